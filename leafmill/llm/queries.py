"""All queries of this subpackage and the SQL of those that SQL can state."""

from leafmill.llm import decontaminate, exact_dedup, html_text, lm_score, near_dedup, packing, quality, secrets, substrings, url_filter

MODULES = (html_text, substrings, url_filter, decontaminate, lm_score, packing, secrets, quality, near_dedup, exact_dedup)
QUERIES: dict = {}
ORACLE: dict = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE |= getattr(module, "ORACLE", {})
