"""The registered queries of the library and the SQL that states each of them."""

from leafmill.plans import chart_queries, eval_queries, layout_queries, text_queries

QUERIES: dict = {}
ORACLE: dict = {}
for module in (text_queries, layout_queries, chart_queries, eval_queries):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
