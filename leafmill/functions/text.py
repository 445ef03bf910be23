"""Scalar text functions: white space, scripts, block types, normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split sees it; Java's \s is ASCII only.
WS = r"[\s\u001c-\u001f\u0085\p{Z}]"
#: The same characters one by one: trimming them needs no pattern, which would be tried at every space of a text.
SPACES = "\t\n\u000b\f\r \u001c\u001d\u001e\u001f\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CJK = r"぀-ゟ゠-ヿ㐀-䶿一-鿿가-힯豈-﫿"
HAN = r"㐀-䶿一-鿿豈-﫿"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"
#: Units of ratios (kN/m2, km/h, m/s) are met by their first part.
UNITS = r"(?<![A-Za-z])(?i:[%‰]|°[CF]|[GMk]?Pa|psi|bars?|kN|[kcm]?m|kg|g|t)(?![A-Za-z])"
SECTIONS = (
    "abstract", "acknowledgements", "acknowledgment", "appendix", "background", "case histories", "case history", "conclusion", "conclusions", "discussion", "field data",
    "introduction", "list of symbols", "literature review", "method", "methodology", "nomenclature", "notation", "references", "results", "summary", "testing",
)
PRIORITY = {"title": 0, "heading": 1, "paragraph": 2, "list": 2, "table": 3, "figure": 4, "formula": 4, "uncertain": 5, "placeholder": 6, "footer": 7, "header": 7}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


#: A run of white space other than one plain space; what is printable ASCII is told by one comparison.
_RUN = rf"[^!-~](?:(?<= ){WS}+|(?<=(?! ){WS}){WS}*)"


def squeeze(c: Column) -> Column:
    """Words joined by one space."""
    return strip(F.regexp_replace(c, _RUN, " "))


def count_of(c: Column, chars: str) -> Column:
    """How many characters of the class ``chars`` (without brackets) a text has."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]", ""))


def cjk_count(c: Column) -> Column:
    return F.when(F.octet_length(c) == F.length(c), 0).otherwise(count_of(strip(c), CJK))


def is_cjk(c: Column) -> Column:
    """Over 30 % of the stripped text is CJK."""
    return cjk_count(c) * 10 > F.length(strip(c)) * 3


def has_tofu(c: Column) -> Column:
    """A glyph that stands for one that couldn't be decoded."""
    return F.coalesce(c.rlike("[□�]"), F.lit(False))


def priority(kind: Column) -> Column:
    """Rank of a block type among blocks at one place; unknown types come last."""
    table = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(9))


def is_measure_or_equation(c: Column) -> Column:
    t = strip(c)
    return t.contains("=") | t.contains("≈") | (t.rlike(r"\p{Nd}") & t.rlike(UNITS))


def is_title_case(c: Column) -> Column:
    """Two to six ASCII words, each capitalised."""
    return squeeze(c).rlike("^[A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*){1,5}$")


def classify_ocr(text: Column, font: Column | float = 0.0) -> Column:
    """Type of an OCR block from its text, and its font size where known (over 0).

    Tests of a text's length and beginning come first, and only what they let
    through is searched for measures: most lines are long paragraphs.
    """
    t, font = strip(text), font if isinstance(font, Column) else F.lit(float(font))
    n = F.length(t)
    numbered = t.rlike(rf"^\p{{Nd}}+[.、)）]{WS}+\S") | t.rlike(rf"^\p{{Nd}}+(?:\.\p{{Nd}}+)+[.、)）]?{WS}+\S") | t.rlike(rf"^[A-Z][.、)）]{WS}+")
    phrase = n.between(3, 15) & t.rlike("[一-鿿㐀-䶿가-힯]")
    section = F.when(n <= max(map(len, SECTIONS)), F.lower(t).isin(*SECTIONS)).otherwise(False)
    capital = t.rlike("^[A-Z]") & (section | is_title_case(t))
    heading = n.between(4, 65) & ~t.rlike("[.。?？!！:：；、…]$") & ~F.translate(t, ".- ", "").rlike(f"^{DIGIT}+$") & (numbered | phrase | capital)
    listed, prose = t.rlike(rf"^(?:\p{{Nd}}+[.、)]|[-*+.)]){WS}+"), ~is_measure_or_equation(t)
    plain = F.when(heading & prose, "heading").when(listed & prose, "list").otherwise("paragraph")
    return F.when(n == 0, "uncertain").when((font >= 20) | ((font >= 16) & (n <= 60)), "title").when(font >= 14, "heading").when(font <= 0, plain).otherwise("paragraph")


def classify_text(text: Column, lines: Column) -> Column:
    """Type of a block of native text of so many lines; any character before a space counts as a bullet."""
    t = strip(text)
    words = F.size(F.split(squeeze(text), " "))
    heading = (lines == 1) & F.length(t).between(4, 65) & ~t.rlike("[.。?？!！:：]$") & (t.rlike(rf"^\p{{Nd}}+[.、)）]{WS}+\S") | (words >= 2))
    return F.when(heading, "heading").when(text.rlike(rf"^(?:\p{{Nd}}+[.、)]|[^\n]){WS}+"), "list").otherwise("paragraph")


def is_list_item(c: Column) -> Column:
    return c.rlike(rf"^(?:\p{{Nd}}+[.、)]|[-*+•·]|\[{WS}*x?{WS}*\]|[(（]\p{{Nd}}+[)）]|[A-Z][.、)]){WS}+")


_WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
#: What OCR writes for look-alikes, and what is put in its place, one for one.
CONFUSED, MEANT = "已未日人土干天王午右刀几凤帅币", "己末曰入士千夫玉牛石力九风师巾"
_PHRASES = (("钼孔", "钻孔"), ("钼 孔", "钻孔"), ("/m 深度", "深度/m"), ("深度 /m", "深度/m"), ("真实 类别", "真实类别"), ("预测 类别", "预测类别"))


def normalize(c: Column, swap: bool = True) -> Column:
    """OCR text with narrow alphanumerics, CJK characters together, and spaces between scripts.

    ``swap`` replaces look-alike characters wholesale; it also changes correct text.
    """
    t = F.translate(squeeze(c), _WIDE, _NARROW)
    t = F.regexp_replace(t, f"(?<=[{HAN}]){WS}+(?=[{HAN}])", "")
    if swap:
        t = F.translate(t, CONFUSED, MEANT)
    t = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), _PHRASES, t)
    t = F.regexp_replace(t, f"([a-zA-Z0-9])([{HAN}])", "$1 $2")
    return F.regexp_replace(t, f"([{HAN}])([a-zA-Z0-9])", "$1 $2")


def lang_tag(cjk: Column, latin: Column) -> Column:
    return F.when(cjk & latin, "zh+en").when(cjk, "zh").otherwise("en")


def has_tag_cjk(c: Column) -> Column:
    return (F.octet_length(c) > F.length(c)) & c.rlike(r"[一-鿿぀-ヿ가-힯]")


def is_latex(c: Column) -> Column:
    """A cheap test for text that was rebuilt already: a command or any underscore."""
    t = strip(c)
    return F.coalesce(~t.startswith("[formula]") & t.rlike(r"\\[A-Za-z]+|_"), F.lit(False))


def latex_markers(c: Column) -> Column:
    """Commands and subscripts, to choose between two reconstructions."""
    t = F.coalesce(c, F.lit(""))
    return F.size(F.regexp_extract_all(t, F.lit(r"\\[A-Za-z]+"), F.lit(0))) + F.size(F.regexp_extract_all(t, F.lit(r"_(?=[A-Za-z0-9{])"), F.lit(0)))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters, lower-cased."""
    x, y = (F.array_distinct(F.split(F.lower(c), "")) for c in (a, b))
    x, y = F.array_remove(x, ""), F.array_remove(y, "")
    score = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(score)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def escape_pipe(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def bbox_text(bbox: Column) -> Column:
    """Comma-joined coordinates rounded to two places (half-even on the printed decimal), or unknown."""
    whole = lambda v: F.when(v == F.floor(v), F.concat(F.floor(v).cast("string"), F.lit(".0"))).otherwise(F.bround(v, 2).cast("string"))
    return F.when(bbox.isNull(), "unknown").otherwise(F.concat_ws(",", *[whole(bbox[k]) for k in ("x0", "y0", "x1", "y1")]))
