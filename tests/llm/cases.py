"""Documents with what goes wrong: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep_id bigint, h bigint, name string, kept boolean, score double, n bigint"


def frame(spark, rows):
    """Rows of (doc_id, text) with extra columns named as the operators name theirs."""
    return spark.createDataFrame([(d, t, "en", None, None, -1, -1, None, None, 0.5, None) for d, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def prose(seed, n, vocabulary=4000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share=0.02):
    draw = random.Random(seed)
    return " ".join(f"x{draw.random()}" if draw.random() < share else w for w in text.split(" "))


def awkward():
    long = prose(1, 30000)
    base = prose(2, 300)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "One"), (7, "a b c d e"), (8, "A B C D E"), (9, long), (10, long), (11, long + " end"), (12, base), (13, base), (None, base)]
    rows += [(20 + i, edited(base, i)) for i in range(6)]
    rows += [(40 + i, prose(100 + i, 80) + " " + prose(7, 60) + " " + prose(200 + i, 40)) for i in range(6)]
    rows += [(60, "é\u00a0ß 漢字 \u2003 z"), (61, "é\u00a0ß 漢字 \u2003 z"), (62, "x" * 9000), (63, "x" * 8192), (64, "x" * 8193), (65, "x" * 4096)]
    return rows
