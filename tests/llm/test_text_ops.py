import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import decontaminate, html_text, lm_score, packing, quality, url_filter
from tests.llm.cases import awkward, folded, frame, prose, words


def grams_of(text):
    w = words(folded(text))
    n = min(5, len(w))
    return n, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


@pytest.mark.parametrize("rows_broadcast", [10**6, 0])
def test_leaks(spark, monkeypatch, rows_broadcast):
    """With the sketches broadcast, and with all joins shuffled."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows_broadcast)
    items = [(1, prose(31, 30)), (2, prose(32, 12)), (3, "Tiny item"), (4, ""), (5, None), (6, prose(31, 30)), (None, "x y"), (7, "lone")]
    passage = prose(31, 30).split(" ")
    rows = awkward() + [(100, prose(1, 50) + " " + " ".join(passage).upper() + " tail"), (101, " ".join(passage[:19])), (102, " ".join(passage[:16])), (103, "a tiny\nITEM"), (104, prose(40, 5000) + " " + prose(32, 12)), (105, "lone"), (105, "lone")]
    table = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.leaks(frame(spark, rows), table).collect()}
    want = {}
    for d, t in rows:
        w = words(folded(t))
        for i, x in items:
            n, own = grams_of(x)
            if d is not None and i is not None and own:
                shared = len(own & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
                if 2 * shared >= len(own) and shared:
                    want[d, i] = (shared, len(own))
    assert got == want and (101, 1) in want and (102, 1) not in want
    assert decontaminate.leaks(frame(spark, rows), table.limit(0)).count() == 0 == decontaminate.leaks(frame(spark, []), table).count()


def test_best_fit_fills_bins():
    sizes = np.random.default_rng(1).integers(1, 1025, 5000)
    bins = packing.best_fit(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(5000)) and max(sizes[b].sum() for b in bins) <= 1024
    assert len(bins) <= 1.01 * math.ceil(sizes.sum() / 1024) + 1


@pytest.mark.parametrize("fan_in,task_items", [(8, 250_000), (2, 10)])
def test_packing(spark, fan_in, task_items):
    from leafmill.llm.scratch import Scratch

    rows = awkward() + [(500 + i, prose(i, 20 + i * 7)) for i in range(60)] + [(700, "say <|endoftext|> now"), (12, "twice")]
    docs, scratch = frame(spark, rows).repartition(6), Scratch(spark, "t")
    cut = scratch.save(packing.pieces(docs, packing.default_vocabulary()))
    placed = packing.pack(cut, scratch, fan_in=fan_in, task_items=task_items).collect()
    encode = packing._own(packing.default_vocabulary())
    want = collections.Counter()
    for d, t in rows:
        if d is not None:
            ids = [*encode.encode(t or "", add_special_tokens=False).ids, 2]
            for k, (start, length) in enumerate(packing.cuts(len(ids), 1024)):
                want[d, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    by = collections.defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = math.ceil(sum(r.length for r in placed) / 1024)
    assert len(by) <= least * (1.02 if task_items > 10 else 1.5) + 1


def test_packing_numbers_the_bins_of_every_chunk(spark):
    """Tasks of several chunks, at the first level and at later ones."""
    from leafmill.llm.scratch import Scratch

    lengths = [1024 if i % 3 else 5 + i % 700 for i in range(120)]
    cut = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").coalesce(2)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    default = spark.conf.get(batch)
    spark.conf.set(batch, "5")
    try:
        placed = packing.pack(cut, Scratch(spark, "t"), fan_in=2, task_items=10).collect()
    finally:
        spark.conf.set(batch, default)
    assert sorted((r.doc_id, r.length) for r in placed) == list(enumerate(lengths))
    by = collections.defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [at for at, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024


def test_sequences_round_trip(spark):
    docs = frame(spark, [(i, prose(i, 30 * i)) for i in range(1, 15)] + [(20, None)])
    placed = packing.pack_documents(docs)
    ids = {r.sequence_id: r.ids for r in packing.sequences(docs, placed).collect()}
    for r in placed.collect():
        assert zlib.crc32(np.array(ids[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()) == r.ids_crc32
    assert packing.pack_documents(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_fast_ids_are_the_tokenizers(text):
    encode = packing.tokenizer(packing.default_vocabulary())
    assert encode(text) == packing._own(packing.default_vocabulary()).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("model_bytes", [1 << 30, 0])
def test_lm_scores(spark, model_bytes):
    rows = awkward() + [(1000 + i, prose(i % 40, 60, 300)) for i in range(120)]
    got = {r.doc_id: r for r in lm_score.lm_scores(frame(spark, rows), model_bytes=model_bytes).collect()}
    tokens = {d: [*words(folded(t)), None] for d, t in rows if d is not None}
    count, pairs = collections.Counter(), collections.Counter()
    for d, ts in tokens.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(ts)
            pairs.update(zip([None, *ts], ts, strict=False))
    n, v = sum(count.values()), len(count)
    off = total = 0.0
    for d, ts in tokens.items():
        r = got[d]
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 7 == 2, len(ts), sum(count[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        exact = 0.0
        for h, t in zip([None, *ts], ts, strict=False):
            c = pairs[h, t]
            q = lm_score.BASE ** int(math.log(c) / math.log(lm_score.BASE) + 1e-9) if c else 0
            u = (count[t] + 1) / (n + v + 1)
            exact += math.log10(lm_score.MIX * min(q, count[h], count[t]) / count[h] + (1 - lm_score.MIX) * u if count[h] else u)
        off += abs(r.score - exact)
        total += abs(exact)
    assert off <= 0.003 * total  # the filter's errors


def test_lm_scores_of_a_large_model_move_little(spark):
    """Beyond the memory-mapped model no token is shuffled, only the distinct keys of chunks and answers to them."""
    rows = [(i, prose(i, 1500)) for i in range(200)]
    docs = frame(spark, rows).coalesce(2).persist()
    assert docs.count() == 200
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    got = {r.doc_id: r for r in lm_score.lm_scores(docs, model_bytes=0).collect()}
    moved = shuffled() - before
    assert moved <= 4 * sum(len(t) for _, t in rows)
    assert got == {r.doc_id: r for r in lm_score.lm_scores(docs).collect()}
    docs.unpersist()


def test_lm_scores_over_several_chunks(spark, monkeypatch):
    rows = awkward() + [(1000 + i, prose(i, 300)) for i in range(60)]
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 5000, raising=False)
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", 10_000)
    some = lambda n: sorted(tuple(r) for r in lm_score.lm_scores(frame(spark, rows), model_bytes=n).collect())
    assert some(0) == some(1 << 30)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=60), st.integers(4, 30))
def test_keys_packed_by_segment_come_back(keys, bits):
    keys = np.array(sorted(keys), np.uint64)
    counts = np.arange(1, len(keys) + 1) ** 5
    rows = list(lm_score.packed(keys, bits, 0, counts))
    assert bool(rows) == bool(len(keys))
    for batch in rows:
        found, bounds = lm_score.unpacked(batch, bits)
        assert (found == keys).all() and len(bounds) == batch.num_rows + 1
        assert (np.repeat(batch["segment"].to_numpy(), np.diff(bounds)) == (keys >> np.uint64(64 - bits)).astype(np.int64)).all()
        assert (lm_score._flat(batch["n"], batch["n_width"].to_numpy())[0] == counts.astype(np.uint64)).all()


def test_lm_scores_without_training(spark):
    got = lm_score.lm_scores(frame(spark, [(5, "a b")] if zlib.crc32(b"5") % 7 == 2 else [(next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2), "a b")])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)]
    assert lm_score.lm_scores(frame(spark, [])).count() == 0


def test_quality(spark):
    def text(i):
        if i % 3:
            return prose(i, 60).replace("w1", "the ").capitalize() + "."
        return " ".join(f"{w.upper()}!!" for w in prose(i, 60).split(" ")) if i % 2 else " ".join(["so"] * 40 + ["on"] * 30)

    rows = [(i, text(i)) for i in range(600)] + [(900, None), (901, ""), (902, "x " * 50000), (None, "z"), (5, text(5))]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(600)] + [(None, 1, 0), (7, None, 0), (8, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) - 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    few = quality.classify(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert [r.score for r in few] == [0.5] * 3
    assert quality.classify(frame(spark, []), labels).count() == 0


def test_word_vectors_are_from_all_documents(spark):
    from leafmill.llm.scratch import Scratch

    texts = [prose(i, 40, 300) for i in range(90)] + [None, ""]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    got = quality.neighbour_sums(table, Scratch(spark, "t"), fan_in=2)
    want = np.zeros_like(got)
    for t in texts:
        for ids, table_, seed in zip(next(quality.streams(pa.array([t or ""])))[1:], want, (1, 2), strict=True):
            index = quality.index_vectors(quality.BUCKETS, quality.WIDTH, quality.NONZERO, seed).astype(int)
            for i in range(len(ids)):
                for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                    if i != j:
                        table_[ids[i]] += index[ids[j]]
    assert (got == want).all() and got.any()
    assert not quality.neighbour_sums(table.limit(0), Scratch(spark, "t")).any()


def test_a_lost_segment_is_an_error(tmp_path):
    model = lm_score.Model(f"file://{tmp_path}", 4, 5, 5, None)
    with pytest.raises(FileNotFoundError):
        model.counts(np.array([7], np.uint64))


def test_url_filter(spark):
    urls = ["http://a.example.com/en/1", "https://WWW.Example.com/en/x?q=/fr/", "http://example.com/EN/", "x.net/es/", None, "", "http://", "ftp://b.net/es/#/fr/", "http://b.net/fr", "http://b.net?/fr/", "http://net/fr/", "http://xnet/fr/", "http://com", "http://q.com/", "a://b://c.com/"]
    pages = spark.createDataFrame([(i if i else None, u, "t", "r") for i, u in enumerate(urls)] + [(1, urls[1], "t", "r")], "page_id bigint, url string, text string, rule string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()]
    assert len(got) == len(urls) + 1
    by = {i: g for i, *g in got}
    assert by[1] == ["www.example.com", "/en/x", "www.example.com/en/", "allow"] and by[None] == ["a.example.com", "/en/1", "example.com/en/", "block"]
    assert by[2] == ["example.com", "/EN/", "com/", "allow"] and by[3] == by[4] == by[5] == ["", "", None, "allow"]
    assert by[7] == ["b.net", "/es/", "net/es/", "block"] and by[8] == ["b.net", "/fr", None, "allow"] and by[9] == ["b.net", "", None, "allow"]
    assert by[10][2] == "net/fr/" and by[11][2] is None and by[12] == ["com", "", None, "allow"] and by[14] == ["b:", "//c.com/", None, "allow"]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_long_urls_and_rules_of_equal_length(spark):
    rows = [(1, "http://a.example.com/en/" + "x/" * 200_000), (2, "http://" + "s." * 2000 + "net/fr/"), (3, "http://b.net/es/fr/")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("net/fr/", "block"), 3: ("net/es/", "block")}


def test_digest_collisions_are_told_apart(tmp_path):
    index = url_filter.DigestArray.build(url_filter.RULES, f"file://{tmp_path}/i", hash_of=lambda k: len(k) % 3)
    plain = url_filter.DigestArray.build(url_filter.RULES, f"file://{tmp_path}/p")
    urls = ["http://a.com/", "http://example.com/en/", "http://www.example.com/en/", "http://x.net/es/1", "http://x.net/fr/1", "http://x.org/"]
    assert index.judge(urls, hash_of=lambda k: len(k) % 3) == plain.judge(urls)
    assert url_filter.DigestArray.build([], f"file://{tmp_path}/e").judge(urls[:1]) == [("a.com", "/", None, "allow")]


PAGE = """<!DOCTYPE html><html><head><title>T %(i)d</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="x">
<header><a href="/">Site</a></header><nav><ul>%(menu)s</ul></nav><div class="cookie-notice">We use cookies</div><!-- c --><div class="ad">Buy %(i)d</div>
<article><header><h1>Head %(i)d &amp; more</h1></header><p><b>First   para&nbsp;%(i)d<br>goes on<p>Second &lt;%(i)d&gt;<form>Name <input></form><ul><li>one<li>two</ul>
<aside>see also</aside><div class="comments"><p>I like it</p></div></article><div id="sidebar">side %(i)d</div><footer>&copy; site</footer>"""


def test_html(spark):
    html = lambda i: PAGE % {"i": i, "menu": "".join(f'<li><a href="/{k}">m{k * i}</a></li>' for k in range(i % 4 + 1))}
    rows = [(i, "http://h.org/%d" % i, html(i)) for i in range(8)] + [(20, "http://h.org/n", None), (21, None, ""), (22, "http://solo.org/", html(5)), (23, "x", "bare &amp; text"), (None, "http://h.org/7", html(7))]
    rows += [(30 + i, "http://plain.org/", f"<body><div id=menu><a href=1>home{i}</a></div><div class=main><p>Body {i}<p>Text {i}</div><div>Always here</div>") for i in range(6)]
    rows += [(40, "http://odd.org/", "<p>a<b>b</i></p></div>c < d <a href='x>y'>e</a> <!-- never"), (41, "http://long.org/", "<p>" + "word " * 200000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, host string, n bigint")
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    want = lambda i: f"Head {i} & more\n\nFirst para {i} goes on\n\nSecond <{i}>\n\none\n\ntwo"
    for i in range(8):
        assert got[i].text == want(i) and got[i].n_chars == len(want(i))
    assert got[20].text == got[21].text == "" and got[22].text == want(5) and got[23].text == "bare & text" and got[None].text == want(7)
    for i in range(6):
        assert got[30 + i].text == f"Body {i}\n\nText {i}"
    assert got[40].text.split() == "ab c < d e".split() and got[41].n_chars == 200000 * 5 - 1
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_html_of_a_host_with_null_and_odd_pages(spark):
    """Neutral names and no article: only the template tells what is boilerplate."""
    html = lambda i: f"<body><div class=top>Our site</div><div class=body><p>Body {i}<p>Text {i}</div><div class=last>Always here</div>" + "<div class=x>Also mostly</div>" * (i > 1)
    other = lambda i: f"<body><table class=grid id=g><tr class=r><td class=left>Fixed cell<td class=right>Cell {i}</table><div class=low>Low line</div>"
    hosts = {"null": [None], "empty": ["", " "], "odd": ["<section class=q><p>Odd words"], "lacks": ["<body><div class=top>Our site</div><div class=body><p>Lone</div>"], "both": [None, "<section class=q><p>Odd words"], "two": [other(i) for i in range(9)]}
    rows = [(n, f"http://{h}.org/", t) for h, more in hosts.items() for n, t in enumerate([html(i) for i in range(12)] + more)]
    rows += [(n, "http://copies.org/", "<p>Same words") for n in range(4)]
    got = {(r.url[7:-5], r.page_id): r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for h in hosts:
        assert [got[h, i] for i in range(12)] == [f"Body {i}\n\nText {i}" for i in range(12)], h
    assert got["null", 12] == got["empty", 12] == got["empty", 13] == got["both", 12] == ""
    assert got["odd", 12] == got["both", 13] == "Odd words" and got["lacks", 12] == "Lone"
    assert [got["two", 12 + i] for i in range(9)] == [f"Cell {i}" for i in range(9)]
    assert [got["copies", n] for n in range(4)] == ["Same words"] * 4


def planted(seed):
    """Pages of one layout with neutral names, and what their text is: only the template can part the two."""
    draw = random.Random(seed)
    name = lambda: "x" + "".join(draw.choice("bcdfgh") for _ in range(5))
    words = lambda n: " ".join(draw.choice("lorem ipsum dolor sit amet elit sed do magna".split()).capitalize() if draw.random() < 0.1 else f"w{draw.randrange(5000)}" for _ in range(n))
    style = draw.choice(["plain", "article", "main", "teaser"])
    fixed = [f"<div class={name()}>{words(draw.randint(1, 12))}</div>" for _ in range(4)]
    inner = f"<p class={name()}>{words(6)}</p>"
    menu, box, side = name(), name(), name()
    pages, texts = [], []
    for i in range(draw.randint(6, 14)):
        paragraphs = [words(draw.randint(8, 40)) for _ in range(draw.randint(2, 6))]
        body = [f"<p>{p}" for p in paragraphs]
        if style in ("plain", "teaser"):
            body.append(inner)
        links = "".join(f"<a href={k}>{words(1)}</a> " for k in range(draw.randint(2, 5)))
        main = f"<div class={box}>{' '.join(body)}</div>"
        if style in ("article", "main"):
            main = f"<{style}>{main}</{style}><div class={side}>{words(3)}</div>"
        elif style == "teaser":
            main = f"<article>{words(2)}</article>{main}"
            paragraphs.insert(0, main[9 : main.index("</article>")])
        pages.append(f"<html><body>{fixed[0]}<div class={menu}>{links}</div>{fixed[1]}{main}{fixed[2]}{fixed[3]}</body></html>")
        texts.append("\n\n".join(paragraphs))
    return pages, texts


@pytest.mark.parametrize("seed", range(40))
def test_html_slots_alone_part_text_from_boilerplate(seed):
    pages, texts = planted(seed)
    assert html_text.extract(pages) == texts
    # Read by element names alone these pages would be wrong, but for those whose article is their text.
    if re.search("<(article|main)><div", pages[0]) is None:
        assert all("\n\n".join(html_text.blocks(html_text.tokenize(p))) != t for p, t in zip(pages, texts, strict=True))


def test_html_copies_of_an_article_keep_their_text():
    article = "<article><h1>Head</h1><p>One and the same long text on all of these pages.<p>%s</article>"
    pages = [f"<nav>{i}</nav>" + article % f"Seen {i}" + "<div>Fixed</div>" for i in range(5)]
    assert html_text.extract(pages) == [f"Head\n\nOne and the same long text on all of these pages.\n\nSeen {i}" for i in range(5)]


def slow_root(pages):
    """The keys that occur exactly once on most pages, and for how many, by counting each key on each page."""
    keys = [[t.key for t in page if t.key is not None] for page in pages]
    need = max(html_text.MIN_PAGES, len(pages) // 2 + 1)
    return {k for k in set().union(*keys) if sum(page.count(k) == 1 for page in keys) >= need}


@pytest.mark.parametrize("seed", range(40, 50))
def test_html_template_against_counting(seed):
    """Outside articles the template's places are those of tokens that counting finds once on most pages."""
    pages = [html_text.tokenize(p) for p in planted(seed)[0]]
    template, root = html_text.deduce(pages), slow_root(pages)
    for p, page in enumerate(pages):
        inside = html_text._within(page, "article", "main")
        want = [i for i, t in enumerate(page) if t.key in root and sum(u.key == t.key for u in page) == 1 and not (inside[i] and t.name == "#text")]
        assert template.begins[p][0] == want


def test_html_split_groups_agree(spark):
    rows = [(i, "http://h.org/", f"<nav>{i}</nav><article><p>text {i}</p></article>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(pages, group=5).collect()} == {i: f"text {i}" for i in range(40)}
