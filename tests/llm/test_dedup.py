import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, graph, near_dedup, substrings
from leafmill.llm.scratch import Scratch
from leafmill.llm.words import grams, runs, scan
from tests.llm.cases import awkward, edited, folded, frame, prose, words


def test_words_agree_with_a_regular_expression():
    texts = ["", " a  b\tc\x0b", "é\u00a0x\u2003 y", "\x1cq\x85 z", "end ", "漢 字"]
    column = pa.array(texts)
    for _, _, data, offsets in runs(column, 4):
        found = scan(data, offsets)
    got = []
    for lo, hi, data, offsets in runs(column, 4):
        found = scan(data, offsets)
        for t in range(hi - lo):
            got.append([bytes(data[a:b]).decode() for a, b in zip(found.start[found.first[t] : found.first[t + 1]], found.end[found.first[t] : found.first[t + 1]], strict=True)])
    assert got == [words(t) for t in texts]


def test_hashes_depend_on_words_alone():
    a = scan(np.frombuffer(b"xx hello wide  world", np.uint8), np.array([0, 20])).hashes()
    b = scan(np.frombuffer(b"hello\nwide world", np.uint8), np.array([0, 16])).hashes()
    assert a[1:].tolist() == b.tolist()
    assert grams(a, 3)[1] == grams(b, 3)[0] and grams(a, 2)[0] != grams(a, 2)[1]


@pytest.mark.parametrize("block_bytes,hash_of", [(4096, F.xxhash64), (exact_dedup.BLOCK_BYTES, F.xxhash64), (16, F.xxhash64), (16, lambda c: F.pmod(F.xxhash64(c), F.lit(3)))])
def test_exact_dedup(spark, block_bytes, hash_of):
    """The last case makes nearly all blocks collide: names must still part them."""
    rows = [r for r in awkward() if r[0] is None or r[0] not in (9, 10, 11) or block_bytes > 16]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows), block_bytes=block_bytes, hash_of=hash_of).collect()}
    groups = collections.defaultdict(list)
    for d, t in rows:
        if d is not None:
            groups[t or ""].append(d)
    assert len(got) == sum(map(len, groups.values()))
    for t, ids in groups.items():
        for d in ids:
            r = got[d]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_repeated_rows_and_empty(spark):
    got = exact_dedup.exact_dedup(frame(spark, [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (1, "b")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 1, True), (1, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True)]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def shingles(text):
    w = words(folded(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(sets):
    part = {d: d for d in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def near_rows():
    rows = awkward()
    for g in range(8):  # groups with copies of copies, and pairs about the threshold
        text = prose(500 + g, 120 + 10 * g)
        for i in range(12):
            rows.append((1000 + g * 50 + i, text))
            text = edited(text, g * 100 + i, 0.03)
    edge = prose(900, 104)  # 100 shingles
    rows += [(2000, edge)] + [(2001 + k, " ".join(edge.split(" ")[: 104 - k])) for k in (28, 29, 30, 31, 32)]
    return rows


@pytest.mark.parametrize("star_rounds", [1, 0, 2])
def test_near_dedup(spark, star_rounds):
    """Components as by brute force, with stars first, and with full sets from the start."""
    rows = near_rows()
    got = {r.doc_id: r for r in near_dedup.near_dedup(frame(spark, rows), star_rounds=star_rounds).collect()}
    sets = {d: shingles(t) for d, t in rows if d is not None}
    want = components(sets)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(s), want[d], want[d] == d) for d, s in sets.items()}


@pytest.mark.parametrize("size,core,n", [(10, 7, 400), (200, 140, 90)])
def test_a_list_of_sets_that_share_a_core_is_not_expanded(spark, size, core, n):
    """All share ``core`` of their shingles, a little less than the similarity asks; candidates stay linear."""
    shared = [f"c{i}" for i in range(core + 4)]
    rows = [(i, " ".join(shared + [f"u{i}x{j}" for j in range(size - core)])) for i in range(n)]
    rows += [(n + i, rows[i][1].rsplit(" ", 1)[0] + f" v{i}") for i in range(0, n, 10)] + [(3 * n, " ".join(shared[:-1] + ["end"]))]
    sets = {d: shingles(t) for d, t in rows}
    assert all(len(s) == size for d, s in sets.items() if d < 3 * n)
    counts = []
    got = {r.doc_id: r.component_id for r in near_dedup.near_rows(frame(spark, rows), Scratch(spark, "t"), counts=counts).collect()}
    assert got == components(sets)
    assert sum(counts) <= 4 * len(rows) and len(counts) <= 3


def test_candidates_grow_with_the_rows(spark):
    """Ten times the rows of one core make about ten times the candidates, not a hundred."""
    shared, total = [f"c{i}" for i in range(11)], []
    for n in (200, 2000):
        counts = []
        rows = [(i, " ".join(shared + [f"u{i}x{j}" for j in range(3)])) for i in range(n)]
        got = near_dedup.near_rows(frame(spark, rows), Scratch(spark, "t"), counts=counts)
        assert got.select("component_id").distinct().count() == n
        total.append(sum(counts))
    assert total[1] <= 12 * total[0]


def test_near_dedup_of_rows_that_share_a_doc_id(spark):
    a, b = prose(11, 200), prose(12, 200)
    rows = [(1, a), (1, b), (2, edited(a, 1, 0.01)), (3, edited(b, 2, 0.01)), (3, edited(b, 2, 0.01)), (4, prose(13, 50)), (4, None), (4, None)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark, rows)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (4, 4, True)]
    # Sharing a doc_id links nothing: b's copy isn't in a's component.
    rows = [(5, a), (5, b), (1, edited(a, 1, 0.01))]
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_dedup(frame(spark, rows)).collect())
    assert got == [(1, 1), (5, 1), (5, 5)]


def test_near_dedup_empty(spark):
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0
    assert [r.kept for r in near_dedup.near_dedup(frame(spark, [(3, None), (4, " ")])).collect()] == [True, True]


@pytest.mark.parametrize("task_edges", [10**6, 0])
def test_components(spark, task_edges):
    chain = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 9), (9, 5), (7, 7), (50, 1)] + [(200, 201 + i) for i in range(30)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint"), Scratch(spark, "t"), task_edges).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 5: 3, 9: 3, 50: 1, 1: 1, 200: 200, **{201 + i: 200 for i in range(30)}}


@pytest.mark.parametrize("task_edges", [10**6, 0])
def test_components_of_a_path_whose_first_round_leaves_two_centres(spark, task_edges):
    path = [(1, 3), (3, 4), (4, 5), (5, 2)]
    got = sorted((r.node, r.component) for r in graph.components(spark.createDataFrame(path, "a bigint, b bigint"), Scratch(spark, "t"), task_edges).collect())
    assert got == [(i, 1) for i in range(1, 6)]


def removed(rows, window):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, t in rows:
        if d is not None:
            w = words(t)
            gone = set()
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
            out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,k", [(50, 16), (8, 3), (5, 5)])
def test_substring_dedup(spark, window, k):
    rows = [r for r in near_rows() if window == 50 or r[0] not in (9, 10, 11)]
    rows += [(3000, "go " * 200), (3001, "go " * 130 + "stop"), (3002, "a b " * 90)]  # no minimiser stands out
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(frame(spark, rows), window=window, k=k).collect()}
    assert got == removed(rows, window)


def test_substring_dedup_empty_and_repeats(spark):
    assert substrings.substring_dedup(frame(spark, [])).count() == 0
    text = prose(3, 70)
    got = substrings.substring_dedup(frame(spark, [(1, text), (1, text), (1, prose(4, 70))])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 0]


def test_substring_dedup_of_texts_that_share_a_doc_id(spark):
    passage, other = prose(3, 70), prose(5, 90)
    rows = [(1, passage), (5, passage + " tail"), (5, other), (5, other), (5, None)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(frame(spark, rows)).collect())
    assert got == sorted((d, *removed([rows[0], (d, t)] if d > 1 else rows[:1], 50)[d]) for d, t in rows)


def test_hot_names_go_by_broadcast(spark, monkeypatch):
    """The same results where nearly every key counts as hot."""
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 1)
    rows = [(i, "same") for i in range(40)] + [(100 + i, prose(i % 3, 60)) for i in range(12)] + [(200, prose(9, 400))]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(frame(spark, rows), block_bytes=64).collect()}
    assert got == {d: max(e for e, u in rows if u == t) for d, t in rows}
    sets = {d: shingles(t) for d, t in rows}
    assert {r.doc_id: r.component_id for r in near_dedup.near_dedup(frame(spark, rows)).collect()} == components(sets)
