import collections

import corpus_pipeline
from leafmill.llm import quality
from leafmill.llm.queries import ORACLE, QUERIES
from leafmill.llm.scratch import Scratch
from tests.llm.cases import folded, frame, prose, words
from tests.llm.test_dedup import components, shingles

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = quality.fit(docs, labels, Scratch(spark, "t"))
    good = {r.doc_id for r in quality.score(docs, net).collect() if r.predicted == 1}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    last = collections.defaultdict(int)
    for d, t in texts.items():
        last[t] = max(last[t], d)
    texts = {d: t for d, t in texts.items() if last[t] == d}
    part = components({d: shingles(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if part[d] == d}
    items = [words(folded(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]
    texts = {d: t for d, t in texts.items() if not any(2 * len(i & shingles(t)) >= len(i) for i in items)}
    placed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in placed} == set(texts)


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name


def test_copies_of_repeated_rows(spark):
    """One of identical rows stays, and a copied text takes no other text of its doc_id with it."""
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "c"), (4, None), (4, ""), (5, "d"), (None, "z"), (None, "z")]
    docs = frame(spark, rows)
    out = corpus_pipeline.drop_copies(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "z"), (0, "z"), (1, "b"), (2, "a"), (3, "c"), (4, ""), (5, "d")]


def test_stages_compose_lazily_and_judge_rows_by_their_own_text(spark):
    a, b = prose(1, 90), prose(2, 90)
    rows = [(1, a), (1, b), (2, a), (3, "q r s t u"), (3, "q r s t u"), (4, a + " end"), (5, b + " end"), (6, None), (7, ""), (None, a)]
    docs = frame(spark, rows)
    first = corpus_pipeline.drop_copies(spark, docs, SF)
    out = corpus_pipeline.drop_leaks(spark, corpus_pipeline.drop_near_copies(spark, first, SF), SF)
    # (2, a) stays of the copies and so leads its near copy 4; (1, b) leads 5; 7 stays of the empty ones.
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, a), (1, b), (2, a), (3, "q r s t u"), (7, "")]
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert near.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in near.collect()) == sorted([(0, a), (1, a), (1, b), (3, "q r s t u"), (6, ""), (7, "")])
    # Two near copies that share a doc_id: one stays.
    both = corpus_pipeline.drop_near_copies(spark, frame(spark, [(8, a), (8, a + " end"), (9, b)]), SF).collect()
    assert sorted(r.doc_id for r in both) == [8, 9]


def test_a_leaking_row_takes_no_other_row_of_its_doc_id_with_it(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    out = corpus_pipeline.drop_leaks(spark, frame(spark, [(1, prose(5, 40)), (1, "so " + leak), (2, leak), (3, None)]), SF)
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, prose(5, 40)), (3, "")]


def test_every_operator_has_its_query():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for i in range(1, 11) for n in QUERIES if n.startswith(f"op{i}_")]
    assert len(QUERIES) == 10 and set(ORACLE) <= set(QUERIES)
