"""The pipeline's stages against plain versions of their decisions."""

import os

import pytest
from test_free import plain_components
from test_native import plain_hits

import corpus_pipeline
from pageloom.llm import pii, sentencepiece_scan
from pageloom.llm.queries import MODEL

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not (os.path.isdir(SF) and os.path.exists(MODEL)), reason="needs the given tables and a model")


def test_stages(spark):
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    names = kept.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, SF)
        rows = kept.collect()
        kept = spark.createDataFrame(rows, kept.schema)
        after = {r["doc_id"]: r for r in rows}
        if k < 4:
            assert kept.columns == names
        if k == 0:
            good = [d for d in before if labels.get(d) == 1]
            assert sum(d in after for d in good) >= 0.98 * len(good)
        if k == 1:
            assert set(after) == {d for d, _, c in plain_components(list(before.items())) if d == c}
        if k == 2:
            assert set(after) == {d for d, t in before.items() if not plain_hits(t, items)[3]}
        if k == 3:
            assert {d: r["text"] for d, r in after.items()} == {d: pii.masked(t, pii.find(t)[1]) for d, t in before.items()}
        if k == 4:
            p = sentencepiece_scan.pieces_of(MODEL)
            assert {d: p.decode(r["ids"]) for d, r in after.items()} == before
        before = {d: (r["text"] if k < 4 else None) for d, r in after.items()}


GOOD = "The river runs past the old mill and the children of the village play on its banks every summer evening until the light is gone and their mothers call them in for supper {}."


def pipeline_docs(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, 2, 3) for k, t in rows], "doc_id long, text string, row string, _row int, __row int, key int")


def test_rows_that_share_an_id(spark):
    a, b = GOOD.format("alpha beta"), "Nothing like it: quite another text with words of its own, one after the other, and no more than that to say."
    d = pipeline_docs(spark, [(1, a), (2, a), (2, b), (2, b), (None, a), (None, "Alone without a number, but a text like any other that nobody else has written down."), (3, None), (3, None), (4, "")])
    got = corpus_pipeline.distinct(spark, d, None)
    assert got.columns == d.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, a), (2, b), (None, "Alone without a number, but a text like any other that nobody else has written down."), (3, None), (3, None), (4, "")], key=str)


def tables(spark, tmp_path, docs, labels, items=()):
    pipeline_docs(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_contaminated_rows_that_share_an_id(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    d = pipeline_docs(spark, [(7, item), (7, "a clean text of the same number"), (8, None), (9, "")])
    at = tables(spark, tmp_path, [], [], [(1, item)])
    assert sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.uncontaminated(spark, d, at).collect()), key=str) == sorted([(7, "a clean text of the same number"), (8, None), (9, "")], key=str)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(99, 0, 0), (98, 1, 0)]])
def test_without_labels_all_rows_stay(spark, tmp_path, labels):
    rows = [(1, GOOD.format("one")), (2, "x y x y x y"), (3, None)]
    at = tables(spark, tmp_path, rows, labels)
    assert corpus_pipeline.quality(spark, pipeline_docs(spark, rows), at).count() == 3


def test_run_over_few_rows_leaves_one_table(spark, tmp_path):
    from pageloom.llm import store

    at = tables(spark, tmp_path, [(1, GOOD.format("write to anna@example.org")), (1, GOOD.format("write to anna@example.org")), (2, "very long " * 40_000), (3, None)], [])
    store.release()
    out = corpus_pipeline.run(spark, at)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3] and out.columns == ["doc_id", "n_pieces", "ids"]
    assert len(store._made) == 1
    store.release()
    empty = tables(spark, tmp_path / "e", [], [])
    assert corpus_pipeline.run(spark, empty).collect() == []
