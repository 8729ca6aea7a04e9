"""The pipeline's stages against brute force on the smallest tables, and on a fixture with nulls and clashing columns."""

from __future__ import annotations

from helpers import CLASHES, documents, jaccard_brute, ordered, substring_brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_effective(spark, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_duplicates", "substrings", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = None
    for name, stage in P.STAGES:
        before, out = docs, stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "near_duplicates":
            want = [r[0] for r, b in zip(rows, jaccard_brute(rows)) if not b[1] or r[0] == b[2]]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(want)
        if name == "substrings":
            want = {b[0]: b[1] - b[2] for b in substring_brute(rows)}
            assert {r.doc_id: len(r.text.split()) for r in docs.collect()} == want
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r[0] for r in rows}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    junk = [k for k, r in labels.items() if r.quality == 0]
    left = {r.doc_id for r in docs.collect()}
    assert sum(k in left for k in junk) <= 0.2 * len(junk)


def test_stages_take_nulls_and_extra_columns(spark):
    import corpus_pipeline as P

    docs = documents(spark, clashing=True)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert set(CLASHES) <= set(docs.columns)
        assert stage(spark, documents(spark, []), SF).collect() == []


def test_run_gives_the_rows_of_the_last_stage(spark):
    import corpus_pipeline as P

    rows = P.run(spark, SF).collect()
    assert rows and len(ordered((r.doc_id, r.piece) for r in rows)) == len({(r.doc_id, r.piece) for r in rows})
