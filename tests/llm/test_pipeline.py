import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = []
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] == counts[1] and counts[2] <= counts[1] and counts[0] <= spark.read.parquet(f"{SF}/documents.parquet").count()
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert {r[0] for r in P.STAGES[-1][1](spark, docs, SF).select("doc_id").collect()} == ids


EDGE = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, extra int"


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    a = " ".join(f"w{i}" for i in range(60))
    texts = [(3, a), (5, a + " more"), (5, "a text of its own that has\nno copy here"), (6, None), (7, ""), (8, " \n\t"), (None, a), (9, "x y z v w u\n" * 3_000), (10, "one and the same words"), (10, "one and the same words"), (11, "\n" * 500)]
    rows = [(i, t, None, s, None, 1, "d", 2) for (i, t), s in zip(texts, ["a", "b", None] * 4)]
    docs = spark.createDataFrame(rows, EDGE)
    out = {name: [tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()] for name, stage in P.STAGES}
    key = lambda rows: sorted((r[:2] for r in rows), key=repr)
    assert key(out["toxicity"]) == key(rows)
    assert sorted((r[0] or 0) for r in out["line_dedup"]) == sorted((r[0] or 0) for r in rows)
    assert key(out["near_dedup"]) == key([r for i, r in enumerate(rows) if i not in (1, 9)])
    assert {r[0] for r in out["mixing"]} <= {r[0] for r in rows} and {6, 7, 8, 11} <= {r[0] for r in out["mixing"]}
    assert sorted(r[0] for r in out["mixing"] if r[0] in (6, 7, 8, 11)) == [6, 7, 8, 11]
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert {r[0] for r in out["packing"]} == {r[0] for r in rows}
    assert P.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_dedup_keeps_the_other_text_of_an_identifier(spark):
    import corpus_pipeline as P

    a = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(3, a), (5, a + " more"), (5, "another text without any copy")], "doc_id long, text string")
    assert sorted(map(tuple, P.near_dedup_stage(spark, docs, "").collect())) == [(3, a), (5, "another text without any copy")]


def test_names():
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
