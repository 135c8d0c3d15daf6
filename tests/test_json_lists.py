import json
import random

import pytest

from bazaarspark.sources.ingest import read_cases

SCHEMA = "id long, text string, more struct<list:array<string>>"


def cases(rng, n):
    bits = ['}', '{', '[', ']', '"', '\\', ',', '\n', 'é', 'x', '}, {', '\\"}', " "]
    return [{"id": i, "text": "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), "more": {"list": [rng.choice(bits) for _ in range(rng.randint(0, 4))]}} for i in range(n)]


@pytest.mark.parametrize("indent,block", [(None, 150), (2, 150), (None, 1 << 20), (None, 40)])
def test_one_file_in_many_tasks(spark, tmp_path, indent, block):
    rows = cases(random.Random(block), 120)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "in" / "b.json").write_text(" [] \n")
    (tmp_path / "in" / "c.json").write_text(json.dumps([rows[0] | {"id": 1_000}]) + "\n\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, block)
    try:
        got = read_cases(spark, str(tmp_path / "in"), SCHEMA)
        found = sorted((r["id"], r["text"], tuple(r["more"]["list"])) for r in got.collect())
        tasks = spark.read.option("lineSep", "}").text(str(tmp_path / "in")).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == sorted((r["id"], r["text"], tuple(r["more"]["list"])) for r in [*rows, rows[0] | {"id": 1_000}])
    assert block > 1_000 or tasks > 10


def test_a_second_list_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": 1}]\n[{"id": 2}]')
    with pytest.raises(Exception, match="goes on behind its list"):
        read_cases(spark, str(tmp_path / "x.json"), SCHEMA).collect()


@pytest.mark.parametrize("text", ['{"id": 1}', "", "7", '[{"id": 1}', '[{"id": "x', '{"a": [1]}'])
def test_anything_but_a_list_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    if text:
        with pytest.raises(ValueError):
            read_cases(spark, str(tmp_path / "x.json"), SCHEMA).collect()
    else:
        assert read_cases(spark, str(tmp_path / "x.json"), SCHEMA).count() == 0
