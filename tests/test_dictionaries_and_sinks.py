import glob
import os
import random

from pyspark.sql import functions as F

from bazaarspark.operators import metadata, phrases
from bazaarspark.plans import catalog
from bazaarspark.streaming import sinks


def test_phrases_of_a_table_equal_those_of_the_plan(spark):
    """The brands as a table find what the expressions with the brands written out find."""
    from bazaarspark.functions import dictionaries as D
    from bazaarspark.functions import text as X

    rng = random.Random(3)
    pieces = [a for a, _ in D.brand_aliases()] + ["ماسک", "x", "not", "Note", "hello", "نوت‌ها", "  "]
    rows = [(i, rng.choice([" ", "  "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for i in range(200)] + [(900, None), (901, "")]
    texts = spark.createDataFrame(rows, "query_id long, query string")
    got = {r["query_id"]: (r["canonical"], r["canonicals"]) for r in phrases.first_phrases(texts, phrases.brand_table(spark)).collect()}
    want = texts.select("query_id", X.first_phrase("query", D.brand_aliases()).alias("c"), X.all_phrases("query", D.brand_aliases()).alias("a")).collect()
    assert got == {r["query_id"]: (r["c"], r["a"]) for r in want if r["c"]}


def test_near_misses_equal_those_of_the_plan(spark):
    rng = random.Random(4)
    from bazaarspark.functions import dictionaries as D

    aliases = [a for a, _ in D.brand_aliases() if len(a) >= 4]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 4)):
            w = list(rng.choice(aliases))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ا"])
                w = w or ["z"]
            words.append("".join(w))
        rows.append((i, words + rng.choice([[], ["خوب"], ["ab"]])))
    tokens = spark.createDataFrame(rows, "query_id long, tokens array<string>")
    got = {r["query_id"]: r["token"] for r in phrases.near_misses(tokens, phrases.brand_table(spark)).collect()}
    want = {r["query_id"]: r["t"] for r in tokens.select("query_id", metadata.near_miss_brand(F.col("tokens")).alias("t")).collect() if r["t"] is not None}
    assert got == want and len(want) > 50


def test_many_aliases_meet_by_equality(spark):
    """The work for 20,000 aliases is a join by parts of words, not of all pairs."""
    aliases = spark.range(20_000).select(F.concat(F.lit("name"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("alias"))
    tokens = spark.range(2_000).select(F.col("id").alias("query_id"), F.array(F.concat(F.lit("nme"), F.lpad(F.col("id").cast("string"), 5, "0"))).alias("tokens"))
    plan = phrases.near_misses(tokens, aliases)
    assert plan.count() == 2_000
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def streamed(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def test_a_batch_that_is_tried_again_is_written_once(spark, tmp_path):
    schema = "customer_id string, turn_id long, ts timestamp, user_message string, assistant_message string"
    ts = F.timestamp_seconds(F.lit(1_700_000_000))
    turns = spark.range(20).select(F.lit("c").alias("customer_id"), F.col("id").alias("turn_id"), ts.alias("ts"), F.concat(F.lit(" hi "), "id").alias("user_message"), F.when(F.col("id") % 2 == 0, "yes").otherwise(" ").alias("assistant_message"))
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    turns.where("turn_id < 12").write.parquet(src)
    sinks.append_messages(streamed(spark, src, schema), out, check).awaitTermination()
    first = spark.read.parquet(out).count()
    assert first == 12 + 6
    # As if the driver had stopped after writing a batch and before noting it: the batch is tried again.
    for f in glob.glob(f"{check}/commits/*") + glob.glob(f"{check}/commits/.*crc"):
        os.remove(f)
    turns.where("turn_id >= 9").write.mode("append").parquet(src)  # three turns come twice
    sinks.append_messages(streamed(spark, src, schema), out, check).awaitTermination()
    rows = spark.read.parquet(out).select("role", "content").collect()
    assert len(rows) == 20 + 10 and len(set(rows)) == 20 + 1


def test_feedback_once(spark, tmp_path):
    schema = "feedback_id long, ts timestamp, rating string, conversation_id string, message_id string"
    rows = spark.range(10).select((F.col("id") % 6).alias("feedback_id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.when(F.col("id") % 6 == 0, "other").otherwise("positive").alias("rating"), F.lit("a; drop").alias("conversation_id"), F.lit("m1").alias("message_id"))
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows.write.parquet(src)
    sinks.append_feedback(streamed(spark, src, schema), out, check).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted(r["feedback_id"] for r in got) == [1, 2, 3, 4, 5] and {r["conversation_id"] for r in got} == {None}


def test_series_are_one_scan(spark):
    plan = catalog.queries()["metric_series"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
