import pytest

from bazaarspark.operators import metadata as M

CASES = {
    "محصولات سالوته رو میخوام": {"tokens": ["سالوته"], "brand": "Salute", "needs_llm": False},
    "از برند نایس پاپت چی دارید؟": {"tokens": ["نایس", "پاپت"]},
    "کفش ورزشی نایک زیر ۲ میلیون میخوام": {"catalog": ["کفش", "ورزشی", "نایک"], "price_max": 2_000_000.0},
    "محصولات نوت زیر 300هزارتومان": {"brand": "Note", "price_max": 300_000.0, "leftover": []},
    "ماساژور شیائومی زیر ۲ میلیون": {"brand": "Xiaomi", "category": "ماساژور", "price_max": 2_000_000.0},
    "ماسک تثبیت کننده رنگ مو میخوام": {"category": None, "needs_llm": True},
    "لاک ناخن میخوام ولی از مریدا نه": {"brand": None, "category": "لاک ناخن", "exclude_brands": ["Merida"]},
    "دیفاکتو کرم دست": {"near_miss": "دیفاکتو", "needs_llm": True, "category": "کرم دست", "locked_fields": ["category"]},
    "رنگ مو": {"needs_llm": False},
    "لاک ناخن مریدا": {"needs_llm": False, "brand": "Merida"},
    "بین 1 تا ۳ میلیون کرم دست": {"price_min": 1_000_000.0, "price_max": 3_000_000.0},
    "": {"tokens": [], "brand": None},
}


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame([(q,) for q in CASES], "query string")
    got = M.metadata_confidence(M.metadata_extract(M.normalize_queries(rows))).collect()
    return {r["query"]: r.asDict() for r in got}


@pytest.mark.parametrize("query", list(CASES))
def test_reading(read, query):
    for field, want in CASES[query].items():
        assert read[query][field] == want, field


def test_negatives_off(spark):
    q = spark.createDataFrame([("لاک ناخن میخوام ولی از مریدا نه",)], "query string")
    assert M.metadata_extract(q, allow_negatives=False).first()["brand"] == "Merida"


def test_model_answers_never_override(spark):
    q = M.metadata_extract(spark.createDataFrame([(1, "محصولات سالوته"), (2, "چیزی خوب"), (3, "چیزی خوب")], "query_id int, query string"))
    answers = [(1, '{"brand": "merida", "confidence": 0.9}'), (2, '{"brand": "merida", "color": "قرمز", "price_min": 5, "confidence": 0.9}'), (3, '{"brand": "merida", "confidence": 0.2}')]
    got = {r["query_id"]: r for r in M.merge_model_metadata(q, spark.createDataFrame(answers, "query_id int, payload string")).collect()}
    assert got[1]["brand"] == "Salute"
    assert (got[2]["brand"], got[2]["color"], got[2]["price_min"]) == ("Merida", "قرمز", None)
    assert got[3]["brand"] is None
