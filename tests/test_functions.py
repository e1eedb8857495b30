from pyspark.sql import functions as F

from tessellar.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_keep_letters_of_any_script(spark):
    assert one(spark, T.tokens, "naïve-protéine, 2 µL") == ["naïve", "protéine", "2", "µl"]
    assert one(spark, T.tokens, None) == []


def test_params_follow_the_pattern_to_the_letter(spark):
    get = lambda s: [(p["value"], p["unit"]) for p in one(spark, T.params, s)]
    assert get("70% ethanol") == [] and get("70%x") == [(70.0, "%")]
    assert get("12,000 xg") == [(0.0, "xg")]
    assert get("10 µL") == [(10.0, "µL")] and get("3 hours") == []


def test_dotted_keys_sort_by_number(spark):
    keys = ["10", "2", "1.10", "1", "1.2"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").orderBy(T.dotted_key(F.col("k"))).collect()
    assert [r["k"] for r in rows] == ["1", "1.2", "1.10", "2", "10"]


def test_jaccard_of_empty_sets_is_zero(spark):
    e = F.array().cast("array<string>")
    assert spark.range(1).select(T.jaccard(e, e).alias("y")).first()["y"] == 0.0


def test_windows(spark):
    cut = lambda s: one(spark, lambda c: T.windows(c, 4, 3), s)
    assert cut("abcd") == ["abcd"] and cut("") == [""] and cut(None) == [""]
    assert cut("abcdefg") == ["abcd", "defg", "g"]


def test_units_and_titles(spark):
    assert one(spark, T.unit, "μL") == "µl" and one(spark, T.unit, "Hours") == "h"
    assert one(spark, T.title_key, "Materials & [Methods]: in-vitro") == "materials and methods in vitro"


def test_steps_keep_digits_at_their_ends_and_lose_spaces(spark):
    lines = ["  Add the salt to the water of the bath. ", "1234 grams of the salt are added to bath 11", "2 more of the same are then added to bath 2"]
    assert one(spark, T.steps, "\n".join(lines)) == [x.strip() for x in lines]
