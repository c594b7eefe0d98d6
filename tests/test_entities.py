"""Entity codes inside headlines."""

from tidemark.operators import joins


def test_headlines_meet_the_mapping_without_a_shuffle_of_texts(spark):
    schema = "article_id string, title string, description string, source string, score double, entities array<struct<symbol: string, sentiment_score: double>>"
    articles = spark.createDataFrame([
        ("a", "Ab and eur in one", None, "", 0.5, [("X:EUR", 0.25)]), ("b", "no hit", "here", "wire", 1.0, []), ("c", "the WIRE says z", None, "wire", -1.0, None),
        ("d", "abc", "z", "", None, []), ("e", "", "", "", 1.0, []), ("f", "ab" * 300 + "z", "", "", 0.0, []),
    ], schema)
    mapping = spark.createDataFrame([("EURO", "EUR"), ("AB", "abab"), ("LAST", "Z"), ("FIRST", "ab")], "symbol string, code string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.match_entities(articles, mapping)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [("a", "EURO", 0.25), ("a", "FIRST", 0.5), *[("c", s, -1.0) for s in ("AB", "EURO", "FIRST", "LAST")], *[("f", s, 0.0) for s in ("AB", "FIRST", "LAST")]]
    assert "hashpartitioning(gram" not in plan and "hashpartitioning(code" not in plan
