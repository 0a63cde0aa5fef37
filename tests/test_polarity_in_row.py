"""Polarity made within a unit's row: no shuffle of units, the same scores as by joins."""

from lexicade.operators import concepts as co


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_polarity_of_a_short_lexicon_needs_no_join(spark, monkeypatch):
    units = spark.createDataFrame([("good",), ("not good",), ("not a b bad",), ("x",), ("not a b c good",), (None,)], "term string")
    valences = spark.createDataFrame(
        [("good", 1.9), ("good", 0.1), ("bad", -2.5), (None, 3.0), ("x", None)], "token string, valence double")
    got = co.polarity(units, valences)
    assert "Join" not in plan(got) and "Generate" not in plan(got)
    rows = {r["term"]: round(r["score"], 9) for r in got.collect()}
    monkeypatch.setattr(co, "LISTED", 0)
    joined = co.polarity(units, valences)
    assert "Join" in plan(joined) and {r["term"]: round(r["score"], 9) for r in joined.collect()} == rows
