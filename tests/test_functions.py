import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.config import Lede, load
from tidemark.functions import calendar, numbers, scalars, text


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_title_key(spark):
    import html
    import random
    import unicodedata

    r = random.Random(3)
    parts = ["Oil", "ＧＯＬＤ", "&lt;b&gt;", "&amp;amp;", "it&#8217;s", " — ", "\t", "\u00a0", "3.75", "$", "Ünï", "ﬁve", "%", "(", "…"]
    titles = ["".join(r.choices(parts, k=r.randint(0, 7))) for _ in range(200)] + [None]

    def by_hand(t):
        t = unicodedata.normalize("NFKC", html.unescape(t)).lower()
        return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in t).split())

    got = values(spark, [(t,) for t in titles], "t string", text.title_key(F.col("t")))
    assert [g[0] for g in got] == [None if t is None else by_hand(t) for t in titles]


def test_clean_and_ngrams(spark):
    rows = [("See https://x.y/z and WWW.a.b now $TSLA  Up, 5% ok",)]
    assert values(spark, rows, "t string", text.clean(F.col("t"))) == [("see and now up, 5% ok",)]
    grams = spark.createDataFrame([(["a", "b", "c"],), ([],), (["x"],)], "w array<string>").select(text.ngrams(F.col("w"), 1, 2)).collect()
    assert [g[0] for g in grams] == [["a", "b", "c", "a b", "b c"], [], ["x"]]


def test_tokens_keep_letters_of_all_scripts(spark):
    got = values(spark, [("Étude 721 b2b don’t self-made",)], "t string", text.tokens(F.col("t")))
    assert got[0][0] == ["Étude", "b2b", "don", "self-made"]


def by_decimal(x, places):
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0


def test_rounding_agrees_with_decimals(spark):
    xs = [k / 1000 for k in range(-300, 300, 5)] + [k + 0.05 for k in range(-30, 30)] + [-0.049, 0.0, 1e6 + 0.25]
    got = [g[0] for g in values(spark, [(x,) for x in xs], "x double", numbers.half_up(F.col("x")))]
    assert got == [by_decimal(x, 1) for x in xs] and "-0.0" not in map(str, got)
    shares = [k / 2000 for k in range(2001)]
    got = values(spark, [(c,) for c in shares], "c double", numbers.certainty(F.col("c")))
    assert [g[0] for g in got] == [int(by_decimal(float(f"{c * 100:.10f}"), 0)) for c in shares]
    pairs = [(a, b) for b in (1, 3, 7, 16, 40) for a in range(b + 1)]
    got = values(spark, [*pairs, (0, 0)], "a long, b long", numbers.percent(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [*[by_decimal(100 * a / b, 1) for a, b in pairs], None]


def test_band_edges(spark):
    cases = [(4.9, "roughly flat"), (-4.9, "roughly flat"), (5.0, "mildly positive"), (-14.9, "mildly negative"), (15.0, "moderately positive"), (-35.0, "strongly negative"), (None, None)]
    got = values(spark, [(c,) for c, _ in cases], "m double", scalars.band(F.col("m")))
    assert [g[0] for g in got] == [b for _, b in cases]


def test_linkable(spark):
    cases = [("HTTPS://a.b/c d", True), ("http://x", True), ("", False), ("javascript:alert(1)", False), ("https:no-host", False), ("ftp://a", False), (None, False)]
    got = values(spark, [(c,) for c, _ in cases], "u string", scalars.linkable(F.col("u")))
    assert [g[0] for g in got] == [b for _, b in cases]


def test_civil_days_over_clock_changes(spark):
    rows = [("2026-09-29 03:30:00",), ("2026-11-02 03:30:00",), ("2026-11-02 04:30:00",), ("2026-11-02 05:30:00",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp").alias("ts"), F.col("t").cast("timestamp_ntz").alias("ntz"))
    got = df.select(calendar.civil_day(df, "ts"), calendar.civil_day(df, "ntz")).collect()
    want = [dt.date(2026, 9, 28), dt.date(2026, 11, 1), dt.date(2026, 11, 1), dt.date(2026, 11, 2), None]
    assert [g[0] for g in got] == want and [g[1] for g in got] == want
    a, b = spark.range(1).select(*calendar.day_bounds(F.lit(dt.date(2026, 11, 1)))).first()
    assert (b - a) == dt.timedelta(hours=25)


def test_softmax_label(spark):
    row = spark.range(1).select(scalars.softmax_label(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit("neg"), F.lit("pos"))).alias("p")).first()["p"]
    assert row["label"] == "pos" and abs(row["confidence"] - 0.8807970779778823) < 1e-12


def test_settings_precedence(tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("index: {timezone: UTC}\nlede: {flat: 7}\n")
    env = {"TIDEMARK_LEDE__FLAT": "8", "TIDEMARK_LEDE__MILD": "16"}
    s = load(str(f), env, lede={"flat": 9})
    assert (s.index.timezone, s.lede.flat, s.lede.mild, s.lede.moderate) == ("UTC", 9.0, 16.0, Lede().moderate)
    with pytest.raises(ValueError):
        load(env={}, split={"train": 0.9})
    with pytest.raises(ValueError):
        load(env={}, model={"revision": "main"})


def test_stored_sum_is_that_of_sql_decimals(spark):
    """Sums whose sign the shortest text of a double gets wrong."""
    import random

    import duckdb

    r = random.Random(3)
    values = [(g, r.choice([-1, 1]) * r.choice([0.5, 0.25, 3.0, 0.733]) * r.choice([1.0, 0.95, -0.74]) * r.choice([0.5, 1.0, 1.5]) + r.choice([0, 0.293 * 0.9])) for g in range(40) for _ in range(50)]
    values += [(100, 0.1 * 3), (100, -0.3), (101, 15.75), (101, -1e-17), (102, -2.22), (102, 3 * 0.74)]
    got = {x.g: x.s for x in spark.createDataFrame(values, "g long, v double").groupBy("g").agg(numbers.stored_sum(F.col("v")).alias("s")).collect()}
    rows = ", ".join(f"({g}, {v!r}::DOUBLE)" for g, v in values)
    want = dict(duckdb.sql(f"SELECT g, sum(v::DECIMAL(38,18))::DOUBLE FROM (VALUES {rows}) t(g, v) GROUP BY g").fetchall())
    assert got == {g: pytest.approx(s, rel=1e-14, abs=0) for g, s in want.items()}
    assert got[100] == pytest.approx(6.4e-17, rel=1e-9)
