"""Operators against brute force, with hot keys and ties on purpose."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anchorkit.checks import align_columns, coerce_numeric, nan_to_null, require_columns
from anchorkit.operators import joins
from anchorkit.operators import running as ru
from anchorkit.operators.align import band_aligned_min
from anchorkit.operators.cohort import dedup, top_k
from anchorkit.operators.encode import levels_of, one_hot, top_categories


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_balanced_join_paths_agree(spark, monkeypatch, how):
    left = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 500).alias("k"), "id")
    right = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, "k", how)
    want = (plain.count(), plain.agg(F.sum("v"), F.sum("id")).first())
    small = joins.balanced_join(left, right, ["k"], how)
    hybrid = joins.balanced_join(left, right, ["k"], how, max_bytes=0)
    assert joins.hot_keys(left.select("k"), ["k"]) == [(7,)]
    for got in (small, hybrid):
        assert (got.count(), got.agg(F.sum("v"), F.sum("id")).first()) == want
    assert "Union" in hybrid._jdf.queryExecution().toString() and "Union" not in small._jdf.queryExecution().toString()


def test_balanced_join_two_keys_and_bad_how(spark):
    left = spark.range(30_000).select(F.lit("u").alias("a"), (F.col("id") % 2).alias("b"), "id")
    right = spark.createDataFrame([("u", 0, 1.0), ("u", 1, 2.0), ("w", 0, 3.0)], "a string, b long, v double")
    got = joins.balanced_join(left, right, ["a", "b"], max_bytes=0)
    assert got.agg(F.sum("v")).first()[0] == 45_000
    with pytest.raises(ValueError):
        joins.balanced_join(left, right, ["a"], "outer")


def test_hot_missing_key_stays_in_a_left_join(spark):
    left = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 400).alias("k"), "id")
    right = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert joins.hot_keys(left.select("k"), ["k"]) == [(None,)]
    got = joins.balanced_join(left, right, ["k"], "left", max_bytes=0)
    assert got.count() == 40_000 and got.where("v IS NULL").count() == 20_000
    assert joins.balanced_join(left, right, ["k"], max_bytes=0).count() == 20_000


def test_hot_entity_window_means(spark):
    """A third of all events in one entity: broadcast, hybrid and plain aggregation agree."""
    from anchorkit.operators.windows import EventSchema, Item, window_means

    events = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 997).cast("long").alias("stay_id"), (F.col("id") % 3).cast("int").alias("itemid"),
        F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, CAST(id % 40 AS INT))").alias("charttime"),
        (F.col("id") % 101).cast("double").alias("valuenum"))
    anchors = spark.range(0, 900).select(F.col("id").alias("stay_id"), F.expr("timestamp_ntz'2020-01-01 05:00:00'").alias("intime"))
    items = [Item(0, "a", 10, 90), Item(1, "b", 0, 100), Item(2, "c", 50, 60)]
    run = lambda **o: rows(window_means(events, anchors, items, EventSchema(), **o).select(
        "stay_id", *[F.round(f"{n}_mean", 9) for n in "abc"]))
    assert run() == run(max_bytes=0)


def test_measured_bytes_counts_text(spark):
    assert joins.measured_bytes(spark.createDataFrame([("x" * 1000,)], "a string")) >= 1000
    assert joins.measured_bytes(spark.createDataFrame([], "a string")) == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-50, 50), st.integers(-3, 5)), min_size=1, max_size=120))
def test_running_total(spark, data):
    unique = {(g, o): w for g, o, w in data}
    df = spark.createDataFrame([(g, o, w) for (g, o), w in unique.items()], "g int, o long, w long")
    got = {(r.g, r.o): r.running for r in ru.running_total(df, ["g"], "o", "w").collect()}
    assert got == {(g, o): sum(w for (h, p), w in unique.items() if h == g and p <= o) for g, o in unique}


def test_running_total_uses_many_buckets(spark):
    df = spark.range(5000).select("id", F.lit(1).cast("long").alias("w"))
    borders = ru.order_borders(df, "id")
    assert 5 <= len(borders) <= 8
    counts = [r["count"] for r in df.groupBy(ru.bucket_of("id", borders).alias("b")).count().collect()]
    assert max(counts) < 1000
    assert ru.running_total(df, [], "id", "w").where(F.col("running") != F.col("id") + 1).count() == 0


def test_borders_of_nothing(spark):
    empty = spark.range(0)
    assert ru.order_borders(empty, "id") == []
    assert ru.running_total(empty.withColumn("w", F.lit(1)), [], "id", "w").count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100), st.integers(0, 3).map(float)), min_size=1, max_size=150))
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.1, 0.33, 0.5, 0.66, 1.0]
    got = {r.prob: r.value for r in ru.exact_quantiles(df, ["x"], probs).collect()}
    known = [v for v in values if v is not None]
    if not known:
        assert got == {}
    for p in probs if known else []:
        assert got[p] == pytest.approx(np.quantile(known, p), abs=1e-9)


def test_exact_quantiles_narrow_band_and_hot_value(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.pmod(F.hash("id"), F.lit(99_991)) / 99_991.0).alias("x"),
        (F.col("id") % 2).alias("g"))
    data = df.toPandas()
    got = {(r.g, r.prob): r.value for r in ru.exact_quantiles(df, ["x"], [0.2, 0.5, 0.9], ["g"]).collect()}
    for (g, p), v in got.items():
        assert v == pytest.approx(np.quantile(data.x[data.g == g], p), abs=1e-12)
    assert len(got) == 6


@pytest.mark.parametrize("sent", [0, 50, 10_000])
def test_exact_quantiles_by_bits(spark, monkeypatch, sent):
    """Large groups are counted bit by bit; how many values a pass may send decides the number of passes, not the result."""
    import anchorkit.operators.quantiles as qu

    monkeypatch.setattr(qu, "GATHERED_ROWS", 500)
    monkeypatch.setattr(qu, "SENT_VALUES", sent)
    df = spark.range(9000).select(
        F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 7 == 0, "b").when(F.col("id") < 200, "few").otherwise("a").alias("g"),
        F.when(F.col("id") % 3 == 0, -0.25).otherwise((F.col("id") * 7 % 3001 - 1500) / 7.0).alias("x"),
        F.when(F.col("id") % 5 == 0, float("nan")).when(F.col("id") % 4 == 0, None).otherwise(F.exp(F.col("id") % 50 - 20.0)).alias("y"),
        F.lit(None).cast("double").alias("z"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("zero"))
    data = df.toPandas()
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.g, r.feature, r.prob): (r.value, r.n) for r in ru.exact_quantiles(df, ["x", "y", "z", "zero"], probs, ["g"]).collect()}
    assert len(got) == 4 * 3 * 5
    for (g, c, p), (v, n) in got.items():
        known = data[c][data.g.isna() if g is None else data.g == g].dropna()
        assert n == len(known) and v == pytest.approx(np.quantile(known, p), abs=1e-12)
    whole = {(r.feature, r.prob): r.value for r in ru.exact_quantiles(df, ["x", "y", "z"], probs).collect()}
    assert whole == {(c, p): pytest.approx(np.quantile(data[c].dropna(), p), abs=1e-12) for c in ("x", "y") for p in probs}


def test_ranks_over_ranges(spark):
    """Hot values, one hot group, null groups and NaN, over many tasks."""
    from anchorkit.operators.ranges import range_totals, tie_ranks

    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([1.0, 2.0, 2.0, 2.0, 5.0, float("nan"), -0.0, 0.0]), i, rnd.randrange(1, 4)) for i in range(3000)]
    rows += [("hot", 7.0, i, 1) for i in range(2000)] + [("one", 1.0, 0, 5)]
    df = spark.createDataFrame(rows, "g string, v double, i long, w long").repartition(5)
    place = lambda v: (v != v, v)
    got = {(r.g, r.i): r.rank for r in tie_ranks(df, ["g"], "v", ["i"], "w", "rank").collect()}
    for g in ("a", "b", None, "hot", "one"):
        own = [r for r in rows if r[0] == g]
        for _, v, i, _ in own:
            less = sum(w for _, x, _, w in own if place(x) < place(v)) if v == v else sum(w for _, x, _, w in own if x == x)
            tie = sum(w for _, x, _, w in own if x == v or (x != x and v != v))
            assert got[g, i] == less + (tie + 1) / 2
    got = {(r.g, r.i): r.upto for r in range_totals(df, ["g"], ["i"], "w", "upto").collect()}
    for g in ("a", "b", None, "hot", "one"):
        total = 0
        for _, _, i, w in sorted((r for r in rows if r[0] == g), key=lambda r: r[2]):
            total += w
            assert got[g, i] == total
    assert [r.upto for r in range_totals(df.where("g = 'one'"), [], ["i"], "w", "upto").collect()] == [5]
    assert tie_ranks(df.limit(0), ["g"], "v", ["i"], "w", "rank").count() == 0
    assert range_totals(df.limit(0), [], ["i"], "w", "upto").count() == 0


def test_quantiles_of_many_and_missing_groups(spark):
    df = spark.range(24_000).select(F.when(F.col("id") >= 2, F.col("id") % 12_000).alias("g"), F.col("id").cast("double").alias("x"))
    got = {r.g: r.value for r in ru.exact_quantiles(df, ["x"], [0.5], ["g"]).collect()}
    assert len(got) == 12_001 and got[None] == 0.5 and got[5] == 6005.0


def test_value_ranks_average_ties(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, 2.0, 3.0, None]], "x double")
    assert rows(ru.value_ranks(df, [], "x").select("x", "n", "avg_rank")) == [(1.0, 1, 1.0), (2.0, 1, 2.0), (3.0, 3, 4.0)]


def test_top_k_ties_nulls_and_plan(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 5, 3), (1, 5, 2), (2, None, 4)], "k int, o int, id int")
    first = top_k(df, ["k"], [F.col("o").asc_nulls_last(), F.col("id")], 2)
    assert rows(first.select("k", "id", "rank")) == [(1, 2, 1), (1, 3, 2), (2, 4, 1)]
    assert "WindowGroupLimit" in first._jdf.queryExecution().toString()
    assert rows(dedup(df, ["k"]).select("k", "id")) == [(1, 2), (2, 4)]


def test_band_alignment_against_triples(spark):
    rnd = random.Random(11)
    start = datetime(2020, 1, 1)
    data = []
    for _ in range(500):
        # One entity holds most readings; minutes on the grid hit the closed edges.
        data.append((0 if rnd.random() < 0.6 else rnd.randrange(1, 5), rnd.choice("abc"),
                     start + timedelta(minutes=rnd.randrange(0, 600) // 10 * 10), float(rnd.randrange(0, 9)) if rnd.random() < 0.95 else None))
    df = spark.createDataFrame(data, "e int, i string, t timestamp_ntz, v double")
    got = dict(rows(band_aligned_min(df, entity="e", item="i", time="t", value="v", base="a", others=["b", "c"], tolerance_seconds=1800)))
    want = {}
    tol = timedelta(minutes=30)
    for e, i, t, v in data:
        if i != "a" or v is None:
            continue
        best = []
        for other in "bc":
            near = [w for f, j, u, w in data if f == e and j == other and w is not None and abs(u - t) <= tol]
            best.append(min(near) if near else None)
        if None not in best:
            want[e] = min(want.get(e, 1e9), v + sum(best))
    assert got == want


def test_schema_helpers(spark):
    df = spark.createDataFrame([("1.5", float("nan"), "x")], "a string, b double, c string")
    assert [tuple(r) for r in coerce_numeric(df).collect()] == [(1.5, None, None)]
    assert nan_to_null(df).first().b is None
    assert align_columns(df, ["b", "z"], ["c"]).columns == ["c", "b", "z"]
    with pytest.raises(KeyError, match="z"):
        require_columns(df, ["a", "z"], "table")


def test_levels_and_top(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "x string")
    assert levels_of(df, "x") == ["a", "b", "c"] and top_categories(df, "x", 2) == ["b", "a"]
    coded = df.select("x", *one_hot("x", ["a", "b", "c"], "x"))
    assert coded.columns == ["x", "x_b", "x_c"] and {r.x: (r.x_b, r.x_c) for r in coded.collect()}[None] == (0, 0)
