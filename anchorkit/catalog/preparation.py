"""Splits, folds, caps, weights, imputation and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorkit.catalog.registry import Register, r6, round_doubles
from anchorkit.checks import align_columns, coerce_numeric
from anchorkit.operators import prep as pr
from anchorkit.operators.oversample import oversample
from anchorkit.operators.quality import check_prepared
from anchorkit.plans.retail import table
from anchorkit.session import staged

REGISTER = Register()


def _ranked(seed: int, src: str = "orders", key: str = "o_orderkey", label: str = "o_orderstatus", more: str = "") -> str:
    part = f"PARTITION BY {label} " if label else ""
    return (f"SELECT {key}{more}, {label + ', ' if label else ''}row_number() OVER ({part}ORDER BY md5('{seed}:' || {key}), {key}) AS rank, "
            f"count(*) OVER ({part.strip()}) AS n FROM {src}")


_SPLIT = """CASE WHEN rank <= floor(n * 0.2::DOUBLE + 0.5) THEN 'test'
  WHEN rank <= floor(n * 0.2::DOUBLE + 0.5) + floor((n - floor(n * 0.2::DOUBLE + 0.5)) * 0.1::DOUBLE + 0.5) THEN 'val' ELSE 'train' END AS split"""


@REGISTER("stratified_split", f"SELECT o_orderkey, o_orderstatus, {_SPLIT} FROM ({_ranked(42)})")
def stratified_split(spark, sf):
    return pr.stratified_split(table(spark, sf, "orders"), key="o_orderkey", label="o_orderstatus")


@REGISTER("stratified_folds", f"SELECT o_orderkey, o_orderstatus, ((rank - 1) % 5)::INT AS fold FROM ({_ranked(42)})")
def stratified_folds(spark, sf):
    return pr.class_folds(table(spark, sf, "orders"), key="o_orderkey", label="o_orderstatus")


@REGISTER("plain_folds", f"SELECT o_orderkey, ((rank - 1) % 5)::INT AS fold FROM ({_ranked(7, label='')})")
def plain_folds(spark, sf):
    return pr.plain_folds(table(spark, sf, "orders"), key="o_orderkey", seed=7)


def _seats(cap: int, src: str, label: str) -> str:
    """(class, quota): a seat per class, the rest by largest remainder in whole numbers; NULL is a class."""
    return f"""seats AS (SELECT class, 1 + base + (row_number() OVER (ORDER BY rest DESC, class NULLS FIRST) <= {cap} - sum(1 + base) OVER ())::INT AS quota
  FROM (SELECT class, (n - 1) * ({cap} - count(*) OVER ()) // (sum(n) OVER () - count(*) OVER ()) AS base,
               (n - 1) * ({cap} - count(*) OVER ()) % (sum(n) OVER () - count(*) OVER ())::BIGINT AS rest
        FROM (SELECT {label} AS class, count(*) AS n FROM {src} GROUP BY 1)))"""


@REGISTER("capped_training_rows", f"""
WITH {_seats(1000, "orders", "o_orderstatus")}
SELECT o_orderkey, o_orderstatus FROM ({_ranked(42)}) JOIN seats ON class = o_orderstatus WHERE rank <= quota""")
def capped_training_rows(spark, sf):
    """The training cap of slow models: a stratified sample of a fixed size is the feature."""
    return pr.capped_sample(table(spark, sf, "orders"), 1000, key="o_orderkey", label="o_orderstatus").select(
        "o_orderkey", "o_orderstatus")


_GAPS = "gaps AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 301 = 1 THEN 'rare' ELSE o_orderstatus END AS label FROM orders)"


def _gaps(spark, sf):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", F.when(key % 9 == 0, None).when(key % 301 == 1, "rare").otherwise(status).alias("label"))


@REGISTER("exact_cap", f"""
WITH {_GAPS}, {_seats(200, "gaps", "label")}
SELECT label, count(*) AS n, (SELECT sum(quota)::BIGINT FROM seats) AS total FROM ({_ranked(42, "gaps", "o_orderkey", "label")})
JOIN seats ON class IS NOT DISTINCT FROM label WHERE rank <= quota GROUP BY label""")
def exact_cap(spark, sf):
    """The cap is met exactly and every class, a missing one too, keeps a row."""
    kept = pr.capped_sample(_gaps(spark, sf), 200, key="o_orderkey", label="label")
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.lit(kept.count()).cast("long"))


@REGISTER("split_with_missing_labels", f"WITH {_GAPS} SELECT o_orderkey, label, {_SPLIT} FROM ({_ranked(42, 'gaps', 'o_orderkey', 'label')})")
def split_with_missing_labels(spark, sf):
    """Rows without a label are split like a class of their own."""
    return pr.stratified_split(_gaps(spark, sf), key="o_orderkey", label="label")


@REGISTER("sampled_rows", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 2000")
def sampled_rows(spark, sf):
    """Seeded sample of at most 2,000 rows (the sample is the feature)."""
    return pr.sample_rows(table(spark, sf, "orders"), 2000, key="o_orderkey").select("o_orderkey", r6("o_totalprice"))


@REGISTER("balanced_weights", """
SELECT o_orderkey, o_orderstatus, round(count(*) OVER () / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*) OVER (PARTITION BY o_orderstatus)), 6) AS weight
FROM orders""")
def balanced_weights(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return round_doubles(pr.balanced_weights(orders, "o_orderstatus"))


CONTINUOUS = {"a": "CAST(nullif(p_size, 7) AS DOUBLE)", "b": "CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END",
              "constant": "CAST(3.5 AS DOUBLE)", "empty": "CASE WHEN p_partkey < 0 THEN CAST(1 AS DOUBLE) END"}
CATEGORICAL = {"kind": "CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size % 4 AS DOUBLE) END", "flag": "CAST(p_size % 2 AS DOUBLE)"}
_TRAIN = _ranked(42, "raw", "p_partkey", "label", ", " + ", ".join([*CONTINUOUS, *CATEGORICAL]))
_PARTS = (
    "raw AS (SELECT p_partkey, p_size % 3 AS label, "
    + ", ".join(f"{e} AS {n}" for n, e in {**CONTINUOUS, **CATEGORICAL}.items())
    + f" FROM part), marked AS (SELECT *, {_SPLIT} FROM ({_TRAIN})), train AS (SELECT * FROM marked WHERE split = 'train')")


def _parts(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "p_size % 3 AS label", *[f"{e} AS {n}" for n, e in {**CONTINUOUS, **CATEGORICAL}.items()])


def _prepared_sql(scaling: str, strategy: str = "median") -> str:
    middle = "median" if strategy == "median" else "avg"
    fills = ", ".join([f"coalesce({middle}({c}), 0) AS f_{c}" for c in CONTINUOUS]
                      + [f"(SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS f_{c}"
                         for c in CATEGORICAL])
    low, width = {"standard": ("avg({x})", "stddev_pop({x})"), "minmax": ("min({x})", "max({x}) - min({x})"),
                  "none": ("min(0 * {x})", "max(0 * {x} + 1)")}[scaling]
    stats = ", ".join(f"{low.format(x=f'coalesce({c}, f_{c})')} AS m_{c}, coalesce(nullif({width.format(x=f'coalesce({c}, f_{c})')}, 0), 1) AS s_{c}"
                      for c in CONTINUOUS)
    out = ", ".join([f"round((coalesce({c}, f_{c}) - m_{c}) / s_{c}, 6) AS \"{c}\"" for c in CONTINUOUS]
                    + [f"round(coalesce({c}, f_{c}), 6) AS {c}" for c in CATEGORICAL])
    return f"""WITH {_PARTS}, fills AS (SELECT {fills} FROM train), stats AS (SELECT {stats} FROM train, fills)
SELECT p_partkey, split, {out} FROM marked, fills, stats"""


def _prepared(spark, sf, scaling, strategy="median"):
    parts = _parts(spark, sf)
    splits = pr.stratified_split(parts, key="p_partkey", label="label")
    marked = staged(parts.join(splits.select("p_partkey", "split"), "p_partkey"), "marked")
    prep = pr.Preparation(scaling=scaling, strategy=strategy, continuous=list(CONTINUOUS))
    prep.fit(marked.where(F.col("split") == "train"), [*CONTINUOUS, *CATEGORICAL])
    # -0.0 and 0.0 are one value.
    out = prep.transform(marked, ["p_partkey", "split"])
    return out.select("p_partkey", "split", *[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) for c in prep.fitted.outputs])


@REGISTER("prepared_standard", _prepared_sql("standard"))
def prepared_standard(spark, sf):
    return _prepared(spark, sf, "standard")


@REGISTER("prepared_minmax", _prepared_sql("minmax"))
def prepared_minmax(spark, sf):
    return _prepared(spark, sf, "minmax")


@REGISTER("prepared_unscaled_mean", _prepared_sql("none", "mean"))
def prepared_unscaled_mean(spark, sf):
    return _prepared(spark, sf, "none", "mean")


@REGISTER("split_check", f"""
WITH {_PARTS} SELECT round(count(*) FILTER (WHERE split = 'test') / count(*) FILTER (WHERE split IN ('train', 'test')), 6) AS test_share FROM marked""")
def split_check(spark, sf):
    """Share of test rows against train and test, after the no-missing check."""
    parts = _parts(spark, sf)
    splits = pr.stratified_split(parts, key="p_partkey", label="label")
    frames = pr.prepare_splits(parts, splits, pr.Preparation(continuous=list(CONTINUOUS)), key="p_partkey", label="label")
    features = [c for c in frames["train"].columns if c not in ("p_partkey", "label")]
    share = check_prepared(frames["train"], frames["test"], 0.2, features)
    return spark.createDataFrame([(round(share, 6),)], "test_share double")


@REGISTER("aligned_and_coerced", """
SELECT p_partkey, NULL::DOUBLE AS absent, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand, try_cast(p_type AS DOUBLE) AS p_type,
       p_retailprice AS price FROM part""")
def aligned_and_coerced(spark, sf):
    raw = table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").alias("price"), "p_type", F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand"), "p_name")
    return coerce_numeric(align_columns(raw, ["absent", "brand", "p_type", "price"], ["p_partkey"]), ["p_partkey"])


@REGISTER("oversampled_classes", """
WITH t AS (SELECT CASE WHEN label % 3 = 0 THEN 0 ELSE 1 END AS grp, count(*) AS n FROM embeddings GROUP BY 1)
SELECT grp, n AS originals, (SELECT max(n) FROM t) - n AS made FROM t""")
def oversampled_classes(spark, sf):
    points = table(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("label") % 3 == 0, 0).otherwise(1).alias("grp"), "embedding")
    full = oversample(points, key="vec_id", label="grp", vector="embedding")
    return full.groupBy("grp").agg(F.count_if(~F.col("synthetic")).alias("originals"), F.count_if("synthetic").alias("made"))


@REGISTER("nearest_same_label", """
SELECT vec_id, arg_min(other, (dist, other)) AS neighbour FROM (
  SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS dist
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) GROUP BY vec_id""")
def nearest_same_label(spark, sf):
    from anchorkit.operators.oversample import nearest_in_class

    return nearest_in_class(table(spark, sf, "embeddings"), key="vec_id", label="label", vector="embedding")


@REGISTER("oversampled_vectors", """
WITH t AS (SELECT vec_id, CASE WHEN label % 3 = 0 THEN 0 ELSE 1 END AS grp, embedding::DOUBLE[] AS x FROM embeddings),
sizes AS (SELECT grp, count(*) AS n, max(count(*)) OVER () AS top FROM t GROUP BY grp),
small AS (SELECT t.*, n, top - n AS missing, row_number() OVER (PARTITION BY grp ORDER BY md5('42:' || vec_id), vec_id) AS rank FROM t JOIN sizes USING (grp) WHERE n < top),
near AS (SELECT a.vec_id, arg_min(b.x, (list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) ** 2)), b.vec_id)) AS y
         FROM small a JOIN small b ON a.grp = b.grp AND a.vec_id <> b.vec_id GROUP BY a.vec_id),
turns AS (SELECT *, unnest(range(1, ((missing - rank + n) // n)::BIGINT + 1)) AS turn FROM small),
made AS (SELECT vec_id AS source, grp, x, y, ('0x' || substr(md5('42:gap:' || vec_id || ':' || turn), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
         FROM turns JOIN near USING (vec_id))
SELECT source, grp, round(list_sum(list_transform(list_zip(x, y), lambda p: p[1] + (p[2] - p[1]) * u)), 4) AS total FROM made""")
def oversampled_vectors(spark, sf):
    """Every synthetic vector, by the sum of its coordinates."""
    points = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, 0).otherwise(1).alias("grp"), "embedding")
    full = oversample(points, key="vec_id", label="grp", vector="embedding").where("synthetic")
    return full.select("source", "grp", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
