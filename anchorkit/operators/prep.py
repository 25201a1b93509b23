"""Keyed splits, folds, caps, weights, imputation and scaling."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorkit.checks import align_columns, coerce_numeric, to_number
from anchorkit.functions.values import hash_text
from anchorkit.operators.joins import balanced_join
from anchorkit.operators.quantiles import exact_medians
from anchorkit.operators.running import hash_ranks
from anchorkit.session import staged

# Columns that are never features, and the features that are scaled.
NON_FEATURES = [
    "stay_id", "subject_id", "hadm_id", "los_days", "los_hours", "los_log", "los_class", "intime", "outtime",
    "first_careunit", "last_careunit", "gender", "admission_type", "admission_location",
]
OCCUPANCY_FEATURES = ["concurrent_patients", "occupancy_rate", "occupancy_percentile"]
SEVERITY_FEATURES = [
    "sofa_total", "sofa_resp", "sofa_cardio", "sofa_hepatic", "sofa_coag", "sofa_renal", "sofa_neuro", "urine_24h",
    "bilirubin_max",
]


def continuous_features() -> list[str]:
    """Names that are imputed by the median and scaled; every other feature is categorical."""
    from anchorkit.plans.items import LAB_COLUMNS, VITAL_COLUMNS

    return ["age", *VITAL_COLUMNS, *LAB_COLUMNS, *OCCUPANCY_FEATURES, *SEVERITY_FEATURES]


def feature_columns(df: DataFrame) -> list[str]:
    """All columns except identifiers, outcomes and raw labels, in table order."""
    skip = set(NON_FEATURES)
    return [c for c in df.columns if c not in skip]


# ---- key-based sampling --------------------------------------------------------------------


def ranked_in_class(df: DataFrame, key: str, label: str | None, seed: int, rank: str = "rank") -> DataFrame:
    """(key, label, rank, n): random but reproducible order of the keys inside each class.

    A missing label is a class of its own. Depends on key and seed only, so it survives reordering, reruns and lost executors.
    """
    keyed = df.select(key, (F.col(label) if label else F.lit(0)).alias("_label"),
                      hash_text(seed, key).alias("_hash"))
    ranked = hash_ranks(keyed, ["_label"], "_hash", [key], rank)
    sizes = keyed.groupBy("_label").agg(F.count(F.lit(1)).alias("n"))
    return balanced_join(ranked, sizes, ["_label"], match_nulls=True).select(
        key, *([F.col("_label").alias(label)] if label else []), rank, "n")


def stratified_split(df: DataFrame, *, key: str = "stay_id", label: str = "los_class", test_size: float = 0.20,
                     val_size: float = 0.10, seed: int = 42) -> DataFrame:
    """(key, label, split): per class the share ``test_size`` is test, ``val_size`` of the rest val."""
    ranked = ranked_in_class(df, key, label, seed)
    n_test = F.floor(F.col("n") * F.lit(test_size) + 0.5)
    n_val = F.floor((F.col("n") - n_test) * F.lit(val_size) + 0.5)
    split = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train")
    return ranked.select(key, label, split.alias("split"))


def class_folds(df: DataFrame, *, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame | None:
    """(key, label, fold) stratified; at most as many folds as the smallest class has rows, None below 2."""
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0]
    if smallest is None or smallest < 2:
        return None
    k = min(folds, smallest)
    return ranked_in_class(df, key, label, seed).select(key, label, F.pmod(F.col("rank") - 1, F.lit(k)).cast("int").alias("fold"))


def plain_folds(df: DataFrame, *, key: str, folds: int = 5, seed: int = 42) -> DataFrame | None:
    """(key, fold) without strata; None below two rows."""
    n = df.count()
    if n < 2:
        return None
    return ranked_in_class(df, key, None, seed).select(key, F.pmod(F.col("rank") - 1, F.lit(min(folds, n))).cast("int").alias("fold"))


def capped_sample(df: DataFrame, max_rows: int | None, *, key: str, label: str | None = None, seed: int = 42) -> DataFrame:
    """``max_rows`` rows (all, when there are fewer), classes kept in proportion when ``label`` is given.

    Every class keeps a row while there are rows for all classes; the others are shared out by the
    largest remainder, ties by class. The cap is the feature (training cap of slow models); without
    it the table passes through.
    """
    if max_rows is None:
        return df
    total = df.count()
    if total <= max_rows:
        return df
    ranked = ranked_in_class(df, key, label, seed)
    if label is None:
        return df.join(ranked.where(F.col("rank") <= max_rows).select(key), key, "left_semi")
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    classes = sizes.count()
    sure = 1 if max_rows >= classes else 0
    share = (F.col("_n") - sure) * F.lit((max_rows - sure * classes) / max(total - sure * classes, 1))
    quotas = staged(sizes.select("_label", F.floor(share + 1e-9).alias("_base"), (share - F.floor(share + 1e-9)).alias("_rest")), "quotas")
    left = max_rows - sure * classes - (quotas.agg(F.sum("_base")).first()[0] or 0)
    # one row per class is ranked here, not the rows
    seat = F.row_number().over(W.orderBy(F.col("_rest").desc(), F.col("_label").asc_nulls_first())) <= left
    quotas = quotas.select(F.col("_label").alias(label), (F.col("_base") + sure + seat.cast("int")).alias("_quota"))
    kept = balanced_join(ranked, quotas, [label], match_nulls=True).where(F.col("rank") <= F.col("_quota"))
    return df.join(kept.select(key), key, "left_semi")


def sample_rows(df: DataFrame, n: int, *, key: str, seed: int = 42) -> DataFrame:
    """``n`` random rows, the same ones on every run."""
    return df.withColumn("_hash", hash_text(seed, key)).orderBy("_hash", key).limit(n).drop("_hash")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add n / (k * n_class) as a weight column, for k classes; a missing label is a class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    n, k = counts.agg(F.sum("_c")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    weights = counts.select(label, (n / (k * F.col("_c"))).alias(out))
    return balanced_join(df, weights, [label], match_nulls=True)


def fold_weights(df: DataFrame, folds: int, label: str, out: str = "weight", fold: str = "fold") -> list[DataFrame]:
    """For each fold the rows of the others, with the weights that :func:`balanced_weights` gives them.

    The classes of all folds are counted in one pass; a weight is then read off its row's label, without a join.
    """
    sizes = df.groupBy(F.col(fold).alias("f"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    found = [tuple(r) for r in sizes.where("f IS NOT NULL").collect()]
    kind, parts = df.schema[label].dataType, []
    for held in range(folds):
        counts: dict = {}
        for f, y, c in found:
            if f != held:
                y = "NaN" if y != y else y  # one class, though it equals nothing
                counts[y] = counts.get(y, 0) + c
        n, weight = sum(counts.values()), F.lit(None).cast("double")
        for y, c in counts.items():
            weight = F.when(F.col(label).eqNullSafe(F.lit(y).cast(kind)), n / (len(counts) * c)).otherwise(weight)
        parts.append(df.where(F.col(fold) != held).withColumn(out, weight))
    return parts


# ---- imputation and scaling ----------------------------------------------------------------


def modes(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Most frequent value of each numeric column, the smallest on a tie."""
    if not columns:
        return {}
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = (
        df.select(F.explode(items).alias("_i")).select("_i.*").where(F.col("value").isNotNull())
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    )
    best = counts.groupBy("feature").agg(F.max(F.struct("_n", (-F.col("value")).alias("_v"))).alias("_m"))
    found = {r["feature"]: -r["_m"]["_v"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


@dataclass
class FittedPreparation:
    """Statistics of the training rows; ``apply`` is one projection."""

    inputs: list[str]
    continuous: list[str]
    categorical: list[str]
    fill: dict[str, float]
    shift: dict[str, float]
    scale: dict[str, float]

    @property
    def outputs(self) -> list[str]:
        return [*self.continuous, *self.categorical]

    def apply(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Align, coerce, impute and scale; ``keep`` columns are carried unchanged."""
        kept = list(keep or [])
        aligned = align_columns(df, [c for c in self.inputs if c not in kept], kept)
        cols = []
        for c in self.outputs:
            filled = F.coalesce(to_number(F.col(c)), F.lit(float(self.fill[c])))
            if c in self.scale:
                filled = (filled - F.lit(self.shift[c])) / F.lit(self.scale[c])
            cols.append(filled.alias(c))
        return aligned.select(*kept, *cols)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "FittedPreparation":
        return FittedPreparation(**json.loads(text))


class Preparation:
    """Impute (median or mean; most frequent for categories), then scale the continuous features.

    Fitted on training rows only: one sketch pass and one counting pass for all medians, one
    pass for all modes, one for mean and spread of the imputed columns. A column without any
    value is filled with 0; a zero spread divides by 1.
    """

    def __init__(self, *, scaling: str = "standard", strategy: str = "median", continuous: list[str] | None = None):
        if scaling not in ("standard", "minmax", "none"):
            raise ValueError(f"unknown scaling {scaling!r}")
        if strategy not in ("median", "mean", "most_frequent"):
            raise ValueError(f"unknown imputation {strategy!r}")
        self.scaling, self.strategy = scaling, strategy
        self.continuous = continuous
        self.fitted: FittedPreparation | None = None

    def fit(self, train: DataFrame, features: list[str] | None = None) -> FittedPreparation:
        names = features or feature_columns(train)
        wanted = set(self.continuous if self.continuous is not None else continuous_features())
        cont = [c for c in names if c in wanted]
        cat = [c for c in names if c not in wanted]
        numeric = coerce_numeric(train.select(*names))
        if not cont:
            centre = {}
        elif self.strategy == "median":
            centre = exact_medians(numeric, cont)
        elif self.strategy == "mean":
            row = numeric.agg(*[F.avg(c).alias(c) for c in cont]).first()
            centre = {c: row[c] for c in cont}
        else:
            centre = modes(numeric, cont)
        fill = {c: v if v is not None else 0.0 for c, v in {**centre, **modes(numeric, cat)}.items()}
        shift, scale = {}, {}
        if cont and self.scaling != "none":
            full = {c: F.coalesce(F.col(c), F.lit(float(fill[c]))) for c in cont}
            pair = ((F.avg, F.stddev_pop) if self.scaling == "standard" else (F.min, lambda e: F.max(e) - F.min(e)))
            stats = numeric.agg(*[f(full[c]).alias(f"{p}{i}") for i, c in enumerate(cont)
                                  for p, f in zip("ab", pair)]).first()
            for i, c in enumerate(cont):
                shift[c] = float(stats[f"a{i}"] or 0.0)
                scale[c] = float(stats[f"b{i}"] or 0.0) or 1.0
        self.fitted = FittedPreparation(names, cont, cat, fill, shift, scale)
        return self.fitted

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        if self.fitted is None:
            raise RuntimeError("fit the preparation before transforming")
        return self.fitted.apply(df, keep)


def prepare_splits(df: DataFrame, splits: DataFrame, prep: Preparation, *, key: str = "stay_id",
                   target: str = "classification", label: str = "los_class", value: str = "los_log") -> dict[str, DataFrame]:
    """Fit on the train split and transform all three; each frame is (key, target, features)."""
    if target not in ("classification", "regression"):
        raise ValueError("target must be 'classification' or 'regression'")
    y = label if target == "classification" else value
    if y not in df.columns:
        raise KeyError(f"{y} is required for {target}")
    marked = staged(df.join(splits.select(key, "split"), key), "marked")
    features = [c for c in feature_columns(df) if c not in (key, label, value)]
    prep.fit(marked.where(F.col("split") == "train"), features)
    return {s: prep.transform(marked.where(F.col("split") == s), [key, y]) for s in ("train", "val", "test")}
