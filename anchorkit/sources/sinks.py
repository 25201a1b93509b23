"""Writing and re-reading result tables; everything is keyed, nothing depends on row order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorkit.sources import files


def save_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Overwrite ``path`` and return the stored table."""
    writer = df.write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """CSV files with header below ``path``, one per task."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.option("compression", compression) if compression else writer).csv(path)


def save_extracts(extracts: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Interim parquet per extract, packed tightly: extracts are the largest tables that are written."""
    return {name: save_parquet(df, f"{folder.rstrip('/')}/{name}", compression="zstd") for name, df in extracts.items()}


_FINGERPRINT = "_FINGERPRINT"


def fingerprint(spark: SparkSession, settings: Any = None, inputs: Sequence[DataFrame] = ()) -> str:
    """A digest of settings (anything JSON can write), of the inputs' plans and of the files they read.

    Plans are taken without the numbers that differ from session to session; a file counts with path,
    length and time of change, which are listed folder by folder.
    """
    plans, found = [], set()
    for df in inputs:
        plans.append(df._jdf.queryExecution().analyzed().canonicalized().toString())
        names = df.inputFiles()
        for folder in sorted({n.rpartition("/")[0] for n in names}):
            inside = files.children(spark, folder)
            found |= {(n, *inside.get(unquote(n.rpartition("/")[2]), inside.get(n.rpartition("/")[2], (0, 0)))[:2])
                      for n in names if n.rpartition("/")[0] == folder}
    text = json.dumps([settings, plans, sorted(found)], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], settings: Any = None,
           inputs: Sequence[DataFrame] = ()) -> DataFrame:
    """The finished table at ``path``, built and stored when it is not there or was built from something else.

    The :func:`fingerprint` of ``settings`` and ``inputs`` is stored beside the table, after it: other settings,
    another plan or a changed input file rebuild it, and so does a table whose write broke off.
    """
    print_ = fingerprint(spark, settings, inputs)
    mark = f"{path.rstrip('/')}/{_FINGERPRINT}"
    if files.finished(spark, path) and files.exists(spark, mark) and files.read_text(spark, mark) == print_:
        return spark.read.parquet(path)
    stored = save_parquet(build(), path)
    files.write_text(spark, mark, print_)
    return stored


def save_splits(splits: DataFrame, path: str, key: str = "stay_id") -> DataFrame:
    return save_parquet(splits.select(key, "split"), path)


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def save_predictions(preds: DataFrame, path: str, run: str, model: str, stage: str) -> None:
    """Add one model's predictions to the shared table; re-running a model replaces its part."""
    keyed = preds.withColumns({"run": F.lit(run), "model": F.lit(model), "stage": F.lit(stage)})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "stage", "model").parquet(path)


def prediction_pair(preds: DataFrame, *, baseline: str = "baseline", candidate: str = "extended", model: str | None = None,
                    stage: str = "stage2", key: str = "stay_id", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(model, key, y_true, baseline, candidate): both runs of a model on the same entity."""
    part = preds.where(F.col("stage") == stage)
    if model is not None:
        part = part.where(F.col("model") == model)
    one = lambda run, *cols: part.where(F.col("run") == run).select("model", key, *cols)
    return one(baseline, y, F.col(p).alias("baseline")).join(one(candidate, F.col(p).alias("candidate")), ["model", key])
