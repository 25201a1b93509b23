"""Loads that tolerate new columns and can be repeated safely."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorkit.operators.quality import labelled_counts
from anchorkit.sources import files
from anchorkit.sources.tables import read_csv


def align_to(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Typed columns first, in schema order and NULL when absent, then the extra ones as text."""
    known = [F.col(c).try_cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]
    return df.select(*known, *[F.col(c).cast("string").alias(c) for c in df.columns if c not in types])


def load_by_header(spark: SparkSession, source: str, target: str, types: dict[str, str]) -> DataFrame:
    """Full reload of ``target`` (parquet) from a CSV whose header decides the columns."""
    if not files.exists(spark, source):
        raise FileNotFoundError(source)
    align_to(read_csv(spark, source, types), types).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


_MANIFESTS, _VERSIONS = "_manifests", "_versions"


def _manifest(spark: SparkSession, target: str, item: str | None = None) -> tuple[int, dict]:
    """Number and content of the newest manifest; a table without one is what its item folders say (number 0)."""
    names = [n for n in files.children(spark, f"{target}/{_MANIFESTS}") if n.endswith(".json")]
    if names:
        name = max(names)
        return int(name.removesuffix(".json")), json.loads(files.read_text(spark, f"{target}/{_MANIFESTS}/{name}"))
    folders = {}
    if item is not None:
        for name, (_, _, is_folder) in files.children(spark, target).items():
            if is_folder and name.startswith(f"{item}="):
                folders[name] = ""
    return 0, {"item": item, "folders": folders, "columns": []}


def read_items(spark: SparkSession, target: str, item: str = "itemid") -> DataFrame:
    """The table at ``target`` as its newest manifest states it, whatever is being written meanwhile.

    Columns that some items lack are NULL there. Item folders of one version are read together, so a
    filter on the item still leaves out folders.
    """
    target = target.rstrip("/")
    _, state = _manifest(spark, target, item)
    item, columns = state["item"], dict(state["columns"])
    by_version: dict[str, list[str]] = {}
    for folder, version in state["folders"].items():
        by_version.setdefault(version, []).append(folder)
    parts = []
    for version, folders in sorted(by_version.items()):
        base = f"{target}/{_VERSIONS}/{version}" if version else target
        part = spark.read.option("basePath", base).option("mergeSchema", True).parquet(*[f"{base}/{f}" for f in sorted(folders)])
        parts.append(part.withColumn(item, F.col(item).cast(columns[item])) if item in columns else part)
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def append_items(rows: DataFrame, target: str, items: list[int], item: str = "itemid") -> DataFrame:
    """Replace the listed items in a target kept by item; all other items stay untouched.

    Repeating the call gives the same table. A listed item without new rows ends up empty. New rows are
    written beside the old ones, and a manifest that appears by one rename makes them the table:
    a reader (:func:`read_items`) or a call that breaks off sees the old table or the new one, never a
    mixture. Of two calls at once the later one builds on the earlier one's manifest. Old versions stay
    until :func:`drop_old_items`. A table partitioned by item without manifest is taken as it is.
    """
    spark, target = rows.sparkSession, target.rstrip("/")
    chosen = rows.where(F.col(item).isin(items))
    version = uuid.uuid4().hex
    base = f"{target}/{_VERSIONS}/{version}"
    # No shuffle: the item list is short, so a task writes few files, and a huge item stays spread.
    chosen.write.partitionBy(item).parquet(base)
    # The folder's name is made of the item as Spark writes it.
    mine = {files.partition_folder(spark, "", item, i).lstrip("/") for i in items}
    present = [n for n, (_, _, is_folder) in files.children(spark, base).items() if is_folder and n.startswith(f"{item}=")]
    while True:
        number, state = _manifest(spark, target, item)
        folders = {f: v for f, v in state["folders"].items() if f not in mine} | {f: version for f in present}
        known = dict(state["columns"])
        columns = known | {c: t for c, t in chosen.dtypes if c not in known}
        text = json.dumps({"item": item, "folders": folders, "columns": list(columns.items())})
        if files.publish_text(spark, f"{target}/{_MANIFESTS}/{number + 1:012d}.json", text):
            return read_items(spark, target, item)


def drop_old_items(spark: SparkSession, target: str, keep: int = 1) -> int:
    """Delete what none of the ``keep`` newest manifests names; returns the number of deleted folders.

    For a time when no reader still uses an older manifest and no call is writing.
    """
    target, used, gone = target.rstrip("/"), set(), 0
    manifests = sorted(n for n in files.children(spark, f"{target}/{_MANIFESTS}") if n.endswith(".json"))
    for name in manifests[-keep:]:
        state = json.loads(files.read_text(spark, f"{target}/{_MANIFESTS}/{name}"))
        used |= {(v, f) for f, v in state["folders"].items()}
        item = state["item"]
    if not manifests:
        return 0
    places = {"": target} | {v: f"{target}/{_VERSIONS}/{v}" for v in files.children(spark, f"{target}/{_VERSIONS}")}
    for version, place in places.items():
        for name, (_, _, is_folder) in files.children(spark, place).items():
            if is_folder and name.startswith(f"{item}=") and (version, name) not in used:
                files.drop_folder(spark, f"{place}/{name}")
                gone += 1
    for name in manifests[:-keep]:
        files.drop_folder(spark, f"{target}/{_MANIFESTS}/{name}")
    return gone


def item_report(df: DataFrame, groups: dict[str, list[int]], item: str = "itemid") -> DataFrame:
    """Rows per labelled item group, zero counts included."""
    return labelled_counts(df, item, groups)
