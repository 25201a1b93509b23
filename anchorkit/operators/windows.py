"""Measurements inside an anchored time window, aggregated to one wide row per entity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorkit.checks import require_columns, require_unique
from anchorkit.functions import values as V
from anchorkit.operators.joins import BROADCAST_MAX_BYTES, balanced_join


@dataclass(frozen=True)
class Item:
    """A measured item: raw values in [low, high] count, then ``convert`` is applied."""

    item: int | str
    name: str
    low: float
    high: float
    convert: str = "none"


@dataclass(frozen=True)
class EventSchema:
    """Column names of a long event table."""

    key: str = "stay_id"
    item: str = "itemid"
    time: str = "charttime"
    value: str = "valuenum"
    extra: tuple[str, ...] = field(default=())


# Unit conversions as SQL over the raw value.
_CONVERSIONS = {"none": "{v}", "f_to_c": "({v} - 32.0D) * 5.0D / 9.0D"}


def events_in_window(events: DataFrame, anchors: DataFrame, items: list, schema: EventSchema = EventSchema(), *,
                     entity: str = "stay_id", anchor: str = "intime", hours: int = 24,
                     max_bytes: int = BROADCAST_MAX_BYTES, anchor_bytes: int | None = None) -> DataFrame:
    """Events of the listed items within ``hours`` after the entity's anchor: (entity, item, time, value).

    The item list is a literal, so it reaches the file scan. ``anchors`` has one row per entity
    and is joined on ``schema.key``, which may be another key than ``entity``. ``anchor_bytes`` is
    their measured size when the caller has it already.
    """
    require_columns(events, [schema.key, schema.item, schema.time, schema.value], "events")
    require_columns(anchors, {schema.key, entity, anchor}, "anchors")
    slim = events.where(F.col(schema.item).isin(items) & F.col(schema.value).isNotNull()).select(
        schema.key, F.col(schema.item).alias("_item"), F.col(schema.time).alias("_time"),
        F.col(schema.value).cast("double").alias("_value"), *schema.extra,
    )
    spots = anchors.select(*dict.fromkeys([schema.key, entity]), F.col(anchor).alias("_anchor"))
    joined = balanced_join(slim, spots.where(F.col("_anchor").isNotNull()), [schema.key], max_bytes=max_bytes,
                           right_bytes=anchor_bytes)
    return joined.where(V.in_window("_time", "_anchor", hours)).select(
        entity, F.col("_item").alias("item"), F.col("_time").alias("time"), F.col("_value").alias("value"),
        *schema.extra,
    )


def item_value(items: list[Item], item: str = "item", value: str = "value") -> Column:
    """The converted value when it is inside its item's range, else NULL."""
    return F.expr(_item_case(items, item, value))


def _item_case(items: list[Item], item: str, value: str) -> str:
    v = V.quoted(value)
    whens = " ".join(
        f"WHEN {V.quoted(item)} = {V.sql_literal(it.item)} AND {v} BETWEEN {V.sql_literal(it.low)} AND {V.sql_literal(it.high)} "
        f"THEN {_CONVERSIONS[it.convert].format(v=v)}" for it in items)
    return f"CASE {whens} END"


def _by_feature(items: list[Item]) -> dict[str, list[Item]]:
    grouped: dict[str, list[Item]] = {}
    for it in items:
        grouped.setdefault(it.name, []).append(it)
    return grouped


def mean_columns(items: list[Item], suffix: str = "_mean", item: str = "item", value: str = "value") -> list[Column]:
    """One conditional mean per feature, in dictionary order; items of one name share a feature."""
    return [F.expr(f"avg({_item_case(same, item, value)}) AS {V.quoted(name + suffix)}")
            for name, same in _by_feature(items).items()]


def window_means(events: DataFrame, anchors: DataFrame, items: list[Item], schema: EventSchema = EventSchema(), *,
                 entity: str = "stay_id", anchor: str = "intime", hours: int = 24,
                 max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Mean of every feature per entity, wide; entities without a valid measurement are absent.

    One scan and one shuffle, of partial sums only when the anchors are broadcast.
    """
    long = events_in_window(events, anchors, [it.item for it in items], schema, entity=entity, anchor=anchor,
                            hours=hours, max_bytes=max_bytes)
    # An entity whose readings are all out of range has no mean at all.
    return long.groupBy(entity).agg(*mean_columns(items), F.count(item_value(items)).alias("_valid")).where(
        F.col("_valid") > 0).drop("_valid")


def partial_means(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mergeable state of a mean: (``by``, sum, count). Partials of disjoint row sets merge exactly."""
    return long.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.sum(value).alias("sum"), F.count(value).alias("count"))


def merge_partials(parts: DataFrame, by: list[str]) -> DataFrame:
    """Combine partial states, of days or loads say, into a coarser key."""
    return parts.groupBy(*by).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))


def finish_means(parts: DataFrame, entity: str, feature: str, names: list[str], suffix: str = "_mean") -> DataFrame:
    """Wide means from partial states; a feature nobody measured is a NULL column."""
    pick = lambda col, n: F.sum(F.when(F.col(feature) == n, F.col(col)))
    return parts.groupBy(entity).agg(*[
        F.try_divide(pick("sum", n), pick("count", n)).alias(n + suffix) for n in names])


def precomputed_means(df: DataFrame, names: list[str], key: str, cohort: DataFrame | None = None,
                      entity: str = "stay_id") -> DataFrame:
    """An already aggregated wide table: checked key, completed columns, moved to the entity key.

    A key that occurs twice is an error, as it would multiply the entity's rows.
    """
    require_columns(df, [key], "precomputed table")
    require_unique(df, key, "precomputed table")
    full = df.select(key, *[
        F.col(n).cast("double").alias(n) if n in df.columns else F.lit(None).cast("double").alias(n) for n in names])
    if cohort is None or key == entity:
        return full
    return cohort.select(key, entity).join(full, key, "left").select(entity, *names)
