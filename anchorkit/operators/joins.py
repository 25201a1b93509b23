"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.session import shuffle_width, staged

#: A side is broadcast only when it was measured to be at most this large.
BROADCAST_MAX_BYTES = 32 << 20
_FIXED_BYTES = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def same_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet each other; the keys appear once, as in ``left.join(right, keys)``.

    ``right`` may be marked with ``F.broadcast`` after :func:`keyed`, which gives it the key names used here.
    """
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    return _on_keyed(left, keyed(right, keys), keys, how)


def keyed(right: DataFrame, keys: list[str]) -> DataFrame:
    """``right`` with its keys renamed, ready to be joined by :func:`same_join`."""
    return right.withColumnsRenamed({k: f"_key_{k}" for k in keys})


def _on_keyed(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"_key_{k}" for k in keys])


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df``, from one aggregate over it."""
    row = F.lit(16)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            row = row + F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + 8
        elif kind.startswith(("array", "map", "struct")):
            row = row + F.octet_length(F.to_json(F.struct(F.col(name))))
        else:
            row = row + _FIXED_BYTES.get(kind, 8)
    return int(df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("b")).first()["b"])


def hot_keys(df: DataFrame, keys: list[str]) -> list[tuple]:
    """Keys holding more rows than half an even shuffle partition, at most two per partition."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).first()["t"]
    limit = max(total / (2.0 * shuffle_width(df.sparkSession)), 10_000)
    return [tuple(r[k] for k in keys) for r in counts.where(F.col("_n") > limit).collect()]


def _is_hot(keys: list[str], hot: list[tuple]):
    if len(keys) == 1:
        listed = F.col(keys[0]).isin([h[0] for h in hot if h[0] is not None])
        return listed | F.col(keys[0]).isNull() if (None,) in hot else listed
    tests = [
        reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, h)]) for h in hot
    ]
    return reduce(lambda a, b: a | b, tests)


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                  max_bytes: int = BROADCAST_MAX_BYTES, right_bytes: int | None = None,
                  match_nulls: bool = False) -> DataFrame:
    """Equi-join of a long ``left`` with a ``right`` that has few rows per key.

    * ``right`` measured small: broadcast, ``left`` is not shuffled.
    * otherwise keys that are hot in ``left`` are joined against a broadcast of just their
      ``right`` rows, the rest by an ordinary shuffle join; the union is the whole result. When even
      the hot keys' ``right`` rows are too large, a hot key's ``left`` rows are dealt over salts and
      its ``right`` rows copied once per salt.

    ``how`` is ``inner`` or ``left``; ``right_bytes`` is the size of ``right`` when already measured.
    With ``match_nulls`` a NULL key is a key like any other.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    def plain(a: DataFrame, b: DataFrame, small: bool, on: list[str] = keys) -> DataFrame:
        if match_nulls:
            b = keyed(b, on)
            return _on_keyed(a, F.broadcast(b) if small else b, on, how)
        return a.join(F.broadcast(b) if small else b, on, how)

    if (measured_bytes(right) if right_bytes is None else right_bytes) <= max_bytes:
        return plain(left, right, True)
    hot = hot_keys(left.select(*keys), keys)
    if not hot:
        return plain(left, right, False)
    is_hot = F.coalesce(_is_hot(keys, hot), F.lit(False))
    hot_right = right.where(is_hot)
    hot_left = left.where(is_hot)
    if measured_bytes(hot_right) <= max(max_bytes, BROADCAST_MAX_BYTES):
        hot_part = plain(hot_left, hot_right, True)
    else:
        salts = shuffle_width(left.sparkSession)
        # salts are written beside their rows: a row that is computed again must not change its salt
        hot_part = plain(
            staged(hot_left.withColumn("_salt", F.floor(F.rand(0) * salts).cast("int")), "salted"),
            hot_right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), False, [*keys, "_salt"]).drop("_salt")
    cold_part = plain(left.where(~is_hot), right.where(~is_hot), False)
    return hot_part.unionByName(cold_part)
