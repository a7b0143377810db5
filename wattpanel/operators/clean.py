"""Cleaning and table maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast


def time_floor(df: DataFrame, ts: str, start) -> DataFrame:
    """Keep rows at or after ``start`` (B3); a literal bound, pushed to the scan."""
    return df.filter(F.col(ts) >= F.lit(start))


def dropna_any(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null or NaN."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], batch_col: str = "_batch") -> DataFrame:
    """Append ``new`` to ``old`` keeping one row per key, the latest batch winning (G1).

    ``old`` rows get batch 0 and ``new`` rows batch 1 unless a ``batch_col`` is
    present already.  Both sides must have the same columns.
    """
    def tag(df: DataFrame, b: int) -> DataFrame:
        return df if batch_col in df.columns else df.withColumn(batch_col, F.lit(b).cast("long"))

    old, new = tag(old, 0), tag(new, 1)
    if set(old.columns) != set(new.columns):
        raise ValueError(f"upsert needs equal columns: {sorted(set(old.columns) ^ set(new.columns))} are on one side only")
    return latest_per_key(old.unionByName(new), keys, batch_col)


def latest_per_key(df: DataFrame, keys: Sequence[str], batch_col: str = "_batch") -> DataFrame:
    """One row per key: the one with the highest ``batch_col`` (latest wins), ties by the other columns in order.

    An aggregate, so rows of a key are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c != batch_col]
    best = F.max(F.struct(F.col(batch_col).alias("_b"), *[F.col(f"`{c}`") for c in rest])).alias("_best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*[F.col(f"`{c}`") if c in keys else F.col("_best").getField(c).alias(c) for c in df.columns if c != batch_col])


def gap_shift_fill(df: DataFrame, ts: str, copy_from, copy_to, cut, shift_hours: int = 48) -> DataFrame:
    """Repair a gap with a shifted copy.

    Rows with ``copy_from <= ts <= copy_to`` are copied ``shift_hours`` later;
    original rows at or after ``cut`` are dropped.
    """
    kept = df.filter(F.col(ts) < F.lit(cut))
    copied = df.filter(F.col(ts).between(F.lit(copy_from), F.lit(copy_to))).withColumn(
        ts, F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(shift_hours)))
    return kept.unionByName(copied)


def batch_needed(df: DataFrame, flag: str = "currently_scored", keys: Sequence[str] = ()) -> DataFrame:
    """Whether a batch needs a prediction: any flag true."""
    agg = F.bool_or(F.col(flag)).alias("needed")
    return df.groupBy(*keys).agg(agg) if keys else df.agg(agg)


def name_to_id(df: DataFrame, names: DataFrame, name_col: str, key: str = "county",
               dim_name: str = "county_name") -> DataFrame:
    """Map a name column to ids through a dimension; unmatched names give null."""
    d = names.select(F.col(dim_name).alias("_name"), F.col(key).alias(key))
    j = df.join(bounded_broadcast(d, 1_000_000), F.col(name_col) == F.col("_name"), "left")
    return j.drop("_name")


def complement(df: DataFrame, part: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``part``."""
    return df.join(part.select(key), on=key, how="left_anti")
