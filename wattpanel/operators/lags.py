"""Shifted-time lag joins, group levels and hierarchical fallback.

The reference joins once per lag.  Here each source row is exploded into one copy
per lag with its time moved forward, the copies are pivoted back to one row per
(key, time) with one column (or struct) per lag, and the result is joined to the
left side once.  Shuffle volume is ``len(lags) x source`` instead of
``len(lags) x left``; every group of the pivot holds at most ``len(lags)`` rows, so
no key, however hot, lands in a single task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LagNamer = Callable[[str, int], str]
DEFAULT_STRATEGY = "chunk"


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def suffix_after_first(lags: Sequence[int]) -> LagNamer:
    """Reference naming: the first lag keeps the plain name, the others get ``_h{lag}``."""
    first = lags[0]
    return lambda c, h: c if h == first else f"{c}_h{h}"


def hours_suffix(c: str, h: int) -> str:
    """``target`` at 48 h -> ``target_48h``."""
    return f"{c}_{h}h"


def shift_hours(ts_col: str, hours) -> F.Column:
    h = hours if isinstance(hours, F.Column) else F.lit(int(hours))
    return F.col(ts_col) + F.make_dt_interval(F.lit(0), h)


def lag_table(src: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], lags: Sequence[int],
              name: LagNamer, wanted: DataFrame | None = None) -> DataFrame:
    """One row per (keys, ts) of the *target* time with one column per (col, lag).

    ``src`` must be unique on ``keys + [ts]`` (run the upsert first); the value at
    lag ``h`` for time ``t`` is the source value at ``t - h``.  With ``wanted`` only its
    (keys, ts) are made: the narrow copies are shuffled and semi-joined before they are
    pivoted, so a sparse series does not pivot the times that nobody asks for, and the
    pivot runs where the copies already lie.
    """
    lags = [int(h) for h in lags]
    shifted = src.select(
        *keys, ts, *cols, F.explode(F.array(*[F.lit(h) for h in lags])).alias("_lag")
    ).withColumn(ts, shift_hours(ts, F.col("_lag")))
    if wanted is not None:
        shifted = shifted.join(wanted.select(*keys, ts).distinct().hint("merge"), on=[*keys, ts], how="left_semi")
    if len(cols) * len(lags) <= 100 and len(lags) < 63:
        # Narrow sources: one max(when) per (column, lag), a plain hash aggregate.  As in the wide form, a duplicated
        # source key is an error: then the sum of the lags' bits differs from their union.
        aggs = [F.max(F.when(F.col("_lag") == h, F.col(f"`{c}`"))).alias(name(c, h)) for h in lags for c in cols]
        bit = F.element_at(F.create_map(*[x for i, h in enumerate(lags) for x in (F.lit(h), F.lit(1 << i))]), F.col("_lag")).cast("long")
        table = shifted.groupBy(*keys, ts).agg(*aggs, F.try_sum(bit).alias("_bits"), F.bit_or(bit).alias("_union"))
        unique = F.assert_true(F.col("_bits").eqNullSafe(F.col("_union")), "DUPLICATED source key in a lag table")
        return table.filter(unique.isNull()).drop("_bits", "_union")
    # One map lag -> struct(cols) per target row: a hash (object) aggregate holding at most
    # len(lags) small entries per group, instead of a sort-based aggregate over structs.
    packed = F.struct(*[F.col(f"`{c}`") for c in cols])
    wide = shifted.groupBy(*keys, ts).agg(F.map_from_entries(F.collect_list(F.struct("_lag", packed))).alias("_m"))
    return wide.selectExpr(
        *[_q(k) for k in [*keys, ts]], *[f"_m[{h}].{_q(c)} AS {_q(name(c, h))}" for h in lags for c in cols]
    )


def lag_join(left: DataFrame, src: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
             lags: Sequence[int], name: LagNamer = hours_suffix, strategy: str | None = None,
             wanted: DataFrame | None = None) -> DataFrame:
    """Left join of ``src`` shifted by every lag in ``lags`` onto ``left``.

    ``strategy``: ``"chunk"`` (one map of times per key and chunk of time, shuffles the source
    once plus a halo of ``max(lags)`` and reads every lag from the map), ``"pivot"`` (explode-shift-pivot, shuffles
    ``len(lags)`` copies of the source) or ``"window"`` (time-chunked range-frame window); default from the session conf
    ``wattpanel.lag.strategy`` (``chunk``).  ``wanted`` is a frame with at least the
    (keys, ts) of ``left``; in a chain of lag joins the first left side spares the later
    ones from running the joins before them twice.
    """
    wanted = left if wanted is None else wanted
    strategy = strategy or left.sparkSession.conf.get("wattpanel.lag.strategy", DEFAULT_STRATEGY)
    if strategy == "chunk":
        return lag_join_chunks(left, src, keys, ts, cols, lags, name)
    if strategy == "window":
        table = lag_table_window(wanted, src, keys, ts, cols, lags, name)
    else:
        table = lag_table(src, keys, ts, cols, lags, name, wanted)
    return left.join(table, on=[*keys, ts], how="left")


class LagSource(NamedTuple):
    """One source of a chain of lag joins: ``cols`` of ``src`` by ``keys``, at every lag of ``lags``.

    ``rows`` makes the rows with keys and columns from those of ``src`` where these have but the time: ``rows(src, by)`` returns
    ``by``, keys, time and columns, its groups never crossing the columns of ``by``.
    """

    src: DataFrame
    keys: Sequence[str]
    cols: Sequence[str]
    lags: Sequence[int]
    name: LagNamer = hours_suffix
    rows: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None

    def made(self) -> list[str]:
        return [self.name(c, h) for h in self.lags for c in self.cols]

    def whole(self) -> DataFrame:
        return self.rows(self.src, []) if self.rows else self.src


def lag_joins(left: DataFrame, sources: Sequence[LagSource], ts: str, strategy: str | None = None) -> DataFrame:
    """Lag joins of several sources onto one left side: :func:`lag_join` for each, in turn, with the left side shuffled once."""
    strategy = strategy or left.sparkSession.conf.get("wattpanel.lag.strategy", DEFAULT_STRATEGY)
    if strategy == "chunk":
        return _join_chunks(left, sources, ts)
    out = left
    for s in sources:
        out = lag_join(out, s.whole(), s.keys, ts, s.cols, s.lags, s.name, strategy, wanted=left)
    return out


def lag_join_chunks(left: DataFrame, src: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                    lags: Sequence[int], name: LagNamer = hours_suffix, chunk_hours: int | None = None) -> DataFrame:
    """:func:`lag_join` through one map per (keys, chunk of time)."""
    return _join_chunks(left, [LagSource(src, keys, cols, lags, name)], ts, chunk_hours)


def _join_chunks(left: DataFrame, sources: Sequence[LagSource], ts: str, chunk_hours: int | None = None) -> DataFrame:
    """Lag joins through one map per (keys, chunk of time) of each source.

    Time is cut into chunks of at least the largest lag; each source row goes to its chunk and, if it lies within
    its largest lag of the next one, there too: two copies at most, however many lags.  A lag leads only to times of the same
    remainder by the lags' greatest common divisor, so the rows of a chunk and remainder become a map from time to values: a
    few dozen entries, over which a hot key is spread.  The left side meets the map in one join, and each lag is a lookup.
    A duplicated source key is an error of the map.

    All sources share chunks and remainders, and both sides are dealt by these and the keys that all sources have, so the left
    side is shuffled once, before it gets any lag column.  Join keys go by how many sources have them: a side sorted by the
    longest list is sorted by its beginnings, too; sources whose keys are no beginning come first, while the rows are narrow.  The lags
    stay an array for each source up to the end, and become columns in one projection.  Where no key deals the rows, those of a
    source with ``rows`` are dealt before they are made.
    """
    lags = [int(h) for s in sources for h in s.lags]
    chunk = max(chunk_hours or max(24, 2 * max(lags)), max(lags), 1) * 3600
    step = max(math.gcd(*lags), 1) * 3600
    often = Counter(k for s in sources for k in s.keys)
    order = sorted(often, key=lambda k: -often[k])
    dealt = [*[k for k in order if often[k] == len(sources)], "_c", "_r"]
    by = [[k for k in order if k in s.keys] for s in sources]
    longest = max(by, key=len)
    turns = sorted(range(len(sources)), key=lambda i: (by[i] == longest[: len(by[i])], -len(by[i])))
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    cell = {"_t": at, "_c": F.floor(at / chunk), "_r": F.pmod(at, F.lit(step))}
    out = left.withColumns(cell).repartition(*dealt)

    def chunked(rows: DataFrame, halo: int) -> DataFrame:
        """Rows with a time, in their chunk and, within ``halo`` seconds of the next one, there too."""
        into_next = F.col("_t") >= (F.col("_c") + 1) * chunk - halo
        both = F.explode(F.when(into_next, F.array(F.col("_c"), F.col("_c") + 1)).otherwise(F.array("_c")))
        return rows.withColumns(cell).filter(F.col("_t").isNotNull()).withColumn("_c", both)

    for i in turns:
        source, own = sources[i], sources[i].lags
        halo = max(max(own), 0) * 3600
        picked = [*by[i], *[F.col(f"`{c}`") for c in source.cols]]
        # Rows are dealt before they are packed: lists of one or two rows would travel with their key and headers.
        if source.rows and dealt == ["_c", "_r"]:
            s = source.rows(chunked(source.src, halo).drop("_t").repartition(*dealt), dealt).select(*dealt, *picked, at.alias("_t"))
        else:
            s = chunked(source.whole().select(ts, *picked), halo).drop(ts).repartition(*dealt)
        values = F.struct(*[F.col(f"`{c}`") for c in source.cols])
        on = ["_c", "_r", *by[i]]
        maps = s.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("_t", values))).alias("_m"))
        kept = out.columns
        joined = out.join(maps, on=on, how="left")
        # All lags in one array: the optimizer does not copy that into the expressions that use the lags later.
        out = joined.selectExpr(*[_q(c) for c in kept], "array(" + ", ".join(f"_m[_t - {int(h) * 3600}L]" for h in own) + f") AS _v{i}")
    found = {s.name(c, h): f"_v{i}[{k}].{_q(c)}" for i, s in enumerate(sources) for k, h in enumerate(s.lags) for c in s.cols}
    return out.selectExpr(*[_q(c) for c in left.columns], *[f"{found[c]} AS {_q(c)}" for s in sources for c in s.made()])


def lag_table_window(left: DataFrame, src: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                     lags: Sequence[int], name: LagNamer, chunk_hours: int | None = None) -> DataFrame:
    """Same result as :func:`lag_table`, restricted to the (keys, ts) of ``left``.

    Source rows and the left side's distinct (keys, ts) (with null values) are
    unioned; time is cut into chunks and every chunk also receives the source rows
    of the ``max(lags)`` hours before it.  One window per (keys, chunk), ordered by
    epoch seconds, reads each lag as the single-point frame ``[t - h, t - h]``.
    """
    lags = [int(h) for h in lags]
    max_lag = max(lags) * 3600
    chunk = max(chunk_hours or max(24 * 90, 4 * max(lags)), max(lags)) * 3600  # a halo reaches into one chunk
    types = dict(src.dtypes)
    s = src.select(*keys, ts, *[F.col(f"`{c}`") for c in cols], F.lit(False).alias("_item"))
    it = left.select(*keys, ts).distinct().select(
        *keys, ts, *[F.lit(None).cast(types[c]).alias(c) for c in cols], F.lit(True).alias("_item"))
    u = s.unionByName(it).withColumn("_t", F.unix_seconds(F.col(ts).cast("timestamp")))
    u = u.withColumn("_chunk", F.floor(F.col("_t") / chunk))
    halo = (~F.col("_item")) & (F.col("_t") >= (F.col("_chunk") + 1) * chunk - max_lag) if max_lag else F.lit(False)
    u = u.select("*", F.explode(F.when(halo, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
                 .alias("_halo"))
    u = u.withColumn("_chunk", F.when(F.col("_halo"), F.col("_chunk") + 1).otherwise(F.col("_chunk")))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_t")
    vals = {name(c, h): F.max(F.when(~F.col("_item"), F.col(f"`{c}`"))).over(w.rangeBetween(-h * 3600, -h * 3600))
            for h in lags for c in cols}
    out = u.select(*keys, ts, "_item", "_halo", *[v.alias(k) for k, v in vals.items()])
    return out.filter(F.col("_item") & ~F.col("_halo")).drop("_item", "_halo")


def lag_join_chain(left: DataFrame, src: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                   lags: Sequence[int], name: LagNamer = hours_suffix) -> DataFrame:
    """The one-join-per-lag form; kept as the cross-check of :func:`lag_join` in tests."""
    out = left
    for h in lags:
        s = src.select(*keys, shift_hours(ts, h).alias(ts), *[F.col(c).alias(name(c, h)) for c in cols])
        out = out.join(s, on=[*keys, ts], how="left")
    return out


def lookback_min(left: DataFrame, ts: str):
    """Earliest time of the rows to build features for (one scalar)."""
    return left.agg(F.min(ts).alias("m")).first()["m"]


def lookback_prune(src: DataFrame, ts: str, start, max_lag_hours: int) -> DataFrame:
    """Keep source rows at or after ``start - max_lag``.

    ``start`` is a literal, so the filter reaches the Parquet scan.
    """
    if start is None:
        return src.limit(0)
    return src.filter(F.col(ts) >= F.lit(start) - F.make_dt_interval(F.lit(0), F.lit(int(max_lag_hours))))


# Two aggregation levels of the segment panel.
LEVEL_TYPE = ["datetime", "county", "is_business", "is_consumption"]
LEVEL_COUNTY_TYPE = ["datetime", "is_business", "is_consumption"]


def group_levels(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Sums and means of ``cols`` over product types, and over counties and types.

    The coarse level is rolled up from the fine one (sums and non-null counts), so the
    raw panel is shuffled only once.  Returns ``(by_county, all_county)`` with columns
    ``{c}_sum`` and ``{c}_mean``.
    """
    fine = df.groupBy(*LEVEL_TYPE).agg(
        *[F.sum(c).alias(f"{c}_sum") for c in cols], *[F.count(c).alias(f"{c}_n") for c in cols]
    )
    coarse = fine.groupBy(*LEVEL_COUNTY_TYPE).agg(
        *[F.sum(f"{c}_sum").alias(f"{c}_sum") for c in cols], *[F.sum(f"{c}_n").alias(f"{c}_n") for c in cols]
    )

    def finish(t: DataFrame, keys) -> DataFrame:
        return t.select(
            *keys,
            *[F.col(f"{c}_sum") for c in cols],
            *[(F.col(f"{c}_sum") / F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_n"))).alias(f"{c}_mean") for c in cols],
        )

    return finish(fine, LEVEL_TYPE), finish(coarse, LEVEL_COUNTY_TYPE)


def lag_fallback_multi(left: DataFrame, src: DataFrame, specs: dict[str, tuple[Sequence[int], Sequence[int]]],
                       keys: Sequence[str] = ("county", "is_business", "product_type", "is_consumption"),
                       ts: str = "datetime") -> DataFrame:
    """:func:`lag_fallback` for several value columns of one source in the same joins.

    ``specs`` maps a column to ``(lags, sum_lags)``.  Each join carries every
    column at the union of the lags; columns at lags not asked for are dropped.
    """
    return fallback_columns(lag_joins(left, fallback_sources(src, specs, keys, ts), ts), specs)


def fallback_sources(src: DataFrame, specs: dict[str, tuple[Sequence[int], Sequence[int]]],
                     keys: Sequence[str] = ("county", "is_business", "product_type", "is_consumption"),
                     ts: str = "datetime") -> list[LagSource]:
    """What the fallback reads lags of: the segments themselves and both levels."""
    cols = list(specs)
    all_lags = sorted({h for lg, _ in specs.values() for h in lg})
    all_sum = sorted({h for _, sl in specs.values() for h in sl})
    by_county, all_county = group_levels(src.select(*LEVEL_TYPE, "product_type", *cols), cols)
    lvl1 = by_county.select(*LEVEL_TYPE, *[F.col(f"{c}_mean").alias(f"{c}_all_type_mean") for c in cols],
                            *[F.col(f"{c}_sum").alias(f"{c}_all_type_sum") for c in cols])
    lvl2 = all_county.select(*LEVEL_COUNTY_TYPE, *[F.col(f"{c}_mean").alias(f"{c}_all_county_type_mean") for c in cols],
                             *[F.col(f"{c}_sum").alias(f"{c}_all_county_type_sum") for c in cols])
    # One join per level: means and (when asked) sums travel in the same lag table.
    both = sorted(set(all_lags) | set(all_sum))
    m1 = [f"{c}_all_type_mean" for c in cols] + ([f"{c}_all_type_sum" for c in cols] if all_sum else [])
    m2 = [f"{c}_all_county_type_mean" for c in cols] + ([f"{c}_all_county_type_sum" for c in cols] if all_sum else [])
    return [LagSource(src.select(*keys, ts, *cols), list(keys), cols, all_lags),
            LagSource(lvl1.select(*LEVEL_TYPE, *m1), LEVEL_TYPE[1:], m1, both),
            LagSource(lvl2.select(*LEVEL_COUNTY_TYPE, *m2), LEVEL_COUNTY_TYPE[1:], m2, both)]


def fallback_columns(out: DataFrame, specs: dict[str, tuple[Sequence[int], Sequence[int]]]) -> DataFrame:
    """The lags of :func:`fallback_sources` with the fallback applied, without the lags that were not asked for."""
    cols = list(specs)
    all_lags = sorted({h for lg, _ in specs.values() for h in lg})
    all_sum = sorted({h for _, sl in specs.values() for h in sl})
    both = sorted(set(all_lags) | set(all_sum))
    extra = [h for h in both if h not in all_lags]
    out = out.drop(*[f"{c}{m}_{h}h" for c in cols for h in extra
                     for m in ("_all_type_mean", "_all_county_type_mean")])
    out = out.withColumns({
        f"{c}_{h}h": F.expr(f"coalesce({_q(f'{c}_{h}h')}, {_q(f'{c}_all_type_mean_{h}h')}, "
                            f"{_q(f'{c}_all_county_type_mean_{h}h')})")
        for c in cols for h in specs[c][0]
    })
    drop = []
    for c, (lg, sl) in specs.items():
        drop += [f"{c}{m}_{h}h" for h in all_lags if h not in lg for m in ("", "_all_type_mean", "_all_county_type_mean")]
        if all_sum:
            drop += [f"{c}{m}_{h}h" for h in both if h not in sl for m in ("_all_type_sum", "_all_county_type_sum")]
    return out.drop(*drop)


def lag_fallback(left: DataFrame, src: DataFrame, col: str, lags: Sequence[int], sum_lags: Sequence[int] = (),
                 keys: Sequence[str] = ("county", "is_business", "product_type", "is_consumption"),
                 ts: str = "datetime", prefix: str | None = None) -> DataFrame:
    """Lags of ``col`` with hierarchical fallback.

    ``{p}_{h}h`` = own segment value at ``t-h``, else the county mean over product
    types, else the all-county mean; the two means are kept as
    ``{p}_all_type_mean_{h}h`` and ``{p}_all_county_type_mean_{h}h``.  For
    ``sum_lags`` the group sums ``{p}_all_type_sum_{h}h`` and
    ``{p}_all_county_type_sum_{h}h`` are added.
    """
    p = prefix or col
    if p != col:
        src = src.withColumnRenamed(col, p)
    return lag_fallback_multi(left, src, {p: (list(lags), list(sum_lags))}, keys, ts)
