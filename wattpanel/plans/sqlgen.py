"""Small helpers that write the oracle SQL (the reference's one-join-per-lag form)."""

from __future__ import annotations

from collections.abc import Sequence


def q(name: str) -> str:
    """Quote an identifier for DuckDB."""
    return '"' + name.replace('"', '""') + '"'


def lag_join(base: str, src: str, alias: str, keys: Sequence[str], lag: int, ts: str = "datetime") -> str:
    cond = " AND ".join(f"{alias}.{k} = {base}.{k}" for k in keys)
    return f"LEFT JOIN {src} {alias} ON {cond} AND {alias}.{ts} + INTERVAL {int(lag)} HOUR = {base}.{ts}"


def row_mean(cols: Sequence[str]) -> str:
    return f"list_aggregate([{', '.join(q(c) for c in cols)}], 'avg')"


def row_std(cols: Sequence[str]) -> str:
    return f"list_aggregate([{', '.join(q(c) for c in cols)}], 'stddev_samp')"


def row_quantile_nearest(cols: Sequence[str], p: float) -> str:
    lst = f"list_sort(list_filter([{', '.join(q(c) for c in cols)}], lambda x: x IS NOT NULL))"
    return (f"CASE WHEN len({lst}) > 0 THEN {lst}[CAST(round((len({lst}) - 1) * {p}) AS BIGINT) + 1] END")


def row_quantile_linear(cols: Sequence[str], p: float) -> str:
    return f"(SELECT quantile_cont(x, {p}) FROM unnest([{', '.join(q(c) for c in cols)}]) t(x))"


SEG = ["county", "is_business", "product_type", "is_consumption"]
LVL1 = ["county", "is_business", "is_consumption"]
LVL2 = ["is_business", "is_consumption"]
ITEM = ["row_id", "county", "is_business", "product_type", "is_consumption", "datetime"]


def fallback_family_sql(src: str, col: str, prefix: str, lags: Sequence[int], sum_lags: Sequence[int]
                        ) -> tuple[list[str], list[str], list[str], list[str]]:
    """CTEs, joins, raw select items and final items for one lag family with fallback.

    ``src`` is a view with datetime, the segment keys and ``col``.
    """
    ctes = [
        f"{prefix}_m1 AS (SELECT datetime, county, is_business, is_consumption, avg({col}) AS m, sum({col}) AS s "
        f"FROM {src} GROUP BY ALL)",
        f"{prefix}_m2 AS (SELECT datetime, is_business, is_consumption, avg({col}) AS m, sum({col}) AS s "
        f"FROM {src} GROUP BY ALL)",
    ]
    joins, raw, final = [], [], []
    for h in lags:
        o, a, c = f"{prefix}_o{h}", f"{prefix}_a{h}", f"{prefix}_c{h}"
        joins += [lag_join("p", src, o, SEG, h), lag_join("p", f"{prefix}_m1", a, LVL1, h),
                  lag_join("p", f"{prefix}_m2", c, LVL2, h)]
        raw += [f"{o}.{col} AS {q(f'_own_{prefix}_{h}')}", f"{a}.m AS {q(f'{prefix}_all_type_mean_{h}h')}",
                f"{c}.m AS {q(f'{prefix}_all_county_type_mean_{h}h')}"]
        if h in sum_lags:
            raw += [f"{a}.s AS {q(f'{prefix}_all_type_sum_{h}h')}", f"{c}.s AS {q(f'{prefix}_all_county_type_sum_{h}h')}"]
        final.append(
            f"coalesce({q(f'_own_{prefix}_{h}')}, {q(f'{prefix}_all_type_mean_{h}h')}, "
            f"{q(f'{prefix}_all_county_type_mean_{h}h')}) AS {q(f'{prefix}_{h}h')}")
    return ctes, joins, raw, final
