"""Upsert and streaming refresh queries (G1, I1, I2, I4, I5); each writes its feed of file drops first."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators.lags import lag_fallback, lookback_min, lookback_prune
from ..schemas import KEYS
from ..session import remove_dir, scratch_dir
from ..sources import fixtures as fx
from ..sources.io import read_table
from ..streaming import feeds
from . import features as FT
from . import joined as J
from . import solar as SO
from .q_models import REG_SQL, SX_CTE, SX_FIX, _norm_sql, group_params, solar_frame, solar_sql
from .q_panel import _target_family_sql
from .q_weather import U, V
from .registry import query

KEY = [*FT.SEGMENT, "datetime"]

_UPSERT_SQL = """
WITH u AS (SELECT *, 0 AS b FROM panel
           UNION ALL SELECT * REPLACE (target + 1 AS target), 1 AS b FROM panel WHERE row_id % 3 = 0)
SELECT * EXCLUDE (b, rn) FROM (SELECT *, row_number() OVER (PARTITION BY county, is_business, product_type,
  is_consumption, datetime ORDER BY b DESC) AS rn FROM u) WHERE rn = 1"""


def _new_rows(spark, sf):
    return _raised(fx.panel(spark, sf))


def _raised(panel):
    return panel.filter(F.col("row_id") % 3 == 0).withColumn("target", F.col("target") + 1)


@query("upsert_latest", _UPSERT_SQL, ("panel",))
def upsert_latest(spark, sf):
    return C.upsert_latest(fx.panel(spark, sf), _new_rows(spark, sf), KEY)


def _write_feed(drops, folder):
    """One folder per drop; rows get their drop's number as data block unless they carry one."""
    for i, d in enumerate(drops):
        d = d if feeds.BLOCK in d.columns else d.withColumn(feeds.BLOCK, F.lit(i).cast("long"))
        d.write.parquet(f"{folder}/drop={i:05d}")
    return d.schema


def _thirds(df):
    """Three drops in the order of time."""
    lo, hi = df.agg(F.min("datetime"), F.max("datetime")).first()
    if lo is None:
        return [df]
    a, b = (F.lit(lo + (hi - lo) * k / 3) for k in (1, 2))
    t = F.col("datetime")
    return [df.filter(t < a), df.filter((t >= a) & (t < b)), df.filter(t >= b)]


def _streamed(spark, drops, job):
    """Run ``job(folder, schema, out, checkpoint)`` over a feed of the drops; the feed goes once it is drained."""
    folder, out, checkpoint = (scratch_dir(p) for p in ("feed-", "log-", "stream-"))
    schema = _write_feed(drops, folder)
    result = job(folder, schema, out, checkpoint)
    remove_dir(spark, folder)
    remove_dir(spark, checkpoint)
    return result


@query("stream_upsert", _UPSERT_SQL, ("panel",))
def stream_upsert(spark, sf):
    """Same content as ``upsert_latest``, arriving as two drops through a stream."""
    return _streamed(spark, [fx.panel(spark, sf), _new_rows(spark, sf)],
                     lambda folder, schema, out, ck: feeds.stream_upsert(spark, folder, schema, out, ck, KEY))


# --- I1 for all six tables of a step: (day column, value column) -----------------------------------
_REFRESHED = {"client": ("date", "eic_count"), "gas_prices": ("forecast_date", "highest_price_per_mwh"),
              "electricity_prices": ("forecast_date", "euros_per_mwh"), "forecast_weather": ("forecast_datetime", "temperature"),
              "historical_weather": ("datetime", "temperature"), "target": ("datetime", "target")}
_REFRESH_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n, CAST(sum(CAST({v} + CASE WHEN day({t}) % 3 = 0 THEN 1 ELSE 0 END "
    f"AS DECIMAL(18,4))) AS DOUBLE) AS total FROM {view}"
    for (name, (t, v)), view in zip(_REFRESHED.items(), [
        "client", "(SELECT CAST(ts AS DATE) AS forecast_date, max(value) AS highest_price_per_mwh FROM events GROUP BY 1)",
        "(SELECT date_trunc('hour', ts) AS forecast_date, max(value) AS euros_per_mwh FROM events GROUP BY 1)",
        "(SELECT *, origin_datetime + to_hours(hours_ahead) AS forecast_datetime FROM forecast_weather)",
        "hist_weather", "panel"]))


@query("stream_refresh_tables", _REFRESH_SQL, ("client", "forecast_weather", "hist_weather", "panel"))
def stream_refresh_tables(spark, sf):
    """All six tables of a step arrive in two drops, the second raising the values of every third day; rows and sum of each table's state."""
    ev = read_table(spark, sf, "events")
    tables = {
        "client": fx.client(spark, sf),
        "gas_prices": ev.groupBy(F.to_date("ts").alias("forecast_date")).agg(
            F.min("value").alias("lowest_price_per_mwh"), F.max("value").alias("highest_price_per_mwh")),
        "electricity_prices": ev.groupBy(F.date_trunc("hour", "ts").alias("forecast_date")).agg(
            F.max("value").alias("euros_per_mwh")),
        "forecast_weather": fx.forecast_weather(spark, sf).withColumn(
            "forecast_datetime", F.expr("origin_datetime + make_dt_interval(0, hours_ahead)")),
        "historical_weather": fx.hist_weather(spark, sf),
        "target": fx.panel(spark, sf),
    }
    folder, state = scratch_dir("feed-"), scratch_dir("state-")
    schemas = {}
    for name, df in tables.items():
        day, value = _REFRESHED[name]
        changed = df.filter(F.dayofmonth(day) % 3 == 0).withColumn(value, F.col(value) + 1)
        schemas[name] = _write_feed([df, changed], f"{folder}/{name}")
    views = feeds.refresh_tables(spark, folder, state, schemas, KEYS)
    remove_dir(spark, folder)
    parts = [v.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"),
                   F.sum(F.col(_REFRESHED[name][1]).cast("decimal(18,4)")).cast("double").alias("total"))
             for name, v in views.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("stream_features", _target_family_sql(), ("panel",))
def stream_features(spark, sf):
    """Target features refreshed per arriving batch of items; equals the batch ``lag_fallback``."""
    stored = scratch_dir("panel-")
    fx.panel(spark, sf).repartitionByRange("datetime").write.parquet(stored)  # in the order of time: a batch reads its look-back only
    panel = spark.read.parquet(stored)
    items = panel.drop("target")

    def build(batch):
        start, end = batch.agg(F.min("datetime"), F.max("datetime")).first()
        hist = lookback_prune(panel, "datetime", start, max(FT.TARGET_LAGS))
        if end is not None:
            hist = hist.filter(F.col("datetime") <= F.lit(end))
        return FT.target_features(batch.drop(feeds.BLOCK), hist)

    # The files of a drop go by time, too, so the items of a batch lie near each other.
    out = _streamed(spark, [d.repartitionByRange("datetime") for d in _thirds(items)],
                    lambda folder, schema, out, ck: feeds.stream_features(spark, folder, schema, out, ck, build, 8))
    remove_dir(spark, stored)
    return out


@query("stream_dedupe", """
SELECT DISTINCT county, is_business, product_type, is_consumption, datetime FROM panel""", ("panel",))
def stream_dedupe(spark, sf):
    def job(folder, schema, out, checkpoint):
        feeds.run_to_files(feeds.dedupe(feeds.read_feed(spark, folder, schema), KEY, "datetime"), out, checkpoint)
        return spark.read.schema(schema).parquet(out).select(*KEY)

    return _streamed(spark, [fx.panel(spark, sf), _new_rows(spark, sf)], job)


@query("stream_sliding_sum", """
WITH w AS (SELECT county, target, date_trunc('day', datetime) + to_days(CAST(k AS INTEGER)) AS datetime FROM panel, range(1, 8) r(k))
SELECT county, datetime, sum(target) AS target_7d FROM w
WHERE datetime <= (SELECT max(datetime) FROM panel) - INTERVAL 1 DAY GROUP BY county, datetime""", ("panel",))
def stream_sliding_sum(spark, sf):
    """Closed 7-day windows (every day) of the hourly target per county, as a live aggregate."""
    def job(folder, schema, out, checkpoint):
        s = feeds.sliding_sum(feeds.read_feed(spark, folder, schema), ["county"], "datetime", "target", "7 days", "1 day", "target_7d")
        feeds.run_to_files(s, out, checkpoint)
        return spark.read.schema(s.schema).parquet(out)

    return _streamed(spark, _thirds(fx.panel(spark, sf).select("county", "datetime", "target")), job)


@query("stream_compacted", _UPSERT_SQL, ("panel",))
def stream_compacted(spark, sf):
    """``upsert_latest`` through a compacted state: six drops, drained by two runs of the same job, a snapshot every two batches."""
    folder, state, checkpoint, stored = (scratch_dir(p) for p in ("feed-", "state-", "stream-", "panel-"))
    fx.panel(spark, sf).repartitionByRange("datetime").write.parquet(stored)  # made once; a drop reads its own span
    panel = spark.read.parquet(stored)
    files = spark.sparkContext.defaultParallelism  # of a drop: it stays one micro-batch, however large
    for block, drops in enumerate((_thirds(panel), _thirds(_raised(panel)))):
        dealt = [d.withColumn(feeds.BLOCK, F.lit(block).cast("long")).repartition(files) for d in drops]
        schema = _write_feed(dealt, f"{folder}/run={block}")
        out = feeds.stream_state(spark, folder, schema, state, checkpoint, KEY, 2, files)
    for path in (folder, checkpoint, stored):
        remove_dir(spark, path)
    return out


# --- Inference with tables refreshed before each prediction -----------------------------------------
STEPS = 4  # blocks of equal span of the panel
IDLE, GAP = 1, 2  # the block that is not scored, and the one whose items lack inputs
_FORECAST_REG = {k: v.replace("_historical", "_forecast") for k, v in REG_SQL.items()}


def _step_sql(t: str) -> str:
    return f"CAST(least({STEPS - 1}, greatest(0, floor((epoch({t}) - lo) * {STEPS} / (hi - lo + 1)))) AS BIGINT)"


def _inference_sql() -> str:
    """The states of each scored block written out: rows that had arrived by then, corrected where the correction had."""
    arrives = _step_sql("p.datetime + INTERVAL 48 HOUR")
    ctes, union = [], []
    whole = " AND ".join(f"sx.{c} IS NOT NULL" for c in sorted(set(_FORECAST_REG.values())))
    case = " ".join(f"WHEN product_type = {g} THEN {solar_sql(th, _FORECAST_REG)}" for g, th in group_params().items())
    mean = " + ".join(solar_sql(th, _FORECAST_REG) for th in group_params().values())
    for b in sorted(set(range(STEPS)) - {IDLE}):
        family = _norm_sql().replace("WHERE p.is_consumption = 1", "")
        for name in ("target_per_eic_m1", "target_per_eic_m2", "norm"):
            family = re.sub(rf"\b{name}\b", f"{name}_s{b}", family)
        family = family.replace("FROM panel p LEFT JOIN client c ON c.county = p.county AND c.is_business = p.is_business\n  AND c.product_type = p.product_type AND c.date = CAST(p.datetime AS DATE)",
                                f"FROM panel_s{b} p LEFT JOIN client c ON c.county = p.county AND c.is_business = p.is_business AND c.product_type = p.product_type AND c.date = CAST(p.datetime AS DATE)", 1)
        family = re.sub(r"\bj AS", f"j_s{b} AS", family)
        family = re.sub(r"\bdf AS", f"df_s{b} AS", family)
        family = re.sub(r"FROM j\)", f"FROM j_s{b})", family)
        ctes.append(f"panel_s{b} AS (SELECT p.* REPLACE (p.target + CASE WHEN p.row_id % 3 = 0 AND {arrives} + 1 <= {b} THEN 1 ELSE 0 END AS target) "
                    f"FROM panel p, span WHERE {arrives} <= {b})")
        ctes.append(family)
        union.append(f"""SELECT i.row_id, i.blk, CASE WHEN sx.is_consumption = 0 THEN CASE {case} ELSE ({mean}) / {len(group_params())} END
    ELSE (0.6 * (d.target_per_eic_48h * sx.eic_count) + 0.4 * (d.target_per_eic_168h * sx.eic_count)) / 1.0 END AS prediction
  FROM items i JOIN sx ON sx.row_id = i.row_id JOIN df_s{b} d ON d.row_id = i.row_id WHERE i.blk = {b}""")
    return f"""WITH {SX_CTE}, span AS (SELECT epoch(min(datetime)) AS lo, epoch(max(datetime)) AS hi FROM panel),
{_norm_sql().replace("WHERE p.is_consumption = 1", "")},
items AS (SELECT sx.row_id, {_step_sql("sx.datetime")} AS blk FROM sx JOIN df ON df.row_id = sx.row_id, span
  WHERE {_step_sql("sx.datetime")} = {GAP} OR ({whole} AND df.target_per_eic_48h IS NOT NULL AND df.target_per_eic_168h IS NOT NULL)),
{', '.join(ctes)},
preds AS ({' UNION ALL '.join(union)}),
flags AS (SELECT blk, bool_or(prediction IS NULL) AS missing FROM preds GROUP BY blk)
SELECT row_id, blk AS data_block_id, CASE WHEN missing THEN 44444444.0 WHEN prediction < 0 THEN 0.0 ELSE prediction END AS target
FROM preds JOIN flags USING (blk) UNION ALL SELECT row_id, blk, 0.0 FROM items WHERE blk = {IDLE}"""


def _save_bundle(spark, folder):
    """A model of given parameters: the solar formula per product type, and persistence of 48 h and 168 h for consumption."""
    params = SO.params_frame(spark, "product_type", group_params())
    J.JoinedModel(params, [J.Part((), 48), J.Part((), 168)], [0.6, 0.4], combine="first").save(folder)


@query("stream_inference", _inference_sql(), SX_FIX)
def stream_inference(spark, sf):
    """Every step brings the tables' new rows and the items of a quarter of the panel's span; a loaded model scores them.

    Targets arrive two days after their hour, a third of them again, corrected, one step later; clients arrive two days late.  The
    items of the second step are not scored, those of the third include rows without forecast or history, so that the sentinel
    fires for that step.  All look-back reads the states as of the step.
    """
    from ..streaming.inference import run_refreshed

    panel = fx.panel(spark, sf).checkpoint()
    client, hist = fx.client(spark, sf), fx.hist_weather(spark, sf)
    forecast = fx.forecast_weather(spark, sf).withColumnsRenamed({"u10": U, "v10": V}).withColumn(
        "forecast_datetime", F.expr("origin_datetime + make_dt_interval(0, hours_ahead)"))
    ev = read_table(spark, sf, "events")
    gas = ev.groupBy(F.to_date("ts").alias("forecast_date")).agg(F.min("value").alias("lowest_price_per_mwh"), F.max("value").alias("highest_price_per_mwh"))
    power = ev.groupBy(F.date_trunc("hour", "ts").alias("forecast_date")).agg(F.max("value").alias("euros_per_mwh"))
    stations = fx.station_weights(spark, sf).checkpoint()
    lo, hi = panel.agg(F.min(F.unix_timestamp("datetime")), F.max(F.unix_timestamp("datetime"))).first()

    def arrives(when):
        at = F.floor((F.unix_timestamp(when) - F.lit(lo)) * STEPS / (F.lit(hi) - F.lit(lo) + 1))
        return F.least(F.lit(STEPS - 1), F.greatest(F.lit(0), at)).cast("long")

    target = panel.drop("row_id").withColumn(feeds.BLOCK, arrives(F.expr("datetime + INTERVAL 48 HOURS")))
    again = panel.filter("row_id % 3 = 0").drop("row_id").withColumns({
        "target": F.col("target") + 1, feeds.BLOCK: arrives(F.expr("datetime + INTERVAL 48 HOURS")) + 1})
    whole = joined_inputs(spark, sf, panel)
    items = panel.drop("target").join(whole, "row_id").withColumns({feeds.BLOCK: arrives("datetime"), "currently_scored": arrives("datetime") != IDLE})
    items = items.filter((F.col(feeds.BLOCK) == GAP) | F.col("whole")).drop("whole")
    drops = {"client": client.withColumn(feeds.BLOCK, arrives(F.expr("cast(date as timestamp) + INTERVAL 48 HOURS"))),
             "gas_prices": gas.withColumn(feeds.BLOCK, arrives(F.col("forecast_date").cast("timestamp"))),
             "electricity_prices": power.withColumn(feeds.BLOCK, arrives("forecast_date")),
             "forecast_weather": forecast.withColumn(feeds.BLOCK, arrives("forecast_datetime")),
             "historical_weather": hist.withColumn(feeds.BLOCK, arrives("datetime")),
             "target": target.unionByName(again), "items": items}
    folder, state, checkpoint, bundle = (scratch_dir(p) for p in ("feed-", "state-", "stream-", "bundle-"))
    for name, df in drops.items():
        df.write.parquet(f"{folder}/{name}")
    _save_bundle(spark, bundle)
    model = J.load(spark, bundle)
    wx = ["temperature", "dewpoint", "snowfall", "rain", "windspeed_10m"]

    def build(asked, tables):
        b = FT.client_features(FT.with_date(asked), tables["client"]).drop("date")
        h = FT.county_hist_weather(tables["historical_weather"], stations)[0]
        f = FT.county_forecast_weather(tables["forecast_weather"].drop("forecast_datetime"), stations)[0]
        h = h.select("county", "datetime", *[F.col(c).alias(f"{c}_historical") for c in wx])
        f = f.select("county", "datetime", *[F.col(c).alias(f"{c}_forecast") for c in wx],
                     F.col("surface_solar_radiation_downwards").alias("surface_solar_radiation_downwards_forecast"))
        b = b.join(h, ["county", "datetime"], "left").join(f, ["county", "datetime"], "left")
        norm = FT.normalised_target(tables["target"], tables["client"])
        past = lookback_prune(norm, "datetime", lookback_min(asked, "datetime"), 168)
        return lag_fallback(b, past, "target_per_eic", [48, 168])

    out = run_refreshed(spark, folder, state, checkpoint, {n: d.schema for n, d in drops.items()}, KEYS, build, model.predict)
    for path in (folder, checkpoint, bundle):
        remove_dir(spark, path)
    return out


def joined_inputs(spark, sf, panel):
    """row_id and whole: whether the row has client, forecast weather and both lags in the end."""
    base = solar_frame(spark, sf, production_only=False, panel=panel)
    norm = FT.normalised_target(panel, fx.client(spark, sf))
    lags = lag_fallback(panel.select("row_id", *FT.SEGMENT, "datetime"), norm, "target_per_eic", [48, 168])
    needed = [*sorted(set(_FORECAST_REG.values())), "target_per_eic_48h", "target_per_eic_168h"]
    whole = reduce(and_, [F.col(c).isNotNull() for c in needed])
    return base.join(lags.select("row_id", "target_per_eic_48h", "target_per_eic_168h"), "row_id", "left").select("row_id", whole.alias("whole"))
