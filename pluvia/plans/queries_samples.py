"""Sample assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.functions import times
from pluvia.functions.arrays import every_nth
from pluvia.functions.scalars import sample_mass
from pluvia.operators import samples as S
from pluvia.operators.grid import frame_times, pack_frames, unpack_frames
from pluvia.operators.ordering import dataset_of, dataset_offsets, time_rank
from pluvia.plans import views as V
from pluvia.plans.registry import query
from pluvia.plans.samples import sample_table
from pluvia.sources.files import hours_needed

MARKS = f"marks AS (SELECT DISTINCT {V.SQL_MARK} AS frame_ts FROM events)"
MARK_FRAMES = f"""mf AS (SELECT {V.SQL_MARK} AS frame_ts, round(sum(value), 4) AS total,
  CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1)"""


def _kind_frames(kind):
    return f"""SELECT {V.SQL_MARK} AS frame_ts, round(sum(value), 4) AS total
      FROM events WHERE event_type = '{kind}' GROUP BY 1"""


def _span(name, lo, hi):
    return f"{name} AS (SELECT CAST(unnest(generate_series({lo}, {hi})) AS INT) AS {name[:-1]})"


def _first(col="values"):
    return F.get(col, F.lit(0))


@query(
    "unpack_frames",
    f"WITH {V.SQL_CELLS} SELECT vec_id, i, j, round(value, 6) AS value FROM cells",
)
def _unpack(spark, sf):
    return unpack_frames(V.frames(spark, sf), V.NJ, ["vec_id"]).withColumn(
        "value", F.round("value", 6)
    )


@query(
    "pack_frames",
    f"""WITH c AS (SELECT {V.SQL_MARK} AS frame_ts, CAST(event_id % 4 AS INT) AS i,
      CAST(floor(event_id / 4.0) AS BIGINT) % 4 AS j, avg(value) AS value FROM events GROUP BY 1, 2, 3)
    SELECT frame_ts, CAST(i * 4 + j AS INT) AS pos, round(value, 6) AS value FROM c""",
)
def _pack(spark, sf):
    packed = pack_frames(V.sparse_cells(spark, sf), 4, 4, ["frame_ts"], sparse=True)
    cells = packed.select("frame_ts", F.posexplode("values").alias("pos", "value"))
    return cells.where("value is not null").withColumn("value", F.round("value", 6))


@query(
    "frame_keys",
    f"WITH {MARKS} SELECT strftime(frame_ts, '%Y%m%d/%H%M') AS key, frame_ts FROM marks",
)
def _frame_keys(spark, sf):
    keys = frame_times(V.mark_frames(spark, sf))
    return keys.select(times.time_key(F.col("frame_ts")).alias("key"), "frame_ts")


@query(
    "time_keys",
    """SELECT event_id, strftime(ts, '%Y%m%d/%H%M') AS key, strftime(ts, '%Y%m%d-%H%M') AS pred_key,
      date_trunc('minute', ts) AS back FROM events""",
)
def _time_keys(spark, sf):
    r = V.readings(spark, sf).withColumn("key", times.time_key(F.col("ts")))
    return r.select(
        "event_id", "key",
        times.time_key(F.col("ts"), times.PREDICTION_KEY_FORMAT).alias("pred_key"),
        times.parse_time_key(F.col("key")).cast("timestamp_ntz").alias("back"),
    )


@query(
    "floor_10min",
    f"SELECT event_id, {V.SQL_MARK} AS mark, date_trunc('hour', ts) AS hour FROM events",
)
def _floor(spark, sf):
    ts = F.col("ts")
    return V.readings(spark, sf).select(
        "event_id", times.floor_minutes(ts).alias("mark"), times.floor_hour(ts).alias("hour")
    )


@query(
    "lag_keys",
    f"""WITH {MARKS}, {_span('lags', 0, 3)}
    SELECT frame_ts, lag, frame_ts - to_minutes(lag * 10) AS past_ts,
      frame_ts - to_minutes((3 - lag) * 10) AS oldest_first_ts FROM marks CROSS JOIN lags""",
)
def _lag_keys(spark, sf):
    ts = F.col("frame_ts")
    both = V.marks(spark, sf).select(
        "frame_ts",
        F.posexplode(
            F.arrays_zip(
                times.past_times(ts, 4).alias("p"), times.past_times_oldest_first(ts, 4).alias("o")
            )
        ).alias("lag", "_z"),
    )
    return both.select(
        "frame_ts", "lag", F.col("_z.p").alias("past_ts"), F.col("_z.o").alias("oldest_first_ts")
    )


@query(
    "lead_keys",
    f"""WITH {MARKS}, {_span('leads', 1, 3)}
    SELECT frame_ts, lead, frame_ts + to_minutes(lead * 10) AS future_ts,
      frame_ts + to_minutes((lead - 1) * 10) AS with_first_ts,
      strftime(frame_ts, '%Y%m%d/%H%M') || '/' ||
        strftime(frame_ts + to_minutes(lead * 10), '%Y%m%d-%H%M') AS pred_key
    FROM marks CROSS JOIN leads""",
)
def _lead_keys(spark, sf):
    ts = F.col("frame_ts")
    zipped = V.marks(spark, sf).select(
        "frame_ts",
        F.posexplode(
            F.arrays_zip(
                times.future_times(ts, 3).alias("f"),
                times.future_times(ts, 3, include_first=True).alias("w"),
                times.prediction_keys(ts, 3).alias("k"),
            )
        ).alias("p", "_z"),
    )
    return zipped.select(
        "frame_ts", (F.col("p") + 1).alias("lead"), F.col("_z.f").alias("future_ts"),
        F.col("_z.w").alias("with_first_ts"), F.col("_z.k").alias("pred_key"),
    )


@query(
    "past_join",
    f"""WITH {MARK_FRAMES}, {_span('lags', 0, 9)}
    SELECT k.frame_ts AS key_ts, lag, f.total, f.n FROM mf k CROSS JOIN lags
    LEFT JOIN mf f ON f.frame_ts = k.frame_ts - to_minutes(lag * 10)""",
)
def _past_join(spark, sf):
    f = V.mark_frames(spark, sf)
    keys = f.select(F.col("frame_ts").alias("key_ts"))
    past = S.past_frames(keys, f, 10)
    return past.select(
        "key_ts", "lag", _first().alias("total"), F.get("values", F.lit(1)).alias("n")
    )


@query(
    "future_join",
    f"""WITH {MARK_FRAMES}, {_span('leads', 1, 6)}
    SELECT k.frame_ts AS key_ts, lead, f.total, f.n FROM mf k CROSS JOIN leads
    LEFT JOIN mf f ON f.frame_ts = k.frame_ts + to_minutes(lead * 10)""",
)
def _future_join(spark, sf):
    f = V.mark_frames(spark, sf)
    keys = f.select(F.col("frame_ts").alias("key_ts"))
    future = S.future_frames(keys, f, 6)
    return future.select(
        "key_ts", "lead", _first().alias("total"), F.get("values", F.lit(1)).alias("n")
    )


@query(
    "lead_pairs",
    f"""WITH {MARK_FRAMES}, {_span('leads', 1, 6)}
    SELECT k.frame_ts AS key_ts, lead,
      CASE WHEN a.total IS NOT NULL AND b.total IS NOT NULL THEN a.total END AS previous,
      CASE WHEN a.total IS NOT NULL AND b.total IS NOT NULL THEN b.total END AS target
    FROM mf k CROSS JOIN leads
    LEFT JOIN mf a ON a.frame_ts = k.frame_ts + to_minutes((lead - 1) * 10)
    LEFT JOIN mf b ON b.frame_ts = k.frame_ts + to_minutes(lead * 10)""",
)
def _lead_pairs(spark, sf):
    f = V.mark_frames(spark, sf)
    pairs = S.lead_pairs(f.select(F.col("frame_ts").alias("key_ts")), f, 6)
    return pairs.select(
        "key_ts", "lead", _first("previous").alias("previous"), _first("target").alias("target")
    )


def _valid_sql(horizon):
    return f"""WITH {MARKS}, c AS (SELECT frame_ts,
      count(*) OVER (ORDER BY frame_ts RANGE BETWEEN INTERVAL {(horizon - 1) * 10} MINUTE PRECEDING
        AND CURRENT ROW) AS past,
      count(*) OVER (ORDER BY frame_ts RANGE BETWEEN INTERVAL 10 MINUTE FOLLOWING
        AND INTERVAL 60 MINUTE FOLLOWING) AS future FROM marks)"""


@query(
    "valid_keys",
    _valid_sql(10) + " SELECT frame_ts FROM c WHERE 10 - past <= 3 AND future = 6",
)
def _valid_keys(spark, sf):
    return S.valid_keys(V.marks(spark, sf), 10, 6)


@query(
    "valid_keys_latent",
    _valid_sql(10) + " SELECT frame_ts FROM c WHERE 10 - past <= 1 AND future = 6",
)
def _valid_keys_latent(spark, sf):
    return S.valid_keys(V.marks(spark, sf), 4, 6, latent=True)


@query(
    "requested_keys",
    f"""WITH {MARKS} SELECT frame_ts FROM marks SEMI JOIN
    (SELECT DISTINCT {V.SQL_MARK} + INTERVAL 1 DAY AS frame_ts FROM events
     WHERE event_type = 'signup') USING (frame_ts)""",
)
def _requested_keys(spark, sf):
    asked = V.marks(spark, sf, "signup").select(
        (F.col("frame_ts") + times.minutes(24 * 60)).alias("frame_ts")
    )
    return S.requested_keys(asked, V.marks(spark, sf))


@query(
    "common_keys",
    f"""SELECT {V.SQL_MARK} AS frame_ts FROM events WHERE event_type = 'view'
    INTERSECT SELECT {V.SQL_MARK} FROM events WHERE event_type = 'click'
    INTERSECT SELECT {V.SQL_MARK} FROM events WHERE event_type = 'error'""",
)
def _common_keys(spark, sf):
    return S.common_keys([V.marks(spark, sf, k) for k in ("view", "click", "error")])


@query(
    "multi_source",
    f"""WITH a AS ({_kind_frames('view')}), b AS ({_kind_frames('click')}),
    k AS (SELECT frame_ts AS key_ts FROM a INTERSECT SELECT frame_ts FROM b),
    {_span('lags', 0, 3)}
    SELECT key_ts, 'x' AS kind, 0 AS source, lag, lag * 2 AS channel, total FROM k
      JOIN lags ON lag < 3 LEFT JOIN a ON a.frame_ts = key_ts - to_minutes(lag * 10)
    UNION ALL SELECT key_ts, 'y', 0, lag, (lag - 1) * 2, total FROM k
      JOIN lags ON lag BETWEEN 1 AND 2 LEFT JOIN a ON a.frame_ts = key_ts + to_minutes(lag * 10)
    UNION ALL SELECT key_ts, 'x', 1, lag, 6 + lag, total FROM k
      JOIN lags ON lag < 2 LEFT JOIN b ON b.frame_ts = key_ts - to_minutes(lag * 10)
    UNION ALL SELECT key_ts, 'y', 1, lag, 4 + lag - 1, total FROM k
      JOIN lags ON lag = 1 LEFT JOIN b ON b.frame_ts = key_ts + to_minutes(lag * 10)""",
)
def _multi_source(spark, sf):
    sources = [
        S.Source(V.mark_frames(spark, sf, "view"), 3, 2, channels=2),
        S.Source(V.mark_frames(spark, sf, "click"), 2, 1, channels=1),
    ]
    out = S.multi_source_samples(sources)
    return out.select("key_ts", "kind", "source", "lag", "channel", _first().alias("total"))


@query(
    "with_predictions",
    f"""WITH {V.SQL_PREDICTIONS}
    SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(issue * 10 AS INT)) AS key_ts,
      lag AS lead, round(sum(value), 4) AS total
    FROM predictions WHERE model = 'damped' AND lag <= 6 GROUP BY issue, lag""",
)
def _with_predictions(spark, sf):
    preds = V.predictions(spark, sf).where(F.col("model") == "damped")
    keys = V.frames(spark, sf).select(F.col("frame_ts").alias("key_ts"))
    out = S.with_predictions(keys, preds, 6)
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return out.select("key_ts", "lead", F.round(total, 4).alias("total"))


@query(
    "static_enrichment",
    f"""WITH {V.SQL_CELLS}, grid AS (SELECT DISTINCT i, j, 10.0::DOUBLE * i + j AS elevation,
      -22.0::DOUBLE - 0.5::DOUBLE * i AS lat FROM cells)
    SELECT vec_id, round(sum(value * elevation), 3) AS lifted, round(min(lat), 6) AS south
    FROM cells JOIN grid USING (i, j) GROUP BY 1""",
)
def _static(spark, sf):
    cells = unpack_frames(V.frames(spark, sf), V.NJ, ["vec_id"])
    grid = cells.select("i", "j").distinct().select(
        "i", "j", (F.lit(10.0) * F.col("i") + F.col("j")).alias("elevation"),
        (F.lit(-22.0) - F.lit(0.5) * F.col("i")).alias("lat"),
    )
    out = S.with_static(cells, grid, ["i", "j"])
    return out.groupBy("vec_id").agg(
        F.round(F.sum(F.col("value") * F.col("elevation")), 3).alias("lifted"),
        F.round(F.min("lat"), 6).alias("south"),
    )


@query(
    "date_features",
    f"""WITH {MARKS} SELECT frame_ts, round(month(frame_ts) / 12.0, 6) AS month_f,
      round(day(frame_ts) / 31.0, 6) AS day_f, round(hour(frame_ts) / 24.0, 6) AS hour_f,
      round(minute(frame_ts) / 60.0, 6) AS minute_f FROM marks""",
)
def _date_features(spark, sf):
    out = S.with_date_features(V.marks(spark, sf), "frame_ts")
    return out.select(
        "frame_ts", *[F.round(c, 6).alias(c) for c in ("month_f", "day_f", "hour_f", "minute_f")]
    )


@query(
    "lead_expansion",
    f"WITH {MARKS}, {_span('leads', 0, 5)} SELECT frame_ts, lead FROM marks CROSS JOIN leads",
)
def _lead_expansion(spark, sf):
    return S.lead_expansion(V.marks(spark, sf), 6)


@query(
    "sample_table",
    f"""WITH {V.SQL_CELLS}, f AS (SELECT vec_id, sum(value) AS total FROM cells GROUP BY 1),
    {_span('lags', 0, 6)},
    rows_ AS (
      SELECT k.vec_id, 'x' AS kind, 0 AS source, lag, lag AS channel, f.total / 2 AS total FROM f k
        JOIN lags ON lag < 4 LEFT JOIN f ON f.vec_id = k.vec_id - lag
      UNION ALL SELECT k.vec_id, 'y', 0, lag, lag - 1, f.total FROM f k
        JOIN lags ON lag BETWEEN 1 AND 6 LEFT JOIN f ON f.vec_id = k.vec_id + lag
      UNION ALL SELECT k.vec_id, 'x', 1, lag, 4 + lag * 2, f.total / 2 FROM f k
        JOIN lags ON lag < 4 LEFT JOIN f ON f.vec_id = k.vec_id - lag
      UNION ALL SELECT k.vec_id, 'x', 2, lag, 12 + lag - 1, f.total * (1 - 0.05 * lag) / 2
        FROM f k JOIN lags ON lag BETWEEN 1 AND 6 JOIN f ON f.vec_id = k.vec_id)
    SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(vec_id * 10 AS INT)) AS key_ts, kind,
      source, lag, channel, round(total, 4) AS total FROM rows_""",
)
def _sample_table(spark, sf):
    total = F.array(F.aggregate("values", F.lit(0.0), lambda s, v: s + v))
    f = V.frames(spark, sf).select("frame_ts", total.alias("values"))
    faded = V.predictions(spark, sf).where(F.col("model") == "damped").withColumn("values", total)
    out = sample_table(
        f, 4, 6, radar=f, predictions=faded, x_transform=lambda a: F.transform(a, lambda v: v / 2)
    )
    return out.withColumn("values", F.round(_first(), 4)).withColumnRenamed("values", "total")


def _channel_rows(spark, sf):
    """Samples with fine (view) and coarse (click) frames plus metadata rows."""
    rows = V.readings(spark, sf).select(
        "event_id",
        F.when(F.col("event_type").isin("view", "click"), "x")
        .when(F.col("event_type").isin("signup", "error"), "y").otherwise("meta").alias("kind"),
        F.when(F.col("event_type").isin("view", "signup"), 0).otherwise(1).alias("ch"),
        F.pmod("event_id", F.lit(5)).cast("int").alias("lag"),
        F.get(
            F.array(F.lit("elevation"), F.lit("lat_lon"), F.lit("hour")),
            F.pmod("station_id", F.lit(3)).cast("int"),
        ).alias("feature"),
        F.when(F.pmod("station_id", F.lit(2)) == 0, "satellite").otherwise("radar").alias("src"),
    )
    return rows


_CHANNELS = """r AS (SELECT event_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'x' WHEN event_type IN ('signup', 'error') THEN 'y'
    ELSE 'meta' END AS kind,
  CASE WHEN event_type IN ('view', 'signup') THEN 0 ELSE 1 END AS ch, event_id % 5 AS lag,
  ['elevation', 'lat_lon', 'hour'][CAST(user_id % 3 AS INT) + 1] AS feature,
  CASE WHEN user_id % 2 = 0 THEN 'satellite' ELSE 'radar' END AS src FROM events)"""


@query(
    "select_channels",
    f"""WITH {_CHANNELS} SELECT event_id, kind, ch FROM r
    WHERE (kind = 'x' AND lag < 3 AND ch = 0 AND src <> 'satellite') OR (kind = 'y' AND ch = 0)
      OR (kind = 'meta' AND feature IN ('elevation', 'hour'))""",
)
def _select_channels(spark, sf):
    out = S.select_channels(
        _channel_rows(spark, sf), 3, elevation=True, hour=True, context=False, satellite=False
    )
    return out.select("event_id", "kind", "ch")


@query(
    "select_channels_context",
    f"""WITH {_CHANNELS} SELECT event_id, kind, ch FROM r
    WHERE (kind = 'x' AND lag < 4) OR kind = 'y' OR (kind = 'meta' AND feature = 'lat_lon')""",
)
def _select_context(spark, sf):
    out = S.select_channels(_channel_rows(spark, sf), 4, lat_lon=True, target_context=True)
    return out.select("event_id", "kind", "ch")


@query(
    "deinterleave",
    f"""WITH {V.SQL_CELLS} SELECT vec_id, round(sum(CASE WHEN k % 2 = 0 THEN value END), 4) AS fine,
      round(sum(CASE WHEN k % 2 = 1 THEN value END), 4) AS coarse FROM cells GROUP BY 1""",
)
def _deinterleave(spark, sf):
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 4)
    return V.frames(spark, sf).select(
        "vec_id",
        total(every_nth(F.col("values"), 2, 0)).alias("fine"),
        total(every_nth(F.col("values"), 2, 1)).alias("coarse"),
    )


@query(
    "sample_weights",
    f"""WITH {V.SQL_CELLS}, {_span('offs', -3, 2)},
    mass AS (SELECT vec_id, sum(1.0 - exp(-value)) AS m FROM cells GROUP BY 1),
    w AS (SELECT k.vec_id, sum(coalesce(m.m, 0)) + 100 AS raw FROM (SELECT vec_id FROM embeddings) k
      CROSS JOIN offs LEFT JOIN mass m ON m.vec_id = k.vec_id - off GROUP BY 1)
    SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(vec_id * 10 AS INT)) AS key_ts,
      round(raw, 5) AS raw_weight, round(raw / sum(raw) OVER () * 1000, 6) AS weight FROM w""",
)
def _sample_weights(spark, sf):
    f = S.frame_mass(V.frames(spark, sf))
    keys = f.select(F.col("frame_ts").alias("key_ts"))
    past, future = S.past_frames(keys, f, 3), S.future_frames(keys, f, 3)
    w = S.sample_weights(past.select("key_ts", "values").unionByName(
        future.select("key_ts", "values")))
    return w.select(
        "key_ts", F.round("raw_weight", 5).alias("raw_weight"),
        F.round(F.col("weight") * 1000, 6).alias("weight"),
    )


def _frame_weights(spark, sf):
    f = V.frames(spark, sf)
    mass = F.aggregate("values", F.lit(0.0), lambda s, v: s + sample_mass(v))
    ranked = time_rank(f.select("frame_ts", mass.alias("weight")), "frame_ts", out="idx")
    return ranked.select("idx", "weight")


@query(
    "rolling_weights",
    f"""WITH {V.SQL_CELLS}, w AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx,
      sum(1.0 - exp(-value)) AS weight FROM cells GROUP BY vec_id),
    s AS (SELECT idx, sum(weight) OVER win + (9 - count(*) OVER win) * min(weight) OVER () AS s
      FROM w WINDOW win AS (ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
    SELECT idx, round(s, 5) AS sum_weight, round(s / sum(s) OVER () * 1000, 6) AS weight FROM s""",
)
def _rolling(spark, sf):
    out = S.rolling_weights(_frame_weights(spark, sf), 5, 4)
    return out.select(
        "idx", F.round("sum_weight", 5).alias("sum_weight"),
        F.round(F.col("weight") * 1000, 6).alias("weight"),
    )


@query(
    "lead_decay",
    f"""WITH {V.SQL_CELLS}, {_span('leads', 0, 5)}, w AS (SELECT
      row_number() OVER (ORDER BY vec_id) - 1 AS idx, sum(1.0 - exp(-value)) AS weight
      FROM cells GROUP BY vec_id)
    SELECT idx, lead, round(weight * exp(-ln(4.0) / 6 * lead), 6) AS weight
    FROM w CROSS JOIN leads""",
)
def _decay(spark, sf):
    out = S.lead_decay(_frame_weights(spark, sf), 6)
    return out.select("idx", "lead", F.round("weight", 6).alias("weight"))


@query(
    "dataset_offsets",
    """WITH n AS (SELECT event_type AS dataset, count(*) AS n FROM events GROUP BY 1)
    SELECT dataset, CAST(sum(n) OVER (ORDER BY dataset) - n AS BIGINT) AS first,
      CAST(sum(n) OVER (ORDER BY dataset) AS BIGINT) AS "end" FROM n""",
)
def _offsets(spark, sf):
    sizes = V.readings(spark, sf).groupBy(F.col("event_type").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return dataset_offsets(sizes, "dataset", "n")


@query(
    "dataset_of_index",
    """WITH n AS (SELECT event_type AS dataset, count(*) AS n FROM events GROUP BY 1),
    o AS (SELECT dataset, sum(n) OVER (ORDER BY dataset) - n AS f,
      sum(n) OVER (ORDER BY dataset) AS e FROM n)
    SELECT event_id AS idx, dataset, CAST(event_id - f AS BIGINT) AS local
    FROM events JOIN o ON event_id >= f AND event_id < e""",
)
def _dataset_of(spark, sf):
    r = V.readings(spark, sf)
    sizes = r.groupBy(F.col("event_type").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    index = r.select(F.col("event_id").alias("idx"))
    return dataset_of(index, dataset_offsets(sizes, "dataset", "n"), "dataset")


@query(
    "target_times",
    """WITH t AS (SELECT max(ts) AS ts FROM events), n AS (SELECT unnest(generate_series(0, 47)) AS n)
    SELECT CAST(n AS INT) AS n, time_bucket(INTERVAL '10 minutes', ts) - to_minutes(CAST(n * 10 AS INT)) AS target_ts,
      n < 36 AS used, n IN (0, 18) AS issue FROM t CROSS JOIN n""",
)
def _target_times(spark, sf):
    last = V.readings(spark, sf).agg(F.max("ts").alias("ts"))
    marks = last.select(F.posexplode(times.target_times(F.col("ts"))).alias("n", "target_ts"))
    return marks.select(
        "n", "target_ts", (F.col("n") < F.lit(48 - 12)).alias("used"),
        F.col("n").isin(0, 18).alias("issue"),
    )


@query(
    "archive_hours",
    """SELECT DISTINCT CAST(year(ts) AS INT) AS year, CAST(dayofyear(ts) AS INT) AS doy,
      CAST(hour(ts) AS INT) AS hour FROM events""",
)
def _archive_hours(spark, sf):
    return hours_needed(V.readings(spark, sf))


@query(
    "first_hours",
    """SELECT DISTINCT CAST(year(ts) AS INT) AS year, CAST(dayofyear(ts) AS INT) AS doy,
      CAST(hour(ts) AS INT) AS hour FROM events ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 6""",
)
def _first_hours(spark, sf):
    return hours_needed(V.readings(spark, sf)).limit(6)


@query(
    "hour_bounds",
    """SELECT event_id, strftime(date_trunc('hour', ts) - INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS start,
      strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS "end",
      strftime(date_trunc('hour', ts) - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS end_local,
      strftime(ts - INTERVAL 3 HOUR, '%H:%M') AS caption FROM events""",
)
def _hour_bounds(spark, sf):
    ts = F.col("ts")
    bounds = [c.alias(n) for n, c in times.hour_bounds(ts, 6).items()]
    return V.readings(spark, sf).select("event_id", *bounds, times.caption_time(ts).alias("caption"))


@query(
    "parse_datetimes",
    """SELECT event_id, date_trunc('second', ts) AS parsed, ts AS scan FROM events""",
)
def _parse(spark, sf):
    r = V.readings(spark, sf).select(
        "event_id",
        F.date_format("ts", times.TEXT_FORMAT).alias("text"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("iso"),
    )
    return r.select(
        "event_id",
        times.parse_datetime(F.col("text")).cast("timestamp_ntz").alias("parsed"),
        times.parse_scan_time(F.col("iso")).cast("timestamp_ntz").alias("scan"),
    )
