"""Verification queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pluvia.functions.scalars import clean_score
from pluvia.operators.grid import centre_window, unpack_frames
from pluvia.operators.ordering import nth_last, time_rank
from pluvia.operators.verify import (
    HEADLINE,
    UserMetric,
    csi_parts,
    hindcast_table,
    forecast_table,
    marker_table,
    match_forecasts,
    neighbourhood_pairs,
    paired_cells,
    pooled_csi,
    rank_models,
    score,
    with_captions,
)
from pluvia.plans import views as V
from pluvia.plans.registry import query
from pluvia.plans.report import score_report

KEYS = ["model", "lag"]


def r6(c):
    return F.round(c, 6)


def _pairs(spark, sf):
    matched = match_forecasts(V.predictions(spark, sf), V.frames(spark, sf), "inner")
    return paired_cells(matched, KEYS)


def _snake(name: str) -> str:
    return name.lower().replace("-", "_")


def _tidy(df):
    out = [
        r6(F.col(f"`{c}`")).alias(_snake(c)) if t == "double" else F.col(f"`{c}`").alias(_snake(c))
        for c, t in df.dtypes
    ]
    return df.select(*out)


def _csi(k):
    return (
        f"sum(CAST(p > {k} AND t > {k} AS INT))::DOUBLE / nullif(sum(CAST(p > {k} OR t > {k} AS INT)), 0)"
    )


def _ets(k):
    hit = f"sum(CAST(p > {k} AND t > {k} AS INT))::DOUBLE"
    rnd = f"(sum(CAST(p > {k} AS INT))::DOUBLE * sum(CAST(t > {k} AS INT)) / count(*))"
    den = f"(sum(CAST(p > {k} OR t > {k} AS INT)) - {rnd})"
    return f"({hit} - {rnd}) / nullif({den}, 0)"


_HEAD = f"""scores AS (
  SELECT model, lag, avg(abs(ln(1.0 + p) - ln(1.0 + t))) AS log_mae,
         avg((ln(1.0 + p) - ln(1.0 + t)) ** 2) AS log_mse, {_csi(1)} AS csi1, {_csi(8)} AS csi8
  FROM pairs GROUP BY 1, 2)"""


def _flag(kind, m):
    low = m.startswith("log")
    fn = "min" if (kind == "best") == low else "max"
    return (
        f"(model = first_value(model) OVER (PARTITION BY lag ORDER BY {m} "
        f"{'ASC' if fn == 'min' else 'DESC'}, CASE model WHEN 'persistence' THEN 0 ELSE 1 END)) "
        f"AS {kind}_{m}"
    )


_COLS = ["log_mae", "log_mse", "csi1", "csi8"]


@query(
    "score_report",
    f"WITH {V.SQL_PREDICTIONS}, {_HEAD} SELECT model, lag, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _COLS)
    + ", "
    + ", ".join(_flag(k, c) for k in ("worst", "best") for c in _COLS)
    + " FROM scores",
)
def _score_report(spark, sf):
    report = score_report(
        V.predictions(spark, sf), V.frames(spark, sf), ["persistence", "damped"], HEADLINE
    )
    return _tidy(report)


@query(
    "score_report_user_metric",
    f"""WITH {V.SQL_PREDICTIONS}, s AS (SELECT model, lag, round(avg(abs(p - t)), 6) AS mae,
      round(1 - sum(abs(p - t)) / sum(p + t), 6) AS overlap,
      round(sqrt(sum((p - t) ** 2) / count(*)), 6) AS rmse FROM pairs GROUP BY 1, 2)
    SELECT *, rmse = min(rmse) OVER (PARTITION BY lag) AND model = first_value(model) OVER (
      PARTITION BY lag ORDER BY rmse, CASE model WHEN 'persistence' THEN 0 ELSE 1 END) AS best_rmse FROM s""",
)
def _score_report_user(spark, sf):
    """The report with two scores given as functions of numpy arrays."""
    user = {
        "overlap": UserMetric(
            lambda p, t: [np.nansum(np.abs(p - t)), np.nansum(p + t)], 2, lambda d, s: 1 - F.try_divide(d, s)
        ),
        "rmse": UserMetric(
            lambda p, t: [np.nansum((p - t) ** 2), np.count_nonzero(~np.isnan(p - t))], 2,
            lambda s, n: F.sqrt(F.try_divide(s, n)),
        ),
    }
    report = score_report(
        V.predictions(spark, sf), V.frames(spark, sf), ["persistence", "damped"], ["MAE"], user=user
    )
    return report.select(
        "model", "lag", r6("MAE").alias("mae"), r6("overlap").alias("overlap"), r6("rmse").alias("rmse"), "best_rmse"
    )


@query(
    "error_scores",
    f"""WITH {V.SQL_PREDICTIONS} SELECT model, lag, round(avg((p - t) ** 2), 6) AS mse,
    round(avg(abs(p - t)), 6) AS mae, round(avg((ln(1.0 + p) - ln(1.0 + t)) ** 2), 6) AS log_mse,
    round(avg(abs(ln(1.0 + p) - ln(1.0 + t))), 6) AS log_mae FROM pairs GROUP BY 1, 2""",
)
def _error_scores(spark, sf):
    return _tidy(score(_pairs(spark, sf), KEYS, ["MSE", "MAE", "log-MSE", "log-MAE"]))


@query(
    "csi_all",
    f"WITH {V.SQL_PREDICTIONS} SELECT model, lag, "
    + ", ".join(f"round({_csi(k)}, 6) AS csi{k}" for k in (1, 2, 4, 8, 16))
    + " FROM pairs GROUP BY 1, 2",
)
def _csi_all(spark, sf):
    return _tidy(score(_pairs(spark, sf), KEYS, [f"CSI{k}" for k in (1, 2, 4, 8, 16)]))


@query(
    "ets_all",
    f"WITH {V.SQL_PREDICTIONS} SELECT model, lag, "
    + ", ".join(f"round({_ets(k)}, 6) AS ets{k}" for k in (1, 2, 4, 8))
    + " FROM pairs GROUP BY 1, 2",
)
def _ets_all(spark, sf):
    return _tidy(score(_pairs(spark, sf), KEYS, [f"ETS{k}" for k in (1, 2, 4, 8)]))


@query(
    "csi_parts",
    f"""WITH {V.SQL_PREDICTIONS} SELECT model, lag,
    CAST(sum(CAST(p > 2 AND t > 2 AS INT)) AS BIGINT) AS tp_2,
    CAST(sum(CAST(p > 2 OR t > 2 AS INT)) AS BIGINT) AS den_2 FROM pairs GROUP BY 1, 2""",
)
def _csi_parts(spark, sf):
    return csi_parts(_pairs(spark, sf), KEYS, [2])


@query(
    "csi_pooled_rollup",
    f"WITH {V.SQL_PREDICTIONS} SELECT coalesce(model, 'all') AS model, coalesce(lag, 0) AS lag, "
    + ", ".join(f"round({_csi(k)}, 6) AS csi_{k}" for k in (1, 8))
    + " FROM pairs GROUP BY ROLLUP(model, lag)",
)
def _csi_pooled(spark, sf):
    pooled = pooled_csi(_pairs(spark, sf), KEYS, [1, 8])
    return _tidy(pooled.na.fill({"model": "all", "lag": 0}))


@query(
    "csi_neighbourhood",
    f"""WITH {V.SQL_PREDICTIONS},
    win AS (SELECT * FROM (VALUES (0), (1)) a(oi) CROSS JOIN (VALUES (0), (1)) b(oj)),
    pooled AS (SELECT model, lag, issue, oi, oj, max(p) AS p, max(t) AS t FROM pairs
      JOIN win ON i BETWEEN 2 * oi AND 2 * oi + 4 AND j BETWEEN 2 * oj AND 2 * oj + 4
      GROUP BY 1, 2, 3, 4, 5)
    SELECT model, lag, CAST(sum(CAST(p > 12 AND t > 12 AS INT)) AS BIGINT) AS tp,
      CAST(sum(CAST(p > 12 OR t > 12 AS INT)) AS BIGINT) AS den, round({_csi(12)}, 6) AS csi
    FROM pooled GROUP BY 1, 2""",
)
def _csi_neighbourhood(spark, sf):
    matched = match_forecasts(V.predictions(spark, sf), V.frames(spark, sf), "inner")
    parts = csi_parts(neighbourhood_pairs(matched, KEYS, V.NI, V.NJ), KEYS, [12])
    return parts.select(
        *KEYS, F.col("tp_12").alias("tp"), F.col("den_12").alias("den"),
        r6(F.try_divide("tp_12", "den_12")).alias("csi"),
    )


@query(
    "model_ranks",
    f"""WITH {V.SQL_PREDICTIONS}, {_HEAD},
    long AS (SELECT model, lag, 'log-MAE' AS metric, log_mae AS score, log_mae AS s FROM scores
      UNION ALL SELECT model, lag, 'CSI1', csi1, -csi1 FROM scores)
    SELECT lag, model, metric, round(score, 6) AS score,
      CAST(rank() OVER (PARTITION BY lag, metric ORDER BY s) AS INT) AS rank FROM long""",
)
def _model_ranks(spark, sf):
    metrics = ["log-MAE", "CSI1"]
    ranks = rank_models(score(_pairs(spark, sf), KEYS, metrics), ["lag"], "model", metrics)
    return ranks.withColumn("score", r6("score"))


@query(
    "nth_last_key",
    """WITH k AS (SELECT DISTINCT vec_id FROM embeddings),
    r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS rn FROM k)
    SELECT CASE rn WHEN 1 THEN 'last' ELSE 'issue' END AS role,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(vec_id * 10 AS INT)) AS frame_ts
    FROM r WHERE rn IN (1, 19)""",
)
def _nth_last_key(spark, sf):
    f = V.frames(spark, sf)
    last = nth_last(f, "frame_ts", 1).withColumn("role", F.lit("last"))
    return last.unionByName(nth_last(f, "frame_ts", 19).withColumn("role", F.lit("issue"))).select(
        "role", "frame_ts"
    )


@query(
    "key_positions",
    f"""WITH m AS (SELECT DISTINCT {V.SQL_MARK} AS frame_ts FROM events)
    SELECT frame_ts, row_number() OVER (ORDER BY frame_ts) - 1 AS rank FROM m""",
)
def _key_positions(spark, sf):
    return time_rank(V.marks(spark, sf), "frame_ts")


@query(
    "next_hours_set",
    f"""WITH {V.SQL_PREDICTIONS} SELECT model, lag, round(sum(value), 4) AS total,
    count(*) AS n FROM predictions WHERE issue = (SELECT max(vec_id) FROM embeddings)
    GROUP BY 1, 2""",
)
def _next_hours(spark, sf):
    shown = forecast_table(V.predictions(spark, sf), V.frames(spark, sf))
    cells = shown.select("model", "lag", F.explode("values").alias("v"))
    return cells.groupBy("model", "lag").agg(
        F.round(F.sum("v"), 4).alias("total"), F.count(F.lit(1)).alias("n")
    )


@query(
    "last_hours_scores",
    f"""WITH {V.SQL_PREDICTIONS}, scored AS (SELECT * FROM pairs
      WHERE issue = (SELECT max(vec_id) - 18 FROM embeddings))
    SELECT model, lag, round(avg(abs(ln(1.0 + p) - ln(1.0 + t))), 6) AS log_mae,
      round({_csi(1)}, 6) AS csi1 FROM scored GROUP BY 1, 2""",
)
def _last_hours(spark, sf):
    f = V.frames(spark, sf)
    issued = hindcast_table(V.predictions(spark, sf), f)
    pairs = paired_cells(match_forecasts(issued, f, "inner"), KEYS)
    return _tidy(score(pairs, KEYS, ["log-MAE", "CSI1"]))


@query(
    "display_markers",
    f"""WITH {V.SQL_PREDICTIONS} SELECT model, lag, strftime(TIMESTAMP '2024-01-01 00:00:00'
      + to_minutes(CAST(valid * 10 AS INT)) - INTERVAL 3 HOUR, '%H:%M') AS valid_caption, i, j,
      round(10 * log10(value), 6) AS value
    FROM predictions WHERE issue = (SELECT max(vec_id) FROM embeddings)
      AND value > 0 AND 10 * log10(value) >= 10""",
)
def _display_markers(spark, sf):
    shown = with_captions(forecast_table(V.predictions(spark, sf), V.frames(spark, sf)))
    cells = unpack_frames(shown, V.NJ, ["model", "lag", "valid_caption"])
    return marker_table(cells, "DBZH").withColumn("value", r6("value"))


@query(
    "rain_markers",
    f"""WITH {V.SQL_CELLS} SELECT vec_id, count(*) AS n, round(sum(value), 4) AS total
    FROM cells WHERE value >= 0.5 GROUP BY 1""",
)
def _rain_markers(spark, sf):
    cells = unpack_frames(V.frames(spark, sf), V.NJ, ["vec_id"])
    return marker_table(cells, "ABI-L2-RRQPEF").groupBy("vec_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "centre_window",
    f"""WITH {V.SQL_CELLS} SELECT vec_id, count(*) AS n, round(sum(value), 4) AS block_total,
    round(sum(CASE WHEN i = j THEN value END), 4) AS diagonal_total
    FROM cells WHERE i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5 GROUP BY 1""",
)
def _centre_window(spark, sf):
    cells = unpack_frames(V.frames(spark, sf), V.NJ, ["vec_id"])
    block = centre_window(cells, 2, 5)
    return block.groupBy("vec_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("block_total"),
        F.round(F.sum(F.when(F.col("i") == F.col("j"), F.col("value"))), 4).alias("diagonal_total"),
    )


@query(
    "centre_diagonal",
    f"""WITH {V.SQL_CELLS} SELECT vec_id, i, j, round(value, 6) AS value FROM cells
    WHERE i BETWEEN 2 AND 5 AND i = j""",
)
def _centre_diagonal(spark, sf):
    cells = unpack_frames(V.frames(spark, sf), V.NJ, ["vec_id"])
    return centre_window(cells, 2, 5, diagonal=True).withColumn("value", r6("value"))


@query(
    "clean_scores",
    """WITH e AS (SELECT vec_id, 40.0 * CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT vec_id, round(sum(CASE WHEN v > 0 THEN v ELSE 0 END), 4) AS cleaned,
      CAST(sum(CAST(v <= 0 AS INT)) AS BIGINT) AS zeroed FROM e GROUP BY 1""",
)
def _clean_scores(spark, sf):
    raw = V.table(spark, sf, "embeddings").select(
        "vec_id", F.explode("embedding").alias("e")
    ).withColumn("v", F.lit(40.0) * F.col("e").cast("double"))
    return raw.groupBy("vec_id").agg(
        F.round(F.sum(clean_score(F.col("v"))), 4).alias("cleaned"),
        F.count(F.when(F.col("v") <= 0, 1)).alias("zeroed"),
    )
