"""Thresholds, decisions and detection metrics. Series are event types, runs are users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conformal, evaluation
from ..sources.tables import SCORES, scores
from .registry import query, r6

_RANKED = "o AS (SELECT series, run, tick, event_id, score, row_number() OVER (PARTITION BY series, run ORDER BY score, event_id) AS i, count(*) OVER (PARTITION BY series, run) AS n FROM scores)"
_Q = "q AS (SELECT series, run, score AS q_run FROM o WHERE i = least(greatest(ceil(0.95::DOUBLE * n), 1), n))"
_TAU = "t AS (SELECT series, q_run AS tau FROM (SELECT series, q_run, row_number() OVER (PARTITION BY series ORDER BY q_run, run) AS i, count(*) OVER (PARTITION BY series) AS n FROM q WHERE run % 4 <> 0) WHERE i = ceil((n + 1) * (1 - 0.1::DOUBLE)))"


@query(f"WITH {SCORES}, {_RANKED}, {_Q} SELECT series, run, round(q_run, 6) AS q_run FROM q")
def g07_order_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.order_stat(scores(spark, sf_dir), ["series", "run"], 0.95).withColumn("q_run", r6("q_run"))


@query(f"WITH {SCORES}, {_RANKED} SELECT series, run, round(score, 6) AS q_run FROM o WHERE i = ceil(0.95::DOUBLE * (n - 1)) + 1")
def g08_quantile_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.quantile_higher(scores(spark, sf_dir), ["series", "run"], 0.95).withColumn("q_run", r6("q_run"))


@query(f"WITH {SCORES} SELECT series, round(quantile_cont(score, 0.95), 6) AS tau FROM scores GROUP BY series")
def p07_pooled_linear_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled 95th percentile, between two neighbours in proportion."""
    return conformal.quantile_linear(scores(spark, sf_dir), ["series"], 0.95, name="tau").withColumn("tau", r6("tau"))


_ALPHAS = [0.1, 0.0005]
_AT_ALPHAS = "f AS (SELECT series, run, q_run, row_number() OVER (PARTITION BY series ORDER BY q_run, run) AS i, count(*) OVER (PARTITION BY series) AS n FROM q), w AS (SELECT f.*, alpha, ceil((n + 1) * (1 - alpha)) AS wanted FROM f, (VALUES (0.1::DOUBLE), (0.0005::DOUBLE)) a(alpha))"


def _taus(spark: SparkSession, sf_dir: str, beyond: str) -> DataFrame:
    """Thresholds over all runs for an alpha that they are enough for, and for one that asks for more runs than a small table has."""
    q = conformal.order_stat(scores(spark, sf_dir), ["series", "run"], 0.95)
    found = [conformal.conformal_tau(q, ["series"], x, value="q_run", beyond=beyond).withColumn("alpha", F.lit(x)) for x in _ALPHAS]
    return found[0].unionByName(found[1])


@query(f"""
WITH {SCORES}, {_RANKED}, {_Q}, {_AT_ALPHAS}
SELECT series, alpha, CAST(n AS BIGINT) AS n, wanted > n AS overflow, CASE WHEN wanted > n THEN NULL ELSE round(q_run, 6) END AS tau FROM w WHERE i = least(n, wanted)
""")
def g09_conformal_infinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too few calibration runs for an alpha leave the threshold infinite (null at the sink)."""
    t = _taus(spark, sf_dir, "infinite")
    return t.select("series", "alpha", "n", "overflow", F.when(F.col("tau") != float("inf"), r6("tau")).alias("tau"))


@query(f"""
WITH {SCORES}, {_RANKED}, {_Q}, {_AT_ALPHAS}
SELECT series, alpha, CAST(n AS BIGINT) AS n, wanted > n AS overflow, round(q_run, 6) AS tau FROM w WHERE i = least(n, wanted)
""")
def g09_conformal_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taus(spark, sf_dir, "capped").select("series", "alpha", "n", "overflow", r6("tau").alias("tau"))


@query(f"""
WITH {SCORES}, o AS (SELECT series, event_id, score, row_number() OVER (PARTITION BY series ORDER BY score, event_id) AS i, count(*) OVER (PARTITION BY series) AS n FROM scores),
k AS (SELECT *, least(ceil(n * 0.95::DOUBLE), n - 1) AS k FROM o), b AS (SELECT series, max(CASE WHEN i = k THEN score END) AS a, max(CASE WHEN i = k + 1 THEN score END) AS b FROM k GROUP BY series)
SELECT series, event_id, round(CASE WHEN i > k THEN a ELSE b END, 6) AS tau_loo, score > CASE WHEN i > k THEN a ELSE b END AS above FROM k JOIN b USING (series)
""")
def g10_loo_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame against the threshold that the others of its series give."""
    found = conformal.loo_conformal(scores(spark, sf_dir), ["series"], 0.95)
    return found.select("series", "event_id", r6("tau_loo").alias("tau_loo"), (F.col("score") > F.col("tau_loo")).alias("above"))


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows with tau and q_run of their series and run, q by run). Runs whose number 4 does not divide calibrate."""
    s = scores(spark, sf_dir)
    q = conformal.order_stat(s, ["series", "run"], 0.95)
    tau = conformal.conformal_tau(q.where("run % 4 <> 0"), ["series"], 0.1, value="q_run").select("series", "tau")
    return s.join(q, ["series", "run"]).join(F.broadcast(tau), "series"), q  # tau: a row a series


_DECISION = "count(*) AS n_frames, round(any_value(q_run), 6) AS q_run, any_value(q_run) > any_value(tau) AS flagged, round(avg(CASE WHEN score > tau THEN 1.0 ELSE 0.0 END), 6) AS frac_above, min(CASE WHEN score > tau THEN tick END) AS first_above"


@query(f"WITH {SCORES}, {_RANKED}, {_Q}, {_TAU} SELECT series, s.run, {_DECISION} FROM scores s JOIN q USING (series, run) JOIN t USING (series) GROUP BY series, s.run")
def g11_run_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _decided(spark, sf_dir)
    found = conformal.run_decision(rows, ["series", "run"], F.col("tau"), F.col("q_run"))
    return found.withColumn("q_run", r6("q_run")).withColumn("frac_above", r6("frac_above"))


@query(f"WITH {SCORES}, {_RANKED}, {_Q}, {_TAU} SELECT series, round(tau, 6) AS tau FROM t")
def p01_split_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = conformal.order_stat(scores(spark, sf_dir).where("run % 4 <> 0"), ["series", "run"], 0.95)
    return conformal.conformal_tau(q, ["series"], 0.1, value="q_run").select("series", r6("tau").alias("tau"))


@query(f"""
WITH {SCORES}, o AS (SELECT series, score, row_number() OVER (PARTITION BY series ORDER BY score, event_id) AS i, count(*) OVER (PARTITION BY series) AS n FROM scores WHERE run % 4 <> 0)
SELECT series, CAST(n AS BIGINT) AS n, round(score, 6) AS tau FROM o WHERE i = ceil((n + 1) * (1 - 0.05::DOUBLE))
""")
def p04_frame_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal.conformal_tau(scores(spark, sf_dir).where("run % 4 <> 0"), ["series"], 0.05).select("series", "n", r6("tau").alias("tau"))


_WINDOWS = "windows AS (SELECT run, CAST(j AS INT) AS w, CAST(m * (j + 1) // 5 AS INT) AS start, CAST(m * (j + 1) // 5 + m // 4 AS INT) AS stop FROM (SELECT user_id AS run, count(*) AS m FROM events GROUP BY user_id), (SELECT unnest(range(3)) AS j) WHERE run % 4 = 0)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, window, start, stop: three windows, which overlap, in every fourth run."""
    n = scores(spark, sf_dir).groupBy("run").agg(F.count("*").alias("m")).where("run % 4 = 0").withColumn("window", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    start = F.floor(F.col("m") * (F.col("window") + 1) / 5).cast("int")
    return n.select("run", "window", start.alias("start"), (start + F.floor(F.col("m") / 4)).cast("int").alias("stop"))


@query(f"""
WITH {SCORES}, {_WINDOWS}
SELECT s.run, s.tick, CAST(coalesce(max(w), -1) AS INT) AS window FROM scores s LEFT JOIN windows k ON s.run = k.run AND s.tick >= start AND s.tick < stop WHERE s.run % 4 = 0 GROUP BY s.run, s.tick
""")
def j06_window_of_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last anomaly window around each tick, half open."""
    return evaluation.window_of(scores(spark, sf_dir).where("run % 4 = 0").select("run", "tick"), _windows(spark, sf_dir))


_IN = f"WITH {SCORES}, {_WINDOWS}, k AS (SELECT s.run, s.tick, s.score, coalesce(max(w), -1) AS w FROM scores s LEFT JOIN windows k ON s.run = k.run AND s.tick >= start AND s.tick < stop WHERE s.run % 4 = 0 GROUP BY s.run, s.tick, s.score)"


@query(f"""
{_IN}, p AS (SELECT run, w, max(score) AS peak FROM k WHERE w >= 0 GROUP BY run, w),
a AS (SELECT avg(CASE WHEN peak > 150 THEN 1.0 ELSE 0.0 END) AS tpr, count(*) AS n_windows FROM p), b AS (SELECT avg(CASE WHEN score > 150 THEN 1.0 ELSE 0.0 END) AS fpr, count(*) AS n_outside FROM k WHERE w < 0)
SELECT round(tpr, 6) AS tpr, n_windows, round(fpr, 6) AS fpr, n_outside, round(1 - fpr, 6) AS tnr, round((tpr + 1 - fpr) / 2, 6) AS balanced FROM a, b
""")
def g15_window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.window_of(scores(spark, sf_dir).where("run % 4 = 0").select("run", "tick", "score"), _windows(spark, sf_dir))
    m = evaluation.window_metrics(rows, 150.0)
    return m.select(*(r6(c).alias(c) if c in ("tpr", "fpr", "tnr", "balanced") else c for c in m.columns))


_TAUS = [float(x) for x in range(0, 400, 8)]


@query(f"""
{_IN}, n AS (SELECT CAST(x AS DOUBLE) AS tau FROM range(0, 400, 8) t(x)), c AS (SELECT count(*) FILTER (w >= 0) AS p, count(*) FILTER (w < 0) AS q FROM k)
SELECT tau, round(count(*) FILTER (w >= 0 AND score > tau) / any_value(p), 6) AS tpr, round(count(*) FILTER (w < 0 AND score > tau) / any_value(q), 6) AS fpr FROM n, k, c GROUP BY tau
""")
def g16_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.window_of(scores(spark, sf_dir).where("run % 4 = 0").select("run", "tick", "score"), _windows(spark, sf_dir)).withColumn("positive", F.col("window") >= 0)
    taus = spark.createDataFrame([(t,) for t in _TAUS], "tau double")
    return evaluation.roc(rows, taus).select("tau", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query(f"""
{_IN}, n AS (SELECT CAST(x AS DOUBLE) AS tau FROM range(0, 400, 8) t(x)), c AS (SELECT count(*) FILTER (w >= 0) AS p, count(*) FILTER (w < 0) AS q FROM k),
r AS (SELECT count(*) FILTER (w < 0 AND score > tau) / any_value(q) AS x, count(*) FILTER (w >= 0 AND score > tau) / any_value(p) AS y FROM n, k, c GROUP BY tau UNION ALL SELECT 0.0, 0.0 UNION ALL SELECT 1.0, 1.0),
l AS (SELECT x, y, lag(x) OVER (ORDER BY x, y) AS px, lag(y) OVER (ORDER BY x, y) AS py FROM r)
SELECT round(sum((x - px) * (y + py) / 2), 6) AS area FROM l
""")
def g16_roc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.window_of(scores(spark, sf_dir).where("run % 4 = 0").select("run", "tick", "score"), _windows(spark, sf_dir)).withColumn("positive", F.col("window") >= 0)
    taus = spark.createDataFrame([(t,) for t in _TAUS], "tau double")
    return evaluation.area(evaluation.roc(rows, taus)).withColumn("area", r6("area"))


_AUROC = "round((sum(r) FILTER (pos) - any_value(n1) * (any_value(n1) + 1) / 2) / nullif(any_value(n1) * any_value(n0), 0), 6) AS auroc, CAST(any_value(n1) AS BIGINT) AS n_pos, CAST(any_value(n0) AS BIGINT) AS n_neg"


@query(f"""
{_IN}, r AS (SELECT run, w >= 0 AS pos, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2 AS r, count(*) FILTER (w >= 0) OVER (PARTITION BY run) AS n1, count(*) FILTER (w < 0) OVER (PARTITION BY run) AS n0 FROM k)
SELECT run, {_AUROC} FROM r GROUP BY run
""")
def g13_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.window_of(scores(spark, sf_dir).where("run % 4 = 0").select("run", "tick", "score"), _windows(spark, sf_dir)).withColumn("positive", F.col("window") >= 0)
    return evaluation.auroc(rows, ["run"]).withColumn("auroc", r6("auroc"))


_QUALITY = """
WITH s AS (SELECT lang, CAST(n_chars AS DOUBLE) AS score, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)),
r AS (SELECT lang, pos, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r, count(*) FILTER (pos) OVER (PARTITION BY lang) AS n1, count(*) FILTER (NOT pos) OVER (PARTITION BY lang) AS n0 FROM s)
"""


@query(f"{_QUALITY} SELECT lang, {_AUROC} FROM r GROUP BY lang")
def g13_auroc_of_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a document's length tells the quality label, by language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    rows = d.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").withColumn("positive", F.col("quality") == 1)
    return evaluation.auroc(rows, ["lang"]).withColumn("auroc", r6("auroc"))


@query(f"""
WITH {SCORES}, a AS (SELECT run, tick, score FROM scores WHERE run % 2 = 0), b AS (SELECT run - 1 AS run, tick, score AS twin FROM scores WHERE run % 2 = 1),
p AS (SELECT run, score, twin FROM a JOIN b USING (run, tick)), l AS (SELECT run, score, true AS pos FROM p UNION ALL SELECT run, twin, false FROM p),
r AS (SELECT run, score, pos, rank() OVER (PARTITION BY run ORDER BY score) + (count(*) OVER (PARTITION BY run, score) - 1) / 2 AS r, count(*) FILTER (pos) OVER (PARTITION BY run) AS n1, count(*) FILTER (NOT pos) OVER (PARTITION BY run) AS n0 FROM l)
SELECT run, CASE WHEN count(DISTINCT score) < 2 THEN 0.5 ELSE round((sum(r) FILTER (pos) - any_value(n1) * (any_value(n1) + 1) / 2) / (any_value(n1) * any_value(n0)), 6) END AS auroc,
    CAST(any_value(n1) AS BIGINT) AS n_pos, CAST(any_value(n0) AS BIGINT) AS n_neg FROM r GROUP BY run
""")
def j04_auroc_same_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against its twin, tick by tick."""
    s = scores(spark, sf_dir)
    a = s.where("run % 2 = 0").select("run", "tick", "score")
    b = s.where("run % 2 = 1").select((F.col("run") - 1).alias("run"), "tick", "score")
    return evaluation.auroc_same_tick(a, b, ["run"]).withColumn("auroc", r6("auroc"))


@query(f"""
WITH {SCORES}, {_RANKED}, {_Q}, {_TAU}, {_WINDOWS}, o2 AS (SELECT run, min(start) AS onset, max(stop) AS until FROM windows GROUP BY run)
SELECT series, s.run, {_DECISION}, min(CASE WHEN score > tau THEN tick END) - any_value(onset) AS delay
FROM scores s JOIN q USING (series, run) JOIN t USING (series) JOIN o2 ON o2.run = s.run WHERE tick >= onset AND tick < until GROUP BY series, s.run
""")
def p05_results_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions inside each run's anomaly span, with the delay from its onset."""
    rows, _ = _decided(spark, sf_dir)
    span = _windows(spark, sf_dir).groupBy("run").agg(F.min("start").alias("onset"), F.max("stop").alias("until"))
    inside = rows.join(span, "run").where("tick >= onset and tick < until")
    found = conformal.run_decision(inside, ["series", "run", "onset"], F.col("tau"), F.col("q_run"))
    return found.withColumn("delay", F.col("first_above") - F.col("onset")).withColumn("q_run", r6("q_run")).withColumn("frac_above", r6("frac_above")).drop("onset")


@query(f"""
WITH {SCORES}, {_RANKED}, {_Q}, {_TAU}, r AS (SELECT CASE WHEN run % 4 = 0 THEN 'anomaly' ELSE 'negative' END AS type, CASE WHEN run % 3 = 0 THEN NULL ELSE series END AS kind, q_run > tau AS flagged FROM q JOIN t USING (series)),
l AS (SELECT type AS grp, flagged FROM r UNION ALL SELECT type || '/' || kind, flagged FROM r WHERE kind IS NOT NULL)
SELECT grp AS "group", round(avg(CASE WHEN flagged THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM l GROUP BY grp
""")
def g14_rates_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and false-alarm rates; a run counts in its type and in type/kind."""
    s = scores(spark, sf_dir)
    q = conformal.order_stat(s, ["series", "run"], 0.95)
    tau = conformal.conformal_tau(q.where("run % 4 <> 0"), ["series"], 0.1, value="q_run").select("series", "tau")
    r = q.join(F.broadcast(tau), "series").select(F.when(F.col("run") % 4 == 0, "anomaly").otherwise("negative").alias("type"), F.when(F.col("run") % 3 != 0, F.col("series")).alias("kind"), (F.col("q_run") > F.col("tau")).alias("flagged"))
    return evaluation.rates_by_group(r).withColumn("rate", r6("rate"))


@query(f"WITH {SCORES} SELECT series, run, round((avg(score) - any_value(m)) / any_value(s), 6) AS z, round(avg(CASE WHEN score < m THEN 1.0 ELSE 0.0 END), 6) AS share_below FROM scores JOIN (SELECT series, avg(score) AS m, CASE WHEN stddev_pop(score) = 0 THEN 1 ELSE stddev_pop(score) END AS s FROM scores GROUP BY series) USING (series) GROUP BY series, run")
def g20_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    m = s.groupBy("series").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).withColumn("s", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")))
    j = s.join(F.broadcast(m), "series")  # a row a series
    return j.groupBy("series", "run").agg(r6((F.avg("score") - F.first("m")) / F.first("s")).alias("z"), r6(F.avg((F.col("score") < F.col("m")).cast("double"))).alias("share_below"))


@query(f"""
WITH {SCORES} SELECT run, tick, round(max(score) FILTER (series = 'click'), 6) AS click, round(max(score) FILTER (series = 'error'), 6) AS error, round(max(score) FILTER (series = 'purchase'), 6) AS purchase,
    round(max(score) FILTER (series = 'signup'), 6) AS signup, round(max(score) FILTER (series = 'view'), 6) AS view FROM scores GROUP BY run, tick
""")
def j03_wide_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series side by side on run and tick; blank where a series has no score there."""
    wide = scores(spark, sf_dir).groupBy("run", "tick").pivot("series", ["click", "error", "purchase", "signup", "view"]).agg(F.first("score"))
    return wide.select("run", "tick", *(r6(c).alias(c) for c in wide.columns[2:]))
