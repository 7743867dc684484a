"""Sweeps over pool sizes, shares of the corpus and thresholds, from one stored table of neighbours.

Recordings here are thirds of the embeddings' labels: 24 pool runs in two towns (even and odd) and 6 test runs, whose ticks 10 to 19 of each
30 are windows. Test rows come from two sources; the second has no components from 48 on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sweeps
from ..sources.tables import recordings
from .registry import query, r6

KS, SIZES, DRAWS, SHARES = [1, 3, 5, 10], [2, 5, 10, 15, 20], 5, [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
ALPHA_FRAME, ALPHA_RUN, LISTED = 0.05, 0.05, 10
KEYS = ["source", "run", "tick", "id", "test", "window"]
POOL_RUNS = list(range(24))
_DRAWN = sweeps.stratified_draws({town: [r for r in POOL_RUNS if r % 2 == town] for town in (0, 1)}, SIZES, DRAWS)

_PARTS = """
rec AS (SELECT CAST(label * 3 + vec_id % 3 AS INT) AS run, CAST(row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) AS INT) AS tick, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
src AS (SELECT 'gt' AS source, * FROM rec UNION ALL SELECT 'owl', run, tick, id, list_transform(v, lambda x, i: CASE WHEN i > 48 THEN 0 ELSE x END) FROM rec WHERE run >= 24),
qs AS (SELECT source, run, tick, id, run >= 24 AS test, CASE WHEN run >= 24 AND tick // 10 % 3 = 1 THEN tick // 30 ELSE -1 END AS window, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM src),
ps AS (SELECT id AS r_id, run AS r_run, v AS r FROM qs WHERE source = 'gt' AND run < 24),
pairs AS (SELECT source, run, id, test, "window", r_id, r_run, 1 - list_dot_product(v, r) AS d FROM qs JOIN ps ON run <> r_run)"""
_EVALUATED = """
l AS (SELECT {keys}, run, score, row_number() OVER (PARTITION BY {keys}, run ORDER BY score) AS i, count(*) OVER (PARTITION BY {keys}, run) AS c FROM s WHERE NOT test),
q AS (SELECT {keys}, score AS q_run FROM l WHERE i = ceil(0.95::DOUBLE * (c - 1)) + 1),
t AS (SELECT {keys}, q_run, row_number() OVER (PARTITION BY {keys} ORDER BY q_run) AS i, count(*) OVER (PARTITION BY {keys}) AS c FROM q),
tau AS (SELECT {keys}, q_run AS tau, ceil((c + 1) * (1 - 0.05::DOUBLE)) > c AS capped FROM t WHERE i = least(ceil((c + 1) * (1 - 0.05::DOUBLE)), c)),
w AS (SELECT {keys}, source, max(CASE WHEN score > tau THEN 1 ELSE 0 END) AS hit FROM s JOIN tau USING ({keys}) WHERE test AND "window" >= 0 GROUP BY {keys}, source, run, "window"),
wr AS (SELECT {keys}, source, avg(hit) AS tpr, count(*) AS n_windows FROM w GROUP BY {keys}, source),
o AS (SELECT {keys}, source, any_value(tau) AS tau, any_value(capped) AS capped, avg(CASE WHEN score > tau THEN 1 ELSE 0 END) AS fpr, count(*) AS n_outside FROM s JOIN tau USING ({keys}) WHERE test AND "window" < 0 GROUP BY {keys}, source)"""
_RESULT = 'CAST(k AS INT) AS k, source, round(tau, 6) AS tau, capped, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round((tpr + 1 - fpr) / 2, 6) AS balanced, n_windows, n_outside'
_SCORED = """
s AS (SELECT {keys}, k, source, run, test, "window", round(avg(d), 9) AS score FROM b JOIN (VALUES (1), (3), (5), (10)) ks(k) ON n <= k GROUP BY {keys}, k, source, run, id, test, "window")"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = recordings(spark, sf_dir)
    return q, q.where("source = 'gt' AND NOT test").select(F.col("id").alias("r_id"), F.col("run").alias("r_run"), F.col("v").alias("r"))


def _shown(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, "k", "source", r6("tau").alias("tau"), "capped", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"), r6("balanced").alias("balanced"), "n_windows", "n_outside")


@query(f"""
WITH {_PARTS}, o AS (SELECT *, row_number() OVER (PARTITION BY source, id, r_run ORDER BY d, r_id) AS n FROM pairs)
SELECT source, id, r_run, CAST(least(count(*), {LISTED}) AS INT) AS n, any_value(r_id) FILTER (n = 1) AS nearest, round(max(d) FILTER (n <= {LISTED}), 6) AS furthest, round(max(d) FILTER (n = {LISTED + 1}), 6) AS bound
FROM o WHERE n <= {LISTED + 1} AND r_run IN (1, 2, 5, 8, 13, 21) GROUP BY source, id, r_run
""")
def p12_pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table, read for six of its runs."""
    q, pool = _sides(spark, sf_dir)
    rows = sweeps.PairTable.store(q, pool, KEYS, LISTED).read(spark, [1, 2, 5, 8, 13, 21])
    bound = F.when(F.col("bound") < float("inf"), r6("bound"))
    return rows.select("source", "id", "r_run", F.size("near").alias("n"), F.col("near")[0]["r_id"].alias("nearest"), r6(F.element_at("near", -1)["d"]).alias("furthest"), bound.alias("bound"))


@query(f"""
WITH {_PARTS}, draws(size, draw, member) AS (VALUES {", ".join(str(x) for x in _DRAWN)}),
b AS (SELECT r.size, r.draw, source, run, id, test, "window", d, row_number() OVER (PARTITION BY r.size, r.draw, source, id ORDER BY d, r_id) AS n
    FROM pairs JOIN draws r ON r.member = r_run LEFT JOIN draws m ON m.size = r.size AND m.draw = r.draw AND m.member = run WHERE test OR m.member IS NOT NULL),
{_SCORED.format(keys="size, draw")}, {_EVALUATED.format(keys="size, draw, k")}
SELECT CAST(size AS INT) AS size, CAST(draw AS INT) AS draw, {_RESULT} FROM o JOIN wr USING (size, draw, k, source)
""")
def p09_whole_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole protocol for each stratified draw of pool runs: left-out scores, quantiles by run, conformal threshold, window metrics."""
    q, pool = _sides(spark, sf_dir)
    draws = spark.createDataFrame(_DRAWN, "size int, draw int, member int")
    near = sweeps.nearest_of_draws(sweeps.PairTable.store(q, pool, KEYS, LISTED), q, pool, draws, max(KS))
    return _shown(sweeps.evaluated(sweeps.mean_scores(near, KS), ["size", "draw", "k"], ALPHA_FRAME, ALPHA_RUN), "size", "draw")


_PLACE = "CAST('0x' || md5(CAST(draw AS VARCHAR) || ':' || CAST({0} AS VARCHAR))[1:13] AS BIGINT)"
_CONCEPTS = "SELECT r_id, unnest(['near ' || r_id % 13, 'far ' || r_id % 57, 'odd ' || r_id // 20]) AS concept FROM ps"


@query(f"""
WITH {_PARTS}, dr AS (SELECT unnest(range({DRAWS})) AS draw), pt AS (SELECT draw, r_id, {_PLACE.format("r_id")} AS place FROM ps, dr),
pl AS (SELECT draw, r_id, place, row_number() OVER (PARTITION BY draw ORDER BY place) AS i, count(*) OVER (PARTITION BY draw) AS c FROM pt),
th AS (SELECT share, draw, place AS threshold FROM pl, (SELECT CAST(unnest({SHARES}) AS DOUBLE) AS share) WHERE i = round_even(share * c, 0) AND (share < 1 OR draw = 0)),
f AS (SELECT draw, concept, min(place) AS first FROM ({_CONCEPTS}) JOIN pt USING (r_id) GROUP BY draw, concept),
cov AS (SELECT share, draw, avg(CASE WHEN first <= threshold THEN 1 ELSE 0 END) AS coverage FROM f JOIN th USING (draw) GROUP BY share, draw),
b AS (SELECT share, draw, source, run, id, test, "window", d, row_number() OVER (PARTITION BY share, draw, source, id ORDER BY d, pairs.r_id) AS n FROM pairs JOIN pl USING (r_id) JOIN th USING (draw) WHERE place <= threshold),
{_SCORED.format(keys="share, draw")}, {_EVALUATED.format(keys="share, draw, k")}
SELECT share, CAST(draw AS INT) AS draw, round(coverage, 6) AS coverage, {_RESULT} FROM o JOIN wr USING (share, draw, k, source) JOIN cov USING (share, draw)
""")
def p10_whole_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole protocol for random shares of the pool's points, with the share of the pool's concepts that they hold."""
    q, pool = _sides(spark, sf_dir)
    thresholds = sweeps._kept(sweeps.share_draws(pool.select("r_id"), SHARES, DRAWS), "shares")
    i = F.col("r_id")
    words = F.array(F.concat(F.lit("near "), i % 13), F.concat(F.lit("far "), i % 57), F.concat(F.lit("odd "), F.expr("r_id div 20")))
    cover = sweeps.coverage(pool.select("r_id", F.explode(words).alias("concept")), thresholds)
    near = sweeps.nearest_of_shares(q, pool, KEYS, thresholds, max(KS))
    found = sweeps.evaluated(sweeps.mean_scores(near, KS).drop("tick", "id"), ["share", "draw", "k"], ALPHA_FRAME, ALPHA_RUN)
    return _shown(found.join(cover.select("share", "draw", r6("coverage").alias("coverage")), ["share", "draw"]), "share", "draw", "coverage")


_ROC = f"""
WITH {_PARTS}, b AS (SELECT source, run, id, test, "window", d, row_number() OVER (PARTITION BY source, id ORDER BY d, r_id) AS n FROM pairs),
s AS (SELECT k, source, run, test, "window", round(avg(d), 8) AS score FROM b JOIN (VALUES (1), (3), (5), (10)) ks(k) ON n <= k GROUP BY k, source, run, id, test, "window"),
l AS (SELECT k, run, score, row_number() OVER (PARTITION BY k, run ORDER BY score) AS i, count(*) OVER (PARTITION BY k, run) AS c FROM s WHERE NOT test),
q AS (SELECT k, p, score AS q FROM l, (SELECT unnest(range(201)) * 0.5::DOUBLE AS p) WHERE i = ceil(p / 100 * (c - 1)) + 1),
t AS (SELECT k, p, q, row_number() OVER (PARTITION BY k, p ORDER BY q) AS i, count(*) OVER (PARTITION BY k, p) AS c FROM q),
tp AS (SELECT k, p, q AS tau FROM t WHERE i = least(ceil((c + 1) * (1 - 0.05::DOUBLE)), c)),
pk AS (SELECT k, source, max(score) AS v FROM s WHERE test AND "window" >= 0 GROUP BY k, source, run, "window"),
e AS (SELECT k, source, 1e-9::DOUBLE * greatest(1, max(abs(v))) AS eps, max(v) AS hi, min(v) AS least FROM pk GROUP BY k, source),
c AS (SELECT k, source, tau, p FROM tp JOIN e USING (k) UNION SELECT k, source, v, NULL FROM pk UNION SELECT k, source, v - eps, NULL FROM pk JOIN e USING (k, source)),
up AS (SELECT c.k, c.source, tau, p, avg(CASE WHEN v > tau THEN 1 ELSE 0 END) AS tpr FROM c JOIN pk ON c.k = pk.k AND c.source = pk.source GROUP BY c.k, c.source, tau, p),
fp AS (SELECT c.k, c.source, tau, p, avg(CASE WHEN score > tau THEN 1 ELSE 0 END) AS fpr FROM c JOIN s ON c.k = s.k AND c.source = s.source WHERE test AND "window" < 0 GROUP BY c.k, c.source, tau, p),
r AS (SELECT up.*, fpr FROM up JOIN fp ON up.k = fp.k AND up.source = fp.source AND up.tau = fp.tau AND up.p IS NOT DISTINCT FROM fp.p),
lo AS (SELECT k, source, coalesce(max(p) FILTER (p <= 75 AND tpr = 1), 0) AS p_lo FROM r GROUP BY k, source),
en AS (SELECT k, source, p_lo, hi, least(tau, least - eps) AS lo FROM e JOIN lo USING (k, source) JOIN tp USING (k) WHERE p = p_lo),
pt AS (SELECT k, source, tau, p, tpr, fpr, p_lo FROM r JOIN en USING (k, source) WHERE tau BETWEEN lo AND hi AND (p IS NULL OR p >= p_lo))"""


def _roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, pool = _sides(spark, sf_dir)
    everything = spark.createDataFrame([(0, r) for r in POOL_RUNS], "draw int, member int")
    near = sweeps.nearest_of_draws(sweeps.PairTable.store(q, pool, KEYS, LISTED), q, pool, everything, max(KS))
    return sweeps.roc_points(sweeps.mean_scores(near, KS, digits=8), ["k"], ALPHA_RUN)


@query(f"{_ROC} SELECT CAST(k AS INT) AS k, source, round(tau, 6) AS tau, p, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round((tpr + 1 - fpr) / 2, 6) AS accuracy FROM pt")
def p11_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each threshold of the nested quantiles detects, and the windows' peaks (p null) beyond them."""
    return _roc_points(spark, sf_dir).select("k", "source", r6("tau").alias("tau"), "p", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"), r6("accuracy").alias("accuracy"))


@query(f"""{_ROC}, x AS (SELECT DISTINCT k, source, p_lo, tau, tpr, fpr FROM pt UNION ALL SELECT k, source, p_lo, 1e300, 0, 0 FROM en UNION ALL SELECT k, source, p_lo, -1e300, 1, 1 FROM en),
g AS (SELECT k, source, p_lo, tpr, fpr, lag(tpr) OVER w AS y, lag(fpr) OVER w AS x FROM x WINDOW w AS (PARTITION BY k, source ORDER BY tau DESC))
SELECT CAST(k AS INT) AS k, source, CAST(p_lo AS DOUBLE) AS p_lo, round(sum((fpr - x) * (tpr + y) / 2), 6) AS auroc FROM g GROUP BY k, source, p_lo
""")
def p11_roc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed area under each series' curve."""
    return sweeps.roc_area(_roc_points(spark, sf_dir), ["k", "source"]).select("k", "source", "p_lo", r6("auroc").alias("auroc"))
