"""Queries on batches of chunks and on the spread of repeated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import u, u_sql
from ..operators import batches as B
from ..operators.resample import delta_of
from ..operators.scan import sized_rank
from .catalog import query
from .fixtures import ARMS, SEEDS, Tables
from .q_levels import EVEN, FOLD, MULT, even
from .q_matching import r6
from .q_resample import COLS, DELTA_SQL, PLAIN, SUMS
from .q_stats import runs

_POS = "(n_gt > 0)::INT"


@query(
    "f38_balanced_draw", "vec",
    f"""WITH un AS (SELECT unit, row_number() OVER (ORDER BY {u_sql('idx', 'unit')}, unit) - 1 AS idx FROM (SELECT DISTINCT unit FROM vec)), {MULT('dr', 20, 38, '(SELECT count(*) FROM un)')},
 cp AS (SELECT b, cls, vec_id, unnest(range(1, w + 1)) AS copy FROM dr JOIN un USING (idx) JOIN vec USING (unit)), rk AS (SELECT *, row_number() OVER (PARTITION BY b, cls ORDER BY {u_sql('38c', 'b', 'vec_id', 'copy')}, vec_id, copy) AS k FROM cp)
 SELECT b, cls, vec_id, count(*) AS w FROM rk WHERE k <= 60 GROUP BY 1, 2, 3""",
)
def f38(t: Tables):
    return B.balanced_draw(t.vec, "unit", "cls", "vec_id", 60, 20, 38)


@query(
    "f24_boot_reweighted", "wide",
    f"""WITH po AS (SELECT *, {_POS} AS pos, row_number() OVER (PARTITION BY n_gt > 0 ORDER BY {u_sql('idx', 'chunk')}, chunk) AS idx FROM wide), sz AS (SELECT pos, count(*) AS n FROM po GROUP BY 1),
 sl AS (SELECT b, slot, ({u_sql('24p', 'b', 'slot')} < 0.25)::INT AS pos, {u_sql(24, 'b', 'slot')} AS uu FROM range(20) x(b), range(1000) y(slot)), dr AS (SELECT b, pos, CAST(floor(uu * n) AS BIGINT) + 1 AS idx, count(*) AS w FROM sl JOIN sz USING (pos) GROUP BY 1, 2, 3),
 s AS (SELECT b, sum(w * pos) / 1000 AS prevalence, {SUMS} FROM dr JOIN po USING (pos, idx) GROUP BY 1) SELECT b, round(prevalence, 6) AS prevalence, round({DELTA_SQL}, 6) AS delta FROM s""",
)
def f24(t: Tables):
    return r6(B.boot_reweighted(t.wide, F.col("n_gt") > 0, 0.25, 1000, ARMS, SEEDS, 20, 24), "prevalence", "delta")


@query(
    "f44_batch_percentile", "wide",
    f"""WITH ne AS (SELECT *, {_POS} AS pos FROM wide WHERE session % 20 = 0), ol AS (SELECT *, {_POS} AS pos FROM wide WHERE session % 20 <> 0), c AS (SELECT count(*) AS k, sum(pos) AS q, (SELECT count(*) FROM ol) AS n FROM ne),
 rk AS (SELECT b, ol.*, row_number() OVER (PARTITION BY b, pos ORDER BY {u_sql(44, 'b', 'chunk')}, chunk) AS rn FROM ol, range(10) x(b)), su AS (SELECT rk.* EXCLUDE (rn) FROM rk, c WHERE rn <= CASE pos WHEN 1 THEN q ELSE k - q END UNION ALL SELECT -1 AS b, * FROM ne),
 ps AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY {u_sql(44, 'b', 'chunk')}, chunk) - 1 AS idx FROM su), ds AS (SELECT b, {PLAIN} FROM su GROUP BY 1), {MULT('dr', 10, '44w', '(SELECT k FROM c)').replace('SELECT b,', 'SELECT b AS r,')},
 bs AS (SELECT b, r, {SUMS} FROM ps JOIN dr USING (idx) GROUP BY 1, 2), lo AS (SELECT b, 'delta' AS measure, {DELTA_SQL} AS v FROM ds UNION ALL SELECT b, 'se', stddev_samp(d) FROM (SELECT b, r, {DELTA_SQL} AS d FROM bs) GROUP BY b),
 g AS (SELECT l.measure, o.v AS observed, count(*) AS draws, avg(l.v) AS mean, stddev_samp(l.v) AS sd, quantile_cont(l.v, 0.025) AS lo, quantile_cont(l.v, 0.975) AS hi, 100 * avg((l.v < o.v)::INT) AS percentile FROM lo l JOIN lo o ON o.measure = l.measure AND o.b = -1 WHERE l.b >= 0 GROUP BY 1, 2)
 SELECT measure, round(observed, 6) AS observed, draws, round(mean, 6) AS mean, round(sd, 6) AS sd, round(lo, 6) AS lo, round(hi, 6) AS hi, round(percentile, 6) AS percentile, round(sd * sqrt((n - 1) / (n - k)), 6) AS sd_fresh, round((observed - mean) / (sd * sqrt((n - 1) / (n - k))), 4) AS z FROM g, c""",
)
def f44(t: Tables):
    new = F.col("session") % 20 == 0
    d = B.batch_percentile(t.wide.filter(~new), t.wide.filter(new), F.col("n_gt") > 0, ARMS, SEEDS, 10, 10, 44)
    return r6(d, "observed", "mean", "sd", "lo", "hi", "percentile", "sd_fresh").withColumn("z", F.round("z", 4))


@query(
    "f20_order_effect", "wide",
    f"""WITH {FOLD}, {EVEN}, rs AS (SELECT rn - 1 AS i, {PLAIN} FROM ev GROUP BY 1), x AS (SELECT i, {DELTA_SQL} AS v FROM rs), y AS (SELECT b, row_number() OVER (PARTITION BY b ORDER BY {u_sql(20, 'b', 'i')}, i) - 1 AS j, v AS y FROM x, range(200) z(b) UNION ALL SELECT -1, i, v FROM x),
 r AS (SELECT b, corr(j, y) AS trend, corr(x.v, y) AS lag1 FROM y LEFT JOIN x ON x.i + 1 = y.j GROUP BY 1), o AS (SELECT trend AS r_trend, lag1 AS r_lag1 FROM r WHERE b = -1)
 SELECT (SELECT count(*) FROM x) AS n, round(r_trend, 6) AS r_trend, round(r_lag1, 6) AS r_lag1, round(avg((abs(trend) >= abs(r_trend) - 1e-12)::INT), 6) AS p_trend, round(avg((abs(lag1) >= abs(r_lag1) - 1e-12)::INT), 6) AS p_lag1 FROM r, o WHERE b >= 0 GROUP BY r_trend, r_lag1""",
)
def f20(t: Tables):
    x = even(t)
    n = x.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    r = sized_rank(x.join(n, "session").withColumn("__u", u(74, "chunk")), ["session"], "__u", ["chunk"], "n", "round")
    rounds = r.groupBy((F.col("round") - 1).alias("i")).agg(*[F.sum(c).alias(c) for c in COLS]).select("i", delta_of(ARMS, SEEDS).alias("v"))
    return r6(B.order_effect(rounds, "i", "v", 200, 20), "r_trend", "r_lag1", "p_trend", "p_lag1")


_HALF = lambda k: f"(SELECT seed * 2 + (arm = 'O')::INT AS run, coalesce(2 * sum(tp) / nullif(sum(tp) + sum(fp) + sum(n_gt), 0), 0) AS f1 FROM counts WHERE session % 2 = {k} GROUP BY arm, seed)"


@query(
    "f25_cross_set_corr", "counts",
    f"""WITH j AS (SELECT a.run, a.f1 AS x, b.f1 AS y FROM {_HALF(0)} a JOIN {_HALF(1)} b ON a.run = b.run), k AS (SELECT *, rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM j),
 o AS (SELECT count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS rho FROM k)
 SELECT l.run, n, round(any_value(r), 6) AS r, round(any_value(rho), 6) AS rho, round(corr(j.x, j.y), 6) AS loo_r, round(2.179 / sqrt(12 + 2.179 * 2.179), 6) AS r_critical FROM j l JOIN j ON j.run <> l.run, o GROUP BY l.run, n""",
)
def f25(t: Tables):
    """Runs of both arms on the even and on the odd sessions: 14 runs, 12 degrees of freedom."""
    half = lambda k: runs(_On(t.counts.filter(F.col("session") % 2 == k))).select((F.col("seed") * 2 + (F.col("arm") == "O").cast("long")).alias("run"), "f1")
    return r6(B.cross_set_corr(half(0), half(1), "run", "f1"), "r", "rho", "loo_r", "r_critical")


class _On:
    """Counts of a part, in the place of the tables."""

    def __init__(self, counts):
        self.counts = counts


_GROUPED = "gr AS (SELECT session % 2 AS grp, arm, seed, coalesce(2 * sum(tp) / nullif(sum(tp) + sum(fp) + sum(n_gt), 0), 0)::DOUBLE AS f1 FROM counts GROUP BY 1, 2, 3)"


def grouped(t: Tables):
    g = t.counts.groupBy((F.col("session") % 2).alias("grp"), "arm", "seed").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "n_gt")])
    den = F.expr("tp + fp + n_gt")
    return g.select("grp", "arm", "seed", F.when(den > 0, 2 * F.col("tp") / den).otherwise(0.0).alias("f1"))


@query(
    "f23_split_variance", "counts",
    f"""WITH {_GROUPED}, w AS (SELECT grp, seed, max(f1) FILTER (arm = 'F') AS p, max(f1) FILTER (arm = 'O') AS q FROM gr GROUP BY 1, 2), g AS (SELECT grp, count(*) AS n, var_samp(q - p) AS d, var_samp(p + q) AS s FROM w GROUP BY 1)
 SELECT a.n AS n_0, round(a.d, 8) AS var_diff_0, b.n AS n_1, round(b.d, 8) AS var_diff_1, round((a.s - a.d) / (a.s + a.d), 6) AS share_run_0, round((b.s - b.d) / (b.s + b.d), 6) AS share_run_1, round(a.d - b.d, 8) AS rest, round(b.d / a.d, 6) AS ratio FROM g a, g b WHERE a.grp = 0 AND b.grp = 1""",
)
def f23(t: Tables):
    d = B.split_variance(grouped(t), "grp", "seed", "arm", ARMS, "f1")
    return r6(d, "share_run_0", "share_run_1", "ratio").withColumns({c: F.round(c, 8) for c in ("var_diff_0", "var_diff_1", "rest")})


@query(
    "f26_replicate_noise", "counts",
    f"""WITH {_GROUPED}, g AS (SELECT arm, seed, count(*) AS k, avg(f1) AS m, var_samp(f1) AS v FROM gr GROUP BY 1, 2), s AS (SELECT count(*) AS configs, count(*) FILTER (k > 1) AS repeated, sqrt(sum(v * (k - 1)) / sum(k - 1)) AS sd_repeat, stddev_samp(m) AS sd_config FROM g)
 SELECT configs, repeated, round(sd_repeat, 6) AS sd_repeat, round(sd_config, 6) AS sd_config, round(sd_repeat / sd_config, 6) AS ratio FROM s""",
)
def f26(t: Tables):
    """A configuration is an arm and a seed; the two halves of the sessions are its repeats."""
    d = grouped(t).withColumn("config", F.concat_ws("|", "arm", F.col("seed").cast("string")))
    return r6(B.replicate_noise(d, "config", "grp", "f1"), "sd_repeat", "sd_config", "ratio")


_MEANS = "ms AS (SELECT arm, seed, seed % 3 AS node, avg(margin) AS m FROM margins GROUP BY 1, 2, 3)"


@query(
    "f47_drop_group_check", "margins",
    f"""WITH {_MEANS}, a AS (SELECT arm, count(*) AS n, stddev_samp(m) AS sd FROM ms GROUP BY 1), d AS (SELECT x.arm, x.node, x.n_node, stddev_samp(m.m) AS sdw FROM (SELECT arm, node, count(*) AS n_node FROM ms GROUP BY 1, 2) x JOIN ms m ON m.arm = x.arm AND m.node <> x.node GROUP BY 1, 2, 3)
 SELECT arm, node, n, n_node, round(sd, 6) AS sd, round(sdw, 6) AS sd_without, round(sdw / sd, 6) AS ratio FROM d JOIN a USING (arm)""",
)
def f47(t: Tables):
    m = t.margins.groupBy("arm", "seed", (F.col("seed") % 3).alias("node")).agg(F.avg("margin").alias("m"))
    return r6(B.drop_group_check(m, "arm", "node", "m"), "sd", "sd_without", "ratio")
