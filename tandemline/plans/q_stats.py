"""Correlation, effect-size and small-sample queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import u_sql
from ..operators import stats as S
from .catalog import query
from .fixtures import Tables
from .q_matching import r6

LINES = "l AS (SELECT l_returnflag AS grp, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, l_discount::DOUBLE AS z FROM lineitem)"
RUNS = "ru AS (SELECT arm, seed, coalesce(2 * sum(tp) / nullif(sum(tp) + sum(fp) + sum(n_gt), 0), 0)::DOUBLE AS f1 FROM counts GROUP BY 1, 2)"
DIFFS = f"{RUNS}, di AS (SELECT seed, max(f1) FILTER (arm = 'O') - max(f1) FILTER (arm = 'F') AS d FROM ru GROUP BY 1)"


def lines(t: Tables):
    c = lambda a, b: F.col(a).cast("double").alias(b)
    return t.table("lineitem").select(F.col("l_returnflag").alias("grp"), c("l_quantity", "x"), c("l_extendedprice", "y"), c("l_discount", "z"))


def runs(t: Tables):
    g = t.counts.groupBy("arm", "seed").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "n_gt")])
    den = F.expr("tp + fp + n_gt")
    return g.select("arm", "seed", F.when(den > 0, 2 * F.col("tp") / den).otherwise(0.0).alias("f1"))


def diffs(t: Tables):
    side = lambda a: F.max(F.when(F.col("arm") == a, F.col("f1")))
    return runs(t).groupBy("seed").agg((side("O") - side("F")).alias("d"))


@query(
    "f01_corr_report", "",
    f"""WITH {LINES}, r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2 AS rx,
 rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2 AS ry FROM l)
 SELECT grp, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept,
 round(regr_slope(ln(y), ln(x)) FILTER (x > 0 AND y > 0), 6) AS log_slope FROM r GROUP BY grp""",
)
def f01(t: Tables):
    r = S.corr_report(lines(t), ["grp"], "x", "y")
    return r6(r, "pearson", "spearman", "log_slope").withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 2)})


@query(
    "f01_partial_corr", "",
    f"WITH {LINES}, c AS (SELECT grp, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM l GROUP BY 1) SELECT grp, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c",
)
def f01_partial(t: Tables):
    return r6(S.partial_corr(lines(t), ["grp"], "x", "y", "z"), "partial")


@query(
    "f02_cohens_d", "",
    """WITH l AS (SELECT l_returnflag AS grp, l_linestatus = 'O' AS g, l_quantity::DOUBLE AS quantity, l_tax::DOUBLE AS tax FROM lineitem), x AS (SELECT grp, g, 'quantity' AS feature, quantity AS v FROM l UNION ALL SELECT grp, g, 'tax', tax FROM l),
 s AS (SELECT grp, feature, count(v) FILTER (g) AS na, count(v) FILTER (NOT g) AS nb, avg(v) FILTER (g) AS ma, avg(v) FILTER (NOT g) AS mb, var_samp(v) FILTER (g) AS va, var_samp(v) FILTER (NOT g) AS vb FROM x GROUP BY 1, 2)
 SELECT grp, feature, na AS n_a, nb AS n_b, CASE WHEN na > 1 AND nb > 1 THEN round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) END AS d FROM s""",
)
def f02(t: Tables):
    li = t.table("lineitem").select(F.col("l_returnflag").alias("grp"), "l_linestatus", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return r6(S.cohens_d(li, ["grp"], F.col("l_linestatus") == "O", ["quantity", "tax"]), "d")


@query(
    "f05_sign_test", "counts",
    f"WITH {DIFFS}, s AS (SELECT count(*) AS n, count(*) FILTER (d < 0) AS n_neg FROM di) SELECT n, n_neg, round((SELECT sum(factorial(n::INT)::DOUBLE / factorial(k::INT) / factorial((n - k)::INT)) FROM range(0, 8) r(k) WHERE k BETWEEN n_neg AND n) / pow(2, n), 6) AS p FROM s",
)
def f05(t: Tables):
    return r6(S.sign_test(diffs(t), [], "d"), "p")


@query(
    "f06_variance_ratio_perm", "counts",
    f"""WITH {RUNS}, o AS (SELECT count(*) FILTER (arm = 'F') AS na, var_samp(f1) FILTER (arm = 'O') / var_samp(f1) FILTER (arm = 'F') AS obs FROM ru),
 r AS (SELECT b, f1, row_number() OVER (PARTITION BY b ORDER BY {u_sql(81, 'b', 'arm', 'seed')}, arm, seed) AS rn FROM ru, range(500) x(b)),
 f AS (SELECT b, obs, var_samp(f1) FILTER (rn > na) / greatest(var_samp(f1) FILTER (rn <= na), 1e-12) AS f FROM r, o GROUP BY b, obs)
 SELECT round(obs, 6) AS obs, round((count(*) FILTER (f >= obs * (1 - 1e-12)) + 1) / 501, 6) AS p FROM f GROUP BY obs""",
)
def f06(t: Tables):
    return r6(S.variance_ratio_perm(runs(t), "f1", F.col("arm") == "O", ["arm", "seed"], 500, 81), "obs", "p")


@query(
    "f07_sd_ci", "counts",
    f"""WITH {RUNS}, s AS (SELECT arm, count(*) AS n, avg(f1) AS mean, stddev_samp(f1) AS sd, count(*) - 1 AS k FROM ru GROUP BY 1), q AS (SELECT *, 1.959963984540054::DOUBLE * sqrt(2 / (9 * k)) AS w, 1 - 2 / (9 * k) AS c FROM s)
 SELECT arm, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd * sqrt(k / (k * pow(c + w, 3))), 6) AS sd_lo, round(sd * sqrt(k / (k * pow(c - w, 3))), 6) AS sd_hi,
 round(mean - 2.447::DOUBLE * sd * sqrt(1 + 1 / n), 6) AS new_lo, round(mean + 2.447::DOUBLE * sd * sqrt(1 + 1 / n), 6) AS new_hi FROM q""",
)
def f07(t: Tables):
    return r6(S.sd_ci(runs(t), ["arm"], "f1"), "mean", "sd", "sd_lo", "sd_hi", "new_lo", "new_hi")


@query(
    "f07_f_ratio", "counts",
    f"""WITH {RUNS}, s AS (SELECT count(*) FILTER (arm = 'F') AS n_first, count(*) FILTER (arm = 'O') AS n_second, var_samp(f1) FILTER (arm = 'F') AS va, var_samp(f1) FILTER (arm = 'O') AS vb FROM ru),
 x AS (SELECT *, vb / va AS f, vb / (vb + va) AS x FROM s), q AS (SELECT *, (SELECT sum(factorial(5)::DOUBLE / factorial(j::INT) / factorial((5 - j)::INT) * pow(x, j) * pow(1 - x, 5 - j)) FROM range(3, 6) r(j)) AS q FROM x)
 SELECT n_first, n_second, round(va, 8) AS var_first, round(vb, 8) AS var_second, round(f, 6) AS f, round(2 * least(q, 1 - q), 6) AS p FROM q""",
)
def f07_f_ratio(t: Tables):
    """Seven runs in each arm: six degrees of freedom, where the tail is a binomial sum."""
    d = S.f_ratio(runs(t), [], "f1", F.col("arm") == "O")
    return r6(d, "f", "p").withColumns({c: F.round(c, 8) for c in ("var_first", "var_second")})


@query(
    "f07_fisher_combined", "",
    """WITH p AS (SELECT l_suppkey AS grp, exp(-l_tax::DOUBLE - 0.001) AS p FROM lineitem), g AS (SELECT grp, count(*) AS k, -sum(ln(p)) AS h FROM p GROUP BY 1)
 SELECT grp, k, round(2 * h, 6) AS chi2, round((SELECT sum(exp(i * ln(h) - h - lgamma(i + 1))) FROM range(0, 5000) r(i) WHERE i < k), 6) AS p FROM g""",
)
def f07_fisher(t: Tables):
    p = t.table("lineitem").select(F.col("l_suppkey").alias("grp"), F.exp(-F.col("l_tax").cast("double") - 0.001).alias("p"))
    return r6(S.fisher_combined(p, ["grp"], "p"), "chi2", "p")


@query(
    "f35_zscore", "",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS grp, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem),
 a AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM l),
 g AS (SELECT grp, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM l GROUP BY 1)
 SELECT l_orderkey, l_linenumber, round((x - a.mx) / CASE a.sx WHEN 0 THEN 1 ELSE a.sx END, 6) AS x_z, round((y - a.my) / CASE a.sy WHEN 0 THEN 1 ELSE a.sy END, 6) AS y_z,
  round((x - g.mx) / CASE g.sx WHEN 0 THEN 1 ELSE g.sx END, 6) AS x_zk, round((y - g.my) / CASE g.sy WHEN 0 THEN 1 ELSE g.sy END, 6) AS y_zk
 FROM l JOIN g ON l.grp = g.grp CROSS JOIN a""",
)
def f35(t: Tables):
    li = t.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("grp"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    z = ["x_z", "y_z", "x_zk", "y_zk"]
    return r6(S.zscore(li, ["x", "y"], ["grp"]), *z).select("l_orderkey", "l_linenumber", *z)


@query(
    "f37_ari", "",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
 pa AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM c GROUP BY a)), pb AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM c GROUP BY b)),
 t AS (SELECT sum(n * (n - 1) / 2) AS p, sum(n) AS n FROM c)
 SELECT t.n::BIGINT AS n, round((t.p - pa.p * pb.p / (t.n * (t.n - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (t.n * (t.n - 1) / 2)), 6) AS ari FROM t, pa, pb""",
)
def f37(t: Tables):
    return r6(S.ari(t.table("lineitem"), "l_returnflag", "l_linestatus"), "ari")


@query(
    "g07_prevalence_diff", "wide",
    """WITH c AS (SELECT session % 2 AS pool, session, count(*) AS n, count(*) FILTER (n_gt > 0) AS y FROM wide GROUP BY 1, 2),
 p AS (SELECT pool, sum(y) / sum(n) AS p FROM c GROUP BY 1),
 v AS (SELECT c.pool, any_value(p) AS p, count(*) AS k, count(*) / (count(*) - 1) * sum((y - p * n) ** 2) / sum(n) ** 2 AS var FROM c JOIN p ON c.pool = p.pool GROUP BY 1)
 SELECT round(a.p, 6) AS p0, round(b.p, 6) AS p1, a.k AS k0, b.k AS k1, round(b.p - a.p, 6) AS diff, round(sqrt(a.var + b.var), 6) AS se, round((b.p - a.p) / sqrt(a.var + b.var), 6) AS t
 FROM v a, v b WHERE a.pool = 0 AND b.pool = 1""",
)
def g07(t: Tables):
    found = S.prevalence_diff(t.wide.withColumn("pool", F.col("session") % 2), "pool", "session", F.col("n_gt") > 0)
    return r6(found, "p0", "p1", "diff", "se", "t")
