"""Statistics and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import u_sql
from ..operators import agreement as A, matching as M, resample as R
from .catalog import query
from .fixtures import ARMS, SEEDS, Tables
from .q_intervals import R6
from .q_matching import F1, r6

CATS = ["silent", "backchannel", "take_floor"]
COLS = R.cells(ARMS, SEEDS)
SUMS = ", ".join(f"sum(w * {c}) AS {c}" for c in COLS)
PLAIN = ", ".join(f"sum({c}) AS {c}" for c in COLS)
F1_SQL = lambda a, k: f"coalesce(2 * tp_{a}{k} / nullif(tp_{a}{k} + fp_{a}{k} + n_gt, 0), 0)"
DELTA_SQL = "(" + " + ".join(f"({F1_SQL('O', k)} - {F1_SQL('F', k)})" for k in SEEDS) + f") / {len(SEEDS)}"
IDX = lambda key, src: f"ix AS (SELECT *, row_number() OVER (ORDER BY {u_sql('idx', key)}, {key}) - 1 AS idx FROM {src})"
DRAW = lambda reps, seed, slots: f"dr AS (SELECT b, CAST(floor({u_sql(seed, 'b', 'slot')} * n) AS BIGINT) AS idx, count(*) AS w FROM range({reps}) x(b), (SELECT count(*) AS n FROM ix) z, range({slots}) s(slot) GROUP BY 1, 2)"
SESS = f"se AS (SELECT session, {PLAIN} FROM wide GROUP BY 1)"
DS = f"ds AS (SELECT seed, {F1('FILTER (arm = $$O$$)')} - {F1('FILTER (arm = $$F$$)')} AS d FROM counts GROUP BY 1)".replace("$$", "'")


def deltas(t: Tables):
    return M.delta_f1(t.counts, ARMS, len(ARMS) * len(SEEDS))


@query("f03_paired_t", "counts", f"WITH {DS} SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM ds")
def f03(t: Tables):
    se = F.stddev_samp("delta") / F.sqrt(F.count(F.lit(1)))
    return deltas(t).agg(F.count(F.lit(1)).alias("n"), R6(F.avg("delta")).alias("mean"), R6(se).alias("se"), F.round(F.avg("delta") / se, 4).alias("t"))


@query(
    "f04_signflip_test", "counts",
    f"WITH {DS}, m AS (SELECT m, avg(CASE WHEN (m >> seed) & 1 = 1 THEN d ELSE -d END) AS s FROM ds, range(128) r(m) GROUP BY 1), o AS (SELECT avg(d) AS o FROM ds) SELECT round(o, 6) AS observed, round(avg(CASE WHEN abs(s) >= abs(o) - 1e-12 THEN 1.0 ELSE 0 END), 6) AS p, count(*) AS n_perm FROM m, o GROUP BY o",
)
def f04(t: Tables):
    return r6(R.signflip_test(deltas(t), "seed", "delta", len(SEEDS)), "observed", "p")


@query(
    "f08_boot_chunks", "wide",
    f"WITH {IDX('chunk', 'wide')}, {DRAW(20, 1, '(SELECT count(*) FROM ix)')}, s AS (SELECT b, {SUMS} FROM dr JOIN ix USING (idx) GROUP BY 1) SELECT b, round({DELTA_SQL}, 6) AS delta FROM s".replace("range((SELECT count(*) FROM ix))", "(SELECT idx AS slot FROM ix)"),
)
def f08(t: Tables):
    return r6(R.boot_chunks(t.wide, ARMS, SEEDS, 20, 1), "delta")


@query(
    "f09_boot_size", "wide",
    f"WITH {IDX('chunk', 'wide')}, {DRAW(20, 2, '1000')}, s AS (SELECT b, {SUMS} FROM dr JOIN ix USING (idx) GROUP BY 1), d AS (SELECT {DELTA_SQL} AS delta FROM s) SELECT 1000 AS k, round(stddev_samp(delta), 6) AS se FROM d",
)
def f09(t: Tables):
    return R.boot_chunks(t.wide, ARMS, SEEDS, 20, 2, slots=1000).agg(F.lit(1000).cast("long").alias("k"), R6(F.stddev_samp("delta")).alias("se"))


@query(
    "f11_boot_cluster", "wide",
    f"WITH {SESS}, {IDX('session', 'se')}, {DRAW(40, 3, 'N')}, s AS (SELECT b, {SUMS} FROM dr JOIN ix USING (idx) GROUP BY 1), d AS (SELECT {DELTA_SQL} AS delta FROM s) SELECT count(*) AS reps, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS se, round(quantile_cont(delta, 0.025), 6) AS lo, round(quantile_cont(delta, 0.975), 6) AS hi, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0 END), 6) AS p_pos FROM d".replace("range(N) s(slot)", "(SELECT idx AS slot FROM ix) s"),
)
def f11(t: Tables):
    return r6(R.summarise(R.boot_cluster(t.wide, ARMS, SEEDS, 40, 3)), "mean", "se", "lo", "hi", "p_pos")


@query(
    "f13_boot_nested", "wide",
    f"""WITH sz AS (SELECT session, count(*) AS n FROM wide GROUP BY 1), si AS (SELECT *, row_number() OVER (ORDER BY {u_sql('idx', 'session')}, session) - 1 AS sidx FROM sz), po AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {u_sql('pos', 'chunk')}, chunk) AS pos FROM wide),
 cp AS (SELECT b, sidx AS copy, CAST(floor({u_sql(5, 'b', 'sidx')} * (SELECT count(*) FROM sz)) AS BIGINT) AS pick FROM range(10) x(b), si), sl AS (SELECT b, copy, session, n, unnest(range(1, n + 1)) AS slot FROM cp JOIN si ON si.sidx = cp.pick),
 w AS (SELECT b, session, CAST(floor({u_sql(5, 'b', 'copy', 'slot')} * n) AS BIGINT) + 1 AS pos, count(*) AS w FROM sl GROUP BY 1, 2, 3), s AS (SELECT b, {SUMS} FROM w JOIN po USING (session, pos) GROUP BY 1) SELECT b, round({DELTA_SQL}, 6) AS delta FROM s""",
)
def f13(t: Tables):
    return r6(R.boot_nested(t.wide, ARMS, SEEDS, 10, 5), "delta")


@query(
    "f16_jackknife", "wide",
    f"WITH {SESS}, tot AS (SELECT {PLAIN} FROM se), f AS (SELECT {DELTA_SQL} AS d FROM tot), lo AS (SELECT se.session, " + ", ".join(f"tot.{c} - se.{c} AS {c}" for c in COLS)
    + f" FROM se, tot) SELECT session, round({DELTA_SQL}, 6) AS loo, round((SELECT d FROM f), 6) AS \"full\", round((SELECT d FROM f) - {DELTA_SQL}, 6) AS influence FROM lo",
)
def f16(t: Tables):
    return r6(R.jackknife(t.wide, ARMS, SEEDS), "loo", "full", "influence")


@query(
    "f17_decompose_counts", "counts",
    "SELECT session, CAST(max(n_gt) = 0 AS BIGINT) AS empty_truth, CAST(sum(CASE WHEN arm = 'O' THEN tp ELSE -tp END) AS BIGINT) AS d_tp, CAST(sum(CASE WHEN arm = 'O' THEN fp ELSE -fp END) AS BIGINT) AS d_fp FROM counts GROUP BY 1",
)
def f17(t: Tables):
    diff = lambda c: F.sum(F.when(F.col("arm") == "O", F.col(c)).otherwise(-F.col(c)))
    return t.counts.groupBy("session").agg((F.max("n_gt") == 0).cast("long").alias("empty_truth"), diff("tp").alias("d_tp"), diff("fp").alias("d_fp"))


@query(
    "f18_variance_components", "counts",
    f"""WITH x AS (SELECT session % 10 AS batch, seed, {F1("FILTER (arm = 'O')")} - {F1("FILTER (arm = 'F')")} AS v FROM counts GROUP BY 1, 2), y AS (SELECT v, avg(v) OVER (PARTITION BY batch) AS rm, avg(v) OVER (PARTITION BY seed) AS cm, avg(v) OVER () AS g FROM x),
 q AS (SELECT sum(pow(rm - g, 2)) AS r, sum(pow(cm - g, 2)) AS c, sum(pow(v - rm - cm + g, 2)) / 54 AS e FROM y) SELECT round((r / 9 - e) / 7, 8) AS var_row, round((c / 6 - e) / 10, 8) AS var_col, round(e, 8) AS var_res FROM q""",
)
def f18(t: Tables):
    w = t.counts.groupBy((F.col("session") % 10).alias("batch"), "seed").pivot("arm", ARMS).agg(M.f1_of(F.sum("tp"), F.sum("fp"), F.sum("n_gt")))
    v = R.variance_components(w.select("batch", "seed", (F.col("O") - F.col("F")).alias("v")), "batch", "seed", "v")
    return v.select(*[F.round(c, 8).alias(c) for c in v.columns])


KAPPA = lambda keep, tail: f"""WITH g AS (SELECT {keep} count(*) AS n_slots, sum(m) AS n_votes, avg((silent * silent + backchannel * backchannel + take_floor * take_floor - m) / (m * (m - 1))) AS p_bar, sum(silent) AS a, sum(backchannel) AS b, sum(take_floor) AS c FROM slots WHERE m >= 2 {tail}),
 e AS (SELECT *, (a * a + b * b + c * c) / (n_votes * n_votes) AS p_e FROM g)"""
KCOLS = "n_slots, CAST(n_votes AS BIGINT) AS n_votes, round(p_bar, 6) AS p_bar, round(p_e, 6) AS p_e, round((p_bar - p_e) / (1 - p_e), 6) AS kappa, round((p_bar - (1 - p_e) / 2) / (1 - (1 - p_e) / 2), 6) AS ac1"


@query("f27_fleiss_kappa", "slots", KAPPA("", "") + f" SELECT {KCOLS} FROM e")
def f27(t: Tables):
    return r6(A.fleiss_and_ac1(t.slots, CATS), "p_bar", "p_e", "kappa", "ac1")


@query("f28_gwet_ac1", "slots", KAPPA("scenario,", "GROUP BY scenario") + f" SELECT scenario, {KCOLS} FROM e")
def f28(t: Tables):
    return r6(A.fleiss_and_ac1(t.slots, CATS, ["scenario"]), "p_bar", "p_e", "kappa", "ac1")


@query(
    "f29_agreement_report", "slots",
    KAPPA("coalesce(split, 'all') AS split, coalesce(scenario, 'all') AS scenario,", "GROUP BY GROUPING SETS ((), (split), (scenario), (split, scenario))") + f" SELECT split, scenario, {KCOLS} FROM e",
)
def f29(t: Tables):
    s = t.slots.filter("m >= 2").withColumn("pi", F.expr("(silent * silent + backchannel * backchannel + take_floor * take_floor - m) / (m * (m - 1))"))
    g = s.groupingSets([[], ["split"], ["scenario"], ["split", "scenario"]], "split", "scenario").agg(
        F.count(F.lit(1)).alias("n_slots"), F.sum("m").alias("n_votes"), F.avg("pi").alias("p_bar"), *[F.sum(c).alias(f"__{c}") for c in CATS]
    )
    g = g.withColumn("split", F.coalesce("split", F.lit("all"))).withColumn("scenario", F.coalesce("scenario", F.lit("all")))
    return r6(A.kappa_columns(g, CATS, ["split", "scenario"]), "p_bar", "p_e", "kappa", "ac1")


@query(
    "f30_vote_structure", "slots",
    "SELECT CASE WHEN greatest(silent, backchannel, take_floor) = m THEN 'unanimous' WHEN 2 * greatest(silent, backchannel, take_floor) > m THEN 'majority' ELSE 'none' END AS structure, count(*) AS n FROM slots WHERE m >= 2 GROUP BY 1",
)
def f30(t: Tables):
    top = F.greatest(*CATS)
    kind = F.when(top == F.col("m"), "unanimous").when(2 * top > F.col("m"), "majority").otherwise("none")
    return t.slots.filter("m >= 2").groupBy(kind.alias("structure")).agg(F.count(F.lit(1)).alias("n"))


@query("f31_dispersion", "slots", "WITH p AS (SELECT sum(backchannel) / sum(m) AS p FROM slots) SELECT count(*) AS n, round(avg(pow(backchannel - m * p, 2) / (m * p * (1 - p))), 6) AS s FROM slots, p")
def f31(t: Tables):
    p = t.slots.agg((F.sum("backchannel") / F.sum("m")).alias("p"))  # one row
    z2 = F.pow(F.col("backchannel") - F.col("m") * F.col("p"), 2) / (F.col("m") * F.col("p") * (1 - F.col("p")))
    return t.slots.crossJoin(F.broadcast(p)).agg(F.count(F.lit(1)).alias("n"), R6(F.avg(z2)).alias("s"))


@query(
    "f33_kl_baselines", "slots",
    """WITH q AS (SELECT 'uniform' AS model, 1 / 3.0::DOUBLE AS a, 1 / 3.0::DOUBLE AS b, 1 / 3.0::DOUBLE AS c UNION ALL SELECT split || '_marginal', sum(silent) / sum(m), sum(backchannel) / sum(m), sum(take_floor) / sum(m) FROM slots GROUP BY split UNION ALL SELECT 'global_marginal', sum(silent) / sum(m), sum(backchannel) / sum(m), sum(take_floor) / sum(m) FROM slots),
 k AS (SELECT model, scenario, CASE WHEN silent > 0 THEN silent / m * ln(silent / m / a) ELSE 0 END + CASE WHEN backchannel > 0 THEN backchannel / m * ln(backchannel / m / b) ELSE 0 END + CASE WHEN take_floor > 0 THEN take_floor / m * ln(take_floor / m / c) ELSE 0 END AS kl FROM slots, q WHERE split = 'test')
 SELECT model, round(avg(x), 6) AS mean_kl FROM (SELECT model, scenario, avg(kl) AS x FROM k GROUP BY 1, 2) GROUP BY 1""",
)
def f33(t: Tables):
    return r6(kl_baselines(t.slots, CATS), "mean_kl")


def kl_baselines(slots, cats):
    """KL(votes || constant model) per test slot, mean per scenario, then over scenarios; 0 log 0 is 0."""
    marg = lambda d, name: d.agg(*[(F.sum(c) / F.sum("m")).alias(f"q_{c}") for c in cats]).withColumn("model", name)
    models = marg(slots.groupBy("split"), F.concat("split", F.lit("_marginal"))).drop("split").unionByName(marg(slots, F.lit("global_marginal")))
    uni = marg(slots, F.lit("uniform")).select(*[F.lit(1 / len(cats)).alias(f"q_{c}") for c in cats], "model")
    x = slots.filter("split = 'test'").crossJoin(F.broadcast(models.unionByName(uni)))  # four model rows
    h = lambda c: F.col(c) / F.col("m")
    terms = [F.when(F.col(c) > 0, h(c) * F.log(h(c) / F.greatest(F.col(f"q_{c}"), F.lit(1e-12)))).otherwise(0.0) for c in cats]
    return x.groupBy("model", "scenario").agg(F.avg(sum(terms[1:], terms[0])).alias("x")).groupBy("model").agg(F.avg("x").alias("mean_kl"))
