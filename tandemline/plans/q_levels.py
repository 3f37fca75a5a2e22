"""Multi-level resampling and vote permutation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keyed import u, u_sql
from ..operators import resample as R, sampling as G, votes as V
from .catalog import query
from .fixtures import ARMS, SEEDS, Tables
from .q_matching import r6
from .q_resample import CATS, COLS, DELTA_SQL, F1_SQL, PLAIN, SUMS

GROUPS = 40
#: Sessions of many chunks: customers are folded into groups.
FOLD = f"fo AS (SELECT * REPLACE (session % {GROUPS} AS session) FROM wide)"
EVEN = f"ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {u_sql(74, 'chunk')}, chunk) AS rn FROM fo) WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM fo GROUP BY session)))"
SEED_W = lambda seed, i: "(" + " + ".join(f"CASE WHEN floor({u_sql(f'{seed}s', 'b', str(k))} * {len(SEEDS)}) = {i} THEN 1 ELSE 0 END" for k in range(len(SEEDS))) + ")"
F1_PRE = lambda pre, a, k: f"coalesce(2 * {pre}tp_{a}{k} / nullif({pre}tp_{a}{k} + {pre}fp_{a}{k} + {pre}n_gt, 0), 0)"
WEIGHTED = lambda seed, pre="": "(" + " + ".join(f"{SEED_W(seed, i)} * ({F1_PRE(pre, 'O', k)} - {F1_PRE(pre, 'F', k)})" for i, k in enumerate(SEEDS)) + f") / {len(SEEDS)}"
MULT = lambda name, reps, seed, n: f"{name} AS (SELECT b, CAST(floor({u_sql(seed, 'b', 'slot')} * n) AS BIGINT) AS idx, count(*) AS w FROM range({reps}) x(b), (SELECT {n} AS n) z, (SELECT unnest(range({n})) AS slot) s GROUP BY 1, 2)"


def folded(t: Tables) -> DataFrame:
    return t.wide.withColumn("session", F.col("session") % GROUPS)


def even(t: Tables) -> DataFrame:
    return G.truncate_balanced(folded(t), "session", u(74, "chunk"), ["chunk"])


@query(
    "f12_boot_crossed", "wide",
    f"""WITH {FOLD}, {EVEN}, po AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY chunk) - 1 AS pos FROM ev), si AS (SELECT session, row_number() OVER (ORDER BY {u_sql('idx', 'session')}, session) - 1 AS idx FROM (SELECT DISTINCT session FROM ev)),
 {MULT('ws', 20, 12, '(SELECT count(*) FROM si)')}, {MULT('wb', 20, '12b', '(SELECT max(pos) + 1 FROM po)')}, s AS (SELECT b, {SUMS} FROM (SELECT ws.b, ws.w * wb.w AS w, po.* FROM po JOIN si USING (session) JOIN ws ON ws.idx = si.idx JOIN wb ON wb.b = ws.b AND wb.idx = po.pos) GROUP BY b) SELECT b, round({WEIGHTED(12)}, 6) AS delta FROM s""",
)
def f12(t: Tables):
    return r6(R.boot_crossed(even(t), ARMS, SEEDS, 20, 12), "delta")


NESTED = lambda seed, reps: f"""sz AS (SELECT session, count(*) AS n FROM fo GROUP BY 1), si AS (SELECT *, row_number() OVER (ORDER BY {u_sql('idx', 'session')}, session) - 1 AS sidx FROM sz), po AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {u_sql('pos', 'chunk')}, chunk) AS pos FROM fo),
 cp AS (SELECT b, sidx AS copy, CAST(floor({u_sql(seed, 'b', 'sidx')} * (SELECT count(*) FROM sz)) AS BIGINT) AS pick FROM range({reps}) x(b), si), sl AS (SELECT b, copy, session, n, unnest(range(1, n + 1)) AS slot FROM cp JOIN si ON si.sidx = cp.pick),
 w AS (SELECT b, session, CAST(floor({u_sql(seed, 'b', 'copy', 'slot')} * n) AS BIGINT) + 1 AS pos, count(*) AS w FROM sl GROUP BY 1, 2, 3)"""


@query("f13_boot_nested_levels", "wide", f"WITH {FOLD}, {NESTED(13, 20)}, s AS (SELECT b, {SUMS} FROM w JOIN po USING (session, pos) GROUP BY 1) SELECT b, round({WEIGHTED(13)}, 6) AS delta FROM s")
def f13_levels(t: Tables):
    return r6(R.boot_nested(folded(t), ARMS, SEEDS, 20, 13, ("session", "block", "seed")), "delta")


@query(
    "f10_boot_stratified", "wide",
    f"""WITH {FOLD}, sz AS (SELECT session, count(*) AS n FROM fo GROUP BY 1), po AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {u_sql('pos', 'chunk')}, chunk) AS pos FROM fo),
 w AS (SELECT b, session, CAST(floor({u_sql(10, 'b', 'session', 'slot')} * n) AS BIGINT) + 1 AS pos, count(*) AS w FROM sz, range(20) x(b), range(8) y(slot) GROUP BY ALL), s AS (SELECT b, {SUMS} FROM w JOIN po USING (session, pos) GROUP BY 1) SELECT b, round({DELTA_SQL}, 6) AS delta FROM s""",
)
def f10(t: Tables):
    return r6(R.boot_stratified(folded(t), "session", 8, ARMS, SEEDS, 20, 10), "delta")


THINNED = lambda draw: F.when(F.col("n_gt") > 0, u(f"thin{draw}", "chunk") < 0.5).otherwise(True)
_PAIR = lambda draw: f"""s{draw} AS (SELECT b, {SUMS}, {', '.join(f"coalesce(sum(w * {c}) FILTER (n_gt = 0 OR {u_sql(f'thin{draw}', 'chunk')} < 0.5), 0) AS t_{c}" for c in COLS)} FROM w{draw} w JOIN po USING (session, pos) GROUP BY 1)"""


@query(
    "f14_boot_paired", "wide",
    f"WITH {FOLD}, {NESTED(140, 10).replace(' w AS (', ' w0 AS (')}, {_PAIR(0)} SELECT b, round({WEIGHTED(140)}, 6) AS \"full\", round({WEIGHTED(140, 't_')}, 6) AS thin, round({WEIGHTED(140, 't_')} - {WEIGHTED(140)}, 6) AS diff FROM s0",
)
def f14(t: Tables):
    return r6(R.boot_paired(folded(t), THINNED(0), ARMS, SEEDS, 10, 140), "full", "thin", "diff")


_CP = lambda k: f"""cp{k} AS (SELECT b, sidx AS copy, CAST(floor({u_sql(140 + k, 'b', 'sidx')} * (SELECT count(*) FROM sz)) AS BIGINT) AS pick FROM range(10) x(b), si), sl{k} AS (SELECT b, copy, session, n, unnest(range(1, n + 1)) AS slot FROM cp{k} JOIN si ON si.sidx = cp{k}.pick),
 w{k} AS (SELECT b, session, CAST(floor({u_sql(140 + k, 'b', 'copy', 'slot')} * n) AS BIGINT) + 1 AS pos, count(*) AS w FROM sl{k} GROUP BY 1, 2, 3), {_PAIR(k)}, d{k} AS (SELECT {k} AS draw, {WEIGHTED(140 + k, 't_')} - {WEIGHTED(140 + k)} AS diff FROM s{k})"""


@query(
    "f14_boot_paired_pooled", "wide",
    f"""WITH {FOLD}, sz AS (SELECT session, count(*) AS n FROM fo GROUP BY 1), si AS (SELECT *, row_number() OVER (ORDER BY {u_sql('idx', 'session')}, session) - 1 AS sidx FROM sz), po AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY {u_sql('pos', 'chunk')}, chunk) AS pos FROM fo),
 {', '.join(_CP(k) for k in range(3))}, p AS (SELECT draw, avg(diff) AS m, var_pop(diff) AS v FROM (FROM d0 UNION ALL FROM d1 UNION ALL FROM d2) GROUP BY 1)
 SELECT count(*) AS draws, round(avg(m), 6) AS mean, round(avg(v), 8) AS within, round(var_samp(m), 8) AS between, round(sqrt(avg(v) + var_samp(m)), 6) AS se FROM p""".replace("AS between", 'AS "between"'),
)
def f14_pooled(t: Tables):
    g = R.pooled_draws(R.boot_paired_draws(folded(t), [THINNED(k) for k in range(3)], ARMS, SEEDS, 10, [140 + k for k in range(3)]))
    return r6(g.withColumn("within", F.round("within", 8)).withColumn("between", F.round("between", 8)), "mean", "se")


@query(
    "f15_boot_mc_error", "wide",
    f"""WITH {FOLD}, se AS (SELECT session, {PLAIN} FROM fo GROUP BY 1), ix AS (SELECT *, row_number() OVER (ORDER BY {u_sql('idx', 'session')}, session) - 1 AS idx FROM se), {MULT('dr', 100, 15, '(SELECT count(*) FROM ix)')},
 s AS (SELECT b, {SUMS} FROM dr JOIN ix USING (idx) GROUP BY 1), r AS (SELECT b // 20 AS run, stddev_samp({DELTA_SQL}) AS se FROM s GROUP BY 1) SELECT count(*) AS runs, round(arg_min(se, run), 6) AS se, round(avg(se), 6) AS mean_se, round(stddev_samp(se), 6) AS mc_sd FROM r""",
)
def f15(t: Tables):
    return r6(R.boot_mc_error(folded(t), ARMS, SEEDS, 20, 15, 5), "se", "mean_se", "mc_sd")


@query(
    "f21_se_without_replacement", "wide",
    f"""WITH {FOLD}, {EVEN}, ro AS (SELECT rn AS round, {PLAIN} FROM ev GROUP BY 1), k AS (SELECT b, round, row_number() OVER (PARTITION BY b ORDER BY {u_sql(21, 'b', 'round')}, round) AS k FROM ro, range(30) x(b)),
 s AS (SELECT n, b, {PLAIN} FROM k JOIN ro USING (round), (VALUES (5), (20), (80)) v(n) WHERE k <= n GROUP BY 1, 2), d AS (SELECT n, {DELTA_SQL} AS delta FROM s), t AS (SELECT count(*) AS r FROM ro)
 SELECT n, r AS n_rounds, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, CASE WHEN r > n THEN round(stddev_samp(delta) / sqrt((r - n) / (n * (r - 1))), 6) END AS sigma FROM d, t GROUP BY n, r""",
)
def f21(t: Tables):
    x = even(t)
    n = x.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    from ..operators.scan import sized_rank

    r = sized_rank(x.join(n, "session").withColumn("__u", u(74, "chunk")), ["session"], "__u", ["chunk"], "n", "round")
    rounds = r.groupBy("round").agg(*[F.sum(c).alias(c) for c in COLS])
    return r6(R.se_without_replacement(rounds, [5, 20, 80], ARMS, SEEDS, 30, 21), "mean", "sd", "sigma")


_CAT = "CASE WHEN j < silent THEN 'silent' WHEN j < silent + backchannel THEN 'backchannel' ELSE 'take_floor' END"
PERMUTED = lambda reps, seed: f"""v AS (SELECT dialogue, slot, m, j, {_CAT} AS cat FROM (SELECT *, unnest(range(m)) AS j FROM slots)), pl AS (SELECT dialogue, slot, m, row_number() OVER (PARTITION BY dialogue ORDER BY {u_sql('place', 'slot', 'j')}, slot, j) AS place FROM v),
 rk AS (SELECT rep, dialogue, cat, row_number() OVER (PARTITION BY rep, dialogue ORDER BY {u_sql(seed, 'rep', 'slot', 'j')}, slot, j) AS place FROM v, range({reps}) r(rep)), mv AS (SELECT rep, dialogue, slot, m, cat, count(*) AS c FROM rk JOIN pl USING (dialogue, place) GROUP BY ALL)"""
_S = lambda q: f"CASE WHEN c > 0 AND c < m THEN ({q} - 2 * (c / m) * c + (c / m) * (c / m) * m) / (n_slots * (c / m) * (1 - c / m)) END"


@query(
    "f32_perm_within_cluster", "slots",
    f"""WITH {PERMUTED(100, 32)}, tt AS (SELECT cat, count(*) AS n_slots, count(DISTINCT dialogue) AS n_dialogues, sum(c) AS c, sum(m) AS m, sum(c * c / m) AS s0 FROM (SELECT dialogue, m, unnest(['silent', 'backchannel', 'take_floor']) AS cat, unnest([silent, backchannel, take_floor]) AS c FROM slots) GROUP BY 1),
 ob AS (SELECT *, {_S('s0')} AS observed FROM tt), nu AS (SELECT cat, observed, {_S('q')} AS s FROM (SELECT rep, cat, sum(c * c / m) AS q FROM mv GROUP BY 1, 2) JOIN ob USING (cat)),
 g AS (SELECT cat, avg(s) AS null_mean, quantile_cont(s, 0.025) AS null_lo, quantile_cont(s, 0.975) AS null_hi, (count(*) FILTER (s >= observed - 1e-12) + 1) / (count(*) + 1) AS p_value FROM nu GROUP BY 1)
 SELECT cat, n_slots, n_dialogues, round(c / m, 6) AS rate, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_lo, 6) AS null_lo, round(null_hi, 6) AS null_hi, round(p_value, 6) AS p_value, round(observed - 1, 6) AS excess, round(null_mean - 1, 6) AS excess_dialogue, round(observed - null_mean, 6) AS excess_slot FROM ob JOIN g USING (cat)""",
)
def f32(t: Tables):
    return r6(V.permutation_test(t.slots, CATS, 100, 32), "rate", "observed", "null_mean", "null_lo", "null_hi", "p_value", "excess", "excess_dialogue", "excess_slot")


_BIN = lambda m, p, draw: f"CASE WHEN {p} <= 0 THEN 0 WHEN {p} >= 1 THEN {m} ELSE len(list_filter(range({m}), lambda k: list_sum(list_transform(range(k + 1), lambda i: exp(lgamma({m} + 1) - lgamma(i + 1) - lgamma({m} - i + 1) + i * ln({p}) + ({m} - i) * ln(1 - {p})))) <= {draw})) END"


@query(
    "f34_kl_noise_floor", "slots",
    f"""WITH x AS (SELECT *, silent / m AS p1, CASE WHEN m > silent THEN backchannel / (m - silent) ELSE 0 END AS p2, {u_sql(34, 'rep', 'slot', '0', '0')} AS u1, {u_sql(34, 'rep', 'slot', '0', '1')} AS u2 FROM slots, range(20) r(rep)),
 y AS (SELECT *, CAST({_BIN('m', 'least(greatest(p1, 0), 1)', 'u1')} AS BIGINT) AS r1 FROM (SELECT * REPLACE (p1 AS p1) FROM x)), z AS (SELECT *, m - r1 AS l FROM y), w AS (SELECT *, CAST({_BIN('l', 'p2', 'u2')} AS BIGINT) AS r2 FROM z),
 k AS (SELECT scenario, rep, CASE WHEN r1 > 0 THEN r1 / m * ln(r1 / silent) ELSE 0 END + CASE WHEN r2 > 0 THEN r2 / m * ln(r2 / backchannel) ELSE 0 END + CASE WHEN l - r2 > 0 THEN (l - r2) / m * ln((l - r2) / take_floor) ELSE 0 END AS kl FROM w),
 g AS (SELECT scenario, rep, avg(kl) AS kl, count(*) AS n_slots FROM k GROUP BY 1, 2) SELECT scenario, max(n_slots) AS n_slots, count(*) AS reps, round(avg(kl), 6) AS mean_kl, round(stddev_samp(kl), 6) AS sd_kl FROM g GROUP BY 1""",
)
def f34(t: Tables):
    return r6(V.noise_floor(t.slots, CATS, 20, 34, ["scenario"]), "mean_kl", "sd_kl")
