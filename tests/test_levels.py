"""Vote permutation, noise floor and multi-level resampling: invariants, literals, two ways that must agree."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tandemline.functions.keyed import u
from tandemline.operators import resample as R, votes as V
from tandemline.operators.scan import sized_rank

CATS = ["a", "b", "c"]
ARMS, SEEDS = ["F", "O"], [0, 1]


@pytest.fixture(scope="module")
def slots(spark):
    r = random.Random(1)
    rows = []
    for s in range(400):  # one dialogue holds a third of all slots
        n = [r.randrange(4) for _ in CATS]
        rows.append(("hot" if s % 3 == 0 else f"d{s % 40}", s, *n, sum(n)))
    return spark.createDataFrame(rows, "dialogue string, slot long, a long, b long, c long, m long").cache()


def wide(spark, sizes):
    r = random.Random(3)
    cols = R.cells(ARMS, SEEDS)
    rows = [(f"s{s}", f"s{s}c{k}", *[r.randrange(5) for _ in cols]) for s, n in enumerate(sizes) for k in range(n)]
    return spark.createDataFrame(rows, "session string, chunk string, " + ", ".join(f"{c} long" for c in cols))


@pytest.mark.parametrize("per", [4096, 7])
@pytest.mark.parametrize("parts", [1, 7, 64])
def test_sized_rank_is_row_number(spark, parts, per):
    d = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("k")).repartition(parts)
    d = d.join(d.groupBy("k").agg(F.count("*").alias("n")), "k").withColumn("x", u("t", "id"))
    got = {(x.k, x.id): x.rn for x in sized_rank(d, ["k"], "x", ["id"], "n", per=per).collect()}
    rows, want = {}, {}
    for x in d.collect():
        rows.setdefault(x.k, []).append((x.x, x.id))
    for k, xs in rows.items():
        want.update({(k, i): n for n, (_, i) in enumerate(sorted(xs), 1)})
    assert got == want


def test_permutation_keeps_slots_and_dialogues(slots):
    moved = V.permuted_votes(slots, CATS, 3, 5).collect()
    size, votes, slot_size = {}, {}, {x.slot: x.m for x in slots.collect()}
    for x in moved:
        size[x.rep, x.slot] = size.get((x.rep, x.slot), 0) + x.c
        votes[x.rep, x.dialogue, x.cat] = votes.get((x.rep, x.dialogue, x.cat), 0) + x.c
        assert 0 < x.c <= x.m == slot_size[x.slot]
    assert size == {(r, s): m for r in range(3) for s, m in slot_size.items() if m}
    want = {}
    for x in slots.collect():
        for c in CATS:
            for r in range(3):
                want[r, x.dialogue, c] = want.get((r, x.dialogue, c), 0) + x[c]
    assert votes == {k: v for k, v in want.items() if v}


def test_permutation_sees_a_slot_signal(spark):
    """Slots of one dialogue that all agree among themselves and differ from each other cannot be chance."""
    rows = [("d", s, 6 * (s % 2), 6 * (1 - s % 2)) for s in range(30)] + [("e", 99, 0, 0)]
    got = {x.cat: x for x in V.permutation_test(spark.createDataFrame(rows, "dialogue string, slot long, a long, b long"), ["a", "b"], 40, 2).collect()}
    assert got["a"].p_value == pytest.approx(1 / 41) and got["a"].observed == pytest.approx(6.0) and got["a"].n_slots == 30
    assert got["a"].excess == pytest.approx(got["a"].excess_dialogue + got["a"].excess_slot)
    one = V.permutation_test(spark.createDataFrame([("d", 1, 3, 0)], "dialogue string, slot long, a long, b long"), ["a", "b"], 5, 2).collect()
    assert all(x.observed is None and x.p_value is None for x in one)


def test_noise_floor_of_single_and_unanimous_slots_is_zero(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, 7, 0)]
    got = V.noise_floor(spark.createDataFrame(rows, "slot long, a long, b long"), ["a", "b"], 5, 1).first()
    assert (got.n_slots, got.reps, got.mean_kl, got.sd_kl) == (3, 5, 0.0, 0.0)


def test_redrawn_votes_follow_the_shares(spark):
    """Binomial inversion keeps m, and large slots are drawn in parts instead of underflowing to zero."""
    rows = [(1, 3000, 1000, 0), (2, 1, 1, 2)]
    got = V.redrawn(spark.createDataFrame(rows, "slot long, a long, b long, c long"), CATS, 30, 3).collect()
    assert all(x.r_a + x.r_b + x.r_c == x.m and min(x.r_a, x.r_b, x.r_c) >= 0 for x in got)
    big = [x.r_a for x in got if x.slot == 1]
    assert abs(sum(big) / 30 - 3000) < 20 and 10 < math.sqrt(sum((v - 3000) ** 2 for v in big) / 30) < 60
    assert all(x.r_c == 0 for x in got if x.slot == 1)


def test_binomial_inversion_against_the_distribution(spark):
    m, p = 9, 0.3
    cdf = [sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k + 1)) for k in range(m + 1)]
    draws = [0.0, 1e-9, 0.04, 0.2, 0.5, 0.73, 0.95, 0.99999]
    d = spark.createDataFrame([(float(x),) for x in draws], "x double")
    got = [r.k for r in d.select(V.binomial(F.lit(m).cast("long"), F.lit(p), F.col("x")).alias("k")).collect()]
    assert got == [sum(c <= x for c in cdf[:m]) for x in draws]


def test_crossed_equals_cluster_when_only_sessions_are_drawn(spark):
    w = wide(spark, [5] * 12)
    a = {x.b: x.delta for x in R.boot_crossed(w, ARMS, SEEDS, 15, 4, ("session",)).collect()}
    b = {x.b: x.delta for x in R.boot_cluster(w, ARMS, SEEDS, 15, 4).collect()}
    c = {x.b: x.delta for x in R.boot_nested(w, ARMS, SEEDS, 15, 4, ("session",)).collect()}
    assert a == pytest.approx(b) and a == pytest.approx(c) and len(a) == 15


def test_no_level_gives_the_plain_difference(spark):
    w = wide(spark, [4] * 6)
    plain = w.agg(*[F.sum(c).alias(c) for c in R.cells(ARMS, SEEDS)]).select(R.delta_of(ARMS, SEEDS).alias("d")).first().d
    for boot in (R.boot_crossed(w, ARMS, SEEDS, 4, 1, ()), R.boot_nested(w, ARMS, SEEDS, 4, 1, ())):
        assert [x.delta for x in boot.collect()] == pytest.approx([plain] * 4)
    paired = R.boot_paired(w, F.lit(True), ARMS, SEEDS, 4, 1).collect()
    assert all(x.diff == 0 and x.full == x.thin for x in paired)


def test_crossed_needs_equal_sessions(spark):
    with pytest.raises(ValueError, match="1 to 3 chunks"):
        R.boot_crossed(wide(spark, [3, 1, 2]), ARMS, SEEDS, 2, 1)


def test_crossed_against_products_of_multiplicities(spark):
    w = wide(spark, [3] * 4)
    ws = {x.idx: x.w for x in R.weight_arrays(spark, 6, 4, 9).collect()}
    wb = {x.idx: x.w for x in R.weight_arrays(spark, 6, 3, "9b").collect()}
    assert all(sum(x[b] for x in ws.values()) == 4 and sum(x[b] for x in wb.values()) == 3 for b in range(6))
    order = {x.session: x.idx for x in R.dense_index(w.select("session").distinct(), ["session"], u("idx", "session"), "idx").collect()}
    rows = sorted(w.collect(), key=lambda x: (x.session, x.chunk))
    got = {x.b: x.delta for x in R.boot_crossed(w, ARMS, SEEDS, 6, 9, ("session", "block")).collect()}
    f1 = lambda tp, fp, gt: 2 * tp / (tp + fp + gt) if tp + fp + gt else 0.0
    for b in range(6):
        tot = {c: sum(ws.get(order[x.session], [0] * 6)[b] * wb.get(k % 3, [0] * 6)[b] * x[c] for k, x in enumerate(rows)) for c in R.cells(ARMS, SEEDS)}
        d = [f1(tot[f"tp_O{s}"], tot[f"fp_O{s}"], tot["n_gt"]) - f1(tot[f"tp_F{s}"], tot[f"fp_F{s}"], tot["n_gt"]) for s in SEEDS]
        assert got[b] == pytest.approx(sum(d) / 2)


def test_drawing_all_rounds_has_no_error(spark):
    w = wide(spark, [1] * 9).withColumnRenamed("chunk", "round")
    got = {x.n: x for x in R.se_without_replacement(w, [3, 9], ARMS, SEEDS, 12, 2).collect()}
    assert got[9].sd == pytest.approx(0) and got[9].sigma is None and got[3].sd > 0
    assert got[3].sigma == pytest.approx(got[3].sd / math.sqrt((9 - 3) / (3 * 8)))


@pytest.mark.parametrize("whole", [0, 30, 10_000])
def test_votes_shuffled_in_a_task_equal_those_ranked_by_shuffles(spark, slots, whole):
    """whatever dialogues are one row, the sums are those of the ranks; small ones write no row a replicate and vote."""
    want = {(x.rep, x.cat): x.q for x in V.permuted_votes(slots, CATS, 3, 5).groupBy("rep", "cat").agg(F.sum(F.col("c") * F.col("c") / F.col("m")).alias("q")).collect()}
    got = {(x.rep, x.cat): x.q for x in V.permuted_squares(slots, CATS, 3, 5, whole).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == 9


def test_redrawn_votes_are_not_shuffled(spark, slots):
    """only slots drawn in several parts are summed by a shuffle, and columns of ``by`` come along without a join."""
    few = V.redrawn(slots.withColumn("kind", F.col("slot") % 2), CATS, 4, 3, ["kind"])
    plan = few.filter("m <= 512")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and few.filter("r_a + r_b + r_c <> m or kind <> slot % 2").count() == 0
    both = slots.limit(3).withColumn("a", F.lit(700).cast("long"))
    got = V.redrawn(both, CATS, 4, 3).agg(F.count("*").alias("n"), F.count_if(F.expr("r_a + r_b + r_c <> m")).alias("bad")).first()
    assert tuple(got) == (12, 0)
    parts = V.noise_floor(slots.withColumn("kind", F.col("slot") % 2), CATS, 4, 3, ["kind"])._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in parts


def test_long_sessions_are_drawn_in_blocks(spark, monkeypatch):
    """the draws of a copy are dealt in blocks; several thinnings share one pass and equal single ones."""
    w = wide(spark, [40, 7, 1, 23])
    once = sorted(tuple(r) for r in R.nested_draws(w, 4, [3]).collect())
    monkeypatch.setattr(R, "BLOCK", 5)
    assert sorted(tuple(r) for r in R.nested_draws(w, 4, [3]).collect()) == once
    thins = [u("t", "chunk") < 0.5, u("v", "chunk") < 0.5]
    both = {(r.draw, r.b): r.diff for r in R.boot_paired_draws(w, thins, ARMS, SEEDS, 4, [8, 9]).collect()}
    for k, seed in enumerate((8, 9)):
        for r in R.boot_paired(w, thins[k], ARMS, SEEDS, 4, seed).collect():
            assert both[k, r.b] == pytest.approx(r.diff)
