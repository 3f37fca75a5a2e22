"""Block-wise greedy matching against the plain loop, with blocks so small that conflicts run across cuts."""

import random

import pytest

from tandemline.operators import matching as M
from tandemline.operators.greedy import collar_rule, cover_rule, greedy_match


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "k long, id long, s double, e double").repartition(parts)


def loop(items, cands, rule):
    """{item id: candidate id} of one key by the plain rule."""
    items, cands, used, got = sorted(items, key=lambda r: r[2:] + r[1:2]), sorted(cands, key=lambda r: r[2:] + r[1:2]), set(), {}
    for x in items:
        best = None
        for j, y in enumerate(cands):
            v = rule(x, y)
            if j not in used and v is not None and (best is None or v > best[0]):
                best = (v, j)
        if best:
            used.add(best[1])
            got[x[0], x[1]] = cands[best[1]][1]
    return got


def cover(x, y):
    part = max(0.0, min(x[3], y[3]) - max(x[2], y[2])) / (x[3] - x[2]) if x[3] > x[2] else 0.0
    return part if part >= 0.5 else None


def near(collar):
    return lambda x, y: -abs(x[2] - y[2]) if x[2] - collar <= y[2] <= x[2] + collar else None


def pairs(df):
    return {(r.k, x): r.y_id[j - 1] for r in df.collect() for x, j in zip(r.x_id, r.took) if j}


@pytest.mark.parametrize("per", [1, 3, 64])
def test_blocks_equal_the_loop(spark, per):
    rnd = random.Random(5)
    span = lambda n, k, top: [(k, i, s, s + rnd.choice([0.0, 1.0, 2.5, 9.0])) for i, s in enumerate(float(rnd.randrange(top)) for _ in range(n))]
    items, cands = [span(40, k, 25) for k in (1, 2)], [span(30, k, 25) for k in (1, 2)]
    want = {}
    for x, y in zip(items, cands):
        want.update(loop(x, y, cover))
    got = greedy_match(frame(spark, sum(items, [])), frame(spark, sum(cands, []), 7), ["k"], cover_rule(0.5), 0.0, 4.0, per)
    assert pairs(got) == want
    points = lambda rows: [(k, i, s, s) for k, i, s, _ in rows]
    want = {}
    for x, y in zip(items, cands):
        want.update(loop(points(x), points(y), near(3.0)))
    got = greedy_match(frame(spark, points(sum(items, []))), frame(spark, points(sum(cands, []))), ["k"], collar_rule(3.0), 3.0, 4.0, per)
    assert pairs(got) == want


def test_an_island_of_ten_thousand_events(spark):
    rnd = random.Random(8)
    items = [(1, i, float(i), i + 1.5) for i in range(10_000)]
    cands = [(1, i, i + rnd.random(), i + 1.0 + rnd.random()) for i in range(10_000)]
    want, used, j = {}, set(), 0
    ys = sorted(cands, key=lambda r: r[2:])
    for x in items:
        while ys[j][3] <= x[2]:
            j += 1
        best = None
        for i in range(j, len(ys)):
            if ys[i][2] >= x[3]:
                break
            v = cover(x, ys[i])
            if i not in used and v is not None and (best is None or v > best[0]):
                best = (v, i)
        if best:
            used.add(best[1])
            want[1, x[1]] = ys[best[1]][1]
    got = greedy_match(frame(spark, items), frame(spark, cands), ["k"], cover_rule(0.5), 0.0, 1000.0, 512)
    assert got.count() == 20 and pairs(got) == want


def test_null_times_count_and_match_nothing(spark):
    ev = frame(spark, [(1, 1, 0.0, 2.0), (1, 2, None, 2.0), (2, 3, 1.0, 1.0)])
    w = frame(spark, [(1, 1, 0.0, 1.0), (3, 2, 0.0, None)])
    got = {r.k: (r.matched, r.n_pred, r.n_gt, r.f1) for r in M.match_by_cover(ev, w, ["k"], 10.0).collect()}
    assert got == {1: (1, 2, 1, 2 / 3), 2: (0, 1, 0, 0.0), 3: (0, 0, 1, 0.0)}


def test_empty_sides(spark):
    none = frame(spark, [(1, 1, 0.0, 1.0)]).limit(0)
    assert greedy_match(none, none, ["k"], cover_rule(0.5), 0.0, 10.0).count() == 0
    assert M.match_by_cover(none, none, ["k"], 10.0).count() == 0
