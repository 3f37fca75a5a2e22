"""Candidates of the two joins: few inside a group of near copies, and none that matters is lost."""

import random

from tandemline.llm import jaccard, lines


def test_candidates_in_a_family_of_lines_stay_few(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(58)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in r.sample(range(58), 5):  # most pairs differ in too many words
            w[k] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    made, pairs = [], lines._pairs
    monkeypatch.setattr(lines, "_pairs", lambda *a, **k: made.append(pairs(*a, **k)) or made[-1])
    sizes, release = [], lines.release
    monkeypatch.setattr(lines, "release", lambda *a, **k: (sizes.extend(d.count() for d in made), made.clear(), release(*a, **k)))
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [set(t.split()) for _, t in rows]
    gone = {i for i in range(400) if any(5 * len(sets[i] & s) >= 4 * len(sets[i] | s) for s in sets[:i])}
    assert {x.doc_id for x in got.collect() if x.n_removed} == gone
    assert sum(sizes) <= 10 * len(rows)


def test_parities_of_near_sets_differ_in_no_more_than_the_sets(spark):
    r = random.Random(6)
    texts = []
    for i in range(40):
        w = [f"v{r.randrange(300)}" for _ in range(120)] if i % 2 == 0 else texts[-1].split()
        w[r.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x for x in jaccard.with_sets(docs, 5).collect()}
    for i in range(40):
        for j in range(i):
            a, b = (set(jaccard.shingles(texts[k], 5).tolist()) for k in (i, j))
            apart = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(found[i].sk, found[j].sk))
            assert apart <= len(a ^ b) and (apart - len(a ^ b)) % 2 == 0
            assert i % 2 == 0 or j != i - 1 or apart > 0
