"""Agreement of texts and provenance of dialogues on small tables with nulls and missing turns."""

from tandemline.operators import texts as T


def test_agreement_of_equal_close_and_missing_texts(spark):
    rows = [("a", "kitten", "sitting"), ("a", "same", "same"), ("b", None, None), ("b", "abc", None), ("c", "", "")]
    got = {r.g: r for r in T.text_agreement(spark.createDataFrame(rows, "g string, r string, h string"), ["g"], "r", "h").collect()}
    assert abs(got["a"].mean_similarity - 4 / 7) < 1e-12 and got["a"].share_equal == 0.5
    assert (got["b"].n_equal, got["b"].least_similarity) == (1, 0.0) and got["c"].mean_similarity is None


def test_provenance_grid(spark):
    a = [("x", 1, 0, "hi"), ("x", 1, 1, "yo"), ("x", 2, 1, "hi"), ("x", 2, 2, None), ("x", 3, 0, "no"), ("y", 4, 0, "hi"), ("y", 4, 1, "b")]
    b = [(1, 0, "hi"), (1, 1, "yo"), (2, 1, "hi"), (2, 2, ""), (2, 3, "more"), (4, 0, "other"), (4, 2, "b"), (9, 0, "alone")]
    df = T.provenance(
        spark.createDataFrame(a, "g string, id long, t long, s string"), spark.createDataFrame(b, "id long, t long, s string"), ["g"], "id", "t", "s")
    got = {r.g: tuple(r)[1:] for r in df.collect()}
    # of x's three, two are found, one has as many turns, that one equals throughout, both begin alike
    assert got == {"x": (3, 2, 1, 1, 2), "y": (1, 1, 1, 0, 0)}


def test_edits_of_words_equal_the_edit_table():
    import random
    import time

    from tandemline.functions.text import _distance

    def table(r, h, free):
        row, best = list(range(len(h) + 1)), len(h)
        for i, a in enumerate(r, 1):
            new = [0 if free else i]
            for j, b in enumerate(h, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row, best = new, min(best, new[-1])
        return best if free else row[-1]

    rnd = random.Random(5)
    for _ in range(400):
        r, h = ([rnd.choice("abcd") for _ in range(rnd.randint(1, 70))] for _ in range(2))
        for free in (True, False):
            assert _distance(r, h, free) == table(r, h, free)
    long = [rnd.choice("abcdefgh") for _ in range(20000)]
    t = time.process_time()
    assert _distance(long, long[:-9], False) == 9
    assert time.process_time() - t < 1.5
