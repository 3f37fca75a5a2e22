"""Brute-force versions, held-out accuracy and edge rows of phrase mining, the quality network and period detection."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tandemline.llm")

from tandemline.llm import periods, phrases, quality_cnn  # noqa: E402

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, key long, n long, n_runs string"
EDGES = [(1, None, None, 1, 1, None), (2, "", "en", 1, 1, None), (None, "a b c d e f", "en", 1, 1, None), (3, "a b c d e f", None, 1, 1, "x"),
         (3, "a b c d e f", None, 1, 1, "x"), (4, LONG, "de", 1, 1, None), (5, " \n\t\n", "de", 1, 1, None), (6, "x " * 40, "de", 1, 1, None)]


# ---- periods


def all_runs(x):
    """{(start, end): smallest period} by comparing the words at every distance."""
    out = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= 2 * p:
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return {(s, e, p) for (s, e), p in out.items()}


def digest(text, doc_id):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = sorted((s, e - s, p) for s, e, p in all_runs(w) if e - s >= max(12, 2 * p))
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_words(r):
    kind = r.random()
    if kind < 0.3:
        return [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(90))]
    if kind < 0.6:  # flat stretches that meet out of phase
        u, w = [r.randrange(2) for _ in range(r.randrange(1, 6))], []
        for _ in range(r.randrange(1, 5)):
            w += u * r.randrange(1, 25) + u[: r.randrange(len(u) + 1)]
        return w * r.choice([1, 2, 3])
    if kind < 0.75:
        return [bin(i).count("1") & 1 for i in range(r.randrange(200))]
    if kind < 0.9:
        a, b = [0], [0, 1]
        for _ in range(r.randrange(9)):
            a, b = b, b + a
        return b
    k = r.randrange(1, 20)
    return [1] + ([0, 1] * k + [0]) * 2 + [0, 1] * (k + r.randrange(6))


def test_runs_against_brute_force():
    r = random.Random(4)
    for _ in range(1500):
        x = periodic_words(r)
        got = periods.runs_of(np.array(x, np.int64))
        assert set(zip(*(a.tolist() for a in got))) == all_runs(x), x


def test_run_digests_against_brute_force(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{k}" for k in periodic_words(r)), None, 0, 0, None) for i in range(300)]
    rows += [x for x in EDGES if x[1] is not LONG]
    want = Counter((i, *digest(t, i)) for i, t, *_ in rows)
    for block in (periods.BLOCK, 1):
        old, periods.BLOCK = periods.BLOCK, block
        try:
            found = periods.digested(spark.createDataFrame(rows, SCHEMA).repartition(3))
        finally:
            periods.BLOCK = old
        assert found.columns == ["doc_id", *periods.COLUMNS]
        assert Counter(tuple(x) for x in found.collect()) == want
    long = periods.digested(spark.createDataFrame(EDGES, SCHEMA)).where("doc_id = 4").first()
    n, p = 60_000, 977  # 4 is not among the ids that are edited
    assert zlib.crc32(b"4") % 10 and (long.n_runs, long.start, long.length, long.period) == (1, 0, n, p)
    assert periods.digested(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- phrases


def mined(rows, least, top=2000):
    count, total, size = defaultdict(Counter), Counter(), {}
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        keep = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            longer = [b for h, b in f.items() if len(h) == 3 and len(g) == 2 and b >= least and g in (h[:2], h[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            s, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            keep.append((-s, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, g, left, right) in enumerate(sorted(keep)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    r = random.Random(2)
    vocab = ["a", "B", "é", "the", "of", "x-y", "Ж", "long", "w1", "w2"]
    text = lambda: "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(r.randrange(120)))
    rows = [(i, text(), r.choice(["en", "de", None, "und"]), 0, 0, None) for i in range(120)]
    return rows + [x for x in EDGES if x[1] is not LONG] + [(7, "Copies of this text. " * 12, x, 0, 0, None) for x in ("en", "de", None) for _ in range(12)]


@pytest.mark.parametrize("bits,block,top", [(62, phrases.BLOCK, 2000), (62, 40, 2000), (9, phrases.BLOCK, 2000), (62, 64, 7)])
def test_phrases_against_brute_force(spark, prose, bits, block, top):
    """Short fingerprints collide all over; small blocks cut every text."""
    old, phrases.BLOCK = phrases.BLOCK, block
    try:
        got = phrases.collocations(spark.createDataFrame(prose, SCHEMA).repartition(5), least=10, top=top, bits=bits).collect()
    finally:
        phrases.BLOCK = old
    assert sorted(tuple(x) for x in got) == mined(prose, 10, top)
    assert got


def test_blocks_carry_word_positions():
    text = "one two. " * 50 + "three " * 30
    old, phrases.BLOCK = phrases.BLOCK, 64
    try:
        cut = phrases._cut(text.encode())
        assert b"".join(cut) == text.encode() and len(cut) > 3
        found = [int(p) for b in phrases.blocks([(text.encode(), 1, 2)], 62) for p in b.pos]
    finally:
        phrases.BLOCK = old
    assert found == list(range(130))


def test_phrases_of_empty_and_edge_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    got = phrases.collocations(spark.createDataFrame(EDGES, SCHEMA)).collect()
    assert {x.lang for x in got} == {"de"} and len(got) > 900  # the long text alone repeats anything ten times, and "x x"


# ---- quality network


def junk(r):
    return r.choice([lambda: " ".join(f"{w}***" for w in good(r).split()), lambda: good(r).upper().replace(" ", "!! ")])()


def good(r):
    return ". ".join(" ".join("".join(r.choice("aeiourstln") for _ in range(r.randint(2, 8))) for _ in range(9)) for _ in range(r.randint(3, 12)))


def test_quality_network_on_held_out_rows(spark):
    r = random.Random(6)
    rows = [(i, junk(r) if i % 4 == 0 else good(r)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(600)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality_cnn.judged(docs, labels).collect()}
    assert {i for i, x in got.items() if x.held_out} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    held = [i for i, x in got.items() if x.held_out]
    assert sum(got[i].predicted == (i % 4 > 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())


def test_held_out_labels_are_not_learned_from(spark):
    r = random.Random(7)
    docs = spark.createDataFrame([(i, good(r)) for i in range(60)], "doc_id long, text string")
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    base = [(i, i % 2) for i in range(60) if i not in held]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    one = quality_cnn.judged(docs, table(base + [(i, 0) for i in held])).orderBy("doc_id").collect()
    two = quality_cnn.judged(docs, table(base + [(i, 1) for i in held])).orderBy("doc_id").collect()
    assert one == two


def test_gradient_of_the_network():
    net = quality_cnn.QualityCNN()
    docs, y, w = [[b"some text " * 60, b"other"], [b"SHORT!!"], [b""]], np.array([1, 0, 1]), np.full(3, 1 / 3, np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["b"] += np.random.default_rng(1).normal(0, 0.3, len(net.p["b"]))  # off the kink at zero

    def loss():
        raw, sizes = quality_cnn.cells([b for d in docs for b in d])
        top = net.cell_maxima(raw, net.tables())
        first, last, many = quality_cnn.chunk_starts(sizes)
        act = np.stack([top[a:b].max(0) for a, b in zip(first, last)])
        own = np.split(act, np.cumsum([many[:2].sum(), many[2]]))
        p = net.combined(np.stack([a.mean(0) for a in own]), np.stack([a.max(0) for a in own]))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    g, eps = net.gradient(docs, y, w), 1e-5
    for name, at in (("z", (0,)), ("o", (3,)), ("d", (5, 2)), ("d", (40, 7)), ("b", (9,)), ("c", (11, 4)), ("c", (30, 20)), ("e", (ord("t"), 2)), ("e", (ord("!"), 5))):
        net.p[name][at] += eps
        up = loss()
        net.p[name][at] -= 2 * eps
        down = loss()
        net.p[name][at] += eps
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-4, name


def test_scores_do_not_depend_on_what_is_scored_together(spark):
    r = random.Random(8)
    rows = [(i, junk(r) if i % 4 == 0 else good(r)) for i in range(80)] + [(100, " ".join(good(r) for _ in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(80)], "doc_id long, quality int")
    whole = {x.doc_id: x.score for x in quality_cnn.judged(docs, labels).collect()}
    old, quality_cnn.PART = quality_cnn.PART, 1
    try:
        parts = {x.doc_id: x.score for x in quality_cnn.judged(docs, labels).collect()}
    finally:
        quality_cnn.PART = old
    assert all(abs(whole[i] - parts[i]) < 1e-5 for i in whole)


@pytest.mark.parametrize("empty", [False, True])
def test_quality_network_takes_edge_rows(spark, empty):
    docs = spark.createDataFrame([] if empty else EDGES, SCHEMA).withColumnRenamed("n", "score")
    labels = spark.createDataFrame([(3, 1), (3, 0), (6, 0), (4, 1), (None, None)], "doc_id long, quality int")
    for y in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality_cnn.judged(docs, y).collect()
        assert len(got) == (0 if empty else len(EDGES))
    if not empty:
        assert {x.score for x in quality_cnn.judged(docs, labels.limit(0)).collect()} == {0.5}
        assert {x.score for x in quality_cnn.judged(docs, spark.createDataFrame([(i, 1) for i in range(7)], labels.schema)).collect()} == {1.0}


# ---- mends of earlier operators


def test_days_are_one_to_one_and_equal_across_formats():
    from datetime import date, timedelta

    from tandemline.llm import pseudonyms

    key, first = b"k", date(1900, 1, 1)
    days = [first + timedelta(n) for n in range(0, (date(2100, 1, 1) - first).days, 5)]
    shapes = {"iso": lambda d: f"{d:%Y-%m-%d}", "dot": lambda d: f"{d:%d.%m.%Y}", "slash": lambda d: f"{d:%m/%d/%Y}",
              "short dot": lambda d: f"{d.day}.{d.month}.{d.year}", "short slash": lambda d: f"{d.month}/{d.day}/{d.year}"}
    read = {"iso": lambda s: date.fromisoformat(s), "dot": lambda s: date(*map(int, s.split(".")[::-1])),
            "slash": lambda s: (lambda m, d, y: date(y, m, d))(*map(int, s.split("/")))}
    new = {n: [read[n.split()[-1]](pseudonyms.day(f(d), key)) for d in days] for n, f in shapes.items()}
    assert all(v == new["iso"] for v in new.values())
    assert len(set(new["iso"])) == len(days) and sum(a == b for a, b in zip(days, new["iso"])) < 5
    late = [d for d in days if d.day > 12]
    texts = [pseudonyms.day(f"{d:%d/%m/%Y}", key) for d in late]
    assert len(set(texts)) == len(late) and all(int(t[:2]) > 12 for t in texts)
    assert not set(texts) & {pseudonyms.day(shapes["slash"](d), key) for d in days}
    for text in ("2024-02-30", "31.4.2024", "13/13/2024", "01/01/1899"):
        assert pseudonyms.day(text, key) is None
    out, found = pseudonyms.pseudonymised("at 2024-02-29T10:00, " + "x" * 90 + "@mail.example.com", key)
    assert "2024-02-29" not in out and "x" * 90 not in out and found[0] == found[3] == 1


def test_rows_that_repeat_count_once_in_the_language_sample(spark):
    from tandemline.llm import langid

    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    rows = [(ids[0], "a b c " * 60, "en")] * 300 + [(ids[1], "d e f " * 60, "de")] * 2 + [(ids[2], None, "de")]
    x, y, classes = langid.sample_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert classes == ["de", "en"] and len(x) == len(y) <= 6


def test_line_dedup_stage_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    rows = [(1, "same line here\nother", "en", "s", 0, 7, "a", "b"), (2, "same line here\nmore", None, None, 5, 8, "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines long, n_removed string, __did string")
    got = corpus_pipeline.line_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(tuple(x) for x in got.collect()) == [(1, "same line here\nother", "en", "s", 20, 7, "a", "b"), (2, "more", None, None, 4, 8, "c", "d")]


def test_released_tables_are_gone(spark):
    import os

    from tandemline.llm import common

    common.release(spark)
    df = common.saved(spark.range(3))
    path = common._tables[0]
    assert df.count() == 3 and os.path.isdir(path)
    common.release(spark)
    assert not os.path.exists(path) and not common._tables


def test_triggers_reach_by_words_of_any_length():
    from tandemline.llm.toxicity import READINGS, Matcher

    read = lambda text: {r: n for r, n in zip(READINGS, Matcher([])(text)) if n}
    for word in ("w", "w" * 90, "w" * 5000):
        between = " ".join([word] * 5)
        assert read(f"she said {between} idiot") == {"reported insult": 1}
        assert read(f"he is not {word} {word} idiot") == {"negated insult": 1}
        assert read(f"she said {between} {between} idiot") == {"bare insult": 1}
        assert read(f"she said. {word} idiot") == {"bare insult": 1}
    assert read("idiot idiot idiot") == {"bare insult": 3} and read("you idiot, you idiot") == {"aimed insult": 2}
    # a match late in a long clause is read with the words right before it
    assert read("idiot " + "a b c " * 2000 + "she said he is an idiot") == {"bare insult": 1, "reported insult": 1}
