"""Edge cases and brute-force versions of the training-text operators, on small literal tables."""

import hashlib
import itertools
import random
import zlib

import pytest
import xxhash

pytest.importorskip("tandemline.llm")

from pyspark.sql import functions as F  # noqa: E402

from tandemline.llm import langid, lines, mixing, pieces, pseudonyms, quality, sharding, simhash, topk, toxicity  # noqa: E402
from tandemline.llm.queries import piece_model  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, shard string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGES = [(1, None, None, None, None, "a", "b"), (2, "", "en", "s", 0, None, None), (None, "a b c d e f", "en", "s", 11, None, None),
         (3, "a b c d e f", "en", None, 11, None, None), (3, "a b c d e f", "en", None, 11, None, None), (4, LONG, "de", "t", len(LONG), None, None),
         (5, " \n\t\n", "de", "t", 4, None, None), (6, "a b c d e g\nx", "de", "t", 13, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (6, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("empty", [False, True])
def test_every_operator_takes_edge_rows(docs, labels, empty):
    d, y = (docs.limit(0), labels.limit(0)) if empty else (docs, labels)
    n = 0 if empty else len(EDGES)
    assert len(lines.deduplicated(d).collect()) == n
    assert len(langid.identified(d).collect()) == n
    assert len(toxicity.scored(d, y).collect()) == n
    assert len(quality.judged(d, y).collect()) == n
    assert len(simhash.near_groups(d).collect()) == n
    assert len(pieces.encoded(d, piece_model(), texts=True).collect()) == n
    assert len(mixing.mix(d).collect()) == n
    assert len(pseudonyms.private(d, b"k").collect()) == n
    assert len(sharding.sharded(d, 1000).collect()) == n
    assert simhash.drop_near_copies(d).columns == d.columns == mixing.mixed(d).columns == quality.good(d, y).columns


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"t{i}" for i in range(40)]
    base = [" ".join(r.sample(vocab, r.randint(1, 14))) for _ in range(30)]
    text = lambda: "\n".join(" ".join(w for w in r.choice(base).split(" ") if r.random() > 0.06) for _ in range(r.randint(0, 6)))
    rows = [(i, text()) for i in range(60)] + [(60, None), (61, ""), (62, "The  Cat\n\nthe cat")]
    earlier, want = [], {}
    for i, t in rows:
        keep = []
        for line in (t or "").split("\n"):
            s = set(line.lower().encode().split())
            if not s or not any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                keep.append(line)
            if s:
                earlier.append(s)
        want[i] = None if t is None else "\n".join(keep)
    for pair, probe in ((lines.PAIR_BUCKET, lines.PROBE_BUCKET), (1, 1), (2, 100)):
        old = lines.PAIR_BUCKET, lines.PROBE_BUCKET
        lines.PAIR_BUCKET, lines.PROBE_BUCKET = pair, probe  # also through the paths for frequent tokens
        try:
            got = {x.doc_id: x.text for x in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        finally:
            lines.PAIR_BUCKET, lines.PROBE_BUCKET = old
        assert got == want


def test_fingerprints_and_groups_against_brute_force(spark):
    r = random.Random(3)
    text = ["".join(r.choice("ab  C") for _ in range(r.randint(0, 12))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(text)] + [(900, None)]

    def fp(t):
        w = words((t or "").lower())
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = {i: fp(t) for i, t in rows}
    low = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in itertools.combinations(marks, 2):
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                low[a] = low[b] = min(low[a], low[b])
    for bucket in (simhash.PAIR_BUCKET, 1):
        old, simhash.PAIR_BUCKET = simhash.PAIR_BUCKET, bucket
        try:
            got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
        finally:
            simhash.PAIR_BUCKET = old
        assert {x.doc_id: (x.fp % 2**64, x.component_id) for x in got} == {i: (marks[i], low[i]) for i in marks}


def test_links_find_all_close_pairs(spark):
    r = random.Random(8)
    near = [0xF0F0] + [0xF0F0 ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for _ in range(80)]
    fps = sorted({*near, *(r.getrandbits(62) for _ in range(50)), *(0xFF ^ (1 << b) for b in range(63))})
    from tandemline.llm.components import components

    got = {x.node: x.root for x in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    low = {f: f for f in fps}
    for _ in range(8):
        for a, b in itertools.combinations(fps, 2):
            if (a ^ b).bit_count() <= 2:
                low[a] = low[b] = min(low[a], low[b])
    assert {f: got.get(f, f) for f in fps} == low


def test_pieces_equal_the_library():
    import sentencepiece

    sp, r = sentencepiece.SentencePieceProcessor(model_file=piece_model()), random.Random(1)
    cut = pieces.Segmenter(piece_model(), table=500)
    for _ in range(3000):
        t = "".join(r.choice(["a", "b", " ", "  ", "\t", "\n", "▁", "é", "漢", "😀", "́", "the", "tion", "<s>", "0", "\0"]) for _ in range(r.randint(0, 30)))
        parts, n, decoded = cut(t)
        ids = sp.encode(t)
        assert (" ".join(x for x in parts if x), n, decoded) == (" ".join(map(str, ids)), len(ids), sp.decode(ids + [2]))


def test_piece_digests(spark):
    row = pieces.encoded(spark.createDataFrame([(1, None)], "doc_id long, text string"), piece_model()).first()
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (1, hashlib.sha256(b"2").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_counts_against_brute_force():
    r = random.Random(2)
    for _ in range(200):
        t = "".join(r.choice(["a", "b", " ", " ", "\n", "#", "é"]) for _ in range(r.randint(0, 120)))
        w = words(t)
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        cover = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)}
        ls = [x for x in t.split("\n") if words(x)]
        assert quality.counts(t)[:5] == (len(w), sum(len(x.decode()) for x in w), t.count("#"), len(ls) - len(set(ls)), len(cover))


def test_rules_are_ordered_conditions(spark):
    import numpy as np

    x = {f: np.zeros(300) for f in quality.FEATURES}
    x["symbol_share"] = np.arange(300) / 300
    rules = quality.learn(x, x["symbol_share"] >= 0.8)
    assert rules and rules[0][0][0] == "symbol_share"
    assert quality.learn(x, np.zeros(300, bool)) == []


def test_top_products_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.randint(-3, 3) for _ in range(5)]) for i in range(120)] + [(200 + i, [1, 1, 1, 1, 1]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    got = [tuple(x) for x in topk.top_products(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")), 10).collect()]
    want = []
    for q, a in rows:
        if q % 20 == 0:
            s = sorted((-sum(p * o for p, o in zip(a, b)), i) for i, b in rows if i != q)[:10]
            want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    assert sorted(got) == sorted(want)


def test_bad_vectors_take_no_part(spark):
    t = spark.createDataFrame([(1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])], "vec_id long, embedding array<float>")
    assert [(x.vec_id, x.vec) for x in topk.whole_vectors(t).collect()] == [(1, [512, 1024])]


def test_toxicity_reads_clauses():
    m = toxicity.Matcher(["lowei"])
    at = dict(zip(toxicity.READINGS, range(7)))
    hit = lambda t: [k for k in at if m(t)[at[k]]]
    assert hit("You are an idiot.") == ["aimed insult"]
    assert hit("what a clown") == ["bare insult"]
    assert hit("you are not an idiot") == ["negated insult"]
    assert hit("she said the man is an idiot") == ["reported insult"]
    assert hit("I will kill it") == ["threat"] and hit("kill it") == []
    assert hit("der loweiung. ") == ["bare insult"] and hit("all is well") == []


def test_pseudonyms():
    key = b"k"
    text = "4111111111111111 +1 (017) 555-7713 2024-02-29 10.0.255.7 of.55@mail.example.com 4111111111111112 2024-02-30 GB82WEST12345698765432"
    new, found = pseudonyms.pseudonymised(text, key)
    assert found == [1, 1, 0, 1, 1, 1, 1] and pseudonyms.pseudonymised(text, key)[0] == new
    old, parts = text.split(" "), new.split(" ")
    assert parts[6:8] == old[6:8] or "4111111111111112" in new and "2024-02-30" in new
    assert pseudonyms.luhn(parts[0]) % 10 == 0 and all(len(a) == len(b) for a, b in zip(old, parts)) and parts[0] != old[0]
    assert sorted(pseudonyms.permuted(i, 300, key, "t") for i in range(300)) == list(range(300))


def test_mixing_takes_near_the_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), None if i % 11 == 0 else f"s{i % 4}") for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = sum(x["size"] for x in got)
    by = {}
    for x in got:
        by.setdefault((rows[x.doc_id][2], x.target, x.source_size), []).append(x.times * x["size"])
    assert abs(sum(t for _, t, _ in by) - 1.5 * total) < 1e-6
    for (_, target, size), taken in by.items():
        assert target <= 2 * size + 1e-9 and target - 7 <= sum(taken) <= target + 1e-9


def test_shards_fit(spark):
    rows = [(i, "x" * (i % 90)) for i in range(3000)] + [(7, "same")] * 900
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 2000).collect()
    sums = {}
    for x in got:
        sums[x.shard] = sums.get(x.shard, 0) + x.bytes
    assert len(got) == len(rows) and max(sums.values()) <= 2000 and all(sums[x.shard] == x.shard_bytes for x in got)


def test_language_is_learned(spark):
    r = random.Random(6)
    make = lambda abc: " ".join("".join(r.choice(abc) for _ in range(6)) for _ in range(60))
    rows = [(i, make("aeiomn" if i % 2 else "xyzkwq"), "p" if i % 2 else "q") for i in range(400)] + [(900, "123 456", "p")]
    got = langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows}
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in got)
    assert sum(x.lang_pred == truth[x.doc_id] for x in got if x.doc_id < 900) >= 390
    assert [x.lang_pred for x in got if x.doc_id == 900] == ["und"]


def test_pipeline_stages_chain(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {x.doc_id for x in quality.judged(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert {x.doc_id for x in first.collect()} == kept
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {x.doc_id for x in out.select("doc_id").collect()} <= kept


def test_lines_fold_only_a_to_z(spark):
    texts = ["École ÉTÉ Ünï xy zz", "école été ünï xy zz", "ÉCOLE ÉTÉ ÜNÏ xy zz", "École ÉTÉ Ünï XY ZZ", "界 世 a", "界 世 A"]
    found = lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 1}


def test_near_copies_at_jaccard_four_fifths_go(spark):
    from tandemline.llm import jaccard

    r = random.Random(11)
    base = [[f"v{r.randrange(5000)}" for _ in range(r.randint(30, 120))] for _ in range(25)]
    passage = [f"common{i}" for i in range(20)]
    rows = []
    for i in range(240):
        w = list(base[i % 25])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w + passage * (i % 3 == 0))))
    rows += [(900, "a b c"), (901, "A  b c"), (902, None), (903, " "), (904, "a b c a b c a b c a b c"), (905, "a b c a b c a b c")]

    def five(t):
        w = words((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, marks = {i: five(t) for i, t in rows}, {i: simhash.fingerprint(t, 5) for i, t in rows}
    low = {i: i for i in sets}
    joined = [(a, b) for a, b in itertools.combinations(sets, 2)
              if (marks[a] ^ marks[b]).bit_count() <= 2 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    assert any((marks[a] ^ marks[b]).bit_count() > 2 for a, b in joined)
    for _ in rows:
        for a, b in joined:
            low[a] = low[b] = min(low[a], low[b])
    for bucket, sample in ((jaccard.PAIR_BUCKET, jaccard.SAMPLE), (1, 1)):
        old = jaccard.PAIR_BUCKET, jaccard.SAMPLE
        jaccard.PAIR_BUCKET, jaccard.SAMPLE = bucket, sample
        try:
            got = {x.doc_id for x in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        finally:
            jaccard.PAIR_BUCKET, jaccard.SAMPLE = old
        assert got == set(low.values())


def test_one_word_lines_under_a_frequent_word(spark):
    text = ["share this", "share\nha ho", "share\r\nha ha", "Share \nother words here", "share share", "ha ha ha", "ha", "ho", "ho\t"]
    rows = list(enumerate(text))
    old = lines.PAIR_BUCKET, lines.PROBE_BUCKET
    lines.PAIR_BUCKET, lines.PROBE_BUCKET = 1, 1
    try:
        got = {x.doc_id: x.text for x in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        lines.PAIR_BUCKET, lines.PROBE_BUCKET = old
    assert got == {0: "share this", 1: "share\nha ho", 2: "ha ha", 3: "other words here", 4: "", 5: "", 6: "", 7: "ho", 8: ""}


def test_toxicity_matches_soon_after_a_long_reading():
    m, fill = toxicity.Matcher([]), "abcdefgh " * 45
    at = dict(zip(toxicity.READINGS, m(f"what a clown {fill}")))
    # the first reading ends some words before the second match, in the same clause
    for cut in range(30):
        text = "clown " + "abcdefgh " * (40 + cut // 3) + "abc " * (cut % 3) + "you are an idiot and you are not an idiot"
        got = dict(zip(toxicity.READINGS, m(text)))
        assert got == {**at, "aimed insult": 1, "negated insult": 1}
