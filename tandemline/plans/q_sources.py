"""Gates, parsers, sinks' rows, profiles and containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keyed import u, u_sql
from ..operators import gates as Q, texts as T
from ..operators.scan import n_parts
from ..sources import parsers as P, writers as W
from .catalog import query
from .fixtures import ARMS, SEEDS, Tables, chunk_name
from .q_matching import r6
from .q_resample import CATS

HALF = lambda t: (t.counts.filter("chunk % 2 = 0 OR chunk % 97 = 1"), t.counts.filter("chunk % 2 = 1 AND chunk % 89 <> 3"))
HALF_SQL = "a AS (SELECT * FROM counts WHERE chunk % 2 = 0 OR chunk % 97 = 1), b AS (SELECT * FROM counts WHERE chunk % 2 = 1 AND chunk % 89 <> 3), ids AS (SELECT chunk FROM wide WHERE chunk % 101 <> 5)"


@query(
    "b04_merge_faults", "counts wide",
    f"""WITH {HALF_SQL}, u AS (SELECT arm, seed, chunk, count(*) AS n FROM (SELECT arm, seed, chunk FROM a UNION ALL SELECT arm, seed, chunk FROM b) GROUP BY ALL)
 SELECT 'repeated' AS fault, arm, seed, chunk FROM u WHERE n > 1 UNION ALL SELECT 'unlisted', arm, seed, chunk FROM u WHERE chunk NOT IN (SELECT chunk FROM ids)
 UNION ALL SELECT 'missing', g.arm, g.seed, ids.chunk FROM (SELECT DISTINCT arm, seed FROM u) g, ids WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.arm = g.arm AND u.seed = g.seed AND u.chunk = ids.chunk)""",
)
def b04_faults(t: Tables):
    a, b = HALF(t)
    return Q.merge_faults(a, b, t.wide.filter("chunk % 101 <> 5").select("chunk"), "chunk", ["arm", "seed"])


@query("b04_merge_sets", "counts", "SELECT arm, seed, chunk, tp, fp, n_gt FROM counts")
def b04(t: Tables):
    c = t.counts.select("arm", "seed", "chunk", "tp", "fp", "n_gt")
    return Q.merge_sets(c.filter("chunk % 2 = 0"), c.filter("chunk % 2 = 1"), t.wide.select("chunk"), "chunk", ["arm", "seed"])


_AGG = "SELECT arm, seed, sum(tp) AS tp, sum(fp) AS fp, sum(n_gt) AS n_gt, count(*) AS n_chunks FROM counts GROUP BY 1, 2"


@query(
    "b04_aggregate_faults", "counts",
    f"WITH g AS ({_AGG}) SELECT arm, seed, 'tp' AS field, tp + 1.0 AS stored, CAST(tp AS DOUBLE) AS recomputed FROM g WHERE seed = 3 UNION ALL SELECT arm, seed, 'n_chunks', n_chunks - 2.0, CAST(n_chunks AS DOUBLE) FROM g WHERE arm = 'F' AND seed = 5".replace("tp + 1.0", "CAST(tp + 1 AS DOUBLE)").replace("n_chunks - 2.0", "CAST(n_chunks - 2 AS DOUBLE)"),
)
def b04_aggregates(t: Tables):
    g = Q.recomputed(t.counts, ["arm", "seed"])
    stored = g.withColumn("tp", F.col("tp") + F.when(F.col("seed") == 3, 1).otherwise(0)).withColumn("n_chunks", F.col("n_chunks") - F.when((F.col("arm") == "F") & (F.col("seed") == 5), 2).otherwise(0))
    return Q.aggregate_faults(stored, t.counts, ["arm", "seed"])


@query("b05_missing_cells", "margins", "SELECT arm, seed FROM (VALUES ('F'), ('O'), ('X')) a(arm), range(8) s(seed) EXCEPT SELECT arm, seed FROM margins")
def b05_missing(t: Tables):
    return Q.missing_cells(t.margins, [*ARMS, "X"], [*SEEDS, 7])


@query("b05_assert_complete", "margins", "SELECT arm, seed, count(*) AS n FROM margins GROUP BY 1, 2")
def b05(t: Tables):
    return Q.assert_complete(t.margins.groupBy("arm", "seed").agg(F.count(F.lit(1)).alias("n")), ARMS, SEEDS)


@query(
    "b03_rebuild", "",
    "SELECT o_orderkey, CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'missing' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey, l_returnflag HAVING max(l_quantity) > 49) THEN 'error' ELSE 'ok' END AS status FROM orders",
)
def b03(t: Tables):
    side = lambda f: t.table("lineitem").filter(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.max("l_quantity") > 49, "long").alias("error"))
    return Q.rebuild(t.table("orders").select("o_orderkey"), "o_orderkey", side("A"), side("R"))


@query("b06_arm_parity", "", "SELECT count(*) AS n_a, count(*) FILTER (o_orderkey % 50 <> 0) AS n_b, count(*) FILTER (o_orderkey % 50 <> 0 AND o_orderkey % 7 = 0) AS diff_answer, 0 AS diff_cid, count(*) FILTER (o_orderkey % 50 <> 0 AND o_custkey % 3 = 0) AS same_payload FROM orders")
def b06(t: Tables):
    a = t.table("orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("cid"), F.col("o_orderpriority").alias("answer"), F.col("o_custkey").alias("payload"))
    b = a.filter("pos % 50 <> 0").withColumn("answer", F.when(F.col("pos") % 7 == 0, "changed").otherwise(F.col("answer"))).withColumn("payload", F.when(F.col("payload") % 3 == 0, F.col("payload")).otherwise(-F.col("payload")))
    return Q.arm_parity(a, b, "pos", ["cid", "answer"], "payload")


@query("b07_rebuild_from_frozen", "", "SELECT c_custkey AS cid, c_mktsegment AS answer, c_custkey AS pos, n.total FROM customer JOIN (SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1) n ON n.o_custkey = c_custkey")
def b07(t: Tables):
    payload = t.table("orders").groupBy(F.col("o_custkey").alias("cid")).agg(F.count(F.lit(1)).alias("total"))
    frozen = t.table("customer").select(F.col("c_custkey").alias("cid"), F.col("c_mktsegment").alias("answer"), F.col("c_custkey").alias("pos")).join(payload.select("cid"), "cid", "left_semi")
    return Q.rebuild_from_frozen(frozen, payload, "cid", "pos")


def CENTS_SQL(x: str) -> str:
    """Hundredths of a non-negative double, half to even, from its decimal text; round_even multiplies in binary first."""
    n = f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 10)) * 10000000000 AS BIGINT)"
    return f"({n} // 100000000 + CASE WHEN {n} % 100000000 > 50000000 OR ({n} % 100000000 = 50000000 AND {n} // 100000000 % 2 = 1) THEN 1 ELSE 0 END)"


@query(
    "b13_attach_by_time", "seg",
    f"WITH e AS (SELECT event_id, session, ch, {CENTS_SQL('s')} AS t FROM seg), x AS (SELECT session, ch, {CENTS_SQL('(s + ((event_id % 3) - 1) * 0.003)')} AS t, s + ((event_id % 3) - 1) * 0.003 AS s, 'text ' || event_id AS text FROM seg), f AS (SELECT session, ch, t, arg_min(text, (s, text)) AS text FROM x GROUP BY 1, 2, 3) SELECT event_id, f.text FROM e LEFT JOIN f ON f.session = e.session AND f.ch = e.ch AND f.t = e.t",
)
def b13(t: Tables):
    texts = t.seg.select("session", "ch", (F.col("s") + ((F.col("event_id") % 3) - 1) * F.lit(0.003)).alias("s"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"))
    return Q.attach_by_time(t.seg.select("event_id", "session", "ch", "s"), texts, ["session", "ch"], "s").select("event_id", "text")


@query("a08_line_transcripts", "utts", "SELECT conv_id, CAST(turn * 2.5 AS DOUBLE) AS start, CAST(turn * 2.5 + n_words AS DOUBLE) AS \"end\", CASE WHEN speaker = 0 THEN 'A' ELSE 'B' END AS side, 'words ' || n_words AS text FROM utts")
def a08(t: Tables):
    line = F.format_string("%.2f %.2f %s: words %d", F.col("turn") * F.lit(2.5), F.col("turn") * F.lit(2.5) + F.col("n_words"), F.when(F.col("speaker") == 0, "A").otherwise("B"), F.col("n_words"))
    lines = t.utts.select("conv_id", F.explode(F.array(F.lit("# file"), F.lit(""), line)).alias("value"))
    return P.line_transcripts(lines)


@query("a04_frames", "frames", "SELECT session, idx // 64 AS block, ch, idx % 64 AS label, t0, t1, round(p, 6) AS p_bc FROM frames")
def a04(t: Tables):
    cell = F.array(F.col("t0").cast("string"), F.col("t1").cast("string"), (F.col("idx") % 64).cast("string"), F.col("p").cast("string"), F.lit("0"))
    doc = t.frames.groupBy("session", "ch", F.expr("idx div 64").alias("block")).agg(F.collect_list(cell).alias("f"))
    value = F.to_json(F.struct(F.create_map(F.col("ch").cast("string"), F.struct(F.col("f").alias("frames"))).alias("channels")))
    x = P.frames(doc.select("session", "block", value.alias("value")), ["session", "block"])
    return x.select("session", "block", "ch", F.col("label").cast("long").alias("label"), "t0", "t1", F.round("p_bc", 6).alias("p_bc"))


@query("a05_states", "chunks", "SELECT chunk, session, ch, k AS pos, CAST(t0 + k * 0.5 AS DOUBLE) AS a, CAST(t0 + k * 0.5 + 0.5 AS DOUBLE) AS b, CASE WHEN (n_frames + k) % 2 = 0 THEN 'speak' ELSE 'idle' END AS state FROM chunks, range(3) r(k)")
def a05(t: Tables):
    blocks = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(F.array(k * F.lit(0.5), k * F.lit(0.5) + 0.5).alias("timestamp"), F.when((F.col("n_frames") + k) % 2 == 0, "speak").otherwise("idle").alias("state")))
    return P.states(t.chunks.select("chunk", F.to_json(blocks).alias("value")), t.chunks.select("chunk", "session", "ch", F.col("t0").cast("double").alias("t0")), "chunk")


@query("a06_vote_slots", "slots", "SELECT CAST(slot AS VARCHAR) AS example_id, k AS turn, 0 AS slot, m, silent, CASE WHEN k = 0 THEN backchannel ELSE 0 END AS backchannel, take_floor FROM slots, range(2) r(k)")
def a06(t: Tables):
    full = F.create_map(*[x for c in CATS for x in (F.lit(c), F.col(c))])
    less = F.create_map(F.lit("silent"), F.col("silent"), F.lit("take_floor"), F.col("take_floor"))
    turn = lambda c: F.struct(F.lit("text").alias("content"), F.array(F.struct(F.col("m").alias("total_count"), c.alias("counts"))).alias("boundaries"))
    docs = t.slots.select(F.to_json(F.struct(F.col("slot").cast("string").alias("example_id"), F.array(turn(full), turn(less)).alias("history"))).alias("value"))
    return P.vote_slots(docs, CATS)


@query("a09_eval_results", "counts", "SELECT arm, CASE WHEN seed = 0 THEN 42 ELSE seed END AS seed, 'e4' AS \"set\", CAST(chunk AS VARCHAR) AS chunk, tp, fp, n_gt, n_pred FROM counts")
def a09(t: Tables):
    name = F.concat(F.lit("/x/g1_eval_"), F.col("arm"), F.when(F.col("seed") == 0, "").otherwise(F.concat(F.lit("_s"), F.col("seed").cast("string"))), F.lit("_e4.json"))
    entry = F.create_map(F.col("chunk").cast("string"), F.struct("tp", "fp", "n_gt", "n_pred"))
    docs = t.counts.select(name.alias("path"), F.to_json(F.struct(entry.alias("per_chunk"))).alias("value"))
    return P.eval_results(docs).select("arm", "seed", "set", "chunk", "tp", "fp", "n_gt", "n_pred")


@query("a11_inventory", "", "WITH n AS (SELECT page_id // 3 AS stem, ['wav', 'json', 'txt'][page_id % 3 + 1] AS kind FROM pages WHERE page_id % 7 <> 0), g AS (SELECT stem, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds FROM n GROUP BY 1) SELECT kinds, count(*) AS n FROM g GROUP BY 1")
def a11(t: Tables):
    kind = F.element_at(F.array(F.lit("wav"), F.lit("json"), F.lit("TXT")), (F.col("page_id") % 3 + 1).cast("int"))
    name = F.concat(F.lit("d/clean_"), F.expr("page_id div 3").cast("string"), F.when(F.col("page_id") % 3 == 1, "_add").otherwise(""), F.lit("."), kind)
    return P.kinds_together(P.inventory_names(t.table("pages").filter("page_id % 7 <> 0").select(name.alias("name")), "name"))


@query(
    "a10_profile_nested", "",
    """WITH j AS (SELECT role AS kind, conv_id * 1000 + turn AS d, '{"id":' || conv_id || ',"turns":[{"role":"x","n":1},{"text":"x","more":[{"deep":1}]},{"n":[]},{"late":3}],"meta":{"turn":' || turn || CASE WHEN turn % 2 = 0 THEN ',"tag":{"a":[[{"b":null}]]}}}' ELSE ',"tag":null}}' END AS j FROM conversations),
 t AS (SELECT kind, d, fullkey, key, path FROM j, json_tree(CAST(j.j AS JSON)) x WHERE x.key IS NOT NULL AND NOT regexp_matches(x.fullkey, '\\[([3-9]|[0-9]{2,})\\]') AND NOT regexp_matches(x.fullkey, '\\]$'))
 SELECT kind, path, count(*) AS n FROM (SELECT DISTINCT kind, d, regexp_replace(substr(fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') AS path FROM t) GROUP BY 1, 2""",
)
def a10_nested(t: Tables):
    tag = F.when(F.col("turn") % 2 == 0, '{"a":[[{"b":null}]]}').otherwise("null")
    doc = F.format_string('{"id":%d,"turns":[{"role":"x","n":1},{"text":"x","more":[{"deep":1}]},{"n":[]},{"late":3}],"meta":{"turn":%d,"tag":%s}}', "conv_id", "turn", tag)
    return T.profile_json(t.table("conversations").select("role", doc.alias("doc")), "doc", "role")


_DLG = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '\\[[a-z_]+\\]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("h02_containment", "", f"WITH b AS (SELECT item_id, left({_DLG('text')}, 40) AS h FROM benchmark), d AS (SELECT doc_id, {_DLG('text')} AS x FROM documents) SELECT item_id, doc_id FROM b, d WHERE h <> '' AND contains(x, h)")
def h02(t: Tables):
    norm = X.norm_dialogue(F.col("text")).alias("x")
    return T.containment(t.table("benchmark").select("item_id", norm), t.table("documents").select("doc_id", norm), "item_id", "doc_id", "x", "x")


@query(
    "a13_sft_rows", "windows chunks",
    f"""WITH x AS (SELECT c.chunk, CAST(round((w.a - c.t0) * 10) AS BIGINT) AS d, w.wid, CAST(floor({u_sql(13, 'w.wid')} * 100) AS BIGINT) AS p FROM chunks c JOIN windows w ON w.session = c.session AND w.ch = c.ch AND w.a >= c.t0 AND w.a < c.t0 + 10 WHERE w.realized <> 'None'),
 s AS (SELECT chunk, string_agg((d // 10) || '.' || (d % 10) || 's (' || (p // 100) || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') || ')', ', ' ORDER BY d, wid) AS answer FROM x GROUP BY 1), a AS (SELECT chunk, coalesce(answer, 'no backchannel') AS answer FROM chunks LEFT JOIN s USING (chunk))
 SELECT chunk, answer, '{{"system":"","messages":[{{"role":"user","content":"{W.AUDIO_TURN}When?"}},{{"role":"assistant","content":"' || answer || '"}}],"audio":"{{\\"path\\":\\"wavs/' || chunk || '.wav\\",\\"ref_path\\":\\"\\",\\"ref_text\\":\\"\\",\\"text\\":\\"\\",\\"token\\":\\"{W.AUDIO_PAD * 250}\\"}}"}}' AS line FROM a""",
)
def a13(t: Tables):
    """Windows are laid to the chunks as rows of one grouping, dealt by session like the runs; chunks are not shuffled."""
    n = n_parts(t.spark)
    g = (F.floor(F.col("a") / 5) * 5).cast("long")
    w = t.windows.dropna(subset=["session", "ch"]).filter("realized <> 'None'").repartition(n, "session").select("session", "ch", "wid", "a", F.explode(F.array(g, g - 5)).alias("t0"))
    d = F.round((F.col("a") - F.col("t0")) * 10).cast("long")
    item = F.struct(d.alias("d"), "wid", (F.floor(u(13, "wid") * 100).cast("double") / 100).alias("p"))
    w = w.select("session", "ch", "t0", F.lit(0).cast("long").alias("n_frames"), item.alias("x"))
    both = t.chunk_rows.select("session", "ch", "t0", "n_frames", F.lit(None).cast(w.schema["x"].dataType).alias("x")).unionByName(w)
    rows = both.groupBy("session", "ch", "t0").agg(F.sum("n_frames").alias("n_frames"), F.sort_array(F.collect_list("x")).alias("x")).filter("n_frames >= 5")
    times = F.transform("x", lambda x: F.struct((x.d / 10).alias("t"), x.p.alias("p")))
    a = rows.select(chunk_name().alias("chunk"), X.format_times(times).alias("answer"))
    return a.select("chunk", "answer", W.chat_line(F.lit("When?"), F.col("answer"), F.concat(F.lit("wavs/"), F.col("chunk"), F.lit(".wav")), 10.0).alias("line"))


@query("a14_positions", "", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS shard FROM orders")
def a14_positions(t: Tables):
    return W.positions(t.table("orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", (F.col("pos") % 7).alias("shard"))


#: DuckDB counts edits in bytes, so its twin writes each letter of Latin-1 beyond ASCII as one sign that texts no longer hold.
_LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&"
_ALNUM = lambda c: f"translate(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '{_LATIN[0]}', '{_LATIN[1]}')"


@query(
    "h04_text_agreement", "utts words",
    f"""WITH h AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY pos) AS hyp FROM words GROUP BY 1, 2), p AS (SELECT speaker, {_ALNUM('text')} AS a, coalesce({_ALNUM('hyp')}, '') AS b FROM utts LEFT JOIN h USING (conv_id, turn)),
 s AS (SELECT speaker, a = b AS eq, CASE WHEN a <> b THEN 1 - levenshtein(a, b) / greatest(length(a), length(b)) END AS sim FROM p)
 SELECT speaker, count(*) AS n, count(*) FILTER (eq) AS n_equal, round(avg(eq::INT), 6) AS share_equal, round(avg(sim), 6) AS mean_similarity, round(min(sim), 6) AS least_similarity FROM s GROUP BY 1""",
)
def h04(t: Tables):
    """Each turn's text against its words as heard."""
    said = F.array_sort(F.collect_list(F.struct("pos", "word")))  # words of one turn
    h = t.words.groupBy("conv_id", "turn").agg(F.array_join(F.transform(said, lambda r: r.word), " ").alias("hyp"))
    d = t.utts.join(h, ["conv_id", "turn"], "left").select("speaker", X.norm_alnum(F.col("text")).alias("a"), X.norm_alnum(F.col("hyp")).alias("b"))
    return r6(T.text_agreement(d, ["speaker"], "a", "b"), "share_equal", "mean_similarity", "least_similarity")


@query(
    "h03_provenance", "utts",
    f"""WITH a AS (SELECT conv_id, turn, conv_id % 3 AS scenario, CASE WHEN conv_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, {_DLG('text')} AS x FROM utts),
 b AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 AND turn % 3 = 2 THEN x || ' again' WHEN conv_id % 6 = 2 AND turn < 2 THEN '' ELSE x END AS y FROM a WHERE conv_id % 7 <> 3 AND NOT (conv_id % 8 = 5 AND turn > 3)),
 na AS (SELECT conv_id, any_value(scenario) AS scenario, any_value(split) AS split, count(*) AS na, min(turn) AS t0 FROM a GROUP BY 1), nb AS (SELECT conv_id, count(*) AS nb FROM b GROUP BY 1),
 sm AS (SELECT a.conv_id, count(*) AS same, min(a.turn) AS s0 FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND x = y GROUP BY 1)
 SELECT scenario, split, count(*) AS n, count(nb) AS found, count(*) FILTER (na = nb) AS same_turns, count(*) FILTER (na = nb AND same = na) AS all_equal, count(*) FILTER (s0 = t0) AS first_equal FROM na LEFT JOIN nb USING (conv_id) LEFT JOIN sm USING (conv_id) GROUP BY 1, 2""",
)
def h03(t: Tables):
    """Dialogues against a copy that lacks some, cuts some short and rewrites turns of others."""
    c, k = F.col("conv_id"), F.col("turn")
    a = t.utts.select("conv_id", "turn", (c % 3).alias("scenario"), F.when(c % 5 == 0, "test").otherwise("train").alias("split"), X.norm_dialogue(F.col("text")).alias("x"))
    y = F.when((c % 4 == 1) & (k % 3 == 2), F.concat("x", F.lit(" again"))).when((c % 6 == 2) & (k < 2), "").otherwise(F.col("x"))
    b = a.filter((c % 7 != 3) & ~((c % 8 == 5) & (k > 3))).select("conv_id", "turn", y.alias("x"))
    return T.provenance(a, b, ["scenario", "split"], "conv_id", "turn", "x")
