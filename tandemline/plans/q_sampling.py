"""Set construction, cleaning and text-join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keyed import u, u_sql
from ..operators import sampling as G
from .catalog import query
from .fixtures import Tables
from .q_frames import SC
from .q_intervals import R6


def used_cands(t: Tables):
    c = t.chunks.withColumn("t0", F.col("t0").cast("double"))
    return c.filter(u(71, "chunk") < 0.05), c


@query("g00_keyed_random", "", f"SELECT event_id, round({u_sql(9, 'event_id', 'event_type')}, 9) AS u FROM events")
def g00(t: Tables):
    return t.table("events").select("event_id", F.round(u(9, "event_id", "event_type"), 9).alias("u"))


NEAR_SQL = f"us AS (SELECT * FROM chunks WHERE {u_sql(71, 'chunk')} < 0.05)"


@query(
    "g03_exclude_overlapping", "chunks",
    f"WITH {NEAR_SQL} SELECT chunk FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM us WHERE us.session = c.session AND us.ch = c.ch AND abs(us.t0 - c.t0) < 10)",
)
def g03(t: Tables):
    used, c = used_cands(t)
    return G.exclude_overlapping(c, used, SC, "chunk", "t0", 10.0).select("chunk")


@query(
    "g04_round_robin", "chunks",
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY session, ch ORDER BY {u_sql(72, 'chunk')}, chunk) AS rnd FROM chunks), p AS (SELECT chunk, rnd AS round, row_number() OVER (ORDER BY rnd, session, ch) AS pick FROM r) SELECT * FROM p WHERE pick <= 2000",
)
def g04(t: Tables):
    return G.round_robin(t.chunks, SC, 2000, u(72, "chunk"), ["chunk"]).select("chunk", "round", "pick")


@query("g05_split_rounds", "chunks", f"WITH r AS (SELECT session, ch, row_number() OVER (PARTITION BY session, ch ORDER BY {u_sql(72, 'chunk')}, chunk) AS rnd FROM chunks) SELECT (rnd - 1) // 4 AS batch, count(*) AS n, count(DISTINCT (session, ch)) AS n_keys, CAST(count(*) = 4 * (SELECT count(DISTINCT (session, ch)) FROM chunks) AS BIGINT) AS complete FROM r GROUP BY 1")
def g05(t: Tables):
    return G.split_rounds(t.chunks, SC, u(72, "chunk"), ["chunk"], 4)


@query(
    "g06_set_metadata", "wide",
    "SELECT count(*) AS n_chunks, CAST(sum(n_gt) AS BIGINT) AS n_events, count(*) FILTER (n_gt > 0) AS n_pos, round(count(*) FILTER (n_gt > 0) / count(*), 6) AS prevalence, count(DISTINCT session) AS n_sessions, max(n_gt) AS max_events FROM wide",
)
def g06(t: Tables):
    pos = F.count_if(F.col("n_gt") > 0)
    return t.wide.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("n_gt").alias("n_events"), pos.alias("n_pos"), R6(pos / F.count(F.lit(1))).alias("prevalence"), F.countDistinct("session").alias("n_sessions"), F.max("n_gt").alias("max_events")
    )


@query(
    "g08_thin_to_prevalence", "wide",
    f"WITH p AS (SELECT chunk, row_number() OVER (ORDER BY {u_sql(73, 'chunk')}, chunk) AS k FROM wide WHERE n_gt > 0), nn AS (SELECT count(*) AS n FROM wide WHERE n_gt = 0), c AS (SELECT arg_min(k, (abs(k / (k + n) - 0.04), k)) AS cut FROM p, nn) SELECT chunk FROM wide WHERE n_gt = 0 UNION ALL SELECT chunk FROM p, c WHERE k <= cut",
)
def g08(t: Tables):
    return G.thin_to_prevalence(t.wide.select("chunk", "n_gt"), F.col("n_gt") > 0, 0.04, u(73, "chunk"), ["chunk"]).select("chunk")


@query("g10_truncate_balanced", "wide", f"WITH r AS (SELECT chunk, session, row_number() OVER (PARTITION BY session ORDER BY {u_sql(74, 'chunk')}, chunk) AS rn FROM wide) SELECT chunk, session FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM wide GROUP BY session))")
def g10(t: Tables):
    return G.truncate_balanced(t.wide.select("chunk", "session"), "session", u(74, "chunk"), ["chunk"])


@query("g13_flag_adjacent", "chunks", f"WITH {NEAR_SQL} SELECT chunk FROM chunks c WHERE EXISTS (SELECT 1 FROM us WHERE us.session = c.session AND us.ch = c.ch AND abs(us.t0 - c.t0) < 10 AND us.t0 <> c.t0)")
def g13(t: Tables):
    used, c = used_cands(t)
    return G.flag_adjacent(c, used, SC, "t0", 10.0).select("chunk")


@query(
    "b01_dedup_first", "",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1",
)
def b01(t: Tables):
    li = t.table("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_quantity", "l_shipdate")
    return G.dedup_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_quantity"]).drop("l_shipdate")


@query("b02_pending", "", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def b02(t: Tables):
    li = t.table("lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return G.pending(t.table("orders").select(F.col("o_orderkey").alias("k")), "k", li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"))


@query("b08_check_votes", "slots", "SELECT count(*) AS n, count(*) FILTER (silent + backchannel + take_floor <> m) AS n_bad FROM slots")
def b08(t: Tables):
    return t.slots.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("silent + backchannel + take_floor <> m")).alias("n_bad"))


@query("b09_prefix_unique", "", "SELECT substr(c_name, 1, 17) AS prefix, count(DISTINCT c_name) AS n_ids FROM customer GROUP BY 1 HAVING count(DISTINCT c_name) > 1")
def b09(t: Tables):
    return G.check_prefix_unique(t.table("customer"), "c_name", 17)


@query("b10_parse_chunk_id", "chunks", "SELECT chunk, session AS s, ch AS c, t0 AS t FROM chunks")
def b10(t: Tables):
    part = lambda i: F.regexp_extract("chunk", r"^(\d+)_ch(\d+)_t(-?\d+)$", i).cast("long")
    return t.chunks.select("chunk", part(1).alias("s"), part(2).alias("c"), part(3).alias("t"))


@query(
    "b11_normalisers", "",
    r"""SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') AS wer, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS txt,
 trim(regexp_replace(regexp_replace(lower(text), '\[[a-z_]+\]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS dialogue, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS alnum FROM documents""",
)
def b11(t: Tables):
    c = F.col("text")
    return t.table("documents").select("doc_id", X.norm_wer(c).alias("wer"), X.norm_text(c).alias("txt"), X.norm_dialogue(c).alias("dialogue"), X.norm_alnum(c).alias("alnum"))


@query(
    "a12_reconcile", "",
    "WITH l AS (SELECT l_orderkey AS k, count(*) % 3 AS v FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, o_custkey % 3 AS v FROM orders WHERE o_orderstatus <> 'P') SELECT coalesce(l.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'only_left' WHEN l.k IS NULL THEN 'only_right' WHEN l.v <> o.v THEN 'mismatch' ELSE 'same' END AS status FROM l FULL JOIN o ON l.k = o.k",
)
def a12(t: Tables):
    l = t.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.count(F.lit(1)) % 3).alias("v"))
    o = t.table("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).alias("v"))
    return G.reconcile(l, o, "k", "v")


@query("a14_shards", "", f"WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY {u_sql('shard', 'event_id')}, event_id) - 1) % 8 AS shard FROM events) SELECT * FROM r")
def a14(t: Tables):
    return G.write_shards(t.table("events").select("event_id"), 8, u("shard", "event_id"), ["event_id"])


@query(
    "a10_profile_json", "",
    "SELECT event_type AS kind, 'k' AS path, count(*) AS n FROM events WHERE props LIKE '%\"k\"%' GROUP BY 1",
)
def a10(t: Tables):
    keys = F.explode(F.json_object_keys("props"))
    return t.table("events").select(F.col("event_type").alias("kind"), keys.alias("path")).groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"))


@query("h05_tag_notes", "", "SELECT p.tag, d.lang, count(*) AS n FROM documents d, (VALUES ('greeting', 'hello|bonjour|hola'), ('licence', 'licen[cs]e'), ('number', '[0-9]{4}')) p(tag, pat) WHERE regexp_matches(lower(d.text), p.pat) GROUP BY 1, 2")
def h05(t: Tables):
    pats = {"greeting": "hello|bonjour|hola", "licence": "licen[cs]e", "number": "[0-9]{4}"}
    low = F.lower("text")
    tags = F.array_compact(F.array(*[F.when(low.rlike(p), k) for k, p in pats.items()]))
    return t.table("documents").select("lang", F.explode(tags).alias("tag")).groupBy("tag", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h01_join_dialogues", "utts words",
    """WITH h AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY pos) AS txt FROM words GROUP BY 1, 2), n AS (SELECT u.conv_id, trim(regexp_replace(lower(u.text), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(coalesce(h.txt, '')), '[^a-z0-9]+', ' ', 'g')) AS same FROM utts u LEFT JOIN h USING (conv_id, turn))
 SELECT conv_id, count(*) AS n_turns, count(*) FILTER (same) AS n_same, CAST(bool_and(same) AS BIGINT) AS all_same FROM n GROUP BY 1""",
)
def h01(t: Tables):
    h = t.words.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda r: r.word), " ").alias("txt"))
    j = t.utts.join(h, ["conv_id", "turn"], "left")
    same = X.norm_dialogue(F.col("text")) == X.norm_dialogue(F.coalesce("txt", F.lit("")))
    return j.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(same).alias("n_same"), F.min(same.cast("long")).alias("all_same"))
