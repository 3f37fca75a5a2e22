"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lines, mixing, periods, phrases, pieces, pseudonyms, quality, quality_cnn, sharding, simhash, topk, toxicity

#: Production parameters.
SHARD_BYTES = 1 << 20
#: Setting that holds the secret key of pseudonyms; without it every query takes a random one of its own.
PSEUDONYM_KEY = "spark.tandemline.pseudonym.key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Path of the public SentencePiece model on this machine; the executors hold it at the same place."""
    import public_tokenizers

    return os.environ.get("PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), piece_model())


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"))  # the stated query set
    return topk.top_products(vectors, queries)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PSEUDONYM_KEY, None)
    return pseudonyms.private(table(spark, sf_dir, "documents"), key.encode()[:64] if key else secrets.token_bytes(32))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digested(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_language, op3_toxicity, op4_quality_rules, op5_simhash, op6_pieces,
                                   op7_top_products, op8_mixing, op9_pseudonyms, op10_sharding, op11_collocations,
                                   op12_quality_cnn, op13_periods)}

_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    # every pair that reaches 4/5 shares one of the rarest tokens of both lines
    "op1_line_dedup": f"""
WITH l AS (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
d AS (SELECT line, list_distinct(regexp_extract_all({_LOWER.format('line')}, '[^\\x20\\x09-\\x0D]+')) AS t, min((doc_id, pos)) AS f FROM l GROUP BY line),
s AS (SELECT t.*, len(t) AS n FROM (SELECT list_sort(t) AS t, min(f) AS f FROM d WHERE len(t) > 0 GROUP BY list_sort(t)) AS t),
w AS (SELECT f, n, unnest(t) AS w FROM s),
c AS (SELECT w, count(*) AS c FROM w GROUP BY w),
p AS (SELECT f, n, w FROM (SELECT f, n, w.w, row_number() OVER (PARTITION BY f ORDER BY c, w.w) AS k FROM w JOIN c ON w.w = c.w)
      WHERE k <= n - (4 * n + 4) // 5 + 1),
q AS (SELECT DISTINCT x.f AS xf, y.f AS yf FROM p AS x JOIN p AS y ON x.w = y.w AND y.f < x.f AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
m AS (SELECT DISTINCT xf FROM q JOIN s AS a ON a.f = xf JOIN s AS b ON b.f = yf
      WHERE 5 * len(list_intersect(a.t, b.t)) >= 4 * (a.n + b.n - len(list_intersect(a.t, b.t)))),
k AS (SELECT l.doc_id, l.pos, line, line NOT SIMILAR TO '.*[^\\x20\\x09-\\x0D].*' OR ((l.doc_id, l.pos) IN (SELECT f FROM s) AND (l.doc_id, l.pos) NOT IN (SELECT xf FROM m)) AS stays FROM l)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text, count(*)::INT AS n_lines, (count(*) FILTER (WHERE NOT stays))::INT AS n_removed
FROM k GROUP BY doc_id UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL""",
    "op7_top_products": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p) WHERE rank <= 10""",
    "op8_mixing": f"""
WITH RECURSIVE r AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source)),
lvl AS (SELECT 0 AS i, (SELECT 3 * sum(source_size) FROM s)::HUGEINT AS top, (SELECT 2 * sum(w) FROM s)::HUGEINT AS down
        UNION ALL
        SELECT i + 1, (SELECT 3 * sum(source_size) - 4 * coalesce(sum(source_size) FILTER (WHERE w * top > 2 * source_size * down), 0) FROM s)::HUGEINT,
               (SELECT 2 * sum(w) FILTER (WHERE w * top <= 2 * source_size * down) FROM s)::HUGEINT FROM lvl WHERE i < 40),
z AS (SELECT top, down FROM lvl ORDER BY i DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN w * top > 2 * source_size * down THEN 2.0::DOUBLE * source_size ELSE w * top::DOUBLE / down::DOUBLE END AS target FROM s, z),
u AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
             sum(size) OVER (PARTITION BY r.source ORDER BY h) AS run FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN run <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM u""",
    "op10_sharding": f"""
WITH RECURSIVE r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
       lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || text, '')), 1, 14))::BIGINT), 56, '0') AS bits FROM documents),
b AS (SELECT 0 AS depth, doc_id, bytes, bits, sum(bytes) OVER () AS shard_bytes, count(*) OVER () AS shard_rows FROM r
      UNION ALL
      SELECT depth + 1, doc_id, bytes, bits, sum(bytes) OVER (PARTITION BY left(bits, depth + 1)), count(*) OVER (PARTITION BY left(bits, depth + 1))
      FROM b WHERE shard_bytes > {SHARD_BYTES} AND shard_rows > 1)
SELECT doc_id, bytes, left(bits, depth) AS shard, depth, shard_bytes::BIGINT AS shard_bytes, shard_rows FROM b WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1""",
    "op11_collocations": f"""
WITH p AS (SELECT coalesce(lang,'und') AS lang, i, unnest(string_split_regex({_LOWER.format('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (SELECT lang, text, row_number() OVER () AS i FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[j:j+k-1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w)-k+2)) AS j FROM w, (VALUES (1),(2),(3)) v(k)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k=1 GROUP BY 1),
q AS (SELECT * FROM g WHERE f>=10),
c AS (SELECT lang, phrase, k, f AS a, cut, array_to_string(string_split(phrase,' ')[1:cut],' ') AS x, array_to_string(string_split(phrase,' ')[cut+1:],' ') AS y FROM q, (VALUES (1),(2)) v(cut) WHERE k>1 AND cut<k),
s AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, l.f AS l, r.f AS r, (1000000::HUGEINT*c.a*c.a // (l.f::HUGEINT*r.f))::BIGINT AS score FROM c JOIN q AS l ON l.lang=c.lang AND l.phrase=x JOIN q AS r ON r.lang=c.lang AND r.phrase=y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut)=1),
t AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase,' ')[1:2],' '), array_to_string(string_split(phrase,' ')[2:3],' ')]) AS phrase FROM q WHERE k=3) GROUP BY 1,2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b LEFT JOIN t USING (lang, phrase) JOIN n USING (lang) WHERE t.f IS NULL OR 100*t.f < 50*a QUALIFY rank <= 2000""",
}
