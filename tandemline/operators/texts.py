"""Key paths of JSON documents and containment of one text's beginning in others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: Items of an array that are looked into.
SAMPLED = 3
#: Characters of a needle that are looked for.
HEAD = 40
#: Whole words of a needle that make an anchor.
ANCHOR = 3


def profile_json(df: DataFrame, col: str, kind: str) -> DataFrame:
    """(kind, path, n): documents of each kind that have a key path; null and unreadable documents have none.

    Keys are joined by dots, arrays add ``[]`` and are looked into at their first three items. Every round opens one level
    of what is left as VARIANT values and goes on with objects and arrays alone.
    """
    docs = df.select(F.col(kind).alias("kind"), F.expr("uuid()").alias("doc"), F.try_parse_json(col).alias("v")).filter("v is not null")
    level, found = cut_lineage(docs.select("kind", "doc", F.lit("").alias("path"), F.to_json("v").alias("j"))), []
    while not level.isEmpty():
        level.createOrReplaceTempView("__profile_level")
        opened = df.sparkSession.sql(
            f"""SELECT kind, doc, key IS NOT NULL AS named, CASE WHEN key IS NULL THEN path || '[]' WHEN path = '' THEN key ELSE path || '.' || key END AS path,
            to_json(value) AS j, schema_of_variant(value) AS t FROM __profile_level, LATERAL variant_explode(parse_json(j)) WHERE key IS NOT NULL OR pos < {SAMPLED}"""
        )
        opened = cut_lineage(opened)
        found.append(opened.filter("named").select("kind", "doc", "path"))
        level = opened.filter("t LIKE 'OBJECT%' OR t LIKE 'ARRAY%'").select("kind", "doc", "path", "j")
    if not found:
        return docs.select("kind", F.lit("").alias("path"), F.lit(0).cast("long").alias("n")).limit(0)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.distinct().groupBy("kind", "path").agg(F.count(F.lit(1)).alias("n"))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array())


def _stretches(c: Column, k: int) -> Column:
    return F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array())


def _keyed(grams: Column, k: int) -> Column:
    return F.transform(grams, lambda g: F.struct(F.lit(k).alias("__k"), g.alias("__key")))


def containment(needles: DataFrame, texts: DataFrame, nid: str, tid: str, needle: str, text: str) -> DataFrame:
    """(nid, tid): texts that hold the first ``HEAD`` characters of a needle. Both columns are normalised: words of
    letters and digits, one blank between them. An empty needle is held by none.

    A text that holds the head holds the head's inner words as whole words, so runs of up to ``ANCHOR`` inner words are
    the join keys, and only what they bring together is searched. Heads with a single blank or none have no inner word:
    their key is a stretch of characters, compared with every stretch of that length.
    """
    n = needles.select(nid, F.substring(needle, 1, HEAD).alias("__head")).filter("__head <> ''")
    inner = F.split("__head", " ")
    inner = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    inner = F.filter(inner, lambda w: w != "")
    n = n.withColumn("__k", F.least(F.size(inner), F.lit(ANCHOR))).withColumn("__key", F.array_join(F.slice(inner, 1, ANCHOR), " "))
    short = F.least(F.length("__head"), F.lit(8))
    n = n.withColumn("__key", F.when(F.col("__k") == 0, F.substring(F.col("__head"), 1, 8)).otherwise(F.col("__key"))).withColumn("__k", F.when(F.col("__k") == 0, -short).otherwise(F.col("__k")))
    sizes = [r["__k"] for r in n.select("__k").distinct().collect()]  # at most 3 + 8 numbers
    # a generator keeps the text and its words from being computed again for every element
    x = texts.select(tid, F.explode(F.array(F.col(text))).alias("__text")).filter("__text <> ''")
    x = x.select(tid, "__text", F.explode(F.array(_words(F.col("__text")))).alias("__w"))
    keys = [_keyed(F.array_distinct(_grams(F.col("__w"), k) if k > 0 else _stretches(F.col("__text"), -k)), k) for k in sizes]
    if not keys:
        return n.select(nid).crossJoin(x.select(tid)).limit(0)
    held = x.select(tid, F.explode(F.concat(*keys)).alias("__g")).select(tid, "__g.__k", "__g.__key").join(n.select("__k", "__key").distinct(), ["__k", "__key"], "left_semi")
    pairs = held.join(n, ["__k", "__key"]).select(nid, tid, "__head")
    return pairs.join(x.select(tid, "__text"), tid).filter(F.contains("__text", "__head")).select(nid, tid)


def text_agreement(df: DataFrame, by: list[str], ref: str, hyp: str) -> DataFrame:
    """Share of pairs whose texts are equal, and the mean and least similarity of the others; per group.

    Both columns are normalised; a null counts as empty. Similarity is 1 - edits / length of the longer text, by
    characters, not the share of matching blocks. Meant for utterances: the edit table grows with the product of the lengths.
    """
    a, b = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    sim = F.when(a != b, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    return df.select(*by, (a == b).alias("__same"), sim.alias("__sim")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("__same").alias("n_equal"), F.avg(F.col("__same").cast("double")).alias("share_equal"),
        F.avg("__sim").alias("mean_similarity"), F.min("__sim").alias("least_similarity"))


def provenance(a: DataFrame, b: DataFrame, by: list[str], key: str, turn: str, text: str) -> DataFrame:
    """Per group of ``a``'s dialogues: how many ids ``b`` has, and of those with as many turns, all turns or the first turn equal.

    Turns are compared by their own text (null as empty) in one full join on (id, turn); a dialogue is never put together.
    A first turn is the lowest number that the dialogue has in ``a``.
    """
    x = a.select(*by, key, turn, F.coalesce(text, F.lit("")).alias("__x"))
    y = b.select(key, turn, F.coalesce(text, F.lit("")).alias("__y"))
    j = x.join(y, [key, turn], "full")
    same = F.coalesce(F.col("__x") == F.col("__y"), F.lit(False))
    d = j.groupBy(key).agg(
        *[F.max(c).alias(c) for c in by], F.count("__x").alias("na"), F.count("__y").alias("nb"), F.count_if(same).alias("same"),
        F.min_by(same, F.when(F.col("__x").isNotNull(), F.col(turn))).alias("first")).filter("na > 0")
    yes = lambda c: F.count_if(F.expr(c))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), yes("nb > 0").alias("found"), yes("na = nb").alias("same_turns"),
        yes("na = nb and same = na").alias("all_equal"), yes("nb > 0 and first").alias("first_equal"))
