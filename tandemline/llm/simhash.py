"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, groups."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import saved
from .components import components
from .jaccard import majority, shingles

PARTS = 4  # blocks of 16 bits
DISTANCE = 2
#: Fingerprints that share two blocks are compared pair by pair up to this many; larger buckets are linked by hubs.
PAIR_BUCKET = 64


def fingerprint(text: str | None, width: int) -> int:
    """Bitwise majority of the XXH64 values of all word shingles, as an unsigned number."""
    return majority(shingles(text, width))


def with_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, fp): a hash of the text, and the fingerprint as a signed number; wordless texts get zero."""

    def work(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t, width) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "fp": fp})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInPandas(work, f"doc_id {kind}, th long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join all pairs at ``DISTANCE`` bits or fewer.

    With two differing bits at most, two of four blocks agree: the six pairs of blocks are the join keys, and the
    Hamming distance is checked in the join. In a bucket of more than ``PAIR_BUCKET`` fingerprints each one is listed
    under itself and under its neighbours at one bit among the bits outside the key; two fingerprints meet under a
    value exactly if they differ in two bits or fewer, so linking all of a value to its smallest loses nothing and
    stays linear.
    """
    width = 64 // PARTS
    keys = []
    for i, two in enumerate(combinations(range(PARTS), PARTS - DISTANCE)):
        block = F.lit(0).cast("long")
        for p in two:
            block = block * (1 << width) + F.shiftrightunsigned("fp", p * width).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.struct(F.lit(i).alias("i"), block.alias("key")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.i", "k.key")
    sizes = rows.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = saved(rows.join(sizes, ["i", "key"]))
    few = rows.where(F.col("n") <= PAIR_BUCKET)
    left, right = (few.select("i", "key", F.col("fp").alias(x)) for x in "ab")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = left.join(right, ["i", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    hubs = None
    for i, two in enumerate(combinations(range(PARTS), PARTS - DISTANCE)):
        bits = [b for p in set(range(PARTS)) - set(two) for b in range(p * width, (p + 1) * width)]
        values = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")) for b in bits]
        part = rows.where((F.col("n") > PAIR_BUCKET) & (F.col("i") == i)).select("i", "key", "fp", F.explode(F.array(*values)).alias("hub"))
        hubs = part if hubs is None else hubs.union(part)
    low = hubs.groupBy("i", "key", "hub").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1")
    stars = hubs.join(low, ["i", "key", "hub"]).where("a <> fp").select("a", F.col("fp").alias("b")).where(near)
    return pairs.union(stars).distinct()


def _grouped(docs: DataFrame, width: int, similar: bool = False) -> DataFrame:
    """``similar`` also joins all texts whose sets of shingles reach the Jaccard similarity ``NUM / DEN``."""
    marked = saved(jaccard.with_sets(docs, width) if similar else with_fingerprints(docs, width))
    fps = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = links(fps.select("fp"))
    if similar:
        edges = edges.union(jaccard.links(docs, marked, width))
        marked = marked.select("doc_id", "th", "fp")
    roots = components(edges).withColumnRenamed("node", "fp")
    named = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(saved(named.join(ids, "root").select("fp", "root", "component_id")), "fp")


def near_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, fp, component_id): ``component_id`` is the smallest doc_id reachable over links.

    Shingles are ``width`` words, lower case, repeats included; shorter texts are one shingle. Null, empty and wordless
    texts share the fingerprint zero, and are linked to whatever is near it. Equal fingerprints are one node, so copies
    are never expanded into pairs. A null doc_id takes part; its group has the smallest id that is not null, or null.
    Repeated rows are returned as often as given. An empty table gives an empty result. Other columns are ignored.
    """
    return _grouped(docs, width).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """One document of each group stays, all columns as given.

    Groups are joined by fingerprints at ``DISTANCE`` bits and by every pair of texts whose sets of shingles reach the
    Jaccard similarity 4/5, found without loss: at 4/5 about ten bits of a fingerprint differ, too many for block keys.
    It is the first by doc_id (null last), then by a hash of the text. Of rows that repeat both, one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = _grouped(docs, width, similar=True).groupBy("root").agg(F.min(order).alias("f"), F.count("*").alias("n")).select("f.doc_id", "f.th", "n")
    first = saved(first.withColumnsRenamed({"doc_id": "__id", "th": "__th"}))
    th = F.xxhash64("text")
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["__id"]) & (th == first["__th"]), "left_semi")
    return kept if _single(docs) else kept.dropDuplicates(["doc_id", "text"])


def _single(docs: DataFrame) -> bool:
    """True if no row repeats another's id and text."""
    return docs.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").isEmpty()
