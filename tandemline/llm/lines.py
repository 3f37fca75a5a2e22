"""Line dedup by an exact set-similarity join: rare-first prefixes, positions, lengths, then Jaccard."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, saved, written

#: Jaccard threshold as a fraction, so that all bounds are whole numbers.
NUM, DEN = 4, 5
#: Counters that token frequencies are summed into; two tokens may share one, which only makes the order less sharp.
COUNTERS = 1 << 18
#: Lines under one prefix token beyond which each line meets the token's earliest lines before it meets the others.
PAIR_BUCKET = 32
#: Number of these earliest lines.
HEADS = 8
#: Lines under one token that are compared with each other; beyond it they are compared under pairs of tokens.
PROBE_BUCKET = 2048
#: A line's number is its document's, shifted by so many bits, and its place in the text.
PLACE_BITS = 28
#: Lines of so many tokens or more carry a wider parity, as 64 bits tell them apart no longer.
LONG_LINE = 48
#: Frequent prefix tokens that may be broadcast (a number each).
BROADCAST_TOKENS = 1_000_000
#: Kept lines whose positions may be broadcast to the documents (32 MB); beyond it that join shuffles.
BROADCAST_LINES = 4_000_000
#: A document's number must be below this, so that twice a line's number fits 63 bits.
DOCUMENTS = 1 << 33


def plain(text: Column) -> Column:
    """A-Z in lower case, every blank a space, so that a plain split finds the words; other characters are only renamed.

    The bytes are read as Latin-1 and put in lower case: that maps the lead byte of a two-byte character onto one of a
    longer character, but the count of bytes that follow keeps them apart, so words stay equal or different as before.
    """
    low = F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))
    for blank in "\t\n\x0b\x0c\r":
        low = F.replace(low, F.lit(blank), F.lit(" "))
    return low


def hashes(lower: Column) -> Column:
    """Distinct words of a translated line as XXH64 values; that two words share one is beyond what 64 bits let occur."""
    return F.array_remove(F.array_distinct(F.transform(F.split(lower, " "), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def _bit(v: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(F.lit(63)).cast("int"))


def _wide(t: str) -> Column:
    """Parities of 256 counters that the values are dealt to; two sets differ in at least as many tokens as parities."""
    part = lambda k: F.filter(t, lambda v: v.bitwiseAND(F.lit(192).cast("long")) == F.lit(64 * k).cast("long"))
    return F.array(*[F.aggregate(part(k), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(_bit(v))) for k in range(4)])


def _apart(x: str, y: str) -> Column:
    return sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(4)), F.lit(0))


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``__n``, which orders the documents by doc_id (null last), then by a hash of the text.

    It is the id itself where that is a whole number below ``DOCUMENTS``, never null and never repeated; otherwise the
    distinct (doc_id, text) are numbered, and rows that repeat both are one document. Then true comes with it: numbers may repeat.
    """
    whole = isinstance(docs.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType))
    if whole and docs.groupBy("doc_id").count().where(f"count > 1 or doc_id is null or doc_id < 0 or doc_id >= {DOCUMENTS}").isEmpty():
        return docs.withColumn("__n", F.col("doc_id").cast("long")), False
    keys = docs.select(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")).distinct()
    parts = saved(keys.repartitionByRange("none", "id", "th").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy("none", "id", "th"))
    ids = saved(parts.join(F.broadcast(before), "part").select(F.col("id").alias("__id"), F.col("th").alias("__th"), (F.col("before") + inside).alias("__n")))
    same = docs["doc_id"].eqNullSafe(ids["__id"]) & (F.xxhash64(docs["text"]) == ids["__th"])
    return docs.join(ids, same).drop("__id", "__th"), True


def _rarity(docs: DataFrame) -> Callable[[Column], Column]:
    """Hash of a token -> its place in the common order: frequency class, then bits of the hash."""
    words = docs.select(F.explode(F.split(plain(F.col("text")), " ")).alias("t")).where("t <> ''")
    found = words.groupBy(F.xxhash64("t").bitwiseAND(F.lit(COUNTERS - 1)).alias("k")).agg(F.count("*").alias("n")).toPandas()
    table = bytearray(COUNTERS)  # a quarter of a million counters, whatever the input
    top = math.log(max(2, found["n"].max() if len(found) else 2))
    for k, n in zip(found["k"], found["n"]):
        table[k] = round(126 * math.log(n) / top)
    classes = F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")  # folded into one literal

    def place(h: Column) -> Column:
        return F.shiftleft(F.get(classes, h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")).cast("long"), 32).bitwiseOR(F.shiftrightunsigned(h, 32))

    return place


def _classes(docs: DataFrame) -> DataFrame:
    """One row for each distinct line with a word: number ``at`` of its first place, size n, parities, rarest tokens."""
    place = _rarity(docs)
    lines = docs.select("did", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select(F.shiftleft("did", PLACE_BITS).bitwiseOR(F.col("pos").cast("long")).alias("at"), plain(F.col("line")).alias("low"))
    low = F.col("low")
    lines = lines.select("at", F.xxhash64(F.lit(1), low).alias("k2"), F.xxhash64(low).alias("k3"), F.sort_array(F.transform(hashes(low), place)).alias("t"))
    n = F.size("t")
    prefix = n - F.ceil(n * NUM / F.lit(DEN)).cast("int") + 1
    lines = lines.select(
        "at", "k2", "k3", n.alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(_bit(v))).alias("sig"), F.when(n >= LONG_LINE, _wide("t")).alias("w"),
        F.transform(F.slice("t", F.lit(1), prefix + 1), lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))).cast("array<long>").alias("pre"))
    grouped = lines.groupBy("k2", "k3").agg(F.min("at").alias("at"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.any_value("w").alias("w"), F.any_value("pre").alias("pre"))
    grouped = grouped.where("n > 0")  # only here: a filter on the lines would be pushed down and hash every word twice
    return grouped.select("at", "n", "sig", "w", F.transform("pre", lambda v: (v - F.when(v >= 1 << 31, F.lit(1 << 32)).otherwise(0)).cast("int")).alias("pre"))


def _document() -> Column:
    return F.shiftright("at", PLACE_BITS)


def _place() -> Column:
    return F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _marked(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``a``, twice the line's number, is odd where the line has its match."""
    had = found.select("x", F.lit(1).alias("had"))
    had = F.broadcast(had) if found.count() <= BROADCAST_LINES // 4 else had
    return lines.join(had, F.col("at") == F.col("x"), "left").withColumn("a", F.col("at") * 2 + F.coalesce("had", F.lit(0))).drop("x", "had", "at")


def _rows(lines: DataFrame, *more: str) -> DataFrame:
    """(tok, i, a, n, sig, w): a row for each token of a line's prefix, rarest first."""
    width = F.col("n") - F.ceil(F.col("n") * NUM / F.lit(DEN)).cast("int") + 1  # ``pre`` has one more where there is one
    rows = lines.select("a", "n", "sig", "w", *more, F.posexplode(F.slice("pre", F.lit(1), width)).alias("i", "tok"))
    # a join adds these tests to one side or the other; with them on both, the two sides share one shuffle
    return rows.where("a is not null and n is not null and sig is not null and i is not null and tok is not null")


def _rest_parity(lines: DataFrame) -> DataFrame:
    """Rows as ``_rows``; ``sig`` leaves out the tokens before the row's own."""
    rows = _rows(lines, "pre")
    before = F.aggregate(F.slice("pre", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(_bit(v.cast("long"))))
    return rows.withColumn("sig", F.col("sig").bitwiseXOR(before))


def _alike(x: str, y: str, before: Column | int = 0) -> Column:
    """Parities and sizes allow the threshold, besides ``before`` tokens that differ; all bounds are multiplied out."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = F.bit_count(F.col(f"{x}.sig").bitwiseXOR(F.col(f"{y}.sig"))) + before
    wide = (NUM + DEN) * _apart(f"{x}.w", f"{y}.w") <= (DEN - NUM) * (nx + ny)
    return ((NUM + DEN) * apart <= (DEN - NUM) * (nx + ny)) & (DEN * nx >= NUM * ny) & (DEN * ny >= NUM * nx) & F.coalesce(wide, F.lit(True))


def _pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (x, y): a line without a match and an earlier line, under the first token that they share.

    All tokens before that one are in one line only, so they count as differences besides those of the later tokens.
    """
    x, y = rows.alias("x"), rows.alias("y")
    test = _alike("x", "y", F.col("x.i") + F.col("y.i")) & (F.col("y.a") < F.when(F.col("x.a") % 2 == 0, F.col("x.a")).otherwise(-1))
    for k in keys:
        test = (F.col(f"x.{k}") == F.col(f"y.{k}")) & test
    return x.join(y, test).select(F.shiftright("x.a", 1).alias("x"), F.shiftright("y.a", 1).alias("y"))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x) of the pairs whose lines really reach the threshold, as a saved table; the others it needs are deleted."""
    since = written()
    pairs = saved(pairs.distinct())
    ends = pairs.select(F.col("x").alias("at")).union(pairs.select("y"))
    ends = saved(ends.groupBy(_document().alias("d")).agg(F.collect_set(_place()).alias("ps")))  # at most a document's own lines in a row
    wanted = F.broadcast(ends) if pairs.count() <= BROADCAST_LINES // 4 else ends
    parts = docs.join(wanted, docs["did"] == F.col("d")).select("d", F.split("text", "\n").alias("lines"), F.explode("ps").alias("p"))
    sets = saved(parts.select(F.shiftleft("d", PLACE_BITS).bitwiseOR(F.col("p").cast("long")).alias("at"), hashes(plain(F.get("lines", F.col("p")))).alias("t")))
    x, y = (sets.select(F.col("at").alias(s), F.col("t").alias("t" + s)) for s in "xy")
    both = pairs.join(x, "x").join(y, "y")
    both = both.select("x", F.size("tx").alias("nx"), F.size("ty").alias("ny"), F.size(F.array_intersect("tx", "ty")).alias("both"))
    found = saved(both.where(DEN * F.col("both") >= NUM * (F.col("nx") + F.col("ny") - F.col("both"))).select("x").distinct())
    release(docs.sparkSession, since, last=1)
    return found


def _matched(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(x) of the distinct lines that an earlier distinct line matches.

    Under a token with many lines each first meets the earliest ones, which settles families of similar lines in linear
    work. A line that is not settled is then compared with the earlier lines under its prefix tokens; under a very
    frequent token, under that and a later token: two lines of two words or more that reach the threshold share the
    second of their common tokens in prefixes longer by one. A line of one word only matches lines of the same word
    alone, so the earliest of these settles all later ones. Of its tables only the result's stays.
    """
    since = written()
    group = Window.partitionBy("tok")
    whole = group.orderBy("a").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = F.struct("a", "n", "sig", "w")
    firsts = [F.nth_value(line, k + 1).over(whole).alias(f"v{k}") for k in range(HEADS)]
    met = _rows(lines.withColumn("a", F.col("at") * 2)).select("tok", line.alias("u"), F.count("*").over(whole).alias("m"), *firsts)
    met = met.where(F.col("m") > PAIR_BUCKET).select("tok", "u", "m", F.explode(F.array(*[f"v{k}" for k in range(HEADS)])).alias("v"))
    first = (F.col("u.a") == F.col("v.a")) & (F.col("m") > PROBE_BUCKET)  # of these one row a line: the token is frequent
    heads = met.where(first | ((F.col("v.a") < F.col("u.a")) & _alike("u", "v")))
    heads = saved(heads.select(F.when(first, F.col("tok")).alias("tok"), F.shiftright("u.a", 1).alias("x"), F.shiftright("v.a", 1).alias("y")))
    alone = lines.where("n = 1").select(F.get("pre", F.lit(0)).alias("tok"), "at")
    sole = alone.select(F.col("at").alias("x"), F.min("at").over(group).alias("y")).where("x <> y")
    found = _verified(docs, heads.where("tok is null").select("x", "y").union(sole))
    hot = saved(heads.where("tok is not null").select("tok").distinct())
    many = hot.count()
    hot = F.broadcast(hot) if many <= BROADCAST_TOKENS else hot
    rows = _rest_parity(_marked(lines, found))
    rest = saved(_pairs((rows.join(hot, "tok", "left_anti") if many else rows).drop("pre"), ["tok"]).distinct())
    if many:
        under = rows.join(hot, "tok")
        later = F.array_distinct(F.slice("pre", F.col("i") + 2, F.size("pre")))
        two = under.select("a", "n", "sig", "w", "i", "tok", F.explode(later).alias("tok2")).where("tok <> tok2")
        rest = rest.union(saved(_pairs(two, ["tok", "tok2"]).distinct()))
        # two words may share a token; their lines alone are few here, as the earliest settled the others
        rest = rest.union(_pairs(under.where("n = 1").drop("pre"), ["tok"]))
    matched = saved(found.union(_verified(docs, rest)))
    release(docs.sparkSession, since, last=1)
    return matched


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents as given, their text without the lines that match an earlier line; n_lines and n_removed added.

    A line's tokens are its distinct words, A-Z in lower case. A line goes if some earlier line, in this or another
    document, has the same words in the same order, or a Jaccard similarity of ``NUM / DEN`` or more; also if that
    earlier line goes itself. Order is by doc_id (null last), then a hash of the text, then place in the text. Lines
    without a word stay. Rows that repeat id and text are one document. Null texts stay null, empty texts empty. The
    output columns replace columns of the same name.
    """
    named, repeated = _numbered(docs)
    numbered = named.select(F.col("__n").alias("did"), "text").dropDuplicates(["did"]) if repeated else named.select(F.col("__n").alias("did"), "text")
    lines = saved(_classes(numbered))
    matched = _matched(numbered, lines)
    first = lines.select("at").join(matched, F.col("at") == F.col("x"), "left_anti").select(_document().alias("did"), _place().alias("pos"))
    kept = saved(first.groupBy("did").agg(F.sort_array(F.collect_set("pos")).alias("kept")))
    gap = lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i == 0, -1).otherwise(F.get("kept", i - 1)) - 1), F.lit("1"))
    mask = kept.select(F.col("did").alias("__did"), F.array_join(F.transform("kept", gap), "").cast("binary").alias("__mask"))
    mask = F.broadcast(mask) if lines.count() <= BROADCAST_LINES else mask
    out = named.join(mask, F.col("__n") == F.col("__did"), "left")
    parts = F.split("text", "\n")
    stays = lambda l, i: (~l.rlike("[^\\x20\\x09-\\x0D]")) | (F.substring("__mask", i + 1, F.lit(1)) == F.lit(b"1"))
    left = F.filter(parts, lambda l, i: F.coalesce(stays(l, i), F.lit(False)))
    before, after = F.coalesce(F.size(parts), F.lit(0)), F.coalesce(F.size(left), F.lit(0))
    before, after = F.when(F.col("text").isNull(), 0).otherwise(before), F.when(F.col("text").isNull(), 0).otherwise(after)
    added = out.withColumns({"n_lines": before, "n_removed": before - after, "text": F.array_join(left, "\n")})
    return added.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
