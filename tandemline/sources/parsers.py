"""Parsers of the corpora's text and JSON shapes, as functions over a string column; readers only add the file scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The shapes that files of these kinds have.
LINE = r"^\s*(\d+\.?\d*)\s+(\d+\.?\d*)\s+([AB])\s*:\s*(.*)$"
FRAMES = "channels map<string, struct<frames: array<array<string>>, transcript: string>>"
VOTES = "example_id string, history array<struct<content: string, boundaries: array<struct<total_count: long, counts: map<string, long>>>>>"
CHUNKS = "per_chunk map<string, struct<tp: long, fp: long, n_gt: long, n_pred: long, pred_times: array<double>, wins: array<array<double>>>>"
RESULT_NAME = r"g1_eval_([A-Za-z0-9]+?)(?:_s(\d+))?_([A-Za-z0-9]+)\.json$"


def line_transcripts(df: DataFrame, col: str = "value") -> DataFrame:
    """(..., start, end, side, text) of lines ``start end A: text``; blank lines, comments and other lines are skipped."""
    part = lambda i: F.regexp_extract(col, LINE, i)
    ok = df.filter(~F.ltrim(col).startswith("#") & F.col(col).rlike(LINE))
    return ok.select(*[c for c in df.columns if c != col], part(1).cast("double").alias("start"), part(2).cast("double").alias("end"), part(3).alias("side"), F.trim(part(4)).alias("text"))


def frames(df: DataFrame, keep: list[str], col: str = "value") -> DataFrame:
    """(keep..., ch, idx, t0, t1, label, p_bc, p_speak) of documents with arrays of frames for each channel."""
    x = df.select(*keep, F.explode(F.from_json(col, FRAMES)["channels"]).alias("ch", "c")).select(*keep, F.col("ch").cast("long").alias("ch"), F.posexplode("c.frames").alias("idx", "f"))
    num = lambda i: F.try_element_at("f", F.lit(i + 1)).try_cast("double")
    return x.select(*keep, "ch", F.col("idx").cast("long").alias("idx"), num(0).alias("t0"), num(1).alias("t1"), F.try_element_at("f", F.lit(3)).alias("label"), num(3).alias("p_bc"), num(4).alias("p_speak"))


def states(df: DataFrame, regions: DataFrame, key: str, col: str = "value") -> DataFrame:
    """State blocks of clipped regions on the session's clock: region start + block times."""
    x = df.select(key, F.posexplode(F.from_json(col, "array<struct<timestamp: array<double>, state: string>>")).alias("pos", "s"))
    return x.join(regions, key).select(
        key, "session", "ch", F.col("pos").cast("long").alias("pos"), (F.col("t0") + F.col("s.timestamp")[0]).alias("a"), (F.col("t0") + F.col("s.timestamp")[1]).alias("b"), F.col("s.state").alias("state"))


def vote_slots(df: DataFrame, cats: list[str], col: str = "value") -> DataFrame:
    """(example_id, turn, slot, m, cats...) of vote annotations, one row per boundary; a category without votes is 0."""
    x = df.select(F.from_json(col, VOTES).alias("d")).select("d.example_id", F.posexplode("d.history").alias("turn", "h"))
    x = x.select("example_id", F.col("turn").cast("long").alias("turn"), F.posexplode("h.boundaries").alias("slot", "b"))
    votes = [F.coalesce(F.try_element_at("b.counts", F.lit(c)), F.lit(0).cast("long")).alias(c) for c in cats]
    return x.select("example_id", "turn", F.col("slot").cast("long").alias("slot"), F.col("b.total_count").alias("m"), *votes)


def eval_results(df: DataFrame, path: str = "path", col: str = "value", default_seed: int = 42) -> DataFrame:
    """(arm, seed, set, chunk, tp, fp, n_gt, n_pred, pred_times, wins) of result documents, named by their path."""
    part = lambda i: F.regexp_extract(path, RESULT_NAME, i)
    seed = F.coalesce(part(2).try_cast("long"), F.lit(default_seed).cast("long"))
    x = df.filter(F.col(path).rlike(RESULT_NAME)).select(part(1).alias("arm"), seed.alias("seed"), part(3).alias("set"), F.explode(F.from_json(col, CHUNKS)["per_chunk"]).alias("chunk", "c"))
    return x.select("arm", "seed", "set", "chunk", "c.*")


def read_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(path, value): the lines of text or JSON-lines files."""
    return spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), "value")


def read_whole(spark: SparkSession, glob: str) -> DataFrame:
    """(path, value): one row per file."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def inventory_names(df: DataFrame, col: str) -> DataFrame:
    """(dir, stem, clean, extra, kind) of file names ``dir/[clean_]stem[_add].kind``."""
    name = r"^(?:(.*)/)?(clean_)?([^/]*?)(_add)?(?:\.([A-Za-z0-9]+))?$"
    part = lambda i: F.regexp_extract(col, name, i)
    return df.select(*df.columns, part(1).alias("dir"), part(3).alias("stem"), (part(2) != "").cast("long").alias("clean"), (part(4) != "").cast("long").alias("extra"), F.lower(part(5)).alias("kind"))


def kinds_together(names: DataFrame) -> DataFrame:
    """(kinds, n): how many stems come with which set of kinds."""
    g = names.groupBy("dir", "stem").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"))
    return g.groupBy("kinds").agg(F.count(F.lit(1)).alias("n"))
