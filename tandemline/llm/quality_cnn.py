"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text.

The filters answer at every byte of a text. Their largest answers in a chunk (``CHUNK`` bytes, every ``STEP`` bytes, so
each byte lies in two chunks) describe the chunk; the mean and the maximum over all chunks describe the document, and a
small dense network turns them into one probability. Training runs on the driver on a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 64  # bytes of a part; chunks are made of whole parts
CHUNK, STEP = 4 * CELL, 2 * CELL
WIDTHS, EMBED, FILTERS, HIDDEN = (3, 5), 8, 16, 16  # filters of each width
#: Bounds of the sample that the network learns from: documents, and bytes of each (in ``STRETCHES`` spread evenly).
SAMPLE_ROWS, SAMPLE_BYTES, STRETCHES = 3_000, 2_048, 4
EPOCHS = 5
#: Bytes of texts that are scored together; a longer text is scored by itself, in about four times its size.
PART = 1 << 20
REACH = max(WIDTHS)


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that the network never learns from; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def cells(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces one after another, and the cells of each piece.

    Zeros fill each up to whole cells, as many at least as a filter looks back, so that none sees the piece before.
    """
    sizes = np.array([-(-(len(p) + REACH - 1) // CELL) for p in pieces])
    out = np.zeros(int(sizes.sum()) * CELL, np.uint8)
    for p, at in zip(pieces, (np.cumsum(sizes) - sizes) * CELL):
        out[at : at + len(p)] = np.frombuffer(p, np.uint8)
    return out, sizes


def chunk_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last cell (exclusive) of every chunk, and the number of chunks of each piece; the last may be short."""
    many = np.maximum(1, -(-(sizes - CHUNK // CELL) // (STEP // CELL)) + 1)
    piece = np.repeat(np.arange(len(sizes)), many)
    begin = np.cumsum(sizes) - sizes
    k = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
    first = begin[piece] + k * (STEP // CELL)
    return first, np.minimum(first + CHUNK // CELL, (begin + sizes)[piece]), many


class QualityCNN:
    def __init__(self, seed: int = 11):
        r, n = np.random.default_rng(seed), FILTERS * len(WIDTHS)
        f32 = lambda a: a.astype(np.float32)
        self.mask = np.zeros((REACH * EMBED, n), np.float32)  # rows past a filter's width stay zero
        for k, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {"e": f32(r.normal(0, 0.5, (256, EMBED))), "c": f32(r.normal(0, 0.2, self.mask.shape)) * self.mask,
                  "b": np.zeros(n, np.float32), "d": f32(r.normal(0, 0.2, (2 * n, HIDDEN))), "g": np.zeros(HIDDEN, np.float32),
                  "o": f32(r.normal(0, 0.3, HIDDEN)), "z": np.zeros(1, np.float32)}
        self.p["e"][0] = 0

    # ---- scoring
    def tables(self) -> list[np.ndarray]:
        """For each offset of a filter, its answer to every byte; only the wider filters have the later offsets."""
        full = [self.p["e"] @ self.p["c"][k * EMBED : (k + 1) * EMBED] for k in range(REACH)]
        return [np.ascontiguousarray(t[:, sum(FILTERS for w in WIDTHS if w <= k) :]) for k, t in enumerate(full)]

    def cell_maxima(self, raw: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Largest answer of every filter in every cell. A filter answers at its last byte, so it may look back into the cell before."""
        n, out = self.mask.shape[1], []
        padded = np.concatenate([np.zeros(REACH - 1, np.uint8), raw])
        for at in range(0, len(raw), 256 * CELL):
            size = min(256 * CELL, len(raw) - at)
            part = padded[at : at + size + REACH - 1].astype(np.intp)
            conv = tables[0].take(part[:size], axis=0)
            for k in range(1, REACH):
                conv[:, n - tables[k].shape[1] :] += tables[k].take(part[k : k + size], axis=0)
            conv = conv.reshape(-1, CELL, n)
            while conv.shape[1] > 1:  # the maximum by halves keeps to long vector operations
                half = conv.shape[1] // 2
                conv = np.maximum(conv[:, :half], conv[:, half:])
            out.append(conv[:, 0])
        return np.maximum(np.concatenate(out) + self.p["b"], 0)

    def scores(self, pieces: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each text."""
        raw, sizes = cells(pieces)
        top = self.cell_maxima(raw, tables)
        first, last, many = chunk_starts(sizes)
        chunk = top[first]
        for k in range(1, CHUNK // CELL):
            chunk = np.maximum(chunk, top[np.minimum(first + k, last - 1)])
        at = np.cumsum(many) - many
        return self.combined(np.add.reduceat(chunk, at, axis=0) / many[:, None], np.maximum.reduceat(chunk, at, axis=0))

    def combined(self, mean: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = np.maximum(np.concatenate([mean, high], axis=1) @ self.p["d"] + self.p["g"], 0)
        return 1 / (1 + np.exp(-np.clip((h @ self.p["o"] + self.p["z"]).astype(np.float64), -30, 30)))

    # ---- training
    def fit(self, docs: list[list[bytes]], y: np.ndarray, epochs: int = EPOCHS, batch: int = 24, rate: float = 0.01, seed: int = 11) -> QualityCNN:
        """Adam on the class-weighted cross entropy; a document is a list of stretches of its text."""
        r, p, t = np.random.default_rng(seed), self.p, 0
        m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        share = np.clip(y.mean(), 1e-9, 1 - 1e-9)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) ** np.float32(0.5)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                i, t = order[at : at + batch], t + 1
                g = self.gradient([docs[k] for k in i], y[i], weight[i] / len(i))
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
            rate *= 0.7
        return self

    def gradient(self, docs: list[list[bytes]], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, self.mask.shape[1]
        raw, sizes = cells([b for d in docs for b in d])
        first, last, many = chunk_starts(sizes)
        pieces = np.array([len(d) for d in docs])
        many = np.add.reduceat(many, np.cumsum(pieces) - pieces)  # chunks of a document
        near = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(REACH - 1, np.uint8), raw]), REACH)
        cols = p["e"][near].reshape(len(raw), -1)
        conv = (cols @ p["c"]).reshape(-1, CELL, n)
        place = conv.argmax(1) + (np.arange(len(conv)) * CELL)[:, None]  # position of each cell's maximum
        top = conv.max(1)
        chunk, cell = top[first].copy(), np.repeat(first[:, None], n, 1)
        for k in range(1, CHUNK // CELL):
            other = np.minimum(first + k, last - 1)
            better = top[other] > chunk
            chunk, cell = np.where(better, top[other], chunk), np.where(better, other[:, None], cell)
        act = np.maximum(chunk + p["b"], 0)
        doc, at = np.repeat(np.arange(len(docs)), many), np.cumsum(many) - many
        mean, high = np.add.reduceat(act, at, axis=0) / many[:, None], np.maximum.reduceat(act, at, axis=0)
        pooled = np.concatenate([mean, high], axis=1)
        h = np.maximum(pooled @ p["d"] + p["g"], 0)
        prob = 1 / (1 + np.exp(-np.clip(h @ p["o"] + p["z"], -30, 30)))
        dz = ((prob - y) * weight).astype(np.float32)
        dh = dz[:, None] * p["o"] * (h > 0)
        dp = dh @ p["d"].T
        chosen = (act == high[doc]) & (act > 0)
        chosen = chosen / np.maximum(1, np.add.reduceat(chosen, at, axis=0))[doc]
        da = ((dp[:, :n] / many[:, None])[doc] + dp[:, n:][doc] * chosen) * (act > 0)
        where = place[cell, np.arange(n)]
        dc, answers = np.zeros_like(p["c"]), np.empty((n, REACH * 256), np.float32)
        slot = near + 256 * np.arange(REACH)  # offset and byte as one number
        for f in range(n):
            w = where[:, f]
            dc[:, f] = cols[w].T @ da[:, f]
            answers[f] = np.bincount(slot[w].reshape(-1), np.repeat(da[:, f], REACH), REACH * 256)
        de = np.einsum("fkb,kef->be", answers.reshape(n, REACH, 256), p["c"].reshape(REACH, EMBED, n), optimize=True)
        de[0] = 0
        return {"e": de, "c": dc * self.mask, "b": da.sum(0), "d": pooled.T @ dh, "g": dh.sum(0), "o": h.T @ dz, "z": dz.sum(keepdims=True)}


def stretches(raw: bytes) -> list[bytes]:
    """A text as it is learned from: whole, or ``STRETCHES`` parts spread evenly, ``SAMPLE_BYTES`` in all."""
    if len(raw) <= SAMPLE_BYTES:
        return [raw]
    size = SAMPLE_BYTES // STRETCHES
    return [raw[a : a + size] for a in np.linspace(0, len(raw) - size, STRETCHES).astype(int)]


def learned(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> QualityCNN | None:
    """The network, from at most ``rows`` labelled documents by a hash of the id; None if a class is missing.

    Several labels of one document count as their largest; of rows that repeat an id, each distinct text counts once and
    the sample keeps to its bound.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    text = F.coalesce("text", F.lit(""))

    def cut(batches):
        for pdf in batches:
            parts = [stretches(x.encode()) for x in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "parts": parts})

    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    found = found.select(F.col("doc_id").cast("string").alias("id"), "label", "text").mapInPandas(cut, "id string, label int, parts array<binary>")
    order = F.xxhash64(F.concat_ws("|", "id", F.hex(F.element_at("parts", 1))))
    pdf = found.distinct().orderBy(order, "id", "parts").limit(rows).toPandas()
    y = pdf["label"].to_numpy(int)
    if not len(y) or y.min() == y.max():
        return None
    return QualityCNN().fit([[bytes(b) for b in parts] for parts in pdf["parts"]], y)


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 from a score of 0.5.

    Null and empty texts are one chunk of zeros and get what the network makes of it. Without rows of both labels every
    score is the label's share among what was learned from, and 0.5 without any. A null doc_id counts as not held out and
    is not learned from. Rows come back as often as given; other columns play no part.
    """
    net = learned(docs, labels, label, rows)
    plain = 0.5
    if net is None:
        one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.avg(label)).first()[0]
        plain = 0.5 if one is None else float(one)

    def work(batches):
        tables = net.tables() if net else None
        for pdf in batches:
            score = np.full(len(pdf), plain)
            texts = [b"" if t is None else t.encode() for t in pdf["text"]]
            at = 0
            while net and at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= PART):
                    size, end = size + len(texts[end]), end + 1
                score[at:end] = net.scores(texts[at:end], tables)
                at = end
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score, "predicted": (score >= 0.5).astype("int32")})

    chosen = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    found = chosen.mapInPandas(work, "doc_id string, held_out boolean, score double, predicted int")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
