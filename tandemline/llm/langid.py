"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

WINDOW = 128  # bytes
WIDTHS, EMBED, FILTERS = (2, 3, 4), 8, 8  # filters of each width
SAMPLE_ROWS, SAMPLE_WINDOWS, EPOCHS = 4_000, 3, 5
UNDEFINED = "und"


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """All bytes of a text in rows of ``size``, the last padded with zeros."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros((max(1, -(-len(raw) // size)), size), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


class ByteCNN:
    """Embedding, convolutions of several widths, maximum over positions, dense softmax layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        f32 = lambda a: a.astype(np.float32)
        self.classes, reach = classes, max(WIDTHS)
        # one matrix holds the filters of all widths; rows past a filter's width stay zero
        self.mask = np.zeros((reach * EMBED, FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
        n = self.mask.shape[1]
        self.p = {"e": f32(r.normal(0, 0.5, (256, EMBED))), "c": f32(r.normal(0, 0.25, self.mask.shape)) * self.mask,
                  "b": np.zeros(n, np.float32), "d": f32(r.normal(0, 0.3, (n, len(classes)))), "o": np.zeros(len(classes), np.float32)}
        self.p["e"][0] = 0

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """Embedded neighbourhoods (windows, positions, reach * EMBED)."""
        reach = max(WIDTHS)
        padded = np.zeros((len(x), x.shape[1] + reach - 1), np.uint8)
        padded[:, : x.shape[1]] = x
        e = self.p["e"][padded].reshape(len(x), -1)
        s = e.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(
            e, (len(x), x.shape[1], reach * EMBED), (s[0], EMBED * s[1], s[1])))

    def probabilities(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """Class probabilities of windows; a filter's response is a sum of per-byte table rows, one for each offset."""
        reach, n = max(WIDTHS), self.mask.shape[1]
        tables = [np.ascontiguousarray(self.p["e"] @ self.p["c"][k * EMBED : (k + 1) * EMBED]) for k in range(reach)]
        tables = [t[:, sum(FILTERS for w in WIDTHS if w <= k) :] for k, t in enumerate(tables)]  # wider filters come last
        tables = [np.ascontiguousarray(t) for t in tables]
        out = np.empty((len(x), len(self.classes)), np.float32)
        for at in range(0, len(x), block):
            part = x[at : at + block]
            padded = np.zeros((len(part), part.shape[1] + reach - 1), np.intp)
            padded[:, : part.shape[1]] = part
            conv = tables[0].take(padded[:, : part.shape[1]], axis=0)
            for k in range(1, reach):
                conv[:, :, n - tables[k].shape[1] :] += tables[k].take(padded[:, k : k + part.shape[1]], axis=0)
            while conv.shape[1] > 1:  # the maximum by halves keeps to long vector operations
                odd, half = conv.shape[1] % 2, conv.shape[1] // 2
                best = np.maximum(conv[:, :half], conv[:, half : 2 * half])
                if odd:
                    best[:, 0] = np.maximum(best[:, 0], conv[:, -1])
                conv = best
            z = np.maximum(conv[:, 0] + self.p["b"], 0) @ self.p["d"] + self.p["o"]
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + block] = z / z.sum(1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        r, p = np.random.default_rng(seed), self.p
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        weight = (len(y) / len(self.classes) / np.maximum(1, np.bincount(y, minlength=len(self.classes)))).astype(np.float32)
        reach, t = max(WIDTHS), 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                xb, yb, t = x[i], y[i], t + 1
                cols = self._columns(xb)
                conv = (cols.reshape(-1, cols.shape[2]) @ p["c"]).reshape(*xb.shape, -1)
                top = conv.argmax(1)
                h = np.maximum(np.take_along_axis(conv, top[:, None], 1)[:, 0] + p["b"], 0)
                z = h @ p["d"] + p["o"]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(i)), yb] -= 1
                z *= weight[yb][:, None] / len(i)
                gh = (z @ p["d"].T) * (h > 0)
                n = np.arange(len(i))[:, None]
                g = {"d": h.T @ z, "o": z.sum(0), "b": gh.sum(0)}
                best = cols[n, top]  # (batch, filters, reach * EMBED): only the maximum passes a gradient on
                g["c"] = np.einsum("bfk,bf->kf", best, gh) * self.mask
                ge = (gh[:, :, None] * p["c"].T[None]).reshape(len(i), -1, reach, EMBED)
                at_byte = np.zeros((len(i), xb.shape[1] + reach - 1), np.uint8)
                at_byte[:, : xb.shape[1]] = xb
                which = at_byte[n[:, :, None], top[:, :, None] + np.arange(reach)]
                g["e"] = np.zeros_like(p["e"])
                np.add.at(g["e"], which.reshape(-1), ge.reshape(-1, EMBED))
                g["e"][0] = 0
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)
            rate *= 0.6
        return self


def sample_windows(docs: DataFrame, rows: int = SAMPLE_ROWS, each: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, class numbers and classes for training: at most ``rows`` documents, ``each`` windows of each, spread
    evenly, outside the held-out quarter and with a language and a letter in the text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", "lang", "text", F.xxhash64("text").alias("__th"))
    same = ["doc_id", "lang", "__th"]  # rows that repeat all of these count once
    ids = known.select(*same).distinct().orderBy(F.xxhash64("doc_id"), *same).limit(rows)

    def work(batches):
        for pdf in batches:
            for i, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
                if any(map(str.isalpha, text)):
                    w = windows(text)
                    if len(w) > 1:
                        w = w[:-1]
                    pick = w[np.unique(np.linspace(0, len(w) - 1, each).astype(int))]
                    yield pd.DataFrame({"id": [str(i)] * len(pick), "lang": [lang] * len(pick), "w": [x.tobytes() for x in pick]}, dtype=object)

    found = known.join(F.broadcast(ids), same).dropDuplicates(same).select("doc_id", "lang", "text").mapInPandas(work, "id string, lang string, w binary").toPandas()
    found = found.sort_values(["id", "lang", "w"], ignore_index=True)
    classes = sorted(found["lang"].unique())
    x = np.frombuffer(b"".join(found["w"]), np.uint8).reshape(-1, WINDOW)
    return x, np.searchsorted(classes, found["lang"].to_numpy(str)) if classes else np.zeros(0, int), classes


def identified(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the mean of the network's probabilities over all windows of a text.

    ``und`` with score 0 for null texts, texts without a letter, and if there is nothing to learn from. A null doc_id
    counts as not held out and is not learned from. Rows come back as often as given; other columns play no part.
    """
    x, y, classes = sample_windows(docs, rows)
    net = ByteCNN(classes).fit(x, y) if classes else None
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for pdf in batches:
            pred, score = [UNDEFINED] * len(pdf), np.zeros(len(pdf))
            rows = [k for k, t in enumerate(pdf["text"]) if t is not None and net and any(map(str.isalpha, t))]
            for at in range(0, len(rows), 64):  # whole texts, some at a time
                some = rows[at : at + 64]
                wins = [windows(pdf["text"].iloc[k]) for k in some]
                p = net.probabilities(np.concatenate(wins))
                starts = np.cumsum([0, *map(len, wins[:-1])])
                mean = np.add.reduceat(p, starts, axis=0) / np.array([[len(w)] for w in wins])
                for k, q in zip(some, mean):
                    pred[k], score[k] = classes[int(q.argmax())], float(min(1.0, q.max()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": pred, "score": score})

    chosen = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return chosen.mapInPandas(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
