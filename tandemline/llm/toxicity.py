"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, held_out, saved

# general words of the grammar's classes, in the languages of the texts
INSULTS = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
THREATS = ["beat", "burn", "destroy", "hurt", "kill", "punch", "shoot", "stab", "strangle"]
INTENT = ["gonna", "shall", "will", "i'll", "we'll", "going"]
TARGETS = ["you", "your", "you're", "he", "she", "they", "them", "him", "her", "du", "dich", "ihr", "sie", "tu", "toi", "vous", "ils", "usted", "ellos", "tú"]
NEGATIONS = ["not", "never", "no", "isn't", "aren't", "don't", "won't", "nicht", "kein", "keine", "ne", "pas", "jamais", "nunca", "jamás"]
REPORTS = ["said", "says", "wrote", "called", "claimed", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]

SYMBOLS = ["insult", "threat", "intent", "target", "negation", "report", "word"]
READINGS = ["aimed insult", "bare insult", "negated insult", "reported insult", "threat", "negated threat", "reported threat"]
PRIOR = np.array([3.5, 2.5, -0.5, -0.5, 3.5, -0.5, -0.5])
BIAS = -3.0
SAMPLE_ROWS, STEM_LENGTHS, STEMS = 6_000, (4, 5, 6, 7, 8), 200


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``moves[state, symbol] = (next state, output)``; a missing move keeps the state and the symbol."""

    moves: dict[tuple[int, str], tuple[int, str]]
    states: int

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.moves.get((state, symbol), (state, symbol))

    def then(self, other: Transducer, alphabet: list[str]) -> Transducer:
        """Composition over ``alphabet``: what this one puts out is the other one's input."""
        number, todo, moves = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            at = todo.pop()
            for x in alphabet:
                a, mid = self.step(at[0], x)
                b, out = other.step(at[1], mid)
                if (a, b) not in number:
                    number[a, b] = len(number)
                    todo.append((a, b))
                moves[number[at], x] = (number[a, b], out)
        return Transducer(moves, len(number))


def _countdown(trigger: str, reach: int, rewrite: dict[str, str]) -> Transducer:
    """``rewrite`` holds for ``reach`` symbols after ``trigger``."""
    moves: dict[tuple[int, str], tuple[int, str]] = {}
    for left in range(reach + 1):
        for x in [*SYMBOLS, *{a for a in rewrite}]:
            if x == trigger:
                moves[left, x] = (reach, x)
            else:
                moves[left, x] = (max(0, left - 1), rewrite.get(x, x) if left else x)
    return Transducer(moves, reach + 1)


def grammar() -> Transducer:
    """Threats need an intent or a target before them; targets aim insults; negation and report rewrite what follows."""
    threat = _countdown("intent", 3, {"threat": "sure threat"})
    aim = _countdown("target", 4, {"insult": "aimed insult", "threat": "sure threat"})
    negate = _countdown("negation", 3, {"insult": "negated insult", "aimed insult": "negated insult", "sure threat": "negated threat"})
    report = _countdown("report", 8, {"insult": "reported insult", "aimed insult": "reported insult", "sure threat": "reported threat"})
    middle = [*SYMBOLS, "sure threat", "aimed insult", "negated insult", "negated threat"]
    wide = lambda t: Transducer({**{(s, x): (max(0, s - 1), x) for s in range(t.states) for x in middle}, **t.moves}, t.states)
    return threat.then(wide(aim), SYMBOLS).then(wide(negate), SYMBOLS).then(wide(report), SYMBOLS)


FINAL = {"aimed insult": 0, "insult": 1, "negated insult": 2, "reported insult": 3, "sure threat": 4, "negated threat": 5, "reported threat": 6}
WORDS = re.compile(r"\w+(?:['’]\w+)?|[.!?;|]+(?=\s|$)|\n")


#: Words after which the machine has forgotten a trigger: the longest countdown of the grammar.
REACH = 8


def _enter(low: str, start: int) -> int:
    """Where the ``REACH`` words before ``start`` begin, however long they are."""
    size = 256
    while True:
        at = max(0, start - size)
        begins = [w.start() for w in WORDS.finditer(low, at, start)]
        if len(begins) > REACH:  # the first may be the rest of a word
            return begins[-REACH]
        if at == 0:
            return 0
        size *= 4


class Matcher:
    """Counts of the readings that the grammar finds in the clauses of a text."""

    def __init__(self, stems: list[str]):
        kinds = {**dict.fromkeys(TARGETS, "target"), **dict.fromkeys(NEGATIONS, "negation"), **dict.fromkeys(REPORTS, "report"),
                 **dict.fromkeys(INTENT, "intent"), **dict.fromkeys(THREATS, "threat"), **dict.fromkeys(INSULTS, "insult")}
        self.kinds, self.machine = kinds, grammar()
        self.stems = tuple(sorted(stems))
        heads = [re.escape(x) for x in sorted({*INSULTS, *THREATS})]
        tails = [re.escape(x) + r"\w*" for x in self.stems]
        self.find = re.compile(r"\b(?:" + "|".join([*tails, *(h + r"s?\b" for h in heads)]) + ")")

    def kind(self, word: str) -> str:
        known = self.kinds.get(word) or (self.kinds.get(word[:-1]) if word[-1:] == "s" else None)
        return known or ("insult" if self.stems and word.startswith(self.stems) else "word")

    def __call__(self, text: str) -> np.ndarray:
        out = np.zeros(len(READINGS))
        low, done = text.lower(), 0
        for m in self.find.finditer(low):
            if m.start() < done:
                continue
            state = 0  # as triggers reach no further than the words before the match, an earlier start would lead here too
            for w in WORDS.finditer(low, _enter(low, m.start())):
                word = w[0]
                if w.start() >= m.end():
                    break
                if not (word[0].isalnum() or word[0] == "_"):
                    state = 0
                    continue
                state, said = self.machine.step(state, self.kind(word))
                if w.start() >= max(done, m.start()) and said in FINAL:
                    out[FINAL[said]] += 1
                done = max(done, w.end())
        return out


def learned_stems(sample: DataFrame) -> list[str]:
    """Beginnings of words that mark labelled texts without a known insult, by sequential covering.

    The sample's texts are taken apart by Spark; the driver gets the beginnings that at least two unexplained toxic
    texts share and that at most one in fifty of the clean texts holds.
    """
    seeds = re.compile(r"\b(?:" + "|".join(INSULTS) + r")s?\b")

    def work(batches):
        for pdf in batches:
            for i, label, text in zip(pdf["doc_id"], pdf["label"], pdf["text"]):
                low = (text or "").lower()
                if label and seeds.search(low):
                    continue
                heads = {w[:k] for w in set(re.findall(r"[^\W\d_]+", low)) for k in STEM_LENGTHS if len(w) >= k}
                yield pd.DataFrame({"id": [str(i)] * len(heads), "label": [label] * len(heads), "stem": sorted(heads)}, dtype=object)

    heads = saved(sample.mapInPandas(work, "id string, label int, stem string"))
    n_clean = max(1, heads.where("label = 0").select("id").distinct().count())
    n_bad = heads.where("label = 1").select("id").distinct().count()
    of = heads.groupBy("stem").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("clean"))
    some = of.where((F.col("bad") >= 2) & (F.col("clean") <= n_clean // 50) & (F.col("bad") * n_clean >= 8 * F.col("clean") * n_bad))
    rows = heads.where("label = 1").join(some, "stem").select("id", "stem", "clean").toPandas()
    clean = dict(zip(rows["stem"], rows["clean"]))
    texts = {s: set(g) for s, g in rows.groupby("stem")["id"]}
    found: list[str] = []
    worth = lambda s: (len(texts[s]) - 4 * clean[s], -len(s), s)
    while texts and len(found) < STEMS:
        best = max(texts, key=worth)
        if worth(best)[0] < 2 or 4 * clean[best] > len(texts[best]):
            break
        found.append(best)
        gone = texts[best]
        texts = {s: left for s, t in texts.items() if (left := t - gone)}
    return found


def weights(x: np.ndarray, y: np.ndarray, pull: float = 2.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on log counts, drawn to ``PRIOR`` where the sample says little."""
    z, w = np.log1p(x), np.array([*PRIOR, BIAS])
    start, z1 = w.copy(), np.hstack([z, np.ones((len(z), 1))])
    for _ in range(steps if len(z) else 0):
        p = 1 / (1 + np.exp(-np.clip(z1 @ w, -30, 30)))
        grad = z1.T @ (p - y) + pull * (w - start)
        hess = (z1 * (p * (1 - p))[:, None]).T @ z1 + pull * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def scored(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, and a count for each reading of the grammar).

    Whole texts are read clause by clause. Null and empty texts have no clause and get the score of a text without a
    match. Word stems and weights are learned from at most ``rows`` labelled documents outside the held-out quarter;
    without any, the general words and the weights' starting values decide. Rows come back as often as given.
    """
    sample = saved(labelled_sample(docs, labels, "toxic", rows))
    stems = learned_stems(sample)
    names = [r.replace(" ", "_") for r in READINGS]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def reader(keep):
        def work(batches):
            match = Matcher(stems)
            for pdf in batches:
                found = np.array([match(t) if t else np.zeros(len(READINGS)) for t in pdf["text"]]).reshape(-1, len(READINGS))
                yield pd.concat([pdf[keep], pd.DataFrame(found, columns=names)], axis=1)

        return work

    shape = ", ".join(f"{n} double" for n in names)
    fit = sample.mapInPandas(reader(["doc_id", "label"]), f"doc_id {kind}, label int, {shape}").toPandas()
    fit = fit.sort_values(["doc_id", "label"], ignore_index=True)
    w, b = weights(fit[names].to_numpy(float), fit["label"].to_numpy(float))
    chosen = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = chosen.mapInPandas(reader(["doc_id", "held_out"]), f"doc_id {kind}, held_out boolean, {shape}")
    total = F.lit(b)
    for n, v in zip(names, w):
        total = total + F.log1p(n) * float(v)
    score = 1 / (1 + F.exp(-total))
    return counts.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), *names)
