"""SentencePiece ids and decoding through tables of distinct marked words."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame

MARK = "▁"
#: A chunk is a run of markers and the marker-free text after it; no piece may reach past one.
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Chunks a task's table may hold before it starts anew, so that its memory stays bounded.
TABLE = 400_000


class Segmenter:
    """Ids and decoded texts, each distinct chunk being segmented once a table."""

    def __init__(self, model: str, table: int = TABLE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        sp, self.limit, self.table = self.sp, table, {}
        names = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        plain = all(sp.normalize(t) == MARK + t.replace(" ", MARK) for t in (" a  b ", "\ufb01", "\u212b", "\uff21", "\xe9", "\t", "\xa0"))
        self.splits = plain and all(MARK not in p.lstrip(MARK) for p in names)  # neither trims nor rewrites
        self.lead = sp.encode("x")
        self.cut = len(sp.decode(self.lead))

    def chunk(self, chunk: str) -> tuple[str, int, str]:
        ids = self.sp.encode(chunk[1:]) if len(chunk) > 1 else self.sp.encode("x" + chunk)[len(self.lead):]
        return " ".join(map(str, ids)), len(ids), self.sp.decode(self.lead + ids)[self.cut:]

    def __call__(self, text: str) -> tuple[list[str], int, str]:
        """Decimal ids by chunk, their number, decoded text; without the end id."""
        if not text:
            return [], 0, ""
        if not self.splits or "\0" in text:
            ids = self.sp.encode(text)
            return [" ".join(map(str, ids))], len(ids), self.sp.decode(ids)
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        table = self.table
        if len(table) > self.limit:
            table.clear()
        for c in set(chunks).difference(table):
            table[c] = self.chunk(c)
        found = [table[c] for c in chunks]
        words = "".join([f[2] for f in found])
        return [f[0] for f in found], sum(f[1] for f in found), words[1:] if words[:1] == " " else words


def encoded(docs: DataFrame, model: str, texts: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``texts`` also the ids and the decoded text.

    Ids end with the end id; null is encoded as the empty text. Every distinct marked word of a task is segmented once
    and its ids are put back by position. A model with pieces that cross markers, or one that rewrites characters, is
    applied to whole texts instead. ``model`` is a path that every executor can read. Rows come back as often as given.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        cut = Segmenter(model)
        end = str(cut.sp.eos_id())
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                parts, n, decoded = cut(text or "")
                ids = " ".join([*parts, end])
                row = (n + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append((doc_id, *row, *((ids, decoded) if texts else ())))
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": pdf["doc_id"].dtype})

    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if texts else [])]
    shape = f"doc_id {kind}, n_tokens long, " + ", ".join(f"{c} string" for c in columns[2:])
    return docs.select("doc_id", "text").mapInPandas(work, shape)
