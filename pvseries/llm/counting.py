"""Token counts of whole texts.

Each task takes its Arrow batches apart into pieces of bounded size, packs them into groups of
about equal bytes, encodes a group per library call and keeps lengths only. A long text is cut
at single blanks, where no merge can cross: a cut is used only if the vocabulary has no piece
with a blank marker after another character and the model keeps blanks as they are.

Defined cases: a null text counts as empty, an empty text has 0 bytes and 0 tokens; repeated
rows and null keys give one row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pvseries.llm.common import id_text, map_arrow, raw, rows

MARK = "▁"


@lru_cache(2)
def piece_model(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(2)
def cuts_are_safe(path: str) -> bool:
    """Whether a text may be cut at a blank that follows another character."""
    sp = piece_model(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    whole = sp.encode("ab  cd e", out_type=str)
    return (all(MARK not in p.lstrip(MARK) for p in pieces) and "".join(whole) == f"{MARK}ab{MARK}{MARK}cd{MARK}e"
            and sp.encode("ab") + sp.encode(" cd e") == sp.encode("ab  cd e"))


def cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of about ``limit`` bytes. The blank at a cut is dropped: the model puts one before each part."""
    start = 0
    while len(text) - start > limit:
        at = text.find(b" ", start + limit)
        while at > 0 and (text[at - 1] == 32 or text[at - 3:at] == MARK.encode()):
            at = text.find(b" ", at + 1)
        if at < 0 or at + 1 >= len(text):
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]


def lengths(sp, texts: list[bytes], limit: int, group: int, safe: bool) -> np.ndarray:
    """Token count of each text."""
    out = np.zeros(len(texts), np.int64)
    parts, owner, held = [], [], 0

    def flush():
        if parts:
            np.add.at(out, owner, [len(x) for x in sp.encode(parts, num_threads=1)])
            parts.clear()
            owner.clear()

    for i, text in enumerate(texts):
        for part in cut(text, limit) if safe else (text,):
            parts.append(part)
            owner.append(i)
            held += len(part)
            if held >= group:
                flush()
                held = 0
    flush()
    return out


def token_counts(df: DataFrame, path: str, over: int = 4096, key: str = "doc_id", text: str = "text",
                 limit: int = 32_768, group: int = 262_144) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row for a sentencepiece model file."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, safe = piece_model(path), cuts_are_safe(path)
        for batch in batches:
            texts = raw(batch)
            n = lengths(sp, texts, limit, group, safe)
            yield rows({"doc_id": batch.column("doc_id"), "n_bytes": np.fromiter(map(len, texts), np.int64, len(texts)),
                        "n_tokens": n, "over_limit": n > over})

    return map_arrow(id_text(df, key, text), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
