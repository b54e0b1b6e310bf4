"""SentencePiece ids of whole texts from a table of distinct marked words.

The model turns blanks into markers and, as its vocabulary has no piece with a marker after
another character, never joins across a place where a marker follows one. So a text falls into
marked words (markers, then other characters) that are segmented independently. Every distinct
marked word goes to one bucket, where it is segmented once for all texts; each block of texts
gets the ids of its words back and joins them by position. Decoding uses the library on the
joined ids.

A text without leading, doubled or literal markers is cut by one split; others take the general
way, with the same words. The vocabulary is checked when the model is loaded: for one that does
join across markers, the operator refuses.

Defined cases: a null or empty text has the end id only and decodes to the empty text; repeated
rows and null keys give one row each; an empty table gives no rows; other columns are not read.
The table must be stored, for its blocks are formed twice; other words than those announced
before would end the job with an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.llm import blocks
from pvseries.llm.common import id_text, rows
from pvseries.llm.counting import cuts_are_safe, piece_model

MARK = "▁".encode()
BLOCK_BYTES = 8 << 20


def marked_words(text: bytes) -> list[bytes]:
    """The marked words of a text, each without its first marker."""
    if not text:
        return []
    if text[0] != 32 and b"  " not in text and MARK not in text:
        return text.split(b" ")
    out, run = [], 0
    for part in text.replace(b" ", MARK).split(MARK):
        if part:
            out.append(MARK * run + part)
            run = 0
        else:
            run += 1
    if run:  # markers at the end
        out.append(MARK * (run - 1))
    return out


def segment(sp, words: list[bytes]) -> list[list[int]]:
    """Ids of marked words. The model puts the first marker back; a lone marker needs a word before it."""
    out = sp.encode(words, num_threads=1)
    if b"" in words:
        alone = sp.encode("a ")[len(sp.encode("a")):]
        out = [alone if not w else ids for w, ids in zip(words, out)]
    return out


def _word_shares(texts: list[bytes | None], buckets: int) -> dict[int, list[bytes]]:
    """The distinct marked words of a block's texts by bucket; words are held once, not per place."""
    shares: dict[int, list[bytes]] = {}
    distinct: set[bytes] = set()
    for t in texts:
        distinct.update(marked_words(t or b""))
    for w in sorted(distinct):
        shares.setdefault(zlib.crc32(w) % buckets, []).append(w)
    return shares


def piece_ids(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids, decoded) per row; ids end with the model's end id."""
    packs = blocks.packed(id_text(df, key, text), block_bytes)
    buckets = blocks.bucket_count(df)

    def words_out(blob: bytes) -> dict[int, bytes]:
        squeeze = zstandard.ZstdCompressor(3).compress
        return {b: squeeze(b" ".join(w)) for b, w in _word_shares(blocks.unpack(blob)[1], buckets).items()}

    def segmented(blobs: list[bytes]) -> list[bytes]:
        if not cuts_are_safe(path):
            raise ValueError("the model joins pieces across blank markers")
        squeeze, expand = zstandard.ZstdCompressor(3).compress, zstandard.ZstdDecompressor().decompress
        lists = [expand(b).split(b" ") for b in blobs]
        distinct = sorted(set().union(*lists))
        ids = segment(piece_model(path), distinct)
        table = {w: (len(x), np.array(x, np.uint32).tobytes())
                 for w, x in zip(distinct, ids)}
        out = []
        for words in lists:
            found = [table[w] for w in words]
            out.append(squeeze(np.array([n for n, _ in found], np.uint32).tobytes() + b"".join(x for _, x in found)))
        return out

    def join_back(block: int, blob: bytes, answers: list[dict[int, bytes]]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        keys, texts = blocks.unpack(blob)
        table: dict[bytes, bytes] = {}
        for b, own in _word_shares(texts, buckets).items():
            data = expand(answers[0][b])
            ends = 4 * (len(own) + np.cumsum(np.frombuffer(data, np.uint32, len(own)).astype(np.int64)))
            for w, lo, hi in zip(own, [4 * len(own), *ends[:-1].tolist()], ends.tolist()):
                table[w] = data[lo:hi]
        sp = piece_model(path)
        end = np.uint32(sp.eos_id()).tobytes()
        for lo in range(0, len(keys), 128):
            codes = [b"".join(map(table.__getitem__, marked_words(t or b""))) + end for t in texts[lo:lo + 128]]
            offsets = np.cumsum([0, *(len(c) // 4 for c in codes)]).astype(np.int32)
            flat = np.frombuffer(b"".join(codes), np.int32)
            decoded = sp.decode([flat[a:b].tolist() for a, b in zip(offsets.tolist(), offsets[1:].tolist())])
            yield rows({"doc_id": keys[lo:lo + 128], "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        "decoded": decoded}, doc_id=pa.int64(), decoded=pa.string())

    answers = blocks.in_buckets(blocks.from_blocks(packs, words_out), segmented)
    return blocks.to_blocks(packs, [answers], join_back, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of coded texts, and the columns to keep."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), *keep)
