"""Removal of long repeated passages through recompression.

Words are symbols. In every round the same rule names runs and pairs in all texts: a run of two
equal words becomes one symbol, and a pair becomes one if a hash bit of its left symbol is 0 and
that of its right symbol is 1. A name is a hash of what it stands for, so it is the same
everywhere without a shared table. Whether a pair is named depends on its two symbols only, hence
equal passages get equal symbols but for a margin at both ends: a run adds two words to the
margin, and a round in which symbols of up to m words may pair adds m. The rounds (1, 1, 2, 2, 4,
4) leave the middle three words of every 35-word window in symbols that the window alone
determines.

So a window can only be repeated if the symbols of its middle words occur twice or more. Counts
of symbols over all texts reveal these windows (a few bytes per symbol, no positions), and a
second exchange compares the windows' 128-bit hashes, which settles repetition. Both exchanges
answer with one bit per distinct value.

Defined cases: a null or empty text has no words, and keeps the empty text; a
text with fewer words than a window keeps all its own; repeated rows (same key, same text) are
different places, so their windows are repeated; null keys give one row each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pvseries.llm import blocks
from pvseries.llm.common import id_text, rows
from pvseries.sources.tables import materialise

BLOCK_BYTES = 4 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _mix(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of ordered pairs of 64-bit values."""
    x = (a ^ (a >> np.uint64(29))) * _ODD[0] + (b ^ (b >> np.uint64(31))) * _ODD[1] + np.uint64(seed * 0x165667B19E3779F9 % (1 << 64))
    x ^= x >> np.uint64(32)
    x *= _ODD[2]
    return x ^ (x >> np.uint64(29))


def rounds_for(window: int) -> tuple[int, ...]:
    """Longest symbols that may pair, by round, so that margins leave the middle of a window."""
    out, margin, most = [], 2, 1
    while margin + most <= (window - 3) // 2:
        out.append(most)
        margin += most
        if len(out) % 2 == 0:
            most *= 2
    return tuple(out)


class Words:
    """The words of a block as hashes, with their documents."""

    def __init__(self, texts: list[bytes | None]):
        import xxhash
        self.split = [(t or b"").split() for t in texts]
        self.counts = np.array([len(w) for w in self.split], np.int64)
        self.ends = np.cumsum(self.counts)
        table: dict[bytes, int] = {}
        for words in self.split:
            for w in set(words).difference(table):
                table[w] = xxhash.xxh64_intdigest(w)
        self.hashes = np.fromiter((h for words in self.split for h in map(table.__getitem__, words)), np.uint64,
                                  int(self.counts.sum()))
        self.doc = np.repeat(np.arange(len(self.split)), self.counts)

    def symbols(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, length in words) of the recompressed block."""
        sym, doc = self.hashes, self.doc
        size = np.ones(len(sym), np.int64)
        if len(sym) > 1:
            same = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1])
            before, after = np.r_[False, same[:-1]], np.r_[same[1:], False]
            at = np.flatnonzero(same & ~before & ~after)  # runs of exactly two
            sym, doc, size = self._join(sym, doc, size, at, 0)
        for k, most in enumerate(rounds_for(window), 1):
            bit = (_mix(sym, sym, k) >> np.uint64(40)) & np.uint64(1)
            fits = size <= most
            at = np.flatnonzero((bit[:-1] == 0) & (bit[1:] == 1) & fits[:-1] & fits[1:] & (doc[1:] == doc[:-1]))
            sym, doc, size = self._join(sym, doc, size, at, k)
        return sym, size

    @staticmethod
    def _join(sym, doc, size, at, k):
        sym, size = sym.copy(), size.copy()
        sym[at] = _mix(sym[at], sym[at + 1], 100 + k)
        size[at] += size[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        return sym[keep], doc[keep], size[keep]

    def window_starts(self, window: int, shared: np.ndarray) -> np.ndarray:
        """Starts of windows inside one document whose three middle words are in shared symbols."""
        n = len(self.hashes)
        if n < window:
            return np.zeros(0, np.int64)
        mid = window // 2
        ok = self.doc[window - 1:] == self.doc[:n - window + 1]
        for k in (mid - 1, mid, mid + 1):
            ok &= shared[k:n - window + 1 + k]
        return np.flatnonzero(ok)

    def window_hashes(self, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each window, by doubling."""
        out = []
        for seed in (1, 2):
            have, width = _mix(self.hashes, self.hashes, seed), 1
            total, at, left = None, starts, window
            while left:
                if left & 1:
                    part = have[at]
                    total = part if total is None else _mix(total, part, seed + width)
                    at = at + width
                left >>= 1
                if left:
                    have, width = _mix(have[:-width], have[width:], seed + 10), width * 2
            out.append(total)
        return out[0], out[1]


def _shares(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of values by bucket, and where each bucket starts."""
    bucket = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _gather(answers: dict[int, bytes], order: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One flag per value from the buckets' answers."""
    out = np.zeros(len(order), bool)
    for b in range(len(cut) - 1):
        if cut[b + 1] > cut[b]:
            out[order[cut[b]:cut[b + 1]]] = _flags(answers[b], int(cut[b + 1] - cut[b]))
    return out


def _distinct_symbols(words: Words, window: int):
    sym, size = words.symbols(window)
    found, back, count = np.unique(sym, return_inverse=True, return_counts=True)
    return found, back, count, size


def _distinct_windows(h: np.ndarray, g: np.ndarray):
    """(h, g, back, count) of distinct 128-bit values."""
    found, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if len(h) and (g != g[first][back]).any():  # equal first halves with other second halves
        both, back, count = np.unique(np.stack([h, g], 1), axis=0, return_inverse=True, return_counts=True)
        return both[:, 0].copy(), both[:, 1].copy(), back.ravel(), count
    return found, g[first], back, count


def repeated_passages(df: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text",
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row: words in windows that start elsewhere too are removed."""
    packs = materialise(blocks.packed(id_text(df, key, text), block_bytes), "text-blocks")
    buckets = blocks.bucket_count(df)

    def symbols_out(blob: bytes) -> dict[int, bytes]:
        found, _, count, _ = _distinct_symbols(Words(blocks.unpack(blob)[1]), window)
        order, cut = _shares(found, buckets)
        rest, many = (found // np.uint64(buckets)).astype(np.uint32)[order], (count > 1)[order]
        return {b: rest[cut[b]:cut[b + 1]].tobytes() + _bits(many[cut[b]:cut[b + 1]])
                for b in range(buckets) if cut[b + 1] > cut[b]}

    def symbols_back(blobs: list[bytes]) -> list[bytes]:
        sizes = [_entries(len(b), 33) for b in blobs]
        values = np.concatenate([np.frombuffer(b, np.uint32, n) for b, n in zip(blobs, sizes)])
        many = np.concatenate([_flags(b[4 * n:], n) for b, n in zip(blobs, sizes)])
        order = np.argsort(values, kind="stable")
        return _answer(order, values[order[1:]] == values[order[:-1]], many, sizes)

    def windows_of(words: Words, answers: dict[int, bytes]):
        found, back, _, size = _distinct_symbols(words, window)
        shared = np.repeat(_gather(answers, *_shares(found, buckets))[back], size)
        starts = words.window_starts(window, shared)
        if not len(starts):
            return starts, *[np.zeros(0, np.uint64)] * 4
        return starts, *_distinct_windows(*words.window_hashes(window, starts))

    def windows_out(block: int, blob: bytes, answers: list[dict[int, bytes]]) -> Iterator[pa.RecordBatch]:
        _, h, g, _, count = windows_of(Words(blocks.unpack(blob)[1]), answers[0])
        order, cut = _shares(h, buckets)
        h, g, many = h[order], g[order], (count > 1)[order]
        yield blocks.send(block, {b: h[lo:hi].tobytes() + g[lo:hi].tobytes() + _bits(many[lo:hi])
                                  for b, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if hi > lo})

    def windows_back(blobs: list[bytes]) -> list[bytes]:
        sizes = [_entries(len(b), 129) for b in blobs]
        h = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blobs, sizes)])
        g = np.concatenate([np.frombuffer(b, np.uint64, n, 8 * n) for b, n in zip(blobs, sizes)])
        many = np.concatenate([_flags(b[16 * n:], n) for b, n in zip(blobs, sizes)])
        order = np.lexsort((g, h))
        return _answer(order, (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]]), many, sizes)

    def remove(block: int, blob: bytes, answers: list[dict[int, bytes]]) -> Iterator[pa.RecordBatch]:
        keys, texts = blocks.unpack(blob)
        words = Words(texts)
        starts, h, _, back, _ = windows_of(words, answers[0])
        cover = np.zeros(len(words.hashes) + 1, np.int64)
        if len(starts):
            at = starts[_gather(answers[1], *_shares(h, buckets))[back]]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed, texts = [], []
        for n, end, own in zip(words.counts.tolist(), words.ends.tolist(), words.split):
            mask = gone[end - n:end]
            k = int(mask.sum())
            removed.append(k)
            kept = [w for w, m in zip(own, mask.tolist()) if not m] if k else own
            texts.append(b" ".join(kept).decode())
        yield rows({"doc_id": keys, "n_words": words.counts, "n_removed": removed, "kept": texts},
                   doc_id=pa.int64(), n_removed=pa.int64(), kept=pa.string())

    shared = materialise(blocks.in_buckets(blocks.from_blocks(packs, symbols_out), symbols_back), "shared-symbols")
    windows = blocks.to_blocks(packs, [shared], windows_out, blocks.ROW)
    repeats = materialise(blocks.in_buckets(windows, windows_back), "repeated-windows")
    return blocks.to_blocks(packs, [shared, repeats], remove, "doc_id long, n_words long, n_removed long, kept string")


def _entries(size: int, bits: int) -> int:
    """Entries in a blob of ``bits`` bits an entry, the last bits of all of them padded to bytes."""
    n = 8 * size // bits
    while (bits // 8) * n + (n + 7) // 8 > size:
        n -= 1
    return n


def _answer(order: np.ndarray, same: np.ndarray, many: np.ndarray, sizes: list[int]) -> list[bytes]:
    """Per blob, a flag for each entry: does its value occur twice or more over all blobs?"""
    twice = many.copy()
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # An entry that occurs in one blob only, but several times there, has its flag in ``many``.
    return [_bits(part) for part in np.split(twice, np.cumsum(sizes)[:-1])]


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0d]+'), lambda x: x <> '') AS ws
           FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS t
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(t)) AS n FROM s) WHERE n > 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE
    list_filter(ws, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
