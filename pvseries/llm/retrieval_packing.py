"""Packing of documents into windows of one length, beside their lexical neighbours.

A task encodes its texts. A document fills windows of its own as long as it can; what is left, its
rest, is saved and waits for neighbours. Rests are range-partitioned by a min-hash of their pairs of
ids, so texts with much in common mostly meet in one shard, and any number of equal ones is cut into
shards like the rest. A shard holds a bounded number of rests and an inverted index of them: BM25
over token ids, whose document frequencies come from all rests of the corpus. The first unused rest
is the seed of a window. The index returns its unused neighbours, best first; those that fit go
in whole, then the best one that did not fit is cut to fill the window, and what remains of it
waits on. A seed without unused neighbours is followed by the next rests in order. What doesn't
fill a window at the end of a shard goes on to the next shard of the task, so only the last window
of a task is padded.

Ids are those of the tokenizers library; the same merges run in tiktoken, several times faster, from
the ranks in the same file, and a text that tiktoken refuses goes to the library. The vocabulary
(a fixed number of ids) bounds the table of frequencies that reaches the driver and the tasks.

Defined cases: a null or empty text is a document with the end id only, which has no neighbours;
special strings are single ids, as the library has them; null keys and repeated rows are documents
like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.llm.common import id_text, map_arrow, raw, rows
from pvseries.sources.tables import materialise

WINDOW, END_ID = 1024, 0
SHARD_UNITS = 4096         # rests in one index
PART_IDS = 4 << 20         # ids of rests in one task
K1, B = 1.2, 0.75
_PACKED = 1 << 62          # sequences of rests are numbered from here, those of whole windows from 0
_GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.fast = self._tiktoken(path)

    def _tiktoken(self, path: str):
        """The same merges in tiktoken; None where the file asks for anything else."""
        import tiktoken
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, model = told["pre_tokenizer"] or {}, told["model"]
        plain = (told["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and not model.get("ignore_merges"))
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in told["added_tokens"]):
            return None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        # Merges must be tried in the order of ids, as tiktoken does.
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        if made != sorted(made):
            return None
        return tiktoken.Encoding("ranks", pat_str=_GPT2, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # a panic of the extension (very long runs of blanks) is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def signature(ids: np.ndarray) -> int:
    """Min-hash of the pairs of neighbouring ids, as a signed number."""
    a = ids.astype(np.uint64)
    pair = (a[:-1] << np.uint64(32) | a[1:]) if len(a) > 1 else a
    mixed = (pair + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return int((mixed ^ (mixed >> np.uint64(32))).min().astype(np.int64))


ENCODED = ("doc_id long, doc_tokens long, first_sequence long, crcs array<long>, start long, sig long, width int, rest binary")


def encoded(df: DataFrame, path: str, window: int = WINDOW, last: int = END_ID, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """One row per document: checksums of its own full windows, and the ids of its rest."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        kind = np.uint16 if max(code.size, last + 1) <= 1 << 16 else np.uint32
        sequence = TaskContext.get().partitionId() << 32
        for batch in batches:
            out = {f.split()[0]: [] for f in ENCODED.split(", ")}
            for doc, body in zip(batch.column("doc_id").to_pylist(), raw(batch)):
                ids = np.append(code.encode(body.decode()), last).astype("<u4")
                full = len(ids) // window
                rest = ids[full * window:]
                out["doc_id"].append(doc)
                out["doc_tokens"].append(len(ids))
                out["first_sequence"].append(sequence)
                out["crcs"].append([zlib.crc32(ids[k * window:(k + 1) * window]) for k in range(full)])
                out["start"].append(full * window)
                out["sig"].append(signature(rest) if len(rest) else None)
                out["width"].append(kind().itemsize)
                out["rest"].append(rest.astype(kind).tobytes())
                sequence += full
            yield rows(out, doc_id=pa.int64(), crcs=pa.list_(pa.int64()), width=pa.int32(), sig=pa.int64(), rest=pa.binary(),
                       doc_tokens=pa.int64(), first_sequence=pa.int64(), start=pa.int64())

    return map_arrow(id_text(df, key, text), encode, ENCODED)


def id_frequencies(units: DataFrame) -> tuple[int, int, dict[int, int]]:
    """(rests, their ids in all, rests that hold each id): the vocabulary bounds what reaches the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, n, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for ids in rests(batch):
                if (most := int(ids.max()) + 1) > len(held):
                    held, last = (np.r_[x, np.zeros(most - len(x), np.int64)] for x in (held, last))
                place = np.arange(len(ids))
                last[ids] = place
                held[ids[last[ids] == place]] += 1  # each id at its last place only
                n, size = n + 1, size + len(ids)
        some = np.flatnonzero(held)
        yield rows({"id": np.r_[some, -1, -2], "n": np.r_[held[some], n, size]}, id=pa.int64(), n=pa.int64())

    found = map_arrow(units.select("width", "rest"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    told = {r["id"]: r["n"] for r in found.collect()}
    return told.pop(-1, 0), told.pop(-2, 0), told


def rests(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16 if w == 2 else np.uint32)
            for b, w in zip(batch.column("rest").to_pylist(), batch.column("width").to_pylist())]


def idf(n: int, frequencies: dict[int, int]) -> np.ndarray:
    """ln((n - f + 0.5) / (f + 0.5)) by id, zero for ids in half of the rests or more: they tell nothing apart."""
    out = np.zeros(max(frequencies, default=0) + 1)
    at, f = np.array([*frequencies], np.int64), np.array([*frequencies.values()], float)
    out[at] = np.maximum(0.0, np.log((n - f + 0.5) / (f + 0.5)))
    return out


class Index:
    """BM25 over the rests of one shard."""

    def __init__(self, units: list[np.ndarray], weight: np.ndarray, mean: float):
        self.n = len(units)
        sizes = np.array([len(u) for u in units], np.int64)
        pair, tf = np.unique(np.repeat(np.arange(self.n), sizes) * len(weight) + np.concatenate(units), return_counts=True)
        doc, term = np.divmod(pair, len(weight))
        some = weight[term] > 0
        doc, term, tf = doc[some], term[some], tf[some]
        score = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        self.terms, self.term_at = term, np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(term, kind="stable")
        self.docs, self.scores = doc[order], score[order]
        self.weight_size = len(weight)
        self._edges(term[order])

    def _edges(self, ordered_terms: np.ndarray) -> None:
        self.ordered = ordered_terms
        ends = np.bincount(ordered_terms, minlength=self.weight_size).cumsum()
        self.lo, self.hi = np.r_[0, ends[:-1]], ends

    def keep(self, free: np.ndarray) -> None:
        """Forget the postings of rests that are used up."""
        some = free[self.docs]
        self.docs, self.scores = self.docs[some], self.scores[some]
        self._edges(self.ordered[some])

    def search(self, unit: int) -> np.ndarray:
        """Score of every rest for the distinct ids of one of them."""
        terms = self.terms[self.term_at[unit]:self.term_at[unit + 1]]
        lo, n = self.lo[terms], self.hi[terms] - self.lo[terms]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.docs[at], self.scores[at], self.n)


def best_that_fits(scores: np.ndarray, left: np.ndarray, gap: float) -> int | None:
    """The best neighbour (the first of equals) with a positive score and at most ``gap`` ids."""
    u = int(np.argmax(np.where(left <= gap, scores, 0.0)))
    return u if scores[u] > 0 and left[u] <= gap else None


def pack(units: list[np.ndarray], weight: np.ndarray, mean: float, window: int, final: bool
         ) -> tuple[list[list[tuple[int, int, int]]], list[int], np.ndarray]:
    """(windows of (unit, first id, ids), units that remain, first id of each that is not placed yet).

    All windows are full, but for the last one of the ``final`` call.
    """
    left = np.array([len(u) for u in units], np.int64)
    size, free, index, held = left.copy(), np.ones(len(units), bool), Index(units, weight, mean), len(units)
    windows, seed, unplaced, n_free = [], 0, int(size.sum()), len(units)
    while unplaced >= window or (final and unplaced):
        while not free[seed]:
            seed += 1
        if n_free < 0.8 * held:
            index.keep(free)
            held = n_free
        window_now, gap = [], window

        def place(u: int) -> None:
            nonlocal gap, unplaced, n_free
            n = min(gap, int(left[u]))
            window_now.append((u, int(size[u] - left[u]), n))
            left[u] -= n
            gap, unplaced = gap - n, unplaced - n
            if not left[u]:
                free[u], n_free = False, n_free - 1

        place(seed)
        if gap:
            scores = index.search(seed) * free
            while gap and (u := best_that_fits(scores, left, gap)) is not None:
                place(u)
                scores[u] = 0.0
            if gap and (u := best_that_fits(scores, left, np.inf)) is not None:
                place(u)  # cut
            after = seed
            while gap and unplaced:
                while not free[after]:
                    after += 1
                place(after)
        windows.append(window_now)
    return windows, np.flatnonzero(free).tolist(), size - left


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_rests(units: DataFrame, window: int = WINDOW, shard_units: int = SHARD_UNITS, part_ids: int = PART_IDS) -> DataFrame:
    """Pieces of the rests, packed with their neighbours."""
    n, size, frequencies = id_frequencies(units)
    weight, mean = idf(n, frequencies), size / max(n, 1)
    order = ["sig", "doc_id", "place"]
    ranged = (units.withColumn("place", F.monotonically_increasing_id())
              .repartitionByRange(max(1, -(-size // part_ids)), *order).sortWithinPartitions(*order))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = _PACKED + (TaskContext.get().partitionId() << 32)
        held: list[tuple] = []  # (doc_id, doc_tokens, first id, ids)

        def shard(final: bool) -> pa.RecordBatch:
            nonlocal held, sequence
            windows, left, start = pack([u[3] for u in held], weight, mean, window, final)
            out = {f.split()[0]: [] for f in PIECE.split(", ")}
            for w in windows:
                offset = 0
                for u, lo, k in w:
                    doc, tokens, first, ids = held[u]
                    for name, v in zip(out, (doc, first + lo, k, zlib.crc32(ids[lo:lo + k].astype("<u4")), tokens, sequence, offset)):
                        out[name].append(v)
                    offset += k
                sequence += 1
            held = [(held[u][0], held[u][1], held[u][2] + int(start[u]), held[u][3][start[u]:]) for u in left]
            return rows(out, **{f.split()[0]: pa.int64() for f in PIECE.split(", ")})

        for batch in batches:
            named = [batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start")]
            for unit in zip(*named, rests(batch)):
                held.append(unit)
                if len(held) >= shard_units and sum(len(u[3]) for u in held) >= window:
                    yield shard(False)
        if held:
            yield shard(True)

    return map_arrow(ranged, fill, PIECE)


def pack_documents(df: DataFrame, path: str, window: int = WINDOW, last: int = END_ID, key: str = "doc_id",
                   text: str = "text", shard_units: int = SHARD_UNITS, part_ids: int = PART_IDS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every document in one piece."""
    coded = materialise(encoded(df, path, window, last, key, text), "encoded")
    whole = coded.select("doc_id", "doc_tokens", "first_sequence", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
        "doc_tokens", (F.col("first_sequence") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    units = coded.where("sig IS NOT NULL").select("doc_id", "doc_tokens", "start", "sig", "width", "rest")
    return whole.unionByName(packed_rests(units, window, shard_units, part_ids))
