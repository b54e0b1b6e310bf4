"""Token ids in grammar-compressed shards.

Texts are ordered by key and encoded; each task cuts its run of documents into shards of a
bounded number of ids. Inside a shard the most frequent pairs of neighbouring ids are replaced by
new symbols, round after round, until pairs are rare or the rounds are used up (Re-Pair, with
many pairs per round, each counted over the whole shard). No pair crosses the end of a document.
A shard is one row of a Parquet file: the rules, the length that each rule expands to, the
symbols, and each document's key, number of symbols and number of ids. Any document, or any run
of ids inside it, can be decoded from the rules and lengths alone, without what lies before it.

Encoding uses the tokenizer on the distinct blank-separated chunks of a task's texts and joins
the ids back; a chunk's ids don't depend on its neighbours, because the tokenizer cuts at white
space before anything else. Marks after a letter or digit are chunks of their own, for they are
never in one token with it. Both are checked against whole texts in the tests.

Defined cases: a null or empty text is a document with the end id only; null keys come first;
rows with equal keys are all written, ordered by a hash of the text; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvseries.llm.common import id_text, map_arrow, raw, rows
from pvseries.session import scratch_path

END_ID = 2
SHARD_IDS = 1 << 21
ROUNDS, PAIRS_PER_ROUND, MIN_COUNT = 6, 2048, 8
_SLOT_BITS = 20
_MARKS, _PLAIN, _LATIN = np.zeros((3, 256), bool)
_MARKS[list(b".,;:!?")] = True
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True  # after the byte C3: À to ÿ without × and ÷
_CHUNKS_KEPT = 1_000_000  # chunks a worker's table holds before some are let go


def apart(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (their bytes in a row and where each begins) with a blank before every mark that follows a letter or digit.

    The tokenizer cuts there anyway, and what it cuts falls into fewer distinct chunks.
    """
    at = np.flatnonzero(_MARKS[data])
    at = at[at > 0]
    before = data[at - 1]
    at = at[_PLAIN[before] | (_LATIN[before] & (data[at - 2] == 0xC3))]
    return np.insert(data, at, 32), edges + np.searchsorted(at, edges)


class ChunkEncoder:
    """Ids of texts through a table of the distinct chunks seen so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # For words of a-z, where the file's own normalizer and cuts leave these as they are.
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        sample = "abcdefghijklmnopqrstuvwxyz the light of a tower"
        if self.plain.encode(sample, add_special_tokens=False).ids != self.tokenizer.encode(sample, add_special_tokens=False).ids:
            self.plain = self.tokenizer
        self.small = "Lowercase" in str(self.tokenizer.normalizer)
        mark = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        # Chunk k has the ids flat[start[k]:start[k] + size[k]]. A text's end is written as a blank, which is in no chunk.
        self.chunks = pa.array(["", " "], pa.large_string())
        self.size, self.start = np.array([0, 1], np.int32), np.zeros(2, np.int32)
        self.flat = np.zeros(1, np.uint32)
        self.again = np.zeros(2, bool)  # met in a later call than the first

    def _library(self, texts: list[str], group: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of distinct chunks, many encoded in a call."""
        size, order, flat = np.zeros(len(texts), np.int32), [], []

        def keep(part: list[int], ids: np.ndarray, at: np.ndarray) -> None:
            size[part] = np.diff(at)
            order.extend(part)
            flat.append(ids)

        # A chunk of letters is one token sequence at least, each with the vocabulary's only end mark last:
        # with as many marks as chunks, every chunk is one.
        letters = [k for k, t in enumerate(texts) if t.isalpha()] if self.ends.any() else []
        rest = sorted(set(range(len(texts))).difference(letters))
        simple = [k for k in letters if texts[k].isascii() and texts[k].islower()]
        others = sorted(set(letters).difference(simple))
        for tokenizer, own in ((self.plain, simple), (self.tokenizer, others)):
            parts = [own[i:i + group] for i in range(0, len(own), group)]
            coded = tokenizer.encode_batch_fast([" ".join([texts[k] for k in p]) for p in parts], add_special_tokens=False)
            for part, got in zip(parts, coded):
                ids = np.array(got.ids, np.uint32)
                at = np.flatnonzero(self.ends[ids]) + 1
                if len(at) == len(part) and at[-1] == len(ids):
                    keep(part, ids, np.r_[0, at])
                else:
                    rest += part
        for i in range(0, len(rest), group):  # told apart by their place
            part = rest[i:i + group]
            ends = np.cumsum([len(texts[k]) + 1 for k in part])
            got = self.tokenizer.encode(" ".join([texts[k] for k in part]), add_special_tokens=False)
            owner = np.searchsorted(ends, [o[0] for o in got.offsets], "right")
            keep(part, np.array(got.ids, np.uint32), np.searchsorted(owner, np.arange(len(part) + 1)))
        start = np.zeros(len(texts), np.int32)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(flat), start, size

    def _learn(self, chunks: pa.Array) -> None:
        """Put the chunks after the known ones into the table."""
        new = chunks[len(self.chunks):].to_numpy(zero_copy_only=False).tolist()
        self.chunks = chunks
        if new:
            ids, start, size = self._library(new)
            self.start, self.size = np.r_[self.start, start + np.int32(len(self.flat))], np.r_[self.size, size]
            self.flat, self.again = np.r_[self.flat, ids], np.r_[self.again, np.zeros(len(new), bool)]

    def _ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks with these numbers, and where each chunk's ids end."""
        n = self.size[places]
        ends = np.cumsum(n, dtype=np.int32)
        return self.flat[np.repeat(self.start[places] - (ends - n), n) + np.arange(len(n) and ends[-1], dtype=np.int32)], ends

    def _forget(self, used: np.ndarray) -> None:
        """Let go the chunks that only one call had or, if that frees too little, all but the last call's."""
        kept = self.again if np.count_nonzero(self.again) < _CHUNKS_KEPT // 2 else used
        kept[:2] = True
        places = np.flatnonzero(kept)
        self.flat, ends = self._ids(places)
        self.size = self.size[places]
        self.start = ends - self.size
        self.chunks, self.again = self.chunks.filter(pa.array(kept)), np.zeros(len(places), bool)

    def encode(self, texts: list[bytes], last: int) -> list[bytes]:
        """Ids of each text with the end id, as little-endian 32-bit numbers.

        Chunks become numbers of the table; ids are then taken from one array.
        """
        if not texts:
            return []
        # Special strings are found before letters are made small, so their texts stay as they are.
        cased = [t.lower() if self.small and b"<|" not in t else t for t in texts]
        data, edges = apart(np.frombuffer(b"".join(cased), np.uint8), np.cumsum([0, *map(len, cased)]))
        split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(cased), pa.py_buffer(edges), pa.py_buffer(data)))
        known = len(self.chunks)
        # One dictionary for both: the known chunks keep their numbers, new ones follow.
        coded = pa.chunked_array([self.chunks, split.flatten()]).dictionary_encode().chunk(1)
        self._learn(coded.dictionary)
        places = coded.indices.to_numpy()
        used = np.zeros(len(self.chunks), bool)
        used[places] = True
        self.again[:known] |= used[:known]
        text_ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        self.flat[0] = last
        ids, ends = self._ids(np.insert(places, text_ends, 1))
        if len(self.chunks) > _CHUNKS_KEPT:
            self._forget(used)
        code, cuts = ids.tobytes(), [0, *(4 * ends[text_ends + np.arange(len(texts))].astype(np.int64)).tolist()]
        return [code[lo:hi] for lo, hi in zip(cuts, cuts[1:])]


@lru_cache(1)
def chunk_encoder(path: str) -> ChunkEncoder:
    # A task has one core: the library's own threads would only wait for each other.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ChunkEncoder(path)


def compress(ids: np.ndarray, vocabulary: int, last: int, rounds: int = ROUNDS, pairs: int = PAIRS_PER_ROUND,
             least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k, a pair of symbols, has the symbol ``vocabulary + k``."""
    seq, rules, following = ids.astype(np.uint32), [], vocabulary
    name = np.zeros(1 << _SLOT_BITS, np.uint32)
    for _ in range(rounds):
        if len(seq) < 2:
            break
        left, right = seq[:-1], seq[1:]
        slot = ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(32 - _SLOT_BITS)
        slot = slot.astype(np.intp)  # as an index, once
        closed = np.flatnonzero(left == last)
        count = np.bincount(slot, minlength=1 << _SLOT_BITS) - np.bincount(slot[closed], minlength=1 << _SLOT_BITS)
        top = np.argpartition(-count, min(pairs, len(count) - 1))[:pairs]
        top = top[count[top] >= least]
        if not len(top):
            break
        # One pair per slot: the first in the shard. Others that share the slot wait for a later round.
        chosen = np.zeros(1 << _SLOT_BITS, bool)
        chosen[top] = True
        usable = chosen[slot]
        usable[closed] = False
        near = np.flatnonzero(usable)
        pair, own = (left[near].astype(np.uint64) << np.uint64(32)) | right[near], slot[near]
        stands = np.zeros(1 << _SLOT_BITS, np.uint64)
        stands[own[::-1]] = pair[::-1]
        same = pair == stands[own]
        at, own = near[same], own[same]
        # Of a run of overlapping places every second one is taken.
        start = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        length = np.diff(np.r_[start, len(at)])
        inside = np.arange(len(at)) - np.repeat(start, length)
        at, own = at[inside % 2 == 0], own[inside % 2 == 0]
        # The rules in order of their pairs; a pair is known by its slot.
        slots = np.flatnonzero(np.bincount(own, minlength=1 << _SLOT_BITS))
        found = np.sort(stands[slots])
        name[slots] = np.searchsorted(found, stands[slots])
        rules.append(np.stack([found >> np.uint64(32), found & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        seq = seq.copy()
        seq[at] = following + name[own]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, following = seq[keep], following + len(found)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def rule_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each rule expands to. Rules of a round refer to earlier rounds only."""
    out = np.ones(vocabulary + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[vocabulary + k] = out[a] + out[b]
    return out[vocabulary:]


class Grammar:
    """Decoder of a shard."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, vocabulary: int):
        self.vocabulary = vocabulary
        flat = rules.ravel()  # all rules in a row; symbols give way to their pairs until only ids are left
        while (made := flat >= vocabulary).any():
            n = 1 + made
            at, pairs = (np.cumsum(n) - n)[made], rules[flat[made] - vocabulary]
            flat = np.repeat(flat, n)
            flat[at], flat[at + 1] = pairs[:, 0], pairs[:, 1]
        self.lengths = np.r_[np.ones(vocabulary, np.int64), lengths]
        self.flat = np.r_[np.arange(vocabulary, dtype=np.uint32), flat]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        before = np.cumsum(n) - n
        return self.flat[np.repeat(self.starts[symbols] - before, n) + np.arange(int(n.sum()))]

    def window(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a document, by expanding only the symbols that hold them."""
        ends = np.cumsum(self.lengths[symbols])
        first, final = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        offset = int(ends[first - 1]) if first else 0
        return self.expand(symbols[first:final])[start - offset:stop - offset]


SHARD = ("part int, seq int, n_ids long, vocabulary int, width int, rules binary, lengths binary, symbols binary, "
         "doc_ids array<long>, doc_symbols binary, doc_tokens binary")


def write_shards(df: DataFrame, path: str, out: str, last: int = END_ID, key: str = "doc_id", text: str = "text",
                 shard_ids: int = SHARD_IDS) -> None:
    """Encode a table and write its shards to a Parquet folder; (part, seq) is the order of ids."""
    order = ["doc_id", "tie", "place"]  # short columns: the driver sees a sample of them
    ordered = (id_text(df, key, text).withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
               .repartitionByRange(*order).sortWithinPartitions(*order))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        vocabulary = max(encoder.tokenizer.get_vocab_size(), last + 1)
        part, seq = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[bytes] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), np.uint32)
            symbols, rules = compress(ids, vocabulary, last)
            lengths = rule_lengths(rules, vocabulary)
            expanded = np.r_[np.ones(vocabulary, np.int64), lengths]
            ends = np.searchsorted(np.cumsum(expanded[symbols]), np.cumsum([len(x) // 4 for x in held]))
            kind = np.uint16 if vocabulary + len(rules) <= 1 << 16 else np.uint32
            return rows({"part": [part], "seq": [seq], "n_ids": [len(ids)], "vocabulary": [vocabulary],
                         "width": [kind().itemsize], "rules": [rules.tobytes()], "lengths": [lengths.tobytes()],
                         "symbols": [symbols.astype(kind).tobytes()], "doc_ids": [keys],
                         "doc_symbols": [np.diff(np.r_[-1, ends]).astype(np.int64).tobytes()],
                         "doc_tokens": [np.array([len(x) // 4 for x in held], np.int64).tobytes()]},
                        part=pa.int32(), seq=pa.int32(), vocabulary=pa.int32(), width=pa.int32(), doc_ids=pa.list_(pa.int64()))

        for batch in batches:
            texts, ids = raw(batch), batch.column("doc_id").to_pylist()
            for doc, code in zip(ids, encoder.encode(texts, last)):
                keys.append(doc)
                held.append(code)
                size += len(code) // 4
                if size >= shard_ids:
                    yield shard()
                    keys, held, size, seq = [], [], 0, seq + 1
        if keys:
            yield shard()

    map_arrow(ordered, write, SHARD).write.parquet(out)


def read_documents(spark, out: str) -> DataFrame:
    """(part, seq, place, doc_id, before, n_tokens, ids_crc32): every document decoded from the files."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                grammar = Grammar(np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2),
                                  np.frombuffer(shard["lengths"], np.int64), shard["vocabulary"])
                symbols = np.frombuffer(shard["symbols"], np.uint16 if shard["width"] == 2 else np.uint32)
                ids = grammar.expand(symbols)
                n = np.frombuffer(shard["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                sums = [zlib.crc32(ids[e - k:e]) for k, e in zip(n.tolist(), ends.tolist())]
                yield rows({"part": np.full(len(n), shard["part"], np.int32), "seq": np.full(len(n), shard["seq"], np.int32),
                            "place": np.arange(len(n)), "doc_id": shard["doc_ids"], "before": ends - n, "n_tokens": n,
                            "ids_crc32": sums}, doc_id=pa.int64(), ids_crc32=pa.int64())

    return map_arrow(spark.read.parquet(out), read, "part int, seq int, place long, doc_id long, before long, "
                                                    "n_tokens long, ids_crc32 long")


def shard_starts(spark, out: str) -> DataFrame:
    """(part, seq, base): ids before each shard; running sums inside parts, then over parts."""
    shards = spark.read.parquet(out).select("part", "seq", "n_ids")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # One row per task of the writing job.
    parts = parts.select("part", F.coalesce(F.sum("ids").over(earlier.orderBy("part")), F.lit(0)).alias("part_base"))
    inside = F.coalesce(F.sum("n_ids").over(earlier.partitionBy("part").orderBy("seq")), F.lit(0))
    return shards.withColumn("inside", inside).join(parts, "part").select(
        "part", "seq", (F.col("part_base") + F.col("inside")).alias("base"))


def encode_to_files(df: DataFrame, path: str, last: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read from the files that the table was written to."""
    spark, out = df.sparkSession, scratch_path(df.sparkSession, "grammar-shards")
    write_shards(df, path, out, last)
    return read_documents(spark, out).join(shard_starts(spark, out), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
