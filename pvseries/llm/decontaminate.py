"""Benchmark passages in texts, found through CGK random walks and verified by edit distance.

Texts are read as words in small letters without punctuation. A CGK walk over a window writes
down one word per step and moves on, or stays, as a random bit of (step, word) says; windows that
differ in few edits soon walk in step again, so their walks differ in few places. Bit sampling
keeps a few steps of a walk as its signature, in several repetitions with bits and steps of their
own; windows whose signatures agree in any repetition are candidates.

Items are indexed by windows of ten words at every second word, so that candidates of an item
come from all its parts, and one unbroken or slightly edited part is enough; the texts' walks start
at every word. A walk is given up at the first sampled step where no item has the same words so
far, which leaves the result as it is and ends nearly all walks after a few steps. A candidate
places the item in the text; the item-sized stretch there, with room on both sides, is
compared by exact edit distance (bytes), and reported if that is at most a quarter of the item.

The benchmark goes to the tasks in blocks of bounded rows and bytes, each read by one pass
inside the same scan of the texts; equal items are one entry there, and what is found is joined with
the ids of all of them.

Defined cases: null, empty and one-word items match nothing; items of two to nine words are
indexed as one window; null and empty texts match nothing; repeated rows, repeated items and null
keys are reported like others; empty tables give no rows; other columns are not read, and the filter
returns them unchanged.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.llm.common import id_text, map_arrow, raw, raw_inner, rows

WINDOW, STRIDE, SAMPLES = 10, 2, 6
MAX_EDITS = 0.25  # of an item's bytes
RECALL, WALK_CHANGE = 0.97, 0.1  # recall of a window whose walk differs in a tenth of its steps
BLOCK_ITEMS, BLOCK_BYTES = 5_000, 8 << 20
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE_BITS = 20


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(None, _PUNCTUATION).split()


def repetitions(recall: float = RECALL, change: float = WALK_CHANGE, samples: int = SAMPLES) -> int:
    """Repetitions after which a walk that differs in ``change`` of its steps is found with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - change) ** samples))


def letters(item: bytes) -> dict[int, int]:
    """For each byte, the places of an item that hold it, as bits."""
    out: dict[int, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def fit_distance(item: bytes, region: bytes, places: dict[int, int] | None = None) -> int:
    """Least edit distance of the item to any part of the region.

    A column of the distance table is kept as bits of its steps up and down, in whole numbers as
    long as the item, so that a byte of the region takes a few operations.
    """
    if item in region:
        return 0
    places = letters(item) if places is None else places
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best = size
    for c in region:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best = score
        rise <<= 1
        up = full & ((fall << 1) | ~(same | down | rise))
        down = rise & (same | down) & full
    return best


class WalkIndex:
    """Signatures of one block of items: [(item key, words)]."""

    def __init__(self, items: list[tuple[str, list[bytes]]], seed: int = 11):
        self.items = items
        self.texts = [b" ".join(w) for _, w in items]
        self.places = [letters(t) for t in self.texts]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}), 2)}  # 0 other, 1 end
        self.reps = repetitions()
        rng = np.random.default_rng(seed)
        self.classes = []
        coded = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]
        for width in sorted({min(WINDOW, len(c)) for c in coded}):
            starts = [(k, o) for k, c in enumerate(coded) if min(WINDOW, len(c)) == width
                      for o in sorted({*range(0, len(c) - width + 1, STRIDE), len(c) - width})]
            windows = np.stack([coded[k][o:o + width] for k, o in starts])
            for _ in range(self.reps):
                first = int(rng.integers(0, 2))
                later = np.sort(rng.choice(np.arange(2, max(2 * width, SAMPLES + 2)), SAMPLES - 1, replace=False))
                steps = [first, *later.tolist()]
                bits = rng.integers(0, 2, (steps[-1] + 1, len(self.vocabulary) + 2)).astype(np.int8)
                self.classes.append(self._rep(width, steps, bits, windows, starts))

    def _rep(self, width, steps, bits, windows, starts):
        """Prefix tables of one repetition: per sampled step, the hashes of the words so far."""
        place, h, tables = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.uint64), []
        row = np.arange(len(windows))
        for j in range(steps[-1] + 1):
            word = np.where(place < width, windows[row, np.minimum(place, width - 1)], 1)
            if j in steps:
                h = self.fold(h, word)
                table = np.zeros(1 << _TABLE_BITS, bool)
                table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
                tables.append(np.packbits(table))
            place = place + bits[j, word]
        known = defaultdict(list)
        for sig, start in zip(h.tolist(), starts):
            known[sig].append(start)
        return width, steps, bits, tables, np.sort(np.array(list(known), np.uint64)), dict(known)

    @staticmethod
    def fold(h: np.ndarray, word: np.ndarray) -> np.ndarray:
        x = (h ^ word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)

    def code(self, words: list[bytes]) -> Iterator[int]:
        return map(self.vocabulary.get, words, repeat(0))

    def candidates(self, coded: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start of the item in ``coded``, document, item) of every agreeing signature."""
        n = len(coded)
        limit = np.searchsorted(doc, doc, "right")  # where a word's document ends
        for width, steps, bits, tables, known, starts in self.classes:
            at = np.arange(n) if steps[0] else np.flatnonzero(coded)  # no item starts with a word of no item
            place, h, sampled = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64), 0
            for j in range(steps[-1] + 1):
                if not len(at):
                    break
                spot = at + place
                inside = (place < width) & (spot < limit[at])
                word = np.where(inside, coded[np.minimum(spot, n - 1)], 1)
                if j == steps[sampled]:
                    h = self.fold(h, word)
                    slot = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
                    keep = (tables[sampled][slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
                    at, place, h, word = at[keep], place[keep], h[keep], word[keep]
                    sampled += 1
                place = place + bits[j, word]
            if len(at) and len(known):
                spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for p, sig in zip(at[known[spot] == h].tolist(), h[known[spot] == h].tolist()):
                    for item, offset in starts[sig]:
                        yield p - offset, int(doc[p]), item

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, distance): the best place of every matching item in a text."""
        split = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        coded = np.fromiter(chain.from_iterable(map(self.code, split)), np.int64, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        places = defaultdict(set)
        for start, doc, item in self.candidates(coded, np.repeat(np.arange(len(split)), sizes)):
            places[doc, item].add(start - int(begin[doc]))
        for (doc, item), found in sorted(places.items()):
            n = len(self.items[item][1])
            room = 2 + n // 4
            best, last = None, None
            for start in sorted(found):
                if last is not None and start - last <= room:  # the stretch before has this place in it
                    continue
                last = start
                region = b" ".join(split[doc][max(0, start - room):start + n + 2 * room])
                d = fit_distance(self.texts[item], region, self.places[item])
                if best is None or d < best[1]:
                    best = (max(0, start), d)
                if d == 0:
                    break
            if best[1] <= MAX_EDITS * len(self.texts[item]):
                yield doc, item, *best


def keyed_items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, doc_id, text): items that have a text, with a key that equal texts share."""
    return id_text(benchmark, key, text).where("text is not null").withColumn("item", F.md5("text"))


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[str, list[bytes]]]]:
    """The distinct items, [(key of the text, words)], in blocks of bounded size."""
    items = keyed_items(benchmark, key, text).select("item", "text").distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    count = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["b"] // BLOCK_BYTES))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count)))
    for k in range(count):
        found = [(r["item"], words_of(r["text"].encode())) for r in numbered.where(F.col("block") == k).collect()]
        yield sorted(x for x in found if len(x[1]) > 1)


def _parts(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size; a longer text is a run of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, texts[start:i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def find_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): one row per row of the table and item found in it.

    Items of equal texts have a row each.
    """
    slim, spark = id_text(df, key, text), df.sparkSession
    schema = "doc_id long, item string, first_word long, n_words long, distance long, similarity double"
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark):
        if not items:
            continue
        index = spark.sparkContext.broadcast(WalkIndex(items))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            walk = index.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for start, texts in _parts(raw(batch)):
                    got = list(walk.matches(texts))
                    yield rows({"doc_id": [ids[start + d] for d, *_ in got], "item": [walk.items[i][0] for _, i, *_ in got],
                                "first_word": [w for _, _, w, _ in got], "n_words": [len(walk.items[i][1]) for _, i, *_ in got],
                                "distance": [x for *_, x in got],
                                "similarity": [1 - x / len(walk.texts[i]) for _, i, _, x in got]},
                               doc_id=pa.int64(), item=pa.string(), first_word=pa.int64(), n_words=pa.int64(),
                               distance=pa.int64(), similarity=pa.float64())

        out = out.union(map_arrow(slim, find, schema))
    ids = keyed_items(benchmark).select("item", F.col("doc_id").alias("item_id"))
    return out.join(ids, "item").select("doc_id", "item_id", "first_word", "n_words", "distance", "similarity")


def drop_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The table's rows in which no item is found, with all columns. No join and no shuffle."""
    columns, spark = df.columns, df.sparkSession
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    schema = out.schema
    for items in item_blocks(benchmark):
        if not items:
            continue
        index = spark.sparkContext.broadcast(WalkIndex(items))

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for start, texts in _parts(raw_inner(batch, text)):
                    bad[[start + d for d, *_ in index.value.matches(texts)]] = True
                yield batch.filter(pa.array(~bad))

        out = map_arrow(out, clean, schema)
    return out.select("row.*")
