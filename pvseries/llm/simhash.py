"""Near-duplicate texts by SimHash and Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. The binary Golay code of
length 23 puts every segment within three bits of exactly one codeword; taking all codewords
within four bits gives one or six (index: 12 bits). Two segments that differ in two bits or fewer
have a word between them that is within three bits of some codeword, which is then within four of
both, so they share an index. If two fingerprints differ in five bits or fewer, at least two of
the three segments differ in two or fewer. So each fingerprint gets one key for every pair of
segments and pair of indices (85 on average), and each link up to five bits meets in some key.

Equal fingerprints are merged before keys are made, so a group of copies is one node. Tasks
read the sorted keys as a stream, verify distances inside a key, and return a spanning forest of
the links there, at most one link per member, never all pairs. A key with very many members goes
to a second round, split by exact blocks of the fingerprint (of distance + 2 blocks, two agree).

``halves`` = 2 uses two fingerprints of each text (two seeds): keys of either half are
candidates, and the distance counts all 128 bits. The filter ``keep_one`` keeps one row of each component.

Defined cases: a null or empty text has fingerprint 0 and is linked like any other; repeated rows
and null keys give one row each; a component without any key has a null id; an empty table gives
no rows; other columns are not read, and the filter returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.llm.common import map_arrow, raw, rows
from pvseries.llm.components import components
from pvseries.sources.tables import materialise

SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
_SMALL, _DENSE, _OVERFLOW = 64, 4096, 1 << 18


def hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """A hash of each run of words, with repeats; of the whole text where it has fewer words."""
    import xxhash
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    body = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    last = ends[words - 1:] if len(w) > words else ends[-1:]
    first = np.r_[0, ends[:len(last) - 1] + 1]
    return np.fromiter((xxhash.xxh64_intdigest(body[a:b], seed) for a, b in zip(first.tolist(), last.tolist())),
                       np.uint64, len(last))


def fingerprint(text: bytes, words: int = 4, seed: int = SEED) -> int:
    h = hashes(text, words, seed)
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits, and per remainder the index changes and their number."""
    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= _GENERATOR << (k - 11)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)], np.uint16)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.uint16)
    change, count = np.zeros((1 << 11, 6), np.uint16), np.zeros(1 << 11, np.uint8)
    for weight in range(5):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            s = low[error & 0xFFF] ^ high[error >> 12]
            change[s, count[s]] = error >> 11
            count[s] += 1
    return low, high, change, count


def golay_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices within four bits, and how many of each row count."""
    low, high, change, count = golay_tables()
    segment = segment.astype(np.uint32)
    s = low[segment & 0xFFF] ^ high[segment >> 12]
    return (segment >> 11).astype(np.uint16)[:, None] ^ change[s], count[s]


def golay_keys(f: np.ndarray, half: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) arrays of fingerprints, by pair of segments."""
    found = [golay_indices((f >> np.uint64(at)) & np.uint64((1 << n) - 1)) for at, n in SEGMENTS]
    slot = np.arange(6)
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        (a, na), (b, nb) = found[i], found[j]
        used = (slot[None, :, None] < na[:, None, None]) & (slot[None, None, :] < nb[:, None, None])
        key = ((half * 3 + p) << 24) | (a.astype(np.int64)[:, :, None] << 12) | b.astype(np.int64)[:, None, :]
        yield np.nonzero(used)[0], key[used]


def _near(f: np.ndarray, g: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(f ^ g).sum(-1) <= most


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position of each position's component."""
    root = np.arange(n)
    while len(i):
        m = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, m)
        np.minimum.at(root, j, m)
        root = root[root]
        if (root == before).all():
            break
    return root


def _spread(f: np.ndarray, most: int) -> tuple[list, list]:
    """Links of a breadth-first search; what is reached leaves the search, so a close group costs one pass."""
    a, b, rest = [], [], np.arange(len(f))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            q = queue.pop()
            hit = _near(f[rest], f[q], most)
            if hit.any():
                new = rest[hit]
                a += [q] * len(new)
                b += new.tolist()
                queue += new.tolist()
                rest = rest[~hit]
    return a, b


def block_keys(f: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of exact blocks: of ``most + 2`` blocks, at least two agree."""
    bits = 64 * f.shape[1]
    edges = np.linspace(0, bits, most + 3).astype(int)
    columns = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1), axis=1, bitorder="little")
    value = [columns[:, lo:hi] @ (1 << np.arange(hi - lo, dtype=np.int64)) for lo, hi in zip(edges, edges[1:])]
    for p, (i, j) in enumerate(combinations(range(most + 2), 2)):
        yield p, value[i] << 32 | value[j]


def bucket_links(key: np.ndarray, f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of a forest with the same components as all links inside equal keys. Keys are sorted."""
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, n])
    small = np.flatnonzero(np.repeat((size > 1) & (size <= _SMALL), size))
    i_all, j_all = [], []
    k, g, shift = key[small], f[small], 1
    while len(small) > shift:
        at = np.flatnonzero(k[shift:] == k[:-shift])
        if not len(at):
            break
        at = at[_near(g[at], g[at + shift], most)]
        i_all.append(small[at])
        j_all.append(small[at + shift])
        shift += 1
    for s, m in zip(start[size > _SMALL].tolist(), size[size > _SMALL].tolist()):
        part = f[s:s + m]
        if m <= _DENSE:
            a, b = _spread(part, most)
            i_all.append(np.array(a, np.int64) + s)
            j_all.append(np.array(b, np.int64) + s)
            continue
        for _, value in block_keys(part, most):
            order = np.argsort(value, kind="stable")
            edge = np.r_[np.flatnonzero(np.r_[True, np.diff(value[order]) != 0]), m]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if hi - lo > 1:
                    a, b = _spread(part[order[lo:hi]], most)
                    i_all.append(order[lo:hi][a] + s)
                    j_all.append(order[lo:hi][b] + s)
    i = np.concatenate(i_all) if i_all else np.zeros(0, np.int64)
    j = np.concatenate(j_all) if j_all else np.zeros(0, np.int64)
    root = _roots(n, i.astype(np.int64), j.astype(np.int64))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _columns(batch: pa.RecordBatch, halves: int) -> np.ndarray:
    return np.stack([batch.column(f"f{h}").to_numpy().view(np.uint64) for h in range(halves)], 1)


def fingerprints(df: DataFrame, words: int, halves: int, kept: list[str], text: str = "text") -> DataFrame:
    """The ``kept`` columns with f0, f1, ... of each text."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw(batch, "__text")
            found = {f"f{h}": np.fromiter((fingerprint(t, words, SEED + h) for t in texts), np.uint64, len(texts)).view(np.int64)
                     for h in range(halves)}
            yield rows({**{c: batch.column(c) for c in kept}, **found})

    slim = df.select(*kept, F.col(f"`{text}`").cast("string").alias("__text"))
    fields = [f"`{c}` {kind}" for c, kind in slim.dtypes if c != "__text"] + [f"f{h} long" for h in range(halves)]
    return map_arrow(slim, prints, ", ".join(fields))


def links(nodes: DataFrame, most: int, halves: int = 1, overflow: int = _OVERFLOW) -> DataFrame:
    """(a, b): links between nodes (nid, f0, ...) with the same components as all pairs within ``most`` bits."""
    names = [f"f{h}" for h in range(halves)]
    fields = "key long, nid long, " + ", ".join(f"{c} long" for c in names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nid, f = batch.column("nid").to_numpy(), _columns(batch, halves)
            for h in range(halves):
                for row, key in golay_keys(f[:, h], h):
                    yield rows({"key": key, "nid": nid[row], **{c: f[row, k].view(np.int64) for k, c in enumerate(names)}})

    def verify(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            hot = None  # the key whose members are being passed on

            def edges(key, nid, f):
                i, j = bucket_links(key, f, most)
                return rows({"key": pa.nulls(len(i), pa.int64()), "nid": nid[i], "other": nid[j],
                             **{c: np.zeros(len(i), np.int64) for c in names}})

            def passed_on(key, nid, f):
                for p, value in block_keys(f, most):
                    with np.errstate(over="ignore"):
                        mixed = (value.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(p)) \
                            * np.uint64(0xC2B2AE3D27D4EB4F) ^ key.view(np.uint64)
                    yield rows({"key": mixed.view(np.int64), "nid": nid, "other": np.zeros(len(nid), np.int64),
                                **{c: np.ascontiguousarray(f[:, k]).view(np.int64) for k, c in enumerate(names)}})

            for batch in batches:
                held.append((batch.column("key").to_numpy(), batch.column("nid").to_numpy(), _columns(batch, halves)))
                if sum(len(x[0]) for x in held) < 50_000:
                    continue
                key, nid, f = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(key, key[-1]))
                if hot is not None and key[0] == hot:
                    own = int(np.searchsorted(key, hot, "right"))
                    yield from passed_on(key[:own], nid[:own], f[:own])
                    key, nid, f, cut = key[own:], nid[own:], f[own:], max(0, cut - own)
                if cut:
                    yield edges(key[:cut], nid[:cut], f[:cut])
                    key, nid, f = key[cut:], nid[cut:], f[cut:]
                held = [(key, nid, f)]
                if not last and len(key) > overflow:
                    hot = key[0]
                    yield from passed_on(key, nid, f)
                    held = []
            if held:
                key, nid, f = (np.concatenate(x) for x in zip(*held))
                own = int(np.searchsorted(key, hot, "right")) if hot is not None and len(key) and key[0] == hot else 0
                if own:
                    yield from passed_on(key[:own], nid[:own], f[:own])
                if len(key) > own:
                    yield edges(key[own:], nid[own:], f[own:])
        return run

    out_fields = "key long, nid long, other long, " + ", ".join(f"{c} long" for c in names)
    keyed = map_arrow(nodes.select("nid", *names), spread, fields)
    found = materialise(map_arrow(keyed.repartition("key").sortWithinPartitions("key"), verify(False), out_fields), "links")
    again = found.where(F.col("key").isNotNull()).select("key", "nid", *names)
    out = found.where(F.col("key").isNull()).select(F.col("nid").alias("a"), F.col("other").alias("b"))
    if again.isEmpty():
        return out
    second = map_arrow(again.repartition("key").sortWithinPartitions("key"), verify(True), out_fields)
    return out.union(second.select(F.col("nid").alias("a"), F.col("other").alias("b")))


def grouped(printed: DataFrame, most: int, halves: int, least: str) -> DataFrame:
    """Adds (component): the least value of column ``least`` in each row's component."""
    names = [f"f{h}" for h in range(halves)]
    nodes = materialise(printed.groupBy(*names).agg(F.min(least).alias("rep"))
                        .withColumn("nid", F.monotonically_increasing_id()), "nodes")
    labels = components(links(nodes, most, halves))
    labelled = nodes.join(labels, nodes["nid"] == labels["node"], "left").select(
        *names, "rep", F.coalesce("root", "nid").alias("root"))
    labelled = materialise(labelled, "labelled")
    ids = labelled.groupBy("root").agg(F.min("rep").alias("component"))
    per_print = labelled.join(ids, "root").select(*[F.col(c).alias(f"n{c}") for c in names], "component")
    match = [printed[c] == per_print[f"n{c}"] for c in names]
    return printed.join(per_print, match).drop(*[f"n{c}" for c in names])


def near_duplicates(df: DataFrame, words: int = 4, most: int = 4, halves: int = 1, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row."""
    slim = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    printed = materialise(fingerprints(slim, words, halves, ["doc_id"]), "fingerprints")
    out = grouped(printed, most, halves, "doc_id")
    return out.select("doc_id", F.concat(*[F.lower(F.lpad(F.hex(f"f{h}"), 16, "0")) for h in range(halves)]).alias("fingerprint"),
                      F.col("component").alias("component_id"))


def keep_one(df: DataFrame, words: int = 4, most: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with one row of each component: the one with the least key, the first of equal ones.

    Components are those of :func:`near_duplicates`: fingerprints of ``words``-word shingles, linked at ``most`` or
    fewer differing bits.
    """
    columns = df.columns
    body = materialise(df.select(F.monotonically_increasing_id().alias("__uid"), *[F.col(f"`{c}`") for c in columns]), "numbered")
    # Null keys come last, so that a row with a key is kept where there is one.
    order = F.struct(F.col(f"`{key}`").isNull().alias("n"), F.col(f"`{key}`").cast("long").alias("k"), F.col("__uid").alias("u"))
    printed = materialise(fingerprints(body.select(order.alias("o"), F.col(f"`{text}`").alias("text")), words, 1, ["o"]), "fingerprints")
    dropped = grouped(printed, most, 1, "o").where("o.u <> component.u").select(F.col("o.u").alias("__uid"))
    return body.join(materialise(dropped, "dropped"), "__uid", "left_anti").drop("__uid")
