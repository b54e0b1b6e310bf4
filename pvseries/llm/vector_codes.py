"""Product codes of vectors, trained and assigned in exact integers.

A component x becomes floor(256 x); a vector is cut into equal parts, and every part position has
a codebook. The dot products behind the squared distances are matrix products in float64: both
sides are split into limbs so narrow that each product of limbs stays below 2 ** 53, where float64
is exact, and the products are put together again in int64. So distances, ties and sums are the
same on every machine, in every order of rows.

A round is one pass over the table: a task sums the parts of each codebook entry with the same
products, Spark adds up one row per task, part, entry and position, and the driver divides. What
the driver and the tasks hold is the codebooks, a size set by parameters and not by the data.

Defined cases: rows with a null vector, or with null or non-finite components, are dropped. So are
vectors that can't be cut into ``parts`` equal parts (their length is no multiple of it, or 0), and
those whose length differs from that of the kept vector with the smallest id. The first entries
are the first ``entries`` rows by (id, vector), null ids last; repeated rows count each time, and
fewer rows give smaller codebooks. Null ids and null labels are kept, null labels form one group.
Components too large for int64 distances take Python's integers; an error that no long can hold is
null, and so is the sum of its label. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.llm.common import map_arrow, rows
from pvseries.sources.tables import materialise

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
_BLOCK = 2048  # vectors in one matrix product
_LONG = 1 << 63
_SUM_BITS = 60


def limb_bits(terms: int) -> int:
    """Bits of a limb, so that a sum of ``terms`` products of limbs stays below 2 ** 53."""
    return (53 - max(terms - 1, 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float arrays, lowest first, whose sum at weights 2 ** (bits k) is ``x``; the last has the sign."""
    out = []
    while x.size and int(np.abs(x).max()) >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """``a @ b`` of int64 stacks, exact wherever the result fits into int64."""
    bits = bits or limb_bits(a.shape[-1])
    total = np.zeros((*a.shape[:-1], b.shape[-1]), np.int64)
    right = limbs(b, bits)
    for i, left in enumerate(limbs(a, bits)):
        for j, r in enumerate(right):
            if (i + j) * bits < 64:  # beyond that only bits that int64 drops
                total += (left @ r).astype(np.int64) << ((i + j) * bits)
    return total


def to_integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x), as int64 where that holds them and as Python integers otherwise."""
    scaled = vectors * float(SCALE)
    if not vectors.size or np.abs(scaled).max() < 2.0 ** 62:
        return np.floor(scaled).astype(np.int64)
    big = [int(v) * SCALE if abs(v) > 2.0 ** 53 else int(np.floor(v * SCALE)) for v in vectors.ravel().tolist()]
    return np.array(big, dtype=object).reshape(vectors.shape)


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """(parts, vectors, components) from one row per vector."""
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def _fits(x: np.ndarray, books: np.ndarray) -> bool:
    """Whether the summed distances of whole vectors fit into int64."""
    if x.dtype == object or books.dtype == object:
        return False
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    return 4 * most * most * x.shape[0] * x.shape[2] < _LONG


def assign(x: np.ndarray, books: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest entry per (part, vector); the lowest index wins a tie."""
    if not _fits(x, books):
        gone = [[((book[None] - v[:, None]) ** 2).sum(-1) for v in np.array_split(part, max(1, len(part) // 64))]
                for part, book in zip(x.astype(object), books.astype(object))]
        far = np.stack([np.concatenate(g) for g in gone])
    else:
        cross = exact_products(x, books.transpose(0, 2, 1), bits)
        far = (x * x).sum(-1)[:, :, None] - 2 * cross + (books * books).sum(-1)[:, None, :]
    index = far.argmin(-1)
    return index, np.take_along_axis(far, index[:, :, None], -1)[:, :, 0]


def entry_sums(x: np.ndarray, index: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(count per part and entry, sums per part, entry and component)."""
    member = (index[:, :, None] == np.arange(entries)).astype(np.int64)
    turned = member.transpose(0, 2, 1)
    sums = np.stack([m.astype(object) @ v for m, v in zip(turned, x)]) if x.dtype == object else exact_products(turned, x)
    return member.sum(1), sums


def blocks(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(slice, its parts as integers)."""
    for at in range(0, batch.num_rows, _BLOCK):
        piece = batch.slice(at, _BLOCK)
        flat = piece.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield piece, cut(to_integers(flat.reshape(piece.num_rows, -1)), parts)


def kept_vectors(df: DataFrame, parts: int, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector is whole and can be cut."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = df.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & whole)
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), v.cast("array<double>").alias("vector"))


def first_books(kept: DataFrame, parts: int, entries: int) -> tuple[int, np.ndarray | None]:
    """(vector length, codebooks before the first round); a bounded number of rows reaches the driver."""
    ordered = kept.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector")
    seeds = [r["vector"] for r in ordered.limit(entries).collect()]
    if not seeds:
        return 0, None
    size = len(seeds[0])
    if any(len(s) != size for s in seeds):
        seeds = [r["vector"] for r in ordered.where(F.size("vector") == size).limit(entries).collect()]
    return size, cut(to_integers(np.array(seeds, np.float64)), parts)


def _table_sums(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, limb, n, total) over the whole table; limb 0 has every task's count."""
    parts, entries, _ = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, object)
        for batch in batches:
            for _, x in blocks(batch, parts):
                n, s = entry_sums(x, assign(x, books)[0], entries)
                count, sums = count + n, sums + s
        part, entry, place = np.nonzero(np.broadcast_to(count[:, :, None] > 0, books.shape))
        left, limb, more = sums[part, entry, place], 0, len(part) > 0
        while more:  # sums of any size travel as limbs, too; nearly always one
            more = max(abs(v) for v in left.tolist()) >> _SUM_BITS > 0
            low, left = (left & ((1 << _SUM_BITS) - 1), left >> _SUM_BITS) if more else (left, left)
            yield rows({"part": part, "entry": entry, "place": place, "limb": np.full(len(part), limb), "n": count[part, entry],
                        "total": [Decimal(int(v)) for v in low]},
                       part=pa.int32(), entry=pa.int32(), place=pa.int32(), limb=pa.int32(), total=pa.decimal128(38, 0))
            limb += 1

    told = map_arrow(kept, add, "part int, entry int, place int, limb int, n long, total decimal(38,0)")
    return told.groupBy("part", "entry", "place", "limb").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(kept: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after ``rounds`` passes: entries that parts use become their floored means."""
    for _ in range(rounds):
        new, total, count = books.astype(object), {}, {}
        for r in _table_sums(kept, books).collect():  # parts * entries * components rows, or a few times that
            at = r["part"], r["entry"], r["place"]
            total[at] = total.get(at, 0) + (int(r["total"]) << (_SUM_BITS * r["limb"]))
            count[at] = max(count.get(at, 0), r["n"])
        for at, v in total.items():
            new[at] = v // count[at]
        books = new if max(map(abs, new.ravel().tolist())) >= 1 << 62 else new.astype(np.int64)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    parts = len(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, x in blocks(batch, parts):
                index, far = assign(x, books)
                error = [e if e < _LONG else None for e in far.sum(0).tolist()]
                texts = index.T.astype(np.uint8 if books.shape[1] <= 256 else ">u2").tobytes().hex()
                width = len(texts) // max(1, piece.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("vec_id"), piece.column("label"),
                     pa.array([texts[i * width:(i + 1) * width] for i in range(piece.num_rows)], pa.string()),
                     pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    schema = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    return map_arrow(kept, code, schema)


def books_text(books: np.ndarray) -> str:
    return ",".join(str(v) for v in books.ravel().tolist())


def vector_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id",
                 vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(rows (vec_id, label, code, error, label_error), codebooks); the codes are saved, as two readers need them."""
    kept = kept_vectors(df, parts, key, vector, label)
    size, books = first_books(kept, parts, entries)
    if books is None:
        none = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error"))
        return none.limit(0), None
    kept = kept.where(F.size("vector") == size)
    books = train(kept, books, rounds)
    coded = materialise(encode(kept, books), "vector-codes")
    total = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    # Saved, so that the size of the stored table decides how it is joined: labels may be few or many.
    sums = materialise(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"]), "left").drop("of"), books


def code_report(df: DataFrame) -> DataFrame:
    """The rows of :func:`vector_codes` with the checksum of all final codebook entries."""
    coded, books = vector_codes(df)
    digest = hashlib.sha256(books_text(books).encode()).hexdigest() if books is not None else ""
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql_round(k: int) -> str:
    """One round: nearest entries of the codebook c{k}, then the codebook c{k + 1}."""
    return f"""
a{k} AS (SELECT p.r, p.part, min(list_sum(list_transform(range(1, 5), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) * 64 + c.e) AS best
 FROM p JOIN c{k} c USING (part) GROUP BY 1, 2),
m{k} AS (SELECT p.part, best % 64 AS e, i, floor(sum(p.v[i]) / count(*))::BIGINT AS x FROM a{k} JOIN p USING (r, part), range(1, 5) t(i)
 GROUP BY 1, 2, 3),
c{k + 1} AS (SELECT c.part, c.e, coalesce(n.v, c.v) AS v FROM c{k} c
 LEFT JOIN (SELECT part, e, list(x ORDER BY i) AS v FROM m{k} GROUP BY 1, 2) n ON n.part = c.part AND n.e = c.e)"""


ORACLE = f"""
WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r,
 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, v[part * 4 + 1:part * 4 + 4] AS v FROM k, range(16) t(part)),
c0 AS (SELECT part, r AS e, v FROM p WHERE r < 64),{_sql_round(0)},{_sql_round(1)},
z AS (SELECT p.r, p.part, min(list_sum(list_transform(range(1, 5), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) * 64 + c.e) AS best
 FROM p JOIN c2 c USING (part) GROUP BY 1, 2),
o AS (SELECT r, string_agg(printf('%02x', (best % 64)::INTEGER), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM z GROUP BY 1)
SELECT k.vec_id, code, error, sum(error) OVER (PARTITION BY k.label)::BIGINT AS label_error,
 (SELECT sha256(string_agg(v[i]::VARCHAR, ',' ORDER BY part, e, i)) FROM c2, range(1, 5) t(i)) AS codebooks_sha256
FROM o JOIN k USING (r)"""
