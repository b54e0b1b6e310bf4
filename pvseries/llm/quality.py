"""Quality rules with limits that follow the data.

Every text is measured once. Four ratios of each text go into quantile sketches per language and
source: counts by bucket, where a bucket keeps the six leading binary digits of a whole number
(at most 1/32 wide). Such sketches are merged by adding counts, in any order, with the same
result, and have at most about 2,000 buckets however many texts they cover. A group with few
texts takes the limits of its language, and a language with few texts those of the whole corpus,
whose sketches are the merged ones. A limit is the 99th percentile plus its distance to the 90th
(below: the 1st less its distance to the 10th), and the width of its bucket; no metric has a fixed
cutoff or a least slack, so 99 of 100 texts that pass the fixed rules stay inside each limit, and
ratios that are mostly zero get limits of their own too. The texts are then joined with their
group's limits and filtered.

Defined cases: a null text has no words and fails; an empty text likewise; null languages and
sources are groups of their own; repeated rows and null keys give one row each; an empty table
gives no rows; other columns are not read, and the filter returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvseries.llm.common import inner, map_arrow, raw_inner, rows
from pvseries.sources.tables import materialise

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_SUPPORT = 200  # texts a group needs for limits of its own
SPREAD = 1  # distances between the 90th and 99th percentiles beyond the 99th
METRICS = ("word_length", "symbols", "dup_lines", "repeats")
TWO_SIDED = ("word_length",)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    pair = ids[:-1] * len(index) + ids[1:]
    if len(index) > 1 << 20:  # keep the packed window within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(index) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


def measure(batch: pa.RecordBatch, name: str) -> dict[str, np.ndarray]:
    texts = raw_inner(batch, name)
    points = pc.fill_null(pc.utf8_length(inner(batch, name).cast(pa.string())), 0).to_numpy(zero_copy_only=False)
    out = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    for i, t in enumerate(texts):
        words = t.split()
        lines = [x for x in t.split(b"\n") if x.strip()]
        out["n_words"][i] = len(words)
        out["word_chars"][i] = points[i] - (len(t) - len(t.translate(None, _SPACE)))
        out["n_symbols"][i] = len(t) - len(t.translate(None, _SYMBOLS))
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_repeat_words"][i] = repeated_words(words)
    return out


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of the table and one struct column ``__quality`` with the counts."""
    kept = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows({"row": batch.column("row"), **measure(batch, text)})

    fields = [packed.schema["row"], *[T.StructField(c, T.LongType()) for c in COUNTS]]
    out = map_arrow(packed, count, T.StructType(fields))
    return out.select("row", F.struct(*COUNTS).alias("q"))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def ratios(q: Column) -> dict[str, Column]:
    """Whole-number ratios of a measured text."""
    def per(unit: int, part: str, whole: str) -> Column:
        return F.expr(f"{unit} * {part} div greatest({whole}, 1)")
    return {"word_length": per(1000, "q.word_chars", "q.n_words"), "symbols": per(1_000_000, "q.n_symbols", "q.word_chars"),
            "dup_lines": per(1_000_000, "q.n_dup_lines", "q.n_lines"), "repeats": per(1_000_000, "q.n_repeat_words", "q.n_words")}


def group_key(value: Column) -> Column:
    """A key that is never null and never equal for null and a text."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def sketches(texts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of texts with ``lang``, ``source`` keys and ``q``."""
    long = texts.where(~base_failed(F.col("q"))).select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in ratios(F.col("q")).items()])).alias("x"))
    shift = F.greatest(F.length(F.bin("x.v")) - 6, F.lit(0))
    return (long.select("lang", "source", "x.metric", F.expr("x.v").alias("v"), shift.alias("s"))
            .groupBy("lang", "source", "metric", F.expr("shiftleft(shiftright(v, s), s)").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def merged(cells: DataFrame) -> DataFrame:
    """The sketches of groups (level 2), languages (1) and the corpus (0)."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), (F.col("lang") if k else F.lit("*")).alias("lang"),
                                (F.col("source") if k == 2 else F.lit("*")).alias("source")) for k in (0, 1, 2)])
    return (cells.select(F.explode(levels).alias("g"), "metric", "bucket", "n")
            .groupBy("g.level", "g.lang", "g.source", "metric", "bucket").agg(F.sum("n").alias("n")))


def limits(cells: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(lang, source, <metric>_lo, <metric>_hi): one row per group that has a sketch."""
    group = Window.partitionBy("level", "lang", "source", "metric")
    ranked = (merged(cells).withColumn("seen", F.sum("n").over(group.orderBy("bucket")))
              .withColumn("total", F.sum("n").over(group)))
    def percentile(p: int) -> Column:
        return F.min(F.when(100 * F.col("seen") >= p * F.col("total"), F.col("bucket"))).alias(f"p{p}")

    tails = ranked.groupBy("level", "lang", "source", "metric").agg(
        F.max("total").alias("total"), *[percentile(p) for p in (1, 10, 90, 99)])
    low = F.when(F.col("metric").isin(*TWO_SIDED), F.col("p1") - SPREAD * (F.col("p10") - F.col("p1"))).otherwise(F.lit(-1))
    high = F.col("p99") + SPREAD * (F.col("p99") - F.col("p90")) + F.expr("p99 div 32")  # a bucket is at most that wide
    edges = tails.select("level", "lang", "source", "metric", "total", high.alias("hi"), low.alias("lo"))
    wide = edges.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{m}_{e}")
                                         for m in METRICS for e in ("lo", "hi")])
    names = [f"{m}_{e}" for m in METRICS for e in ("lo", "hi")]
    ways = F.array(*[F.struct(F.lit(k).alias("level"), (F.col("lang") if k else F.lit("*")).alias("lang"),
                              (F.col("source") if k == 2 else F.lit("*")).alias("source")) for k in (0, 1, 2)])
    groups = wide.where(F.col("level") == 2).select(F.col("lang").alias("l"), F.col("source").alias("s"), F.explode(ways).alias("w"))
    found = groups.select("l", "s", "w.*").join(wide, ["level", "lang", "source"])
    fit = found.where((F.col("level") == 0) | (F.col("total") >= min_support))
    best = fit.groupBy("l", "s").agg(F.max_by(F.struct(*names), "level").alias("x"))
    return best.select(F.col("l").alias("lang"), F.col("s").alias("source"), "x.*")


def verdict() -> Column:
    """Whether a joined text stays."""
    inside = F.lit(True)
    for m, v in ratios(F.col("q")).items():
        inside = inside & (v >= F.col(f"{m}_lo")) & (v <= F.col(f"{m}_hi"))
    return ~base_failed(F.col("q")) & F.coalesce(inside, F.lit(False))


def _keyed(df: DataFrame, lang: str, source: str) -> DataFrame:
    return df.select("row", "q", group_key(F.col(f"row.`{lang}`")).alias("lang"),
                     group_key(F.col(f"row.`{source}`")).alias("source"))


def quality_report(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                   source: str = "source") -> DataFrame:
    """(doc_id, counts, base_failed, kept) per row; the measured table without texts is saved once."""
    slim = measured(df.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).alias("lang"),
                              F.col(source).alias("source"), F.col(text).alias("text")))
    slim = materialise(_keyed(slim, "lang", "source").select(F.col("row.doc_id").alias("doc_id"), "lang", "source", "q"),
                       "quality")
    judged = slim.join(limits(sketches(slim)), ["lang", "source"], "left")
    return judged.select("doc_id", *[f"q.{c}" for c in COUNTS], base_failed(F.col("q")).alias("base_failed"),
                         verdict().alias("kept"))


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The table's rows, with all columns, that pass. Texts are measured again rather than stored twice."""
    wanted = [c for c in dict.fromkeys([lang, source, text])]
    slim = _keyed(measured(df.select(*[F.col(f"`{c}`") for c in wanted]), text), lang, source).select("lang", "source", "q")
    edges = materialise(limits(sketches(slim)), "limits")
    judged = _keyed(measured(df, text), lang, source).join(edges, ["lang", "source"], "left").where(verdict())
    return judged.select("row.*")


ORACLE = rf"""
WITH w AS (SELECT doc_id, lang, source, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0d]+'),
           lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c, i
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (
      SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM p) WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0d]')) AS ls FROM w),
q AS (SELECT w.doc_id, w.lang, w.source, len(ws)::BIGINT AS n_words,
      list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS wc,
      length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      len(ls)::BIGINT AS n_lines FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
m AS (SELECT *, coalesce(wc, 0) AS word_chars,
      n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM q),
v AS (SELECT *, unnest([{{'metric': 'word_length', 'v': 1000 * word_chars // greatest(n_words, 1)}},
      {{'metric': 'symbols', 'v': 1000000 * n_symbols // greatest(word_chars, 1)}},
      {{'metric': 'dup_lines', 'v': 1000000 * n_dup_lines // greatest(n_lines, 1)}},
      {{'metric': 'repeats', 'v': 1000000 * n_repeat_words // greatest(n_words, 1)}}], recursive := true) FROM m),
s AS (SELECT *, greatest(length(bin(v)) - 6, 0)::BIGINT AS sh FROM v),
c AS (SELECT lang, source, metric, (v >> sh) << sh AS bucket, count(*) AS n, grouping(lang, source) AS g FROM s
      WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source, metric, (v >> sh) << sh),
      (lang, metric, (v >> sh) << sh), (metric, (v >> sh) << sh))),
k AS (SELECT *, sum(n) OVER (PARTITION BY g, lang, source, metric ORDER BY bucket) AS seen,
      sum(n) OVER (PARTITION BY g, lang, source, metric) AS total FROM c),
t AS (SELECT g, lang, source, metric, max(total) AS total, min(bucket) FILTER (100 * seen >= total) AS p1,
      min(bucket) FILTER (100 * seen >= 10 * total) AS p10, min(bucket) FILTER (100 * seen >= 90 * total) AS p90,
      min(bucket) FILTER (100 * seen >= 99 * total) AS p99 FROM k GROUP BY ALL),
f AS (SELECT g, lang, source, metric, total, p99 + {SPREAD} * (p99 - p90) + p99 // 32 AS hi,
      CASE WHEN metric = 'word_length' THEN p1 - {SPREAD} * (p10 - p1) ELSE -1 END AS lo FROM t),
j AS (SELECT s.doc_id, s.base_failed, s.v,
      CASE WHEN a.total >= {MIN_SUPPORT} THEN a.lo WHEN b.total >= {MIN_SUPPORT} THEN b.lo ELSE o.lo END AS lo,
      CASE WHEN a.total >= {MIN_SUPPORT} THEN a.hi WHEN b.total >= {MIN_SUPPORT} THEN b.hi ELSE o.hi END AS hi
      FROM s LEFT JOIN f a ON a.g = 0 AND a.lang = s.lang AND a.source = s.source AND a.metric = s.metric
      LEFT JOIN f b ON b.g = 1 AND b.lang = s.lang AND b.metric = s.metric
      LEFT JOIN f o ON o.g = 3 AND o.metric = s.metric)
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.n_lines, m.base_failed,
  NOT m.base_failed AND coalesce(x.inside, FALSE) AS kept
FROM m JOIN (SELECT doc_id, bool_and(v >= lo AND v <= hi) AS inside FROM j GROUP BY doc_id) x USING (doc_id)
"""
