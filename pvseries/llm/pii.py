"""Personal data in whole texts: fixed forms, and identifiers found through their contexts.

E-mail addresses, IP addresses, card and phone numbers have fixed forms. Their matches are seeds:
the two words before an entity make a lexical pattern, and everything that looks like an
identifier (five digits or more) after such a pattern is an instance. Spark scores the graph of
patterns and instances in rounds. A pattern's confidence is the share of its instances' belief in
all its distinct instances, less for few instances; an instance believes its best pattern. The
patterns over the threshold with enough seeds of their own then tell further identifiers of
any form, as kind ``context``.

Texts are read once: each task returns spans, and candidates with their patterns. Edges are
pre-aggregated to one row per pattern and instance, so a frequent pattern has one row per
distinct instance, and the joins leave skew to adaptive execution.

Defined cases: a null text counts as empty and has no spans; repeated rows and null keys give one
row each; an empty table gives no rows; the report reads no other columns, and masking returns
them unchanged. Spans count code points, end exclusive. Work is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvseries.llm.common import inner, map_arrow, rows, strings
from pvseries.sources.tables import materialise

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS, THRESHOLD, MIN_SEEDS = 3, 0.6, 5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+", re.ASCII)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", re.ASCII)
# The look-behinds only spare starts inside a digit run, which can't match where the run's start doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", re.ASCII)
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+", re.ASCII)
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.ASCII)
_CANDIDATE = re.compile(r"(?<![\w#-])[#]?(?:[A-Za-z]{1,4}[-]?)?[0-9][0-9A-Za-z-]{4,31}(?![\w-])", re.ASCII)
_WORD = re.compile(r"\S+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the whole run before an ``@``: found from the sign, no run is tried twice."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def pattern_before(text: str, start: int) -> str:
    """The two words before a position, in small letters without digits; words are looked for nearby only."""
    words = _WORD.findall(text[max(0, start - 64):start])[-2:]
    return re.sub(r"[0-9]+", "0", " ".join(words).lower()) if len(words) == 2 else ""


def edges_of(text: str, base: list[Span]) -> list[tuple[str, str, int, int, bool]]:
    """(pattern, instance, start, end, seed) of the seeds and the candidates of a text."""
    out = [(pattern_before(text, s), text[s:e], s, e, True) for _, s, e in base]
    at, floor = 0, 0
    for m in _CANDIDATE.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        if at < len(base) and base[at][1] < m.end() or m.start() < floor:
            continue
        if len(digits_of(m[0])) >= 5:
            out.append((pattern_before(text, m.start()), m[0], m.start(), m.end(), False))
            floor = m.end()
    return [x for x in out if x[0]]


EDGE = "struct<pattern:string,instance:string,start:int,stop:int,seed:boolean>"
EDGE_TYPE = pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                       ("seed", pa.bool_())])


def extracted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(uid, doc_id, base, edges) per row; ``uid`` is a row's place in the input."""
    slim = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").cast("long").alias("doc_id"),
                     F.col(f"`{text}`").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, edges = [], []
            for body in strings(batch):
                spans = base_spans(body)
                base.append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
                edges.append([dict(zip(("pattern", "instance", "start", "stop", "seed"), x)) for x in edges_of(body, spans)])
            yield rows({"uid": batch.column("uid"), "doc_id": batch.column("doc_id"), "base": base, "edges": edges},
                       base=pa.string(), edges=pa.list_(EDGE_TYPE))

    return map_arrow(slim, scan, f"uid long, doc_id long, base string, edges array<{EDGE}>")


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD,
                     min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, confidence) of the patterns over the threshold, from the graph of all rows."""
    graph = materialise(found.select(F.explode("edges").alias("e")).groupBy("e.pattern", "e.instance")
                        .agg(F.max(F.col("e.seed").cast("double")).alias("seed")), "pattern-graph")
    belief = graph.withColumn("belief", F.col("seed"))
    for _ in range(rounds):
        patterns = materialise(belief.groupBy("pattern").agg(
            (F.sum("belief") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.sum("seed").alias("seeds")), "patterns")
        scored = graph.join(patterns.select("pattern", "confidence"), "pattern")
        best = scored.groupBy("instance").agg(F.max("confidence").alias("best"))
        belief = graph.join(best, "instance").select("pattern", "instance", "seed", F.greatest("seed", "best").alias("belief"))
    return patterns.where((F.col("confidence") >= threshold) & (F.col("seeds") >= min_seeds)).select("pattern", "confidence")


def context_spans(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """(uid, extra): spans that trusted patterns tell; only rows that have some."""
    told = (found.where(F.exists("edges", lambda e: ~e["seed"])).select("uid", F.explode("edges").alias("e"))
            .where(~F.col("e.seed")).select("uid", "e.pattern", "e.start", "e.stop")
            .join(patterns.select("pattern"), "pattern", "left_semi"))
    return told.groupBy("uid").agg(F.collect_list(F.concat_ws(":", F.lit("context"), "start", "stop")).alias("extra"))


def _merge(base: str, extra: list[str] | None) -> str:
    spans = [x.split(":") for x in (base.split(",") if base else []) + list(extra or [])]
    return ",".join(":".join(x) for x in sorted(spans, key=lambda x: (int(x[1]), KINDS.index(x[0]))))


def find_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans) per row."""
    found = materialise(extracted(df, key, text), "personal")
    all_spans = found.select("uid", "doc_id", "base").join(context_spans(found, trusted_patterns(found)), "uid", "left")

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = batch.column("base").to_pylist()
            spans = [_merge(b, x) for b, x in zip(base, batch.column("extra").to_pylist())]
            counts = {f"n_{k}": [s.count(f"{k}:") for s in spans] for k in KINDS}
            yield rows({"doc_id": batch.column("doc_id"), **counts,
                        "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base], "spans": spans},
                       **{k: pa.int64() for k in counts}, base_sha256=pa.string(), spans=pa.string())

    return map_arrow(all_spans, report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                        "n_context long, base_sha256 string, spans string")


def masked(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, s, e in (x.split(":") for x in spans.split(",") if x):
        if int(e) <= at:
            continue
        out += [text[at:max(at, int(s))], f"<{kind.upper()}>"]
        at = int(e)
    return "".join([*out, text[at:]])


def mask_personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with masked texts. Only texts with spans from contexts take part in a join."""
    columns = df.columns
    body = materialise(df.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in columns])
                                 .alias("row")), "unmasked")
    packed = body.select("uid", F.col(f"row.`{key}`").alias("doc_id"), F.col(f"row.`{text}`").alias("text"))
    found = materialise(_extract_saved(packed), "personal")
    extra = materialise(context_spans(found, trusted_patterns(found)), "context-spans")
    joined = body.join(extra, "uid", "left")
    schema = T.StructType([body.schema["row"], T.StructField("masked", T.StringType())])

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body_text, more in zip(inner(batch, text).cast(pa.string()).to_pylist(), batch.column("extra").to_pylist()):
                base = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(body_text or ""))
                out.append(None if body_text is None else masked(body_text, _merge(base, more)))
            yield rows({"row": batch.column("row"), "masked": out}, masked=pa.string())

    done = map_arrow(joined.select("row", "extra"), mask, schema)
    return done.select(*[F.col("masked").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns])


def _extract_saved(packed: DataFrame) -> DataFrame:
    """As ``extracted``, for rows that carry their ``uid`` already."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [[dict(zip(("pattern", "instance", "start", "stop", "seed"), x)) for x in edges_of(b, base_spans(b))]
                     for b in strings(batch)]
            yield rows({"uid": batch.column("uid"), "edges": edges}, edges=pa.list_(EDGE_TYPE))

    return map_arrow(packed.select("uid", F.col("text").cast("string").alias("text")), scan,
                     f"uid long, edges array<{EDGE}>")
