"""Ordered operators on (site, time) series that survive one very long site.

A window partitioned by site alone puts a site's whole history in one task. So the table is
range-partitioned by site, time and ties, and saved once with the partition number as its chunk.
Ranges hold about equal numbers of rows, wherever the rows of a site bunch, and rows without a
site are cut like others. Windows run per (site, chunk); what must cross a border (row counts,
the last known value) is aggregated to one row per site and chunk, run through a small window
over a site's chunks, and joined back. Only sites that straddle a border enter that table: at
most two rows per chunk, and one more per chunk inside a long site.

Values needed from later rows come from a second window in descending order. A frame that
reaches forward to the end of the partition would be recomputed for every row.

Rows that are equal in site, time and ties are told apart by their place in the input, so any number
of them is cut like other rows. The saved chunks are the only table that an operator writes: borders
are summed up from them, and what is carried across a border from columns that were computed here is
computed once more for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pvseries.config import SplitSpec
from pvseries.functions.calendar import micros
from pvseries.sources.tables import materialise

_CHUNK, _PLACE = "__chunk", "__place"


class Chunked:
    """A series table with its chunk column, and the windows that go with it.

    ``chunks`` sets the number of range partitions; without it the session's settings do.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str] = (),
                 chunks: int | None = None):
        self.keys, self.ts, self.ties, self.columns = list(keys), ts, [*ties, _PLACE], df.columns
        ranged = df.withColumn(_PLACE, F.monotonically_increasing_id()).repartitionByRange(
            *([chunks] if chunks else []), *self.keys, ts, *self.ties)
        self.df = materialise(ranged.withColumn(_CHUNK, F.spark_partition_id()), "series")

    @property
    def parts(self) -> list[str]:
        """Window partition: the site and the chunk."""
        return [*self.keys, _CHUNK]

    # windows -----------------------------------------------------------------
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(self.ts, *self.ties)

    def up_to_here(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def back_to_here(self) -> WindowSpec:
        order = [F.col(c).desc() for c in (self.ts, *self.ties)]
        return (Window.partitionBy(*self.parts).orderBy(*order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.parts)

    # chunk-level carry -------------------------------------------------------
    def carry(self, totals: Mapping[str, Column], carried: Mapping[str, Column],
              first: Mapping[str, Column] | None = None) -> "Chunked":
        """Join one row per chunk of a site that straddles a border back to its rows.

        ``totals`` are aggregates per chunk; ``carried`` are expressions over those totals,
        evaluated across the chunks of a site, after those of ``first``. Sites inside one chunk
        receive nulls.
        """
        per_chunk = self.df.groupBy(*self.keys, _CHUNK).agg(*[agg.alias(name) for name, agg in totals.items()])
        names = {k: f"__key{i}" for i, k in enumerate(self.keys)}
        table = per_chunk.withColumns(dict(first or {})).select(
            *[F.col(k).alias(n) for k, n in names.items()], F.col(_CHUNK).alias("__of"),
            *[c.alias(n) for n, c in carried.items()], F.count(F.lit(1)).over(self.all_chunks()).alias("__several"),
        ).filter("__several > 1").drop("__several")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()],
                      F.col(_CHUNK) == F.col("__of"))
        return self.with_df(self.df.join(table, same, "left").drop("__of", *names.values()))

    def earlier_chunks(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(_CHUNK).rowsBetween(
            Window.unboundedPreceding, -1)

    def later_chunks(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(F.col(_CHUNK).desc()).rowsBetween(
            Window.unboundedPreceding, -1)

    def all_chunks(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    # plumbing ----------------------------------------------------------------
    def with_df(self, df: DataFrame) -> "Chunked":
        other = object.__new__(Chunked)
        other.__dict__.update(self.__dict__, df=df)
        return other

    def with_columns(self, columns: Mapping[str, Column]) -> "Chunked":
        return self.with_df(self.df.withColumns(dict(columns)))

    def done(self, *extra: str) -> DataFrame:
        return self.df.select(*self.columns, *extra)

    def positioned(self, pos: str = "__pos", total: str | None = None) -> "Chunked":
        """Add the 0-based position of each row in its site and, on request, the site's size."""
        carried = {"__before": F.sum("__rows").over(self.earlier_chunks())}
        if total:
            carried["__all"] = F.sum("__rows").over(self.all_chunks())
        out = self.carry({"__rows": F.count(F.lit(1))}, carried)
        row = F.row_number().over(self.window()) - 1
        out = out.with_columns({pos: row + F.coalesce("__before", F.lit(0))})
        if total:
            here = F.count(F.lit(1)).over(self.whole())
            out = out.with_columns({total: F.coalesce("__all", here)})
        return out.with_df(out.df.drop("__before", "__all"))


def row_position(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str] = (),
                 col: str = "pos", chunks: int | None = None) -> DataFrame:
    """0-based position of every row in its site, in time order."""
    return Chunked(df, keys, ts, ties, chunks).positioned(col).done(col)


def gap_audit(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str] = (),
              per_site: bool = False, chunks: int | None = None) -> DataFrame:
    """How often each time difference to the previous row of the site occurs, in seconds."""
    s = Chunked(df.select(*keys, ts, *ties), keys, ts, ties, chunks)
    s = s.carry({"__max": F.max(micros(ts))}, {"__last": F.max("__max").over(s.earlier_chunks())})
    previous = F.coalesce(F.lag(micros(ts)).over(s.window()), F.col("__last"))
    gaps = s.df.select(*keys, ((micros(ts) - previous) / F.lit(1e6)).alias("gap_seconds"))
    by = [*keys, "gap_seconds"] if per_site else ["gap_seconds"]
    return (gaps.filter(F.col("gap_seconds").isNotNull()).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n")))


def _fill_both_ways(s: Chunked, cols: Sequence[str]) -> Chunked:
    """Last known value, else next known value, for each column."""
    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(),
                      F.struct(micros(s.ts).alias("t"), *s.ties, F.col(c).alias("v")))

    totals, carried = {}, {}
    for i, c in enumerate(cols):
        totals |= {f"__hi{i}": F.max(known(c)), f"__lo{i}": F.min(known(c))}
        carried |= {
            f"__prev{i}": F.last(f"__hi{i}", True).over(s.earlier_chunks()).getField("v"),
            f"__next{i}": F.last(f"__lo{i}", True).over(s.later_chunks()).getField("v")}
    out = s.carry(totals, carried)
    back = {f"__back{i}": F.last(c, True).over(out.back_to_here()) for i, c in enumerate(cols)}
    out = out.with_columns(back)
    filled = {c: F.coalesce(F.last(c, True).over(out.up_to_here()), f"__prev{i}", f"__back{i}",
                            f"__next{i}") for i, c in enumerate(cols)}
    out = out.with_columns(filled)
    spare = [f"{p}{i}" for i in range(len(cols)) for p in ("__prev", "__next", "__back")]
    return out.with_df(out.df.drop(*spare))


def ffill_bfill(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                ties: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """Forward fill without limit, then backward fill what is left at the start."""
    return _fill_both_ways(Chunked(df, keys, ts, ties, chunks), cols).done()


def interpolate_time(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                     ties: Sequence[str] = (), limit: int | None = 3,
                     max_gap: int | None = None, then_fill: bool = True,
                     chunks: int | None = None) -> DataFrame:
    """Time-weighted linear interpolation of missing values, per site.

    A missing row is filled when it lies within ``limit`` rows of a known value on either
    side; before the first and after the last known value the nearest one is used. With
    ``then_fill`` the rest is forward- and then backward-filled. ``max_gap`` leaves runs of
    more missing rows than that untouched by the interpolation.
    """
    s = Chunked(df, keys, ts, ties, chunks)
    now, pos = micros(ts), F.col("__pos")

    def knot(c: str, place: Column) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(place.alias("p"), now.alias("t"), F.col(c).alias("v")))

    def moved(k: str) -> Column:
        """A chunk's knot with its place in the whole site."""
        return F.when(F.col(k).isNotNull(), F.struct((F.col(k)["p"] + F.col("__start")).alias("p"), F.col(k)["t"].alias("t"),
                                                     F.col(k)["v"].alias("v")))

    s = s.with_columns({"__here": F.row_number().over(s.window()) - 1})
    totals, carried = {"__rows": F.count(F.lit(1))}, {"__before": F.col("__start")}
    for i, c in enumerate(cols):
        totals |= {f"__hi{i}": F.max(knot(c, F.col("__here"))), f"__lo{i}": F.min(knot(c, F.col("__here")))}
        carried |= {f"__cp{i}": F.last(moved(f"__hi{i}"), True).over(s.earlier_chunks()),
                    f"__cn{i}": F.last(moved(f"__lo{i}"), True).over(s.later_chunks())}
    # One merge of the borders for all that the operator needs: rows, and the known values around.
    s = s.carry(totals, carried, {"__start": F.coalesce(F.sum("__rows").over(s.earlier_chunks()), F.lit(0))})
    s = s.with_columns({"__pos": F.col("__here") + F.coalesce("__before", F.lit(0))})
    # Forward windows share the sort of the positions, backward ones that of the fill below.
    s = s.with_columns({f"__p{i}": F.coalesce(F.last(knot(c, pos), True).over(s.up_to_here()),
                                              f"__cp{i}") for i, c in enumerate(cols)})
    s = s.with_columns({f"__n{i}": F.coalesce(F.last(knot(c, pos), True).over(s.back_to_here()),
                                              f"__cn{i}") for i, c in enumerate(cols)})

    filled = {}
    for i, c in enumerate(cols):
        before, after = F.col(f"__p{i}"), F.col(f"__n{i}")
        left, right = pos - before["p"], after["p"] - pos
        near_left = F.lit(True) if limit is None else left <= limit
        near_right = F.lit(True) if limit is None else right <= limit
        if max_gap is not None:
            short = F.coalesce(left + right - 1 <= max_gap, F.lit(True))
            near_left, near_right = near_left & short, near_right & short
        span = F.nullif(after["t"] - before["t"], F.lit(0))
        line = before["v"] + (after["v"] - before["v"]) * F.coalesce((now - before["t"]) / span, F.lit(0.0))
        filled[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                     .when(before.isNotNull() & after.isNotNull(), F.when(near_left | near_right, line))
                     .when(after.isNotNull(), F.when(near_right, after["v"]))
                     .when(before.isNotNull(), F.when(near_left, before["v"])))
    s = s.with_columns(filled)
    spare = [f"{p}{i}" for i in range(len(cols)) for p in ("__cp", "__cn", "__p", "__n")]
    s = s.with_df(s.df.drop("__pos", "__here", "__before", *spare))
    return (_fill_both_ways(s, cols) if then_fill else s).done()


def chrono_split(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str] = (),
                 split: SplitSpec = SplitSpec(), chunks: int | None = None) -> DataFrame:
    """Add ``split`` (train, val, test), ``pos`` and ``split_pos`` per site, in time order.

    The cuts are the truncated products n*train and n*(train+val) in double arithmetic.
    """
    s = Chunked(df, keys, ts, ties, chunks).positioned("pos", "__n")
    n, pos = F.col("__n"), F.col("pos")
    cut1 = F.floor(n * F.lit(float(split.train)))
    cut2 = F.floor(n * F.lit(float(split.train + split.val)))
    return s.with_columns({
        "split": F.when(pos < cut1, "train").when(pos < cut2, "val").otherwise("test"),
        "split_pos": pos - F.when(pos < cut1, F.lit(0)).when(pos < cut2, cut1).otherwise(cut2),
    }).done("pos", "split", "split_pos")


def tail_holdout(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str] = (),
                 test_size: float = 0.2, chunks: int | None = None) -> DataFrame:
    """Add ``split``: the last ceil(n * test_size) rows of each site are the test part."""
    s = Chunked(df, keys, ts, ties, chunks).positioned("pos", "__n")
    first_test = F.col("__n") - F.ceil(F.col("__n") * F.lit(float(test_size)))
    return s.with_columns({
        "split": F.when(F.col("pos") < first_test, "train").otherwise("test")}).done("pos", "split")


def lookback_windows(df: DataFrame, keys: Sequence[str], ts: str, features: Sequence[str],
                     target: str, lookback: int, horizon: int = 1, max_gap_seconds: float | None = None,
                     rows: int = 1_000_000) -> DataFrame:
    """Samples of ``lookback`` consecutive rows and the target ``horizon`` rows after them.

    Expects ``split`` and ``split_pos`` from :func:`chrono_split`; a sample never crosses a
    split. Output: keys, split, ts and split_pos of the target row, ``x`` (lookback rows by
    features, oldest first) and ``y``. Rows are cut into blocks of exactly ``rows`` positions,
    and the rows a block needs from the one before it are copied over, so the blocks of a
    long site run in parallel. ``max_gap_seconds`` drops samples that span a longer gap.
    """
    reach = lookback + horizon - 1
    if rows <= reach:
        raise ValueError("rows per block must exceed lookback + horizon - 1")
    own = F.floor(F.col("split_pos") / F.lit(rows))
    tail = F.col("split_pos") % rows >= rows - reach
    blocks = df.select(
        *keys, "split", "split_pos", ts, F.col(target).cast("double").alias("y"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("__row"),
        F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))).alias("__block"))
    w = Window.partitionBy(*keys, "split", "__block").orderBy("split_pos")
    steps = [F.lag("__row", k).over(w) for k in range(reach, horizon - 1, -1)]
    out = blocks.withColumn("x", F.array(*steps))
    if max_gap_seconds is not None:
        out = out.withColumn("__step", micros(ts) - F.lag(micros(ts)).over(w))
        out = out.withColumn("__widest", F.max("__step").over(w.rowsBetween(-(reach - 1), 0)))
    out = out.filter((F.col("split_pos") >= reach) & (F.col("__block") == own))
    if max_gap_seconds is not None:
        out = out.filter(F.col("__widest") <= F.lit(int(max_gap_seconds * 1e6)))
    return out.select(*keys, "split", ts, "split_pos", "x", "y")
