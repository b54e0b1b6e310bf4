"""Exact quantiles of large groups without gathering a group in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation
buffer, which fails for continuous measures at scale. Here a bounded sketch brackets the
wanted ranks, and the exact values are then found inside the brackets only:

1. First scan: ``percentile_approx`` gives a value below and above each wanted rank (fixed memory).
2. Second scan: values outside the brackets are counted, values inside them are counted by value,
   in one aggregate that combines map-side, so only values near the wanted ranks are shuffled. These
   counts are saved; a value that fills a third of the table is one row of them.
3. The ranks are searched in the saved counts. A bracket with more than ``limit`` distinct values is
   divided into ``_CELLS`` equal-width cells, running counts over cells (a bounded number of rows per
   bracket) name the cells that hold a rank, and those are divided again while they are too large. So
   no task orders more than ``limit`` values.

The result interpolates linearly between neighbouring ranks, as the usual default does.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvseries.operators.clean import quoted
from pvseries.sources.tables import materialise

_CELLS = 1024
_LIMIT = 200_000


def melt(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Long form (groups, column, value) of numeric columns; missing values are dropped."""
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in columns]
    long = df.select(*groups, F.explode(F.array(*cells)).alias("__c")).select(*groups, "__c.*")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    groups: Sequence[str] = (), accuracy: int = 10_000, limit: int = _LIMIT) -> DataFrame:
    """(groups, column, n, q0, q1, ...): one value per entry of ``probs``.

    Runs when called: the table is read twice, and its counts near the ranks are saved.
    """
    asked, probs = list(probs), sorted(probs)
    groups = list(groups)
    keys, index = [*[f"__g{k}" for k in range(len(groups))], "__i"], range(len(columns))
    numbers = [quoted(c).cast("double") for c in columns]
    wide = df.select(*[quoted(g).alias(k) for g, k in zip(groups, keys)],
                     *[F.when(~F.isnan(v), v + F.lit(0.0)).alias(f"__v{i}") for i, v in enumerate(numbers)])
    counts = materialise(_bracket_counts(wide, keys[:-1], index, probs, accuracy), "quantile-counts")

    slots = counts.groupBy(*keys, "__slot").agg(F.sum("__c").alias("__c"))
    whole = Window.partitionBy(*keys)  # at most two slots per rank, and one more
    before = whole.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slots.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).withColumn("n", F.sum("__c").over(whole))
    ranks = [_rank(q) for q in probs]
    flat = [r for low, frac in ranks for r in (low, F.when(frac > 0, low + 1).otherwise(low))]
    chosen = placed.filter(_holds(flat)).select(*keys, "__slot", "__before", "n")
    missed = F.raise_error(F.lit("quantile sketch missed a rank: raise accuracy"))
    near = same(counts, chosen, [*keys, "__slot"]).withColumn("__path", F.array(F.lit(0)))
    cell, crowded = [*keys, "__slot", "__path"], _crowded(counts, [*keys, "__slot"], limit)

    while crowded:
        finite = F.when(F.abs("__v") < float("inf"), F.col("__v"))
        spans = materialise(near.groupBy(*cell).agg(F.count(F.lit(1)).alias("__k"), F.min(finite).alias("__lo"), F.max(finite).alias("__hi")),
                            "quantile-spans")
        lo, hi, v = F.col("__lo") / 2, F.col("__hi") / 2, F.col("__v") / 2  # halves: no difference overflows
        step = F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * _CELLS).cast("int")
        step = F.when(v == float("inf"), _CELLS + 1).when(v == -float("inf"), -1).otherwise(F.coalesce(step, F.lit(0)))
        split = same(near, spans, cell).withColumn("__path", F.when(F.col("__k") > limit, F.concat("__path", F.array(step))).otherwise(F.col("__path")))
        inside = split.groupBy(*keys, "__slot", "__path", "__before", "n").agg(F.sum("__c").alias("__sum"))
        # At most _CELLS + 2 cells for each that was cut.
        own = Window.partitionBy(*keys, "__slot", "__before").orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)
        cells = inside.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__sum").over(own), F.lit(0))).withColumn("__c", F.col("__sum"))
        kept = cells.filter(_holds(flat, "__start")).select(*cell, F.col("__start").alias("__from"))
        near = materialise(same(split.drop("__k", "__lo", "__hi"), kept, cell).withColumn("__before", F.col("__from")).drop("__from"),
                           "quantile-near")
        crowded = _crowded(near, cell, limit)

    in_cell = Window.partitionBy(*cell).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = near.withColumn("__upto", F.col("__before") + F.sum("__c").over(in_cell))
    known = F.when(F.col("__v").isNotNull(), F.col("__v")).otherwise(missed.cast("double"))
    picks = [F.max(F.when((r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__c")), known)).alias(f"__r{k}") for k, r in enumerate(flat)]
    picked = ordered.groupBy(*keys, "n").agg(*picks)
    out = []
    for k, q in enumerate(asked):
        j = probs.index(q)
        low, high, frac = F.col(f"__r{2 * j}"), F.col(f"__r{2 * j + 1}"), ranks[j][1]
        out.append(F.when(low == high, low).otherwise(low + (high - low) * frac).alias(f"q{k}"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__i") + 1)
    return picked.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], name.alias("column"), "n", *out)


def _bracket_counts(wide: DataFrame, groups: list[str], index: range, probs: list[float], accuracy: int) -> DataFrame:
    """(groups, __i, __slot, __v, __c): slot 2j+1 is bracket j, by value; slot 2j what lies between brackets j-1 and j, without."""
    margin = 4.0 / accuracy
    shares = [p for q in probs for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    cuts = f"array({', '.join(f'{p:.12f}D' for p in shares)}), {accuracy}"
    sketch = wide.groupBy(*groups).agg(*[F.expr(e) for i in index for e in (
        f"count(__v{i}) AS n{i}", f"min(__v{i}) AS min{i}", f"max(__v{i}) AS max{i}",
        f"percentile_approx(__v{i}, {cuts}) AS cut{i}")])
    bounds = []
    for i in index:
        small = f"n{i} * {margin}D < 4"     # a few thousand values: bracket them all
        for j, q in enumerate(probs):
            lo, hi = ("true" if q - margin <= 0 else small), ("true" if q + margin >= 1 else small)
            bounds += [f"IF({lo}, min{i}, cut{i}[{2 * j}]) AS lo{i}_{j}",
                       f"IF({hi}, max{i}, cut{i}[{2 * j + 1}]) AS hi{i}_{j}"]
    table = sketch.selectExpr(*groups, *bounds)
    if groups:
        # Saved: the size of the stored table decides whether it is broadcast.
        wide, bound = same(wide, materialise(table, "quantile-sketch"), groups), str
    else:
        row = table.first()                 # two numbers per column and rank
        bound = lambda name: _literal(row[name])
    cells = []
    for i in index:
        steps = "".join(f" WHEN __v{i} < {bound(f'lo{i}_{j}')} THEN {2 * j} WHEN __v{i} <= {bound(f'hi{i}_{j}')} THEN {2 * j + 1}"
                        for j in range(len(probs)))
        slot = f"CASE{steps} ELSE {2 * len(probs)} END"
        cells.append(f"IF(__v{i} IS NULL, NULL, named_struct('__i', {i}, '__slot', {slot}, '__v', __v{i}))")
    long = wide.select(*groups, F.expr(f"explode(array({', '.join(cells)}))").alias("__l")).filter("__l IS NOT NULL").select(*groups, "__l.*")
    return (long.withColumn("__v", F.when(F.col("__slot") % 2 == 1, F.col("__v")))
            .groupBy(*groups, "__i", "__slot", "__v").agg(F.count(F.lit(1)).alias("__c")))


def same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, where missing keys are equal too."""
    named = right.select(*[F.col(c).alias(f"__on{k}") if c in on else F.col(c) for k, c in enumerate(right.columns)])
    hit = reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"__on{k}"]) for k, c in enumerate(right.columns) if c in on])
    return left.join(named, hit).drop(*[c for c in named.columns if c.startswith("__on")])


def _crowded(values: DataFrame, cell: list[str], limit: int) -> bool:
    return bool(values.groupBy(*cell).agg(F.count(F.lit(1)).alias("__k")).filter(F.col("__k") > limit).limit(1).count())


def _holds(ranks: Sequence[Column], start: str = "__before") -> Column:
    """Whether a run of ``__c`` values from rank ``start`` on holds one of the ranks."""
    hit = F.lit(False)
    for r in ranks:
        hit = hit | ((r >= F.col(start)) & (r < F.col(start) + F.col("__c")))
    return hit


def _literal(x: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"double('{x!r}')"


def _rank(q: float) -> tuple[Column, Column]:
    """0-based lower rank and the fraction towards the next one, for ``n`` values."""
    place = F.lit(float(q)) * (F.col("n") - 1)
    return F.floor(place), place - F.floor(place)
