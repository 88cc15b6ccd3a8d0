"""Ordered work on even slices: running totals, earlier rows and folds over keys of any number of rows.

Rows are dealt by range of their order, keys first, so that slices hold about as many rows each however the
rows crowd in time or on a key; a slice is a column of a stored table. What runs along a key is done in each
slice alone and then carried from slice to slice in tables of a row for each slice and key that goes on:

- sums and maxima are carried by adding up what the slices before hold;
- a value some rows earlier is in the slice, or among the last rows of the slices before;
- a fold, whose steps depend on the exact state before them, begins in each slice with the state in which the
  slice before ended. The states are not known at first, so slices are folded again until they end as they
  were taken to end: then, from the first slice on, every one began with the true state. Smoothing forgets
  where it began, so slices of some thousand rows are folded twice.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from temblor.operators.graph import discard, stored
from temblor.session import ship_package

#: Rows of a slice, and the least where rows are dealt over all cores; up to ``ROWS``, keys are dealt whole over
#: ``SMALL`` slices and nothing is carried.
ROWS, LEAST_ROWS, SMALL = 1 << 19, 1 << 15, 16


def dealt(rows: DataFrame, keys: list[str], order: list[str], n: int, name: str = "slices") -> tuple[DataFrame, bool]:
    """The rows, of which there are about ``n``, with their slice ``part``, and whether keys go over slices. Few
    rows are dealt by key, as they are; more are dealt by range and stored."""
    if n <= ROWS:
        return rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(SMALL)).cast("int")), False
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // ROWS), min(cores, n // LEAST_ROWS), 2)
    ranged = rows.repartitionByRange(parts, *keys, *order)
    return stored(ranged.withColumn("part", F.spark_partition_id()), name), True


def _along(keys: list[str], order: list[str]) -> W:
    return W.partitionBy("part", *keys).orderBy(*order)


def _going_on(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (part, keys) of keys that are in several slices."""
    several = parts.groupBy(*keys).agg(F.count("*").alias("n_parts")).filter("n_parts > 1").drop("n_parts")
    return parts.join(several, keys, "left_semi")


def running(rows: DataFrame, spans: bool, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Adds the sums and maxima of columns over a key's rows up to each row."""
    sums, maxima = sums or {}, maxima or {}
    rows = rows.withColumns(sums | maxima)
    upto = _along(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.withColumns({c: F.sum(c).over(upto) for c in sums} | {c: F.max(c).over(upto) for c in maxima})
    if not spans:
        return local
    totals = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
    parts = _going_on(rows.groupBy("part", *keys).agg(*totals), keys)
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a slice
    before = parts.select("part", *keys, *(F.sum(c).over(earlier).alias(f"{c}_before") for c in sums), *(F.max(c).over(earlier).alias(f"{c}_before") for c in maxima))
    joined = local.join(before, ["part", *keys], "left")
    whole = {c: F.col(c) + F.coalesce(F.col(f"{c}_before"), F.lit(0)) for c in sums} | {c: F.greatest(F.col(c), F.col(f"{c}_before")) for c in maxima}
    return joined.withColumns(whole).drop(*(f"{c}_before" for c in [*sums, *maxima]))


def earlier_value(rows: DataFrame, spans: bool, keys: list[str], order: list[str], value: str, k: int, rank: str, out: str) -> DataFrame:
    """Adds the value of the row ``k`` rows earlier, or of a key's first row; ``rank`` numbers a key's rows."""
    along = _along(keys, order)
    if not spans:
        return rows.withColumn(out, F.first(value).over(along.rowsBetween(-k, 0)))
    kept = rows.withColumns({out: F.first(value).over(along.rowsBetween(-k, 0)), "_own": F.row_number().over(along), "_left": F.lead(F.lit(1), k).over(along)})
    last = kept.filter(F.col("_left").isNull()).select(*keys, F.col(rank).alias("_rank"), F.struct(F.col(value).alias("x")).alias("_found"))  # k rows a slice and key
    last = last.join(_going_on(rows.select("part", *keys).distinct(), keys).select(*keys).distinct(), keys, "left_semi")
    sought = F.when((F.col("_own") <= k) & (F.col(rank) > F.col("_own")), F.greatest(F.col(rank) - k, F.lit(1)))
    joined = kept.withColumn("_rank", sought).join(last, [*keys, "_rank"], "left")
    value_ = F.when(F.col("_found").isNotNull(), F.col("_found.x")).otherwise(F.col(out))
    return joined.withColumn(out, value_).drop("_own", "_left", "_rank", "_found")


Step = Callable[[dict[str, list], list], list[list]]


def folded(rows: DataFrame, spans: bool, keys: list[str], order: list[str], step: Step, states: dict[str, str], name: str = "fold") -> DataFrame:
    """Adds the columns ``states`` (name: type) of a fold along each key's rows.

    ``step(columns, state)`` takes a stretch of a key's rows as a dict of lists and the state before it, a list
    with None where there is none, and gives the states after each row, a list for each of ``states``."""
    ship_package(rows.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {t}" for c, t in (fields | states).items())
    held, names = list(states), list(fields)

    def run(own: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["part", *keys, *order], ignore_index=True)
        begun = {tuple(r[:-1]): r[-1] for r in start[[*keys, "state"]].itertuples(index=False, name=None)} if len(start) else {}
        cuts = [0, *((own[keys] != own[keys].shift()).any(axis=1).to_numpy().nonzero()[0][1:].tolist() if len(own) else []), len(own)]
        found: list[list] = [[] for _ in held]
        for low, high in zip(cuts, cuts[1:], strict=False):
            some = own.iloc[low:high]
            key = tuple(some[keys].iloc[0].tolist()) if high > low else ()
            before = begun.get(key)
            before = [None] * len(held) if before is None else [before[c] for c in held]
            for c, xs in zip(found, step({c: some[c].tolist() for c in names}, before), strict=True):
                c.extend(xs)
        return own.assign(**{c: pd.Series(xs, dtype="float64" if states[c] == "double" else "object") for c, xs in zip(held, found, strict=True)})[[*names, *held]]

    if not spans:
        none = pd.DataFrame()
        return rows.groupBy("part").applyInPandas(lambda own: run(own, none), schema)
    rows, starts = stored(rows, name), None
    while True:
        begin = starts if starts is not None else _no_starts(rows, keys, states)
        out = stored(rows.groupBy("part").cogroup(begin.groupBy("part")).applyInPandas(run, schema), name)
        ends = _going_on(out.groupBy("part", *keys).agg(F.max_by(F.struct(*held), F.struct(*order)).alias("state")), keys)
        to_next = F.lag("state").over(W.partitionBy(*keys).orderBy("part"))
        found = stored(ends.select("part", *keys, to_next.alias("state")).filter("state IS NOT NULL"), f"{name}-starts")
        if found.exceptAll(begin.select(*found.columns)).isEmpty():
            return out
        discard(out)
        starts = found


def _no_starts(rows: DataFrame, keys: list[str], states: dict[str, str]) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    state = ", ".join(f"{c}: {t}" for c, t in states.items())
    return rows.sparkSession.createDataFrame([], ", ".join(f"{c} {fields[c]}" for c in ["part", *keys]) + f", state struct<{state}>")


def smoothing(betas: dict[str, float]) -> Step:
    """A step of ``folded`` that smooths each column with its factor, from its first value on; nulls and NaN
    are passed over."""

    def step(columns: dict[str, list], state: list) -> list[list]:
        out = []
        for (value, beta), y in zip(betas.items(), state, strict=True):
            keep, found = 1 - beta, []
            y = None if y is None or y != y else y
            for x in columns[value]:
                if x is not None and x == x:
                    y = x if y is None else beta * x + keep * y
                found.append(y)
            out.append(found)
        return out

    return step

