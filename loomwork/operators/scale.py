"""Joins, numbers and folds that hold at any size: what the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A side of at most so many narrow rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Rows that a range is to hold, the rows sampled for each bound between ranges, and the fewest and most ranges; the most bounds the table of bounds.
RANGE, STRIDE, LEAST, RANGES = 1_000_000, 16, 128, 16_384


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if a count finds it within the bound, else as it is for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dense_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows numbered from 1 in an order, without a task that holds them all.

    They are cut into as many ranges as their number asks for, by bounds from the rows with the least hashes, the same in
    each evaluation; a row finds its range by halving. Rows are numbered in their range; what is added are the sums of a
    small table of counts.
    """
    ranges = min(RANGES, max(LEAST, rows.count() // RANGE))
    at = rows.withColumn("_at", F.struct(*order))
    some = at.select("_at").orderBy(F.xxhash64("_at"), "_at").limit(ranges * STRIDE).agg(F.sort_array(F.collect_list("_at")).alias("_some"))
    some = some.select(F.filter("_some", lambda x, i: i % STRIDE == STRIDE - 1).alias("_bounds"))
    # How many bounds lie below the row: of low and high, the half is tried as often as their number can be halved.
    halves = f"sequence(1, {ranges.bit_length() + 1})"
    low = (f"aggregate({halves}, named_struct('l', 0, 'h', size(_bounds)), (a, i) -> CASE WHEN a.l >= a.h THEN a WHEN element_at(_bounds, (a.l + a.h) div 2 + 1) < _at "
           "THEN named_struct('l', cast((a.l + a.h) div 2 + 1 AS int), 'h', a.h) ELSE named_struct('l', a.l, 'h', cast((a.l + a.h) div 2 AS int)) END).l")
    low = low.replace("(a.l + a.h) div 2 + 1)", "cast((a.l + a.h) div 2 + 1 AS int))")
    cut = at.crossJoin(F.broadcast(some)).withColumn("_range", F.expr(low)).drop("_bounds")
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy("_at")) + F.col("_before")
    return cut.join(F.broadcast(counts), "_range").withColumn(name, number).select(*rows.columns, name)


def folded(rows: DataFrame, key: str, order: list[str], begin: Callable, step: Callable, schema: str) -> DataFrame:
    """Each key's rows run in their order through ``step(state, row)``, which gives the next state and an output row.

    ``begin(row)`` gives the state before a key's first row. A task reads its keys as one sorted stream of batches, so it
    holds a batch and a state however many rows a key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, fresh = None, None, True
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                at = getattr(row, key)
                if fresh or at != last and not (pd.isna(at) and pd.isna(last)):
                    last, state, fresh = at, begin(row), False
                state, answer = step(state, row)
                out.append(answer)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
