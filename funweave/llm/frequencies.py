"""Frequency of every distinct value or n-gram (problem 5), by suffixes and their common prefixes.

The suffixes of all value sequences, each as its next max_n values, are sorted once over the whole collection, by range.
The common prefix of two neighbours tells for every n at once whether the same n-gram goes on: the suffixes that begin
with one n-gram form an interval, its length the number of occurrences. An interval that spans partitions gives one
state for each of them, and the states are summed.

For the number of records the suffixes are sorted a second time, within their record: where two neighbours of one record
have a common prefix of m values, the record holds their first 1, .., m values once more, and so much is subtracted. A
record may hold a third of all suffixes: it too is parted by range, and the neighbours across a boundary are compared
from the first and last suffix of each partition.

Null values are none and end no n-gram; occurrences without a record count as occurrences only. Values are compared as
they are, in columns of their own; nothing is joined to a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from funweave.functions.text import norm_id
from funweave.runs import changes
from funweave.scratch import cut


def _names(max_n: int) -> list[str]:
    return [f"v{i}" for i in range(1, max_n + 1)]


def value_sequences(df: DataFrame, fields: tuple[str, ...], record: str) -> DataFrame:
    """field_name, record, vals: each cell as a sequence of one value."""
    cells = F.array(*(F.struct(F.lit(f).alias("field_name"), F.array(norm_id(F.col(f))).alias("vals")) for f in fields))
    return df.select(F.col(record).cast("string").alias("record"), F.explode(cells).alias("c")).select("c.field_name", "record", "c.vals")


def array_sequences(df: DataFrame, values: str, record: str) -> DataFrame:
    """field_name, record, vals of an array column."""
    return df.select(F.lit(values).alias("field_name"), F.col(record).cast("string").alias("record"), F.col(values).alias("vals"))


def suffixes(sequences: DataFrame, max_n: int) -> DataFrame:
    """field_name, record, v1 .. v(max_n): the next values from every position on, null beyond the end."""
    rows = sequences.select("field_name", "record", F.filter("vals", lambda x: x.isNotNull()).alias("vals")).filter("size(vals) > 0")
    if max_n == 1:
        return rows.select("field_name", "record", F.explode("vals").alias("v1"))
    at = rows.select("field_name", "record", "vals", F.explode(F.sequence(F.lit(0), F.size("vals") - 1)).alias("at"))
    return at.select("field_name", "record", *(F.get("vals", F.col("at") + i).alias(n) for i, n in enumerate(_names(max_n))))


def _counted(batch: pa.RecordBatch, names: list[str], n: int, keep: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows field_name, v.., n, c of the kept rows; values after the n-th are null."""
    take = pa.array(np.flatnonzero(keep))
    cols = [batch.column("field_name").take(take), *(batch.column(v).take(take) if i < n else pa.nulls(len(take), pa.string()) for i, v in enumerate(names))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(take), n, "int32")), pa.array(counts.astype("int64"))], names=["field_name", *names, "n", "c"])


def _intervals(max_n: int):  # noqa: ANN202
    """For mapInArrow over suffixes sorted by field_name and values: one row per n-gram and batch that it occurs in."""
    names = _names(max_n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            edge = changes([b.column("field_name")])
            for n, v in enumerate(names, 1):
                edge = edge | changes([b.column(v)])  # the common prefix with the row before is shorter than n
                start = np.flatnonzero(edge)
                size = np.diff(np.append(start, b.num_rows))
                held = b.column(v).is_valid().to_numpy(zero_copy_only=False)[start]
                first = np.zeros(b.num_rows, bool)
                first[start[held]] = True
                yield _counted(b, names, n, first, size[held])

    return run


def _adjacencies(max_n: int):  # noqa: ANN202
    """For mapInArrow over suffixes sorted by field_name, record and values: how often an n-gram is a record's further
    one (kind 0), and the first and last suffix of the partition (kinds 1 and 2)."""
    names = _names(max_n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, begun = TaskContext.get().partitionId(), None, False

        def edge(row: pa.RecordBatch, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [row.column("field_name"), *(row.column(v) for v in names), pa.array([0], pa.int32()), pa.array([0], pa.int64()), row.column("record"), pa.array([part], pa.int32()), pa.array([kind], pa.int32())],
                names=["field_name", *names, "n", "c", "record", "part", "kind"],
            )

        for own in batches:
            if not own.num_rows:
                continue
            if not begun:
                begun = True
                yield edge(own.slice(0, 1), 1)
            t = pa.Table.from_batches([own] if last is None else [last, own]).combine_chunks()
            b = t.to_batches()[0]
            last = own.slice(own.num_rows - 1, 1)
            new = changes([b.column("field_name"), b.column("record")])
            for n, v in enumerate(names, 1):
                new = new | changes([b.column(v)])
                again = ~new & b.column(v).is_valid().to_numpy(zero_copy_only=False)
                if again.any():
                    grams = pa.Table.from_batches([_counted(b, names, n, again, np.ones(again.sum()))])
                    sums = grams.group_by(["field_name", *names, "n"]).aggregate([("c", "sum")])
                    k = sums.num_rows
                    yield from pa.table(
                        {"field_name": sums["field_name"], **{x: sums[x] for x in names}, "n": sums["n"], "c": sums["c_sum"], "record": pa.nulls(k, pa.string()), "part": pa.nulls(k, pa.int32()), "kind": pa.array(np.zeros(k, "int32"))}
                    ).to_batches()
        if last is not None:
            yield edge(last, 2)

    return run


def gram_counts(sequences: DataFrame, max_n: int) -> DataFrame:
    """field_name, n, v1 .. v(max_n) (the n-gram), n_rows (occurrences), n_members (records) of every n-gram up to max_n values.

    Occurrences of a null record are of no record: they are counted in n_rows alone.
    """
    names = _names(max_n)
    rows = suffixes(sequences, max_n)
    values = ", ".join(f"{v} string" for v in names)
    salt = F.xxhash64(F.monotonically_increasing_id()).alias("salt")  # parts equal suffixes, that one partition may not hold
    order = ["field_name", *names]
    sorted_ = rows.select(*order, salt).repartitionByRange(*order, "salt").drop("salt").sortWithinPartitions(*order)
    occurrences = sorted_.mapInArrow(_intervals(max_n), f"field_name string, {values}, n int, c long")
    within = ["field_name", "record", *names]
    own = rows.filter("record is not null").select(*within, salt)
    near = own.repartitionByRange(*within, "salt").drop("salt").sortWithinPartitions(*within)
    near = cut(near.mapInArrow(_adjacencies(max_n), f"field_name string, {values}, n int, c long, record string, part int, kind int"), "adjacencies")
    again = near.filter("kind = 0").select("field_name", *names, "n", "c")
    # two rows of each partition: the last suffix of one against the first of the next that is not empty
    w = W.orderBy("part", "kind")
    ends = near.filter("kind > 0").withColumns({f"old_{c}": F.lag(c).over(w) for c in within}).filter("kind = 1")
    same = (F.col("field_name") == F.col("old_field_name")) & (F.col("record") == F.col("old_record"))
    levels = []
    for n, v in enumerate(names, 1):
        same = same & (F.col(v) == F.col(f"old_{v}"))
        levels.append(F.when(same, F.lit(n)))
    at = F.explode(F.filter(F.array(*levels), lambda x: x.isNotNull())).alias("n")
    ends = ends.select("field_name", *names, at).select("field_name", *(F.when(F.col("n") > i, F.col(v)).alias(v) for i, v in enumerate(names)), "n", F.lit(1).cast("long").alias("c"))
    zero = F.lit(0).cast("long")
    # nothing to subtract from where the record is null, and no record either
    none = rows.filter("record is null")
    for_none = None
    for n in range(1, max_n + 1):
        part = none.filter(F.col(names[n - 1]).isNotNull()).select("field_name", *(F.col(v) if i < n else F.lit(None).cast("string").alias(v) for i, v in enumerate(names)), F.lit(n).alias("n"), F.lit(1).cast("long").alias("c"))
        for_none = part if for_none is None else for_none.unionByName(part)
    parts = occurrences.withColumn("less", zero).unionByName(again.unionByName(ends).unionByName(for_none).select("field_name", *names, "n", zero.alias("c"), F.col("c").alias("less")))
    return parts.groupBy("field_name", "n", *names).agg(F.sum("c").alias("n_rows"), F.sum(F.col("c") - F.col("less")).alias("n_members"))


def value_counts(df: DataFrame, fields: tuple[str, ...] = ("go_id", "evidence_code"), record: str = "db_object_id") -> DataFrame:
    """field_name, val_text, n_rows (occurrences), n_members (records) of each distinct value: the n-grams of one value."""
    return gram_counts(value_sequences(df, fields, record), 1).select("field_name", F.col("v1").alias("val_text"), "n_rows", "n_members")


def marked_values(df: DataFrame, rare: int = 3, common: float = 0.05, record: str = "db_object_id") -> DataFrame:
    """value_counts with mark: `rare` with fewer than `rare` records, `common` with more than that share of all records, else null."""
    total = df.agg(F.countDistinct(record).alias("n_all"))  # one row
    mark = F.when(F.col("n_members") < rare, "rare").when(F.col("n_members") > common * F.col("n_all"), "common")
    return value_counts(df, record=record).crossJoin(F.broadcast(total)).select("field_name", "val_text", "n_rows", "n_members", mark.alias("mark"))
