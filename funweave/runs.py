"""Range-sorted runs: sort by a composite key on sampled quantiles, so that a heavy key spans several
partitions, reduce each partition's runs to partial states, and stitch the states at the boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

STATE = T.StructType(
    [
        T.StructField("field_name", T.StringType()),
        T.StructField("key_text", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_members", T.LongType()),
        T.StructField("first_member", T.StringType()),
        T.StructField("last_member", T.StringType()),
    ]
)


def changes(columns: list[pa.Array]) -> np.ndarray:
    """True where a row differs from the row before it in one of the columns, null being a value; the first row counts as different."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for a in columns:
        x, y = a.slice(1), a.slice(0, n - 1)
        same = pc.fill_null(pc.equal(x, y), False).to_numpy(zero_copy_only=False)
        if a.null_count:
            same |= (x.is_null().to_numpy(zero_copy_only=False) & y.is_null().to_numpy(zero_copy_only=False))
        out[1:] |= ~same
    return out


def _states(b: pa.RecordBatch, part: int) -> pa.Table:
    """A state of each (field_name, key_text) run of a sorted batch."""
    keys, member = [b.column("field_name"), b.column("key_text")], b.column("member")
    start = np.flatnonzero(changes(keys))
    end = np.append(start[1:], b.num_rows)
    fresh = changes([*keys, member]) & member.is_valid().to_numpy(zero_copy_only=False)
    columns = [
        *(k.take(pa.array(start)) for k in keys), pa.array(np.full(len(start), part, "int32")), pa.array((end - start).astype("int64")),
        pa.array(np.add.reduceat(fresh.astype("int64"), start)), member.take(pa.array(start)), member.take(pa.array(end - 1)),
    ]
    return pa.Table.from_arrays(columns, names=STATE.names)


def run_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state for each (field_name, key_text) run of a sorted partition: the run at the end of a batch is held open."""
    part, held = TaskContext.get().partitionId(), None
    for b in batches:
        if not b.num_rows:
            continue
        t = _states(b, part)
        if held is not None:
            first = t.slice(0, 1).to_pylist()[0]
            if (first["field_name"], first["key_text"]) == (held["field_name"], held["key_text"]):
                again = int(held["last_member"] is not None and held["last_member"] == first["first_member"])
                held |= {"n_rows": held["n_rows"] + first["n_rows"], "n_members": held["n_members"] + first["n_members"] - again, "last_member": first["last_member"]}
                t = t.slice(1)
            if t.num_rows:
                yield from pa.Table.from_pylist([held], t.schema).to_batches()
        if t.num_rows:
            held = t.slice(t.num_rows - 1).to_pylist()[0]
            yield from t.slice(0, t.num_rows - 1).to_batches()
    if held is not None:
        yield from pa.Table.from_pylist([held], pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.string())) for f in STATE])).to_batches()


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Rows (field_name, key_text, member, tie) -> field_name, key_text, n_rows, n_members.

    n_members is the number of distinct non-null members. The composite sort key ends with tie, so neither a key
    nor a (key, member) pair with a third of all rows has to fit one partition. Each partition yields one state of a
    key, so no more states of a key are stitched than there are partitions. A member that two neighbouring
    states share is subtracted once. Nulls sort first, so a state's first member is null only if it begins with
    null members.
    """
    order = ["field_name", "key_text", "member", "tie"]
    states = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").mapInArrow(run_states, STATE)
    before = F.lag("last_member").over(W.partitionBy("field_name", "key_text").orderBy("part"))
    return (
        states.withColumn("again", F.coalesce((before == F.col("first_member")).cast("long"), F.lit(0)))
        .groupBy("field_name", "key_text")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_members") - F.col("again")).alias("n_members"))
    )
