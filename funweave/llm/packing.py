"""Filling fixed-capacity containers (problem 9): harmonic packing, topped up between classes.

Lengths are parted into reciprocal-capacity classes: class k holds the lengths in (C/(k+1), C/k], k of which fill a
container. The bins of a class take k documents of the class each, its longest first, whatever the other classes hold.
That leaves up to 1/(k+1) of a bin free; the top-up then gives this room to items of the classes after it, the longest
that fit first. Bins that hold the same lengths form a pattern, and patterns follow from the histogram of lengths alone,
which has at most C + 1 rows whatever the input. Items are numbered within their length, bucket by bucket, and every
worker finds the container of an item from its number, by arithmetic, without looking at another.

Without the top-up (`top_up=False`) the classes stand alone; `fill` of both is what the top-up is worth.

An item longer than the capacity is split into full containers and a last piece; null and empty texts have length 0
and take part as items of length 0, at most C of them to a container.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from funweave.scratch import cut

CAPACITY = 2048


def slots(length: int, capacity: int) -> int:
    """The class of a length: how many of it a container takes."""
    return capacity // length if length else capacity


def patterns(counts: dict[int, int], capacity: int, top_up: bool = True) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, containers, items of each length) of each pattern; all items are used up."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left, reverse=True)
    out, first = [], 0
    for k in sorted({slots(n, capacity) for n in left}):
        own = [n for n in lengths if slots(n, capacity) == k]
        later = [n for n in lengths if slots(n, capacity) > k]
        while any(left[n] for n in own):
            room, take = k, {}
            for n in own:
                if left[n] and room:
                    take[n] = min(left[n], room)
                    room -= take[n]
            if top_up:
                free = capacity - sum(n * c for n, c in take.items())
                for n in later:
                    c = min(left[n], free // n if n else capacity) if n <= free else 0
                    if c:
                        take[n] = c
                        free -= c * n
            times = min(left[n] // c for n, c in take.items())
            for n, c in take.items():
                left[n] -= c * times
            out.append((first, times, take))
            first += times
    return out


def pack(items: DataFrame, item: str, length: str, capacity: int = CAPACITY, top_up: bool = True, buckets: int | None = None) -> DataFrame:
    """item, piece_no, piece_len, container of each piece of each item; container numbers run from 0 without gaps."""
    n = F.coalesce(F.col(length).cast("long"), F.lit(0))
    pieces = F.when(n <= capacity, F.array(n)).otherwise(
        F.filter(F.concat(F.array_repeat(F.lit(capacity).cast("long"), (n / capacity).cast("int")), F.array(n % capacity)), lambda x: x > 0)
    )
    rows = cut(items.select(item, F.posexplode(pieces).alias("piece_no", "piece_len")), "pieces")
    # as many parts of a length as there are shuffle partitions: a length that most items have is numbered by all workers
    buckets = buckets or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(item, "piece_no"), F.lit(buckets)))
    table = cut(rows.groupBy("piece_len", "bucket").agg(F.count("*").alias("c")), "histogram")
    counts = {r[0]: r[1] for r in table.groupBy("piece_len").agg(F.sum("c")).collect()}  # at most capacity + 1 rows
    plan, used = [], dict.fromkeys(counts, 0)
    for first, times, take in patterns(counts, capacity, top_up):
        for size, c in take.items():
            plan.append((size, used[size], used[size] + c * times, c, first))
            used[size] += c * times
    # ranges of item numbers of each length, with the items in a container and the first container
    steps = items.sparkSession.createDataFrame(plan, "piece_len long, lo long, hi long, each long, first long")
    offset = F.coalesce(F.sum("c").over(W.partitionBy("piece_len").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = table.withColumn("off", offset).select("piece_len", "bucket", "off")
    at = F.row_number().over(W.partitionBy("piece_len", "bucket").orderBy(item, "piece_no")) - 1
    numbered = rows.join(offsets, ["piece_len", "bucket"]).withColumn("at", F.col("off") + at)
    return (
        numbered.join(F.broadcast(steps.groupBy("piece_len").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "each", "first"))).alias("steps"))), "piece_len")
        .withColumn("s", F.filter("steps", lambda s: (s["lo"] <= F.col("at")) & (F.col("at") < s["hi"]))[0])
        .select(item, "piece_no", "piece_len", (F.col("s.first") + F.floor((F.col("at") - F.col("s.lo")) / F.col("s.each"))).alias("container"))
    )


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, fill (share of the capacity used), fullest."""
    per = packed.groupBy("container").agg(F.sum("piece_len").alias("used"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("fill"), F.max("used").alias("fullest")
    )


def fills(items: DataFrame, item: str, length: str, capacity: int = CAPACITY) -> DataFrame:
    """fill of the classes alone and of the bins topped up."""
    items = cut(items.select(item, length), "lengths")
    one = lambda t: fill(pack(items, item, length, capacity, t), capacity).select(F.lit("topped up" if t else "classes").alias("form"), "*")
    return one(False).unionByName(one(True))
