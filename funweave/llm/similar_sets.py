"""All similar pairs between set-valued records (problem 6): multi-index binary sketches.

Records with equal sets form a class, known by its exact terms. Each class gets one bit of each of many minhashes; a bit
of two sets with similarity J agrees with probability (1 + J) / 2. The bits are packed into one code of disjoint
segments. Classes meet if they agree on all bits of at least one segment, and stay if their codes differ in no more bits
than a Hamming radius, first on the head of the code, which travels with the segments, then on all of it. Number of
segments and both radii are calibrated so that a pair at the threshold is missed with a probability of at most `miss`.
What stays is verified on the original sets.

A strict pigeonhole split (one more segment than the radius has bits) would leave segments of under eight bits at a
threshold of 0.75, and so nearly all pairs; here the segments grow with the logarithm of the number of classes, and their
number follows from the recall wanted.

A segment value that many classes share is parted into chunks, and every two chunks meet in a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from funweave.functions.text import norm_id
from funweave.scratch import cut

HEAD = 64  # bits of the code that travel with the segments
CHUNK = 2_000  # classes of one segment value, or records of one class, that meet in a task
SHIPPED_KEYS = 20_000  # crowded segment values that are broadcast; more are joined by shuffle
ELEMENTS = 8_192  # set elements that are hashed at once
MISS = 1e-6


def _radius(bits: int, same: float, miss: float) -> int:
    """The least number of differing bits that a pair at the threshold exceeds with a probability of at most miss."""
    tail, radius = 0.0, bits
    while radius > 0:
        tail += math.exp(math.lgamma(bits + 1) - math.lgamma(radius + 1) - math.lgamma(bits - radius + 1) + radius * math.log(1 - same) + (bits - radius) * math.log(same))
        if tail > miss:
            break
        radius -= 1
    return radius


def plan(n_sets: int, threshold: float, miss: float) -> tuple[int, int, int, int]:
    """Bits of a segment, number of segments, Hamming radius of the head and of the whole code."""
    bits = min(30, max(8, math.ceil(math.log2(max(2, n_sets))) - 4))  # a value is shared by some 16 classes at random
    same = min((1 + threshold) / 2, 1 - 1e-9)
    segments = max(math.ceil(math.log(miss / 3) / math.log1p(-(same**bits))), math.ceil(HEAD / bits))
    return bits, segments, _radius(HEAD, same, miss / 3), _radius(bits * segments, same, miss / 3)


def _minima(values: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least hash of each set under each seed, in 32 bits."""
    x = values[:, None] ^ seeds[None, :]
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return np.minimum.reduceat(x, offsets, axis=0)


def _bits(values: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One bit of each minhash of each set; a set of any size is hashed in pieces of at most ELEMENTS elements."""
    ends = np.cumsum(sizes)
    out, at = np.empty((len(sizes), len(seeds)), bool), 0
    while at < len(sizes):
        start = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, start + ELEMENTS, "right")))
        offsets = ends[at:to] - sizes[at:to] - start
        for i in range(0, len(seeds), 256):
            part = seeds[i : i + 256]
            if to == at + 1 and sizes[at] > ELEMENTS:
                least = np.full((1, len(part)), np.uint32(0xFFFFFFFF))
                for k in range(start, ends[at], ELEMENTS):
                    least = np.minimum(least, _minima(values[k : min(k + ELEMENTS, ends[at])], np.zeros(1, int), part))
            else:
                least = _minima(values[start : ends[to - 1]], offsets, part)
            out[at:to, i : i + 256] = least & np.uint32(1)
        at = to
    return out


def sketches(bits: int, segments: int):  # noqa: ANN201
    """A function for mapInArrow: set_id, size, hashes -> set_id, size, head (a long), code (all bits), keys (a long for each segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.random.default_rng(7).integers(1, 2**32, bits * segments, dtype=np.uint32)
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                lists = b.column("hashes")
                values = (lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
                one = _bits(values, np.diff(lists.offsets.to_numpy()), seeds)
                head = np.packbits(one[:, :HEAD], axis=1).view(">i8").astype("int64")[:, 0]
                keys = one.reshape(len(one), segments, bits) @ weights + (np.arange(segments, dtype=np.int64) << 32)
                code = np.packbits(one, axis=1)
                code = np.pad(code, ((0, 0), (0, -code.shape[1] % 8))).view(">i8").astype("int64")
                lists_of = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype="int32"), m.ravel())
                yield pa.RecordBatch.from_arrays([b.column("set_id"), b.column("size"), pa.array(head), lists_of(code), lists_of(keys)], names=["set_id", "size", "head", "code", "keys"])

    return run


def classes_of(df: DataFrame, record: str, value: str, least: int) -> tuple[DataFrame, DataFrame]:
    """record, set_id of the records with at least `least` distinct values, and set_id, rep (the least record), n, terms of
    each class of equal sets. Null records and values do not count. Classes are grouped by the terms themselves."""
    rows = df.select(F.col(record).alias("record"), norm_id(F.col(value)).alias("v")).filter("record is not null and v is not null")
    sets = cut(rows.groupBy("record").agg(F.array_sort(F.collect_set("v")).alias("terms")).filter(F.size("terms") >= least), "records")
    found = sets.groupBy("terms").agg(F.min("record").alias("rep"), F.count("*").alias("n"))
    classes = cut(found.select(F.monotonically_increasing_id().alias("set_id"), "rep", "n", "terms"), "classes")  # the number is given once, in the written table
    return sets.join(classes.select("terms", "set_id"), "terms").select("record", "set_id"), classes


def _meetings(rows: DataFrame, key: str, chunk: int) -> DataFrame:
    """rows with at (a long), own and other: every two rows of one key meet once under one `at`. Keys that many rows share are
    parted into chunks, and each two chunks meet under an `at` of their own, so that no meeting has many more than chunk rows
    a side. Which keys these are is estimated from a sixteenth of the rows; that decides on the chunks, not on the result."""
    rate = 16 if chunk >= 256 else 1
    some = rows.filter(F.pmod(F.xxhash64("set_id", F.lit(3)), F.lit(rate)) == 0) if rate > 1 else rows
    parts = F.ceil(F.col("m") * rate / chunk).cast("int")
    hot = cut(some.groupBy(key).agg(F.count("*").alias("m")).filter(F.col("m") * rate * 2 > chunk).select(key, parts.alias("parts")), "hot")
    marked = rows.join(F.broadcast(hot) if hot.count() <= SHIPPED_KEYS else hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    marked = marked.withColumn("own", F.pmod(F.xxhash64("set_id", F.lit(1)), F.col("parts")).cast("int"))
    one = F.array(F.lit(0))
    met = marked.select(*rows.columns, "own", "parts", F.explode(F.when(F.col("parts") == 1, one).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))).alias("other"))
    at = F.xxhash64(key, F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))  # two that fall together only add candidates
    return met.withColumn("at", F.when(F.col("parts") == 1, F.col(key)).otherwise(at)).drop("parts")


def similar_classes(classes: DataFrame, threshold: float, miss: float = MISS, chunk: int = CHUNK) -> DataFrame:
    """a, b (set_id, a < b) of the classes whose similarity is at least the threshold."""
    bits, segments, near, far = plan(classes.count(), threshold, miss)
    width = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 12)
    coded = classes.select("set_id", F.size("terms").alias("size"), F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes")).repartition(width, "set_id")
    coded = cut(coded.mapInArrow(sketches(bits, segments), "set_id long, size int, head long, code array<long>, keys array<long>"), "codes")
    rows = coded.select("set_id", "head", "size", F.explode("keys").alias("k"))
    met = _meetings(rows, "k", chunk)
    x, y = (met.select("at", *(F.col(c).alias(c + n) for c in ("set_id", "head", "size", "own", "other"))) for n in "ab")
    sized = F.least("sizea", "sizeb") >= F.lit(threshold) * F.greatest("sizea", "sizeb")
    head = F.bit_count(F.col("heada").bitwiseXOR(F.col("headb"))) <= near
    # two rows of one chunk meet in its own task alone, two of different chunks in theirs
    once = (F.col("owna") == F.col("otherb")) & (F.col("ownb") == F.col("othera"))
    pairs = x.join(y, "at").filter((F.col("set_ida") < F.col("set_idb")) & once & sized & head)
    pairs = pairs.select(F.col("set_ida").alias("a"), F.col("set_idb").alias("b")).distinct()
    t = coded.select("set_id", "code").join(classes.select("set_id", "terms"), "set_id")
    both = pairs.join(t.toDF("a", "ca", "ta"), "a").join(t.toDF("b", "cb", "tb"), "b")
    differ = F.aggregate(F.zip_with("ca", "cb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    common = F.size(F.array_intersect("ta", "tb"))
    return both.filter(differ <= far).filter(common >= F.lit(threshold) * (F.size("ta") + F.size("tb") - common)).select("a", "b")


def _within(of: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ra, rb: the pairs of records of one class, met chunk by chunk."""
    met = _meetings(of.select("record", F.xxhash64("record").alias("set_id"), F.col("set_id").alias("k")), "k", chunk)
    x, y = (met.select("at", *(F.col(c).alias(c + n) for c in ("record", "k", "own", "other"))) for n in "ab")
    once = (F.col("owna") == F.col("otherb")) & (F.col("ownb") == F.col("othera"))
    return x.join(y, "at").filter(once & (F.col("ka") == F.col("kb")) & (F.col("recorda") < F.col("recordb"))).select(F.col("recorda").alias("ra"), F.col("recordb").alias("rb"))


def similar_pairs(df: DataFrame, record: str, value: str, threshold: float = 0.75, least: int = 4, miss: float = MISS, chunk: int = CHUNK) -> DataFrame:
    """protein_a, protein_b (a < b): all pairs of records whose sets are similar, those with equal sets included.

    The output grows with the square of a class of equal records; class_pairs and members hold the same links without it.
    """
    of, classes = classes_of(df, record, value, least)
    of = cut(of, "members")
    pairs = similar_classes(classes, threshold, miss, chunk)
    across = pairs.join(of.toDF("ra", "a"), "a").join(of.toDF("rb", "b"), "b").select("ra", "rb")
    return across.union(_within(of, chunk)).select(F.least("ra", "rb").alias("protein_a"), F.greatest("ra", "rb").alias("protein_b"))


def members(df: DataFrame, record: str, value: str, least: int = 4) -> DataFrame:
    """record, rep: the representative (least record) of the class of records with the same set."""
    of, classes = classes_of(df, record, value, least)
    return of.join(classes.select("set_id", "rep"), "set_id").select("record", "rep")


def class_pairs(df: DataFrame, record: str, value: str, threshold: float = 0.75, least: int = 4, miss: float = MISS) -> DataFrame:
    """rep_a < rep_b: the representatives of similar classes."""
    _, classes = classes_of(df, record, value, least)
    rep = classes.select("set_id", "rep")
    named = similar_classes(classes, threshold, miss).join(rep.toDF("a", "ra"), "a").join(rep.toDF("b", "rb"), "b")
    return named.select(F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b"))


def similar_links(df: DataFrame, record: str, value: str, threshold: float = 0.75, least: int = 4, miss: float = MISS) -> DataFrame:
    """record, rep, n_links: one row per record, with its class and the number of records similar to it."""
    of, classes = classes_of(df, record, value, least)
    pairs = cut(similar_classes(classes, threshold, miss), "pairs")
    ways = pairs.union(pairs.select("b", "a")).toDF("set_id", "other")
    links = ways.join(classes.select(F.col("set_id").alias("other"), F.col("n").alias("m")), "other").groupBy("set_id").agg(F.sum("m").alias("m"))
    per = classes.select("set_id", "rep", "n").join(links, "set_id", "left").select("set_id", "rep", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    return of.join(per, "set_id").select("record", "rep", "n_links")
