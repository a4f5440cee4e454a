"""SimHash near-duplicates by multi-index hashing.

1. ``fingerprints``: 64 bits of each whole text, from XXH64 of its word shingles.
2. ``links``: distinct fingerprints only, so copies cost nothing more. A fingerprint is cut in two segments of 32 bits; two
   fingerprints at most 4 bits apart are at most 2 apart in one of them. Both sides enter the table under every value
   within 1 bit of each segment (33 values a segment), so such a pair meets under some value: a ball of radius 2 by two
   small balls. What meets is verified on all 64 bits. Under one value, a search from fingerprint to fingerprint gives
   a spanning forest and not the pairs, so a group of g fingerprints yields less than g links. A value that more than
   ``HOT`` fingerprints share is dealt out again: its members enter under the value and each neighbour of the two 16-bit
   halves of their other segment (in one of these, too, a pair differs by 2 bits at most), so no task meets them all at once.
3. ``components`` of the links, and the least id in each.

Shuffles: fingerprints' table entries (66 for each distinct fingerprint, 16 bytes each), links, ids. Texts don't move.

Defined cases: a null or blank text has fingerprint zero and links like any other; a null id never names a component
unless all ids of the component are null; repeated rows each keep a row; an empty table gives an empty result. Only id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialise, table
from .components import connected_components

SHINGLE = 4
SEED = 42
MOST_BITS = 4
HALF = 32
#: Members of a value that one task compares; a value with more is split.
HOT = 4096


def simhash(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one whole text as a signed 64-bit integer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        h = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[: -words] + 1))
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        counts += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """key and fp (signed 64 bits), a row for each row of df."""
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = [simhash(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[batch.schema.field(0).name, "fp"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def ball_entries(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table entries (value, fingerprint): each segment's value and its 32 neighbours at one bit."""
    flips = np.concatenate(([0], np.left_shift(np.int64(1), np.arange(HALF, dtype=np.int64))))
    low, high = fps & 0xFFFFFFFF, fps >> HALF & 0xFFFFFFFF
    values = np.stack([low[:, None] ^ flips, (high[:, None] ^ flips) | np.int64(1) << HALF], axis=1)
    return values.reshape(-1), np.repeat(fps, 2 * len(flips))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed 64-bit fingerprints (counted unsigned: a signed count is of the absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """(fingerprint, its group's least fingerprint) for fingerprints that links of at most ``most`` bits connect.

    Every fingerprint is compared once with those not yet reached, so a dense group costs little more than its size.
    """
    rest, out = np.unique(fps), []
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for x in front[:64]:
                near |= differing(rest, x) <= most
            reached, rest = rest[near], rest[~near]
            out += [(int(x), int(root)) for x in reached]
            front = np.concatenate((front[64:], reached))
    return out


def split_entries(values: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (value, part, fingerprint) of a value's members by the halves of their other segment, and these at one bit."""
    flips = np.concatenate(([0], np.left_shift(np.int64(1), np.arange(HALF // 2, dtype=np.int64))))
    other = np.where(values >> HALF & 1, fps, fps >> HALF) & 0xFFFFFFFF  # a value of the high segment has bit 32
    low, high = other & 0xFFFF, other >> 16
    parts = np.stack([low[:, None] ^ flips, (high[:, None] ^ flips) | 1 << 16], axis=1).reshape(len(fps), -1)
    n = parts.shape[1]
    return np.repeat(values, n), parts.reshape(-1), np.repeat(fps, n)


def linked(groups_of: list[np.ndarray], most: int) -> list[tuple[int, int]]:
    pairs: set[tuple[int, int]] = set()
    for fps in groups_of:
        pairs.update(forest(fps, most))
    return list(pairs)


def links(distinct: DataFrame, fp: str = "fp", most: int = MOST_BITS, partitions: int | None = None, hot: int = HOT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints at most ``most`` (4 or less) bits apart."""
    if most > MOST_BITS:
        raise ValueError("two segments with balls of radius 1 on either side find pairs up to 4 bits apart")
    spark = distinct.sparkSession

    def enter(batches):
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(all_fps), 2048):
                values, fps = ball_entries(all_fps[k : k + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(fps)], names=["value", "fp"])

    def found(pairs):
        if pairs:
            x, y = zip(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64())], names=["a", "b", "value", "part"])

    def again(value, fps):
        for k in range(0, len(fps), 2048):
            values, parts, members = split_entries(np.full(len(fps[k : k + 2048]), value, np.int64), fps[k : k + 2048])
            yield pa.RecordBatch.from_arrays([pa.array(members), pa.nulls(len(members), pa.int64()), pa.array(values), pa.array(parts)], names=["a", "b", "value", "part"])

    def meet(batches):
        held_v, held_f, splitting = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in _then_none(batches):
            if batch is not None:
                held_v = np.concatenate((held_v, batch.column(0).to_numpy(zero_copy_only=False)))
                held_f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False)))
            if not len(held_v):
                continue
            cut = np.flatnonzero(held_v[1:] != held_v[:-1]) + 1  # values come sorted: runs are groups
            starts = np.concatenate(([0], cut))
            sizes = np.diff(np.concatenate((starts, [len(held_v)])))
            last = len(starts) if batch is None else len(starts) - 1  # the last run may go on in the next batch
            done, pairs = held_v[starts[:last]], []
            twos = starts[:last][(sizes[:last] == 2) & (done != splitting if splitting is not None else True)]
            a, b = held_f[twos], held_f[twos + 1]
            close = differing(a, b) <= most
            pairs = list(zip(np.maximum(a, b)[close].tolist(), np.minimum(a, b)[close].tolist()))
            for k in range(len(starts)):
                s, n = int(starts[k]), int(sizes[k])
                value = int(held_v[s])
                if n > hot or value == splitting:  # split it, and what follows of it in later batches
                    splitting = value
                    yield from again(value, held_f[s : s + n])
                elif k < last and n > 2:
                    pairs += forest(held_f[s : s + n], most)
            yield from found(list(set(pairs)))
            if batch is None or int(held_v[starts[-1]]) == splitting:
                last = len(starts)
            rest = int(starts[last]) if last < len(starts) else len(held_v)
            held_v, held_f = held_v[rest:], held_f[rest:]

    def meet_parts(batches):
        held = np.zeros((3, 0), np.int64)
        for batch in _then_none(batches):
            if batch is not None:
                held = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])), 1)
            if not held.shape[1]:
                continue
            starts = np.concatenate(([0], np.flatnonzero((held[:2, 1:] != held[:2, :-1]).any(0)) + 1, [held.shape[1]]))
            last = len(starts) - 1 if batch is None else len(starts) - 2
            yield from found(linked([held[2, a:b] for a, b in zip(starts[:last], starts[1:]) if b - a > 1], most))
            held = held[:, starts[last] :]

    entries = distinct.select(fp).mapInArrow(enter, "value long, fp long")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = materialise(entries.repartition(n, "value").sortWithinPartitions("value").mapInArrow(meet, "a long, b long, value long, part long"), "met")
    split = met.where("b is null").select("value", "part", F.col("a").alias("fp"))
    more = split.repartition(n, "value", "part").sortWithinPartitions("value", "part").mapInArrow(meet_parts, "a long, b long, value long, part long")
    return met.where("b is not null").select("a", "b").unionByName(more.select("a", "b")).distinct()


def _then_none(batches):
    yield from batches
    yield None


def components_of(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """fp, component_id and first_fp from distinct (fp, least: what names a row, nulls last): the least name that links lead to,
    and the fingerprint that has it."""
    joined = materialise(connected_components(links(distinct, most=most)), "components")
    members = materialise(joined.join(distinct, joined["node"] == distinct["fp"]).select("fp", "component", "least"), "members")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("component_id"), F.col("fp").alias("first_fp"))).alias("first")
    best = materialise(members.groupBy("component").agg(first).select("component", "first.component_id", "first.first_fp"), "best")
    linked = materialise(members.join(best, "component").select("fp", "component_id", "first_fp"), "linked")
    return materialise(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("first_fp", "fp").alias("first_fp")), "named")


def components(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """key, fp and component_id (the least key that links lead to) for every row of df."""
    rows = materialise(fingerprints(df, key, text, words).withColumnRenamed(key, "_id"), "fingerprints")
    named = components_of(materialise(rows.groupBy("fp").agg(F.min("_id").alias("least")), "distinct-fingerprints"), most)
    return rows.join(named, "fp").select(F.col("_id").alias(key), "fp", "component_id")


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = SHINGLE) -> DataFrame:
    """df and each row's fingerprint in the column ``name``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    where = df.columns.index(text)

    def run(batches):
        for batch in batches:
            fps = pa.array([simhash(x.as_py(), words) for x in batch.column(where)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """Rows of df without near-duplicates: of each component one row with the least key (nulls last). Every row gets a number of
    its own, so different texts that share a key, or have none, each stay. Columns and their order are df's."""
    fp, row = fresh(df, "_fp"), fresh(df, "_row")
    marked = materialise(with_fingerprint(df, text, fp, words).withColumn(row, F.monotonically_increasing_id()), "marked")
    name = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))
    named = components_of(materialise(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(name).alias("least")), "distinct-fingerprints"), most)
    keep = named.where("fp = first_fp").select(F.col("component_id.row").alias(row))
    return marked.join(keep, row, "left_semi").select(*df.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
