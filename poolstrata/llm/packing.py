"""Best-fit packing of tokenised documents into sequences, bulk-synchronous.

``pieces``  tokenises every whole text (an Arrow map) and cuts what is longer than a sequence.
``ranked``  range-sorts all pieces by size, so that each has its rank among those of its size, whatever range it is in.
``sweep``   the rounds: the largest size left goes to its successor gap (the least that holds it), who gets which gap is settled by rank,
            gaps shrink, and again. A round moves a run of equal sizes into a run of equal gaps at once, so the rounds follow the number of
            different sizes and gaps, which the sequence's length bounds, and not the number of pieces: they run on counts.
``place``   every range looks its pieces' moves up by size and rank.

The result is best-fit decreasing over all pieces. A size that a third of all pieces have is split among ranges, as these are cut
within sizes too. Shuffled are the pieces' rows, once; the driver gets a count for each size, and the tasks get the moves. No task has more
than about ``LANE`` pieces.

Defined cases: a null text is empty and packs as its end token; a null id is an id; repeated rows are pieces of their own;
an empty table gives no pieces; other columns aren't read. Pieces of a size are ranked by their own number, so ties are settled.
"""

from __future__ import annotations

import base64
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import batches_of, delete, materialise, table

LENGTH = 1024
END = 2
#: Pieces of a range, about.
LANE = 1 << 16
SPECIAL = "<|endoftext|>"
LONG_WORD = 4096


def default_tokenizer() -> tuple[str, str]:
    """The tokenizer, and the same vocabulary as merge ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class TokenIds:
    """Token ids of texts by a byte-level BPE tokenizer, as little-endian 32-bit integers.

    Where the same vocabulary is given as merge ranks, texts are encoded by these, which yields the tokenizer's ids (the
    tests compare them) in a fraction of its time. Texts with special tokens or with very long words, whose merging by
    ranks is slow, go to the tokenizer.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode
        self.by_rank = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.by_rank and SPECIAL not in text and not (len(text) > LONG_WORD and max(map(len, text.split()), default=LONG_WORD) >= LONG_WORD):
            ids = self.by_rank(text)
        else:
            ids = self.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def token_ids(path: str, ranks: str | None) -> TokenIds:
    """One for each worker: all tasks that it runs share the loaded vocabulary."""
    return TokenIds(path, ranks)


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """key, piece, start, length, ids_crc32: the ids of each text and the end id, cut where they exceed a sequence; the first
    piece is the shorter one."""
    files = (tokenizer, None) if tokenizer else default_tokenizer()
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))])
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        ids_of = token_ids(*files)
        for batch in batches:
            arrow = pa.schema([batch.schema.field(0), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

            def rows():
                for k, body in zip(batch.column(0), batch.column(1)):
                    ids = memoryview(ids_of(body.as_py() or "") + last)
                    n = len(ids) // 4
                    at, nth = 0, 0
                    while at < n:
                        size = n % length or length if not at else length
                        size = n if n <= length else size
                        yield [k.as_py(), nth, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])], 64
                        at, nth = at + size, nth + 1

            yield from batches_of(rows(), arrow)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def sweep(runs: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Moves (size, first rank, ranks, first sequence, offset) that place runs[size] documents of each size, and how many
    sequences they open. Best fit: each size, from the largest, goes to the least gap that holds it."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> intervals of sequences (first, how many)
    moves, opened = [], 0

    def put(size: int, rank: int, n: int, first: int, gap: int) -> None:
        moves.append((size, rank, n, first, length - gap))
        if gap > size:
            gaps.setdefault(gap - size, []).append((first, n))

    for size in sorted((s for s, n in runs.items() if n), reverse=True):
        rank, left = 0, runs[size]
        while left:
            gap = min((g for g in gaps if g >= size), default=None)
            if gap is None:
                fit = length // size
                whole, rest = divmod(left, fit)
                if whole:  # new sequences that this size fills as far as it can, a level at a time
                    for level in range(fit):
                        moves.append((size, rank + level * whole, whole, opened, level * size))
                    if length > fit * size:
                        gaps.setdefault(length - fit * size, []).append((opened, whole))
                if rest:
                    for level in range(rest):
                        moves.append((size, rank + fit * whole + level, 1, opened + whole, level * size))
                    gaps.setdefault(length - rest * size, []).append((opened + whole, 1)) if length > rest * size else None
                opened += whole + bool(rest)
                break
            first, n = gaps[gap].pop()
            taken = min(n, left)
            if n > taken:
                gaps[gap].append((first + taken, n - taken))
            if not gaps[gap]:
                del gaps[gap]
            put(size, rank, taken, first, gap)
            rank, left = rank + taken, left - taken
    return moves, opened


def fill_lane(blocks: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and the sequence's fill of each block, for blocks in memory. A sequence is named by its first block."""
    order = np.lexsort((blocks, sizes))
    blocks, sizes = blocks[order], sizes[order]
    kinds, begin, n = np.unique(sizes, return_index=True, return_counts=True)
    at = dict(zip(kinds.tolist(), begin.tolist()))
    moves, opened = sweep(dict(zip(kinds.tolist(), n.tolist())), length)
    number, offset, fill = np.empty(len(blocks), np.int64), np.empty(len(blocks), np.int64), np.zeros(opened, np.int64)
    for size, rank, count, first, place in moves:
        k = at[size] + rank
        number[k : k + count], offset[k : k + count] = np.arange(first, first + count), place
        fill[first : first + count] += size
    name = np.empty(opened, np.int64)
    name[number[offset == 0]] = blocks[offset == 0]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return name[number][back], offset[back], fill[number][back]


def ranked(parts: DataFrame, ranges: int) -> DataFrame:
    """parts with ``_range`` and ``_rank``, a piece's number among those of its size in its range; in the shared folder."""

    def run(batches):
        here, size, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            sizes = batch.column("length").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], sizes[1:] != sizes[:-1]))) if len(sizes) else np.zeros(0, np.int64)
            ranks = np.arange(len(sizes)) - np.repeat(starts, np.diff(np.append(starts, len(sizes))))
            if len(sizes):
                if sizes[0] == size:  # goes on from the batch before
                    ranks[: starts[1] if len(starts) > 1 else len(sizes)] += n
                size, n = sizes[-1], int(ranks[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), here, np.int32)), pa.array(ranks)], names=[*batch.schema.names, "_range", "_rank"])

    schema = T.StructType([*parts.schema, T.StructField("_range", T.IntegerType()), T.StructField("_rank", T.LongType())])
    return materialise(parts.repartitionByRange(ranges, "length", "_block").sortWithinPartitions("length", "_block").mapInArrow(run, schema), "ranked")


def place(parts: DataFrame, key: str = "doc_id", length: int = LENGTH, lane: int = LANE) -> DataFrame:
    """parts (columns of ``pieces`` and ``_block``, a number of each row's own, already in the shared folder) with sequence_id and offset."""
    rows = ranked(parts, max(1, -(-parts.count() // lane)))
    counts = materialise(rows.groupBy("_range", "length").agg(F.count("*").alias("n")), "counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range that has the size
    runs = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``length`` rows at most
    moves = np.array(sorted(sweep(runs, length)[0]), np.int64).reshape(-1, 5)  # as many as rounds
    sent = parts.sparkSession.sparkContext.broadcast(moves)
    columns = [key, "piece", "start", "length", "ids_crc32"]

    def run(batches):
        sizes, ranks, _, firsts, offsets = sent.value.T
        bounds = np.searchsorted(sizes, np.arange(length + 2))  # where each size's moves begin
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy() + batch.column("_before").to_numpy()
            at = np.empty(len(own), np.int64)
            for size in np.unique(own).tolist():
                of = np.flatnonzero(own == size)
                at[of] = bounds[size] + np.searchsorted(ranks[bounds[size] : bounds[size + 1]], rank[of], "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])], names=[*columns, "sequence_id", "offset"])

    schema = T.StructType([*(parts.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = materialise(rows.join(counts.select("_range", "length", before.alias("_before")), ["_range", "length"]).select(*columns, "_rank", "_before").mapInArrow(run, schema), "packed")
    delete(rows)
    delete(counts)
    return placed


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, tokenizer: str | None = None, lane: int = LANE) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    parts = materialise(pieces(df, key, text, length, end, tokenizer).withColumn("_block", F.monotonically_increasing_id()), "pieces")
    placed = place(parts, key, length, lane)
    delete(parts)
    return placed


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
