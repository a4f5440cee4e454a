"""Alignment of two tokenizers' tokens, and how often each pair of ids is linked in the whole corpus.

``encode``   both tokenizers' ids of every whole text, once; later passes need the ids and the tokens' byte lengths only.
``Links``    a text cut at the ends of all tokens of either side: each stretch lies in one token of A and one of B, and is a link of the two.
             Ends that both sides have cut the tokens into groups.
``index``    first pass: distinct pairs of ids, dealt into shards by a hash, and a minimal perfect hash of each shard (levels of bit
             arrays; a pair's place is the rank of its bit) with the pairs in their places, so that a lookup is verified.
``count``    dense vectors, one number for each place of a shard; each task fills its own, and they are summed as a tree: a few tasks
             at a time, then a few such sums, until one vector for each shard is left, which is a file of the shared folder.
``lookup``   second pass: texts are aligned again and each link's count is read from the mapped files.

What a task holds follows neither the corpus nor the number of pairs: a chunk of texts, a bounded number of pairs, one shard's vector. A
text is never cut, so a chunk is at least a text. The driver gets one number for each id of B.

Defined cases: a null or empty text, and one whose tokens' bytes aren't the text's, has no tokens: zeros and an empty digest; repeated
rows each count and each get a row; a null key is a key; an empty table gives no rows. Strings of special tokens are plain text. Only key and text
are read, so other columns can't clash. Ties for a B id's highest count are all highest.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, delete, materialise, read_bytes, shared_dir, table, write_bytes
from .words import mix

#: Words from this length on go to the tokenizer that doesn't take square time for them.
LONG_WORD = 4096
SPACE = "▁"


@dataclass(frozen=True)
class Sizes:
    """Bytes of ids that are aligned at a time, pairs that a task holds before it sends them on, pairs of a shard (about), vectors of
    a sum. They bound memory; results don't depend on them."""

    chunk: int = 1 << 20
    held: int = 1 << 21
    shard: int = 1 << 18
    fan: int = 16


# ---- the two vocabularies --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Files:
    """Paths: tokenizer A (byte-level BPE), the same vocabulary as merge ranks or None, and tokenizer B (pieces)."""

    a: str
    ranks: str | None
    b: str


def default_files() -> Files:
    import public_tokenizers as P

    return Files(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"))


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabularies:
    """Ids by both tokenizers, and the bytes of every id."""

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(files.a)
        tokenizer.encode_special_tokens = True
        self.by_tokenizer, self.by_rank = tokenizer.encode, None
        if files.ranks:
            import public_tokenizers
            import tiktoken

            with open(files.ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        alphabet, vocabulary = byte_alphabet(), tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
        pieces = sentencepiece.SentencePieceProcessor(model_file=files.b)
        self.by_piece = pieces.encode
        names = map(pieces.id_to_piece, range(pieces.get_piece_size()))
        self.b_bytes = [bytes.fromhex(name[3:5]) if pieces.is_byte(k) else name.replace(SPACE, " ").encode() for k, name in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """A's ids of space and text, B's of the text; none of either where their bytes aren't those of space and text."""
        whole = " " + text
        raw = whole.encode("utf-8", "surrogatepass")
        slow = self.by_rank is None or (len(text) > LONG_WORD and max(map(len, text.split()), default=LONG_WORD) >= LONG_WORD)
        a = self.by_tokenizer(whole, add_special_tokens=False).ids if slow else self.by_rank(whole)
        b = self.by_piece(text)
        if not text or b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return [], []
        return a, b


@lru_cache(maxsize=2)
def vocabularies(files: Files) -> Vocabularies:
    """One for each worker: all tasks that it runs share it."""
    return Vocabularies(files)


def encode(df: DataFrame, files: Files, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, a and b: the ids of each text as little-endian 16-bit integers (32-bit where a vocabulary is larger)."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(files)
        for batch in batches:
            arrow = pa.schema([("id", batch.schema.field(0).type), ("a", pa.binary()), ("b", pa.binary())])

            def rows():
                for k, body in zip(*batch.columns):
                    a, b = v.ids(body.as_py() or "")
                    a, b = np.array(a, width(len(v.a_bytes))).tobytes(), np.array(b, width(len(v.b_bytes))).tobytes()
                    yield [k.as_py(), a, b], len(a) + len(b) + 16

            yield from batches_of(rows(), arrow)

    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("body")).mapInArrow(run, schema)


def width(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


# ---- alignment -------------------------------------------------------------------------------------------------------


class Links:
    """Links and groups of texts put end to end; as both sides cover each text, a text's end is an end of both."""

    def __init__(self, a: list[bytes], b: list[bytes], v: Vocabularies):
        wide_a, wide_b = (np.dtype(width(len(x))) for x in (v.a_bytes, v.b_bytes))
        self.n_a, self.n_b = (np.array([len(x) // w.itemsize for x in ids], np.int64) for ids, w in ((a, wide_a), (b, wide_b)))
        self.a, self.b = np.frombuffer(b"".join(a), wide_a), np.frombuffer(b"".join(b), wide_b)
        a_ends, b_ends = np.cumsum(v.a_sizes[self.a]), np.cumsum(v.b_sizes[self.b])
        marks = np.zeros(int(a_ends[-1]) + 1 if len(a_ends) else 1, np.uint8)
        marks[a_ends] = 1
        marks[b_ends] |= 2
        ends = np.flatnonzero(marks)
        kind = marks[ends]
        self.of_a, self.of_b, self.common = kind & 1 > 0, kind & 2 > 0, kind == 3
        self.at_a, self.at_b = (np.cumsum(x) - x for x in (self.of_a, self.of_b))  # each link's token
        last = np.concatenate(([0], a_ends))[np.cumsum(self.n_a)]  # where each text ends
        self.until = np.searchsorted(ends, last, "right")  # links up to each text's end
        self.base = len(v.b_bytes)

    def pairs(self) -> np.ndarray:
        """Each link's pair of ids as one number."""
        return self.a[self.at_a].astype(np.int64) * self.base + self.b[self.at_b]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of the links' values in each text."""
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[self.until]
        return np.diff(sums, prepend=0)

    def spelled(self, tables: tuple[list[bytes], ...]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the ids of its groups in order."""
        group = np.cumsum(self.common) - self.common
        g_a, g_b = group[self.of_a], group[self.of_b]
        groups = int(self.common.sum())
        before_b = np.cumsum(np.bincount(g_b, minlength=groups)) - np.bincount(g_b, minlength=groups)
        upto_a = np.cumsum(np.bincount(g_a, minlength=groups))
        out = np.empty(len(self.a) + len(self.b), np.int64)
        n_a, n_b = len(tables[0]), len(tables[2])
        out[np.arange(len(self.a)) + before_b[g_a]] = self.a + n_a * self.common[self.of_a]
        out[np.arange(len(self.b)) + upto_a[g_b]] = self.b + n_b * self.common[self.of_b].astype(np.int64) + 2 * n_a
        words = [*tables[0], *tables[1], *tables[2], *tables[3]]
        cuts = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        codes = out.tolist()
        return [b"".join(map(words.__getitem__, codes[i:j]))[:-1] for i, j in zip(cuts, cuts[1:])]


def chunks(batches: Iterator[pa.RecordBatch], v: Vocabularies, size: int) -> Iterator[tuple[list, Links]]:
    """(ids of rows, their links) of about ``size`` bytes of tokens at a time."""
    keys, a, b, held = [], [], [], 0
    for batch in batches:
        for k, x, y in zip(*batch.columns):
            keys.append(k.as_py())
            a.append(x.as_py())
            b.append(y.as_py())
            held += len(a[-1]) + len(b[-1]) + 16
            if held >= size:
                yield keys, Links(a, b, v)
                keys, a, b, held = [], [], [], 0
    if keys:
        yield keys, Links(a, b, v)


def counted(batches: Iterator[pa.RecordBatch], v: Vocabularies, sizes: Sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different pairs in order, and their counts; more than ``sizes.held`` pairs go out before the end."""
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, links in chunks(batches, v, sizes.chunk):
        new, n = np.unique(links.pairs(), return_counts=True)
        every, at = np.unique(np.concatenate((pairs, new)), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        total[at[: len(pairs)]] = counts
        total[at[len(pairs) :]] += n
        pairs, counts = every, total
        if len(pairs) > sizes.held:
            yield pairs, counts
            pairs, counts = pairs[:0], counts[:0]
    if len(pairs):
        yield pairs, counts


# ---- minimal perfect hash --------------------------------------------------------------------------------------------


def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place under ``size`` for each key; another one on each level."""
    return (mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return place(keys, -1, shards)


class PerfectHash:
    """Numbers 0 to n - 1 for n different keys. On each level a key that is alone in its place is settled there; its number is the
    rank of its place among all settled ones. The keys are kept in that order, so that others are told apart."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, keys: np.ndarray):
        self.sizes, self.bits, self.ranks, self.keys = sizes, bits, ranks, keys

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        settled = np.concatenate(levels) if levels else np.zeros(0, bool)
        bits = np.packbits(settled, bitorder="little").view("<u8")
        ones = np.bitwise_count(bits).astype(np.int64)
        self = cls(np.array(sizes, np.int64), bits, np.cumsum(ones) - ones, np.empty(0, np.int64))
        ordered = np.empty(len(keys), np.int64)
        ordered[self.numbers(keys)] = keys
        self.keys = ordered
        return self

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that isn't one of them, -1 or any number."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = place(keys[left], level, size) + start
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)) > 0
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = self.ranks[at[here] >> 6] + below[here]
            left, start = left[~here], start + size
            if not len(left):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, verified: -1 for a key that isn't one of them."""
        found = self.numbers(keys)
        return np.where((found >= 0) & (self.keys[found] == keys), found, -1) if len(self.keys) else np.full(len(keys), -1, np.int64)

    def to_bytes(self) -> bytes:
        return b"".join(x.astype("<i8" if x.dtype.kind == "i" else "<u8").tobytes() for x in (np.array([len(self.sizes), len(self.bits)], np.int64), self.sizes, self.bits, self.ranks, self.keys))

    @classmethod
    def from_bytes(cls, data: memoryview) -> PerfectHash:
        whole = np.frombuffer(data, "<i8")
        levels, words = whole[:2].tolist()
        cuts = np.cumsum([2, levels, words, words]).tolist()
        return cls(whole[cuts[0] : cuts[1]], whole[cuts[1] : cuts[2]].view("<u8"), whole[cuts[2] : cuts[3]], whole[cuts[3] :])


@dataclass(frozen=True)
class Index:
    """Shards of pairs in a folder of the shared one: a perfect hash each and, once counted, a vector of counts each."""

    folder: str
    shards: int

    def hash_path(self, shard: int) -> str:
        return f"{self.folder}/pairs-{shard}"

    def counts_path(self, shard: int) -> str:
        return f"{self.folder}/counts-{shard}"

    def split(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places of its keys) for the shards that keys fall into."""
        of = shard_of(keys, self.shards)
        order = np.argsort(of, kind="stable")
        here, first = np.unique(of[order], return_index=True)
        for shard, at in zip(here.tolist(), np.split(order, first[1:])):
            yield shard, at

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        """The corpus-wide count of each pair; 0 for pairs that it never linked."""
        out = np.zeros(len(keys), np.int64)
        for shard, at in self.split(keys):
            found = mapped_hash(self.hash_path(shard)).find(keys[at])
            out[at] = np.where(found >= 0, mapped_counts(self.counts_path(shard))[found], 0)
        return out


@lru_cache(maxsize=1024)
def mapped_hash(path: str) -> PerfectHash:
    return PerfectHash.from_bytes(read_bytes(path))


@lru_cache(maxsize=1024)
def mapped_counts(path: str) -> np.ndarray:
    return np.frombuffer(read_bytes(path), "<i8")


# ---- Spark -----------------------------------------------------------------------------------------------------------


def index(encoded: DataFrame, files: Files, folder: str, sizes: Sizes = Sizes()) -> Index:
    """The perfect hashes of all distinct pairs of rows of ``encode``."""

    def distinct(batches):
        for pairs, _ in counted(batches, vocabularies(files), sizes):
            yield pa.RecordBatch.from_arrays([pa.array(pairs)], names=["pair"])

    pairs = materialise(encoded.mapInArrow(distinct, "pair long").distinct(), "pairs")
    shards = max(1, -(-pairs.count() // sizes.shard))
    where = Index(folder, shards)

    def dealt(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, shards)), batch.column(0)], names=["shard", "pair"])

    def build(rows: pa.Table) -> pa.Table:
        shard, keys = rows.column("shard")[0].as_py(), rows.column("pair").to_numpy()
        write_bytes(where.hash_path(shard), PerfectHash.of(keys).to_bytes())
        return pa.table({"shard": [shard], "n": [len(keys)]})

    built = pairs.mapInArrow(dealt, "shard long, pair long").groupBy("shard").applyInArrow(build, "shard long, n long")
    built.agg(F.sum("n")).first()  # writes every shard
    delete(pairs)
    return where


def summed(rows: DataFrame, then: Callable[[int, int, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """(shard, lane, vector) rows with the same shard and lane come down to ``then`` of their sum, one vector held at a time."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        now, total = None, None
        for batch in batches:
            for shard, lane, vector in zip(*batch.columns):
                at = (shard.as_py(), lane.as_py())
                new = np.frombuffer(unpack(vector.as_py()), "<i8")
                if at == now:
                    total = total + new
                    continue
                if now is not None:
                    yield from then(*now, total)
                now, total = at, new
        if now is not None:
            yield from then(*now, total)

    return rows.repartition("shard", "lane").sortWithinPartitions("shard", "lane").mapInArrow(run, schema)


VECTORS = "shard long, lane long, vector binary"


def vector_row(shard: int, lane: int, vector: np.ndarray) -> pa.RecordBatch:
    packed = zstandard.ZstdCompressor(level=1).compress(vector.astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([lane], pa.int64()), pa.array([packed], pa.binary())], names=["shard", "lane", "vector"])


def count(encoded: DataFrame, files: Files, where: Index, sizes: Sizes = Sizes()) -> dict[int, int]:
    """Write the counts of all pairs to the shared folder; returns the highest count of each id of B."""

    def fill(batches):
        lane, v = TaskContext.get().partitionId(), vocabularies(files)
        for pairs, n in counted(batches, v, sizes):
            for shard, at in where.split(pairs):
                known = mapped_hash(where.hash_path(shard))
                found = known.find(pairs[at])
                if len(found) and found.min() < 0:
                    raise ValueError(f"shard {shard} lacks a pair")
                vector = np.zeros(len(known.keys), np.int64)
                vector[found] = n[at]
                yield vector_row(shard, lane, vector)

    def keep(shard: int, lane: int, vector: np.ndarray):
        write_bytes(where.counts_path(shard), vector.astype("<i8").tobytes())
        of_b = mapped_hash(where.hash_path(shard)).keys % len(vocabularies(files).b_bytes)
        best = np.zeros(len(vocabularies(files).b_bytes), np.int64)
        np.maximum.at(best, of_b, vector)
        ids = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best[ids])], names=["b", "n"])

    vectors = materialise(encoded.mapInArrow(fill, VECTORS), "vectors")
    rows, lanes = vectors, (vectors.agg(F.max("lane")).first()[0] or 0) + 1
    while lanes > sizes.fan:  # so many lanes become one
        rows = summed(rows.withColumn("lane", F.expr(f"lane div {sizes.fan}")), lambda *x: iter([vector_row(*x)]), VECTORS)
        lanes = -(-lanes // sizes.fan)
    highest = summed(rows.withColumn("lane", F.lit(0).cast("long")), keep, "b long, n long").groupBy("b").agg(F.max("n").alias("n"))
    found = {r["b"]: r["n"] for r in highest.collect()}  # a row for each id of B at most
    delete(vectors)
    return found


RESULT = (("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("n_best", T.LongType()), ("count_sum", T.LongType()), ("groups_sha256", T.StringType()))


def lookup(encoded: DataFrame, files: Files, where: Index, highest: dict[int, int], sizes: Sizes = Sizes()) -> DataFrame:
    """id and the columns of ``RESULT`` for every row of ``encode``."""
    schema = T.StructType([encoded.schema["id"], *(T.StructField(n, t) for n, t in RESULT)])
    sent = encoded.sparkSession.sparkContext.broadcast(highest)  # a number for each id of B

    def run(batches):
        v = vocabularies(files)
        best = np.zeros(len(v.b_bytes), np.int64)
        best[list(sent.value)] = list(sent.value.values())
        spell = [[b"%d%b" % (k, mark) for k in range(len(names))] for names, mark in ((v.a_bytes, b","), (v.a_bytes, b"|"), (v.b_bytes, b","), (v.b_bytes, b";"))]
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        arrow = pa.schema([first.schema.field(0).with_name("id"), *((n, pa.string() if t == T.StringType() else pa.int64()) for n, t in RESULT)])

        def every():
            yield first
            yield from batches

        for keys, links in chunks(every(), v, sizes.chunk):
            pairs, at = np.unique(links.pairs(), return_inverse=True)
            of = where.counts_of(pairs)[at]
            numbers = (links.n_a, links.n_b, links.per_text(links.common), links.per_text(np.ones(len(of), bool)), links.per_text(of == best[links.b[links.at_b]]), links.per_text(of))
            digests = [hashlib.sha256(x).hexdigest() if n else "" for x, n in zip(links.spelled(tuple(spell)), links.n_a.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow.field(0).type), *map(pa.array, numbers), pa.array(digests, pa.string())], schema=arrow)

    return encoded.mapInArrow(run, schema)


def align(df: DataFrame, files: Files | None = None, key: str = "doc_id", text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """id and the columns of ``RESULT`` for every row of df, in the shared folder; all that led to them is deleted."""
    files, spark = files or default_files(), df.sparkSession
    folder = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    encoded = materialise(encode(df, files, key, text), "encoded")
    try:
        where = index(encoded, files, folder, sizes)
        return materialise(lookup(encoded, files, where, count(encoded, files, where, sizes), sizes), "aligned")
    finally:
        delete(encoded)
        delete(spark, folder)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
