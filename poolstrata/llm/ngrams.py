"""Perplexity by interpolated modified Kneser-Ney models of orders 2 and 3, counted in Spark (Chen and Goodman, 1999).

The corpus is cut in chunks of whole texts. A chunk knows its own n-grams; what it lacks are totals over the corpus. It
asks for them in sorted arrays of 64-bit hashes, split by hash range in shards, with its own counts beside them:

  trigrams chunk -> shard: hash, count in training texts      shard -> chunk: count in all, and whether this chunk is the
                                                              first to have it (so each trigram is counted once below)
  bigrams  chunk -> shard: hash, count, left contexts,        shard -> chunk: the same, summed over the corpus, and whether
           followers seen once, twice, more often             this chunk is the first
  words    chunk -> shard: the same, and the same of left     shard -> chunk: the same, summed over the corpus
           contexts instead of counts

The model is what the shards keep: a file for each order and hash range in the shared folder, with the sorted hashes of
all n-grams of the training texts and the code of each one's counts (``write_shard``). A worker that answers chunks maps
its shard's file in memory and looks their n-grams up there. ``train`` leaves the model for ``score_with``, which
scores other texts by mapping the same files; ``score`` learns from a table and scores it in one go, so that the
n-grams of its texts move once, and keeps the files only if it is given a folder. Shards are ranges of hashes, so a word that makes up a third of the corpus is one entry of
each chunk's request. Their number follows from the text's bytes (``SHARD_BYTES``), so a shard's arrays don't grow
with the corpus. Nothing is broadcast but two dozen totals.

Data moved: each chunk's different n-grams, packed to about 6 bytes each, once there and about one byte back. As in any
shuffle each task has a block for each shard. The chunks' texts are written once, bucketed by chunk, and don't move again;
they and the answers are deleted when the scores are written.

A stored key is the place of its bucket (eight keys each on average) and 32 more bits, so a lookup meets a wrong n-gram with
a probability of about 2e-9, however large the model is.

Model. p(w | v) = max(c(v w) - D, 0) / c(v) + g(v) p(w); p(w) = max(left(w) - D', 0) / bigrams + g' / (V + 1), so unknown
words share one slot. The trigram model is p(w | u v) = max(c(u v w) - D, 0) / c(u v) + g(u v) p'(w | v), where p' is the bigram
formula over left contexts instead of counts; a bigram at a text's start has none but the start, and keeps its count. A text starts in a start context and ends with the end token.

Defined cases: a null text is empty (one token, the end); with no training text every word has probability 1 / (V + 1) = 1;
repeated rows each get a row; null ids are kept, and a row whose hold-out mark is null counts as not held out, for
learning as for the totals. Only id, text and the hold-out mark are read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import crc_mod, delete, materialise, read_bytes, shared_dir, table, write_bytes
from .words import NOT_SPACE, gather, hashes, mix, words

CHUNK_BYTES = 6 << 20
#: Bytes of text whose n-grams a shard holds, about.
SHARD_BYTES = 16 << 20
ORDER = 3
LEVELS = ("words", "bigrams", "trigrams")
K = np.uint64(0x9E3779B97F4A7C15)
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


# ---- packed arrays ---------------------------------------------------------------------------------------------------


def packed(a: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed: high planes of small numbers cost nothing."""
    planes = a.view(np.uint8).reshape(len(a), -1).T if len(a) else a
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes, dtype=np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)


def packed_sorted(a: np.ndarray) -> bytes:
    return packed(np.diff(a, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def shard_bounds(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each of ``shards`` equal hash ranges starts in sorted keys, and the end."""
    edges = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]))


# ---- chunks ----------------------------------------------------------------------------------------------------------


def sorted_order(h: np.ndarray) -> np.ndarray:
    """What argsort gives for 64-bit hashes, by sorting their high bits with the places in the low ones."""
    bits = np.uint64(len(h).bit_length())
    both = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    both.sort()
    order = (both & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    got = h[order]
    high = both >> bits
    for k in np.flatnonzero(got[1:] < got[:-1]).tolist():  # few: hashes that differ in their low bits only
        run = slice(int(np.searchsorted(high, high[k])), int(np.searchsorted(high, high[k], "right")))
        order[run] = np.sort(order[run])[np.argsort(h[np.sort(order[run])], kind="stable")]
    return order


def ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of hashes, and each one's rank."""
    order = sorted_order(h)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    return order, rank


def coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's number among the different keys, and these: by one sort of keys with their places, where both fit in 64 bits."""
    bits = np.uint64(len(keys).bit_length())
    if not len(keys) or int(keys.max()).bit_length() + int(bits) > 64:
        return pd.factorize(keys)
    both = keys.astype(np.uint64) << bits | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    key = both >> bits
    new = np.concatenate(([True], key[1:] != key[:-1]))
    code = np.empty(len(keys), np.int64)
    code[(both & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)] = np.cumsum(new) - 1
    return code, key[new].astype(np.int64)


class Chunk:
    """Token arrays of a chunk's texts: each token's text, its word, the word before it."""

    def __init__(self, texts: list[str | None], held: np.ndarray):
        hs, owners = [], []
        for first, last, buffer, starts in gather(texts):
            a, b = words(buffer, NOT_SPACE)
            h = hashes(buffer, a, b)
            per_text = np.diff(np.concatenate((np.searchsorted(a, starts), [len(a)])))
            ends = np.cumsum(per_text)
            hs.append(np.insert(h, ends, END))
            owners.append(np.repeat(np.arange(first, last), per_text + 1))
        tokens = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        self.text = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.train = ~held[self.text]
        starts = np.concatenate(([True], self.text[1:] != self.text[:-1])) if len(tokens) else np.zeros(0, bool)
        code, found = pd.factorize(tokens)
        found = np.append(found.astype(np.uint64), START)
        order, rank = ranked(found)
        self.words, self.start_word = found[order], int(rank[-1])
        self.word = rank[code]
        self.context = np.where(starts, self.start_word, np.concatenate((self.word[:1], self.word[:-1])))
        self.train_texts = int((~held).sum())
        width = len(self.words)
        code, found = coded(self.context * width + self.word)
        key = mix(self.words[found // width] * K + self.words[found % width])
        order, rank = ranked(key)
        self.bigrams, self.bigram = key[order], rank[code]
        self.of_context, self.of_word = found[order] // width, found[order] % width
        self.later = np.flatnonzero(~starts)  # tokens with two before them, the start context counted
        self.first = np.flatnonzero(starts)
        self.at_start = np.zeros(len(self.bigrams), bool)
        self.at_start[self.bigram[self.first]] = True

    def with_trigrams(self) -> Chunk:
        width = len(self.words)
        code, found = coded(self.bigram[self.later - 1] * width + self.word[self.later])
        key = mix(self.bigrams[found // width] * K + self.words[found % width])
        order, rank = ranked(key)
        self.trigrams, self.trigram = key[order], rank[code]
        # a trigram's two bigrams
        self.of_first = found[order] // width
        self.of_last = np.empty(len(self.trigrams), np.int64)
        self.of_last[self.trigram] = self.bigram[self.later]
        return self

    def trigram_counts(self) -> np.ndarray:
        return np.bincount(self.trigram, weights=self.train[self.later], minlength=len(self.trigrams)).astype(np.uint64)

    def bigram_stats(self, total: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """count, left contexts, followers seen once, twice, more: this chunk's part of the sums over the corpus."""
        n, count, own = len(self.bigrams), self.bigram_counts(), first & (total > 0)
        left = np.where(self.at_start, count, np.bincount(self.of_last[own], minlength=n))
        return [count, *(x.astype(np.uint64) for x in (left, *(np.bincount(self.of_first[own & which], minlength=n) for which in (total == 1, total == 2, total > 2))))]

    def bigram_counts(self) -> np.ndarray:
        return np.bincount(self.bigram, weights=self.train, minlength=len(self.bigrams)).astype(np.uint64)

    def word_stats(self, total: np.ndarray, first: np.ndarray, left: np.ndarray | None = None) -> list[np.ndarray]:
        """count, left contexts, followers seen once, twice, more; with the bigrams' left contexts also their sum, and followers
        with one, two, more: this chunk's part of the sums over the corpus."""
        n = len(self.words)
        count = np.bincount(self.word, weights=self.train, minlength=n)
        count[self.start_word] += self.train_texts
        own = first & (total > 0)
        follow = lambda x: [np.bincount(self.of_context[own & which], minlength=n) for which in (x == 1, x == 2, x > 2)]
        got = [count, np.bincount(self.of_word[own], minlength=n), *follow(total)]
        if left is not None:
            got += [np.bincount(self.of_context[own], weights=left[own], minlength=n), *follow(left)]
        return [x.astype(np.uint64) for x in got]


def write_chunks(df: DataFrame, key: str, text: str, held: Column, buckets: int) -> str:
    """A table of chunks, bucketed by chunk, and its name."""
    source = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held.alias("held"))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("size", T.LongType()), T.StructField("ids", T.ArrayType(df.schema[key].dataType)), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("held", T.ArrayType(T.BooleanType()))])

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        rows, size = ([], [], []), 0
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for column, value in zip(rows, row):
                    column.append(value)
                size += len(row[1]) + 16
                if size >= CHUNK_BYTES:
                    yield of(part, n, size, rows, kind)
                    rows, size, n = ([], [], []), 0, n + 1
        if rows[0]:
            yield of(part, n, size, rows, kind)

    def of(part, n, size, rows, kind):
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([size], pa.int64()), pa.array([rows[0]], pa.list_(kind)), pa.array([rows[1]], pa.list_(pa.string())), pa.array([rows[2]], pa.list_(pa.bool_()))], names=["chunk", "size", "ids", "texts", "held"])

    name = f"ngram_chunks_{uuid.uuid4().hex}"
    source.mapInArrow(run, schema).write.option("compression", "zstd").bucketBy(buckets, "chunk").format("parquet").saveAsTable(name)
    return name


def chunk_of(row: dict) -> Chunk:
    return Chunk(row["texts"], np.array(row["held"], bool))


def whole_chunk(row: dict, order: int) -> Chunk:
    return chunk_of(row).with_trigrams() if order == 3 else chunk_of(row)


def rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}


# ---- the stored model ------------------------------------------------------------------------------------------------


def write_shard(path: str, keys: np.ndarray, columns: list[np.ndarray], shards: int) -> None:
    """A file of one shard's n-grams: sorted different hashes of its range, and each one's counts as the code of a row of a
    table of the different rows. A hash is kept as its bucket (an index of where each begins) and the 32 bits after it."""
    seen = np.any(columns, axis=0)  # n-grams of held-out texts alone aren't part of the model
    x, columns = keys[seen] * np.uint64(shards), [c[seen] for c in columns]
    bits = max(1, int(len(x) // 16).bit_length())
    row = columns[0]
    for column in columns[1:]:
        row = mix(row * K + column)
    code, _ = pd.factorize(row)
    first = np.flatnonzero(~pd.Series(code).duplicated().to_numpy())
    rows = np.stack([c[first] for c in columns], 1).astype(np.uint64).reshape(-1, len(columns))
    kind = np.uint8 if len(rows) <= 1 << 8 else np.uint16 if len(rows) <= 1 << 16 else np.uint32
    index = np.searchsorted(x >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    suffix = (x >> np.uint64(32 - bits)).astype(np.uint32)
    header = np.array([len(x), bits, np.dtype(kind).itemsize, *rows.shape], np.int64)
    write_bytes(path, b"".join(part.tobytes() for part in (header, rows, index, suffix, code.astype(kind))))


class Shard:
    """A shard's file, mapped in memory."""

    def __init__(self, path: str, shards: int):
        raw, at = read_bytes(path), 40
        n, bits, size, n_rows, n_columns = (int(v) for v in np.frombuffer(raw, np.int64, 5))
        self.shards, self.bits, self.n = np.uint64(shards), bits, n
        parts = []
        for kind, count in ((np.uint64, n_rows * n_columns), (np.uint32, (1 << bits) + 1), (np.uint32, n), ({1: np.uint8, 2: np.uint16, 4: np.uint32}[size], n)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        self.rows, self.index, self.suffix, self.code = parts[0].reshape(n_rows, n_columns), *parts[1:]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key of this shard's range is kept, or -1."""
        x = keys * self.shards
        bucket = (x >> np.uint64(64 - self.bits)).astype(np.int64)
        suffix = (x >> np.uint64(32 - self.bits)).astype(np.uint32)
        at, stop = self.index[bucket].astype(np.int64), self.index[bucket + 1].astype(np.int64)
        out = np.full(len(keys), -1)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            same = self.suffix[at[todo]] == suffix[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return out

    def counts(self, places: np.ndarray) -> list[np.ndarray]:
        """The columns of counts at places; zeros for -1."""
        if not self.n:
            return [np.zeros(len(places), np.uint64) for _ in range(self.rows.shape[1])]
        code = self.code[places]
        return [np.where(places >= 0, column[code], np.uint64(0)) for column in self.rows.T]


# ---- questions and answers -------------------------------------------------------------------------------------------

ASK = "shard int, chunk long, keys binary, values array<binary>"
ANSWER = "shard int, chunk long, values array<binary>, totals array<bigint>"
ASK_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("values", pa.list_(pa.binary()))])
ANSWER_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("values", pa.list_(pa.binary())), ("totals", pa.list_(pa.int64()))])


def ask(chunk: int, keys: np.ndarray, values: list[np.ndarray], shards: int):
    bounds = shard_bounds(keys, shards)
    for s in range(shards):
        a, b = int(bounds[s]), int(bounds[s + 1])
        if b > a:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([s], [chunk], [packed_sorted(keys[a:b])], [[packed(v[a:b]) for v in values]]), ASK_ARROW)], schema=ASK_ARROW)


def shard_path(folder: str, level: str, shard: int) -> str:
    return f"{folder}/{level}/{shard:06d}"


def learned(asked: DataFrame, folder: str, level: str, shards: int, totals) -> DataFrame:
    """Each shard's questions are summed and kept as its file of the model; the answers are looked up there, with a last column
    that says which n-grams this chunk is the first to have in a training text. ``totals`` of the shard's sums go with one of the answers.
    A task that runs again writes the same file."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        number, keys, values = group["shard"][0].as_py(), group["keys"], group["values"]
        asks = [unpacked_sorted(k.as_py()) for k in keys]
        sizes = [len(k) for k in asks]
        every = np.concatenate(asks)
        del asks
        order = sorted_order(every * np.uint64(shards))  # scaled: a shard's hashes agree in their high bits
        every = every[order]
        new = np.concatenate(([True], every[1:] != every[:-1]))
        starts = np.flatnonzero(new)
        sums, asker = [], np.repeat(np.arange(len(keys), dtype=np.int32), sizes)[order]
        for c in range(len(values[0])):
            column = np.concatenate([unpacked(v[c].as_py()) for v in values])[order]
            sums.append(np.add.reduceat(column, starts))
            if not c:
                first = np.minimum.reduceat(np.where(column > 0, asker, len(keys)), starts)
        path = shard_path(folder, level, number)
        write_shard(path, every[starts], sums, shards)
        of_shard, seen = totals(np.array(sums)), np.any(sums, axis=0)
        first, kept = first[seen], np.where(seen, np.cumsum(seen) - 1, -1)  # where each is in the file
        place = np.empty(len(every), np.int32)
        place[order] = kept[np.cumsum(new) - 1]
        del every, order, asker, new, sums
        shard, out, at = Shard(path, shards), [], 0
        for k, n in enumerate(sizes):
            own = place[at : at + n]
            mine = (own >= 0) & (first[own] == k) if len(first) else np.zeros(n, bool)
            out.append({"shard": number, "chunk": group["chunk"][k].as_py(), "values": [*map(packed, shard.counts(own)), packed(mine.astype(np.uint8))], "totals": of_shard if k == 0 else None})
            at += n
        return pa.Table.from_pylist(out, schema=ANSWER_ARROW)

    return materialise(asked.groupBy("shard").applyInArrow(run, ANSWER), f"ngram-{level}")


def recalled(asked: DataFrame, folder: str, level: str, shards: int) -> DataFrame:
    """Answers to questions without counts, looked up in the model's files."""

    def run(batches):
        shard, number = None, None
        for batch in batches:
            for s, chunk, keys in zip(*(batch.column(n).to_pylist() for n in ("shard", "chunk", "keys"))):
                if s != number:
                    shard, number = Shard(shard_path(folder, level, s), shards), s
                values = [packed(c) for c in shard.counts(shard.places(unpacked_sorted(keys)))]
                yield pa.RecordBatch.from_pylist([{"shard": s, "chunk": chunk, "values": values, "totals": None}], schema=ANSWER_ARROW)

    return materialise(asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, ANSWER), f"ngram-{level}")


def how_many(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def trigram_totals(sums: np.ndarray) -> list[int]:
    return how_many(sums[0])


def bigram_totals(sums: np.ndarray) -> list[int]:
    return how_many(sums[0]) + (how_many(sums[1]) if len(sums) > 1 else [0] * 4)


def word_totals(sums: np.ndarray) -> list[int]:
    return [int((sums[0] > 0).sum()), int(sums[0].sum()), int(sums[1].sum()), *how_many(sums[1]), int((sums[1] > 2).sum())]


def gathered(chunks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """chunks with the answers of all shards, in the order of the shards."""
    own = replies.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("shard", "values"))).alias(name))
    return chunks.join(own, "chunk", "left")


def joined(parts: list[dict] | None, column: int, kind=np.uint64) -> np.ndarray:
    """A column of a chunk's answers, all shards' in a row; -1 is the mark of first occurrence."""
    return np.concatenate([unpacked(p["values"][column], kind) for p in parts]) if parts else np.zeros(0, kind)


def firsts(parts: list[dict] | None) -> np.ndarray:
    return joined(parts, -1, np.uint8).astype(bool)


# ---- learning --------------------------------------------------------------------------------------------------------


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2, 3 and more, from how many n-grams occur once to four times."""
    out = [0.0, 0.5, 1.0, 1.5]
    if all(n[:4]):
        y = n[0] / (n[0] + 2 * n[1])
        out = [0.0, *(min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))]
    return np.array(out)


@dataclass(frozen=True)
class Model:
    """What is known of the corpus besides the shards' files."""

    folder: str
    order: int
    shards: int
    tokens: int  # of training texts, ends counted
    vocabulary: int
    types: int  # different bigrams
    words: tuple[int, ...]  # how many words have one to four left contexts, and more than two
    bigrams: tuple[int, ...]  # how many bigrams occur once to four times; then how many have one to four left contexts
    trigrams: tuple[int, ...]

    def logs(self, c: Chunk, count1: list[np.ndarray], count2: list[np.ndarray], count3: np.ndarray | None) -> dict[int, np.ndarray]:
        """log10 probability of each token by the models of each order, from the counts of the chunk's n-grams."""
        d1, spare = discounts(list(self.words[:4])), 1.0
        if self.types:
            spare = (d1[1] * self.words[0] + d1[2] * self.words[1] + d1[3] * self.words[4]) / self.types
        number = lambda columns: [x.astype(np.float64) for x in columns]
        count1, pairs = number(count1), count2[0].astype(np.int64)
        count, left = count1[:2]
        p1 = np.maximum(left - d1[np.minimum(left, 3).astype(int)], 0) / max(self.types, 1) + spare / (self.vocabulary + 1)
        out = {2: np.log10(interpolated(pairs, discounts(list(self.bigrams[:4])), count, count1[2:5], c.of_context, p1[c.of_word]))[c.bigram]}
        if self.order == 3:
            left2, *followers = (x.astype(np.int64) for x in count2[1:5])
            lower = interpolated(left2, discounts(list(self.bigrams[4:])), count1[5], count1[6:9], c.of_context, p1[c.of_word])
            whole = np.log10(interpolated(count3.astype(np.int64), discounts(list(self.trigrams)), pairs, followers, c.of_first, lower[c.of_last]))
            out[3] = np.log10(lower)[c.bigram]
            out[3][c.later] = whole[c.trigram]
        return out

    def rows(self, chunk: dict, count1: list[np.ndarray], count2: list[np.ndarray], count3: np.ndarray | None, c: Chunk, id_type: pa.DataType) -> pa.RecordBatch:
        """Scores of a chunk's texts."""
        n, count = len(chunk["ids"]), count1[0].astype(np.float64)
        sums = lambda x: np.bincount(c.text, weights=x, minlength=n)
        n_tokens = np.bincount(c.text, minlength=n)
        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))
        scores = {order: sums(x) for order, x in self.logs(c, count1, count2, count3).items()}
        perplexity = lambda x: pa.array(10 ** (-x / n_tokens))
        arrays = [
            pa.array(chunk["ids"], id_type), pa.array(chunk["held"], pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(sums((count > 0)[c.word]).astype(np.int64)), pa.array(np.full(n, self.tokens, np.int64)),
            pa.array(sums(base[c.word])), pa.array(scores[self.order]), perplexity(scores[self.order]),
        ]
        for order in sorted(scores):
            arrays += [pa.array(scores[order]), perplexity(scores[order])]
        return pa.RecordBatch.from_arrays(arrays, names=score_names(self.order))

    def save(self) -> None:
        write_bytes(f"{self.folder}/model.json", json.dumps(asdict(self)).encode())

    @staticmethod
    def load(folder: str) -> Model:
        got = json.loads(bytes(read_bytes(f"{folder}/model.json")))
        return Model(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()} | {"folder": folder})


def score_names(order: int) -> list[str]:
    own = [f"{name}_{x}" for name in ("bigram", "trigram")[: order - 1] for x in ("score", "perplexity")]
    return ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity", *own]


def score_schema(key: T.StructField, order: int) -> T.StructType:
    kinds = [T.BooleanType(), *[T.LongType()] * 3, *[T.DoubleType()] * (2 * order + 1)]
    return T.StructType([key, *(T.StructField(n, k) for n, k in zip(score_names(order)[1:], kinds))])


def interpolated(count: np.ndarray, d: np.ndarray, context: np.ndarray, followers: list[np.ndarray], at: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of n-grams: their counts; counts and followers of contexts, the place of each one's there; the lower order's."""
    with np.errstate(divide="ignore", invalid="ignore"):
        back = np.where(context > 0, sum(d[k + 1] * f for k, f in enumerate(followers)) / context, 1.0)
    seen = np.where(context[at] > 0, np.maximum(count - d[np.minimum(count, 3)], 0) / np.maximum(context[at], 1), 0.0)
    return seen + back[at] * lower


class Corpus:
    """A table cut in chunks, and what is to be deleted once it is scored."""

    def __init__(self, df: DataFrame, held: Column, key: str, text: str):
        self.spark, self.field = df.sparkSession, df.schema[key]
        self.table = write_chunks(df, key, text, F.coalesce(held, F.lit(False)), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.chunks = self.spark.table(self.table)
        self.texts = self.chunks.select("chunk", "texts", "held")
        self.kept: list[DataFrame] = []

    def shards(self) -> int:
        size = self.chunks.agg(F.sum("size")).first()[0] or 0
        return max(self.spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))

    def keep(self, answers: DataFrame) -> DataFrame:
        self.kept.append(answers)
        return answers

    def finished(self, scores: DataFrame) -> DataFrame:
        """The scores, written; what led to them is deleted."""
        out = materialise(scores, "ngram-scores")
        self.clear()
        return out

    def clear(self) -> None:
        for answers in self.kept:
            delete(answers)
        self.spark.sql(f"drop table if exists {self.table}")


def fit(corpus: Corpus, order: int, folder: str | None) -> tuple[Model, dict[str, DataFrame]]:
    """The model of a corpus, its files in ``folder``, and the answers that its chunks got by the way. Without a folder an
    order's files are in the shared one until all chunks have been answered from them."""
    if order not in (2, 3):
        raise ValueError("models have order 2 or 3")
    spark, shards, known, replies = corpus.spark, corpus.shards(), corpus.texts, {}
    stays, folder = bool(folder), folder or f"{shared_dir(spark)}/ngram-model-{uuid.uuid4().hex}"

    def learn(asked: DataFrame, level: str, totals) -> None:
        replies[level] = corpus.keep(learned(asked, folder, level, shards, totals))
        if not stays:
            delete(spark, f"{folder}/{level}")

    if order == 3:

        def ask_trigrams(batches):
            for row in rows_of(batches):
                c = chunk_of(row).with_trigrams()
                yield from ask(row["chunk"], c.trigrams, [c.trigram_counts()], shards)

        learn(known.mapInArrow(ask_trigrams, ASK), "trigrams", trigram_totals)
        known = gathered(known, replies["trigrams"], "trigrams")

    def ask_bigrams(batches):
        for row in rows_of(batches):
            c = whole_chunk(row, order)
            stats = c.bigram_stats(joined(row["trigrams"], 0), firsts(row["trigrams"])) if order == 3 else [c.bigram_counts()]
            yield from ask(row["chunk"], c.bigrams, stats, shards)

    learn(known.mapInArrow(ask_bigrams, ASK), "bigrams", bigram_totals)

    def ask_words(batches):
        for row in rows_of(batches):
            c = chunk_of(row)
            left = joined(row["bigrams"], 1) if order == 3 else None
            yield from ask(row["chunk"], c.words, c.word_stats(joined(row["bigrams"], 0), firsts(row["bigrams"]), left), shards)

    learn(gathered(corpus.texts, replies["bigrams"], "bigrams").mapInArrow(ask_words, ASK), "words", word_totals)

    def totals(level: str, n: int) -> tuple[int, ...]:
        row = replies[level].agg(*(F.sum(F.element_at("totals", k + 1)).alias(f"t{k}") for k in range(n))).first()
        return tuple(int(x or 0) for x in row)

    vocabulary, tokens, types, *left_counts = totals("words", 8)
    trained = corpus.chunks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    # the start context is no token
    model = Model(folder, order, shards, tokens - trained, vocabulary - bool(trained), types, tuple(left_counts), totals("bigrams", 8), totals("trigrams", 4) if order == 3 else ())
    if stays:
        model.save()
    return model, replies


def train(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", order: int = ORDER) -> Model:
    """A model of all rows of df, kept in ``folder`` for ``score_with``."""
    corpus = Corpus(df, F.lit(False), key, text)
    model, _ = fit(corpus, order, folder)
    corpus.clear()
    return model


def score_with(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``score`` gives, for texts that the model needn't have seen; every row counts as held out."""
    corpus = Corpus(df, F.lit(True), key, text)
    out, all_of = corpus.chunks, {"words": 9 if model.order == 3 else 5, "bigrams": 5 if model.order == 3 else 1, "trigrams": 1}
    levels = LEVELS[: model.order]
    for level in levels:

        def questions(batches, level=level):
            for row in rows_of(batches):
                c = chunk_of(row)
                yield from ask(row["chunk"], getattr(c.with_trigrams() if level == "trigrams" else c, level), [], model.shards)

        out = gathered(out, corpus.keep(recalled(corpus.texts.mapInArrow(questions, ASK), model.folder, level, model.shards)), level)

    def finish(batches):
        for row in rows_of(batches):
            got = {level: [joined(row[level], k) for k in range(all_of[level])] for level in levels}
            yield renamed(model.rows(row, got["words"], got["bigrams"], got["trigrams"][0] if model.order == 3 else None, whole_chunk(row, model.order), id_type), schema)

    id_type, schema = to_arrow_type(corpus.field.dataType), score_schema(corpus.field, model.order)
    return corpus.finished(out.mapInArrow(finish, schema))


def renamed(batch: pa.RecordBatch, schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(batch.columns, names=schema.names)


def score(df: DataFrame, held: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, folder: str | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (of the model of the order) for every row, and
    score and perplexity of each order from 2; rows that ``held`` marks aren't learned from. With ``folder`` the model stays
    there; else it is deleted with the rest."""
    corpus = Corpus(df, held, key, text)
    model, replies = fit(corpus, order, folder)

    def finish(batches):
        for row in rows_of(batches):
            count1, count2 = ([joined(row[level], k) for k in range(n)] for level, n in (("words", 9 if order == 3 else 5), ("bigrams", 5 if order == 3 else 1)))
            yield renamed(model.rows(row, count1, count2, joined(row["trigrams"], 0) if order == 3 else None, whole_chunk(row, order), id_type), schema)

    id_type, schema = to_arrow_type(corpus.field.dataType), score_schema(corpus.field, order)
    asked = corpus.chunks
    for level in LEVELS[:order]:
        asked = gathered(asked, replies[level], level)
    out = corpus.finished(asked.mapInArrow(finish, schema))
    if not folder:
        delete(corpus.spark, model.folder)
    return out


def op6_ngrams(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    """The query; it is registered with the order ``ORDER``."""
    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2, order=order)
