"""Benchmark decontamination by the q-gram lemma.

An item of m characters counts as leaked where a document holds a region at most k = floor(m / 10) edits away. Texts are
compared lower-cased, white space as one space.

1. Anchors. Cut in k + 2 pieces, an item that suffers k edits keeps two pieces whole. Of each piece one stretch of
   ``ANCHOR`` characters (``SHORT_ANCHOR`` for items under 10 ``ANCHOR`` characters, whose pieces are shorter) is its anchor, the one
   that fewest items of the block share, so common openings make no hits. Places of a document that hold an anchor give
   (item, diagonal) hits; two hits of an item within 2k diagonals make candidates.
2. Q-gram lemma. Candidates are gathered in overlapping diagonal bands (width W, overlap 2k). An occurrence within
   k edits shares at least m - q + 1 - k q of the item's q-grams inside its band; bands with fewer are dropped.
3. Banded alignment of what is left, free at both ends of the document's region, gives the edits and the place.

The benchmark is the query set: it is taken in blocks of about ``BLOCK_CHARS`` characters, each block's index is broadcast
(its size is bounded by that), and every document is scanned against it where it lies. No shuffle.

Defined cases: null texts are empty and match nothing; items that normalise to nothing match nothing; items under
20 characters that are too short for k + 2 anchors have k + 1, one hit of which makes a candidate; those under ``ANCHOR`` match only a whole document; repeated items and documents each
give their rows; an empty benchmark or table gives none. Only ids and texts are read; ``clean`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

ANCHOR = 8
SHORT_ANCHOR = 5
Q = 5
EDIT_SHARE = 0.1
BLOCK_CHARS = 4_000_000
SLOT_BITS = 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """32-bit hashes of all n-grams (n = 8 or 5)."""
    if len(x) < n:
        return np.zeros(0, np.uint32)
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    two ^= two >> np.uint32(15)
    four = two[:-2] * np.uint32(0xC2B2AE3D) + two[2:]
    four ^= four >> np.uint32(13)
    last = four[:-4] * np.uint32(0x27D4EB2F) + four[4:] if n == 8 else four[:-1] * np.uint32(0x27D4EB2F) + x[4:] * np.uint32(0x165667B1)
    return last ^ last >> np.uint32(16)


@dataclass
class Item:
    item_id: object
    text: str
    x: np.ndarray
    k: int
    need: int  # anchors
    least: int  # shared q-grams in a band
    sorted_grams: np.ndarray
    gram_places: np.ndarray


class Anchors:
    """Anchors of one length, by hash."""

    def __init__(self, n: int, hashes: np.ndarray, places: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.n, self.hashes = n, hashes[order]
        self.owner, self.at = places[order].T
        self.slots = np.zeros(1 << SLOT_BITS, bool)
        self.slots[self.hashes >> np.uint32(32 - SLOT_BITS)] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item number, diagonal) of each place of a document that holds an anchor."""
        h = grams(x, self.n)
        at = np.flatnonzero(self.slots[h >> np.uint32(32 - SLOT_BITS)])
        low, high = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        which = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return self.owner[which], np.repeat(at, n) - self.at[which]


class Index:
    """Anchors and q-grams of one block of items."""

    def __init__(self, items: list[tuple[object, str]], share: float = EDIT_SHARE):
        self.items: list[Item] = []
        self.whole: dict[str, list[object]] = {}
        bodies = []
        for item_id, body in items:
            text = normal(body)
            if len(text) < ANCHOR:
                self.whole.setdefault(text, []).append(item_id) if text else None
            else:
                bodies.append((item_id, text, points(text)))
        self.anchors = []
        for n in (ANCHOR, SHORT_ANCHOR):
            own = [(*b, grams(b[2], n)) for b in bodies if (len(b[1]) >= 10 * ANCHOR) == (n == ANCHOR)]
            common, times = np.unique(np.concatenate([np.unique(b[3]) for b in own]), return_counts=True) if own else (None, None)
            hashes, places = [], []
            for item_id, text, x, g in own:
                m, k = len(text), int(len(text) * share)
                need = 2 if m >= (k + 2) * n else 1
                k = max(0, min(k, m // n - need))  # holds for shares over a tenth only
                rare = times[np.searchsorted(common, g)]
                for p in range(k + need):
                    first, last = p * m // (k + need), (p + 1) * m // (k + need) - n
                    at = first + int(rare[first : last + 1].argmin())
                    hashes.append(int(g[at]))
                    places.append((len(self.items), at))
                q = grams(x, Q)
                order = np.argsort(q, kind="stable")
                self.items.append(Item(item_id, text, x, k, need, m - Q + 1 - k * Q, q[order], order))
            if own:
                self.anchors.append(Anchors(n, np.array(hashes, np.uint32), np.array(places, np.int64)))
        self.reach = np.array([2 * i.k for i in self.items], np.int64)
        self.single = np.array([i.need < 2 for i in self.items], bool)

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item number, diagonal) of the anchor hits in a document that have as many others of the item near as it takes."""
        hits = [a.hits(x) for a in self.anchors]
        owner, diagonal = (np.concatenate(c) for c in zip(*hits)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((diagonal, owner))
        owner, diagonal = owner[order], diagonal[order]
        near = (owner[1:] == owner[:-1]) & (diagonal[1:] - diagonal[:-1] <= self.reach[owner[1:]]) if len(owner) else np.zeros(0, bool)
        keep = self.single[owner] if len(owner) else near
        keep[1:] |= near
        keep[:-1] |= near
        return owner[keep], diagonal[keep]

    def find(self, body: str | None) -> list[tuple[object, int, int, int, int]]:
        """(item_id, start, end, edits, shared q-grams): the best region of each item that the document holds, in normalised
        characters; of equal edits the first."""
        text = normal(body)
        found = [(i, 0, len(text), 0, 0) for i in self.whole.get(text, ())]
        if len(text) < ANCHOR or not self.items:
            return found
        x = points(text)
        owners, diagonals = self.candidates(x)
        if not len(owners):
            return found
        doc_grams = grams(x, Q)
        best: dict[int, tuple[int, int, int, int]] = {}
        for number, first, last in bands(owners, diagonals, self.items):
            item = self.items[number]
            begin, stop = max(0, first - item.k), min(len(x), last + len(item.x) + item.k)
            shared = shared_grams(item, doc_grams[begin : max(begin, stop - Q + 1)], begin, first - item.k, last + item.k)
            if shared < item.least:
                continue
            place = text.find(item.text, begin, stop)
            got = (0, place, place + len(item.x)) if place >= 0 else align(item.x, x[begin:stop], first - item.k - begin, last + item.k - begin, item.k)
            if got is None:
                continue
            edits, s, e = got if place >= 0 else (got[0], got[1] + begin, got[2] + begin)
            best[number] = min(best.get(number, (1 << 30, 0, 0, 0)), (edits, s, e, shared))
        return found + [(self.items[n].item_id, s, e, d, c) for n, (d, s, e, c) in sorted(best.items())]


def bands(owners: np.ndarray, diagonals: np.ndarray, items: list[Item]):
    """(item, first and last diagonal) of bands that hold candidates. Each band is 2k + 1 wide at least and overlaps the next
    by what an occurrence may stray (k to either side, added by the caller), so no occurrence is cut."""
    seen = set()
    for number, diagonal in zip(owners.tolist(), diagonals.tolist()):
        width = 2 * items[number].k + 16
        key = (number, diagonal // width)
        if key not in seen:
            seen.add(key)
            yield number, key[1] * width, key[1] * width + width - 1


def shared_grams(item: Item, doc: np.ndarray, begin: int, first: int, last: int) -> int:
    """Q-grams of the item that a document region has on the diagonals first..last; each place of the item counts once."""
    low, high = np.searchsorted(item.sorted_grams, doc, "left"), np.searchsorted(item.sorted_grams, doc, "right")
    hit = np.flatnonzero(high > low)
    n = (high - low)[hit]
    if not len(n):
        return 0
    which = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    place = item.gram_places[which]
    diagonal = np.repeat(hit, n) + begin - place
    return len(np.unique(place[(diagonal >= first) & (diagonal <= last)]))


def align(a: np.ndarray, b: np.ndarray, first: int, last: int, k: int) -> tuple[int, int, int] | None:
    """Fewest edits between all of a and a part of b on the diagonals first..last (b's place minus a's), with that part's start
    and end, or None beyond k. One row for each character of a; insertions by a running minimum."""
    width = last - first + 1
    big = 1 << 20
    lanes = np.arange(width)
    column = first + lanes  # row 0: place in b
    cost = np.where((column >= 0) & (column <= len(b)), 0, big)
    start = column.copy()
    for i in range(len(a)):
        at = column + i  # the character of b that a diagonal step takes
        inside = (at >= 0) & (at < len(b))
        same = np.zeros(width, bool)
        same[inside] = b[at[inside]] == a[i]
        step = cost + np.where(same, 0, 1)
        step[~inside] = big
        gap = np.concatenate((cost[1:] + 1, [big]))  # a's character is missing in b: from the next diagonal of the row before
        new = np.minimum(step, gap)
        new_start = np.where(step <= gap, start, np.concatenate((start[1:], [0])))
        run = np.minimum.accumulate(np.where(new < big, new, big) - lanes)  # b's extra characters: along the row
        better = run + lanes < new
        if better.any():
            source = np.maximum.accumulate(np.where(new - lanes == run, lanes, 0))
            new_start = np.where(better, new_start[source], new_start)
            new = np.minimum(new, run + lanes)
        new[(at + 1 < 0) | (at + 1 > len(b))] = big
        cost, start = new, new_start
        if cost.min() > k:
            return None
    edits = int(cost.min())
    lane = int(np.flatnonzero(cost == edits)[0])
    return edits, int(start[lane]), int(column[lane] + len(a))


def blocks(benchmark: DataFrame, item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS):
    """The benchmark's items in blocks of about block_chars characters, one block at a time on the driver."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(item_key, item_text)
    chars = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(n)) == k).orderBy(item_key).collect()]


def matches(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """key, item_id, start, end, edits, shared: each leaked item of each document at its best place (in normalised text)."""
    spark = df.sparkSession
    item_field = benchmark.schema[item_key]
    schema = T.StructType([df.schema[key], T.StructField("item_id", item_field.dataType), *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "edits", "shared"))])
    item_type, names = to_arrow_type(item_field.dataType), schema.names
    source, out = df.select(F.col(key), F.col(text)), None
    for block in blocks(benchmark, item_key, item_text):
        sent = spark.sparkContext.broadcast(Index(block, share))

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                rows = [(k, hit) for k, hits in enumerate(index.find(x.as_py()) for x in batch.column(1)) for hit in hits]
                values = [pa.array([hit[n] for _, hit in rows], t) for n, t in enumerate((item_type, *[pa.int32()] * 4))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in rows], pa.int64())), *values], names=names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """Rows of df that hold no benchmark item; columns and their order stay."""
    where = df.columns.index(text)
    for block in blocks(benchmark, item_key, item_text):
        sent = df.sparkSession.sparkContext.broadcast(Index(block, share))

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                yield batch.filter(pa.array([not index.find(x.as_py()) for x in batch.column(where)], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
