"""Filter interaction audit by decision diagrams.

``digests``  one Arrow map over whole texts: of each row its id, part, the text's SHA-256 and the mask of the filters A to D that
             it fails. No text moves.
``counts``   adds filter E (an equal text with a smaller id) and the labels, and comes down to a row for each part and mask.
             E needs no row of a group of copies beside another: rows of one text, part and label are counted as they are read, and
             of each such count only the least id and how many rows have it go on.
``Diagram``  a part's counts by mask as a decision diagram, one level for each filter: equal parts below are one node, and each
             node weighs what is below it. Swapping two adjacent levels changes the upper one's children only, so all orders are
             walked one swap apart (plain changes), and in each order the path that passes every filter gives the steps.

A diagram has at most 2^5 leaves, whatever the part holds, so a group of one part is 32 rows.

Defined cases: a null text is empty (it fails A; B, C and D pass, as nothing is nothing's share); null or empty texts are equal to each other; a
null part is the empty string, as a part named so; a null id fails no E and makes no other row fail; repeated rows count each, and equal
ids don't fail E by each other; a label that a document has twice counts if one of them is 1; an empty table gives no rows. Texts are
taken whole, however long. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, delete, materialise, table

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
# fixed values: the filters' thresholds and characters
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
UPPER = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))  # the bytes of a code point but its first

AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(raw: bytes) -> int:
    """Mask of the filters A to D that a text, in UTF-8, fails: bit k is the k-th filter."""
    words = raw.split()  # of bytes, split knows exactly the six white-space characters
    upper = len(raw) - len(raw.translate(None, UPPER))
    points = len(raw.translate(None, CONTINUATION))
    checks = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * upper > MOST_UPPER * points, len(raw.translate(None, MARKS)) < len(raw))
    return sum(1 << k for k, failed in enumerate(checks) if failed)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part, body (SHA-256) and mask (A to D) of every row."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("part", T.StringType()), T.StructField("body", T.BinaryType()), T.StructField("mask", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = pa.schema([("id", batch.schema.field(0).type), ("part", pa.string()), ("body", pa.binary()), ("mask", pa.int32())])

            def rows():
                for k, name, body in zip(*batch.columns):
                    raw = body.as_py() or b""
                    yield [k.as_py(), name.as_py() or "", hashlib.sha256(raw).digest(), failures(raw)], 80

            yield from batches_of(rows(), arrow)

    return df.select(F.col(key).alias("id"), F.col(part).cast("string").alias("part"), F.col(text).cast("binary").alias("body")).mapInArrow(run, schema)


def marks_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """id, good and toxic (0 or 1) of every labelled document."""
    marked = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(marked("quality")("good"), marked("toxic")("toxic"))


def counts(found: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """part, mask (A to E), n, good and toxic: documents of each part and mask, and how many of them have each label.

    found: rows of ``digests``, already in the shared folder. The result is there too: a row for each part and mask.
    """
    none = (F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    known = found.where("id is not null").join(marks_of(labels, key), "id", "left").select(*found.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    same = ["body", "part", "mask", "good", "toxic"]
    # rows of one id and text are one row with a count; then of each text, part and label the least id, its count, and the sum
    each = known.unionByName(found.where("id is null").select("*", *none)).groupBy("id", *same).agg(F.count("*").alias("n"))
    groups = materialise(each.groupBy(*same).agg(F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"), F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n"))).alias("with_id")), "audit-groups")
    firsts = groups.groupBy("body").agg(F.min("least").alias("first"), F.sum("with_id").alias("rows")).where("rows > 1").drop("rows")
    at_first = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    copies = F.when(F.col("first").isNotNull(), F.coalesce("with_id", F.lit(0)) - at_first).otherwise(0)
    split = groups.join(firsts, "body", "left").withColumn("_copies", copies)
    cases = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("_copies")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(DUPLICATE)).alias("mask"), F.col("_copies").alias("n")))
    rows = split.select("part", "good", "toxic", F.explode(cases).alias("c")).where("c.n > 0")
    summed = rows.groupBy("part", "c.mask").agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))
    out = materialise(summed, "audit-counts")
    delete(groups)
    return out


Weight = tuple[int, int, int]


class Diagram:
    """A decision diagram of counts by mask. ``order[i]`` is the filter of level i; a node's children are (passes, fails)."""

    def __init__(self, by_mask: dict[int, Weight], filters: int = len(FILTERS)):
        self.order = list(range(filters))
        self.nodes: list[dict[tuple[int, int], int]] = [{} for _ in range(filters)]  # of each level: children -> node
        self.children: dict[int, tuple[int, int]] = {}
        self.weight: dict[int, Weight] = {}
        leaves: dict[Weight, int] = {}

        def build(level: int, mask: int) -> int:
            if level == filters:
                weight = by_mask.get(mask, (0, 0, 0))
                if weight not in leaves:
                    leaves[weight] = self._new(weight)
                return leaves[weight]
            return self._node(self.nodes[level], build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _new(self, weight: Weight) -> int:
        self.weight[len(self.weight)] = weight
        return len(self.weight) - 1

    def _node(self, level: dict[tuple[int, int], int], passes: int, fails: int) -> int:
        if (passes, fails) not in level:
            a, b = self.weight[passes], self.weight[fails]
            node = level[passes, fails] = self._new((a[0] + b[0], a[1] + b[1], a[2] + b[2]))
            self.children[node] = (passes, fails)
        return level[passes, fails]

    def swap(self, i: int) -> None:
        """Exchange levels i and i + 1. Nodes of level i stay what they are, and so do all above; those of level i + 1 are new."""
        upper, lower = {}, {}
        for (passes, fails), node in self.nodes[i].items():
            (pp, pf), (fp, ff) = self.children[passes], self.children[fails]
            kids = self._node(lower, pp, fp), self._node(lower, pf, ff)
            upper[kids], self.children[node] = node, kids
        self.nodes[i], self.nodes[i + 1] = upper, lower
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> list[tuple[int, Weight, Weight]]:
        """(filter, weight kept, weight removed) at each level of the path that passes every filter."""
        out, node = [], self.root
        for of in self.order:
            passes, fails = self.children[node]
            out.append((of, self.weight[passes], self.weight[fails]))
            node = passes
        return out


def swaps(n: int) -> Iterator[int]:
    """Upper levels of the adjacent swaps that lead through all orders of n levels: the first one travels to the far end and back,
    and at either end the others make one swap of theirs."""
    if n < 2:
        return
    forth = True
    inner = swaps(n - 1)
    while True:
        yield from range(n - 1) if forth else range(n - 2, -1, -1)
        other = next(inner, None)
        if other is None:
            return
        yield other if forth else other + 1  # the traveller stands at the far end, or before the others
        forth = not forth


def audit_part(by_mask: dict[int, Weight], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order and step."""
    diagram = Diagram(by_mask, len(filters))
    fails = [sum(w[0] for mask, w in by_mask.items() if mask >> k & 1) for k in range(len(filters))]
    alone = [by_mask.get(1 << k, (0, 0, 0))[0] for k in range(len(filters))]
    shares, rows = [0] * len(filters), []

    def walk() -> None:
        name = "".join(filters[k] for k in diagram.order)
        for step, (of, kept, removed) in enumerate(diagram.steps(), 1):
            shares[of] += removed[0]
            rows.append((of, name, step, kept[0], removed[0], fails[of] - removed[0], alone[of], removed[1], removed[2]))

    walk()
    for level in swaps(len(filters)):
        diagram.swap(level)
        walk()
    return [(*row, shares[of]) for of, *row in rows]


def audit(by_mask: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows of ``counts`` to a row for each part, order and step."""
    names = [c.split(" ")[0] for c in AUDIT.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        weights = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples(index=False)}
        return pd.DataFrame([(key[0], *row) for row in audit_part(weights, filters)], columns=names)

    return by_mask.groupBy("part").applyInPandas(run, AUDIT)


def filter_audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each filter removes in every order, for every part of df."""
    found = materialise(digests(df, key, text, part), "audit-digests")
    by_mask = counts(found, labels, key)
    delete(found)
    return audit(by_mask)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SPACE = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
with doc as (select doc_id, coalesce(text, '') as body, coalesce(source, '') as part from documents),
words as (select doc_id, part, body, regexp_extract_all(body, '{SPACE}') as w from doc),
firsts as (select body, min(doc_id) as first from doc group by body),
label as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
checked as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    [len(w) < {LEAST_WORDS}, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w), 100 * length(regexp_replace(words.body, '[^A-Z]', '', 'g')) > {MOST_UPPER} * length(words.body), regexp_matches(words.body, '[#$%&*|]'), coalesce(firsts.first < words.doc_id, false)] as fails
  from words join firsts on words.body = firsts.body left join label on words.doc_id = label.doc_id),
grouped as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from checked group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select filter_order, step, substr(filter_order, step, 1) as f from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
met as (
  select part, filter_order, step, f, n, good, toxic, fails[ascii(f) - 64] as failing, len(list_filter(fails, lambda x: x)) = 1 as alone,
    len(list_filter(range(1, step), lambda j: fails[ascii(substr(filter_order, j, 1)) - 64])) > 0 as before
  from grouped, steps),
summed as (
  select part, filter_order, step, f, sum(case when not before and not failing then n else 0 end) as kept, sum(case when not before and failing then n else 0 end) as removed,
    sum(case when before and failing then n else 0 end) as redundant, sum(case when failing and alone then n else 0 end) as unique_fails,
    sum(case when not before and failing then good else 0 end) as good_lost, sum(case when not before and failing then toxic else 0 end) as toxic_lost
  from met group by part, filter_order, step, f)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from summed
"""
