"""The filter audit against filters that are really applied one after the other, and against its SQL."""

import os
import re
from itertools import permutations

import duckdb
import pytest

from poolstrata.llm import filter_audit as A

DOCS = "doc_id bigint, text string, source string, part string, id int, mask string"
LABELS = "doc_id bigint, quality int, toxic int"
DATA = "/root/testdata/sf0.001"
PROSE = " ".join(f"w{n}" for n in range(60))
ROWS = [
    (1, PROSE, "a", "x", 0, ""), (2, PROSE, "b", None, 0, ""), (3, PROSE, "a", "x", 0, ""), (3, PROSE, "a", "x", 0, ""), (4, PROSE + " #", "a", "x", 0, ""), (5, "same " * 60, "a", "x", 0, ""),
    (6, PROSE.upper(), "b", "x", 0, ""), (7, None, "b", "x", 0, ""), (8, "", "a", "x", 0, ""), (9, "\x0b\x0c \t", "", "x", 0, ""), (None, PROSE, "a", "x", 0, ""), (None, "alone", None, "x", 0, ""),
    (10, "Été à ÀÉ " * 30, None, "x", 0, ""), (11, "café bar " + PROSE, "b", "x", 0, ""), (12, "word|" * 200_000, "a", "x", 0, ""), (13, "THE END", "b", "x", 0, ""),
]
MARKED = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (4, None, 1), (7, 0, 1), (None, 1, 1), (99, 1, 1), (6, 1, None), (8, 1, 0)]


def brute(rows, labels):
    docs = [(i, t or "", s or "") for i, t, s, *_ in rows]
    label = lambda i, k: i is not None and any(row[k] == 1 for row in labels if row[0] == i)
    fails = []
    for i, t, _ in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)})
    out = {}
    for part in {s for *_, s in docs}:
        members = [n for n, d in enumerate(docs) if d[2] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [n for n in left if fails[n][f]]
                left = [n for n in left if not fails[n][f]]
                removed_by[f] += len(gone)
                every = [n for n in members if fails[n][f]]
                out[part, "".join(order), step] = [len(left), len(gone), len(every) - len(gone), sum(sum(fails[n].values()) == 1 for n in every), sum(label(docs[n][0], 1) for n in gone), sum(label(docs[n][0], 2) for n in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def plain(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_like_filters_applied(spark):
    got = A.filter_audit(spark.createDataFrame(ROWS, DOCS).repartition(3), spark.createDataFrame(MARKED, LABELS)).collect()
    assert plain(got) == brute(ROWS, MARKED) and len(got) == 3 * 120 * 5


def test_empty_table(spark):
    assert A.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_no_labels(spark):
    got = A.filter_audit(spark.createDataFrame(ROWS[:3], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert plain(got) == brute(ROWS[:3], [])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_reach_every_order_once(n):
    order, seen = list(range(n)), []
    seen.append(tuple(order))
    for level in A.swaps(n):
        order[level], order[level + 1] = order[level + 1], order[level]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def test_swap_keeps_the_function():
    counts = {m: (m * m % 7, m % 2, m % 3) for m in range(32)}
    d = A.Diagram(counts)
    top = d.weight[d.root]
    for level in A.swaps(5):
        d.swap(level)
        assert d.weight[d.root] == top

        def leaf(node, level, mask):
            if level == 5:
                assert d.weight[node] == counts[mask]
                return
            passes, fails = d.children[node]
            leaf(passes, level + 1, mask), leaf(fails, level + 1, mask | 1 << d.order[level])

        leaf(d.root, 0, 0)
        assert all(len(nodes) <= 1 << k for k, nodes in enumerate(d.nodes))


def test_equal_parts_are_shared():
    d = A.Diagram({m: (1, 0, 0) for m in range(32)})
    assert [len(nodes) for nodes in d.nodes] == [1] * 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
def test_query_against_sql(spark):
    c = duckdb.connect()
    for name in ("documents", "labels"):
        c.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    rel = c.sql(A.ORACLE_SQL)
    theirs = sorted(tuple(dict(zip(rel.columns, r))[k] for k in sorted(rel.columns)) for r in rel.fetchall())
    found = A.op11_filter_audit(spark, DATA)
    assert sorted(found.columns) == sorted(rel.columns)
    assert sorted(tuple(r[k] for k in sorted(found.columns)) for r in found.collect()) == theirs
