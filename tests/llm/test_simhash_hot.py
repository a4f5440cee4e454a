"""Values that very many fingerprints share, and rows without an identity of their own."""

import random

from pyspark.sql import functions as F

from poolstrata.llm import simhash
from poolstrata.llm.components import connected_components


def root_of(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_hot_values_lose_no_link(spark):
    rng = random.Random(8)
    low = rng.getrandbits(32)
    fps = {low | rng.getrandbits(32) << 32 for _ in range(300)}  # one low segment, mutually far apart
    for x in list(fps)[:60]:  # and some close ones
        for _ in range(4):
            y = x
            for _ in range(rng.randrange(1, 5)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    parent = {x: x for x in fps}
    for n, x in enumerate(fps):
        for y in fps[:n]:
            if (x ^ y).bit_count() <= 4:
                parent[max(root_of(parent, x), root_of(parent, y))] = min(root_of(parent, x), root_of(parent, y))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3)
    for hot in (10, 1 << 12):
        got = simhash.links(frame, hot=hot).collect()
        part = {r.node: r.component for r in connected_components(spark.createDataFrame(got, "a long, b long")).collect()}
        ours = {}
        for x in fps:
            ours.setdefault(part.get(signed(x), signed(x)), set()).add(x)
        want = {}
        for x in fps:
            want.setdefault(root_of(parent, x), set()).add(x)
        assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))


def test_names_that_clash_stay(spark):
    text = " ".join(str(n) for n in range(50))
    rows = spark.createDataFrame([(3, text, 1, 2, 3), (2, text, 4, 5, 6), (2, "other words here", 7, 8, 9)], "doc_id long, text string, _keep int, _fp int, _row int")
    got = simhash.deduplicate(rows.withColumn("_ROW_", F.lit(1)))
    assert got.columns == [*rows.columns, "_ROW_"] and sorted(tuple(r)[:5] for r in got.collect()) == sorted([(2, "other words here", 7, 8, 9), (2, text, 4, 5, 6)])
