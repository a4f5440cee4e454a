"""The registered queries, each against a plain version on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolstrata.llm import decontaminate, html_text, language, licenses, media_gif, queries, secrets, simhash, toxicity

ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (9004, "one"), (9004, "another text of this id"), (9005, "é 😀 ﬀ İstanbul"), (9006, "word " * 20000), (None, "no id here"), (None, "nor here, with other words"), (9007, "x" * 30000)]


def landed(spark, tmp_path, documents, **tables):
    rows = spark.createDataFrame(documents, "doc_id bigint, text string")
    for name in ("score", "fp", "media", "samples", "spans", "blob", "value", "length", "held_out", "_text", "n_bytes", "piece", "start", "license", "end", "_blob", "_fp", "_row", "_block"):
        rows = rows.withColumn(name, F.lit(7))
    rows.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx")).withColumn("source", F.lit(None).cast("string")).write.parquet(str(tmp_path / "documents.parquet"))
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).withColumn("fp", F.lit(1)).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def of(name, spark, where):
    return queries.QUERIES[name](spark, where).collect()


def held(i, modulus):
    return i is not None and zlib.crc32(str(i).encode()) % modulus


def test_op1(spark, tmp_path):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(n))
    items = [(n, words(rng.randrange(2, 30))) for n in range(14)] + [(50, None), (51, ""), (52, "one"), (53, "What is the " + words(6)), (54, "What is the " + words(7)), (55, "What is the " + words(5))]
    docs = list(ODD)
    for n in range(40):
        body = list(rng.choice([t for _, t in items if t]))
        for _ in range(rng.randrange(0, len(body) // 8 + 2)):
            k = rng.randrange(len(body))
            body[k : k + rng.randrange(2)] = rng.choice(["", "q", "zz"])
        docs.append((n, f"{words(9)} {''.join(body)} {words(9)}"))
    where = landed(spark, tmp_path, docs, benchmark=(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): r.edits for r in of("op1_decontaminate", spark, where)}

    def fewest(a, b):
        before = np.zeros(len(b) + 1, int)
        for i, x in enumerate(a):
            now = np.minimum(before[1:] + 1, before[:-1] + np.array([x != y for y in b], int))
            out = np.concatenate(([i + 1], now))
            before = np.minimum.accumulate(out - np.arange(len(out))) + np.arange(len(out))
        return int(before.min())

    for i, text in docs:
        body = decontaminate.normal(text)
        if len(body) > 5000:
            assert not any(d == i for d, _ in got)
            continue
        if i == 9004:  # three rows
            assert [item for d, item in got if d == i] == [52]
            continue
        for item, t in items:
            t = decontaminate.normal(t)
            if t and i is not None:
                leaks = body == t if len(t) < 8 else fewest(t, body) <= len(t) // 10
                assert ((i, item) in got) == leaks, (i, item)
                if leaks:
                    assert got[i, item] == (0 if len(t) < 8 else fewest(t, body))


def test_op2(spark, tmp_path):
    names = list(licenses.TEMPLATES)
    docs = [*ODD, *((n, f"some words before é {licenses.TEMPLATES[name]} and after") for n, name in enumerate(names))]
    where = landed(spark, tmp_path, docs)
    got = collections.defaultdict(dict)
    for r in of("op2_licenses", spark, where):
        got[r.doc_id][r.license] = r
    for n, name in enumerate(names):
        r, text = got[n][name], docs[len(ODD) + n][1]
        assert r.containment == 1.0 and text[r.start : r.end] in licenses.TEMPLATES[name] and len(text[r.start : r.end]) > 0.9 * len(licenses.TEMPLATES[name]) - 2
    assert set(got) == set(range(len(names)))
    rows = spark.read.parquet(f"{where}/documents.parquet")
    assert licenses.scan(rows, {}).count() == 0 and licenses.scan(rows, {"whole": "no id here"}).count() == 1
    assert max(c["bands"] for c in licenses.Templates(licenses.TEMPLATES, least=0.2).classes.values()) > 21


def test_ftrl_and_temperature_against_plain_python():
    rng = random.Random(9)
    examples = []
    for _ in range(60):
        y = rng.randrange(3)
        slots = sorted({rng.randrange(8) * 3 + (y if rng.random() < 0.8 else rng.randrange(3)) for _ in range(5)})
        examples.append((np.array(slots), np.array([rng.random() + 0.2 for _ in slots]), y))
    got, bias = language.ftrl(examples, 3, 2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        l1, l2 = (0.0, 0.0) if k[0] < 0 else (language.L1, language.L2)
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((language.BETA + math.sqrt(n[k])) / language.ALPHA + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for e in order.permutation(len(examples)):
            slots, values, y = examples[e]
            row = [(-1, 1.0), *zip(slots.tolist(), values.tolist())]
            w = {(s, c): weight((s, c)) for s, _ in row for c in range(3)}
            scores = [sum(v * w[s, c] for s, v in row) for c in range(3)]
            total = sum(math.exp(x - max(scores)) for x in scores)
            for c in range(3):
                miss = math.exp(scores[c] - max(scores)) / total - (c == y)
                for s, v in row:
                    g = v * miss
                    z[s, c] += g - (math.sqrt(n[s, c] + g * g) - math.sqrt(n[s, c])) / language.ALPHA * w[s, c]
                    n[s, c] += g * g
    assert np.allclose(got[:24], [[weight((s, c)) for c in range(3)] for s in range(24)], atol=1e-9) and np.allclose(bias, [weight((-1, c)) for c in range(3)], atol=1e-9)
    logits = np.array([v @ got[s] + bias for s, v, _ in examples]) * 3
    y = np.array([c for _, _, c in examples])
    loss = lambda t: -np.log(language.softmax(logits / t)[np.arange(len(y)), y]).mean()
    assert loss(language.temperature(logits, y)) <= min(loss(math.exp(k / 20)) for k in range(-50, 70)) + 1e-6


def test_op3(spark, tmp_path):
    letters = {0: "abcdef", 1: "uvwxyz"}
    rng = random.Random(1)
    docs = [*ODD, *((n, " ".join("".join(rng.choice(letters[n % 2]) for _ in range(5)) for _ in range(30))) for n in range(120))]
    where = landed(spark, tmp_path, docs)
    got = of("op3_language", spark, where)
    assert len(got) == len(docs) and all(isinstance(r.held_out, bool) and r.held_out == (held(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == ("en" if r.doc_id % 2 == 0 else "xx") for r in got if r.doc_id is not None and r.doc_id < 9000)
    assert {r.lang_pred for r in got if r.doc_id in (9001, 9002, 9003)} == {"und"}
    seen = collections.Counter()  # document frequencies, by hand
    texts = [t for _, t in docs if t is not None]
    for t in texts:
        seen.update(set(language.slots_of(t).tolist()))
    counts, n = language.document_frequencies(spark.read.parquet(f"{where}/documents.parquet").where("text is not null"))
    assert n == len(texts) and {k: int(counts[k]) for k in np.flatnonzero(counts)} == dict(seen)


def test_op5(spark, tmp_path):
    where = landed(spark, tmp_path, [*ODD, (1, "a" * 576), (2, "b" * 577)])
    texts = collections.defaultdict(set)
    for i, t in [*ODD, (1, "a" * 576), (2, "b" * 577)]:
        texts[i].add((t or "").encode())
    got = of("op5_media", spark, where)
    features = collections.defaultdict(set)
    for r in got:
        raw, = [t for t in texts[r.doc_id] if hashlib.sha256(media_gif.padded(t)).hexdigest() == r.payload_sha256]
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        media = media_gif.gif_of(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(payload), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        grey = [sum(b // 16 == k for b in payload) for k in range(16)] if len(payload) < 3000 else None
        assert grey is None or r.feature.endswith("grey=" + ".".join(map(str, grey)))
        features[raw].add(r.feature)
    assert len(got) == len(ODD) + 2 and all(len(f) == 1 for f in features.values())


def test_scale_of_scores_is_the_root_under_the_background():
    weights, shares = {"a": 1.0, "b": 3.0}, {"a": 0.1, "b": 0.001}
    rate = toxicity.decay(weights, -0.3, shares)
    assert math.isclose(0.899 * math.exp(-0.3 * rate) + 0.1 * math.exp(rate) + 0.001 * math.exp(3 * rate), 1.0, rel_tol=1e-9)


def test_op7(spark, tmp_path):
    rng = random.Random(7)
    plain, bad = [f"w{k}" for k in range(60)], ["vile", "foul", "rotten", "nasty"]
    from_words = {"w" + str(k): "".join("abcdefghij"[int(d)] for d in str(100 + k)) for k in range(60)}
    docs, labels = list(ODD), [(9004, 0), (9006, 1), (None, 1), (9005, None)]
    for n in range(300):
        words = [from_words[rng.choice(plain)] for _ in range(40)]
        toxic = n % 4 == 0
        if toxic:
            words[10:10] = [rng.choice(bad) for _ in range(8)]
        docs.append((n, " ".join(words)))
        labels.append((n, int(toxic)))
    where = landed(spark, tmp_path, docs, labels=(labels, "doc_id bigint, toxic int"))
    got = of("op7_toxicity", spark, where)
    assert len(got) == len(docs) and all(isinstance(r.held_out, bool) and r.held_out == (held(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 9000)
    # token scores by hand: log-odds between the classes with the prior of both together, over different texts
    known = {(t or "", max((y or 0) for j, y in labels if j == i)) for i, t in docs if i is not None and held(i, 3) != 1 and any(j == i and y is not None for j, y in labels)}
    n = collections.Counter((w, y) for t, y in known for w in set(re.findall(r"[^\W\d_]+", t.lower())))
    totals = [sum(v for (_, k), v in n.items() if k == y) for y in (0, 1)]
    frame = toxicity.labelled(spark.read.parquet(f"{where}/documents.parquet").where("doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1"), spark.read.parquet(f"{where}/labels.parquet"))
    weights, _, shares = toxicity.token_scores(toxicity.token_counts(frame))
    assert set(weights) == set(bad)
    everything = 0.01 * sum(totals) + 0.5
    for w in bad:
        prior = 0.01 * (n[w, 0] + n[w, 1]) + 0.5
        a, b = n[w, 1] + prior, n[w, 0] + prior
        assert math.isclose(weights[w], math.log(a / (totals[1] + everything - a)) - math.log(b / (totals[0] + everything - b)), rel_tol=1e-9) and math.isclose(shares[w], b / (totals[0] + everything), rel_tol=1e-9)


def test_op9(spark, tmp_path):
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><article><h1>Of &amp; on</h1><p>A sentence that is  plain.<br>And more.</p><p><noscript>Kept too.</noscript> <svg><text>Drawn.</text></svg></p></article><footer>All rights reserved.</footer></body></html>'
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "long " * 50000)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2)).write.parquet(str(tmp_path / "pages.parquet"))
    got = of("op9_html", spark, str(tmp_path))
    assert sorted((str(r.page_id), r.text[:60]) for r in got if r.page_id != 3) == sorted([("1", "Of & on\nA sentence that is plain. And more.\nKept too. Drawn."[:60])] * 2 + [("None", ""), ("2", "")])
    assert all(r.n_chars == len(r.text) for r in got)
    none = spark.read.parquet(str(tmp_path / "pages.parquet")).limit(0)
    assert html_text.extract(none, html_text.train(none)).count() == 0


@pytest.mark.parametrize("kind", ["</b>", "<b>", "<p>", "</p>", "<div>", "<i></b>", "<td>", "<li>x"])
def test_page_of_many_tags_takes_linear_time(kind):
    import time

    took = []
    for n in (2000, 16000):
        began = time.perf_counter()
        html_text.parse("<span>" * n + kind * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * 5 * max(took[0], 0.01)


def test_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    leak, copy = words(12), words(40)
    docs = [*ODD, (1, copy), (2, copy), (None, copy), (3, f"{words(20)} {leak} {words(20)}"), (4, f"{words(20)} token = abcdefghijklmnop {words(20)}"), (5, words(50)), (5, words(50))]
    where = landed(spark, tmp_path, docs, benchmark=([(1, leak), (2, None)], "item_id bigint, text string"))
    rows = spark.read.parquet(f"{where}/documents.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.materialise(stage(spark, rows, where), f"odd-{name}")
        outs[name] = rows
        assert name == "packing" or rows.columns == spark.read.parquet(f"{where}/documents.parquet").columns
    bodies = lambda name: collections.Counter((r.doc_id, r.text) for r in outs[name].select("doc_id", "text").collect())
    lettered = [(i, t) for i, t in docs if t and any(map(str.isalpha, t))]
    first = bodies("language")
    assert set(first) <= set(lettered)
    groups = collections.defaultdict(list)
    for i, t in first.elements():
        groups[simhash.simhash(t)].append((i is None, i or 0, t))
    kept = bodies("near_dedup")
    assert kept == collections.Counter((None if none else i, t) for g in groups.values() for none, i, t in [min(g)]) or len(kept) <= len(groups)
    assert sum(t == copy for _, t in kept.elements()) == 1 and (1, copy) in kept
    clean = bodies("decontaminate")
    assert clean == collections.Counter({k: n for k, n in kept.items() if k[0] != 3})
    assert all(secrets.MARK in t for i, t in bodies("secrets") if i == 4) and sum(bodies("secrets").values()) == sum(clean.values())
    assert outs["packing"].where("start = 0").count() == sum(clean.values())
