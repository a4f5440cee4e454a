"""Cross-tokenizer alignment against loops over all pairs of tokens, and its perfect hash against dictionaries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from poolstrata.llm import alignment as A
from poolstrata.llm.common import local_path, shared_dir

DOCS = "doc_id bigint, text string, id string, a int, n_a string"
TEXTS = [
    "The quick brown fox.", "The quick brown fox.", None, "", " ", "two  spaces and a\ttab\nline", "<|endoftext|> is plain <s> text </s> <unk>", "▁ is a space here", "naïve café – ünï 🙂 漢字かな", "x" * 5000, "ab " * 3000, " nbsp em",
    "tokenization of unbelievable antidisestablishmentarianism", "0" * 30 + " 3.14159", "é", "�​", "<0x41> byte",
]
ROWS = [(None if k == 3 else k % 11, t, "x", 1, "y") for k, t in enumerate(TEXTS)]


def tokens(text, v, tokenizer):
    if not text:
        return [], []
    raw = (" " + text).encode()
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, v.by_piece(text)
    return (a, b) if b"".join(v.a_bytes[i] for i in a) == raw == b"".join(v.b_bytes[i] for i in b) else ([], [])


def spans(ids, names):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(names[i])))
        at += len(names[i])
    return out


def brute(texts):
    v = A.vocabularies(A.default_files())
    tokenizer = Tokenizer.from_file(A.default_files().a)
    tokenizer.encode_special_tokens = True
    docs, total = [], Counter()
    for text in texts:
        a, b = tokens(text, v, tokenizer)
        sa, sb = spans(a, v.a_bytes), spans(b, v.b_bytes)
        first, links = 0, []
        for i, (x, y) in enumerate(sa):  # all overlaps; what ends before this token overlaps no later one
            while first < len(sb) and sb[first][1] <= x:
                first += 1
            j = first
            while j < len(sb) and sb[j][0] < y:
                links.append((i, j))
                j += 1
        total.update((a[i], b[j]) for i, j in links)
        groups, i, j = [], 0, 0
        common = {y for _, y in sa} & {y for _, y in sb}
        for end in sorted(common):
            m = next(k for k in range(i, len(sa)) if sa[k][1] == end) + 1
            n = next(k for k in range(j, len(sb)) if sb[k][1] == end) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        docs.append((a, b, groups, links))
    best = Counter()
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    out = []
    for a, b, groups, links in docs:
        n = [total[a[i], b[j]] for i, j in links]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), sum(c == best[b[j]] for c, (_, j) in zip(n, links)), sum(n), digest))
    return out


def plain(rows):
    return sorted(((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows), key=repr)


def expected():
    return sorted(((k, *row) for (k, *_), row in zip(ROWS, brute(TEXTS))), key=repr)


def test_like_loops(spark):
    assert plain(A.align(spark.createDataFrame(ROWS, DOCS).repartition(3)).collect()) == expected()


def test_small_chunks_many_shards_deep_tree(spark):
    """Sizes are no limits: what is held and dealt in many pieces gives the same."""
    got = A.align(spark.createDataFrame(ROWS, DOCS).repartition(7), sizes=A.Sizes(chunk=64, held=50, shard=40, fan=2))
    assert plain(got.collect()) == expected()


def test_some_texts_have_no_tokens():
    found = brute(TEXTS)
    assert [n for n, t in enumerate(TEXTS) if not found[n][0]] == [2, 3, 7] or all(not found[n][0] for n in (2, 3, 7))
    assert found[0][0] and found[9][0]


def test_empty_table(spark):
    got = A.align(spark.createDataFrame([], DOCS))
    assert got.columns == ["id", *(n for n, _ in A.RESULT)] and got.collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 31, n, replace=False).astype(np.int64) if n else np.zeros(0, np.int64)
    found = A.PerfectHash.from_bytes(memoryview(A.PerfectHash.of(keys).to_bytes()))
    assert sorted(found.find(keys).tolist()) == list(range(n))
    others = np.setdiff1d(np.arange(5000), keys)
    assert (found.find(others) == -1).all()
    assert found.bits.nbytes * 8 <= 4 * n + 64 * 40


def test_ranks_give_the_tokenizers_ids():
    v = A.vocabularies(A.default_files())
    for text in filter(None, TEXTS):
        assert v.by_rank(" " + text) == v.by_tokenizer(" " + text, add_special_tokens=False).ids


def test_intermediates_go(spark):
    shared = local_path(shared_dir(spark))
    before = {p.name for p in shared.iterdir()} if shared.exists() else set()
    A.align(spark.createDataFrame(ROWS[:4], DOCS)).collect()
    assert [name.split("-")[0] for name in {p.name for p in shared.iterdir()} - before] == ["aligned"]
