"""Personal data: base spans against the plain patterns, EM against loops over single candidates, added spans on written texts."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from poolstrata.llm import pii as P

DOCS = "doc_id bigint, text string, spans string, id int, n_email int"
# the contract's patterns and checks, as they are written there
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= sum(c.isdigit() for c in s) <= 19 and checksum([int(c) for c in s if c.isdigit()])),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
}


def checksum(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base(text):
    return [(kind, m.start(), m.end()) for kind, (pattern, check) in PLAIN.items() for m in re.finditer(pattern, text) if check(m[0])]


TEXTS = [
    "mail a.b@c.de, now", "x@y @z.q a@b.c@d.e.f %+-@--.--", "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255 0000.1.2.3 1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111", "call +1 (743) 555-3824. +49 30 1234567 +1 +2 +3 ++12345678901 +1.1.",
    None, "", "ÀÉ 🙂 é@mail.example.org ü+44 20 7946 0958", "12345678901234567890 " + "9" * 25, "a" * 500 + "@b.c" * 3, "+" * 30 + "1" * 12, "4111  1111 1111 1111", "5500 0000 0000 0004-+1 555 0100 111@1.1.1.1.com",
]


def plain(row):
    return [(s["kind"], s["start"], s["end"]) for s in row["spans"] if s["base"]]


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_base_spans(text):
    assert sorted(x[:3] for x in P.spans_of(text) if x[3]) == sorted(base(text))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="019@.+-() aZé%_:", max_size=60))
def test_base_spans_of_any_text(text):
    assert sorted(x[:3] for x in P.spans_of(text) if x[3]) == sorted(base(text))


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@", "a@", "+", "+1", "1 ", "a.", ":", "a:", " at a dot ", "A", "AB12", "Mr ", "(", "1-", "@a."])
def test_long_texts_take_linear_time(unit):
    began = time.process_time()
    P.candidates_in(unit * (400_000 // len(unit)))
    assert time.process_time() - began < 20


def test_query_columns(spark, monkeypatch):
    rows = [(k % 5 if k else None, t, "x", 1, 2) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(P, "table", lambda *_: docs)
    got = sorted((r["doc_id"] or -1, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in P.op12_pii(spark, "").collect())
    want = []
    for key, text, *_ in rows:
        found = base(text or "")
        n = [sum(k == kind for k, *_ in found) for kind in P.BASE]
        want.append((key or -1, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table(spark):
    assert P.find(spark.createDataFrame([], DOCS)).collect() == []


def loop_em(rows, rounds):
    """One candidate at a time: (kind, votes) with PRIOR's pseudo-votes."""
    truth = [1 / (1 + math.exp(-sum(v))) for _, v in rows]
    for _ in range(rounds):
        share, seen = {}, {}
        for kind in {k for k, _ in rows}:
            own = [t for (k, _), t in zip(rows, truth) if k == kind]
            share[kind] = (sum(own) + 1) / (len(own) + 2)
            for j in range(6):
                for y in (0, 1):
                    n = [P.PRIOR[y][v + 1] + sum((t if y else 1 - t) for (k, votes), t in zip(rows, truth) if k == kind and votes[j] == v) for v in (-1, 0, 1)]
                    seen[kind, j, y] = [x / sum(n) for x in n]
        truth = []
        for kind, votes in rows:
            yes, no = share[kind], 1 - share[kind]
            for j, v in enumerate(votes):
                yes, no = yes * seen[kind, j, 1][v + 1], no * seen[kind, j, 0][v + 1]
            truth.append(yes / (yes + no))
    return truth


def test_expectation_maximisation():
    draw = random.Random(3)
    rows = [(draw.randrange(2), tuple(draw.choice((-1, 0, 1)) for _ in range(6))) for _ in range(60)]
    rows += rows[:20]
    patterns = sorted(set(rows))
    kind, votes = np.array([k for k, _ in patterns]), np.array([v for _, v in patterns])
    found = P.maximise(kind, votes, np.array([rows.count(p) for p in patterns], float), rounds=12)
    want = dict(zip(rows, loop_em(rows, 12)))
    assert np.allclose(found.probability(kind, votes), [want[p] for p in patterns])


def test_reliabilities_tell_a_good_labeler_from_a_bad_one():
    draw = random.Random(5)
    rows = []
    for _ in range(4000):
        truth = draw.random() < 0.4
        vote = lambda right: (1 if truth else -1) if draw.random() < right else (-1 if truth else 1)  # noqa: B023, E731
        rows.append((2, (vote(0.95), vote(0.9), vote(0.85), vote(0.55), vote(0.9), 0)))
    patterns = sorted(set(rows))
    found = P.maximise(np.array([k for k, _ in patterns]), np.array([v for _, v in patterns]), np.array([rows.count(p) for p in patterns], float))
    of = found.of_labelers()
    assert [round(of["card", name], 1) for name in P.LABELERS[:5]] == pytest.approx([0.95, 0.9, 0.85, 0.55, 0.9], abs=0.06)


def test_added_kinds(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghijklmnoprstuv") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, want, key = [], {}, 0
    for _ in range(60):
        for kind, value, lead in (
            ("email_text", f"{word()} at {word()} dot org", "write an email to"), ("phone_local", f"({draw.randrange(200, 999)}) {draw.randrange(200, 999)}-{draw.randrange(1000, 9999)}", "call my phone"),
            ("ssn", f"{draw.randrange(100, 600)}-{draw.randrange(10, 99)}-{draw.randrange(1000, 9999)}", "social security"), ("iban", "DE89 3704 0044 0532 0130 00", "bank account"), ("ip6", "2001:db8:0:0:8:800:200c:417a", "server address"),
        ):
            text = f"{prose(8)} {lead} "
            want[key] = (kind, len(text), len(text) + len(value))
            rows.append((key, text + value + " " + prose(5), "", 0, 0))
            key += 1
        for decoy in ("version 12:30:45", f"order {draw.randrange(100, 199)}-{draw.randrange(100, 199)}-1234", f"serial part {draw.choice(['000', '666', '987'])}-00-0000", "model AB12 XXXX YYYY ZZZZ", f"{word()} at home"):
            rows.append((key, f"{prose(9)} {decoy} {prose(6)}", "", 0, 0))
            key += 1
    rows += [(key, "both 4111 1111 1111 1111 stay", "", 0, 0)]
    got = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in P.find(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    hit = sum(got[k] == [v] for k, v in want.items())
    clean = [k for k, *_ in rows if k not in want and k != key]
    assert hit >= 0.95 * len(want)
    assert sum(bool(got[k]) for k in clean) <= 0.02 * len(clean)
    assert got[key] == [("card", 5, 24)]


def test_added_spans_overlap_nothing():
    model = P.Model(P.maximise(np.zeros(0, int), np.zeros((0, 6), int), np.zeros(0)), np.full(P.SLOTS, 3.0), ())
    make = lambda kind, start, end, base, features: {"kind": P.KINDS.index(kind), "start": start, "end": end, "base": base, "features": features}
    found = [make("card", 0, 16, True, [1]), make("iban", 10, 30, False, [1]), make("ssn", 40, 50, False, [1]), make("phone_local", 45, 60, False, [1, 2]), make("phone", 70, 80, False, [1, 2, 3])]
    assert [(r["kind"], r["start"]) for r in P.chosen(found, model)] == [("card", 0), ("phone_local", 45)]
