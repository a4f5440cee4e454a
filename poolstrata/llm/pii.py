"""Personal data by weak supervision.

``candidates``    one Arrow map over whole texts: every span that a kind's pattern takes, strict or loose, with the votes of six labelers
                  and hashed features of its shape and surroundings. Of a text only these go on.
``reliabilities`` the votes' patterns are counted in Spark over all candidates, and expectation-maximisation (Dawid and Skene, 1979)
                  estimates each kind's share of true spans and how often each labeler says yes, nothing or no of true and of false ones.
``fit``           a logistic regression on the features, with the labelers' combined probabilities as soft labels, on at most ``FIT`` different
                  candidates (those of least hash; where candidates are many, of the share of them that has the least hashes): the final span classifier.
``decide``        base spans stay, whatever the classifier says. Candidates of the added kinds stay from ``LEAST`` probability on, the likeliest
                  first, where they overlap nothing that stays.

Kinds. email, ip, card and phone have base spans: leftmost, non-overlapping matches of the pattern that pass the kind's check; those
that fail it are candidates that only teach. email_text ("name at host dot org"), phone_local, ip6, iban, ssn and name are added.
Labelers. Two of patterns (the span's shape; its characters' arithmetic), one of its borders, one of gazetteers (top-level domains,
calling codes, card issuers, countries, given names, reserved addresses), two of context (words that announce the kind; words
that announce another number). A labeler that has nothing to say of a kind abstains.

A text of n characters takes time about in proportion to n, whatever it holds: no pattern looks back over a run again.

Defined cases: a null text is empty; a text without candidates has no spans; a table without candidates has a model that adds none;
repeated rows each get a row and a null key is a key; of candidates as likely as each other the earlier stays. Only key and text are
read, so other columns can't clash. Offsets are code points.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, delete, materialise, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_text", "phone_local", "ip6", "iban", "ssn", "name")
LABELERS = ("shape", "check", "border", "gazetteer", "context", "other")
#: Bound of the sample that the classifier is fitted on, slots of its features, and what an added span's probability must reach.
FIT, SLOTS, LEAST = 20_000, 1 << 12, 0.8
BEFORE, AFTER = 48, 24  # code points of context

# fixed values: the base patterns' tails; what leads up to an email's at sign is read backwards from it
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can't begin within a run of digits: from its start it would match too
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# the added kinds
AT_HOST = re.compile(r"(?:\s?[(\[{]at[)\]}]\s?| at )[A-Za-z0-9-]{1,63}(?:(?:\s?[(\[{]dot[)\]}]\s?| dot )[A-Za-z0-9-]{2,63}){1,4}")
PHONE_LOCAL = re.compile(r"(?<![\w+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)")
IP6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Señor Señora".split()
GIVEN = frozenset("James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Thomas Susan Anna Peter Hans Klaus Ursula Monika Jean Marie Pierre Sophie Nathalie José Carmen Antonio María Juan Ana Carlos Laura".split())
NAME = re.compile(rf"\b(?=[A-ZÀ-Þ])(?:(?:{'|'.join(TITLES)})\.? |(?=(?:{'|'.join(sorted(GIVEN))})\b))[A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+){{0,2}}")
# gazetteers
DOMAINS = frozenset("com org net edu gov mil int info biz io co eu de fr es it nl uk us ca au at ch be se no dk fi pl pt ru jp cn in br mx ar".split())
CALLING = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 381 385 386 420 421 852 886 966 971 972".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[68]|6011|64[4-9]|65|35|62")
IBAN_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split())
# context
ANNOUNCE = {
    "email": "mail e-mail email contact write schreiben courriel correo contacto kontakt address".split(),
    "ip": "ip host server address login client addr from visitor adresse".split(),
    "card": "card visa mastercard amex credit debit payment karte carte tarjeta paid".split(),
    "phone": "phone tel call mobile cell fax telephone whatsapp telefon téléphone teléfono móvil handy".split(),
    "iban": "iban account bank konto compte cuenta transfer".split(),
    "ssn": "ssn social security".split(),
    "name": "name dear signed regards by patient customer employee".split(),
}
ANNOUNCE |= {"email_text": ANNOUNCE["email"], "phone_local": ANNOUNCE["phone"], "ip6": ANNOUNCE["ip"]}
ANNOUNCE = {kind: frozenset(words) for kind, words in ANNOUNCE.items()}
OTHER = frozenset("version v ver release section chapter isbn issn doi order invoice sha md5 commit build token hash id serial part page model figure table".split())
WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?|\d+")

Span = tuple[str, int, int, bool]  # kind, start, end, base


# ---- spans -----------------------------------------------------------------------------------------------------------


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    twice = (sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def octets(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in text.split("."))


def mod97(text: str) -> bool:
    packed = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def ip6(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def social(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


#: What makes a match of a kind's pattern a span.
CHECKS: dict[str, Callable[[str], bool]] = {
    "email": lambda s: ".." not in s and not s.startswith(".") and ".@" not in s,
    "ip": octets,
    "card": lambda s: 13 <= len(digits_of(s)) <= 19 and luhn(digits_of(s)),
    "phone": lambda s: 9 <= len(digits_of(s)) <= 15,
    "email_text": lambda s: True,
    "phone_local": lambda s: digits_of(s)[0] > "1" and digits_of(s)[3] > "1",
    "ip6": ip6,
    "iban": mod97,
    "ssn": social,
}
SHAPES = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]+(?:[ .-][0-9]+)*"),
    "email_text": re.compile(r"[A-Za-z0-9].*[A-Za-z]{2,24}", re.DOTALL),
    "phone_local": re.compile(r"\([0-9]{3}\) [0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}"),
    "ip6": re.compile(r"[0-9A-Fa-f:]*[A-Fa-f][0-9A-Fa-f:]*"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]+|(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?)"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}


def led(text: str, matches: Iterator[re.Match], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Start and end of what a match of the tail and the characters of ``LOCAL`` before it make; matches that none leads up to are none."""
    after = 0
    for m in matches:
        start, floor = m.start(), after if most is None else max(after, m.start() - most)
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            after = m.end()


def spans_of(text: str) -> Iterator[Span]:
    """Every kind's candidates; base ones are marked. Card numbers and phones of other lengths aren't candidates."""
    if "@" in text:
        for start, end in led(text, DOMAIN.finditer(text)):
            yield "email", start, end, True
    for m in IP.finditer(text):
        yield "ip", *m.span(), octets(m[0])
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits_of(m[0])) <= 19:
            yield "card", *m.span(), luhn(digits_of(m[0]))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 7 <= len(digits_of(m[0])) <= 17:
                yield "phone", *m.span(), CHECKS["phone"](m[0])
    if "dot" in text:
        for start, end in led(text, AT_HOST.finditer(text), 64):
            yield "email_text", start, end, False
    for kind, pattern in (("phone_local", PHONE_LOCAL), ("ssn", SSN), ("iban", IBAN), ("name", NAME)):
        for m in pattern.finditer(text):
            yield kind, *m.span(), False
    if ":" in text:
        for m in IP6.finditer(text):
            if m.end() - m.start() >= 6:
                yield "ip6", *m.span(), False


# ---- labelers and features -------------------------------------------------------------------------------------------


def gazetteer(kind: str, span: str) -> int:
    vote = lambda yes: 1 if yes else -1
    if kind in ("email", "email_text"):
        return vote(re.split(r"[^A-Za-z0-9-]+", span.strip(")]}"))[-1].lower() in DOMAINS)
    if kind == "ip":
        parts = [int(x) if len(x) < 9 else 999 for x in span.split(".")]
        return vote(0 < parts[0] < 224 and parts[0] != 127)
    if kind == "card":
        return vote(ISSUERS.match(digits_of(span)))
    if kind == "phone":
        return vote(digits_of(span).startswith(CALLING))
    if kind == "iban":
        return vote(span[:2] in IBAN_COUNTRIES)
    if kind == "name":
        return 1 if any(word in GIVEN for word in span.split()) else 0
    return 0


def votes_of(kind: str, span: str, before: str, after: str, words: list[str], later: list[str]) -> tuple[int, ...]:
    """1, 0 or -1 of each of ``LABELERS``."""
    shape = 1 if kind not in SHAPES or SHAPES[kind].fullmatch(span) else -1
    check = 0 if kind not in CHECKS else 1 if CHECKS[kind](span) else -1
    border = -1 if (before and (before[-1].isalnum() or before[-1] in "_./")) or (after and (after[0].isalnum() or after[0] in "_/@")) else 1
    near = {*words[-5:], *later[:3]}
    return shape, check, border, gazetteer(kind, span), 1 if near & ANNOUNCE[kind] else 0, -1 if {*words[-2:]} & OTHER else 0


def shape_of(span: str) -> str:
    """Letters, digits and other characters, each run of a class as one sign."""
    signs = ["a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c for c in span[:80]]
    return "".join(c for k, c in enumerate(signs) if k == 0 or c != signs[k - 1])


def features_of(kind: str, span: str, before: str, after: str, words: list[str], later: list[str], votes: tuple[int, ...]) -> list[int]:
    """Slots of a candidate's features, in order."""
    found = [
        "", f"shape {shape_of(span)}", f"size {min(len(span), 40) // 4}", f"digits {min(len(digits_of(span)), 24)}", f"left {sign(before[-1:])}", f"right {sign(after[:1])}",
        *(f"before {w}" for w in words[-3:]), *(f"after {w}" for w in later[:2]), *(f"{name} {v}" for name, v in zip(LABELERS, votes)),
    ]
    return sorted({xxhash.xxh64_intdigest(f"{kind} {x}".encode("utf-8", "surrogatepass"), 12) % SLOTS for x in found})


def sign(c: str) -> str:
    return "edge" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c


def code_of(votes: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(votes))


def votes_in(code: int) -> list[int]:
    return [code // 3**k % 3 - 1 for k in range(len(LABELERS))]


CANDIDATES = "array<struct<kind: int, start: int, end: int, base: boolean, votes: int, features: array<int>>>"
ARROW_CANDIDATES = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))


def candidates_in(text: str) -> list[dict]:
    out = []
    for kind, start, end, base in spans_of(text):
        span, before, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
        words, later = WORDS.findall(before.lower()), WORDS.findall(after.lower())
        votes = votes_of(kind, span, before, after, words, later)
        out.append({"kind": KINDS.index(kind), "start": start, "end": end, "base": base, "votes": code_of(votes), "features": features_of(kind, span, before, after, words, later, votes)})
    return out


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id and candidates of every row."""
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("candidates", T._parse_datatype_string(CANDIDATES))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = pa.schema([("id", batch.schema.field(0).type), ("candidates", ARROW_CANDIDATES)])
            found = ((k.as_py(), candidates_in(body.as_py() or "")) for k, body in zip(*batch.columns))
            yield from batches_of((([k, c], 16 + 160 * len(c)) for k, c in found), arrow)

    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("body")).mapInArrow(run, schema)


# ---- model -----------------------------------------------------------------------------------------------------------

#: Dirichlet prior of a labeler's votes (no, nothing, yes) on false and on true spans: better than chance until the data say otherwise.
PRIOR = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])


@dataclass
class Reliabilities:
    """share[kind]: true candidates of a kind; votes[kind, labeler, truth, vote + 1]: how often a labeler votes so."""

    share: np.ndarray
    votes: np.ndarray

    def probability(self, kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """That a candidate is true, by the votes of all labelers: (n,) from kinds (n,) and votes (n, labelers)."""
        each = np.log(self.votes[kind[:, None], np.arange(len(LABELERS))[None, :], :, votes + 1]).sum(1)  # (n, truth)
        odds = each[:, 1] - each[:, 0] + np.log(self.share[kind]) - np.log(1 - self.share[kind])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def of_labelers(self) -> dict[tuple[str, str], float]:
        """Of each kind and labeler: the share of right votes among its votes, each truth weighing the same."""
        right, wrong = self.votes[:, :, 0, 0] + self.votes[:, :, 1, 2], self.votes[:, :, 0, 2] + self.votes[:, :, 1, 0]
        return {(kind, labeler): float((right / (right + wrong))[k, j]) for k, kind in enumerate(KINDS) for j, labeler in enumerate(LABELERS)}


def maximise(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> Reliabilities:
    """Expectation-maximisation over counted patterns: kinds (p,), votes (p, labelers), how many candidates have each (p,)."""
    truth = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    for _ in range(rounds):
        share = np.array([(n * truth)[kind == k].sum() + 1 for k in range(len(KINDS))]) / np.array([n[kind == k].sum() + 2 for k in range(len(KINDS))])
        seen = np.tile(PRIOR, (len(KINDS), len(LABELERS), 1, 1))
        for j in range(len(LABELERS)):
            np.add.at(seen, (kind, j, 1, votes[:, j] + 1), n * truth)
            np.add.at(seen, (kind, j, 0, votes[:, j] + 1), n * (1 - truth))
        found = Reliabilities(share, seen / seen.sum(-1, keepdims=True))
        before, truth = truth, found.probability(kind, votes)
        if not len(truth) or np.abs(truth - before).max() < 1e-9:
            break
    return found


@dataclass
class Model:
    reliabilities: Reliabilities
    weights: np.ndarray
    added: tuple[str, ...]  # kinds that the fitted sample has

    def probability(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features].sum(), -50, 50))))


def logistic(features: list[list[int]], target: np.ndarray, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on slots that are there or not, by adaptive gradient steps over all examples."""
    weights, grown = np.zeros(SLOTS), np.full(SLOTS, 1e-8)
    if not features:
        return weights
    at = np.repeat(np.arange(len(features)), [len(x) for x in features])
    slots = np.concatenate([np.asarray(x, np.int64) for x in features])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, weights[slots], len(features)), -50, 50)))
        gradient = np.bincount(slots, (p - target)[at], SLOTS) / len(features) + ridge * weights
        grown += gradient * gradient
        weights -= rate * gradient / np.sqrt(grown)
    return weights


def train(found: DataFrame, fit: int = FIT) -> Model:
    """A model from rows of ``candidates``, already in the shared folder. Votes are counted over all of them."""
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    counts = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()  # 3^6 patterns of a kind at most
    kind, votes = np.array([r["kind"] for r in counts], np.int64), np.array([votes_in(r["votes"]) for r in counts], np.int64).reshape(-1, len(LABELERS))
    reliable = maximise(kind, votes, np.array([r["n"] for r in counts], float))
    # a share of the different candidates by hash, so that no more than a few times ``fit`` compete for the sample, whatever their number
    total, draw = max(1, sum(r["n"] for r in counts)), F.xxhash64("kind", "votes", "features")
    share = each.where(F.pmod(draw, F.lit(1 << 30)) < F.lit(int(min(1.0, 4 * fit / total) * (1 << 30))))
    drawn = share.distinct().orderBy(F.pmod(draw, F.lit(1 << 30)), "kind", "votes", "features").limit(fit).collect()
    target = reliable.probability(np.array([r["kind"] for r in drawn], np.int64), np.array([votes_in(r["votes"]) for r in drawn], np.int64).reshape(-1, len(LABELERS)))
    return Model(reliable, logistic([r["features"] for r in drawn], target), tuple(sorted({KINDS[r["kind"]] for r in drawn})))


FOUND = "array<struct<kind: string, start: int, end: int, base: boolean, probability: double>>"
ARROW_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("probability", pa.float64())]))


def chosen(found: list[dict], model: Model, least: float = LEAST) -> list[dict]:
    """Spans that stay of a text's candidates, by kind as listed, then by start."""
    rows = [{"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "base": c["base"], "probability": model.probability(c["features"])} for c in found]
    kept = [r for r in rows if r["base"]]
    extra = sorted((r for r in rows if r["kind"] not in BASE and r["probability"] >= least), key=lambda r: (-r["probability"], r["start"], r["end"]))
    if extra:
        taken = np.zeros(max(r["end"] for r in rows) + 1, bool)
        for r in kept:
            taken[r["start"] : r["end"]] = True
        for r in extra:
            if not taken[r["start"] : r["end"]].any():
                taken[r["start"] : r["end"]] = True
                kept.append(r)
    return sorted(kept, key=lambda r: (KINDS.index(r["kind"]), r["start"]))


def decide(found: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """id and spans (kind, start, end, base, probability) for every row of ``candidates``."""
    sent = found.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers
    schema = T.StructType([found.schema["id"], T.StructField("spans", T._parse_datatype_string(FOUND))])

    def run(batches):
        for batch in batches:
            arrow = pa.schema([batch.schema.field(0), ("spans", ARROW_FOUND)])
            yield from batches_of((([k.as_py(), spans := chosen(c.as_py(), sent.value, least)], 16 + 48 * len(spans)) for k, c in zip(*batch.columns)), arrow)

    return found.mapInArrow(run, schema)


def find(df: DataFrame, key: str = "doc_id", text: str = "text", fit: int = FIT, least: float = LEAST) -> DataFrame:
    """id and spans for every row of df, in the shared folder; the candidates are deleted."""
    found = materialise(candidates(df, key, text), "candidates")
    try:
        return materialise(decide(found, train(found, fit), least), "personal")
    finally:
        delete(found)


def spelled(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; n_added counts the spans of the added kinds."""
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(of, BASE), F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled("spans").alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
