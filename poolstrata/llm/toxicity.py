"""Toxicity by maximum-scoring segments.

Fitting takes a bounded sample of the labels (``LABELLED``); scoring and its passages cover every whole text.

Token scores. Log-odds of a token between toxic and other labelled texts, with an informative Dirichlet prior from both
classes together (Monroe et al., 2008), over texts that hold the token; equal texts count once, so a group of copies says
no more than one text. A token scores if at least ``LEAST_TEXTS`` toxic texts hold it (of fewer no bound can be told) and
the lower bound of its log-odds passes ``LEAST_BOUND``; all that do are kept, so the model grows with the
labelled sample and with nothing else. Every other token gets the rest's log-odds, which is below zero, so scores drift down outside toxic passages.
Segments. All maximal scoring segments of a text in linear time (Ruzzo and Tompa, 1999); between two scoring tokens only
the number of others matters.
Calibration. By extreme-value statistics (Karlin and Altschul, 1990): lambda from the background scores, each token's by its
share of the background, K from the
maxima of the texts labelled as not toxic; a segment of score s in n tokens has E = K n exp(-lambda s). Segments with
E under ``SIGNIFICANT`` are passages; a text's evidence is the sum of their -ln E. A logistic curve on the evidence,
fitted on counts of labelled texts by evidence, gives the score.

Defined cases: a null text is empty; a text without tokens has no evidence and gets the base rate; without labels of both
classes every score is the smoothed base rate; repeated rows each get a row. Only id, text and labels are read; a doc_id
with several labels counts as toxic if one of them is 1; a null doc_id has no label and isn't held out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, materialise, table

WORD = re.compile(r"[^\W\d_]+")
PRIOR_SHARE, PRIOR_LEAST = 0.01, 0.5
LEAST_BOUND, BOUND_SD, LEAST_TEXTS = 1.0, 2.6, 3
#: Bound of the labelled sample that the model is fitted on: where there are more labels, a share of them drawn by hash.
LABELLED = 250_000
SIGNIFICANT = 0.05
THRESHOLD = 0.7


def lowered(text: str) -> str:
    """Lower case of the same length, so offsets in it are offsets in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def maximal_segments(steps: list[tuple[float, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a list of (score below or at zero, positive score) steps, as (first, last, score):
    numbers of the positive scores at either end. Linear time."""
    kept: list[list] = []  # [first, last, sum before it, sum at its end, number of the nearest one before it that begins lower]
    total = 0.0
    for k, (fall, rise) in enumerate(steps):
        total += fall
        new = [k, k, total, total + rise, -1]
        total += rise
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]  # what lies between begins no lower than kept[j], so none of it is looked at again
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], -1]
            del kept[j:]
    return [(a, b, right - left) for a, b, left, right, _ in kept]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    rest: float = -0.01
    rate: float = 1.0  # lambda
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens, and maximal segments as (first token, last token, score)."""
        found = list(map(self.weights.get, WORD.findall(lowered(text)))) if self.weights else []
        hits = [n for n, w in enumerate(found) if w is not None]
        steps, before = [], 0
        for n in hits:
            steps.append(((n - before) * self.rest, found[n]))
            before = n + 1
        return len(found), [(hits[a], hits[b], s) for a, b, s in maximal_segments(steps)]

    def passages(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """A text's evidence and its significant passages (first token, last token, -ln E)."""
        n, segments = self.segments(text)
        out = [(a, b, self.rate * s - math.log(self.k * n)) for a, b, s in segments]
        out = [x for x in out if x[2] > -math.log(SIGNIFICANT)]
        return sum(x[2] for x in out), out

    def score(self, evidence: float) -> float:
        z = self.intercept + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def labelled(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = LABELLED) -> DataFrame:
    """body and toxic for each different labelled text of df, in the shared folder; of about ``bound`` labels at most.

    The labels that take part are few by that bound, so they go to the texts (broadcast) and unlabelled texts don't move.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    share = min(1.0, bound / max(1, marks.count()))
    drawn = marks.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(13)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    drawn = drawn.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    return materialise(df.join(F.broadcast(drawn), key).select(body, "_toxic").groupBy("body").agg(F.max("_toxic").alias("toxic")), "labelled")


def token_counts(known: DataFrame) -> DataFrame:
    """token, n_toxic, n_other: texts of each class that hold it. Each partition counts before the shuffle."""

    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for body, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                for token in set(WORD.findall(lowered(body))):
                    counts.setdefault(token, [0, 0])[1 - toxic] += 1
                if len(counts) > 300_000:
                    yield of(counts)
                    counts = {}
        yield of(counts)

    def of(counts: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["token", "n_toxic", "n_other"])

    parts = known.select("body", "toxic").mapInArrow(run, "token string, n_toxic long, n_other long")
    return parts.groupBy("token").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))


def token_scores(counts: DataFrame) -> tuple[dict[str, float], float, dict[str, float]]:
    """Scores of the tokens that have one, the score of the rest, and the background share of each scoring token."""
    counts = materialise(counts, "tokens")
    total = counts.agg(F.sum("n_toxic").alias("t"), F.sum("n_other").alias("o")).first()
    n_toxic, n_other = total["t"] or 0, total["o"] or 0
    if not n_toxic or not n_other:
        return {}, -0.01, {}
    prior = PRIOR_SHARE * (F.col("n_toxic") + F.col("n_other")) + PRIOR_LEAST
    all_prior = PRIOR_SHARE * (n_toxic + n_other) + PRIOR_LEAST
    a, b = F.col("n_toxic") + F.col("prior"), F.col("n_other") + F.col("prior")
    odds = F.log(a / (n_toxic + all_prior - a)) - F.log(b / (n_other + all_prior - b))
    ranked = counts.where(F.col("n_toxic") >= LEAST_TEXTS).withColumn("prior", prior).withColumn("odds", odds).withColumn("bound", F.col("odds") - BOUND_SD * F.sqrt(1 / a + 1 / b))
    rows = ranked.where(F.col("bound") >= LEAST_BOUND).orderBy("token").collect()
    in_toxic, in_other = sum(r["n_toxic"] for r in rows), sum(r["n_other"] + r["prior"] for r in rows)
    rest = math.log((1 - in_toxic / (n_toxic + all_prior)) / (1 - in_other / (n_other + all_prior)))
    return {r["token"]: r["odds"] for r in rows}, min(rest, -0.01), {r["token"]: (r["n_other"] + r["prior"]) / (n_other + all_prior) for r in rows}


def decay(weights: dict[str, float], rest: float, shares: dict[str, float]) -> float:
    """lambda: the positive root of E[exp(lambda score)] = 1 under the background."""
    if not weights:
        return 1.0
    w, p = np.array(list(weights.values())), np.array([shares[t] for t in weights])
    grown = lambda x: (1 - p.sum()) * math.exp(x * rest) + float((p * np.exp(x * w)).sum())
    low, high = 1e-6, 1.0
    while grown(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if grown(mid) < 1 else (low, mid)
    return max(low, 1e-3)


def logistic(evidence: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below 0) of a logistic curve on log1p(evidence), by Newton steps with a weak ridge."""
    x = np.stack([np.ones(len(evidence)), np.log1p(evidence)], 1)
    n, w = toxic + other, np.zeros(2)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - n * p) - ridge @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled texts of df."""
    known = labelled(df, labels, key, text, label)
    weights, rest, shares = token_scores(token_counts(known))
    model = Model(weights, rest, decay(weights, rest, shares))

    def maxima(batches):
        for batch in batches:
            got = [model.segments(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([max((s for *_, s in g), default=0.0) for _, g in got], pa.float64()), pa.array([n for n, _ in got], pa.int64())], names=["top", "n"])

    clean = known.where("toxic = 0").select("body").mapInArrow(maxima, "top double, n long")
    fit = clean.agg(F.count("*").alias("texts"), F.sum(F.col("n") * F.exp(-model.rate * F.col("top"))).alias("mass")).first()
    model.k = max(fit["texts"], 1) / max(fit["mass"] or 0.0, 1.0)

    def evidence(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([round(math.log1p(model.passages(x.as_py())[0]), 1) for x in batch.column(0)], pa.float64()), batch.column(1)], names=["x", "toxic"])

    rows = known.select("body", "toxic").mapInArrow(evidence, "x double, toxic int").groupBy("x").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")).collect()
    bins = np.array([[math.expm1(r["x"]), r["t"], r["o"]] for r in rows] or [[0.0, 0.5, 0.5]], float)  # a few hundred at most: steps of 0.1 in log1p
    model.intercept, model.slope = logistic(bins[:, 0], bins[:, 1], bins[:, 2])
    return model


PASSAGE = "array<struct<start: int, end: int, evidence: double>>"


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the carried columns, score, evidence and passages (code points, end exclusive) for every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # tokens of the bounded sample
    kept = [f for f in df.schema.fields if f.name == key or f.name in carry]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("passages", T._parse_datatype_string(PASSAGE))])
    arrow_passages = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))

    def run(batches):
        m = sent.value
        for batch in batches:
            totals, spans = [], []
            for x in batch.column(len(names)):
                body = x.as_py() or ""
                total, found = m.passages(body)
                places = [w.span() for w in WORD.finditer(lowered(body))] if found else []
                totals.append(total)
                spans.append([{"start": places[a][0], "end": places[b][1], "evidence": e} for a, b, e in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([m.score(t) for t in totals], pa.float64()), pa.array(totals, pa.float64()), pa.array(spans, arrow_passages)], names=[*names, "score", "evidence", "passages"])

    return df.select(*(F.col(n) for n in names), F.col(text).alias("_text")).mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    model = train(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    found = score(docs, model, carry=("held_out",))
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "evidence", F.size("passages").alias("n_passages"))
