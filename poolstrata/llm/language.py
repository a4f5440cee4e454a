"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features. Character 1- to 3-grams of the whole lower-cased text, hashed to ``SLOTS`` slots. Term weight: the slot's share
of the text's n-grams, times its inverse document frequency, the latter counted over every training text (one vector of
``SLOTS`` counts for each partition, summed in Spark).
Training. Follow-the-regularised-leader (proximal) with elastic-net penalties, so most weights are exactly zero, on a
sample of labelled texts drawn by hash, of at most ``SAMPLE`` texts and ``SAMPLE_SLOTS`` different slots together; a fifth of it is kept out to fit the temperature.
Prediction. A weighted sum of table rows for each text: an Arrow map without a shuffle. The model (``SLOTS`` x languages)
has a fixed size, whatever the corpus.

Defined cases: a text that is null or has no letter gives ``und`` with score 0; texts without a label aren't trained on;
with no training text at all every text is ``und``; repeated rows each get a row; a null id isn't held out. Only id, text and the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import crc_mod, table

SLOTS = 1 << 16
ORDERS = (1, 2, 3)
#: Bounds of the labelled sample that the weights are fitted on: texts, and different slots of all of them together.
SAMPLE = 3000
SAMPLE_SLOTS = 12_000_000
UNKNOWN = "und"
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-4
EPOCHS = 4
PART = 1 << 16  # slots that are looked up at a time
SCALE = 100.0  # features are shares of a text; this brings them near 1
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def slots_of(text: str) -> np.ndarray:
    """Hash slots of all n-grams of a whole text, orders one after the other."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    parts, h = [], np.zeros(len(x), np.uint32)
    for n in ORDERS:
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] ^ x[n - 1 :] * MULTIPLIERS[n - 1]) * np.uint32(0x27D4EB2F)
        parts.append((h ^ h >> np.uint32(15)) & np.uint32(SLOTS - 1))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and (text.isalpha() or any(map(str.isalpha, text)))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # (SLOTS, languages): weight times inverse document frequency
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        slots = slots_of(text)
        total = np.zeros(len(self.bias))
        for k in range(0, len(slots), PART):
            total += self.table[slots[k : k + PART]].sum(0, dtype=np.float64)
        return total * (SCALE / max(1, len(slots))) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and the number of texts: over all rows of df."""

    def run(batches):
        counts, n, seen = np.zeros(SLOTS, np.int64), 0, np.zeros(SLOTS, bool)
        for batch in batches:
            for body in batch.column(0):
                seen[:] = False
                seen[slots_of(body.as_py() or "")] = True
                counts += seen
                n += 1
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([*slots, -1], pa.int64()), pa.array([*counts[slots], n], pa.int64())], names=["slot", "n"])

    rows = df.select(text).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS + 1 rows at most
    counts = np.zeros(SLOTS + 1, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts[:SLOTS], int(counts[SLOTS])


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (SLOTS, classes) and biases from (slots, values, class) examples, a step for each example."""
    z, n = np.zeros((SLOTS, n_classes)), np.zeros((SLOTS, n_classes))
    zb, nb = np.zeros(n_classes), np.zeros(n_classes)

    def weights(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            slots, values, y = examples[k]
            w, wb = weights(z[slots], n[slots], L1, L2), weights(zb, nb, 0.0, 0.0)
            p = softmax(values @ w + wb)
            p[y] -= 1.0
            g = values[:, None] * p
            z[slots] += g - (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA * w
            n[slots] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * wb
            nb += p * p
    return weights(z, n, L1, L2), weights(zb, nb, 0.0, 0.0)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a search that narrows a bracket of log-temperatures."""
    low, high = -3.0, 4.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of df. Document frequencies cover all of them; weights a sample of at most ``sample``."""
    known = df.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    counts, n = document_frequencies(known, text)
    if not n:
        return Model((), np.zeros((SLOTS, 0), np.float32), np.zeros(0), 1.0)
    idf = np.log((1 + n) / (1 + counts)) + 1.0
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(1 << 30))
    share = min(1.0, 0.9 * sample / n)
    picked = known.where(draw < F.lit(int(share * (1 << 30)))).select(F.col(label).cast("string").alias("label"), draw.alias("draw"), text)

    def features(batches):
        for batch in batches:
            for language, drawn, body in zip(*(c.to_pylist() for c in batch.columns)):
                slots, c = np.unique(slots_of(body), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language]), pa.array([drawn], pa.int64()), pa.array([slots.astype("<u2").tobytes()]), pa.array([(c / max(1, c.sum())).astype("<f4").tobytes()])], names=["label", "draw", "slots", "shares"])

    drawn = picked.mapInArrow(features, "label string, draw long, slots binary, shares binary").orderBy("draw", "label").limit(sample)
    running = F.sum(F.length("slots") / 2).over(Window.orderBy("draw", "label", "slots"))  # of ``sample`` rows at most
    rows = drawn.withColumn("running", running).where(F.col("running") <= SAMPLE_SLOTS).drop("running").collect()
    languages = tuple(sorted({r["label"] for r in rows}))
    if not languages:
        return Model((), np.zeros((SLOTS, 0), np.float32), np.zeros(0), 1.0)
    examples = []
    for r in rows:
        slots = np.frombuffer(r["slots"], "<u2").astype(np.int64)
        examples.append((slots, np.frombuffer(r["shares"], "<f4") * idf[slots] * SCALE, languages.index(r["label"])))
    kept_out = examples[::5] if len(examples) >= 50 else examples
    fitted = [e for k, e in enumerate(examples) if k % 5] if len(examples) >= 50 else examples
    weights, bias = ftrl(fitted, len(languages))
    logits = np.array([v @ weights[s] + bias for s, v, _ in kept_out])
    return Model(languages, (weights * idf[:, None]).astype(np.float32), bias, temperature(logits, np.array([y for _, _, y in kept_out])))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the carried columns, lang_pred and score (calibrated probability) for every row."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)  # SLOTS x languages floats
    kept = [f for f in df.schema.fields if f.name == key or f.name in carry]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(x.as_py()) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return df.select(*(F.col(n) for n in names), F.col(text).alias("_text")).mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs.drop("lang"), model, carry=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


# ---- for the pipeline ------------------------------------------------------------------------------------------------

LEAST_SCORE = 0.4


def keep_known_language(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """Rows of df whose text has a letter and whose language is predicted with at least ``least`` probability; columns stay."""
    model = train(df, key, text, label)
    names = df.columns
    schema = df.schema
    sent = df.sparkSession.sparkContext.broadcast(model)
    where = names.index(text)

    def run(batches):
        for batch in batches:
            found = [sent.value.predict(x.as_py()) for x in batch.column(where)]
            yield batch.filter(pa.array([a != UNKNOWN and b >= least for a, b in found], pa.bool_()))

    return df.mapInArrow(run, schema)
