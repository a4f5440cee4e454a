"""Secret scans as an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (sha256 of its text). A ledger table keeps one row for each (blob, rule
version) that has been scanned, with its findings; a run scans only the pairs that the ledger lacks and joins the findings
back to all paths that hold the blob. Equal blobs are scanned once, however many paths hold them, so a group of copies
costs one scan; the join back is on the blob's hash with the path's key alone, never with texts.

Rules. ``assign``, ``access`` and ``hex`` are the base kinds. ``pem``, ``jwt`` and ``vendor`` add spans that those don't
describe; ``pem`` is a whole block from its BEGIN line through its END line, or through its base64 where END is missing. A match is leftmost and non-overlapping for its kind; matches that fail the kind's least length are dropped
after matching, so they still use up their characters.

The ledger is a folder with one folder for each run (``append``). A run that is repeated, or two at once, may write a pair
twice; readers take one row of each pair, so findings never double.

Defined cases: a null text is the empty blob; an empty table gives an empty result; equal rows each keep a row; a null key
is kept as any other key; only the key and the text are read, so other columns can't clash. Offsets are code points.
Spans of a text with very many matches are built in blocks, so the work stays about linear.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, fresh, materialise, shared_dir, table

RULE_VERSION = 2


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # code points of the checked group
    group: int = 0


# fixed values: the rules
# quantifiers are possessive where they repeat groups: Java takes those without recursion, however long a block is
GAP = r"""(?:[\s"'>,;]|\\[nrt])"""
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:(?:[^-]++|-{1,4}+(?!-))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{GAP}*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+"
    # a last line is shorter; on the same line a run of letters alone is a word
    rf"""(?:(?<=[A-Za-z0-9+/=]{{16}})(?:(?:\r?\n|\\n)[ \t"'>]*+|{GAP}++(?=[A-Za-z]*+[0-9+/=]))[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?![^\s"'\\]))?)"""
)
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # the same spans as runs of any length with those under 16 dropped
)
ADDED = (
    Rule("pem", PEM, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1),
    Rule("vendor", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 1),
)
RULES = BASE + ADDED
#: Matches whose spans are put together at a time.
BLOCK = 64
SPAN = "struct<start: int, ord: int, kind: string, end: int>"


def spans_of(text: Column, rule: Rule, ordinal: int) -> Column:
    """array of (start, ord, kind, end) of a rule's matches. What lies between the matches (split) and the matches' own
    lengths give their places, as there is no function for positions; texts without a match skip that."""
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    checked = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    each = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(checked, F.length).alias("checked"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        span = F.array(F.struct(start.alias("start"), F.lit(ordinal).alias("ord"), F.lit(rule.kind).alias("kind"), (start + x["size"]).alias("end")))
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"), F.when(x["checked"] >= rule.least, F.concat(a["got"], span)).otherwise(a["got"]).alias("got"))

    def block(a: Column, k: Column) -> Column:
        """The spans of one block of matches, after those of the blocks before it."""
        own = F.aggregate(F.slice(each, k * BLOCK + 1, F.lit(BLOCK)), F.struct(a["at"].alias("at"), none.alias("got")), step)
        return F.struct(own["at"].alias("at"), F.concat(a["got"], F.array(own["got"])).alias("got"))

    many = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / BLOCK).cast("int")), F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("got")), block, lambda a: F.flatten(a["got"]))
    few = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("got")), step, lambda a: a["got"])
    placed = F.when(F.size(each) <= BLOCK, few).otherwise(many)
    return F.when(F.rlike(text, F.lit(rule.pattern)), placed).otherwise(none)


def scan(blobs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs with ``spans``: all rules' spans by start, then by the rules' order."""
    parts = blobs.select("*", *(spans_of(F.col(text), r, k).alias(f"_spans_{r.kind}") for k, r in enumerate(rules)))
    names = [f"_spans_{r.kind}" for r in rules]
    return parts.withColumn("spans", F.array_sort(F.concat(*names))).drop(*names)


def versions_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: its key, the blob's address, its text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).alias("path"), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("body"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) for the pairs of versions that ``ledger`` lacks."""
    # one text for each blob: copies meet before the shuffle as well as after it
    todo = versions.groupBy("blob").agg(F.first("body").alias("body"))
    if ledger is not None:
        todo = todo.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return scan(todo, "body", rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def findings(versions: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """path and spans for every version; spans are empty where the ledger has none. A pair that the ledger has twice counts once."""
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).dropDuplicates(["blob"]).select("blob", "spans")
    return versions.select("path", "blob").join(hits, "blob", "left").select("path", F.coalesce("spans", F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"))


LEDGER = f"blob string, rule_version int, spans array<{SPAN}>"


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at path, or None before the first run; any other failure to read it is raised."""
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else None


def append(fresh_rows: DataFrame, path: str) -> None:
    """Keep a run's rows in a folder of their own: it is whole or, if the run fails, marked as unfinished by Spark's committer."""
    fresh_rows.write.mode("errorifexists").parquet(f"{path}/run={uuid.uuid4().hex}")


def scan_incrementally(df: DataFrame, ledger_path: str | None = None, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """Scan the pairs of blob and rule version that the ledger at ledger_path hasn't seen, append them there, and return path and
    spans for every row of df. Without a path a ledger is begun in the shared folder."""
    spark = df.sparkSession
    path = ledger_path or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    versions = versions_of(df, key, text)
    append(update_ledger(versions, open_ledger(spark, path), rule_version, rules), path)
    return findings(versions, open_ledger(spark, path), rule_version)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    """Secrets of all documents; with a ledger of earlier runs only blobs and rule versions that it lacks are scanned."""
    found = scan_incrementally(table(spark, sf_dir, "documents"), ledger_path)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    return found.select(
        F.col("path").alias("doc_id"), of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


# ---- redaction, for the pipeline -------------------------------------------------------------------------------------

MARK = "[REDACTED]"


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = MARK) -> DataFrame:
    """df with every span replaced by the mark (spans that touch or overlap become one). Rows without a span stay as they are.

    Texts don't move: only the blobs' findings do, joined back on the blob's address.
    """
    versions = versions_of(df, key, text)
    hits = materialise(update_ledger(versions), "ledger").where(F.size("spans") > 0).select("blob", "spans")
    blob, spans = (fresh(df, name) for name in ("_blob", "_merged"))
    # a span begins a new stretch where it starts after all spans before it have ended
    merged = F.aggregate(
        "spans",
        F.expr("struct(cast(array() as array<struct<start: int, end: int>>) as got, -1 as start, -1 as end)"),
        lambda a, s: F.when(s["start"] <= a["end"], F.struct(a["got"].alias("got"), a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"))).otherwise(
            F.struct(F.when(a["start"] < 0, a["got"]).otherwise(F.concat(a["got"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))).alias("got"), s["start"].alias("start"), s["end"].alias("end"))
        ),
        lambda a: F.concat(a["got"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))),
    )
    # what lies before each stretch, and after the last: each part is cut from the text once and all are joined once
    parts = F.transform(spans, lambda s, k: F.substring(text, F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(spans, k)["end"]) + 1, s["start"] - F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(spans, k)["end"])))
    rest = F.substring(text, F.try_element_at(spans, F.lit(-1))["end"] + 1, F.length(text))
    kept = F.array_join(F.concat(parts, F.array(rest)), mark)
    named = df.withColumn(blob, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    out = named.join(hits.select(F.col("blob").alias(blob), merged.alias(spans)), blob, "left")
    return out.select(*(F.when(F.col(spans).isNotNull(), kept).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in df.columns))
