"""The classifier catalog: lenses, versions and label vocabularies, and the registry that new lenses join (all four results
of a transaction are published together)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# fixed values: rules, labels and families in their canonical order
RULES = ("output_size", "element_size", "undefined_version", "taproot_annex", "control_block_size", "op_success", "tapscript_op_if")
STATUSES = ("compatible", "violating", "indeterminate")
FAMILIES = ("p2pk", "bare_multisig", "p2pkh", "p2sh", "p2wpkh", "p2wsh", "p2tr", "p2a", "unknown_witness_program", "op_return", "unknown_script")
PROPERTY_LABELS = ("version_1", "version_2", "version_3", "version_other", "signals_rbf", "has_witness", "has_taproot_annex", *FAMILIES)
SHAPE_LABELS = ("possible_coinjoin", "consolidation", "batch_payout", "other_shape")
DATA_LABELS = ("inscription", "brc20", "runes", "stamps", "counterparty", "omni", "other_op_return", "no_detected_protocol")


@dataclass(frozen=True)
class Lens:
    classifier_id: str
    version: str
    methodology: str
    semantics: str
    required_facts: tuple[str, ...]
    labels: tuple[str, ...]
    classify: Callable[..., DataFrame] | None = field(default=None, compare=False)
    #: Lenses whose results this one reads: they are planned before it, and it gets them by id as a fourth argument.
    needs: tuple[str, ...] = ()


CATALOG: list[Lens] = [
    Lens("transaction_properties", "1", "exact", "multi_label", ("raw_transaction", "input_script_pubkeys"), PROPERTY_LABELS),
    Lens("transaction_shape", "2", "heuristic", "multi_label", ("raw_transaction", "input_script_pubkeys"), SHAPE_LABELS, needs=("data_protocols",)),
    Lens("data_protocols", "2", "fingerprint", "multi_label", ("raw_transaction",), DATA_LABELS),
    Lens("knots_bip110", "1", "policy", "rule_set", ("raw_transaction", "input_script_pubkeys"), STATUSES),
]


def labels_of(classifier_id: str) -> tuple[str, ...]:
    return next(x.labels for x in CATALOG if x.classifier_id == classifier_id)


def register(lens: Lens) -> None:
    """Add a lens; its id must be new and its labels distinct."""
    if any(x.classifier_id == lens.classifier_id for x in CATALOG) or len(set(lens.labels)) != len(lens.labels):
        raise ValueError(f"lens {lens.classifier_id} is taken or repeats a label")
    CATALOG.append(lens)


def planned(lenses: list[Lens]) -> list[Lens]:
    """Lenses with each after all that it needs, else in their order. A need that isn't among them, or that leads back, is an error."""
    names, done, out = {x.classifier_id for x in lenses}, set(), []
    for lens in lenses:
        if missing := set(lens.needs) - names:
            raise ValueError(f"lens {lens.classifier_id} needs {', '.join(sorted(missing))}")
    while len(out) < len(lenses):
        ready = next((x for x in lenses if x.classifier_id not in done and done.issuperset(x.needs)), None)
        if ready is None:
            raise ValueError(f"lenses need each other: {', '.join(x.classifier_id for x in lenses if x.classifier_id not in done)}")
        done.add(ready.classifier_id)
        out.append(ready)
    return out


def catalog_frame(spark: SparkSession) -> DataFrame:
    """One row for each label: a dimension of a few dozen rows."""
    rows = [(n, x.classifier_id, x.version, x.methodology, x.semantics, list(x.required_facts), k, label) for n, x in enumerate(CATALOG) for k, label in enumerate(x.labels)]
    return spark.createDataFrame(rows, "ord int, classifier_id string, version string, methodology string, semantics string, required_facts array<string>, label_ord int, label_key string")
