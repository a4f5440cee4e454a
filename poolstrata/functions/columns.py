"""Per-row functions of membership facts and results, as Column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import FAMILIES, PROPERTY_LABELS, RULES

# fixed values: domains of the log axes (low, high)
DOMAINS = {"fee_rate": (1, 512), "vsize": (64, 131072), "data": (1, 131072), "io": (1, 1024), "value": (1000, 100_000_000_000)}
HOUR = 3_600_000
# fixed values: (upper bound, name) bands
RELATIVE_BANDS = ((1, "alone"), (2, "one"), (5, "few"), (10, "several"), (None, "many"))
AGE_BANDS = ((HOUR // 6, "under_10m"), (HOUR, "under_1h"), (6 * HOUR, "under_6h"), (24 * HOUR, "under_24h"), (None, "older"))
FEE_LANES = ((128, "128+"), (64, "64-128"), (32, "32-64"), (16, "16-32"), (8, "8-16"), (4, "4-8"), (2, "2-4"), (1, "1-2"), (None, "<1"))
AGE_COLUMNS = ((72 * HOUR, "3d+"), (24 * HOUR, "1-3d"), (6 * HOUR, "6-24h"), (HOUR, "1-6h"), (HOUR // 6, "10-60m"), (None, "<10m"))
PROFILES = {"legacy": ("p2pk", "bare_multisig", "p2pkh", "p2sh"), "segwit_v0": ("p2wpkh", "p2wsh"), "taproot": ("p2tr",)}


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fee_rate(fee: Column | str = "fee_sats", vsize: Column | str = "vsize") -> Column:
    """fee / vsize, 0 where vsize is not positive."""
    return F.when(c(vsize) > 0, c(fee) / c(vsize)).otherwise(F.lit(0.0))


def ancestor_fee_rate() -> Column:
    return fee_rate("ancestor_fee_sats", "ancestor_vsize")


def age_ms(observed: Column | str, entered: Column | str = "entered_at_ms") -> Column:
    """Age at observation, 0 for entries from the observer's future."""
    return F.greatest(F.lit(0).cast("bigint"), c(observed) - c(entered))


def log_position(value: Column | str, domain: str) -> Column:
    """Place of value on a log axis, clamped to 0..1; 0 for what isn't positive."""
    low, high = DOMAINS[domain]
    v = c(value).cast("double")
    place = (F.log(v) - F.log(F.lit(float(low)))) / (F.log(F.lit(float(high))) - F.log(F.lit(float(low))))
    return F.when((v > 0) & ~F.isnan(v), F.least(F.lit(1.0), F.greatest(F.lit(0.0), place))).otherwise(F.lit(0.0))


def log_bin(value: Column | str, domain: str, bins: int) -> Column:
    """Bin of value among ``bins`` equal parts of a log axis. A value on a bin's edge belongs to the bin above; logarithms
    are rounded to 12 places so that this holds whatever library takes them."""
    return F.least(F.lit(bins - 1), F.floor(F.round(log_position(value, domain) * bins, 12)).cast("int"))


def banded(value: Column, bands, rising: bool = True) -> Column:
    """Name of the band: below its bound (rising) or at least its bound (falling), else the last."""
    out = F.lit(bands[-1][1])
    for bound, name in reversed(bands[:-1]):
        out = F.when(value < bound if rising else value >= bound, name).otherwise(out)
    return out


def relative_band(count: Column | str) -> Column:
    """Band of how many relatives a transaction has besides itself."""
    return banded(F.greatest(F.lit(0), c(count) - 1), RELATIVE_BANDS)


def age_band(age: Column) -> Column:
    return banded(age, AGE_BANDS)


def fee_lane(rate: Column) -> Column:
    return banded(rate, FEE_LANES, rising=False)


def age_column(age: Column) -> Column:
    return banded(age, AGE_COLUMNS, rising=False)


def rule_mask(rules: Column | str) -> Column:
    """Bit i for the i-th rule; NULL for NULL."""
    bits = F.transform(c(rules), lambda r: F.pow(F.lit(2), F.array_position(F.array(*map(F.lit, RULES)), r) - 1).cast("int"))
    return F.aggregate(F.array_distinct(bits), F.lit(0), lambda a, b: a.bitwiseOR(b))


def rules_of_mask(mask: Column | str) -> Column:
    each = [F.when(c(mask).bitwiseAND(1 << i) > 0, F.lit(r)) for i, r in enumerate(RULES)]
    return F.array_compact(F.array(*each))


def mask_hex(mask: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(c(mask).cast("bigint")), 2, "0"))


def violation_signature(status: Column | str, violated: Column | str, unknown: Column | str) -> Column:
    """exact:VV, or partial:VV:UU where rules are unknown; NULL unless violating."""
    v, u = rule_mask(violated), rule_mask(unknown)
    key = F.when(u == 0, F.concat(F.lit("exact:"), mask_hex(v))).otherwise(F.concat(F.lit("partial:"), mask_hex(v), F.lit(":"), mask_hex(u)))
    return F.when(c(status) == "violating", key)


def foundation_rule(violated: Column | str) -> Column:
    """The highest violated rule."""
    return F.array_max(F.transform(c(violated), lambda r: F.array_position(F.array(*map(F.lit, RULES)), r)))


def region_key(status: Column | str, violated: Column | str, unknown: Column | str) -> Column:
    return F.coalesce(violation_signature(status, violated, unknown), c(status), F.lit("unclassified"))


def gray_rank(mask: Column | str) -> Column:
    """Rank of a mask in the reflected Gray order of seven bits."""
    m, out = c(mask), c(mask)
    for k in range(1, 7):
        out = out.bitwiseXOR(F.shiftright(m, k))
    return out


def signature_order(violated: Column | str, unknown: Column | str, key: Column | str) -> Column:
    """Sort key of signatures: exact ones first, then Gray ranks, then the key."""
    v, u = rule_mask(violated), rule_mask(unknown)
    return F.struct((u > 0).alias("partial"), gray_rank(v).alias("violated"), gray_rank(u).alias("unknown"), c(key).alias("key"))


def rule_numbers(rules: Column | str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.transform(c(rules), lambda r: F.array_position(F.array(*map(F.lit, RULES)), r))), lambda n: F.concat(F.lit("R"), n.cast("string"))), " + ")


def signature_label(violated: Column | str, unknown: Column | str) -> Column:
    named = F.when(F.size(c(violated)) == 1, F.concat(rule_numbers(violated), F.lit(" only"))).otherwise(rule_numbers(violated))
    return F.when(F.size(c(unknown)) == 0, named).otherwise(F.concat(F.lit("Proven "), rule_numbers(violated)))


def bucket_key(state: Column | str, labels: Column | str, vocabulary: tuple[str, ...]) -> Column:
    """state:i.j.k over the labels' places in the catalog; state:none; unavailable."""
    places = F.transform(F.array_sort(F.transform(F.array_distinct(c(labels)), lambda x: F.array_position(F.array(*map(F.lit, vocabulary)), x) - 1)), lambda n: n.cast("string"))
    key = F.concat(c(state), F.lit(":"), F.when(F.size(places) > 0, F.array_join(places, ".")).otherwise(F.lit("none")))
    return F.when(c(state).isNull() | (c(state) == "unavailable"), F.lit("unavailable")).otherwise(key)


def script_profile(state: Column | str, labels: Column | str) -> Column:
    """Bucket of the properties lens: the one script profile among the labels, mixed for several, other for none."""
    has = {name: F.arrays_overlap(c(labels), F.array(*map(F.lit, families))) for name, families in PROFILES.items()}
    other = F.arrays_overlap(c(labels), F.array(*(F.lit(f) for f in FAMILIES if not any(f in p for p in PROFILES.values()) and f != "op_return")))
    n = sum((F.when(x, 1).otherwise(0) for x in (*has.values(), other)), F.lit(0))
    one = F.lit("other")
    for name, x in has.items():
        one = F.when(x, F.lit(name)).otherwise(one)
    profile = F.when(n > 1, F.lit("mixed")).otherwise(one)
    return F.when(c(state).isNull() | (c(state) == "unavailable"), F.lit("unavailable")).otherwise(F.concat(c(state), F.lit(":profile_"), profile))


def bucket_label(key: Column | str, vocabulary: tuple[str, ...]) -> Column:
    """Label names of a bucket key, joined."""
    indexes = F.split(F.element_at(F.split(c(key), ":"), -1), "\\.")
    names = F.transform(indexes, lambda i: F.element_at(F.array(*map(F.lit, vocabulary)), i.try_cast("int") + 1))
    return F.when(c(key).contains(":") & ~c(key).endswith(":none"), F.array_join(names, " + ")).otherwise(F.when(c(key) == "unavailable", F.lit("Unavailable")).otherwise(F.lit("No labels")))


def availability(has_snapshot: Column, has_error: Column) -> Column:
    return F.when(has_snapshot, F.when(has_error, F.lit("stale")).otherwise(F.lit("ready"))).otherwise(F.when(has_error, F.lit("error")).otherwise(F.lit("waiting")))


def caveat(availability: Column | str, lifecycle: Column | str) -> Column:
    return F.when(c(availability) == "stale", F.lit("stale")).when(c(lifecycle) == "paused", F.lit("paused")).otherwise(F.lit("none"))


def unclassified_kind(lifecycle: Column | str) -> Column:
    return F.when(c(lifecycle) == "classifying", F.lit("pending")).otherwise(F.lit("unavailable"))


def comparison_side(region: Column | str, chosen: Column | str) -> Column:
    """The side whose rows a region shows: its own, or the chosen one for what is common."""
    return F.when(c(region) == "left_only", F.lit("left")).when(c(region) == "right_only", F.lit("right")).otherwise(c(chosen))


def ordered_labels(flags: dict[str, Column], vocabulary: tuple[str, ...]) -> Column:
    """Labels whose flag is true, in the catalog's order."""
    return F.array_compact(F.array(*(F.when(flags[name], F.lit(name)) for name in vocabulary if name in flags)))


assert set(FAMILIES) < set(PROPERTY_LABELS)
