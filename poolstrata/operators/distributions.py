"""Distribution panels of a snapshot: bands, spectra, densities, mosaics. All are aggregates; none keeps a transaction.

Rows carry ``bucket`` (the lens bucket, or a panel group) where a panel stacks by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..storage import written

SPECTRUM_BINS, DENSITY_COLUMNS, DENSITY_ROWS = 22, 22, 14


def weight_of(metric: str) -> Column:
    return F.lit(1).cast("bigint") if metric == "count" else F.col("vsize")


def entanglement(entries: DataFrame, metric: str = "count") -> DataFrame:
    """Bands of ancestors and descendants besides the transaction itself, with shares."""
    long = entries.select("source_id", weight_of(metric).alias("weight"), "ancestor_count", "descendant_count").unpivot(["source_id", "weight"], ["ancestor_count", "descendant_count"], "relation", "relatives")
    rows = long.groupBy("source_id", "relation", C.relative_band("relatives").alias("band")).agg(F.sum("weight").alias("weight"))
    return rows.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("source_id", "relation")))


def spectrum(rows: DataFrame, value: Column, domain: str, bins: int = SPECTRUM_BINS, metric: str = "count") -> DataFrame:
    """Stacked histogram on a log axis: weight by bin and bucket, with the largest bin's total and the whole. Entries of no
    weight are left out."""
    each = rows.select("source_id", "bucket", C.log_bin(value, domain, bins).alias("bin"), weight_of(metric).alias("weight")).where("weight > 0")
    parts = each.groupBy("source_id", "bin", "bucket").agg(F.sum("weight").alias("weight"))
    per_bin = parts.withColumn("bin_weight", F.sum("weight").over(Window.partitionBy("source_id", "bin")))
    w = Window.partitionBy("source_id")  # bins times buckets
    return per_bin.withColumn("max_bin", F.max("bin_weight").over(w)).withColumn("total", F.sum("weight").over(w))


def fee_spectrum(entries: DataFrame, metric: str = "count") -> DataFrame:
    return spectrum(entries, C.fee_rate(), "fee_rate", metric=metric)


def ancestor_fee_spectrum(entries: DataFrame, metric: str = "count") -> DataFrame:
    return spectrum(entries, C.ancestor_fee_rate(), "fee_rate", metric=metric)


def data_spectrum(entries: DataFrame, metric: str = "count") -> DataFrame:
    return spectrum(entries.where("structure.op_return_bytes > 0"), F.col("structure.op_return_bytes"), "data", metric=metric)


def value_spectrum(entries: DataFrame, metric: str = "count") -> DataFrame:
    return spectrum(entries.where("structure is not null"), F.col("structure.output_sats"), "value", metric=metric)


def density(rows: DataFrame, x: Column, x_domain: str, y: Column, y_domain: str, columns: int = DENSITY_COLUMNS, lines: int = DENSITY_ROWS, metric: str = "count") -> DataFrame:
    """Cells, both marginals and the whole in one pass (grouping sets): col or row NULL where summed over."""
    each = rows.select("source_id", C.log_bin(x, x_domain, columns).alias("col"), C.log_bin(y, y_domain, lines).alias("row"), weight_of(metric).alias("weight"))
    s, a, b = F.col("source_id"), F.col("col"), F.col("row")
    return each.groupingSets([[s, a, b], [s, a], [s, b], [s]], s, a, b).agg(F.sum("weight").alias("weight"))


def dense_grid(cells: DataFrame, columns: int = DENSITY_COLUMNS, lines: int = DENSITY_ROWS) -> DataFrame:
    """Every cell of a density, zero where empty, with the fullest cell's weight."""
    full = cells.where("col is not null and row is not null")
    grid = cells.select("source_id").distinct().select("source_id", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("col")).select("source_id", "col", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("row"))
    out = grid.join(full, ["source_id", "col", "row"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    return out.withColumn("max_cell", F.max("weight").over(Window.partitionBy("source_id")))


def joint_density(entries: DataFrame, metric: str = "count") -> DataFrame:
    return density(entries, C.fee_rate(), "fee_rate", F.col("vsize"), "vsize", metric=metric)


def complexity_density(entries: DataFrame, metric: str = "count") -> DataFrame:
    return density(entries.where("structure is not null"), F.col("structure.input_count"), "io", F.col("structure.output_count"), "io", metric=metric)


def age_mosaic(entries: DataFrame, metric: str = "count") -> DataFrame:
    """Weight by bucket and age band, the bucket's share of all and the cell's share of its bucket."""
    band = C.age_band(C.age_ms("observed_at_ms"))
    cells = entries.groupBy("source_id", "bucket", band.alias("band")).agg(F.sum(weight_of(metric)).alias("weight"))
    column = F.sum("weight").over(Window.partitionBy("source_id", "bucket"))
    whole = F.sum("weight").over(Window.partitionBy("source_id"))
    return cells.withColumn("column_share", column / whole).withColumn("cell_share", F.col("weight") / column)


def panel_totals(entries: DataFrame) -> DataFrame:
    """Population, structured, data-carrying and replaceable: counts and vsizes."""
    parts = {"population": F.lit(True), "structured": F.col("structure").isNotNull(), "carriers": F.coalesce(F.col("structure.op_return_bytes") > 0, F.lit(False)), "replaceable": F.col("replaceable")}
    return entries.groupBy("source_id").agg(*(x for name, cond in parts.items() for x in (F.count_if(cond).alias(f"{name}_n"), F.sum(F.when(cond, F.col("vsize")).otherwise(0)).alias(f"{name}_vsize"))))


def fee_and_age_lanes(entries: DataFrame) -> DataFrame:
    """(source_id, axis, name, n): counts of fee lanes and of age columns."""
    lanes = F.array(F.struct(F.lit("fee").alias("axis"), C.fee_lane(C.fee_rate()).alias("name")), F.struct(F.lit("age").alias("axis"), C.age_column(C.age_ms("observed_at_ms")).alias("name")))
    return entries.select("source_id", F.explode(lanes).alias("x")).groupBy("source_id", "x.axis", "x.name").agg(F.count("*").alias("n"))


def all_panels(entries: DataFrame, metric: str = "count", limit: int = 6) -> dict[str, DataFrame]:
    """The nine panels over one bucketed frame, which is written once for all of them."""
    from . import buckets as B

    bucketed = written(entries.withColumn("bucket", B.lens_bucket()), "bucketed")
    entries = bucketed.drop("bucket")
    groups = B.lens_buckets(entries)
    weight = "n" if metric == "count" else "vsize"
    return {
        "composition": B.composition_bar(groups, weight), "entanglement": entanglement(entries, metric), "fee_spectrum": fee_spectrum(bucketed, metric), "ancestor_fee_spectrum": ancestor_fee_spectrum(bucketed, metric),
        "joint_density": joint_density(entries, metric), "age_mosaic": age_mosaic(bucketed, metric), "data_spectrum": data_spectrum(bucketed, metric), "complexity_density": complexity_density(entries, metric),
        "value_spectrum": value_spectrum(bucketed, metric), "panel_groups": B.panel_groups(groups, weight, limit),
    }
