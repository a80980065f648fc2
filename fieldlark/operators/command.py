"""Canal commands: demand, delivery order and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan(fields: DataFrame, discharge: float, tail_first: bool = True, only_due: bool = True, command: str = "command_id") -> DataFrame:
    """Per command: volume (m3) of the due fields, hours of the outlet's discharge (m3/s), number of fields in need."""
    if discharge <= 0:
        raise ValueError("the discharge has to be positive")
    due = (F.col("status") >= 2) if only_due else F.lit(True)
    volume = F.when(due, F.col("dgross") * F.col("area_ha") * 10.0).otherwise(F.lit(0.0))
    out = fields.groupBy(command).agg(F.sum(volume).alias("volume_m3"), F.count_if(F.col("status") >= 2).alias("n_need"), F.count(F.lit(1)).alias("n_fields"))
    return out.withColumn("hours", F.col("volume_m3") / discharge / 3600.0)


def delivery(fields: DataFrame, tail_first: bool = True, only_due: bool = True, command: str = "command_id", field: str = "field_id") -> DataFrame:
    """Due fields of each command with their place in line: the tail first, then the farthest, the most urgent, the driest."""
    due = fields.where("status >= 2") if only_due else fields
    tail = [F.desc("is_tail_end")] if tail_first else []
    w = Window.partitionBy(command).orderBy(*tail, F.desc("distance_from_head_m"), F.desc("status"), F.desc("dgross"), F.asc(field))
    return due.select(command, field, (F.col("dgross") * F.col("area_ha") * 10.0).alias("volume_m3"), F.row_number().over(w).alias("rank"))


def rollup(cells: DataFrame, stress: DataFrame, advice: DataFrame, area_ha: str = "command_area_ha", command: str = "command_id") -> DataFrame:
    """Per command: mean stress and deficit, water demand, the histogram of actions and the commonest (first met on ties).

    ``cells`` is (command, cell, pos, area); a cell without both records is left out.
    """
    j = cells.join(stress, "cell").join(advice, "cell")
    acts = j.groupBy(command, "action").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    acts = acts.groupBy(command).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("actions"),
        F.max_by("action", F.struct(F.col("n"), -F.col("first"))).alias("dominant"),
    )
    means = j.groupBy(command).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("stress_index").alias("s"), F.avg("deficit_mm").alias("d"), F.first(area_ha).alias("area"))
    out = means.join(acts, command)
    return out.select(command, "n_cells", F.round("s", 4).alias("mean_stress"), F.round("d", 2).alias("mean_deficit"), F.round(F.col("d") * F.col("area") * 10.0, 1).alias("demand_m3"), "actions", "dominant")


def dashboard(fields: DataFrame, keys: list[str], efficiency: float = 0.65) -> DataFrame:
    """Per key: fields, area, count and share of each advisory, gross demand (m3 and hectare-metres)."""
    net = F.when(F.col("advisory").isin("irrigate_now", "critical"), F.greatest(F.col("dr"), F.lit(0.0))).when(F.col("advisory") == "irrigate_soon", F.greatest(F.col("dr") - F.col("raw") * 0.6, F.lit(0.0))).otherwise(F.lit(0.0))
    gross = net / efficiency * 1e-3 * F.col("area_ha") * 1e4
    names = ("no_irrigation", "watch", "irrigate_soon", "irrigate_now", "critical")
    is_ = lambda a: F.col("advisory") == a
    out = fields.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fields"), F.sum("area_ha").alias("area"), *[F.count_if(is_(a)).alias(f"n_{a}") for a in names], F.sum(gross).alias("g"))
    return out.select(*keys, "n_fields", F.round("area", 1).alias("total_area_ha"), *[f"n_{a}" for a in names], *[F.round(100.0 * F.col(f"n_{a}") / F.col("n_fields"), 1).alias(f"pct_{a}") for a in names], F.round("g", 0).alias("gross_demand_m3"), F.round(F.col("g") / 1e4, 1).alias("gross_demand_ham"))
