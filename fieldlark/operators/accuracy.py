"""Map accuracy: confusion matrix, its summaries, and area-weighted accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n) over the grid of all labels, zeros included."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("truth", "pred")).alias("l")).distinct()
    grid = labels.select(F.col("l").alias("truth")).crossJoin(labels.select(F.col("l").alias("pred")))  # a label by a label
    return grid.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def overall(cm: DataFrame) -> DataFrame:
    """overall_accuracy and kappa (1 or 0 where chance agreement is complete)."""
    rows = cm.groupBy(F.col("truth").alias("l")).agg(F.sum("n").alias("r"))
    cols = cm.groupBy(F.col("pred").alias("l")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "l").agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("rc"))
    total = cm.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("d"))
    one = total.crossJoin(chance).where("t > 0").select((F.col("d") / F.col("t")).alias("po"), (F.col("rc") / (F.col("t").cast("double") * F.col("t"))).alias("pe"))
    kappa = F.when(F.abs(1.0 - F.col("pe")) < 1e-12, F.when(F.col("po") == 1.0, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / F.when(F.abs(1.0 - F.col("pe")) >= 1e-12, 1.0 - F.col("pe")))
    return one.select(F.col("po").alias("overall_accuracy"), kappa.alias("kappa"))


def _ratio(a: str, b: str):
    return F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(F.lit(0.0))


def per_class(cm: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of each class, and the rows "macro" and "weighted"."""
    rows = cm.groupBy(F.col("truth").alias("l")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    cols = cm.groupBy(F.col("pred").alias("l")).agg(F.sum("n").alias("said"))
    each = rows.join(cols, "l").select(F.col("l").cast("string").alias("label"), _ratio("hit", "said").alias("precision"), _ratio("hit", "support").alias("recall"), "support")
    s = F.col("precision") + F.col("recall")
    each = each.withColumn("f1", F.when(s > 0, 2.0 * F.col("precision") * F.col("recall") / F.when(s > 0, s)).otherwise(F.lit(0.0)))
    names = ("precision", "recall", "f1")
    macro = each.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).withColumn("label", F.lit("macro"))
    weigh = each.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).withColumn("label", F.lit("weighted"))
    return each.unionByName(macro).unionByName(weigh)


def area_weighted(cm: DataFrame, areas: DataFrame, z: float = 1.96) -> DataFrame:
    """Per class area-weighted user's and producer's accuracy, area proportion, their errors, and the overall accuracy.

    ``cm`` is (map, ref, n), ``areas`` (label, fraction); fractions are made to add up to 1.
    """
    whole = areas.agg(F.sum("fraction").alias("__t"))
    w = areas.crossJoin(whole).select(F.col("label").alias("map"), (F.col("fraction") / F.col("__t")).alias("w"))
    sums = cm.groupBy("map").agg(F.sum("n").alias("ni"))
    c = cm.join(sums, "map").join(w, "map").withColumn("u", F.when(F.col("ni") > 0, F.col("n") / F.when(F.col("ni") > 0, F.col("ni"))).otherwise(F.lit(0.0))).withColumn("p", F.col("w") * F.col("u"))
    diag = c.where("map = ref").select(F.col("map").alias("l"), "w", "ni", F.col("p").alias("pd"), F.when(F.col("ni") > 0, F.col("u")).alias("users"))
    by_ref = c.groupBy(F.col("ref").alias("l")).agg(
        F.sum("p").alias("area"),
        F.sum(F.when(F.col("ni") > 1, (F.col("w") * F.col("p") - F.col("p") * F.col("p")) / (F.col("ni") - 1.0)).otherwise(0.0)).alias("var_area"),
        F.sum(F.when((F.col("ni") > 1) & (F.col("map") != F.col("ref")), F.col("w") * F.col("w") * F.col("u") * (1.0 - F.col("u")) / (F.col("ni") - 1.0)).otherwise(0.0)).alias("term2"),
    )
    each = diag.join(by_ref, "l").withColumn("producers", F.when(F.col("area") > 0, F.col("pd") / F.when(F.col("area") > 0, F.col("area"))))
    spread = F.when(F.col("ni") > 1, F.col("users") * (1.0 - F.col("users")) / F.when(F.col("ni") > 1, F.col("ni") - 1.0))
    term1 = F.coalesce(F.col("w") * F.col("w") * (1.0 - F.col("producers")) * (1.0 - F.col("producers")) * spread, F.lit(0.0))
    var_prod = (term1 + F.col("producers") * F.col("producers") * F.col("term2")) / F.when(F.col("area") > 0, F.col("area") * F.col("area"))
    each = each.withColumns({"se_users": F.sqrt(spread), "se_producers": F.sqrt(F.greatest(var_prod, F.lit(0.0))), "se_area": F.sqrt(F.greatest(F.col("var_area"), F.lit(0.0))), "oa_part": F.col("w") * F.col("w") * spread})
    total = each.agg(F.sum("pd").alias("oa"), F.sqrt(F.sum(F.coalesce("oa_part", F.lit(0.0)))).alias("se_oa"))
    out = each.crossJoin(F.broadcast(total))
    return out.select(F.col("l").alias("label"), "users", "producers", F.col("area").alias("area_proportion"), "se_users", "se_producers", "se_area", "oa", "se_oa", (F.col("oa") - z * F.col("se_oa")).alias("oa_low"), (F.col("oa") + z * F.col("se_oa")).alias("oa_high"))
