"""Label transfer by nearest profile, coarse first and then among the labels of the coarse one, with overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def log_profile(long: DataFrame, key: str, feature: str = "feature", target: float = 1e4) -> DataFrame:
    """(key, feature, value): counts over the key's total, times ``target``, log1p. Totals are of the features there are,
    so restrict these first."""
    total = F.sum("n").over(Window.partitionBy(key))
    return long.withColumn("value", S.log_normalised(F.col("n"), total, target)).select(key, feature, "value")


def scores(query: DataFrame, reference: DataFrame, cell: str = "cell_id", label: str = "label", feature: str = "feature") -> DataFrame:
    """For each cell: labels with their scores, best first. query and reference: (key, feature, value).

    Similarity is cosine over features; a label without any shared feature has 0, and the least over all labels is taken off
    before scores are normalised to 1 (0 if all are equal). The profiles, labels times features, are a dictionary; products
    are summed within a cell before anything is shuffled on labels."""
    norms = reference.groupBy(label).agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("r"))
    labels = norms.agg(F.sort_array(F.collect_list(F.struct(label, "r"))).alias("labels"))
    own = query.groupBy(cell).agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("q"))
    products = query.join(reference.select(feature, label, F.col("value").alias("w")), feature).groupBy(cell, label).agg(F.sum(F.col("value") * F.col("w")).alias("dot"))
    by_cell = products.groupBy(cell).agg(F.map_from_entries(F.collect_list(F.struct(label, "dot"))).alias("dots"))
    rows = own.join(by_cell, cell, "left").withColumn("labels", labels.scalar())

    def similarity(x: Column) -> Column:
        lengths = F.col("q") * x["r"]
        return F.when(lengths > 0, F.coalesce(F.element_at("dots", x[label]), F.lit(0.0)) / lengths).otherwise(0.0)

    rows = rows.withColumn("s", F.transform("labels", lambda x: F.struct(similarity(x).alias("s"), x[label].alias(label))))
    rows = rows.withColumn("least", F.array_min(F.transform("s", lambda x: x["s"])))
    rows = rows.withColumn("sum", F.aggregate("s", F.lit(0.0), lambda t, x: t + (x["s"] - F.col("least"))))
    score = lambda x: F.when(F.col("sum") > 0, (x["s"] - F.col("least")) / F.col("sum")).otherwise(0.0)
    ranked = F.array_sort(F.transform("s", lambda x: F.struct((-F.round(score(x), 9)).alias("k"), x[label].alias(label))))
    return rows.select(cell, F.transform(ranked, lambda x: F.struct((-x["k"]).alias("score"), x[label].alias(label))).alias("ranked"))


def best(ranked: DataFrame, cell: str = "cell_id", label: str = "label") -> DataFrame:
    """label, score, second_score and margin of each cell; with one label the second is the first and the margin 0."""
    first, runner = F.col("ranked")[0], F.element_at("ranked", F.least(F.size("ranked"), F.lit(2)))
    r = lambda c: F.round(c, 6)
    return ranked.select(cell, first[label].alias(label), r(first["score"]).alias("score"), r(runner["score"]).alias("second_score"), r(first["score"] - runner["score"]).alias("margin"))


def hierarchical(query: DataFrame, reference: DataFrame, parents: DataFrame, coarse: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Fine labels among those of each cell's predicted parent; a parent without any keeps its own name, without scores.

    parents: (label, parent) of fine labels; coarse: (cell, parent) predictions. Each parent's cells meet that parent's profiles only,
    keyed by parent and feature."""
    q = query.join(coarse.select(cell, "parent"), cell)
    ref = reference.join(parents, "label")
    norms = ref.groupBy("parent", "label").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("r"))
    own = q.groupBy(cell, "parent").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("q"))
    grid = own.join(norms, "parent")
    dots = q.join(ref.select("parent", "feature", "label", F.col("value").alias("w")), ["parent", "feature"]).groupBy(cell, "label").agg(F.sum(F.col("value") * F.col("w")).alias("dot"))
    lengths = F.col("q") * F.col("r")
    s = F.when(lengths > 0, F.coalesce("dot", F.lit(0.0)) / lengths).otherwise(0.0)
    of_cell = Window.partitionBy(cell)
    shifted = grid.join(dots, [cell, "label"], "left").withColumn("s", s)
    shifted = shifted.withColumn("s", F.col("s") - F.min("s").over(of_cell)).withColumn("sum", F.sum("s").over(of_cell))
    scored = shifted.withColumn("score", F.round(F.when(F.col("sum") > 0, F.col("s") / F.col("sum")).otherwise(0.0), 9))
    ranked = scored.withColumn("k", F.row_number().over(of_cell.orderBy(F.desc("score"), "label"))).where("k <= 2")
    top = ranked.groupBy(cell).agg(F.min_by("label", "k").alias("label"), F.min_by("score", "k").alias("score"), F.max_by("score", "k").alias("second_score"))
    out = coarse.join(top, cell, "left")
    r = lambda c: F.round(c, 6)
    return out.select(cell, "parent", F.coalesce(F.col("label").cast("string"), F.col("parent").cast("string")).alias("label"), r("score").alias("score"), r("second_score").alias("second_score"), r(F.col("score") - F.col("second_score")).alias("margin"), F.col("label").isNull().alias("fallback"))


def overridden(predictions: DataFrame, confirmed: Column, name: str) -> DataFrame:
    """final_label: ``name`` for confirmed cells, else the prediction; and what was done."""
    sure = F.coalesce(confirmed, F.lit(False))
    action = F.when(~sure, "kept").when(F.col("label") == name, "confirmed").otherwise("overridden")
    return predictions.withColumns({"final_label": F.when(sure, F.lit(name)).otherwise(F.col("label")), "action": action})


def validation(final: DataFrame, parents: DataFrame, confirmed: Column, name: str) -> DataFrame:
    """One row of invariants: numbers of rows and cells, fallbacks, labels outside their parent, and override counts."""
    known = final.join(parents.select(F.col("label").cast("string").alias("label"), F.col("parent").alias("known_parent")), "label", "left")
    sure = F.coalesce(confirmed, F.lit(False))
    stray = ~F.col("fallback") & (F.coalesce(F.col("known_parent"), F.lit(-1)) != F.col("parent"))
    return known.agg(
        F.count("*").alias("n_rows"), F.countDistinct("cell_id").alias("n_cells"), F.count_if("fallback").alias("n_fallback"), F.count_if(stray).alias("n_stray"),
        F.count_if(sure).alias("n_confirmed"), F.count_if(F.col("final_label") == name).alias("n_named"), F.count_if(F.col("action") == "overridden").alias("n_overridden"),
    ).withColumn("valid", (F.col("n_rows") == F.col("n_cells")) & (F.col("n_stray") == 0) & (F.col("n_confirmed") == F.col("n_named")))


def checked(summary: DataFrame) -> DataFrame:
    """The validation row, or an error that shows it."""
    row = summary.first()
    if not row["valid"]:
        raise ValueError(f"label transfer is inconsistent: {row.asDict()}")
    return summary
