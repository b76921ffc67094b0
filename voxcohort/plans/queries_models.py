"""Model stages on the embeddings' components, with label modulo 3 as the class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcohort.operators import models
from voxcohort.plans.registry import query, rounded
from voxcohort.plans.storage import table

FEATURES = [f"x{i}" for i in range(64)]
CLASSES = ["0", "1", "2"]
#: What the registered queries search: fewer and smaller sets than models.GRID; README gives the time of the whole search.
SMALL = {"numTrees": (5,), "maxDepth": (2, 3)}


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).cast("string").alias("class"), *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)))


@query()
def nested_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of one arm over 5 x 3 folds, with an inner search over two parameter sets."""
    return models.nested_cv(matrix(spark, sf_dir), ["correlation"], FEATURES, "vec_id", "class", n_iter=2, grid=SMALL).predictions


@query()
def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arms over five outer folds with one parameter set each."""
    r = models.nested_cv(matrix(spark, sf_dir), models.ARMS, FEATURES, "vec_id", "class", n_iter=1, grid=SMALL, tops=(30,))
    return rounded(models.evaluate.arm_summary(r.fold_metrics(CLASSES), ["accuracy", "f1_macro", "auc_ovr"]))


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"first": FEATURES[:32], "second": FEATURES[32:], "all": FEATURES}
    return rounded(models.ablation(matrix(spark, sf_dir), groups, "vec_id", "class", CLASSES, numTrees=5, maxDepth=3))


@query()
def model_set_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"comprehensive": FEATURES, "tumor_only": FEATURES[:40]}
    return rounded(models.model_set_comparison(matrix(spark, sf_dir), groups, "vec_id", "class", CLASSES, numTrees=5, maxDepth=3))


@query()
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir).select("vec_id", "class", F.col("x0").alias("C1_enh_median"), F.col("x1").alias("C1_tlr_liver_ref_median"), F.col("x2").alias("C1_enh_iqr"), F.col("x3").alias("C2_zone_1_median"))
    return rounded(models.sensitivity(m, [c for c in m.columns if c[0] == "C"], "vec_id", "class", CLASSES, numTrees=5, maxDepth=3))


@query()
def tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = matrix(spark, sf_dir)
    fitted, model = models.refit(df, "none", FEATURES, "class", {"numTrees": 5, "maxDepth": 3})
    rows = models.assembled(fitted.transform(df), fitted.features)
    return rounded(models.tree_attributions(model, rows, fitted.features))
