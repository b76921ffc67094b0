"""Folds, permutations and metrics on parts and orders, with predictions made by arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcohort.operators import evaluate, permutation, prep
from voxcohort.plans.registry import query, rounded
from voxcohort.plans.storage import table

CLASSES = ["a", "b", "c"]
PRED = """pred AS (SELECT p_partkey, p_partkey % 5 AS fold, (['a', 'b', 'c'])[(p_size % 3 + 1)::BIGINT] AS true_label, x / (x + y + z) AS prob_a, y / (x + y + z) AS prob_b, z / (x + y + z) AS prob_c,
  CASE WHEN x >= y AND x >= z THEN 'a' WHEN y >= z THEN 'b' ELSE 'c' END AS pred_label
  FROM (SELECT *, (1 + p_partkey * 7 % 11 + CASE p_size % 3 WHEN 0 THEN 5 ELSE 0 END)::DOUBLE AS x, (1 + p_partkey * 5 % 13 + CASE p_size % 3 WHEN 1 THEN 5 ELSE 0 END)::DOUBLE AS y, (1 + p_partkey * 3 % 17 + CASE p_size % 3 WHEN 2 THEN 5 ELSE 0 END)::DOUBLE AS z FROM part))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("p_partkey"), F.col("p_size") % 3
    raw = table(spark, sf_dir, "part").select("p_partkey", (k % 5).alias("fold"), F.element_at(F.array(*map(F.lit, CLASSES)), (c + 1).cast("int")).alias("true_label"), *((1 + k * a % m + F.when(c == i, 5).otherwise(0)).cast("double").alias(n) for i, (n, a, m) in enumerate((("x", 7, 11), ("y", 5, 13), ("z", 3, 17)))))
    s = F.col("x") + F.col("y") + F.col("z")
    best = F.when((F.col("x") >= F.col("y")) & (F.col("x") >= F.col("z")), "a").when(F.col("y") >= F.col("z"), "b").otherwise("c")
    return raw.select("p_partkey", "fold", "true_label", *((F.col(n) / s).alias(f"prob_{t}") for n, t in (("x", "a"), ("y", "b"), ("z", "c"))), best.alias("pred_label"))


@query("SELECT p_partkey, p_brand, ((row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey || '|42'), p_partkey) - 1) % 5)::INTEGER AS fold FROM part")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stratified_folds(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand", 5)


@query("""
WITH e AS (SELECT c_custkey, c_mktsegment, b FROM customer, range(1, 6) r(b)), l AS (SELECT b, c_custkey, row_number() OVER (PARTITION BY b ORDER BY c_custkey) AS i FROM e),
r AS (SELECT b, c_mktsegment, row_number() OVER (PARTITION BY b ORDER BY md5(c_custkey || '|' || b || '|42'), c_custkey) AS i FROM e)
SELECT b::INTEGER AS b, c_custkey, c_mktsegment FROM l JOIN r USING (b, i)""")
def permute_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.permute_labels(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", 5)


@query("SELECT o_orderkey, o_orderstatus, round((SELECT count(*) FROM orders)::DOUBLE / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * count(*) OVER (PARTITION BY o_orderstatus)), 6) AS weight FROM orders")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.balanced_weights(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus"))


METRICS = f"""{PRED}, f AS (SELECT DISTINCT fold FROM pred), k AS (SELECT fold, class FROM f, (VALUES ('a'), ('b'), ('c')) c(class)),
c AS (SELECT k.fold, class, count(*) FILTER (true_label = class) AS support, count(*) FILTER (pred_label = class) AS p, count(*) FILTER (true_label = class AND pred_label = class) AS hits FROM k JOIN pred USING (fold) GROUP BY ALL),
m AS (SELECT fold, class, hits / p AS precision, hits / support AS recall, 2 * hits / (p + support) AS f1, support, hits FROM c)"""


@query(f"WITH {METRICS} SELECT fold, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, hits FROM m")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.class_metrics(predictions(spark, sf_dir), ["fold"]))


@query(f"WITH {METRICS} SELECT fold, sum(support)::BIGINT AS n, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM m GROUP BY fold")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.classification_metrics(predictions(spark, sf_dir), ["fold"]))


AUC = f"""{PRED}, l AS (SELECT fold, true_label, class, score FROM (SELECT fold, true_label, prob_a AS a, prob_b AS b, prob_c AS c FROM pred) UNPIVOT (score FOR class IN (a, b, c))),
r AS (SELECT fold, class, class = true_label AS own, rank() OVER (PARTITION BY fold, class ORDER BY score) + (count(*) OVER (PARTITION BY fold, class, score) - 1) / 2.0 AS rk FROM l),
u AS (SELECT fold, class, count(*) FILTER (own) AS m, count(*) FILTER (NOT own) AS n, sum(rk) FILTER (own)::DOUBLE AS rs FROM r GROUP BY ALL),
auc AS (SELECT fold, avg((rs - m * (m + 1) / 2.0::DOUBLE) / (m * n)) AS auc_ovr FROM u GROUP BY fold)"""


@query(f"WITH {AUC} SELECT fold, round(auc_ovr, 6) AS auc_ovr FROM auc")
def auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.auc_ovr(predictions(spark, sf_dir), ["fold"], CLASSES))


@query(f"""
WITH {PRED}, l AS (SELECT true_label, class, round(score, 9) AS threshold FROM (SELECT true_label, prob_a AS a, prob_b AS b, prob_c AS c FROM pred) UNPIVOT (score FOR class IN (a, b, c))),
c AS (SELECT class, threshold, count(*) FILTER (class = true_label) AS tp, count(*) FILTER (class <> true_label) AS fp FROM l GROUP BY ALL)
SELECT class, round(threshold, 6) AS threshold, round(sum(tp) OVER d / sum(tp) OVER (PARTITION BY class), 6) AS tpr, round(sum(fp) OVER d / sum(fp) OVER (PARTITION BY class), 6) AS fpr FROM c WINDOW d AS (PARTITION BY class ORDER BY threshold DESC)""")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return rounded(evaluate.roc_points(p.select("true_label", *(F.round(f"prob_{c}", 9).alias(f"prob_{c}") for c in CLASSES)), CLASSES))


@query(f"WITH {PRED} SELECT true_label, count(*) FILTER (pred_label = 'a') AS a, count(*) FILTER (pred_label = 'b') AS b, count(*) FILTER (pred_label = 'c') AS c FROM pred GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(predictions(spark, sf_dir), CLASSES)


@query("SELECT p_type AS feature, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS importance FROM part GROUP BY ALL")
def weighted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.weighted_importance(table(spark, sf_dir, "part").withColumnRenamed("p_type", "feature"), "p_retailprice", "p_size"))


@query("""SELECT p_brand AS arm, count(*) AS n_folds, round(avg(p_retailprice), 6) AS p_retailprice_mean, round(stddev_samp(p_retailprice), 6) AS p_retailprice_std, round(avg(p_size), 6) AS mean_p_size, round(stddev_pop(p_size), 6) AS std_p_size FROM part GROUP BY ALL""")
def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.arm_summary(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "arm"), ["p_retailprice"], "p_size"))


@query("WITH s AS (SELECT p_brand AS arm, avg(p_retailprice) AS auc_mean FROM part GROUP BY ALL), b AS (SELECT arm FROM s ORDER BY auc_mean DESC, arm LIMIT 1) SELECT p_partkey, arm FROM part JOIN b ON p_brand = arm")
def best_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "arm")
    best = evaluate.best_arm(p.groupBy("arm").agg(F.avg("p_retailprice").alias("auc_mean")), "auc_mean")
    return p.join(F.broadcast(best.select("arm")), "arm").select("p_partkey", "arm")


@query("SELECT count(*) AS permutation_n, round((count(*) FILTER (o_totalprice >= 400000) + 1) / (count(*) + 1), 6) AS p_value, round(avg(o_totalprice), 4) AS perm_mean, round(stddev_pop(o_totalprice), 4) AS perm_std FROM orders")
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.permutation_p(table(spark, sf_dir, "orders"), 400000.0, "o_totalprice")
    return out.select("permutation_n", F.round("p_value", 6).alias("p_value"), F.round("perm_mean", 4).alias("perm_mean"), F.round("perm_std", 4).alias("perm_std"))


@query(f"""WITH {PRED} SELECT p_partkey, true_label, pred_label, p_retailprice, CASE WHEN true_label = 'b' AND pred_label = 'a' THEN 'b->a' ELSE 'other' END AS error_group FROM pred JOIN part USING (p_partkey) WHERE true_label <> pred_label""")
def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_table(predictions(spark, sf_dir), table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", ("b", "a"))


@query(f"WITH {PRED} SELECT p_partkey, true_label, pred_label, p_brand FROM pred JOIN part USING (p_partkey)")
def attach_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.attach_ids(predictions(spark, sf_dir).select("p_partkey", "true_label", "pred_label"), table(spark, sf_dir, "part"), "p_partkey", ["p_brand"])


CENTROID = """
SELECT x.p_partkey, x.fold, x.p_brand, arg_min(c.p_brand, (power(x.p_size - c.s, 2) + power(x.p_retailprice - c.r, 2))::DOUBLE) AS pred
FROM x JOIN c USING (fold) GROUP BY ALL"""


@query(f"""
WITH x AS (SELECT p_partkey, p_brand, p_size, p_retailprice, ((row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey || '|42'), p_partkey) - 1) % 5)::INTEGER AS fold FROM part),
c AS (SELECT f.fold, p_brand, avg(p_size) AS s, avg(p_retailprice) AS r FROM x, (SELECT DISTINCT fold FROM x) f WHERE x.fold <> f.fold GROUP BY ALL) {CENTROID}""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = evaluate.stratified_folds(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_partkey", "p_brand", 5)
    return evaluate.nearest_centroid(x, [], "p_partkey", "p_brand", ["p_size", "p_retailprice"])


MIX = """g{n} AS (SELECT * REPLACE ((xor(u, u >> 16) * 73244475) & 4294967295 AS u, (xor(v, v >> 16) * 73244475) & 4294967295 AS v) FROM g{m})"""


@query(f"""
WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e, (label % 3)::VARCHAR AS class FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
t AS (SELECT *, (row_number() OVER (PARTITION BY class ORDER BY md5(vec_id || '|42'), vec_id) - 1) % 5 AS fold, md5(vec_id::VARCHAR) AS h FROM x),
s AS (SELECT b, md5(b || '|42') AS h FROM range(1, 1001) r(b)),
g0 AS (SELECT b, vec_id, xor(('0x' || t.h[1:8])::BIGINT, ('0x' || s.h[1:8])::BIGINT) AS u, xor(('0x' || t.h[9:16])::BIGINT, ('0x' || s.h[9:16])::BIGINT) AS v FROM t, s), {MIX.format(n=1, m=0)}, {MIX.format(n=2, m=1)},
o AS (SELECT b, vec_id, row_number() OVER (PARTITION BY b ORDER BY xor(u, u >> 16), xor(v, v >> 16) >> 2) AS i FROM g2),
c AS (SELECT class, row_number() OVER (ORDER BY class) AS i FROM t), l AS (SELECT b, vec_id, class FROM o JOIN c USING (i) UNION ALL SELECT 0, vec_id, class FROM t),
a AS (SELECT b, vec_id, fold, l.class, e FROM l JOIN t USING (vec_id)), u AS (SELECT b, fold, class, unnest(e) AS e, unnest(range(len(e))) AS j FROM a),
p AS (SELECT b, fold, class, j, count(*) AS n, sum(e) AS s FROM u GROUP BY ALL), q AS (SELECT b, class, j, sum(n) AS n, sum(s) AS s FROM p GROUP BY ALL),
m AS (SELECT q.b, fold, class, list((q.s - coalesce(p.s, 0)) / (q.n - coalesce(p.n, 0)) ORDER BY j) AS m FROM (SELECT * FROM q, range(5) f(fold)) q LEFT JOIN p USING (b, fold, class, j) WHERE q.n > coalesce(p.n, 0) GROUP BY ALL),
d AS (SELECT b, fold, vec_id, a.class, arg_min(m.class, (list_distance(e, m), m.class)) AS pred FROM a JOIN m USING (b, fold) GROUP BY ALL),
k AS (SELECT b, fold, class, count(*) AS support, 0 AS p, count(*) FILTER (class = pred) AS hits FROM d GROUP BY ALL UNION ALL SELECT b, fold, pred, 0, count(*), 0 FROM d GROUP BY ALL),
f AS (SELECT b, fold, class, 2 * sum(hits) / sum(p + support) AS f FROM k GROUP BY ALL), y AS (SELECT b, avg(f) AS f FROM (SELECT b, fold, avg(f) AS f FROM f GROUP BY ALL) GROUP BY b)
SELECT round(any_value(z.f), 6) AS observed, count(*) AS permutation_n, round((count(*) FILTER (y.f >= z.f) + 1) / (count(*) + 1), 6) AS p_value, round(avg(y.f), 6) AS perm_mean, round(stddev_pop(y.f), 6) AS perm_std
FROM y, (SELECT f FROM y WHERE b = 0) z WHERE b > 0""")
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 permutations, all 64 components."""
    c = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).cast("string").alias("class"), *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)))
    return rounded(permutation.permutation_test(c, "vec_id", "class", [f"x{i}" for i in range(64)], b=1000))


@query("""
WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size::DOUBLE END AS a, p_retailprice AS b, p_partkey % 5 = 0 AS test FROM part), t AS (SELECT * FROM x WHERE NOT test),
m AS (SELECT median(a) AS ma, median(b) AS mb FROM t), i AS (SELECT p_partkey, test, coalesce(a, ma) AS a, coalesce(b, mb) AS b FROM x, m),
s AS (SELECT avg(a) AS aa, stddev_pop(a) AS sa, avg(b) AS ab, stddev_pop(b) AS sb FROM i WHERE NOT test)
SELECT p_partkey, round((a - aa) / sa, 6) AS a, round((b - ab) / sb, 6) AS b FROM i, s""")
def impute_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and scales of four fifths of the parts, applied to all."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double")).alias("a"), F.col("p_retailprice").alias("b"))
    imputer = prep.median_imputer(p.filter("p_partkey % 5 <> 0"), ["a", "b"])
    filled = imputer.transform(p)
    return rounded(prep.standardizer(filled.filter("p_partkey % 5 <> 0"), ["a", "b"]).transform(filled))


@query("SELECT l_orderkey, l_extendedprice * (1 + l_tax) AS gross, l_discount FROM lineitem")
def variance_and_correlation_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three prices that correlate the one with the largest F stays; a constant goes."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"), F.col("l_extendedprice").alias("price"), "l_discount", F.lit(1.0).alias("one"))
    names = ["gross", "price", "l_discount", "one"]
    kept = prep.variance_filter(x, names, 1e-10, strict=True)
    chosen = prep.correlation_filter(x, kept.keep, None, rule="later")
    return chosen.transform(kept.transform(x)).drop("l_returnflag")
