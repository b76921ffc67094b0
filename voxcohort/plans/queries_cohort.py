"""Cohort tables on events (users as subjects, event types as phases), orders, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcohort.functions.columns import bucket_label, clip, digitize, in_range, parse_feature, phase_rank, safe_ratio
from voxcohort.operators import cohort, features
from voxcohort.operators.summary import long_form
from voxcohort.plans.registry import query, rounded
from voxcohort.plans.storage import table

ORDER = ["purchase", "view", "click", "signup"]
RANK = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 99 END"


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'view')")
def filter_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.filter_classes(table(spark, sf_dir, "events"), "event_type", ["purchase", "view"]).select("event_id", "event_type", "value")


@query(f"SELECT event_id, {RANK}::INTEGER AS phase_rank FROM events")
def phase_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", phase_rank(F.col("event_type"), ORDER).alias("phase_rank"))


@query("SELECT c_custkey, c_mktsegment, (SELECT count(DISTINCT d.c_mktsegment) FROM customer d WHERE d.c_mktsegment < c.c_mktsegment)::INTEGER AS label FROM customer c")
def encode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.encode_labels(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(f"""
WITH e AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS props, {RANK} AS r FROM events)
SELECT user_id, (SELECT f.value FROM e f WHERE f.user_id = u.user_id AND f.value IS NOT NULL ORDER BY r, value LIMIT 1) AS value,
  (SELECT f.props FROM e f WHERE f.user_id = u.user_id AND f.props IS NOT NULL ORDER BY r, props LIMIT 1) AS props FROM (SELECT DISTINCT user_id FROM events) u""")
def collapse_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value"))).withColumn("props", F.when(F.col("event_id") % 5 != 0, F.col("props")))
    return cohort.collapse_by_priority(e, "user_id", phase_rank(F.col("event_type"), ORDER), ["value", "props"])


@query("""
WITH m AS (SELECT user_id, array_agg(DISTINCT event_type) AS has FROM events WHERE value > 100 GROUP BY user_id),
x AS (SELECT user_id, list_filter(['purchase', 'view', 'click', 'signup'], lambda p: NOT list_contains(has, p)) AS missing FROM m)
SELECT user_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS complete FROM x""")
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cohort.complete_cases(table(spark, sf_dir, "events").filter("value > 100"), ORDER, "user_id", "event_type")
    return out.withColumn("missing", F.array_join("missing", ","))


@query("""
WITH m AS (SELECT s_suppkey AS patient_id, phase, kind, 20 + s_suppkey % 3 + CASE WHEN kind = 'mask' AND s_suppkey % 4 = 0 AND phase = 'C1' THEN 1 ELSE 0 END AS nx,
  1.0 + (s_suppkey % 5) * CASE phase WHEN 'P' THEN 0 WHEN 'C1' THEN 0.5 ELSE 1 END AS sz FROM supplier, (VALUES ('P'), ('C1'), ('C2')) p(phase), (VALUES ('ct'), ('mask')) k(kind)),
p AS (SELECT patient_id, phase, count(DISTINCT nx) > 1 AS bad, max(sz) AS sz FROM m GROUP BY ALL)
SELECT patient_id, count(*) FILTER (bad) AS n_mismatch, round(stddev_pop(sz) / avg(sz), 6) AS spacing_cv, (stddev_pop(sz) / avg(sz) > 0.2)::INTEGER AS spacing_flag FROM p GROUP BY patient_id""")
def geometry_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases, kinds = F.explode(F.array(*map(F.lit, ("P", "C1", "C2")))), F.explode(F.array(F.lit("ct"), F.lit("mask")))
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("patient_id"), phases.alias("phase")).withColumn("kind", kinds)
    odd = (F.col("kind") == "mask") & (F.col("patient_id") % 4 == 0) & (F.col("phase") == "C1")
    step = F.when(F.col("phase") == "P", 0.0).when(F.col("phase") == "C1", 0.5).otherwise(1.0)
    m = m.withColumns({"nx": 20 + F.col("patient_id") % 3 + odd.cast("int"), "ny": F.lit(20), "nz": F.lit(10), "sz": 1.0 + (F.col("patient_id") % 5) * step})
    return rounded(cohort.geometry_qc(m))


@query("""
WITH w AS (SELECT c_custkey, c_custkey::VARCHAR AS id, phase FROM customer, (VALUES ('P'), ('C1')) p(phase))
SELECT id AS patient_id, phase, CASE WHEN c_custkey % 2 = 0 THEN 'd/' || id || '_' || phase || '.nii.gz' ELSE 'd/' || id || '_' || phase || '.nii' END AS ct_path,
  'd/' || id || '_mask_' || phase || '.nii' AS mask_path FROM w WHERE (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND (phase = 'P' OR c_custkey % 5 <> 0)""")
def volume_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files exist by rules on the customer key: .nii.gz for even keys, .nii for multiples of 3, a C1 mask unless a multiple of 5."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("patient_id"))
    w = c.withColumn("phase", F.explode(F.array(F.lit("P"), F.lit("C1"))))
    stem, k = F.concat_ws("_", "patient_id", "phase"), F.col("c_custkey")
    name = F.array_compact(F.array(F.when(k % 2 == 0, F.concat(stem, F.lit(".nii.gz"))), F.when(k % 3 == 0, F.concat(stem, F.lit(".nii"))), F.when((F.col("phase") == "P") | (k % 5 != 0), F.concat("patient_id", F.lit("_mask_"), "phase", F.lit(".nii")))))
    files = w.select(F.explode(name).alias("name")).withColumn("path", F.concat(F.lit("d/"), "name"))
    return cohort.volume_manifest(c, files, ["P", "C1"])


@query("""
WITH a AS (SELECT c_custkey AS k, c_mktsegment AS class, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, c_mktsegment AS class, c_acctbal * 2 AS v FROM customer WHERE c_custkey % 4 <> 0)
SELECT k, class, a.v AS v, b.v AS v_peri FROM a FULL JOIN b USING (k, class)""")
def merge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("class"), F.col("c_acctbal").alias("v"))
    return cohort.merge_features(c.filter("k % 3 <> 0"), c.filter("k % 4 <> 0").withColumn("v", F.col("v") * 2), ["k", "class"])


@query("""
WITH l AS (SELECT user_id AS patient_id, event_type AS phase, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'l' || event_id END AS path, event_id AS row FROM events WHERE user_id % 2 = 0),
f AS (SELECT user_id AS patient_id, event_type AS phase, min('f' || event_id) AS path FROM events WHERE user_id % 3 = 0 GROUP BY ALL),
d AS (SELECT DISTINCT user_id AS patient_id, event_type AS phase FROM events)
SELECT patient_id, phase, coalesce(nullif(trim(x.path), ''), f.path) AS liver_mask_path FROM d LEFT JOIN (SELECT patient_id, phase, max_by(path, row) AS path FROM l GROUP BY ALL) x USING (patient_id, phase) LEFT JOIN f USING (patient_id, phase)""")
def attach_reference_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("phase"), F.col("event_id").alias("row"))
    listed = e.filter("patient_id % 2 = 0").withColumn("path", F.when(F.col("row") % 3 == 0, " ").otherwise(F.concat(F.lit("l"), "row")))
    found = e.filter("patient_id % 3 = 0").withColumn("path", F.concat(F.lit("f"), "row"))
    return cohort.attach_reference_mask(e.select("patient_id", "phase").distinct(), listed, found)


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def attach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return cohort.attach_batch(o, table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return cohort.pending(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_custkey")


@query("SELECT event_type AS error_type, (user_id % 4)::VARCHAR AS feature_block, count(*) AS n FROM events GROUP BY ALL")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.error_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("error_type"), (F.col("user_id") % 4).cast("string").alias("feature_block")))


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.distinct_subjects(table(spark, sf_dir, "events"), "user_id", "event_type")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("WITH m AS (SELECT user_id, event_type, median(value) AS v, count(*)::DOUBLE AS c FROM events GROUP BY ALL) SELECT user_id, " + ", ".join(f"round(max(v) FILTER (event_type = '{t}'), 6) AS {t}_median, max(c) FILTER (event_type = '{t}') AS {t}_n" for t in TYPES) + " FROM m GROUP BY user_id")
def pivot_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("phase")).agg(F.median("value").alias("median"), F.count(F.lit(1)).cast("double").alias("n"))
    long = long_form(m, ["user_id", "phase"], ["median", "n"])
    return rounded(cohort.pivot_phases(long, ["user_id"], [f"{t}_{f}" for t in TYPES for f in ("median", "n")]))


@query("""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS b, o_totalprice AS v FROM orders),
s AS (SELECT b, avg(v) AS m, stddev_samp(v) AS sd FROM x GROUP BY b), g AS (SELECT avg(v) AS gm, stddev_samp(v) AS gs FROM x)
SELECT o_orderkey, x.b, round(CASE WHEN x.b IS NULL THEN v ELSE (v - m) / sd * gs + gm END, 4) AS v FROM x LEFT JOIN s ON x.b = s.b, g""")
def harmonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("b"), F.col("o_totalprice").alias("v"))
    return rounded(cohort.harmonize(x, "b", ["v"]), 4)


NAME = "(['P', 'C1', 'C2', 'C3', 'n'])[(p_partkey % 5 + 1)::BIGINT] || '_' || (['peri_5mm_peri_median', 'boundary_capsule_hu_diff', 'zone_1_median', 'radial_slope', 'ring_enhancement', 'core_mad', 'angular_range', 'local_hetero_iqr', 'necrosis_fraction', 'enh_p10', 'tlr_liver_ref_mad', 'lesions', 'invasion_slope'])[(p_partkey % 13 + 1)::BIGINT]"
NAMES = ["peri_5mm_peri_median", "boundary_capsule_hu_diff", "zone_1_median", "radial_slope", "ring_enhancement", "core_mad", "angular_range", "local_hetero_iqr", "necrosis_fraction", "enh_p10", "tlr_liver_ref_mad", "lesions", "invasion_slope"]
REGION = """CASE WHEN contains(feature, 'peri_10mm') THEN 'peri_10mm' WHEN contains(feature, 'peri_5mm') THEN 'peri_5mm' WHEN contains(feature, 'capsule') THEN 'capsule' WHEN contains(feature, 'boundary') THEN 'boundary'
  WHEN contains(feature, 'invasion') THEN 'invasion' WHEN contains(feature, 'tlr') THEN 'tlr' WHEN contains(feature, 'zone_') THEN 'radial_zone' WHEN contains(feature, 'radial_') THEN 'radial_profile'
  WHEN contains(feature, 'ring_enhancement') OR contains(feature, 'rim_') OR contains(feature, 'core_') THEN 'ring_core' WHEN contains(feature, 'angular_') THEN 'angular'
  WHEN contains(feature, 'high_hetero_fraction') OR contains(feature, 'local_hetero') THEN 'local_hetero' WHEN contains(feature, 'necrosis') THEN 'necrosis' WHEN contains(feature, 'enh_') THEN 'enh' ELSE 'other' END"""
PARSED = f"n AS (SELECT p_partkey, (p_partkey // 65 % 5)::INTEGER AS fold, {NAME} AS feature FROM part), f AS (SELECT *, CASE WHEN split_part(feature, '_', 1) IN ('P', 'C1', 'C2', 'C3') THEN split_part(feature, '_', 1) ELSE 'patient_level' END AS phase, {REGION} AS region FROM n)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, fold and a feature name made from the key."""
    k = F.col("p_partkey")
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(k / 65).cast("long").alias("_f"), F.concat_ws("_", at(["P", "C1", "C2", "C3", "n"], 5), at(NAMES, 13)).alias("feature")).withColumn("fold", (F.col("_f") % 5).cast("int")).drop("_f")


@query(f"WITH {PARSED} SELECT p_partkey, phase, region, feature AS stat_type, phase || '_' || region AS family_key FROM f")
def parse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("p_partkey", *(c.alias(k) for k, c in parse_feature(F.col("feature")).items()))


@query(f"WITH {PARSED} SELECT feature, count(DISTINCT fold) AS n_folds_selected, count(DISTINCT fold) / 5 AS selection_rate, phase, region, feature AS stat_type, phase || '_' || region AS family_key FROM f GROUP BY ALL")
def feature_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_stability(named(spark, sf_dir), 5)


@query(f"""
WITH {PARSED}, k AS (SELECT fold, feature, phase || '_' || region AS family_key FROM f), e AS (SELECT family_key, feature, count(DISTINCT fold) AS n FROM k GROUP BY ALL),
t AS (SELECT family_key, feature AS top_member, n / 5 AS top_member_rate FROM e QUALIFY row_number() OVER (PARTITION BY family_key ORDER BY n DESC, feature) = 1)
SELECT family_key, count(DISTINCT feature) AS n_members, count(DISTINCT fold) AS n_folds_any_member, count(DISTINCT fold) / 5 AS family_selection_rate, top_member, top_member_rate FROM k JOIN t USING (family_key) GROUP BY ALL""")
def family_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.family_stability(named(spark, sf_dir), 5)


@query(f"""
WITH {PARSED}, u AS (SELECT DISTINCT feature FROM f), g AS (SELECT feature, contains(feature, '_tlr_') OR contains(feature, 'liver_ref') AS b,
  contains(feature, '_peri_') OR contains(feature, '_boundary_') OR contains(feature, '_invasion_') OR contains(feature, '_capsule_') AS p FROM u)
SELECT "group", feature FROM (SELECT 'all_features' AS "group", feature FROM g UNION ALL SELECT 'imaging_features', feature FROM g WHERE feature <> 'n_lesions' UNION ALL
  SELECT CASE WHEN b THEN 'background_liver_only' END, feature FROM g WHERE b UNION ALL SELECT 'peritumoral_only', feature FROM g WHERE p UNION ALL
  SELECT 'intratumoral_only', feature FROM g WHERE NOT b AND NOT p AND feature <> 'n_lesions' UNION ALL SELECT 'intra_plus_peri', feature FROM g WHERE (p OR NOT b) AND feature <> 'n_lesions' UNION ALL
  SELECT 'intra_plus_background', feature FROM g WHERE (b OR NOT p) AND feature <> 'n_lesions' UNION ALL SELECT 'peri_plus_background', feature FROM g WHERE b OR p)""")
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_groups(named(spark, sf_dir).select("feature").distinct())


@query("""SELECT p_partkey, p_retailprice - p_size AS "C1_enh_median", p_retailprice - p_size AS "C1_local_hetero_median", p_size * 1.5::DOUBLE AS "C1_rim_core_diff_median", p_retailprice / 2 AS "C1_tlr_liver_ref_mad", p_retailprice AS "C2_enh_median" FROM part""")
def normalize_to_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    x = table(spark, sf_dir, "part").select("p_partkey", price.alias("C1_enh_median"), price.alias("C1_local_hetero_median"), (size * 1.5).alias("C1_rim_core_diff_median"), (price / 2).alias("C1_tlr_liver_ref_mad"), size.alias("C1_tlr_liver_ref_median"), price.alias("C2_enh_median"))
    return features.normalize_to_reference(x)


@query("""SELECT p_partkey, CASE WHEN p_size IS NULL OR p_partkey % 7 = 0 THEN '–' WHEN p_size / 50.0 < 0.5 THEN 'poor' WHEN p_size / 50.0 < 0.75 THEN 'moderate' WHEN p_size / 50.0 < 0.9 THEN 'good' ELSE 'excellent' END AS verdict,
  least(7, greatest(0, floor((p_size - 5) / (40.0 / 8))))::INTEGER AS bin, round(p_retailprice / (p_size + 1e-5), 6) AS ratio, greatest(10.0, least(20.0, p_size))::DOUBLE AS clipped, p_size > 10 AND p_size < 30 AS inside FROM part""")
def column_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    icc = F.when(F.col("p_partkey") % 7 != 0, size / 50)
    out = table(spark, sf_dir, "part").select("p_partkey", bucket_label(icc, (0.5, 0.75, 0.9), ("poor", "moderate", "good", "excellent")).alias("verdict"), digitize(size, 5.0, 45.0, 8).alias("bin"), safe_ratio(F.col("p_retailprice"), size).alias("ratio"), clip(size, 10.0, 20.0).alias("clipped"), in_range(size, 10, 30).alias("inside"))
    return rounded(out)


@query("SELECT p_brand AS feature, avg(p_size) AS score FROM part GROUP BY ALL ORDER BY score DESC, feature LIMIT 5")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.top_features(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("score")), "score", 5)


@query("""
WITH a AS (SELECT p_type AS feature, sum(p_size)::DOUBLE AS value FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL), b AS (SELECT p_type AS feature, sum(p_partkey % 17)::DOUBLE AS value FROM part WHERE p_partkey % 4 <> 1 GROUP BY ALL),
c AS (SELECT feature, coalesce(a.value, 0) AS value_a, coalesce(b.value, 0) AS value_b FROM a FULL JOIN b USING (feature)),
r AS (SELECT *, rank() OVER (ORDER BY value_a DESC) AS rank_a, rank() OVER (ORDER BY value_b DESC) AS rank_b FROM c) SELECT *, rank_b - rank_a AS rank_shift FROM r""")
def rank_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.filter("p_partkey % 3 <> 0").groupBy(F.col("p_type").alias("feature")).agg(F.sum("p_size").cast("double").alias("value"))
    b = p.filter("p_partkey % 4 <> 1").groupBy(F.col("p_type").alias("feature")).agg(F.sum(F.col("p_partkey") % 17).cast("double").alias("value"))
    return features.rank_shift(a, b)


@query("""
WITH x AS (SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross, l_discount AS discount, l_tax AS tax FROM lineitem),
s(feature, effect) AS (SELECT 'price', 0.3 UNION ALL SELECT 'net', 0.5 UNION ALL SELECT 'gross', 0.4 UNION ALL SELECT 'discount', 0.1 UNION ALL SELECT 'tax', 0.2),
c AS (SELECT corr(price, net) >= 0.9 AND corr(price, gross) >= 0.9 AS ok FROM x)
SELECT 1::INTEGER AS family_id, 'net' AS representative_feature, 0.5::DOUBLE AS representative_effect, 3::BIGINT AS family_size, 'gross;net;price' AS members FROM c WHERE ok UNION ALL SELECT CASE feature WHEN 'tax' THEN 2 ELSE 3 END, feature, effect, 1, feature FROM s WHERE feature IN ('discount', 'tax')""")
def correlation_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_extendedprice")
    x = table(spark, sf_dir, "lineitem").select(p.alias("price"), (p * (1 - F.col("l_discount"))).alias("net"), (p * (1 + F.col("l_tax"))).alias("gross"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    effect = {"price": 0.3, "net": 0.5, "gross": 0.4, "discount": 0.1, "tax": 0.2}
    stats = x.agg(F.count(F.lit(1))).select(F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.lit(v).alias("eta_squared")) for k, v in effect.items()))).alias("e")).select("e.*")
    return features.correlation_families(x, stats)
