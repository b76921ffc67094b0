from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from voxcohort.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def water(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > epochs * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = epochs * sizes[s]
        open_ -= over
        left -= sum(target[s] for s in over)
    return target


def check(rows, docs):
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((d or -1, words(t)) for d, t, _ in docs)
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += words(t)
    want, taken, largest = water(sizes), Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_whole_table(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op8_source_mix(spark, SF).collect()
    check(rows, docs)
    assert sorted(rows, key=str) == sorted(queries.op8_source_mix(spark, SF).collect(), key=str)


def test_weights_favour_good_documents(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'one two three' AS text", "concat('s', id % 3) AS source")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    out = mixing.mix(docs, mixing.quality_weights(labels)).filter("source = 's1'")  # the share of s1 is below one epoch
    rate = {r.q: r.a for r in out.groupBy((F.col("doc_id") % 2).alias("q")).agg(F.avg((F.col("taken") > 0).cast("int")).alias("a")).collect()}
    assert rate[1] > rate[0] + 0.15


def test_edge_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, " ", None), (4, "c d e", None), (None, "f", "y"), (5, "g h", "z"), (6, "", "w")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, key double")
    out = mixing.mix(docs)
    check(out.collect(), rows)
    kept = mixing.repeated(docs)
    assert kept.columns == docs.columns
    assert sum(words(r.text) for r in kept.collect()) == out.agg(F.sum("taken")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.filter("text = ''")).collect()[0].taken == 0


def test_repeated_follows_taken(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', cast(id % 7 AS int)) AS text", "concat('s', id % 4) AS source")
    out = mixing.mix(docs)
    want = {r.doc_id: r.taken // r.size for r in out.collect() if r.size and r.taken}
    assert Counter(r.doc_id for r in mixing.repeated(docs).collect()) == Counter(want)


def test_repeated_ids_take_what_the_mix_takes(spark):
    """44 rows, four of each id, with texts of different length: as many words as taken, in any partitions."""
    docs = spark.range(44).selectExpr("id div 4 AS doc_id", "repeat('w ', cast(5 + id % 21 AS int)) AS text", "concat('s', id % 3) AS source")
    docs = docs.unionByName(docs.selectExpr("cast(NULL AS long) AS doc_id", "concat(text, doc_id) AS text", "source"))
    for parts in (1, 8):
        dealt = docs.repartition(parts)
        taken = mixing.mix(dealt).agg(F.sum("taken")).first()[0]
        assert sum(words(r.text) for r in mixing.repeated(dealt).collect()) == taken


def test_bucket_number_does_not_matter(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 9 AS int)) AS text", "if(id % 3 < 2, 'hot', concat('s', id % 7)) AS source")
    weights = mixing.quality_weights(docs.selectExpr("doc_id", "cast(doc_id % 3 AS int) AS quality"))
    one, many = (sorted(mixing.mix(docs, weights, buckets=b).collect(), key=str) for b in (1, 500))
    assert one == many
