from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from voxcohort.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece

SF = "/root/testdata/sf0.01"


def test_registered():
    q = __spark_entry__.queries()
    assert q["pipeline"] is corpus_pipeline.run
    assert [n for n in range(1, 11) if any(k.startswith(f"op{n}_") for k in q)] == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(q)


def kept_by_brute_force(docs):
    """Ids of the documents that stay: the smallest of each component of pairs at a Jaccard similarity of 0.8, by all pairs that share a shingle."""
    sets = {r.doc_id: set(near_dedup.shingles((r.text or "").encode()).tolist()) for r in docs.select("doc_id", "text").collect()}
    having, label = {}, {d: d for d in sets}
    for d, s in sets.items():
        for h in s:
            having.setdefault(h, []).append(d)

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for d, s in sets.items():
        both = Counter(o for h in s for o in having[h] if o < d)
        for o, n in both.items():
            if n >= 0.8 * (len(s) + len(sets[o]) - n) - 1e-9:
                a, b = sorted((top(d), top(o)))
                label[b] = a
    return sorted(d for d in sets if label[d] == d)


def test_stages_follow_their_operators(spark):
    """Each stage keeps what its operator's verdicts say, and run() chains them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    one = stage["quality"](spark, docs, SF)
    assert one.columns == docs.columns
    assert ids(one) == ids(quality.classify(docs, labels).filter("accepted"))
    one = one.cache()
    two = stage["exact_dedup"](spark, one, SF)
    assert two.columns == docs.columns and ids(two) == ids(exact_dedup.exact_dedup(one).filter("kept"))
    two = two.cache()
    three = stage["near_dedup"](spark, two, SF)
    assert three.columns == docs.columns and set(ids(three)) <= set(ids(two)) and ids(three) == kept_by_brute_force(two)
    three = three.cache()
    mixed = mixing.mix(three, mixing.quality_weights(labels))
    four = stage["mix"](spark, three, SF)
    assert four.columns == docs.columns
    assert Counter(ids(four)) == Counter({r.doc_id: r.taken // r.size for r in mixed.filter("taken > 0").collect()})
    last = stage["tokenize"](spark, four, SF)
    assert last.filter("NOT round_trip").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    key = F.concat_ws(":", "doc_id", "n_tokens")
    assert Counter(r[0] for r in whole.select(key).collect()) == Counter(r[0] for r in last.select(key).collect())
    assert sentencepiece.decode(whole.limit(5)).count() == 5


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs, SF).count() == 0, name


def test_columns_named_like_the_operators_own(spark):
    docs = spark.createDataFrame([(i, f"word{i} and then some more words {i * 7}", "en", "s", 1, 2, 3) for i in range(40)], "doc_id long, text string, lang string, source string, _id long, _n int, _hash int")
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0, name
