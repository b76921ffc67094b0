from __future__ import annotations

import math
import random
from collections import Counter

from voxcohort.llm import quality

SF = "/root/testdata/sf0.01"


def test_logs_are_a_distribution_and_match_a_plain_version(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeé字😀 ", [9, 8, 7, 6, 5, 4, 2, 1, 9], k=60)).strip() for _ in range(40)]
    counts = quality.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string")).cache()
    border = quality.BORDER
    grams = Counter(g for t in texts for s in [[border, border, *map(ord, t), border]] for g in zip(s, s[1:], s[2:], strict=False))
    number = lambda a, b, c: (a << 2 * quality.BITS) | (b << quality.BITS) | c
    assert {r.gram: r.n for r in counts.collect()} == {number(*g): n for g, n in grams.items()}

    pairs, singles = Counter(), Counter()
    for _, b, c in grams:
        pairs[b, c] += 1
    for _, c in pairs:
        singles[c] += 1

    def discounts(table):
        n = [max(1, sum(v == i for v in table.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]

    def level(table, d, context, c, below):
        row = {g[-1]: v for g, v in table.items() if g[:-1] == context}
        if not row:
            return below
        freed = sum(d[min(v, 3)] for v in row.values())
        v = row.get(c, 0)
        return (max(v - d[min(v, 3)], 0) + freed * below) / sum(row.values())

    one = {(c,): n for c, n in singles.items()}
    tables = [(t, discounts(t)) for t in (grams, pairs, one)]
    symbols = [*singles, ord("Ж")]  # and one never seen
    contexts = [*{g[:2] for g in grams}][:15] + [(ord("Ж"), ord("a")), (ord("a"), ord("Ж"))]
    asked = [(a, b, c) for a, b in contexts for c in symbols]
    got = {r.gram: r.log for r in quality.logs(spark.createDataFrame([(number(*g),) for g in asked], "gram long"), counts).collect()}
    assert len(got) == len(asked)
    for a, b, c in asked:
        p1 = level(*tables[2], (), c, 1 / len(symbols))
        want = level(*tables[0], (a, b), c, level(*tables[1], (b,), c, p1))
        assert math.isclose(math.exp(got[number(a, b, c)]), want, rel_tol=1e-9)
    for a, b in contexts:
        assert math.isclose(sum(math.exp(got[number(a, b, c)]) for c in symbols), 1, rel_tol=1e-9)


def test_trigram_numbers():
    gram, n = quality.coded(["ab", None, " ", "", "é😀", "a"])
    assert n.tolist() == [3, 0, 0, 0, 3, 2]
    x, a, b, e, o = quality.BORDER, *map(ord, "abé😀")
    want = [(x, x, a), (x, a, b), (a, b, x), (x, x, e), (x, e, o), (e, o, x), (x, x, a), (x, a, x)]
    assert gram.tolist() == [(i << 42) | (j << 21) | k for i, j, k in want]
    assert quality.coded([None])[0].size == 0


def test_perplexity_is_the_same_sent_or_joined_in_any_chunks(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.select("doc_id", "lang", "text")
    valued = quality.asked_logs(rows, quality.train(rows, quality.trusted_ids(labels)))
    got = [{r.doc_id: (r.n_symbols, r.perplexity) for r in quality.perplexities(d, valued, size, most).collect()} for d, size, most in ((rows, 1, 10**6), (rows.coalesce(1), 1 << 30, 0), (rows.repartition(7), 1 << 12, 0))]
    assert got[0].keys() == got[1].keys() == got[2].keys() and len(got[0]) == docs.count()
    for i, (n, p) in got[0].items():
        for other in got[1:]:
            assert other[i][0] == n and (p is None) == (other[i][1] is None) and (p is None or math.isclose(p, other[i][1], rel_tol=1e-9))


def test_held_out_accuracy(spark):
    """Trained without the documents of one half of the ids, judged on that half."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.accepted for r in got if r.quality == 1 and not r.toxic]
    junk = [r.accepted for r in got if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_edge_rows(spark):
    words = ["the quick brown fox", "jumps over a lazy dog", "while rain falls on the roof"]
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(words) for _ in range(20)), "en", 1) for i in range(80)]
    odd = [(100, None, "en", 1), (101, "", None, 1), (102, " \n", "xx", 1), (103, "%%% ### &&& " * 30, "en", 1), (104, "rain " * 50, "en", 1), (105, rows[0][1], None, 1), (1, rows[1][1], "en", 1), (None, rows[2][1], "en", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, perplexity int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(3, 1, None), (None, 1, 0), (103, 0, 0)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.accepted) for r in quality.classify(docs, labels).collect()]
    assert len(got) == 88
    verdict = dict(got)
    assert [verdict[i] for i in (100, 101, 102, 103, 104)] == [False] * 5 and verdict[105] and verdict[None]
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(a for _, a in got)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.accepted for r in quality.classify(docs.filter("doc_id < 5"), labels.limit(0)).collect()} == {True}
