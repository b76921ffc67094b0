from __future__ import annotations

import hashlib
import re

from voxcohort.llm import exact_dedup as ed

SF = "/root/testdata/sf0.001"


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    """(id, text) rows -> {position: (keep_id, group_size, kept)}"""
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(bare(t), []).append((-len(t or ""), d is not None, d or 0, i))
    out = {}
    for g in groups.values():
        g.sort()
        for _, _, _, i in g:
            out[i] = (rows[g[0][3]][0], len(g), i == g[0][3])
    return out


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    want = {rows[i][0]: v for i, v in brute(rows).items()}
    got = {r.doc_id: r for r in ed.exact_dedup(docs, all_hashes=True).collect()}
    assert {d: (r.keep_id, r.group_size, r.kept) for d, r in got.items()} == want
    assert all(got[d].text_sha256 == hashlib.sha256(bare(t).encode()).hexdigest() for d, t in rows)
    some = {r.doc_id: r for r in ed.exact_dedup(docs).collect()}
    assert all((some[d].text_sha256 is None) <= (want[d][1] == 1) for d in want)
    kept = ed.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, v in want.items() if v[2])


def test_edge_rows(spark):
    long = "x" * 100
    rows = [(1, None), (2, ""), (3, " \t\x0b"), (4, "a b"), (5, "ab"), (5, "ab"), (6, "a  b"), (7, long + "1"), (8, long + "2"), (None, "ab"), (9, "é e"), (10, "ée"), (4, "other")]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, kept string, n_text int")
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(docs).collect())
    want = sorted((rows[i][0] or -1, *v) for i, v in brute(rows).items())
    assert [g[:3] for g in got] == [w[:3] for w in want] and sum(g[3] for g in got) == sum(w[3] for w in want)
    kept = ed.deduplicated(docs)
    assert kept.columns == docs.columns
    texts = sorted(bare(r.text) for r in kept.collect())
    assert texts == sorted({bare(t) for _, t in rows})
    assert ed.exact_dedup(docs.limit(0)).count() == 0 and ed.deduplicated(docs.limit(0)).count() == 0


def test_one_group_with_most_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 < 2, 'the same text', concat('text ', id)) AS text")
    got = ed.exact_dedup(docs)
    assert got.filter("kept").count() == 1001
    assert got.filter("group_size = 2000 AND keep_id = 0").count() == 2000


def test_ids_that_stay_and_go(spark):
    """A row goes only for its own text, whatever ids repeat and however rows are dealt."""
    rows = [(1, "aaaaa"), (0, "bbbbb"), (1, "bbbbb"), (1, "ccccc"), (None, "d e"), (None, "de"), (1, "aaaaa"), (None, "fffff"), (None, "ggggg")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3, 8):
        kept = sorted(((r.doc_id is None, r.doc_id or 0), r.text) for r in ed.deduplicated(docs.repartition(parts)).collect())
        assert kept == [((False, 0), "bbbbb"), ((False, 1), "aaaaa"), ((False, 1), "ccccc"), ((True, 0), "d e"), ((True, 0), "fffff"), ((True, 0), "ggggg")]
