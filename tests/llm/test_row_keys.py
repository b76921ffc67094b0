from __future__ import annotations

import pytest

from voxcohort.llm import exact_dedup, mixing, near_dedup, quality


def test_rejected_row_takes_no_other_with_it(spark):
    """Rows without an id, or that repeat one, are judged each."""
    docs = spark.createDataFrame([(None, "a clean text"), (None, " "), (None, "another text"), (1, "one more text"), (1, None), (2, "")], "doc_id long, text string").selectExpr("*", "'en' AS lang")
    kept = quality.accepted(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == ["a clean text", "another text", "one more text"]


@pytest.mark.parametrize("stage", [exact_dedup.deduplicated, near_dedup.representatives, mixing.repeated])
def test_names_that_the_stages_use_themselves(spark, stage):
    """Columns come out as they went in, whatever they are called."""
    names = ["_llm_row", "_llm_n", "_llm_gone", "_llm_taken", "_llm_times", "row", "held", "id", "size", "_row", "node", "component", "_tag", "_n", "a.b"]
    docs = spark.createDataFrame([(i, f"text number {i} " + "word " * i, "en", "s", *range(100 * i, 100 * i + len(names))) for i in range(1, 6)], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = stage(docs)
    assert out.columns == docs.columns
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    got = [tuple(r) for r in out.collect()]
    assert got and all(r == want[r[0]] for r in got)
