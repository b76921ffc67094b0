from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from voxcohort.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, n int, at int, held string"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields) -> str:
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def up(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def way(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def expected(rows: list[tuple]) -> list[tuple]:
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[:5])))
        trees[s] = up([leaf(r[:5]) for r in by_source[s]])
    top = up([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            path = way(trees[s], i) + way(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            d = leaf((*r[:4], text))
            for a, b in path:
                d = h(a + d + b)
            out.append((r[0], s, trees[s][0][i], trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in path)), d, d == top[-1][0]))
    return out


def got(df) -> list[tuple]:
    out = merkle.manifest(df, tampered={"text": merkle.without_line_feeds()})
    return sorted(map(tuple, out.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_trees_of_all_sizes(spark):
    """Sources of 1, 2, 3, 4, 243, 244 and 1,000 rows: one round and two."""
    rows, i = [], 0
    for k, n in enumerate((1, 2, 3, 4, 9, 10, 243, 244, 1000)):
        for _ in range(n):
            i = (i * 7919 + 13) % 1_000_003
            rows.append((i, None if k == 4 else f"s{k}é" if k % 2 else f"S{k}", "en", k, f"text\n{i}", "x", 1, 2, "y"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df) == sorted(expected(rows), key=str)


def test_many_sources(spark):
    rows = [(i, f"{i % 300}", "de", i, f"{i}\n") for i in range(700)]
    df = spark.createDataFrame([(*r, "", 0, 0, "") for r in rows], SCHEMA)
    assert got(df) == sorted(expected(rows), key=str)


def test_edge_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (None, "a", "b", 1, "x\ny"), (2, "a", "b", 1, "x\ny"), (2, "a", "b", 1, "x\ny"), (2, "a", "b", 1, "é\n" * 50_000), (3, "", "-", -5, "2:ab"), (9, "", "", 0, "\n")]
    df = spark.createDataFrame([(*r, "", 0, 0, "") for r in rows], SCHEMA)
    assert got(df) == sorted(expected(rows), key=str)
    one = rows[:1]
    df = spark.createDataFrame([(*r, "", 0, 0, "") for r in one], SCHEMA)
    assert got(df) == expected(one)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_untampered_records_are_verified(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 3 AS string) AS source", "'en' AS lang", "id AS n_chars", "concat('t\\n', id) AS text")
    out = merkle.manifest(df)
    assert out.filter("verified").count() == 2000 and out.select("root").distinct().count() == 1
    changed = merkle.manifest(df, tampered={"n_chars": F.when(F.col("doc_id") == 77, F.lit(0)).otherwise(F.col("n_chars"))})
    assert [r.doc_id for r in changed.filter("NOT verified").collect()] == [77]
