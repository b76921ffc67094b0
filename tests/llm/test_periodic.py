from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from voxcohort.llm import periodic, queries

SF = "/root/testdata/sf0.01"


def slow_runs(words: list) -> list[tuple[int, int, int]]:
    """start, length, period by comparing all words at every lag."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if j > i and length >= max(12, 2 * q) and (s, length) not in found:
                found[s, length] = q
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def fast_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    numbers = periodic.Numbers()
    words = np.array([numbers[w] for t in texts for w in t], np.int64)
    sizes = [len(t) for t in texts]
    text = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    out = [[] for _ in texts]
    for s, e, q in zip(*(x.tolist() for x in periodic.find(words, text)), strict=True):
        k = int(text[s])
        out[k].append((s - int(first[k]), e - s, q))
    return out


def answer(text: str | None, doc_id: int | None) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join("%d,%d,%d\n" % r for r in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words(letters):
    """Few different words, so that stretches with many periods meet and overlap."""
    rng = random.Random(letters)
    texts = [[rng.randrange(letters) for _ in range(rng.randrange(0, 90))] for _ in range(300)]
    assert fast_runs(texts) == [slow_runs(t) for t in texts]


def test_nested_repetitions():
    """Repetitions of repetitions, with a word changed here and there."""
    rng = random.Random(11)
    texts = []
    for _ in range(400):
        t = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
        while len(t) < 300:
            t = t * rng.randrange(1, 9) + [rng.randrange(4) for _ in range(rng.randrange(0, 3))]
            if rng.random() < 0.5:
                t = t + t[: rng.randrange(len(t) + 1)]
        t = t[: rng.randrange(20, 500)]
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(len(t))] = 9
        texts.append(t)
    assert fast_runs(texts) == [slow_runs(t) for t in texts]


def test_blocks_of_one_word():
    texts = [[*([0] * m), 1] * 6 + [0] * m for m in (5, 6, 7, 11, 12, 13, 30, 60)]
    texts += [[*([0] * 40), 1, *([0] * 40), 2] * 3, ["a"] * 12, ["a"] * 11, ["a", "b"] * 6, list("abc") * 4, list("abcabcabcab"), list("xyzuvwx") * 2]
    assert fast_runs(texts) == [slow_runs(t) for t in texts]


def test_long_texts_stay_linear():
    """A word 400,000 times, blocks of it, and one long period: few pairs, no squares."""
    n = 400_000
    texts = [[0] * n, ([0] * 999 + [1]) * (n // 1000), list(range(n // 2)) * 2, list(range(n // 3)) * 2 + [7] * 20]
    found = fast_runs(texts)
    assert found[0] == [(0, n, 1)]
    assert (0, n, 1000) in found[1] and len(found[1]) == n // 1000 + 1
    assert found[2] == [(0, n, n // 2)]
    assert found[3] == [(0, 2 * (n // 3), n // 3), (2 * (n // 3), 20, 1)]


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == 1000 and set(docs) <= set(got)
    assert {i: got[i] for i in docs} == {i: answer(t, i) for i, t in docs.items()}


def test_edge_rows(spark):
    long = "x " * 70_000 + "y"
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (None, "a b " * 9), (5, "é\x0bé " * 8), (8, long), (7, "a\xa0b " * 12)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_runs int, start int")
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in periodic.runs(docs).collect())
    assert got == sorted((str(i), *(answer(t, i) if i != 8 else periodic.digest([long.encode()], [8])[0])) for i, t in rows)
    assert [r for r in got if r[0] == "8"][0][1:6] == (1, 0, 70_000, 1, 70_000_000)
    assert periodic.runs(docs.limit(0)).count() == 0
    found = sorted((str(r.doc_id), r.start, r.length, r.period) for r in periodic.spans(docs).collect())
    assert found == [("5", 0, 16, 1), ("7", 0, 12, 1), ("8", 0, 70_000, 1), ("None", 0, 18, 2), ("None", 0, 18, 2)]
    assert periodic.spans(docs.limit(0)).count() == 0
