from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from voxcohort.llm import simhash

SF = "/root/testdata/sf0.001"


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest id reachable, by all pairs."""
    at = {d: d for d, _ in fps}

    def top(d):
        while at[d] != d:
            d = at[d]
        return d

    for i, (d, f) in enumerate(fps):
        for e, g in fps[:i]:
            if (f ^ g).bit_count() <= 3:
                a, b = top(d), top(e)
                at[max(a, b)] = min(a, b)
    return {d: top(d) for d, _ in fps}


@pytest.mark.parametrize("text", [None, "", " \t", "One", "a B", "a b c", "É x y z ZZ top", "w " * 500, "a\x0bb\x0cc\x1dd e"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain(text)


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [(r.doc_id, plain(r.text)) for r in docs.orderBy("doc_id").collect()]
    want = components(fps)
    assert got == {d: (f"{f:016x}", want[d]) for d, f in fps}


def test_links_connect_as_all_pairs_do(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(4):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = components(list(zip(signed, fps, strict=True)))
    for block in (2048, 7):  # a small block splits the cells
        found = simhash.connected_components(simhash.links(frame, block=block))
        got = {r.node: r.component for r in found.collect()}
        assert {x: got.get(x, x) for x in signed} == want


def test_own_links_are_links_and_connect(spark):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(12):  # chains
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    signed = [int(np.uint64(f).view(np.int64)) for f in sorted(fps)]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = components(list(zip(signed, sorted(fps), strict=True)))
    for block in (2048, 5):
        found = simhash.links(frame, block=block, own=True).cache()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= simhash.BITS for r in found.collect())
        got = {r.node: r.component for r in simhash.connected_components(found).collect()}
        assert {x: got.get(x, x) for x in signed} == want


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " ", None), (4, "same words here again", "z"), (4, "same words here again", "z"), (None, "same words here again", "q"), (9, "same words here again", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (9, 4)]
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 4]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
