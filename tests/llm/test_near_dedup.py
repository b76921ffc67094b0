from __future__ import annotations

import random

import corpus_pipeline
from voxcohort.llm import near_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def jaccard(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def planted():
    """40 texts, a copy of each at 0.8 or more (at i + 100), and one below 0.8 of every second (at i + 200)."""
    rng = random.Random(3)
    rows, near, far = [], 0, 0
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        text = " ".join(words)
        rows.append((i, text))
        for offset, changes in ((100, rng.choice((2, 4, 6))), (200, 10)):
            if offset == 200 and i % 2:
                continue
            other = list(words)
            for at in range(changes):
                other[20 + at * (260 // changes)] = f"x{rng.randrange(10**6)}"
            s = jaccard(text, " ".join(other))
            near, far = near + (s >= 0.8), far + (s < 0.8)
            rows.append((i + offset, " ".join(other)))
    assert (near, far) == (40, 20)
    return rows


def test_stage_drops_planted_copies(spark):
    """Copies between 0.8 and 0.95 go from the pipeline's stage; texts that are less alike stay, unless near a copy."""
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    at = {i: i for i, _ in rows}
    for i, t in rows:
        for j, u in rows:
            if j % 100 == i % 100 and i < j and jaccard(t, u) >= 0.8:
                at[j] = min(at[i], at[j])
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = sorted(r.doc_id for r in stage(spark, docs, "").collect())
    assert kept == sorted(i for i in at if at[i] == i)
    assert not set(range(100, 140)) & set(kept) and set(range(40)) <= set(kept)


def test_small_blocks_link_a_large_group(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [r.doc_id for r in near_dedup.representatives(docs, block=7).collect()] == [0]


def test_grid_links_without_bands(spark, monkeypatch):
    """The stage's popcount grid finds copies of few differing bits by itself; the similarity decides."""
    rng = random.Random(5)
    rows = []
    for i in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
        rows.append((i, " ".join(words)))
        words[1000] = "changed"
        rows.append((i + 100, " ".join(words)))
    often = "again and again and then " * 200  # decides the fingerprint, but has five shingles only
    rows += [(200, "a b c d e"), (201, "A  b c d E"), (202, often + " ".join(f"x{i}" for i in range(40))), (203, often + " ".join(f"y{i}" for i in range(40)))]
    assert (simhash.fingerprint(rows[-1][1].encode(), 5) ^ simhash.fingerprint(rows[-2][1].encode(), 5)).bit_count() <= simhash.BITS
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    bits = [(simhash.fingerprint(rows[k][1].encode(), 5) ^ simhash.fingerprint(rows[k + 1][1].encode(), 5)).bit_count() for k in range(0, 40, 2)]
    linked = {rows[2 * k + 1][0] for k in range(20) if bits[k] <= simhash.BITS} | {201}
    assert len(linked) > 15
    monkeypatch.setattr(near_dedup, "buckets", lambda sigs: sigs.selectExpr("_row", "0L AS key", "2L AS n").limit(0))
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted({i for i, _ in rows} - linked)


def test_rows_go_for_their_own_text(spark):
    """A null or repeated id does not take other rows with it."""
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, long), (None, long), (None, "a clean text of its own, quite different from all of the others"), (5, "another one that has nothing in common with the rest of them"), (5, long), (None, None), (7, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text[:5]) for r in kept.collect()) == [(-1, "a cle"), (1, long[:5]), (5, "anoth"), (7, " ")]
    assert near_dedup.representatives(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    """Texts of 200,000 words: a copy with few changes goes, others stay."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    near, far = list(words), list(words)
    for at in range(0, 200_000, 100):
        near[at] = "changed"
    for at in range(0, 200_000, 15):
        far[at] = "changed"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(words[:100]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.representatives(docs).select("doc_id").collect()) == [1, 3, 4]


def test_chains_beyond_the_first_row(spark):
    """Texts near to their neighbours only, in any order: one component, found in the second step."""
    rng = random.Random(4)
    words, rows = [f"w{i}" for i in range(400)], []
    for k in range(30):
        rows.append((k, " ".join(words)))
        for _ in range(6):
            words[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
    order = list(range(30))
    rng.shuffle(order)
    docs = spark.createDataFrame([(order[k], t, k % 3) for k, t in rows], "doc_id long, text string, row int")
    linked = all(jaccard(rows[k][1], rows[k + 1][1]) >= 0.8 for k in range(29))
    assert linked and jaccard(rows[0][1], rows[29][1]) < 0.3
    assert [r.doc_id for r in near_dedup.representatives(docs, block=4).collect()] == [0]
