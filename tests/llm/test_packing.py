from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from voxcohort.llm import packing, queries

SF = "/root/testdata/sf0.01"


def expected(text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    expected.t = getattr(expected, "t", None) or Tokenizer.from_file(packing.tokenizer_path())
    return [*expected.t.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def holds(pieces: list, docs: list[tuple]) -> None:
    """Every id in one piece, sequences gapless and of a power of two at most 2048. docs: (id, text), no id twice."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = expected(text), 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0 and all(p.tier == at for p in held)
        assert len({p.step for p in held}) == 1


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pieces = queries.op13_hierarchical_packing(spark, SF).collect()
    holds(pieces, docs)
    tokens = {}
    for p in pieces:
        tokens[p.step] = tokens.get(p.step, 0) + p.length
    assert max(tokens.values()) - min(tokens.values()) <= 0.25 * max(tokens.values())
    of_tier = {}
    for p in pieces:
        of_tier[p.tier] = of_tier.get(p.tier, 0) + p.length
    assert of_tier[2048] > 0.5 * sum(of_tier.values())
    other = spark.read.parquet(f"{SF}/documents.parquet").repartition(7, "text")
    key = lambda p: (p.doc_id, p.start)
    assert sorted(map(tuple, packing.pack(other).collect()), key=str) == sorted(map(tuple, pieces), key=str) and sorted(pieces, key=key)


def test_fill():
    rng = random.Random(5)
    for case in range(200):
        lengths = [rng.choice((rng.randrange(1, 40), rng.randrange(1, 3000), rng.randrange(1, 9000))) for _ in range(rng.randrange(1, 60))]
        made = packing.fill(lengths)
        seen = sorted((i, at, n) for s in made for i, at, n in s)
        for i, n in enumerate(lengths):
            parts = [(at, k) for j, at, k in seen if j == i]
            assert [at for at, _ in parts] == [sum(k for _, k in parts[:x]) for x in range(len(parts))] and sum(k for _, k in parts) == n
        sizes = [sum(n for _, _, n in s) for s in made]
        assert all(s <= 2048 and s & (s - 1) == 0 for s in sizes), case
        assert sum(s not in packing.TIERS for s in sizes) <= 8  # the rest of a group
    assert packing.fill([]) == [] and packing.fill([1]) == [[(0, 0, 1)]]


def test_long_windows_are_filled_from_shorter_tiers():
    made = packing.fill([1500, 300, 200, 40, 8, 700, 324])
    assert [sum(n for _, _, n in s) for s in made] == [2048, 1024]
    assert [i for i, _, _ in made[0]] == [0, 6, 2] or sum(n for _, _, n in made[0]) == 2048
    assert all(len({i}) == 1 for i, _, _ in made[0])


def test_words_are_encoded_as_in_their_text():
    words = packing.Words(packing.tokenizer_path())
    assert words.apart and words.narrow
    texts = ["It's A  test\n\nof  <|endoftext|> things", "é ́a ΣΣ İ x\x1cy\x85z 　w", "", None, "\x0b\x0c", "don't... 12 3.5%! \U0001f600\U0001f600", "ΑΣ ΑΣ, ΑΣα", "x" * 5000, "café's NAÏVE ÿ1a2,b..c Ǆ 北京x a<|b", "é" * 20 + " " + "é" * 33, "straße's'll 'Twas rock'n'roll 1,000.5"]
    ids, per = words(pa.array([t.encode() if t is not None else None for t in texts], pa.binary()))
    assert np.split(ids, np.cumsum(per))[:-1] and [x.tolist() for x in np.split(ids, np.cumsum(per))[:-1]] == [expected(t) for t in texts]


def test_words_of_random_letters():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzETAOIN'',.-0123456789éüñßøæÀÞžőǆ%€ж"
    words = ["".join(rng.choice(letters[:26] if rng.random() < 0.5 else letters) for _ in range(rng.randrange(1, 36))) for _ in range(4000)]
    one = packing.WordEncoder(packing.tokenizer_path())
    ids, per = one([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(per))[:-1]] == [one.one(w) for w in words]


def test_edge_rows(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(9000))
    docs = [(1, None), (2, ""), (3, "  "), (4, long), (5, "a b"), (None, "a null id")]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, start int, ids string")
    pieces = packing.pack(df, ids=True, part=4096)
    holds(pieces.collect(), docs)
    assert packing.pack(df.limit(0)).count() == 0
    whole = packing.sequences(pieces).collect()
    assert sum(r.n_tokens for r in whole) == sum(len(expected(t)) for _, t in docs)
    assert all(r.n_tokens == len(r.ids) and r.offsets == sorted(r.offsets) for r in whole)


def test_rows_repeated_many_times_are_spread(spark):
    df = spark.range(3000).selectExpr("1L AS doc_id", "'the same few words' AS text")
    pieces = packing.pack(df, group_bytes=16 << 10)
    assert pieces.agg({"length": "sum"}).first()[0] == 3000 * 5
    assert pieces.selectExpr("sequence_id >> 32 AS g").distinct().count() > 5
