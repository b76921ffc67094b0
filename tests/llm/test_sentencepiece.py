from __future__ import annotations

import random
import tracemalloc

import numpy as np
import sentencepiece

from voxcohort.llm import sentencepiece as sp

SF = "/root/testdata/sf0.001"


def unigram():
    """The library's own unigram search over the same pieces: field 3 (model_type) of the trainer spec says 1."""
    proto = open(sp.MODEL, "rb").read()
    m = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    at = proto.index(b"\x18\x02", proto.rindex(m.id_to_piece(m.get_piece_size() - 1).encode()))
    return sentencepiece.SentencePieceProcessor(model_proto=proto[:at] + b"\x18\x01" + proto[at + 2 :])


HARD = [None, "", " ", "  a  b", "\n", "a\nb \n c", "tab\there", "▁x", "日本語 text 😀", "é" * 50, "x" * 3000, "\u0000a", "Hello world"]


def test_against_the_library(spark):
    lib, v = unigram(), sp.vocabulary()
    texts = HARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    enc = sp.Encoder(v)
    ids, per = enc(texts)
    at = 0
    for t, n in zip(texts, per, strict=True):
        mine = ids[at : at + n].tolist()
        at += n
        total = lambda x: sum(v.score[i] for i in x if i not in v.of_byte)
        if t and len(t) < 400 and "▁" not in t and "\x00" not in t:
            want = lib.encode(t)
            assert mine == want or abs(total(mine) - total(want)) < 1e-3 * (1 + abs(total(want))), t
        assert sp.Decoder(v)(ids[at - n : at], np.array([n])) == [(t or "").replace("▁", " ")]


def test_trie_holds_exactly_its_words():
    rng = random.Random(2)
    words = {bytes(rng.choices(b"abc\xff", k=rng.randint(1, 6))): i for i, _ in enumerate(range(200))}
    words = {w: i for i, w in enumerate(words)}
    base, check, piece = sp.double_array(words)

    def find(w):
        s = 0
        for b in w:
            t = base[s] + b + 1
            if t >= len(check) or check[t] != s:
                return -1
            s = t
        return piece[s]

    assert all(find(w) == i for w, i in words.items())
    for _ in range(2000):
        w = bytes(rng.choices(b"abc\xffd", k=rng.randint(1, 7)))
        assert find(w) == words.get(w, -1)


def test_best_path_against_all_splits():
    rng = random.Random(4)
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"\xe2\x96\x81", b"\xe2\x96\x81a"]
    scores = {i + 1: -rng.random() * 5 for i in range(len(pieces))}
    v = sp.of_pieces([b"?", *pieces], {p: i + 1 for i, p in enumerate(pieces)}, scores, 0, np.full(256, -1, np.int32))
    for _ in range(200):
        w = "".join(rng.choices("abx", k=rng.randint(1, 7))).encode()

        def best(t):
            if not t:
                return 0.0
            heads = [(v.score[i + 1], len(p)) for i, p in enumerate(pieces) if t.startswith(p)]
            heads += [] if t[:1] in pieces else [(v.score[0], 1)]
            return max(s + best(t[n:]) for s, n in heads)

        ids, per = sp.best_paths(v, [w, b"", w])
        assert per[1] == 0 and per[0] == per[2]
        assert abs(sum(v.score[ids[: per[0]]]) - best(w)) < 1e-9


def test_whole_table_round_trip_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sp.encode(docs)
    assert got.filter("round_trip").count() == docs.count()
    back = sp.decode(got).join(docs.withColumnRenamed("text", "was"), "doc_id")
    assert back.filter("text = was").count() == docs.count()
    edge = spark.createDataFrame([(i, t, 1) for i, t in enumerate(HARD)] + [(0, "again", 1), (0, "again", 1), (None, "x", 1)], "doc_id long, text string, ids int")
    out = sp.encode(edge)
    assert out.filter("round_trip").count() == len(HARD) + 3
    assert {r.n_tokens for r in out.filter("doc_id in (1)").collect()} == {0}
    assert sp.encode(edge.limit(0)).count() == 0
    assert [r.text for r in sp.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [""]


def test_kept_words_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(sp, "KEPT_BYTES", 1000)
    e = sp.Encoder(sp.vocabulary(sp.MODEL))
    first = [x.tolist() for x in e(["q" * 5000])]
    e(["short"])
    assert sum(map(len, e.number)) < 100
    assert [x.tolist() for x in e(["q" * 5000])] == first


def test_arrays_are_bounded_by_some_words_at_a_time(monkeypatch):
    v, texts = sp.vocabulary(), [" ".join(f"w{i * j:x}" for j in range(1, 20_000)) for i in range(1, 7)] + ["é" * 3000, "", None]
    sp.Encoder(v)(texts[-3:])
    tracemalloc.start()
    ids, per = sp.Encoder(v)(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    for most in (500, 1 << 30):
        monkeypatch.setattr(sp, "PATHS", most)
        again, sizes = sp.Encoder(v)(texts)
        assert again.tolist() == ids.tolist() and sizes.tolist() == per.tolist()
