from __future__ import annotations

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from voxcohort.llm import context_mixing as cm

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + ["\n"]


def held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def unigram(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score), word by word."""
    c = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return {d: (held(d), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for d, x in rows}


def windows_of(text):
    """Six-byte windows of a text, one by one, with the token each belongs to."""
    words = [w.encode() for w in tokens(text)[:-1]]
    spelled = b"\0" * 5 + b"".join(w + b" " for w in words) + b"\0"
    place = [i for i, w in enumerate(words) for _ in range(len(w) + 1)] + [len(words)]
    return [(int.from_bytes(spelled[i : i + 6]), t) for i, t in zip(range(len(spelled) - 5), place, strict=True)]


def plain_scores(rows, spark):
    """Scores by loops over bytes and tokens, given the table of window values."""
    n = Counter(code for d, x in rows if not held(d) for code, _ in windows_of(x))
    every = {code for _, x in rows for code, _ in windows_of(x)}
    counts = spark.createDataFrame([(code, n[code]) for code in sorted(every)], "key long, n long")
    value = {r.key: r.value for r in cm.valued(*cm.train(counts)).collect()}
    c = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    total, out = sum(c.values()), {}
    for d, x in rows:
        letters = defaultdict(float)
        for code, t in windows_of(x):
            letters[t] += value[code] * math.log10(2)
        told = told_before = score = 0.0
        for i, t in enumerate(tokens(x)):
            if i % cm.BLOCK == 0:
                told_before = told
            share = (cm.START * cm.FIRST + told_before) / (cm.START + i // cm.BLOCK * cm.BLOCK)
            a, b = share * c[t] / total, (1 - share) * 10 ** letters[i]
            score += math.log10(a + b)
            told += a / (a + b)
        out[d] = score
    return out


def test_whole_table_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, scores = unigram(rows), plain_scores(rows, spark)
    got = cm.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
        assert r.score == pytest.approx(scores[r.doc_id], rel=1e-6)


def test_partitions_and_chunks_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r.doc_id: r.score for r in cm.score(docs.repartition(3), chunk=20_000).collect()}
    other = {r.doc_id: r.score for r in cm.score(docs.repartition(17)).collect()}
    assert one == other


def test_a_task_scores_one_chunk(spark, monkeypatch):
    scored = cm._scored

    def one_chunk_only(*sizes):
        inner = scored(*sizes)

        def run(batches):
            seen = set()

            def watched():
                for b in batches:
                    seen.update(b.column("chunk").to_pylist())
                    assert len(seen) == 1, f"{len(seen)} chunks in a task"
                    kinds.extend(b.column("kind").to_pylist())
                    yield b

            kinds = []
            yield from inner(watched())
            assert kinds == sorted(kinds)

        return run

    monkeypatch.setattr(cm, "_scored", one_chunk_only)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert cm.score(docs.repartition(17), rounds=1).count() == docs.count()


def test_held_out_texts_score_above_the_base(spark):
    """Of tokens that the training texts have; the base gives any other string alike, so it is no distribution of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in cm.score(docs).collect() if r.held_out and r.n_known >= 0.85 * r.n_tokens]
    assert len(got) > 50
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert sum(r.score > r.base_score for r in got) > 0.5 * len(got)


def test_counts_against_dictionaries():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"ab e"), 40)) for _ in range(20)]
    code, n = np.unique(cm.windows([cm.spelled(t) for t in texts])[0], return_counts=True)
    shard = cm.Shard(code, n, (np.zeros(cm.LOW, np.float32), np.zeros(cm.LOW, np.float32)))

    def context(c, k):
        before = int(c).to_bytes(6)[:5]
        if k < cm.PREDICTORS - 1:
            return before[5 - cm.CONTEXT[k] :]
        return before[min(before.rfind(b" ") + 1, 5 - cm.NEAR) :]

    for bit in range(8):
        zeros, ones = shard.counts(bit)
        for k in range(2, cm.PREDICTORS):
            seen = Counter()
            for c, m in zip(code.tolist(), n.tolist(), strict=True):
                seen[context(c, k), (c & 255) >> 8 - bit, c >> 7 - bit & 1] += m
            for i, c in enumerate(code.tolist()):
                assert (zeros[k, i], ones[k, i]) == tuple(seen[context(c, k), (c & 255) >> 8 - bit, y] for y in (0, 1))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    low = tuple(rng.integers(0, 3, cm.LOW).astype(np.float32) for _ in range(2))
    model = cm.Mixer(refine=rng.uniform(0.1, 0.9, (256, cm.BUCKETS)))
    for context in (0, 0x61626364, 0xFFFFFFFF):
        code = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((2 ** cm.Shard(code, rng.integers(0, 4, 256), low).log2(model)).sum() - 1) < 1e-9


def test_windows():
    texts = ["ab", None, "", "hello é", " One\tLONG  words"]
    code, n = cm.windows([cm.spelled(t and t.encode()) for t in texts])
    assert code.tolist() == [c for t in texts for c, _ in windows_of(t)]
    assert n.tolist() == [len(windows_of(t)) for t in texts]


def test_lookup_tells_keys_apart():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 2**48, 5000, np.uint64))
    value = rng.random(len(key)).astype(np.float32)
    at = rng.integers(0, len(key), 20_000)
    assert (cm.Lookup(key, value)(key[at]) == value[at]).all()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Some words some", "z"), (3, "Some words some", "z"), (None, "other words", "z"), (7, "\u0000", "q"), (8, "w" * 30_000, "q")], "doc_id long, text string, row string")
    got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens) for r in cm.score(docs, rounds=1).collect()), key=str)
    assert got == sorted([(False, 1, 1), (False, 2, 1), (False, 3, 4), (False, 3, 4), (True, None, 3), (False, 7, 2), (False, 8, 2)], key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in cm.score(docs, rounds=1).collect())
    assert cm.score(docs.limit(0), rounds=1).count() == 0


def test_gathering_holds_and_gives_out_some_rows_at_a_time(monkeypatch):
    class Here:
        get = staticmethod(lambda: Here)
        partitionId = staticmethod(lambda: 3)

    class Rows:
        mapInArrow = staticmethod(lambda run, schema: run)

    monkeypatch.setattr(cm, "TaskContext", Here)
    texts = [" ".join(f"{(i * 4000 + j) * 2654435761 % 2**32:x}" for j in range(4000)).encode() for i in range(100)] + [b"a A b", None]
    held_out = [i % 5 == 1 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(held_out), pa.array(texts, pa.binary())], ["doc_id", "held_out", "text"])
    run = cm.gathered(Rows)
    tracemalloc.start()
    sizes, words, codes = [b.num_rows for b in run(iter([batch]))], Counter(), Counter()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and max(sizes) <= 1 << 16
    for b in run(iter([batch])):
        if b.column("kind")[0].as_py() == cm.WORDS:
            words.update(dict(zip(b.column("x").to_pylist(), b.column("n").to_pylist(), strict=True)))
        elif b.column("kind")[0].as_py() == cm.WINDOWS:
            codes.update(dict(zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True)))
    want, want_codes = Counter(), Counter()
    for x, out in zip(texts, held_out, strict=True):
        found, n = cm.tokens(x), not out
        for w in [*found, cm.END]:
            want[w] += n
        for c in cm.windows([cm.spelled(x)])[0].view(np.int64).tolist():
            want_codes[c] += n
    assert words == want and len(words) == len(want)
    assert codes == want_codes and len(codes) == len(want_codes)
