"""Language-model scores by online logistic context mixing.

The model codes the same tokens as the unigram base: words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased), then one
end. A word is its bytes and a space, the end a zero byte; each byte is eight binary decisions.

Bit predictors look at the one to five bytes before (these may reach into words before) and at the bytes of
the word so far. A table of states (small counts of zeros and ones) turns a predictor's counts into
calibrated logits, which are mixed with weights chosen (gated) by how much the longest context and the word
have been seen; the weights are learned online, by logistic gradient steps of adaptive size. A refining table
of (bits so far, quantised logit) adapts the mix to what was observed there. Along each text a last mixer
weighs these spelled words against the words' own frequencies; its weight starts at FIRST and is updated after
every BLOCK tokens from how well either has told the tokens of this text so far.

What is gathered grows with the corpus, and none of it comes to the driver or into every executor: windows of
six bytes are counted in each chunk of texts, then summed; the distinct ones are hashed by the three bytes
before the last into shards of about SHARD windows, in which all longer contexts meet and are counted
exactly. Only the counts of the contexts of one and two bytes (LOW slots whatever the corpus, hashed), the
states, weights and refining table are sent out. Each chunk gets back, by a join, the values of the windows
and words that it holds, and with them scores its texts.

Learning passes take each window without its own occurrence, as an online model that predicts before it
learns does. Shards depend on the data alone, are learned in the order of hashes and averaged as whole
numbers, so scores don't depend on partitions. Scoring uses all counts, of windows seen once too.

Nulls: a null text is empty; a null id is hashed as 'null'. Repeated rows are scored each. An empty table
gives an empty result. Without training rows all counts are zero and the bytes are uniform. Other columns
play no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.llm.grouped import groups, slices
from voxcohort.plans.storage import small_or_not, stored

#: Bytes of context of each predictor; the last one sees the word so far, at least NEAR bytes of it and before it.
LONGEST = 5
CONTEXT = (1, 2, 3, 4, LONGEST, LONGEST)
PREDICTORS = len(CONTEXT)
NEAR = 3
#: Slots of the contexts of one byte (each its own) and of two bytes (hashed).
LOW_BITS = (16, 20)
LOW = sum(1 << b for b in LOW_BITS)
#: Counts from which on a state holds more than one count; counts beyond the last are used as they are.
STATES = np.array([1, 2, 3, 4, 6, 9, 15, 30, 60])
SIDE = len(STATES) + 1
STATE_OF = np.digitize(np.arange(STATES[-1] + 1), STATES)
LONG_SEEN, WORD_SEEN = (1, 2, 4, 8, 20, 100), (1, 4, 30)
GATES = (len(LONG_SEEN) + 1) * (len(WORD_SEEN) + 1)
PRIOR = 0.4
BUCKETS = 33
ROUNDS = 2
RATE = 0.03
STEP = 1024
#: Distinct windows of a shard, about.
SHARD = 1 << 16
#: Bytes of text of a chunk, about.
CHUNK = 32 << 20
#: Of a task that gathers a chunk: bytes of text split at once, windows held before they are merged, rows of a batch given out.
READ, PARTS, SENT = 512 << 10, 1_000_000, 1 << 16
#: Tokens after which a text's last mixer is updated; the weight of words it starts with, and how many tokens that counts for.
BLOCK, FIRST, START = 16, 0.2, 4.0
END = b"\n"  # not a word
WINDOWS, WORDS, TEXTS = 1, 2, 3
#: Fixed-point units of averaged weights and of shares in the refining table.
UNIT, SHARE = 1 << 24, 64


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def spelled(text: bytes | None) -> bytes:
    """The words, each with a space after it."""
    words = tokens(text)
    return b" ".join(words) + b" " if words else b""


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Six-byte windows, one per byte of each spelled text and one for its end, and how many each has; the last byte is the one to predict."""
    buf = np.frombuffer(b"".join(b"\0" * LONGEST + t + b"\0" for t in texts), np.uint8)
    n = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    code = np.zeros(max(len(buf) - LONGEST, 0), np.uint64)
    for back in range(LONGEST, -1, -1):
        code <<= np.uint64(8)
        code |= buf[LONGEST - back : len(buf) - back]
    real = np.ones(len(code), bool)  # windows that predict the zeros before the next text are none
    ends = np.cumsum(n + LONGEST)[:-1]
    for i in range(LONGEST):
        real[ends - LONGEST + i] = False
    return code[real], n


def _words_so_far(code: np.ndarray) -> np.ndarray:
    """The window, its context cut after the last white space (NEAR bytes stay) and marked with its length."""
    context = code >> np.uint64(8)
    n = np.full(len(code), LONGEST)
    for i in range(LONGEST - 1, -1, -1):
        n = np.where((context >> np.uint64(8 * i)) & np.uint64(255) == 32, i, n)
    n = np.maximum(n, NEAR)
    masks = np.array([(1 << 8 * (k + 1)) - 1 for k in range(LONGEST + 1)], np.uint64)
    return code & masks[n] | n.astype(np.uint64) << np.uint64(56)


def bit_of(code: np.ndarray, bit: int) -> np.ndarray:
    return ((code >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


def _partial(code: np.ndarray, bit: int) -> np.ndarray:
    """The bits of the last byte so far, with a one before them."""
    return (1 << bit) | ((code & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64)


def low_slots(code: np.ndarray, bit: int) -> np.ndarray:
    """Slots of the contexts of one and two bytes: two rows."""
    partial = _partial(code, bit).astype(np.uint64)
    one = code & np.uint64(0xFF00) | partial
    h = (code & np.uint64(0xFFFF00) | partial) * np.uint64(0x9E3779B97F4A7C15)
    two = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - LOW_BITS[1])
    return np.stack((one, two + np.uint64(1 << LOW_BITS[0]))).astype(np.int64)


def counted(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """zeros, ones [bit, window]: what n counts for each bit among the windows of equal context and bits before; key: context, then the byte."""
    order = np.argsort(key, kind="stable")
    k, w = key[order], n[order].astype(np.float64)
    out = np.empty((2, 8, len(key)))
    for bit in range(8):
        head = k >> np.uint64(8 - bit)
        starts = np.concatenate(([0], np.flatnonzero(head[1:] != head[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(k)))
        one = np.where(bit_of(k, bit) == 1, w, 0)
        ones = np.add.reduceat(one, starts)
        out[0, bit, order] = np.repeat(np.add.reduceat(w, starts) - ones, sizes)
        out[1, bit, order] = np.repeat(ones, sizes)
    return out[0], out[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _first_weights() -> np.ndarray:
    """Most for the longest context, or for four bytes where that was never seen."""
    w = np.full((GATES, PREDICTORS), 0.15)
    seen = np.arange(GATES) >= len(WORD_SEEN) + 1
    w[seen, PREDICTORS - 2] = w[~seen, 3] = 0.6
    return w


def state(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    most = STATES[-1]
    return STATE_OF[np.minimum(n0, most).astype(np.int64)] * SIDE + STATE_OF[np.minimum(n1, most).astype(np.int64)]


def _bucket(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = (np.clip(logit, -8, 8) + 8) * (BUCKETS - 1) / 16
    low = np.minimum(place.astype(np.int64), BUCKETS - 2)
    return low, place - low


@dataclass
class Mixer:
    """Logits of states, gated weights and the refining table; as small for any corpus."""

    states: np.ndarray | None = None
    weights: np.ndarray = field(default_factory=_first_weights)
    refine: np.ndarray | None = None

    def inputs(self, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the predictors, and gates, from counts [predictor, window]."""
        x = np.log((n1 + PRIOR) / (n0 + PRIOR))
        if self.states is not None:
            known = np.take_along_axis(self.states, state(n0, n1), 1)
            x = np.where((np.maximum(n0, n1) >= STATES[-1]) & (np.minimum(n0, n1) > 0), x, known)
        long, word = (np.digitize(n0[k] + n1[k], seen) for k, seen in ((PREDICTORS - 2, LONG_SEEN), (PREDICTORS - 1, WORD_SEEN)))
        return x, long * (len(WORD_SEEN) + 1) + word

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((self.weights[gate].T * x).sum(0), -11, 11)

    def probability(self, logit: np.ndarray, partial: np.ndarray) -> np.ndarray:
        p = _sigmoid(logit)
        if self.refine is None:
            return p
        low, part = _bucket(logit)
        refined = self.refine[partial, low] * (1 - part) + self.refine[partial, low + 1] * part
        return np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)


class Shard:
    """Windows that share shards of contexts, with the counts of all predictors."""

    def __init__(self, code: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> None:
        self.code, self.n, self.low = code, n, low
        keys = [code & np.uint64((1 << 8 * (size + 1)) - 1) for size in CONTEXT[2:-1]] + [_words_so_far(code)]
        self.high = [counted(k, n) for k in keys]

    def counts(self, bit: int, at: np.ndarray | None = None, left_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones [predictor, window] of the windows at; left_out: without one occurrence of the window."""
        at = slice(None) if at is None else at
        code = self.code[at]
        low = low_slots(code, bit)
        n0, n1 = (np.concatenate((self.low[i][low], [h[i][bit][at] for h in self.high])) for i in (0, 1))
        if left_out:
            y = bit_of(code, bit)
            n0, n1 = np.maximum(n0 - (1 - y), 0), np.maximum(n1 - y, 0)
        return n0, n1

    def seen(self) -> np.ndarray:
        """Places of the windows of training texts, in the order of a hash."""
        at = np.flatnonzero(self.n > 0)
        h = self.code[at] * np.uint64(0x9E3779B97F4A7C15)
        return at[np.argsort((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), kind="stable")]

    def log2(self, model: Mixer) -> np.ndarray:
        """log2 probability of each window's last byte."""
        out = np.zeros(len(self.code))
        for bit in range(8):
            p = model.probability(model.mixed(*model.inputs(*self.counts(bit))), _partial(self.code, bit))
            out += np.log2(np.where(bit_of(self.code, bit) == 1, p, 1 - p))
        return out

    def state_sums(self, model: Mixer) -> list[np.ndarray]:
        size, at = PREDICTORS * SIDE**2, self.seen()
        n, seen, one = np.tile(self.n[at], PREDICTORS), np.zeros(size), np.zeros(size)
        for bit in range(8):
            s = (state(*self.counts(bit, at, True)) + SIDE**2 * np.arange(PREDICTORS)[:, None]).ravel()
            seen += np.bincount(s, n, size)
            one += np.bincount(s, n * np.tile(bit_of(self.code[at], bit), PREDICTORS), size)
        return [seen, one]

    def learned(self, model: Mixer) -> list[np.ndarray]:
        """One online pass over the shard: a gradient step for each gate after every STEP windows, divided by the root of past squares."""
        at, w = self.seen(), model.weights.copy()
        model, past = Mixer(model.states, w), np.full(w.shape, 1e-4)
        counts = [self.counts(bit, at, True) for bit in range(8)]
        for i in range(0, len(at), STEP):
            c, n = self.code[at[i : i + STEP]], self.n[at[i : i + STEP]]
            for bit in range(8):
                x, gate = model.inputs(*(m[:, i : i + STEP] for m in counts[bit]))
                miss = n * (bit_of(c, bit) - _sigmoid(model.mixed(x, gate)))
                slope = np.stack([np.bincount(gate, miss * x[k], GATES) for k in range(PREDICTORS)], 1)
                past += slope * slope
                w += RATE * slope / np.sqrt(past)
        return [np.rint(w.ravel() * UNIT) * len(at), np.full(w.size, len(at))]

    def refine_sums(self, model: Mixer) -> list[np.ndarray]:
        at, size = self.seen(), 256 * BUCKETS
        code, n, seen, one = self.code[at], self.n[at], np.zeros(size), np.zeros(size)
        for bit in range(8):
            low, part = _bucket(model.mixed(*model.inputs(*self.counts(bit, at, True))))
            up, cell = np.rint(part * SHARE), _partial(code, bit) * BUCKETS + low
            for add, share in ((0, n * (SHARE - up)), (1, n * up)):
                seen += np.bincount(cell + add, share, size)
                one += np.bincount(cell + add, share * bit_of(code, bit), size)
        return [seen, one]


def packed(zeros: np.ndarray, ones: np.ndarray) -> bytes:
    """The counts, mostly zeros in small corpora, compressed for the way to the executors."""
    return zlib.compress(np.stack((zeros, ones)).astype(np.float32).tobytes(), 1)


@lru_cache(maxsize=1)
def unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    zeros, ones = np.frombuffer(zlib.decompress(held), np.float32).reshape(2, -1)
    return zeros, ones


def _low_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones in the LOW slots, from windows (key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, n = b.column("key").to_numpy().view(np.uint64), b.column("n").to_numpy()
            key = np.concatenate([(low_slots(code, bit) * 2 + bit_of(code, bit)).ravel() for bit in range(8)])
            key, at = np.unique(key, return_inverse=True)
            sums = np.bincount(at, np.tile(n, 16), len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(sums)], ["slot", "n"])

    short = counts.groupBy((F.col("key").bitwiseAND(F.lit(0xFFFFFF))).alias("key")).agg(F.sum("n").alias("n")).filter("n > 0")
    t = short.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(2 * LOW)
    flat[t["slot"].to_numpy()] = t["n"].to_numpy()
    return flat[0::2], flat[1::2]


def _in_shards(counts: DataFrame, held, work: Callable[[Shard, tuple], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work makes of each shard of the windows (shard, key, n); held: a broadcast of the packed low counts and the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, model = held.value
        for _, (key, n) in groups(batches, ("shard",), ("key", "n")):
            yield work(Shard(key.view(np.uint64), n, unpacked(low)), model)

    return counts.sortWithinPartitions("shard", "key").mapInArrow(run, schema)


def _summed(counts: DataFrame, low: bytes, model: Mixer, name: str) -> list[np.ndarray]:
    """Sums over all shards of the arrays (whole numbers) that a method of Shard returns."""
    held = counts.sparkSession.sparkContext.broadcast((low, model))

    def work(shard: Shard, model: Mixer) -> pa.RecordBatch:
        a, b = getattr(shard, name)(model)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(a), dtype=np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["i", "a", "b"])

    t = _in_shards(counts, held, work, "i int, a long, b long").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("i").toArrow()
    held.unpersist()
    return [t["a"].to_numpy().astype(np.float64), t["b"].to_numpy().astype(np.float64)]


def train(counts: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, bytes, Mixer]:
    """The windows in shards, the packed low counts and the mixer, from windows (key, n)."""
    shards = max(1, -(-counts.count() // SHARD))
    of_key = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))), F.lit(shards)).cast("int")
    counts = counts.withColumn("shard", of_key).repartition(shards, "shard")  # a number given, as small tasks would else be made one
    low, model = packed(*_low_counts(counts)), Mixer()
    seen, one = _summed(counts, low, model, "state_sums")
    size = PREDICTORS * SIDE**2
    p = (one + PRIOR) / (seen + 2 * PRIOR) if len(seen) else np.full(size, 0.5)
    model.states = np.log(p / (1 - p)).reshape(PREDICTORS, -1)
    for _ in range(rounds):
        sums, total = _summed(counts, low, model, "learned")
        if len(sums) and total[0] > 0:
            model.weights = (sums / total / UNIT).reshape(model.weights.shape)
    seen, one = _summed(counts, low, model, "refine_sums")
    centre = np.tile(_sigmoid(np.linspace(-8, 8, BUCKETS)), 256)
    if len(seen):
        model.refine = ((one / SHARE + 20 * centre) / (seen / SHARE + 20)).reshape(256, BUCKETS)
    return counts, low, model


def valued(counts: DataFrame, low: bytes, model: Mixer) -> DataFrame:
    """key, value (log2 probability of the last byte) of each window (shard, key, n)."""
    held = counts.sparkSession.sparkContext.broadcast((low, model))

    def work(shard: Shard, model: Mixer) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shard.code.view(np.int64)), pa.array(shard.log2(model).astype(np.float32))], ["key", "value"])

    return _in_shards(counts, held, work, "key long, value float")


class Chunk:
    """Gathers the windows and words of a chunk's texts; those of held-out texts count zero."""

    def __init__(self) -> None:
        self.bytes = self.held = 0
        self.words: Counter[bytes] = Counter()
        self.unlearned: set[bytes] = set()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, texts: list[bytes | None], held_out: list[bool]) -> None:
        for out in (False, True):
            own = [t for t, h in zip(texts, held_out, strict=True) if h == out]
            if not own:
                continue
            split = [tokens(t) for t in own]
            for w in split:
                (self.unlearned if out else self.words).update(w)
            self.words[END] += 0 if out else len(own)
            code, n = np.unique(windows([b" ".join(w) + b" " if w else b"" for w in split])[0], return_counts=True)
            self.parts.append((code, (n * (not out)).astype(np.int32)))  # a text has less than 2 GB
            self.held += len(code)
        self.bytes += sum(len(t or b"") for t in texts)
        if self.held > PARTS:  # merged rarely, as that sorts all that is held
            self.parts = [self.windows()]
            self.held = len(self.parts[0][0]) // 2

    def counted(self) -> Iterator[tuple[bytes, int]]:
        """How often the training texts have each word."""
        return chain(self.words.items(), ((w, 0) for w in self.unlearned if w not in self.words))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        code = np.concatenate([c for c, _ in self.parts])
        n = np.concatenate([n for _, n in self.parts])
        self.parts = []
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        del order
        starts = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1))
        return code[starts], np.add.reduceat(n, starts)


def _batch(chunk: int, kind: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of the gathered table, with nulls in the columns not given."""
    types = {"key": pa.int64(), "n": pa.int64(), "x": pa.binary()}
    own = [pa.array(np.full(rows, chunk)), pa.array(np.full(rows, kind, np.int8))]
    return pa.RecordBatch.from_arrays(own + [columns.get(c, pa.nulls(rows, t)) for c, t in types.items()], ["chunk", "kind", *types])


def gathered(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, kind and the windows (key, n), words (x, n) and texts of each chunk; rows: doc_id, held_out, text.

    Texts come some together, as a compressed Arrow stream of the rows in x.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = TaskContext.get().partitionId() << 24, Chunk()  # type: ignore[union-attr]

        def close() -> Iterator[pa.RecordBatch]:
            if own.parts:
                code, n = own.windows()
                for at in range(0, len(code), SENT):
                    key = code[at : at + SENT].view(np.int64)
                    yield _batch(name, WINDOWS, len(key), key=pa.array(key), n=pa.array(n[at : at + SENT].astype(np.int64)))
                del code, n
                words = own.counted()
                while part := list(islice(words, SENT)):
                    yield _batch(name, WORDS, len(part), x=pa.array([w for w, _ in part], pa.binary()), n=pa.array([c for _, c in part], pa.int64()))

        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                for some in slices(b, "text", READ):
                    own.add(some.column("text").to_pylist(), some.column("held_out").to_pylist())
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as stream:
                    stream.write_batch(b)
                yield _batch(name, TEXTS, 1, x=pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary()))
                if own.bytes >= chunk:
                    yield from close()
                    name, own = name + 1, Chunk()
        yield from close()

    return rows.mapInArrow(run, "chunk long, kind byte, key long, n long, x binary")


class Lookup:
    """Values of 64-bit keys: hash tables level by level, each with the keys that met another one in the level before."""

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        self.levels = []
        while len(key):
            bits = max(4, int(len(key) * 2).bit_length())
            held, values = np.full(1 << bits, ~np.uint64(0)), np.zeros(1 << bits, value.dtype)
            factor = np.uint64((0x9E3779B97F4A7C15 * (2 * len(self.levels) + 1)) & (1 << 64) - 1)
            at = (key * factor >> np.uint64(64 - bits)).astype(np.int64)
            held[at], values[at] = key, value
            self.levels.append((factor, np.uint64(64 - bits), held, values))
            left = held[at] != key
            key, value = key[left], value[left]

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(key)), None
        for factor, shift, held, values in self.levels:
            k = key if open_ is None else key[open_]
            at = (k * factor >> shift).astype(np.int64)
            out[slice(None) if open_ is None else open_] = values[at]
            miss = np.flatnonzero(held[at] != k)
            open_ = miss if open_ is None else open_[miss]
            if not len(open_):
                break
        return out


def last_mix(word: np.ndarray, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each text from its tokens' log10 probabilities as words (-inf: unknown) and as letters; sizes: tokens of each text.

    The weight of words in a block of BLOCK tokens is the share that words had in telling the text's tokens
    before it (their posterior), with FIRST for START tokens.
    """
    start = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    first, size = start[order], sizes[order]
    told, out = np.zeros(len(sizes)), np.zeros(len(sizes))
    for at in range(0, int(size.max(initial=0)), BLOCK):
        m = int(np.searchsorted(-size, -at, side="left"))  # texts that reach this block
        own = np.minimum(size[:m] - at, BLOCK)
        flat = np.arange(int(own.sum())) + np.repeat(first[:m] + at - (np.cumsum(own) - own), own)
        share = np.repeat((START * FIRST + told[:m]) / (START + at), own)
        a, b = np.log10(share) + word[flat], np.log10(1 - share) + letters[flat]
        apart = 10.0 ** -np.abs(a - b)
        cuts = np.cumsum(own) - own
        out[:m] += np.add.reduceat(np.maximum(a, b) + np.log10(1 + apart), cuts)
        told[:m] += np.add.reduceat(np.where(a >= b, 1, apart) / (1 + apart), cuts)
    back = np.empty(len(sizes))
    back[order] = out
    return back


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % 5 == 1


def _scored(total: int, distinct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores a partition of (chunk, kind, a, value, x) in order: a chunk's windows (a, value), words (x, a) and texts (x)."""
    smooth, whole = math.log10(total + 0.5 * (distinct + 1)), math.log10(max(total, 1))

    def texts(x: bytes, known: dict[bytes, int], letters: Lookup) -> pa.RecordBatch:
        rows = pa.ipc.open_stream(zstandard.decompress(x)).read_next_batch()
        held = rows.column("text").to_pylist()
        split = [tokens(t) for t in held]
        code, _ = windows([b" ".join(w) + b" " if w else b"" for w in split])
        bits = letters(code)
        stops = np.flatnonzero((code & np.uint64(255) == 32) | (code & np.uint64(255) == 0)) if len(code) else np.zeros(0, np.int64)
        spelled = np.add.reduceat(bits, np.concatenate(([0], stops[:-1] + 1))) * math.log10(2) if len(code) else bits
        sizes = np.fromiter((len(w) + 1 for w in split), np.int64, len(split))
        for w in split:
            w.append(END)
        c = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.float64, int(sizes.sum()))
        with np.errstate(divide="ignore"):
            word = np.log10(c) - whole
        cuts = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10(c + 0.5) - smooth, cuts)
        seen = np.add.reduceat((c > 0).astype(np.int64), cuts)
        columns = [sizes, seen, base, last_mix(word, spelled, sizes), np.fromiter(map(len, held), np.int64, len(held))]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), *map(pa.array, columns)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, values, known, letters = None, [], [], {}, None
        for batch in batches:
            chunk, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), len(chunk)], strict=True):
                if i == j:
                    continue
                b = batch.slice(i, j - i)
                if chunk[i] != now:
                    now, keys, values, known, letters = chunk[i], [], [], {}, None
                if kind[i] == WINDOWS:
                    keys.append(b.column("a").to_numpy().view(np.uint64))
                    values.append(b.column("value").to_numpy())
                elif kind[i] == WORDS:
                    known.update(zip(b.column("x").to_pylist(), b.column("a").to_pylist(), strict=True))
                else:
                    if letters is None:
                        letters = Lookup(np.concatenate(keys), np.concatenate(values))
                        keys, values = [], []
                    for x in b.column("x"):
                        yield texts(x.as_py(), known, letters)

    return run


def _by_chunk(met: DataFrame, chunks: DataFrame) -> DataFrame:
    """met, each chunk in a task of its own and in the order of kinds; chunks: their names.

    By a hash of the name some tasks get four chunks of 32, and hold and sort them all.
    """
    places = chunks.select(F.col("chunk").alias("_chunk"), (F.row_number().over(Window.orderBy("chunk")) - 1).alias("_place"))
    places = stored(places, "lm-chunks")  # a row per chunk
    placed = met.join(small_or_not(places), F.col("chunk") == F.col("_chunk"))
    placed = placed.repartitionById(max(1, places.count()), "_place").sortWithinPartitions(F.col("_place").cast("long") * 4 + F.col("kind"))  # one number is sorted by its digits
    return placed.select(*met.columns)


def score(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row; held-out rows teach nothing.

    score: log10 probability of the tokens. Bits are per byte of the text as given.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    all_ = stored(gathered(rows, chunk), "lm-gathered")
    asked = all_.filter(F.col("kind") == WINDOWS)
    counts = stored(asked.groupBy("key").agg(F.sum("n").alias("n")), "lm-windows")
    values = valued(*train(counts, rounds))
    of_word = Window.partitionBy("x")
    words = all_.filter(F.col("kind") == WORDS).select("chunk", "x", F.sum("n").over(of_word).alias("c"), (F.min("chunk").over(of_word) == F.col("chunk")).alias("first"))
    words = stored(words, "lm-words")
    total, distinct = words.filter(F.col("first") & (F.col("c") > 0)).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    kind, none = dict(rows.dtypes)["doc_id"], F.lit(None)
    types = {"a": "long", "value": "float", "x": "binary"}
    same = lambda df, k, **given: df.select("chunk", F.lit(k).cast("byte").alias("kind"), *(given.get(c, none).cast(t).alias(c) for c, t in types.items()))
    met = same(asked.select("chunk", "key").join(values.hint("shuffle_hash"), "key"), WINDOWS, a=F.col("key"), value=F.col("value"))
    met = met.unionByName(same(words, WORDS, a=F.col("c"), x=F.col("x")))
    blobs = all_.filter(F.col("kind") == TEXTS)
    met = met.unionByName(same(blobs, TEXTS, x=F.col("x")))
    out = _by_chunk(met, blobs.select("chunk").distinct()).mapInArrow(_scored(total, distinct), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = -F.col("score") / F.lit(math.log10(2)) / F.greatest("n_bytes", F.lit(1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
