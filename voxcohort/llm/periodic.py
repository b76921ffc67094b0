"""Periodic runs of words by a sparse diagonal recurrence over earlier occurrences.

Words at a distance (lag) q that are equal lie on the diagonal q; a stretch of L words has period q if its diagonal
matches at the last L - q of them. Every word looks up its earlier occurrences, each of which carries on the match
of its diagonal, and a diagonal that ends with a sufficient length emits a run. Three facts keep it sparse, none
of which loses a run:

- A run of at least max(12, 2q) words matches at max(q, 12 - q) places or more in succession. So occurrences are
  those of six words in a row for lags under 12, of K words for lags from K to 2K - 1 (K = 12, 24, 48, ...); what
  doesn't occur twice at one K is left out at the next.
- Occurrences inside one stretch of a period p <= K / 2 have lags that are multiples of p: never smallest periods.
- Of two stretches with the same p only the places where one of them ends are compared, since a diagonal between
  them ends where either ends.

So the number of lags looked at is in proportion to the words at each K, and the work is about n log n for any
text, also one word a million times. Lengths of matches are found by comparing hashes of stretches, and every run
is then checked word by word.

Texts are read whole, some megabytes of them as one array; words of different texts never match. A null or empty
text has no words, no run and the hash of an empty text. A null id has no planted repetition. Rows are answered one
by one, so repeated rows and ids are answered alike; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.grouped import runs as spread
from voxcohort.llm.grouped import slices

#: A run has at least so many words, and at least two periods.
LEAST = 12
#: Words of the shortest occurrences; a run of LEAST words matches at LEAST / 2 places at least.
FIRST = LEAST // 2
#: Bytes of texts that are handled as one array.
SLICE = 1 << 20

_PRIME = np.uint64((1 << 31) - 1)
_BASES = (np.uint64(1_103_515_245), np.uint64(1_597_334_677))
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Stretches:
    """Compares stretches of an array by polynomial hashes."""

    def __init__(self, words: np.ndarray) -> None:
        values = (words + 1).astype(np.uint64)
        self.powers, self.sums = [], []
        for base in _BASES:
            power = np.ones(1, np.uint64)
            step = base % _PRIME
            while len(power) <= len(words):
                power = np.concatenate((power, power * step % _PRIME))
                step = step * step % _PRIME
            power = power[: len(words) + 1]
            self.powers.append(power)
            self.sums.append(np.append(np.uint64(0), np.cumsum(values % _PRIME * power[:-1] % _PRIME)) % _PRIME)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n values from a are those from b, a < b."""
        out = np.ones(len(a), bool)
        for power, sums in zip(self.powers, self.sums, strict=True):
            left = (sums[a + n] + _PRIME - sums[a]) % _PRIME * power[b - a] % _PRIME
            out &= left == (sums[b + n] + _PRIME - sums[b]) % _PRIME
        return out

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The largest n <= most with equal stretches of n values from a and b, or before them."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a - middle, b - middle, middle) if back else self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _several(name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names from 0 and places, ordered by both, of the names that occur twice or more."""
    order = np.lexsort((at, name)) if len(at) else np.zeros(0, np.int64)
    name, at = name[order], at[order]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    number = np.cumsum(new) - 1
    kept = np.bincount(number, minlength=1)[number] > 1 if len(number) else np.zeros(0, bool)
    number, at = number[kept], at[kept]
    return np.unique(number, return_inverse=True)[1].astype(np.int64), at


def _grams(words: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """A hash for the so many words from each place, mixed with the number of its text."""
    h = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n = len(words) - size + 1
    h = h[:n].copy()
    for k in range(size):
        h = (h ^ words[k : k + n].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _pairs(name: np.ndarray, at: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """place, lag of equal occurrences (ordered by name and place), from low to high apart, of which runs can come."""
    wide = int(at.max()) + 2 * high + 2
    key = name * wide + at + high  # below a name's first place there is room for a whole window
    before = np.zeros(len(at), np.int64)
    before[1:] = np.where(name[1:] == name[:-1], at[1:] - at[:-1], 0)
    lag = np.where((before > 0) & (2 * before <= size), before, 0)
    # In order of places: where an occurrence and the next place's have the same small lag, and where such a stretch begins.
    order = np.argsort(at)
    follows = np.zeros(len(at), bool)
    follows[order[1:]] = (np.diff(at[order]) == 1) & (lag[order[1:]] == lag[order[:-1]]) & (lag[order[1:]] > 0)
    inner = np.zeros(len(at), bool)
    inner[order[:-1]] = follows[order[1:]]
    head = np.where(follows[order], 0, np.arange(len(at)))
    begin = np.empty(len(at), np.int64)
    begin[order] = at[order][np.maximum.accumulate(head)]
    # Occurrences in the stretch of a place itself are multiples of its period.
    last = np.where(lag > 0, np.minimum(at - low, begin - lag - 1), at - low)
    if low < size:  # short lags: there are few of them anyhow
        last, inner = at - low, np.zeros(len(at), bool)

    def within(some: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(key[among], key[some] - high)
        j = np.searchsorted(key[among], key[some] - at[some] + last[some], side="right")
        n = np.maximum(j - i, 0)
        here = np.repeat(at[some], n)
        return here, here - at[among][spread(i, n)]

    outer = np.flatnonzero(~inner)
    parts = [within(outer, np.arange(len(at))), within(np.flatnonzero(inner), outer)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def find(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of the runs of texts whose words (numbers from 0) stand one after another; text numbers them."""
    none = (np.zeros(0, np.int64),) * 3
    if len(words) < LEAST:
        return none
    # A mark of its own after each text, so that no stretch goes on into the next.
    ends = np.append(np.flatnonzero(np.diff(text)), len(words) - 1)
    shift = np.zeros(len(words), np.int64)
    shift[ends[:-1] + 1] = 1
    place = np.arange(len(words)) + np.cumsum(shift)
    marked = np.full(len(words) + len(ends), -1, np.int64)
    marked[place] = words
    owner = np.zeros(len(marked), np.int64)
    owner[place] = text
    marks = np.flatnonzero(marked < 0)
    marked[marks] = words.max() + 1 + np.arange(len(marks))
    name, at = _several(_grams(marked, owner, FIRST), np.arange(len(marked) - FIRST + 1))
    if not len(at):
        return none
    compare, found, size = Stretches(marked), [], FIRST
    while len(at):
        here, lag = _pairs(name, at, size, 1 if size == FIRST else size, 2 * size - 1)
        if len(here):
            order = np.lexsort((here, lag))
            here, lag = here[order], lag[order]
            first = np.ones(len(here), bool)  # one place of each unbroken part of a diagonal
            first[1:] = (lag[1:] != lag[:-1]) | (np.diff(here) != 1)
            here, lag = here[first], lag[first]
            right = compare.common(here - lag, here, len(marked) - here)
            left = compare.common(here - lag, here, here - lag, back=True)
            good = left + right >= np.maximum(lag, LEAST - lag)
            found.append(np.stack((here - lag - left, here + right, lag))[:, good])
        # Twice as long: an occurrence, and the one that begins where it ends.
        rank = np.full(len(marked) + size, -1, np.int64)
        rank[at] = name
        both = rank[at + size] >= 0
        name, at = _several((name * len(marked) + rank[at + size])[both], at[both])
        size *= 2
    if not found:
        return none
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.ones(len(start), bool)  # of the periods of a stretch the smallest
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[least], end[least], period[least]
    for i, j, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
        if not np.array_equal(marked[i : j - q], marked[i + q : j]):
            raise RuntimeError("two stretches of words have the same hashes")
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    before = np.searchsorted(marks, start)  # marks, which don't count as words
    return start - before, end - before, period


def planted(n: int, h: int) -> np.ndarray:
    """The original words' numbers of a text of n words into which a repetition is planted by h."""
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


class Numbers(dict):
    """Numbers words from 0 in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def digest(texts: list[bytes | None], ids: list | None = None) -> list[tuple]:
    """SCHEMA's columns for each text; with ids, repetitions are planted by their checksums first."""
    numbers, all_words, each, sizes = Numbers(), [], [], []
    for k, t in enumerate(texts):
        words = (t or b"").split()
        if ids is not None and ids[k] is not None and words and (h := zlib.crc32(str(ids[k]).encode())) % 10 == 0:
            words = [words[i] for i in planted(len(words), h).tolist()]
        each.append(words)
        sizes.append(len(words))
        all_words.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    text = np.repeat(np.arange(len(texts)), sizes)
    start, end, period = find(np.concatenate(all_words) if all_words else np.zeros(0, np.int64), text)
    cut = np.searchsorted(text[start], np.arange(len(texts) + 1)).tolist() if len(start) else [0] * (len(texts) + 1)
    first = (np.cumsum(sizes) - sizes).tolist()
    out = []
    for k, words in enumerate(each):
        i, j = cut[k], cut[k + 1]
        if i == j:
            out.append((0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
            continue
        s, e, q = start[i:j] - first[k], end[i:j] - first[k], period[i:j]
        edges = np.bincount(s + q, minlength=len(words) + 1) - np.bincount(e, minlength=len(words) + 1)
        kept = b" ".join([words[x] for x in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()])
        lines = "".join(f"{a},{b - a},{p}\n" for a, b, p in zip(s.tolist(), e.tolist(), q.tolist(), strict=True))
        best = np.lexsort((q, s, s - e))[0]
        a, n, p = int(s[best]), int(e[best] - s[best]), int(q[best])
        out.append((j - i, a, n, p, 1000 * n // p, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return out


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """doc_id, n_runs, the longest run and the checksums of all runs and of the text without repetitions, for every row.

    plant: puts repetitions into a tenth of the texts before, chosen by the checksum of the id.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                out = digest(b.column("text").to_pylist(), b.column("doc_id").to_pylist() if plant else None)
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {SCHEMA}")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, period: every run of every text as it is, one row each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                numbers = Numbers()
                words = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in ((t or b"").split() for t in b.column("text").to_pylist())]
                sizes = np.array([len(w) for w in words])
                text = np.repeat(np.arange(len(words)), sizes)
                start, end, period = find(np.concatenate(words), text)
                owner = text[start] if len(start) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), pa.array(start - (np.cumsum(sizes) - sizes)[owner]), pa.array(end - start), pa.array(period)], ["doc_id", "start", "length", "period"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, period long")
