"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text becomes pieces by the path of the largest sum of log scores. Spaces are written as the marker U+2581,
one more stands before the text, characters that no piece covers fall back to their bytes. Decoding joins
the pieces' surfaces and turns markers into spaces, so a text comes back exactly, unless it holds the marker
itself, which comes back as a space.

Pieces never cross into a marker from other characters (checked when a vocabulary is read; otherwise texts
are encoded whole), so the best path of a text is that of its words. Words are encoded together, in arrays:
first all positions walk the trie side by side, then the paths advance one position of every word at a time.
Arrays hold some twenty numbers for each byte of the words in them, so words go through them some at a time.
Encoded words are kept for the next batches up to a number of words and of bytes, a matter of speed only.

The vocabulary is read from a given model file and is the only thing broadcast; it is as large as that file.
Nothing is trained here. A null or empty text has no pieces and decodes to an empty text. Repeated rows are
encoded each; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.grouped import runs, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What an uncovered character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Words that a task keeps encoded, and how many bytes of them (text without spaces is one long word).
KEPT, KEPT_BYTES = 250_000, 16 << 20
#: Bytes of words whose paths are looked for at once (a longer word alone), and of texts encoded at once.
PATHS, TEXTS = 128 << 10, 512 << 10


@dataclass
class Vocabulary:
    """Pieces and their double-array trie; state 0 is the root, a byte b leads from s to base[s] + b + 1 if check there is s."""

    surface: list[bytes]
    score: np.ndarray
    unknown: int
    of_byte: np.ndarray
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    longest: int
    split: bool


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and the word's number at its state (or -1)."""
    trie: list[dict[int, int]] = [{}]
    ends = {}
    for word, number in words.items():
        at = 0
        for b in word:
            if b not in trie[at]:
                trie[at][b] = len(trie)
                trie.append({})
            at = trie[at][b]
        ends[at] = number
    size = 2 * len(trie) + 512
    base, check, piece = [0] * size, [-1] * size, [-1] * size
    check[0] = -2
    free, todo = 1, [(0, 0)]
    while todo:
        node, state = todo.pop()
        piece[state] = ends.get(node, -1)
        codes = sorted(b + 1 for b in trie[node])
        if not codes:
            continue
        at, tried = max(free, codes[0]), 0
        while True:
            first = at - codes[0]
            if first + 257 >= len(check):
                more = len(check)
                base += [0] * more
                check += [-1] * more
                piece += [-1] * more
            if check[at] == -1 and all(check[first + c] == -1 for c in codes):
                break
            at += 1
            tried += 1
        if tried > 30:  # crowded up to here: later searches begin here
            free = at
        base[state] = first
        for c in codes:
            check[first + c] = state
            todo.append((trie[node][c - 1], first + c))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(piece, np.int32)


@lru_cache(maxsize=4)
def vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    surface, words, scores = [], {}, {}
    of_byte = np.full(256, -1, np.int32)
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            b = int(p[3:5], 16)
            of_byte[b] = i
            surface.append(bytes([b]))
        elif m.is_control(i):
            surface.append(b"")
        elif m.is_unknown(i):
            surface.append(" ⁇ ".encode())
        else:
            surface.append(p.replace(MARK, " ").encode())
            if not m.is_unused(i):
                words[p.encode()] = i
                scores[i] = m.get_score(i)
    return of_pieces(surface, words, scores, m.unk_id(), of_byte)


def of_pieces(surface: list[bytes], words: dict[bytes, int], scores: dict[int, float], unknown: int, of_byte: np.ndarray) -> Vocabulary:
    score = np.zeros(len(surface))
    score[list(scores)] = list(scores.values())
    score[unknown] = min(scores.values()) - UNKNOWN_PENALTY
    split = all(re.fullmatch(f"{MARK}*[^{MARK}]*", w.decode()) for w in words)
    return Vocabulary(surface, score, unknown, of_byte, *double_array(words), max(map(len, words)), split)


def best_paths(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words one after another, and how many each has."""
    buf = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    whole = np.int32 if len(buf) + len(words) < 1 << 31 else np.int64
    begin = (np.cumsum(sizes) - sizes).astype(whole)
    sizes = sizes.astype(whole)
    word = np.repeat(np.arange(len(words), dtype=whole), sizes)
    left = np.repeat(begin + sizes, sizes) - np.arange(len(buf), dtype=whole)
    at = np.flatnonzero((buf & 0xC0) != 0x80).astype(whole)  # characters begin here
    width = np.diff(np.append(at, whole(len(buf))))
    # All positions walk the trie together.
    pos, state, found = at, np.zeros(len(at), np.int32), []
    covered = np.zeros(len(buf), bool)
    wide = np.zeros(len(buf), whole)
    wide[at] = width
    for depth in range(v.longest):
        on = left[pos] > depth
        pos, state = pos[on], state[on]
        if not len(pos):
            break
        to = v.base[state] + buf[pos + depth] + 1
        ok = v.check[np.minimum(to, len(v.check) - 1)] == state
        pos, state = pos[ok], to[ok]
        ids = v.piece[state]
        hit = ids >= 0
        found.append((pos[hit], np.full(int(hit.sum()), depth + 1, whole), ids[hit]))
        covered[pos[hit & (wide[pos] == depth + 1)]] = True
    bare = at[~covered[at]]
    found.append((bare, wide[bare], np.full(len(bare), v.unknown, np.int32)))
    start, length, ids = (np.concatenate(c) for c in zip(*found, strict=True))
    del found, left, covered, wide
    node = start + word[start]  # one node more than bytes in each word
    step = start - begin[word[start]]
    order = np.lexsort((node, step))
    start, length, ids, node, step = start[order], length[order], ids[order], node[order], step[order]
    gain = v.score[ids]
    best = np.full(len(buf) + len(words), -np.inf)
    best[begin + np.arange(len(words), dtype=whole)] = 0
    back = np.full(len(best), -1, np.int64)
    cuts = np.append(np.flatnonzero(np.diff(step, prepend=-1)), len(step)).tolist()
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        reach = best[node[i:j]] + gain[i:j]
        to = node[i:j] + length[i:j]
        better = np.flatnonzero(reach > best[to])
        best[to[better]] = reach[better]
        back[to[better]] = i + better
    chosen, now = [], (begin + sizes + np.arange(len(words), dtype=whole))[sizes > 0]
    while len(now):
        m = back[now]
        chosen.append(m)
        now = node[m]
        now = now[step[m] > 0]
    used = np.concatenate(chosen)
    used = used[np.argsort(start[used])]
    ids, begin_at, many = ids[used], start[used], length[used]
    owner = word[begin_at]
    fall = (ids == v.unknown) & (v.of_byte[0] >= 0)
    if fall.any():
        times = np.where(fall, many, 1)
        spread = runs(begin_at, times)
        ids, owner = np.where(np.repeat(fall, times), v.of_byte[buf[spread]], np.repeat(ids, times)), np.repeat(owner, times)
    return ids.astype(np.int32), np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes texts word by word, keeping words it has seen."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.words = re.compile(f"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n" if v.split and not any(b"\n" in s and len(s) > 1 for s in v.surface) else f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+" if v.split else r"(?s:.+)").findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.bytes = 0

    def _parts(self, words: Iterator[str]) -> Iterator[list[bytes]]:
        """The words' bytes, in lists of PATHS bytes at most; a longer word stands alone."""
        part, held = [], 0
        for x in words:
            b = x.replace(" ", MARK).encode()
            if part and held + len(b) > PATHS:
                yield part
                part, held = [], 0
            part.append(b)
            held += len(b)
            self.bytes += len(b)
        yield part

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if len(self.number) > KEPT or self.bytes > KEPT_BYTES:
            self.forget()
        number, had = self.number, len(self.number)
        seen, counts = [], []
        for t in texts:
            w = self.words(" " + t) if t else []
            counts.append(len(w))
            for x in w:
                if x not in number:
                    number[x] = len(number)
            seen.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
        if len(number) > had:
            ids, size = zip(*(best_paths(self.v, part) for part in self._parts(islice(number, had, None))), strict=True)
            self.ids, self.size = np.concatenate((self.ids, *ids)), np.concatenate((self.size, *size))
        start = np.cumsum(self.size) - self.size
        w = np.concatenate(seen) if seen else np.zeros(0, np.int64)
        n = self.size[w]
        per = np.zeros(len(texts), np.int64)
        np.add.at(per, np.repeat(np.arange(len(texts)), counts), n)
        return self.ids[runs(start[w], n)], per


class Decoder:
    """Turns ids back into texts."""

    def __init__(self, v: Vocabulary) -> None:
        self.all = np.frombuffer(b"".join(v.surface), np.uint8)
        self.size = np.fromiter(map(len, v.surface), np.int64, len(v.surface))
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray, per: np.ndarray) -> list[str]:
        n = self.size[ids]
        whole = self.all[runs(self.start[ids], n)].tobytes()
        ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(per))].tolist()
        return [whole[i:j].removeprefix(b" ").decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (the ids decode to the text, its markers as spaces) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(model))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(held.value), Decoder(held.value)
        for batch in batches:
            for b in slices(batch, "text", TEXTS):
                texts = b.column("text").to_pylist()
                ids, per = encoder(texts)
                back = pa.array([d == (t or "").replace(MARK, " ") for d, t in zip(decoder(ids, per), texts, strict=True)])
                offsets = pa.array(np.append(0, np.cumsum(per)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(per), pa.ListArray.from_arrays(offsets, pa.array(ids)), back], ["doc_id", "n_tokens", "ids", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text from ids; null ids give an empty text."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary(model))
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for b in batches:
            lists = b.column("ids")
            texts = decoder(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
