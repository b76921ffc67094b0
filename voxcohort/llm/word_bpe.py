"""Byte-pair encoding of many words at once, from a tokenizer file of lower-case words with word ends.

A word's parts (letters, single digits, other signs) are merged by the ranks of the file, in all words side by side:
each round merges in every word the pair of the lowest rank, the first of equal ones, until no word has a pair that can be
merged. Words with letters beyond the Latin ones, very long parts, or strings of special tokens are left to the library,
and so are all words if the file is of another kind.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import regex

from voxcohort.llm.grouped import runs

#: Fixed value: how the file parts a word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
#: Bytes of a part that is encoded here.
LONGEST = 32
#: Letters above this are left to the library.
LATIN = "ɏ"


def byte_names() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for n, b in enumerate(hidden):
        out[b] = chr(256 + n)
    return out


class Merges:
    """The merges of a file as sorted arrays."""

    def __init__(self, model: dict) -> None:
        vocabulary = model["vocab"]
        self.width = 1 << max(vocabulary.values()).bit_length()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], np.int64)
        new = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.new, self.rank = key[order], new[order], order.astype(np.int64)
        names = byte_names()
        self.inside = np.array([vocabulary[c] for c in names], np.int64)
        self.last = np.array([vocabulary[c + SUFFIX] for c in names], np.int64)
        self.never = len(key)
        # Ranks of two letters, inside a part and at its end.
        self.of_letters = [self.ranks(self.inside[:, None], to[None, :])[0] for to in (self.inside, self.last)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging left with right, never where there is no such merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        ok = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.rank[at], self.never), self.new[at]

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and how many each has; no part is empty or longer than LONGEST."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        if not len(size):
            return np.zeros(0, np.int64), size
        begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(parts), np.uint8)
        many = np.zeros(len(parts), np.int64)
        held = []
        for n in np.unique(size).tolist():  # parts of a length together: no room for shorter ones is wasted
            which = np.flatnonzero(size == n)
            made = self._merged(flat[begin[which, None] + np.arange(n)])
            many[which] = (made >= 0).sum(axis=1)
            held.append((which, made))
        start = np.cumsum(many) - many
        out = np.zeros(int(many.sum()), np.int64)
        for which, made in held:
            out[runs(start[which], many[which])] = made[made >= 0]
        return out, many

    def _merged(self, letters: np.ndarray) -> np.ndarray:
        """One row of ids per row of letters, filled up with -1."""
        ids = self.inside[letters]
        ids[:, -1] = self.last[letters[:, -1]]
        if ids.shape[1] == 1:
            return ids
        rank = self.of_letters[0][letters[:, :-1], letters[:, 1:]]
        rank[:, -1] = self.of_letters[1][letters[:, -2], letters[:, -1]]
        out = np.full(ids.shape, -1, np.int64)
        row = np.arange(len(ids))
        while len(row):
            at = rank.argmin(axis=1)
            open_ = rank[np.arange(len(row)), at] < self.never
            if not open_.all():
                done = row[~open_]
                out[done, : ids.shape[1]] = ids[~open_]
                ids, rank, row, at = ids[open_], rank[open_], row[open_], at[open_]
                if not len(row):
                    break
            n = np.arange(len(row))
            _, new = self.ranks(ids[n, at], ids[n, at + 1])
            ids[n, at] = new
            # What stands behind the pair moves up by one place.
            width = ids.shape[1]
            move = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            ids = np.take_along_axis(ids, move, axis=1)
            rank = np.take_along_axis(rank, np.minimum(move, width - 2)[:, : width - 2], axis=1) if width > 2 else np.full((len(row), 1), self.never)
            if width == 2:
                out[row, :1] = ids
                break
            before = at > 0
            rank[n[before], at[before] - 1] = self.ranks(ids[n[before], at[before] - 1], ids[n[before], at[before]])[0]
            after = at < width - 2
            rank[n[after], at[after]] = self.ranks(ids[n[after], at[after]], ids[n[after], at[after] + 1])[0]
        return out


class Parts(dict):
    """Numbers parts from 0 in the order in which they come."""

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


class WordEncoder:
    """Encodes lists of words without white space; the same ids as the library gives them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.merges = Merges(held["model"]) if self._known(held) else None
        self.parted = regex.compile(PATTERN).findall

    @staticmethod
    def _known(held: dict) -> bool:
        model, before = held["model"], (held.get("pre_tokenizer") or {}).get("pretokenizers") or []
        kinds = [n["type"] for n in (held.get("normalizer") or {}).get("normalizers", [])]
        return (
            model["type"] == "BPE"
            and model.get("end_of_word_suffix") == SUFFIX
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and kinds == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in before] == ["Split", "ByteLevel"]
            and before[0]["pattern"] == {"Regex": PATTERN}
            and not before[1].get("add_prefix_space")
            and all(t["content"].startswith("<|") for t in held.get("added_tokens", []))
        )

    def one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        if self.merges is None:
            return self._by_library([w.decode(errors="replace") for w in words])
        joined = b"\n".join(words).decode(errors="replace")
        rest = {i for i, n in enumerate(map(len, words)) if n > LONGEST}
        if "<|" in joined:
            rest |= {i for i, w in enumerate(words) if b"<|" in w}
        texts = joined.lower().split("\n") if words else []
        if not joined.isascii():
            rest |= {i for i, t in enumerate(texts) if not t.isascii() and max(t) > LATIN}
        for i in rest:
            texts[i] = ""
        found = [(t,) if t.isalpha() else self.parted(t) for t in texts]
        many = np.fromiter(map(len, found), np.int64, len(found))
        number = Parts()
        part = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, int(many.sum()))
        coded = [p.encode() for p in number]
        long = [i for i, c in enumerate(coded) if len(c) > LONGEST]
        for i in long:
            coded[i] = coded[i][:1]
        ids, size = self.merges.encode(coded)
        if long:  # letters of several bytes: these parts are encoded by the library
            names = list(number)
            ids, size = self._replaced(ids, size, long, self._by_library([names[i] for i in long]))
        start = np.cumsum(size) - size
        out = ids[runs(start[part], size[part])]
        per = np.zeros(len(texts), np.int64)
        np.add.at(per, np.repeat(np.arange(len(texts)), many), size[part])
        left = sorted(rest)
        return self._replaced(out, per, left, self._by_library([words[i].decode(errors="replace") for i in left])) if left else (out, per)

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for f in found for i in f], np.int64), np.fromiter(map(len, found), np.int64, len(found))

    @staticmethod
    def _replaced(ids: np.ndarray, size: np.ndarray, which: list[int], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """ids and size with the ids of some texts put in place of theirs."""
        to = size.copy()
        to[which] = new[1]
        start, begin = np.cumsum(to) - to, np.cumsum(size) - size
        out = np.zeros(int(to.sum()), np.int64)
        kept = np.ones(len(size), bool)
        kept[which] = False
        out[runs(start[kept], to[kept])] = ids[runs(begin[kept], size[kept])]
        out[runs(start[which], to[which])] = new[0]
        return out, to
