"""Hierarchical packing of token sequences into windows of several lengths.

A document's tokens end with one token more. Pieces are routed to the smallest of the context sizes 256, 512, 1024
and 2048 that holds them, longer documents first being cut into whole windows of the longest. The tiers are packed from
the longest to the shortest: the longest piece that waits opens a window of its tier, the gap is filled by the longest
waiting pieces that fit, which belong to shorter tiers, and where none fits one is cut at the gap and its rest
goes back to the tier of its length. So every window is full, and its length is a power of two. What is left at the end of a
group is cut at powers of two. Sequences are then dealt to steps of near equal numbers of tokens, the longest first, each
to the step that has the fewest.

Documents are dealt to groups of a few hundred thousand tokens by a hash of id and text; a group is packed in one
task and needs no other. So the work is a tokenization and one shuffle of token ids (two bytes each where the
vocabulary allows), any number of groups is packed side by side, and the result doesn't depend on partitions, except for
rows so often repeated that they are spread by their place in the input. Very long documents travel in parts of
whole windows.

Words are encoded once for each task and looked up after that (the tokenizer drops white space and never merges
across it); a text is encoded as a whole where it doesn't. A null or empty text is its last token alone. A null
id is hashed like any value; repeated rows are packed each; an empty table gives an empty result. Other columns
play no part.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.grouped import groups, runs, slices
from voxcohort.llm.word_bpe import WordEncoder

TOKENIZER = "word_bpe_49k.json"
#: The token after each document.
END = 1
#: Context sizes; each a power of two.
TIERS = (256, 512, 1024, 2048)
#: Bytes of text (and for each record) of a group, about half a million tokens.
GROUP_BYTES, RECORD_BYTES = 2 << 20, 64
#: Tokens that one step should hold.
STEP = 1 << 17
#: Tokens of a long document that travel in one row; a multiple of the longest context.
PART = 1 << 16
#: Words that a task keeps encoded, and how many bytes of them.
KEPT, KEPT_BYTES = 600_000, 32 << 20
#: Bytes of texts that are encoded at once.
SLICE = 4 << 20
PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """Encodes texts by their words; new ones are encoded when they are first met."""

    def __init__(self, path: str) -> None:
        self.encoder = WordEncoder(path)
        one = self.encoder.one
        self.narrow = self.encoder.tokenizer.get_vocab_size() <= 1 << 16
        # Words may be encoded by themselves if white space leaves no token behind and parts nothing else.
        self.apart = all(one(f"a{b}b") == one("a") + one("b") and not one(b) for b in (" ", "\n", "\t", "\r\n  "))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.ids, self.size, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def parted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of all texts, and how many each text has; every different word is looked up once."""
        texts = pc.fill_null(texts, b"").view(pa.string())
        # Leading and trailing white space leaves an empty word.
        lists = pc.ascii_split_whitespace(texts) if self.apart else pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts)
        words = lists.flatten().dictionary_encode()
        code, different = words.indices.to_numpy(), words.dictionary.cast(pa.binary()).to_pylist()
        filled = np.fromiter(map(len, different), np.int64, len(different)) > 0
        number = np.fromiter((self[w] if w else -1 for w in different), np.int64, len(different))
        owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        kept = filled[code]
        return number[code[kept]], np.bincount(owner[kept], minlength=len(texts))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with END, one after another, and how many each has."""
        if len(self) > KEPT or self.bytes > KEPT_BYTES:
            self.forget()
        seen, counts = self.parted(texts)
        if self.new:
            ids, size = self.encoder(self.new)
            self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids.astype(np.int32)))
            self.bytes += sum(map(len, self.new))
            self.new = []
        # The end is one word more, of one token.
        size, start = np.append(self.size, 1), np.append(np.cumsum(self.size) - self.size, len(self.ids))
        w = np.insert(seen, np.cumsum(counts), len(self.size))
        n = size[w]
        per = np.add.reduceat(n, np.cumsum(counts + 1) - counts - 1)
        return np.append(self.ids, np.int32(END))[runs(start[w], n)], per


def fill(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), from the documents' lengths; every token in one piece."""
    longest = tiers[-1]
    out, waiting = [], []
    for i, n in enumerate(lengths):
        whole = n // longest * longest
        out += [[(i, at, longest)] for at in range(0, whole, longest)]
        if n > whole:
            waiting.append((n - whole, -i, whole))
    waiting.sort()
    while waiting:
        n, i, at = waiting.pop()
        size = next(t for t in tiers if t >= n)
        sequence, gap = [(-i, at, n)], size - n
        while gap and waiting:
            k = bisect_right(waiting, (gap, 1, 0))
            if k:
                n, i, at = waiting.pop(k - 1)
            else:  # the shortest that waits is longer than the gap
                n, i, at = waiting.pop(0)
                insort(waiting, (n - gap, i, at + gap))
                n = gap
            sequence.append((-i, at, n))
            gap -= n
        if gap:  # nothing waits: what there is goes to sequences of powers of two
            left, sequence, rest = size - gap, [], sequence
            while left:
                room = 1 << left.bit_length() - 1
                left -= room
                while room:
                    i, at, n = rest.pop(0)
                    sequence.append((i, at, min(n, room)))
                    if n > room:
                        rest.insert(0, (i, at + room, n - room))
                    room -= min(n, room)
                out.append(sequence)
                sequence = []
        else:
            out.append(sequence)
    return out


def steps(sizes: list[int], step: int = STEP) -> list[int]:
    """A step for each sequence: about step tokens each, the longest sequences first, to the step with the fewest."""
    held = [(0, k) for k in range(max(1, round(sum(sizes) / step)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n, k = held[0]
        out[i] = k
        heapq.heapreplace(held, (n + sizes[i], k))
    return out


def encoded(docs: DataFrame, path: str, group: Column, id_col: str, text_col: str, part: int) -> DataFrame:
    """doc_id, _start, _tokens (of the whole document), _group, _ids (bytes), in parts of long documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), group.alias("_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        kind = np.uint16 if words.narrow else np.uint32
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                ids, per = words(b.column("text"))
                ids = ids.astype(kind)
                parts = -(-per // part)
                at = runs(np.zeros(len(per), np.int64), parts) * part
                owner = np.repeat(np.arange(len(per)), parts)
                size = np.minimum(per[owner] - at, part)
                width = ids.itemsize
                ends = np.append(0, np.cumsum(size * width)).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                # Parts of a long document go to groups of their own.
                h = b.column("_hash").to_numpy()[owner] + at // part * 0x9E3779B1
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner)), pa.array(at), pa.array(per[owner]), pa.array(h), held], ["doc_id", "_start", "_tokens", "_hash", "_ids"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, _start long, _tokens long, _hash long, _ids binary")


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, group_bytes: int = GROUP_BYTES, step: int = STEP, part: int = PART, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step, and its ids if asked for.

    tier is the length of the piece's sequence; ids_crc32 is taken of the ids as little-endian unsigned 32-bit numbers.
    """
    path = path or tokenizer_path()
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.xxhash64(F.col(id_col), F.col(text_col))
    many = max(1, (docs.agg(F.sum(F.octet_length(text) + RECORD_BYTES)).first()[0] or 0) // group_bytes)
    # Rows repeated so often that they would fill a group are spread by their place; there are fewer of them than groups.
    often = docs.groupBy(name.alias("_often")).agg(F.sum(F.octet_length(text) + RECORD_BYTES).alias("_bytes"), F.count(F.lit(1)).alias("_n")).filter(f"_n > 1 AND _bytes > {group_bytes // 4}").select("_often")
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_name", F.xxhash64("_id", "_text"))
    keyed = keyed.join(F.broadcast(often), F.col("_name") == F.col("_often"), "left")
    spread = F.when(F.col("_often").isNull(), F.col("_name")).otherwise(F.xxhash64("_name", F.monotonically_increasing_id()))
    rows = encoded(keyed, path, F.shiftright(spread, 1), "_id", "_text", part)
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_hash"), F.lit(many)))
    rows = rows.withColumn("_key", F.xxhash64("doc_id", "_start", "_ids")).drop("_hash")
    rows = rows.repartition("_group").sortWithinPartitions("_group", "_key")
    kind = dict(rows.dtypes)["doc_id"]
    schema = PIECES.format(kind=kind) + (", ids array<int>" if ids else "")
    narrow = Words(path).narrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g,), (doc, first, tokens, held) in groups(batches, ("_group",), ("doc_id", "_start", "_tokens", "_ids")):
            values = [np.frombuffer(x.as_py(), np.uint16 if narrow else np.uint32).astype("<u4") for x in held]
            made = fill([len(v) for v in values], tiers)
            sizes = [sum(n for _, _, n in s) for s in made]
            where = steps(sizes, step)
            flat = [(i, at, n, s) for s, pieces in enumerate(made) for i, at, n in pieces]
            owner = np.array([x[0] for x in flat])
            n = np.array([x[2] for x in flat])
            seq = np.array([x[3] for x in flat])
            begin = np.cumsum(n) - n
            offset = begin - begin[np.searchsorted(seq, seq)]
            cut = [values[i][at : at + k] for i, at, k, _ in flat]
            first_id = int(g) << 32
            columns = [
                doc.take(pa.array(owner)) if isinstance(doc, pa.Array) else pa.array(doc[owner]),
                pa.array(first[owner] + np.array([x[1] for x in flat])),
                pa.array(n),
                pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()),
                pa.array(tokens[owner]),
                pa.array(first_id + seq),
                pa.array(offset),
                pa.array(np.array(sizes)[seq].astype(np.int32)),
                pa.array(first_id + np.array(where)[seq]),
            ]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate(cut).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.select("_group", "doc_id", "_start", "_tokens", "_ids").mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, step, n_tokens, ids, doc_ids, offsets: the windows themselves, from pieces with ids."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    out = pieces.groupBy("sequence_id", "step").agg(held.alias("x"))
    ids = F.flatten(F.transform("x", lambda p: p["ids"]))
    return out.select("sequence_id", "step", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.offset").alias("offsets"))
