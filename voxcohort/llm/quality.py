"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a character trigram model over all code points and one border. Trusted documents (labelled of good
quality and not toxic; at most about TRUSTED of them, chosen by a hash of the id) give the trigram counts, which
are added up in each task and then by trigram; counts and contexts stay tables, sharded over the cluster. The
distinct trigrams of all documents meet the counts of trigrams, pairs and symbols and of their contexts by joins.
If there are few distinct trigrams (counted: BROADCAST_ROWS at most, 16 MB), their logs are sent to the documents;
if more, documents are gathered into chunks of about CHUNK bytes, each of which asks once for every trigram that
it holds and gets its log by a join. Both ways give the same values.

A document's perplexity is compared with the quantiles of all trusted documents of its language and length
band (few trusted documents: of the band in all languages; of all), widened by a margin. Too high a
perplexity is text unlike any trusted text; too low, text of few patterns. What perplexity cannot see is a
word that follows itself again and again, if its letters are usual: texts of SHORT words or more of which a
share of REPEATS or more equal the word before them are rejected too.

Nulls: a null, empty or blank text has no perplexity and is rejected. A null language is a language of its
own. Repeated rows are judged each. An empty table gives an empty result; without trusted documents nothing
but texts without characters is rejected. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.context_mixing import Lookup
from voxcohort.llm.grouped import slices
from voxcohort.plans.storage import BROADCAST_ROWS, small_or_not, stored

#: Bits of a symbol in a trigram's number: a code point, or BORDER, which is none.
BITS = 21
BORDER = (1 << BITS) - 1
#: Bytes of text of a chunk, about.
CHUNK = 16 << 20
TRUSTED = 20_000
LOW, HIGH = 0.01, 0.99
#: How far beyond a quantile a document may be, in units of the distance from the median to it.
MARGIN = 1.0
REPEATS, SHORT = 0.3, 8
#: Least numbers of characters of the length bands.
BANDS = (0, 60, 250, 1000)
#: Trusted documents that a language and band needs for thresholds of its own.
ENOUGH = 30


def trusted_ids(labels: DataFrame) -> DataFrame:
    """_id of the trusted documents."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 AND t = 0 AND doc_id IS NOT NULL")
    return good.select(F.col("doc_id").alias("_id"))


def characters(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of each text with two borders before and one after it, and how many each has (0 for blank texts)."""
    parts = [characters(t) if t and not t.isspace() else None for t in texts]
    n = np.array([0 if p is None else len(p) + 1 for p in parts], np.int64)
    used = [p for p in parts if p is not None]
    if not used:
        return np.zeros(0, np.int64), n
    border = np.full(2, BORDER, np.uint32)
    sym = np.concatenate([x for p in used for x in (border, p, border[:1])]).astype(np.int64)
    gram = (sym[:-2] << 2 * BITS) | (sym[1:-1] << BITS) | sym[2:]
    real = np.ones(len(gram), bool)  # trigrams that end in the borders before the next text are none
    ends = np.cumsum(n[n > 0] + 2)[:-1]
    real[ends - 2] = real[ends - 1] = False
    return gram[real], n


def trigram_counts(texts: DataFrame) -> DataFrame:
    """gram, n of the trigrams of column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 4 << 20):
                gram, n = np.unique(coded(b.column("text").to_pylist())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discount(counts: DataFrame) -> Column:
    """What modified Kneser-Ney takes off a count n, from how many counts are 1, 2, 3 and 4."""
    n = [max(c, 1) for c in counts.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first()]
    y = n[0] / (n[0] + 2 * n[1])
    d = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _last(gram: str, symbols: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * symbols) - 1))


def logs(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, log P(c | a b) for each distinct gram of asked: discounted trigram counts over the number of different symbols before a pair, and before a symbol."""
    pairs = stored(counts.groupBy(_last("gram", 2).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "pairs")
    singles = stored(pairs.groupBy(_last("gram", 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "singles")
    out = asked.select("gram", F.shiftright("gram", BITS).alias("_ab"), _last("gram", 2).alias("_bc"), _last("gram", 1).alias("_c")).withColumn("_b", F.shiftright("_bc", BITS))
    below = None
    for table, key, context in ((singles, "_c", None), (pairs, "_bc", "_b"), (counts, "gram", "_ab")):
        taken = _discount(table)
        kept = table.select(F.col("gram").alias("_k"), F.greatest(F.col("n") - taken, F.lit(0.0)).alias("_kept"))
        out = out.join(kept, F.col(key) == F.col("_k"), "left").drop("_k")
        if context is None:
            total, freed, distinct = table.agg(F.sum("n"), F.sum(taken), F.count(F.lit(1))).first()
            below = F.lit(1 / (distinct + 1))  # symbols never seen share what one would have
            p = (F.coalesce("_kept", F.lit(0.0)) + freed * below) / total if total else below
        else:
            held = table.groupBy(F.shiftright("gram", BITS).alias("_k")).agg(F.sum("n").alias("_total"), F.sum(taken).alias("_freed"))
            out = out.join(held, F.col(context) == F.col("_k"), "left").drop("_k")
            p = F.when(F.col("_total").isNull(), F.col("_p")).otherwise((F.coalesce("_kept", F.lit(0.0)) + F.col("_freed") * F.col("_p")) / F.col("_total"))
        out = out.withColumn("_p", p).drop("_kept", "_total", "_freed")
    return out.select("gram", F.log("_p").alias("log"))


def train(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The trigram counts of the trusted documents; docs: doc_id, text."""
    texts = docs.join(small_or_not(trusted), F.col("doc_id") == F.col("_id")).select("text")
    return stored(trigram_counts(texts), "trigrams")


def asked_grams(rows: DataFrame) -> DataFrame:
    """gram: the distinct trigrams of column text, told apart in each slice of texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(coded(b.column("text").to_pylist())[0]))], ["gram"])

    return rows.select("text").mapInArrow(run, "gram long").distinct()


def gathered(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chunk, and in gram its distinct trigrams, or in texts some of its rows as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, parts = TaskContext.get().partitionId() << 24, 0, []  # type: ignore[union-attr]

        def batch_of(gram: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), name)), gram, texts], ["chunk", "gram", "texts"])

        def close() -> Iterator[pa.RecordBatch]:
            if parts:
                gram = np.unique(np.concatenate(parts))
                yield batch_of(pa.array(gram), pa.nulls(len(gram), pa.binary()))

        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                parts.append(np.unique(coded(b.column("text").to_pylist())[0]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as stream:
                    stream.write_batch(b)
                size += b.column("text").nbytes
                yield batch_of(pa.nulls(1, pa.int64()), pa.array([zstandard.compress(sink.getvalue(), 9)], pa.binary()))
                if size >= chunk:
                    yield from close()
                    name, size, parts = name + 1, 0, []
        yield from close()

    return rows.mapInArrow(run, "chunk long, gram long, texts binary")


def repetition(words: list[str]) -> float:
    """Share of the words that equal the word before them; 0 for short texts."""
    return sum(a == b for a, b in zip(words, words[1:], strict=False)) / (len(words) - 1) if len(words) >= SHORT else 0.0


def _scored(b: pa.RecordBatch, value: Lookup, names: list[str]) -> pa.RecordBatch:
    """b's columns names, with n_symbols, perplexity and repeats."""
    texts = b.column("text").to_pylist()
    gram, n = coded(texts)
    total, some = np.zeros(len(n)), n > 0
    if some.any():
        total[some] = np.add.reduceat(value(gram.view(np.uint64)), (np.cumsum(n) - n)[some])
    mean = np.exp(-total / np.maximum(n, 1))
    new = [pa.array(n), pa.array(mean, mask=~some), pa.array([repetition((t or "").split()) for t in texts])]
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *new], [*names, "n_symbols", "perplexity", "repeats"])


def asked_logs(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, log of the distinct trigrams of column text, written."""
    return stored(logs(stored(asked_grams(docs), "asked-trigrams"), counts), "logs")


def perplexities(docs: DataFrame, valued: DataFrame, chunk: int = CHUNK, most: int = BROADCAST_ROWS, without: tuple[str, ...] = ("text",)) -> DataFrame:
    """n_symbols, perplexity (null for blank texts), repeats of every row beside docs' columns but those named in without; docs: text and others.

    The logs of the distinct trigrams (valued) are sent to where the documents are if they are counted to be most at
    most; beyond, each chunk of documents is joined with its own by a shuffle.
    """
    names = [c for c in docs.columns if c not in without]
    schema = "".join(f"`{c}` {kind}, " for c, kind in docs.dtypes if c in names) + "n_symbols long, perplexity double, repeats double"
    if valued.count() > most:
        return _joined(docs, valued, chunk, names, schema)
    few = valued.toArrow()
    held = docs.sparkSession.sparkContext.broadcast((few["gram"].to_numpy(), few["log"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = Lookup(held.value[0].view(np.uint64), held.value[1])
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                yield _scored(b, value, names)

    return docs.mapInArrow(run, schema)


def _joined(docs: DataFrame, valued: DataFrame, chunk: int, names: list[str], schema: str) -> DataFrame:
    """perplexities by a shuffle: chunks of documents, as compressed Arrow streams, meet the logs of their trigrams."""
    all_ = stored(gathered(docs, chunk), "texts-and-trigrams")
    # A trigram is asked for once by a chunk, so none has more rows than there are chunks.
    valued = all_.filter(F.col("gram").isNotNull()).select("chunk", "gram").join(valued, "gram")
    none = F.lit(None)
    texts = all_.filter(F.col("texts").isNotNull()).select("chunk", none.cast("long").alias("gram"), none.cast("double").alias("log"), "texts")
    met = valued.select("chunk", "gram", "log", none.cast("binary").alias("texts")).unionByName(texts)
    many = max(1, texts.select("chunk").distinct().count())
    met = met.repartition(many, "chunk").sortWithinPartitions("chunk", F.col("gram").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, values, value = None, [], [], None
        for batch in batches:
            name = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if name[i] != now:
                    now, keys, values, value = name[i], [np.zeros(0, np.int64)], [np.zeros(0)], None
                part = batch.slice(i, j - i)
                grams = part.num_rows - part.column("gram").null_count  # they come before the texts
                keys.append(part.column("gram").slice(0, grams).to_numpy())
                values.append(part.column("log").slice(0, grams).to_numpy())
                for held in part.column("texts").slice(grams):
                    if value is None:
                        value, keys, values = Lookup(np.concatenate(keys).view(np.uint64), np.concatenate(values)), [], []
                    yield _scored(pa.ipc.open_stream(zstandard.decompress(held.as_py())).read_next_batch(), value, names)

    return met.mapInArrow(run, schema)


def _band() -> Column:
    return F.array_size(F.filter(F.array(*map(F.lit, BANDS)), lambda x: x <= F.col("n_symbols")))


def thresholds(scored: DataFrame, trusted: DataFrame, low: float = LOW, high: float = HIGH, margin: float = MARGIN) -> DataFrame:
    """_lang, _band, low, high (logs of perplexities) for each language and band; null stands for all languages, or all bands."""
    good = scored.filter("perplexity IS NOT NULL").join(small_or_not(trusted), F.col("doc_id") == F.col("_id"))
    good = good.select(F.coalesce("lang", F.lit("")).alias("_lang"), _band().alias("_band"), F.log("perplexity").alias("x"))
    q = F.percentile_approx("x", F.array(F.lit(low), F.lit(0.5), F.lit(high)), 2000)
    cut = good.groupingSets([["_lang", "_band"], ["_band"], []], "_lang", "_band").agg(q.alias("q"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_level"))
    a, m, z = (F.col("q")[i] for i in range(3))
    return cut.select("_lang", "_band", "_level", "n", (a - margin * (m - a)).alias("low"), (z + margin * (z - m)).alias("high"))


def judged(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """scored (lang, n_symbols, perplexity, repeats and others) with low, high and accepted."""
    own = cuts.filter(f"_level = 0 AND n >= {ENOUGH}").select("_lang", F.col("_band").alias("_b"), F.col("low").alias("_l0"), F.col("high").alias("_h0"))
    band = cuts.filter(f"_level = 2 AND n >= {ENOUGH}").select(F.col("_band").alias("_b1"), F.col("low").alias("_l1"), F.col("high").alias("_h1"))
    every = cuts.filter("_level = 3").select(F.col("low").alias("_l2"), F.col("high").alias("_h2"))
    out = scored.withColumn("_band", _band())
    out = out.join(small_or_not(own), (F.coalesce("lang", F.lit("")) == F.col("_lang")) & (F.col("_band") == F.col("_b")), "left")
    out = out.join(F.broadcast(band), F.col("_band") == F.col("_b1"), "left").join(F.broadcast(every), F.lit(True), "left")
    low, high = F.coalesce("_l0", "_l1", "_l2"), F.coalesce("_h0", "_h1", "_h2")
    x = F.log("perplexity")
    fits = F.coalesce((x >= low) & (x <= high), F.lit(True))
    return out.select(*scored.columns, F.exp(low).alias("low"), F.exp(high).alias("high"), (F.col("perplexity").isNotNull() & fits & (F.col("repeats") < REPEATS)).alias("accepted"))


def fitted(rows: DataFrame, labels: DataFrame, most: int | None = TRUSTED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The logs of all trigrams of rows (doc_id, lang, text), what every row scores, and the thresholds."""
    everyone = stored(trusted_ids(labels), "trusted-ids")
    some = everyone if (n := everyone.count()) <= (most or n) else everyone.filter(F.pmod(F.xxhash64("_id"), F.lit(n)) < most)
    valued = asked_logs(rows, train(rows, some))
    scored = stored(perplexities(rows, valued), "perplexities")
    return valued, scored, stored(thresholds(scored, everyone), "thresholds")


def classify(docs: DataFrame, labels: DataFrame, most: int | None = TRUSTED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, low, high, accepted, repeats of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    _, scored, cuts = fitted(rows, labels, most)
    return judged(scored, cuts).select("doc_id", "lang", "n_symbols", "perplexity", "low", "high", "accepted", "repeats")


def accepted(docs: DataFrame, labels: DataFrame, most: int | None = TRUSTED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are accepted, with docs' columns. Each row is scored once more and judged by itself, so rows of one id, or of none, don't go for each other."""
    valued, _, cuts = fitted(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), labels, most)
    names = {c: "text" if c == text_col else f"_own{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(F.col(lang_col).alias("lang"), *(F.col(c).alias(n) for c, n in names.items()))
    return judged(perplexities(rows, valued, without=()), cuts).filter("accepted").select(*(F.col(n).alias(c) for c, n in names.items()))
