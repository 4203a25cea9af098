"""Language identification, words first with backoff to character n-grams.

A known word scores by its smoothed log-frequency in each language. An unseen
word falls back to its character n-grams, the longest length of which any is
known (4, 3, 2, 1). A text takes the language with the highest mean.

The model is fitted on a bounded sample: about ``DOCS_PER_LANGUAGE`` labelled
documents of each language, drawn by a hash of their ids, with every language and
every word of theirs. Only counts of (language, word) come to the driver; the model
holds a number for each of these, not for each word in each language, and is
broadcast. Every text is scored whole, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound of the labelled rows that are learned from.
DOCS_PER_LANGUAGE = 1_000
#: Bytes of summed log-frequencies that a worker keeps, by run of characters.
CACHE_BYTES = 16 << 20
LONGEST, SMOOTH, EVIDENCE = 4, 0.5, 50
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: remainder 1 of the CRC-32 of the id's text by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def draw(rows: DataFrame, rate: Column) -> DataFrame:
    """Rows whose hashed id falls under ``rate`` (0 to 1): the same rows whenever and wherever it runs."""
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def rows():
        out = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[], [], []], (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    for batch in common.slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for part in common.parts(text or ""):
                counts.setdefault(lang, Counter()).update(words_of(part))
        if sum(map(len, counts.values())) > 200_000:
            yield rows()
    yield rows()


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} " if n > 1 else word
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


class Table:
    """Counts of keys by language: of each key the languages that have it, and how far above an absent key's its log-frequency lies there."""

    def __init__(self, counts: dict[str, dict[int, int]], languages: int) -> None:
        self.rows = {key: k for k, key in enumerate(counts)}
        self.begins = np.cumsum([0, *map(len, counts.values())])
        n = int(self.begins[-1])
        self.langs = np.fromiter((lang for c in counts.values() for lang in c), np.int32, n)
        seen = np.fromiter((m for c in counts.values() for m in c.values()), np.float64, n)
        self.above = np.log((seen + SMOOTH) / SMOOTH).astype(np.float32)
        totals = np.bincount(self.langs, seen, languages) + SMOOTH * max(len(counts), 1)
        self.absent = np.log(SMOOTH) - np.log(totals)

    def means(self, rows: list[int], counts: list[int]) -> np.ndarray:
        """Mean log-frequencies of runs of rows, ``counts`` rows each."""
        at, languages = np.array(rows, np.int64), len(self.absent)
        each = self.begins[at + 1] - self.begins[at]
        place = np.repeat(self.begins[at] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        owner = np.repeat(np.repeat(np.arange(len(counts)), counts), each)
        above = np.bincount(owner * languages + self.langs[place], self.above[place], len(counts) * languages)
        return self.absent + above.reshape(-1, languages) / np.array(counts)[:, None]


class Model:
    """Log-frequencies of words and n-grams by language."""

    def __init__(self, counts: list[tuple[str, str, int]]) -> None:
        self.languages = sorted({c[0] for c in counts})
        at = {lang: k for k, lang in enumerate(self.languages)}
        tables: list[dict[str, dict[int, int]]] = [{} for _ in range(LONGEST + 1)]  # words, then 1-grams and up
        for lang, word, n in counts:
            k = at[lang]
            for size, table in enumerate(tables):
                for key in [word] if size == 0 else grams(word, size):
                    own = table.setdefault(key, {})
                    own[k] = own.get(k, 0) + n
        self.tables = [Table(t, len(at)) for t in tables]

    def vectors(self, words: list[str]) -> np.ndarray:
        """Of each word a log-frequency per language; zeros if not even a letter is known."""
        out = np.zeros((len(words), len(self.languages)))
        todo = range(len(words))
        for size in (0, *range(LONGEST, 0, -1)):
            get, rows, known, counts, rest = self.tables[size].rows.get, [], [], [], []
            for k in todo:
                own = [row for key in ([words[k]] if size == 0 else grams(words[k], size)) if (row := get(key)) is not None]
                if own:
                    rows += own
                    known.append(k)
                    counts.append(len(own))
                else:
                    rest.append(k)
            if known:
                out[known] = self.tables[size].means(rows, counts)
            todo = rest
        return out

    def sums(self, runs: list[bytes]) -> list[bytes]:
        """Of each run of characters its number of words and the sum of their vectors, as bytes."""
        out: list[bytes] = []
        step = max(64, 4096 // (1 + len(self.languages) // 16))
        for k in range(0, len(runs), step):
            words = [words_of(x) for x in b"\n".join(runs[k : k + step]).decode("utf-8", "replace").split("\n")]
            numbers: dict[str, int] = {}
            at = [numbers.setdefault(w, len(numbers)) for x in words for w in x]
            ends = np.cumsum([0, *map(len, words)])
            upto = np.cumsum(np.vstack([np.zeros(len(self.languages)), self.vectors(list(numbers))[at]]), axis=0)
            total = np.column_stack([np.diff(ends), upto[ends[1:]] - upto[ends[:-1]]]).astype(np.float32)
            out += map(bytes, total.view(np.uint8).reshape(len(words), -1))
        return out

    def cache(self) -> common.ChunkCache:
        return common.ChunkCache(self.sums, max(1_000, min(100_000, CACHE_BYTES // (200 + 4 * len(self.languages)))))

    def predict(self, texts: pa.Array, cache: common.ChunkCache) -> list[tuple[str, float]]:
        """Language and score of each text of a column. A long text comes as a column by itself."""
        totals = np.zeros((len(texts), 1 + len(self.languages)))
        for part in common.texts_by_parts(texts) if self.languages else ():
            runs, codes, sizes = common.runs(part)
            if runs:
                values = np.frombuffer(b"".join(cache.values(runs)), np.float32).reshape(len(runs), -1)
                ends = np.cumsum(sizes).tolist()
                for k, (a, b) in enumerate(zip([0, *ends], ends)):
                    totals[k] += values[codes[a:b]].sum(axis=0, dtype=np.float64)
        return [self._best(int(t[0]), t[1:]) for t in totals]

    def _best(self, n: int, total: np.ndarray) -> tuple[str, float]:
        if not n:
            return UNKNOWN, 0.0
        mean = total / n
        odds = np.exp((mean - mean.max()) * min(n, EVIDENCE))
        best = int(mean.argmax())  # the first in order of names where languages tie
        return self.languages[best], float(odds[best] / odds.sum())


def fit(docs: DataFrame) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    crowded = rows.groupBy("lang").count().filter(F.col("count") > DOCS_PER_LANGUAGE).collect()
    rate = F.lit(1.0)
    if crowded:
        rates = F.create_map(*(x for r in crowded for x in (F.lit(r["lang"]), F.lit(DOCS_PER_LANGUAGE / r["count"]))))
        rate = F.coalesce(rates[F.col("lang")], rate)
    counts = draw(rows, rate).select("lang", "text").mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counts.orderBy("lang", "word").collect()])


def _predict(shared):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = model.cache()
        for batch in common.slices(rows):
            found = model.predict(batch.column(2), cache)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return batches


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1). Only ``text`` is scored.

    * null text, or one without a letter: ``und``, score 0; so is every text if no row has a lang.
    * null doc_id: not held out, but never learned from. Ties: the first language by name.
    * repeated ids and rows: each row gets its row. Empty table: empty result. Extra columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(slim))
    return slim.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(shared), "doc_id bigint, held_out boolean, lang_pred string, score double")
