"""Quality rules with the fertility of a public tokeniser.

Base rules count words, symbols, repeated lines and repeated 8-word windows. The
method measures each text with a public vocabulary (words by themselves): code
points per token, share of byte-fallback tokens and entropy of the tokens. Bands
per language (or script, where ``lang`` names none) are quartile fences over all
documents that pass the base rules; a text outside its language's bands goes.
Quartiles of a language with fewer than ``SUPPORT`` documents are drawn towards
those of its script, these towards those of all rows, and these towards NATURAL,
so that every rule judges every row whatever the size of the table.

Scale: one narrow pass measures each text once and writes a slim table; the
bands are one aggregation with map-side sketches into at most 26**2 + 26**3
languages, a few scripts and all rows, and are broadcast under that bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS, WHITE, MARK = "#*$%&|<>", " \t\n\x0b\x0c\r", "▁"
#: Words that are encoded as one string.
BLOCK = 256
#: Fences in interquartile ranges beyond the median; the floors of the ranges; documents from which a band stands by itself.
FENCES = {"fertility": 4.0, "fallback": 10.0, "entropy": 3.5, "evenness": 1.5}
#: Measures of short texts scatter: with so many tokens the fences are twice as far.
SHORT = 60
FLOORS = {"fertility": 0.02, "fallback": 0.01, "entropy": 0.1, "evenness": 0.03}
SUPPORT = 100
#: Digits of the measures whose quartiles are taken.
DIGITS = 3
#: Rows of a rare language that agree place its band: half the way where there are AGREE of them besides the first.
AGREE = 10
#: Towards what the quartiles of a table of few rows are drawn: entropy and evenness as measured on prose, fertility and fallback as wide as natural texts of all languages.
NATURAL = {"fertility": (1.5, 2.75, 4.0), "fallback": (-0.03, 0.0, 0.03), "entropy": (6.27, 6.52, 6.69), "evenness": (0.648, 0.698, 0.747)}
SCRIPTS = ((0x41, "Latn"), (0x370, "Grek"), (0x400, "Cyrl"), (0x590, "Hebr"), (0x600, "Arab"), (0x900, "Deva"), (0xE00, "Thai"), (0x1100, "Hang"), (0x1200, "Zyyy"), (0x3040, "Kana"), (0x3400, "Hani"), (0xA000, "Zyyy"), (0xAC00, "Hang"), (0xD7B0, "Zyyy"), (0xF900, "Hani"), (0xFB00, "Zyyy"))
_STARTS = np.array([s for s, _ in SCRIPTS])
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, fertility double, fallback double, entropy double, evenness double, script string"
NAMES = [c.split()[0] for c in MEASURES.split(", ")]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(codes: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, its words (numbered alike where equal) that lie in a window of words found twice or more in it."""
    none, total = np.zeros(len(sizes), np.int64), len(codes)
    if total < window:
        return none
    ids = codes.astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = total - window + 1
    starts = np.flatnonzero(owner[:n] == owner[window - 1 :])
    if len(starts) < 2:
        return none
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        key = owner[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(window):
            key = key * _MIX + mixed[k : k + n]
    order = starts[np.argsort(key[starts], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    # equal keys are compared word by word, so a chance collision does not count
    true = np.ones(len(a), bool)
    for k in range(window):
        true &= ids[a + k] == ids[b + k]
    true &= owner[a] == owner[b]
    edge = np.zeros(total + 1, np.int64)
    covered = np.unique(np.r_[a[true], b[true]])
    np.add.at(edge, covered, 1)
    np.add.at(edge, covered + window, -1)
    inside = np.cumsum(edge)[:total] > 0
    return np.bincount(owner[inside], minlength=len(sizes))


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def script_counts(text: str) -> np.ndarray:
    """Letters of the text by row of SCRIPTS; all characters beyond ASCII count as letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    far = codes >= 0x80
    counts = np.zeros(len(SCRIPTS), np.int64)
    if far.any():
        counts += np.bincount(np.searchsorted(_STARTS, codes[far], side="right") - 1, minlength=len(SCRIPTS))
        codes = codes[~far]
    lower = codes | 32
    counts[0] += np.count_nonzero((lower >= 97) & (lower <= 122))
    return counts


def script_named(counts: np.ndarray) -> str:
    """Script of most letters, the first by name of several; Zyyy if there is none."""
    by: dict[str, int] = {}
    for (_, name), n in zip(SCRIPTS, counts.tolist()):
        by[name] = by.get(name, 0) + n
    return max(sorted(by), key=by.__getitem__) if any(by.values()) else "Zyyy"


class Fertility:
    """Token ids of words under a sentencepiece vocabulary, each word by itself."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(k) for k in range(n)])
        self.begins = np.array([self.model.id_to_piece(k).startswith(MARK) for k in range(n)])
        self.kind = "<u2" if n < 65536 else "<u4"
        self.cache = common.ChunkCache(self._encode, 150_000)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        texts = b" ".join(words).decode("utf-8", "replace").split(" ")
        # in a text of words that single spaces part, each word begins with the one id that has a marker
        blocks = [texts[k : k + BLOCK] for k in range(0, len(texts), BLOCK)]
        out: list[bytes] = []
        for block, found in zip(blocks, self.model.encode([" ".join(b) for b in blocks], num_threads=1)):
            ids = np.array(found, self.kind)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(block) and not any(MARK in w for w in block):
                blob, width = ids.tobytes(), ids.itemsize
                at = [*(width * starts).tolist(), len(blob)]
                out += [blob[a:b] for a, b in zip(at, at[1:])]
            else:
                out += [np.array(x, self.kind).tobytes() for x in self.model.encode(block, num_threads=1)]
        return out


@lru_cache(maxsize=2)
def fertility(path: str) -> Fertility:
    return Fertility(path)


def _row(n_words: int, chars: int, symbols: int, dups: int, repeated: int, counts: np.ndarray, fallback: int, script: str) -> tuple:
    """A row of MEASURES; ``counts`` are those of the tokens that occur."""
    n = int(counts.sum())
    share = counts / max(n, 1)
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    return n_words, chars, symbols, dups, repeated, n, chars / n if n else 0.0, fallback / n if n else 0.0, entropy, entropy / float(np.log2(n)) if n > 1 else 0.0, script


def _symbols(column: pa.Array) -> np.ndarray:
    return sum(pc.count_substring(column, x).to_numpy() for x in SYMBOLS).astype(np.int64)


def measure_texts(column: pa.Array, path: str) -> list[tuple]:
    """A row of MEASURES per text of a column. A long text comes as a column by itself and is measured in parts."""
    column, model = pc.fill_null(column.cast(pa.string()), ""), fertility(path)
    texts = column.to_pylist()
    if len(texts) == 1 and len(texts[0]) > common.PART:
        return [_measure_long(texts[0], model)]
    words, codes, sizes = common.runs(column)
    ids, lengths = common.gathered(model.cache.values(words), codes, sizes, model.kind)
    ends, white = np.cumsum(lengths).tolist(), sum(pc.count_substring(column, x).to_numpy() for x in WHITE)
    chars, symbols, repeated = pc.utf8_length(column).to_numpy() - white, _symbols(column), repeat_words(codes, sizes)
    out = []
    for k, (a, b) in enumerate(zip([0, *ends], ends)):
        own = ids[a:b]
        out.append(_row(int(sizes[k]), int(chars[k]), int(symbols[k]), dup_lines(texts[k]), int(repeated[k]), np.unique(own, return_counts=True)[1], int(model.is_byte[own].sum()), script_named(script_counts(texts[k]))))
    return out


def _measure_long(text: str, model: Fertility) -> tuple:
    numbers: dict[bytes, int] = {}
    counts, scripts = np.zeros(len(model.is_byte), np.int64), np.zeros(len(SCRIPTS), np.int64)
    codes, chars, symbols = [], 0, 0
    for part in common.parts(text):
        column = pa.array([part], pa.string())
        words, own, sizes = common.runs(column)
        codes.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)[own])
        counts += np.bincount(common.gathered(model.cache.values(words), own, sizes, model.kind)[0], minlength=len(counts))
        chars += len(part) - sum(map(part.count, WHITE))
        symbols += int(_symbols(column)[0])
        scripts += script_counts(part)
    all_codes = np.concatenate(codes)
    repeated = int(repeat_words(all_codes, np.array([len(all_codes)]))[0])
    return _row(len(all_codes), chars, symbols, dup_lines(text), repeated, counts[counts > 0], int(counts[model.is_byte].sum()), script_named(scripts))


_TYPES = [pa.int64()] * 6 + [pa.float64()] * 4 + [pa.string()]


def _measure(path: str, at: int, names: list[str]):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(rows):
            if not batch.num_rows:
                continue
            columns = zip(*measure_texts(batch.column(at), path))
            yield pa.record_batch([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, _TYPES))], names=names)
        fertility(path).cache.clear()

    return batches


def measured(docs: DataFrame, path: str, prefix: str = "") -> DataFrame:
    """``docs`` with a column per measure."""
    new = [prefix + n for n in NAMES]
    schema = StructType([*docs.schema.fields, *(f for field in MEASURES.split(", ") for f in StructType.fromDDL(prefix + field).fields)])
    return docs.mapInArrow(_measure(path, docs.columns.index("text"), docs.columns + new), schema)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < LEAST_WORDS) | (100 * r > MOST_REPEATED * n)


def band_of(prefix: str = "") -> Column:
    """The band that judges a row: its two- or three-letter language, else its script."""
    return F.when(F.col("lang").rlike("^[a-z]{2,3}$"), F.col("lang")).otherwise(F.col(prefix + "script"))


def _drawn(measure: str, support: Column, parent: Column, known: Column) -> Column:
    """Quartiles of few rows, drawn towards the parent's by the share of SUPPORT that is missing.

    The median moves sooner, and the range takes in what the rows and the parent differ by; ``known`` (0 to 1) says how much the parent is worth as a contrast.
    """
    q, share = F.col(measure), F.least(support / SUPPORT, F.lit(1.0))
    placed = F.greatest(share, known * (support - 1) / (support - 1 + AGREE))
    middle = placed * q[1] + (1 - placed) * parent[1]
    half = (share * (q[2] - q[0]) + (1 - share) * (parent[2] - parent[0])) / 2
    # four times the product outweighs the rest of the way from a placed share of a quarter on
    half += known * placed * (1 - placed) * F.abs(q[1] - parent[1]) * 4 / FENCES[measure] / 2
    return F.when(support >= SUPPORT, q).otherwise(F.array(middle - half, middle, middle + half))


def bands(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Quartiles of each measure by band over all rows that pass the base rules; at most 18,252 languages and the scripts.

    A band's script is that of most of its rows (the first by name of several).
    """
    script = F.col(prefix + "script")
    levels = F.array(F.struct(F.lit(0).alias("level"), band_of(prefix).alias("band")), F.struct(F.lit(1).alias("level"), script.alias("band")), F.struct(F.lit(2).alias("level"), F.lit("").alias("band")))
    good = rows.filter(~base_failed(prefix)).select(F.explode(levels).alias("at"), script.alias("script"), *(F.col(prefix + m).alias(m) for m in FENCES))
    # exact over measures of so many digits, of which no band has more than some ten thousand values
    quartiles = [F.percentile(F.round(m, DIGITS), [0.25, 0.5, 0.75]).alias(m) for m in FENCES]
    found = common.materialise(good.groupBy("at.level", "at.band").agg(F.count("*").alias("n"), F.mode("script", True).alias("script"), *quartiles), "quality-bands")
    none, n = F.lit(0.0), F.col("n")
    whole = found.filter("level = 2").select(F.least(n / SUPPORT, F.lit(1.0)).alias("known"), *(_drawn(m, n, F.array(*map(F.lit, NATURAL[m])), none).alias(f"whole_{m}") for m in FENCES))
    scripts = found.filter("level = 1").crossJoin(F.broadcast(whole)).select("script", "known", *(_drawn(m, n, F.col(f"whole_{m}"), F.col("known")).alias(f"script_{m}") for m in FENCES))
    own = found.filter("level = 0").join(F.broadcast(scripts), "script")
    return own.select("band", *(_drawn(m, n, F.col(f"script_{m}"), F.col("known")).alias(m) for m in FENCES))


def _fence(q: Column, measure: str, side: int, n_tokens: Column) -> Column:
    return q[1] + side * FENCES[measure] * F.greatest(q[2] - q[0], F.lit(FLOORS[measure])) * (1 + SHORT / F.greatest(n_tokens, F.lit(1)))


def judged(rows: DataFrame, prefix: str = "") -> DataFrame:
    """``rows`` with base_failed and kept (named with the prefix)."""
    m = lambda name: F.col(prefix + name)
    own = common.unused(rows.columns)
    fence = lambda name, side: _fence(F.col(f"{own}_{name}"), name, side, m("n_tokens"))
    odd = (m("fertility") < fence("fertility", -1)) | (m("fertility") > fence("fertility", 1)) | (m("fallback") > fence("fallback", 1)) | ((m("entropy") < fence("entropy", -1)) & (m("evenness") < fence("evenness", -1)))
    table = bands(rows, prefix)
    table = F.broadcast(table.select(*(F.col(c).alias(f"{own}_{c}") for c in table.columns)))
    out = rows.withColumn(f"{own}_band", band_of(prefix)).join(table, f"{own}_band", "left")
    out = out.withColumn(prefix + "base_failed", base_failed(prefix)).withColumn(prefix + "kept", ~base_failed(prefix) & ~odd)
    return out.drop(*table.columns)


def quality(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept, and the measures.

    * null text: no words, so base_failed. Null lang: judged by script.
    * null doc_id, repeated ids and rows: each row gets its row, and each counts for the bands.
    * empty table: empty result. Extra columns are ignored; a missing lang counts as null.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    rows = common.materialise(measured(slim, vocabulary).drop("text"), "quality-measures")
    return judged(rows).select("doc_id", *NAMES[:5], "base_failed", "kept", *NAMES[5:])


def drop_poor(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` (all columns) that the rules keep. Texts are measured once: the measures go beside them into the shared folder.

    * null, empty and very short texts fail the base rules and go. Null lang: judged by script.
    * null doc_id, repeated ids and rows: each row is judged and kept or dropped by itself.
    * empty table: empty result. Extra columns, whatever their names, are kept as they are.
    """
    prefix = common.unused(docs.columns)
    rows = common.materialise(measured(docs, vocabulary, prefix), "quality-documents")
    return judged(rows, prefix).filter(F.col(prefix + "kept")).select(*docs.columns)
