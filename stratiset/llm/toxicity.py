"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its embedding, the mean embedding of its character n-grams, and
log-odds of the word and of its n-grams. Two gated recurrent layers read a window
of ``SPAN`` words, one each way; attention pools their states into one number. All
overlapping windows of a text are scored (one starts every ``STEP`` words, so each word
but those at the ends lies in three or four), and the text takes the highest.

Trained in numpy on a bounded sample: at most ``TOXIC`` and ``CLEAN`` labelled
documents of at most ``TRAIN_CHARS`` code points, drawn by a hash of their ids.
One part of them gives the log-odds, one trains the network (each document by
its highest window), one calibrates scores. Held-out rows are never drawn.

The model (a few MB) is broadcast; scoring is narrow. A word's gate inputs do not
depend on its neighbours, so they are computed once and kept in a bounded cache.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import draw, held_out

#: Bounds of the training sample and the model.
TOXIC, CLEAN, TRAIN_CHARS, VOCABULARY, GRAMS, TRIGRAMS = 2_000, 4_000, 10_000, 4_000, 100_000, 4_000
SPAN, STEP, TRAIN_STEP = 32, 10, 16
UNITS, WORD_DIM, CHAR_DIM, ATTENTION, SLOTS = 8, 6, 6, 8, 24
EPOCHS, BATCH, RATE, SEED, THRESHOLD = 14, 256, 0.01, 7, 0.7
#: Letters; longer runs (scripts without spaces) are several inputs.
WORD = re.compile(rf"[^\W\d_]{{1,{SLOTS}}}")
#: Characters that n-grams are told apart by; those beyond are unknown.
LETTERS = 4_000
#: Windows that are scored side by side.
SIDE = 1024


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str) -> list[str]:
    """The character 4- and 5-grams of a word between marks, which get log-odds."""
    marked = f"<{word}>"
    n = len(marked)
    return [marked[k : k + 4] for k in range(n - 3)] + [marked[k : k + 5] for k in range(n - 4)]


def trigrams(word: str) -> list[str]:
    """Its character 3-grams, which get embeddings."""
    marked = f"<{word}>"
    return [marked[k : k + 3] for k in range(len(marked) - 2)]


def _log_odds(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, least: int) -> dict[str, float]:
    out = {}
    for key in set(toxic) | set(clean):
        a, b = toxic[key], clean[key]
        if a + b >= least:
            out[key] = max(-1.0, min(1.0, 0.25 * (math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1)))))
    return out


def _odds(texts: list[tuple[list[str], int]]) -> tuple[list[dict[str, float]], list[str]]:
    """Log-odds of words and of n-grams by how many documents of each class hold them; the most frequent 3-grams."""
    seen, sizes, short = [(Counter(), Counter()) for _ in range(2)], [0, 0], Counter()
    for words, label in texts:
        own = set(words)
        sizes[label] += 1
        seen[label][0].update(own)
        seen[label][1].update({g for w in own for g in grams(w)})
        short.update(g for w in own for g in trigrams(w))
    return [_log_odds(seen[1][k], seen[0][k], sizes[1], sizes[0], 4) for k in (0, 1)], sorted(short, key=lambda g: (-short[g], g))[:TRIGRAMS]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Grams:
    """Values of character n-grams of one length, looked up for all places of many words at once.

    An n-gram is one number: its letters' places in the alphabet, twelve bits each.
    """

    def __init__(self, n: int, values: dict[str, float], alphabet: np.ndarray) -> None:
        self.n = n
        known = [(g, v) for g, v in values.items() if len(g) == n]
        codes = letters("".join(g for g, _ in known), alphabet).reshape(-1, n) if known else np.zeros((0, n), np.int64)
        whole = codes.all(axis=1)
        keys = self._keys(codes[whole].T)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([v for _, v in known], np.float64)[whole][order]

    @staticmethod
    def _keys(columns) -> np.ndarray:
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            key = key << 12 | c
        return key

    def at(self, codes: np.ndarray, missing: float = 0.0) -> np.ndarray:
        """The value of the n-gram at each place of ``codes``, the last n - 1 left out."""
        n = self.n
        if len(codes) < n:
            return np.zeros(0)
        keys = self._keys([codes[k : len(codes) - n + 1 + k] for k in range(n)])
        if not len(self.keys):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], missing)


def letters(text: str, alphabet: np.ndarray) -> np.ndarray:
    """Places (from 1) of the characters of a text in the sorted alphabet of code points; 0 for others."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    at = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
    return np.where(alphabet[at] == points, at + 1, 0)


class Network:
    """Parameters, forward and backward passes, gate inputs by word."""

    def __init__(self, word_odds: dict[str, float], gram_odds: dict[str, float], common_trigrams: list[str]) -> None:
        strongest = sorted(word_odds, key=lambda w: (-abs(word_odds[w]), w))[:VOCABULARY]
        self.vocabulary = {w: k for k, w in enumerate(strongest, 1)}
        self.trigrams = {g: k for k, g in enumerate(common_trigrams[:TRIGRAMS], 1)}
        self.learn_odds(word_odds, gram_odds)
        r, h, d = np.random.default_rng(SEED), UNITS, WORD_DIM + CHAR_DIM + 3
        p = {"words": r.normal(0, 0.1, (len(strongest) + 1, WORD_DIM)), "chars": r.normal(0, 0.1, (len(self.trigrams) + 1, CHAR_DIM)), "a": r.normal(0, 0.5, (2 * h, ATTENTION)), "v": r.normal(0, 0.5, ATTENTION), "w": r.normal(0, 0.5, 2 * h), "b": np.array([-1.0])}
        for way in "fb":
            p |= {f"x{way}": r.normal(0, 1 / math.sqrt(d), (d, 3 * h)), f"u{way}": r.normal(0, 1 / math.sqrt(h), (h, 3 * h)), f"g{way}": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.scale, self.shift = 1.0, 0.0

    def learn_odds(self, word_odds: dict[str, float], gram_odds: dict[str, float]) -> None:
        self.word_odds = word_odds
        self.gram_odds = {g: gram_odds[g] for g in sorted(gram_odds, key=lambda g: (-abs(gram_odds[g]), g))[:GRAMS]}
        seen = Counter(c for g in (*self.gram_odds, *self.trigrams) for c in g)
        self.alphabet = np.array(sorted(ord(c) for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]) or [0], np.uint32)
        self.short = Grams(3, self.trigrams, self.alphabet)
        self.long = [Grams(n, self.gram_odds, self.alphabet) for n in (4, 5)]

    def table(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Feature arrays of distinct words: embedding rows of the word and its 3-grams (0: unknown), the weight
        of each 3-gram, and log-odds of the word and of its longer n-grams (highest, mean)."""
        n = len(words)
        slots, many, odds = np.zeros((n, SLOTS), np.int64), np.zeros((n, SLOTS), np.float32), np.zeros((n, 3), np.float32)
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, n)
        odds[:, 0] = np.fromiter((self.word_odds.get(w, 0.0) for w in words), np.float32, n)
        if not n:
            return ids, slots, many, odds
        codes = letters("<" + "><".join(words) + ">", self.alphabet)
        sizes = np.fromiter(map(len, words), np.int64, n) + 2
        owner, starts = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
        here = np.flatnonzero(owner[: len(owner) - 2] == owner[2:])
        own, place = owner[here], here - starts[owner[here]]
        slots[own, place] = self.short.at(codes)[here]
        many[own, place] = (1 / (sizes - 2))[own]
        highest, total = np.full(n, -np.inf), np.zeros(n)
        for grams_of in self.long:
            here = np.flatnonzero(owner[: len(owner) - grams_of.n + 1] == owner[grams_of.n - 1 :])
            found, own = grams_of.at(codes)[here], owner[here]
            total += np.bincount(own, found, n)
            if len(own):
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                highest[own[first]] = np.maximum(highest[own[first]], np.maximum.reduceat(found, first))
        count = np.maximum(sizes - 3, 0) + np.maximum(sizes - 4, 0)
        odds[:, 1], odds[:, 2] = np.where(count > 0, highest, 0), total / np.maximum(count, 1)
        return ids, slots, many, odds

    def inputs(self, table: tuple[np.ndarray, ...]) -> np.ndarray:
        ids, slots, many, odds = table
        return np.hstack([self.p["words"][ids], (self.p["chars"][slots] * many[:, :, None]).sum(axis=1), odds])

    def gates(self, table: tuple[np.ndarray, ...]) -> np.ndarray:
        """Per distinct word what it adds to the gates of both layers."""
        x = self.inputs(table)
        both, more = np.hstack([self.p["xf"], self.p["xb"]]), np.r_[self.p["gf"], self.p["gb"]]
        # a task owns one core; products of few rows do not wake others
        return np.concatenate([x[k : k + 256] @ both + more for k in range(0, max(len(x), 1), 256)])

    def _layer(self, way: str, gates: np.ndarray, mask: np.ndarray, keep: bool):
        """States (steps, windows, units) of one layer over gate inputs (windows, steps, 3 units)."""
        n, steps, h = mask.shape[0], mask.shape[1], UNITS
        state, out, kept = np.zeros((n, h), np.float32), np.zeros((steps, n, h), np.float32), [None] * steps
        u, full = self.p["u" + way], mask.all(axis=0)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g, s = gates[:, t], state @ u
            zr = 1 / (1 + np.exp(-(g[:, : 2 * h] + s[:, : 2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, 2 * h :] + r * s[:, 2 * h :])
            new = c + z * (state - c)
            if keep:
                kept[t] = (state, z, r, c, s[:, 2 * h :])
            state = new if full[t] else np.where(mask[:, t, None], new, state)
            out[t] = state
        return out, kept

    def logits(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        h = UNITS
        f, kf = self._layer("f", gates[:, :, : 3 * h], mask, keep)
        b, kb = self._layer("b", gates[:, :, 3 * h :], mask, keep)
        states = np.concatenate([f, b], axis=2).transpose(1, 0, 2)
        hidden = np.tanh(states @ self.p["a"])
        e = np.where(mask, hidden @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        weight = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return (logit, (kf, kb, states, hidden, weight, pooled)) if keep else logit

    def window_logits(self, rows: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows over gate inputs, one word a row, step by step side by side and in place."""
        p, h, n, steps = self.p, UNITS, *at.shape
        gates, full = rows[at.T], mask.all(axis=0)
        states = np.empty((steps, n, 2 * h), np.float32)
        s, zr, c = np.empty((n, 3 * h), np.float32), np.empty((n, 2 * h), np.float32), np.empty((n, h), np.float32)
        for lo, way in enumerate("fb"):
            u, state = p["u" + way], np.zeros((n, h), np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                g = gates[t, :, 3 * h * lo : 3 * h * lo + 3 * h]
                np.matmul(state, u, out=s)
                np.add(g[:, : 2 * h], s[:, : 2 * h], out=zr)
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(zr[:, h:], s[:, 2 * h :], out=c)
                c += g[:, 2 * h :]
                np.tanh(c, out=c)
                new = states[t, :, h * lo : h * lo + h]
                np.subtract(state, c, out=new)
                new *= zr[:, :h]
                new += c
                if not full[t]:
                    off = ~mask[:, t]
                    new[off] = state[off]
                state = new
        e, said = np.empty((steps, n), np.float32), np.empty((steps, n), np.float32)
        for t in range(steps):  # small products run on one core
            hidden = states[t] @ p["a"]
            e[t] = np.tanh(hidden, out=hidden) @ p["v"]
            said[t] = states[t] @ p["w"]
        e = np.exp(np.where(mask.T, e, -1e9) - np.where(mask.T, e, -1e9).max(axis=0))
        return (e * said).sum(axis=0) / e.sum(axis=0) + p["b"][0]

    def gradients(self, table, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients over windows of rows ``at`` (windows, steps) of the table."""
        p, h = self.p, UNITS
        x = self.inputs(table)
        gates = np.hstack([x @ p["xf"] + p["gf"], x @ p["xb"] + p["gb"]])
        logit, (kf, kb, states, hidden, weight, pooled) = self.logits(gates[at], mask, True)
        prob, n = _sigmoid(logit), len(y)
        loss = float(-(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)).mean())
        d = ((prob - y) / n).astype(np.float32)
        grad = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * p["w"]
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = np.einsum("nh,nth->nt", d_pooled, states)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        grad["v"] = np.einsum("nt,nta->a", d_e, hidden)
        d_hidden = d_e[:, :, None] * p["v"] * (1 - hidden**2)
        grad["a"] = np.einsum("nth,nta->ha", states, d_hidden)
        d_states += d_hidden @ p["a"].T
        d_gates = np.zeros((*mask.shape, 6 * h), np.float32)
        for way, kept, lo in (("f", kf, 0), ("b", kb, 1)):
            d_u, carry = np.zeros_like(p["u" + way]), np.zeros((n, h), np.float32)
            steps = range(mask.shape[1])
            for t in reversed(steps) if way == "f" else steps:
                on = mask[:, t, None]
                carry = carry + d_states[:, t, lo * h : (lo + 1) * h]
                old, z, r, c, s = kept[t]
                now = np.where(on, carry, 0)
                d_c = now * (1 - z) * (1 - c**2)
                d_z = now * (old - c) * z * (1 - z)
                d_r = d_c * s * r * (1 - r)
                local = np.hstack([d_z, d_r, d_c * r])
                d_u += old.T @ local
                d_gates[:, t, 3 * h * lo : 3 * h * lo + 3 * h] = np.hstack([d_z, d_r, d_c])
                carry = np.where(on, now * z + local @ p["u" + way].T, carry)
            grad["u" + way] = d_u
        d_rows = np.zeros((len(x), 6 * h), np.float32)
        np.add.at(d_rows, at[mask], d_gates[mask])
        d_x = d_rows[:, : 3 * h] @ p["xf"].T + d_rows[:, 3 * h :] @ p["xb"].T
        grad |= {"xf": x.T @ d_rows[:, : 3 * h], "xb": x.T @ d_rows[:, 3 * h :], "gf": d_rows[:, : 3 * h].sum(axis=0), "gb": d_rows[:, 3 * h :].sum(axis=0)}
        grad["words"], grad["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(grad["words"], table[0], d_x[:, :WORD_DIM])
        np.add.at(grad["chars"], table[1], table[2][:, :, None] * d_x[:, None, WORD_DIM : WORD_DIM + CHAR_DIM])
        return loss, grad


def window_starts(n: int, step: int = STEP) -> list[int]:
    """Starts of the windows over n words: every ``step`` words, and one that ends with the text."""
    return [0] if n <= SPAN else [*range(0, n - SPAN, step), n - SPAN]


def window_rows(sizes: list[int], step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (windows, SPAN), mask and text of all windows over texts that lie one after another."""
    starts, owners, ends, base = [], [], [], 0
    for k, n in enumerate(sizes):
        if n:
            s = window_starts(n, step)
            starts += [base + x for x in s]
            owners += [k] * len(s)
            ends += [base + n] * len(s)
            base += n
    at = np.array(starts, np.int64)[:, None] + np.arange(SPAN)
    mask = at < np.array(ends, np.int64)[:, None]
    return np.where(mask, at, 0), mask, np.array(owners, np.int64)


class Scorer:
    """Scores texts with a network."""

    def __init__(self, net: Network | None) -> None:
        self.net = net
        self.cache = common.ChunkCache(self._gates, 100_000)

    def _gates(self, runs: list[bytes]) -> list[bytes]:
        """Of each run of characters the gate inputs of its words."""
        words = [words_of(r) for r in b"\n".join(runs).decode("utf-8", "replace").split("\n")]
        numbers: dict[str, int] = {}
        at = np.array([numbers.setdefault(w, len(numbers)) for x in words for w in x], np.int64)
        blob = self.net.gates(self.net.table(list(numbers))).astype(np.float32)[at].tobytes()
        ends = np.cumsum([4 * 6 * UNITS * len(x) for x in words]).tolist()
        return [blob[a:b] for a, b in zip([0, *ends], ends)]

    def _rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Gate inputs of the words of a column, one word a row, and words per text."""
        runs, codes, sizes = common.runs(column)
        return common.gathered(self.cache.values(runs), codes, sizes, "<f4", 6 * UNITS)

    def _worst(self, rows: np.ndarray, sizes: list[int], best: np.ndarray) -> None:
        at, mask, owner = window_rows(sizes)
        for k in range(0, len(at), SIDE):
            np.maximum.at(best, owner[k : k + SIDE], self.net.window_logits(rows, at[k : k + SIDE], mask[k : k + SIDE]))

    def raw(self, column: pa.Array) -> np.ndarray:
        """Highest logit over each text's windows; -inf without words. A long text comes as a column by itself."""
        best = np.full(len(column), -np.inf)
        if self.net is None:
            return best
        rest = None  # of a long text the words since the last window's start, and the last SPAN words
        for part in common.texts_by_parts(column):
            rows, sizes = self._rows(part)
            if len(part) == len(column) > 1:
                if len(rows):
                    self._worst(rows, sizes.tolist(), best)
                continue
            ahead, last = rest or (rows[:0], rows[:0])
            ahead, last = np.concatenate([ahead, rows]), np.concatenate([last, rows])[-SPAN:]
            starts = range(0, len(ahead) - SPAN, STEP)
            for k in range(0, len(starts), SIDE):
                own = np.array(starts[k : k + SIDE])[:, None] + np.arange(SPAN)
                best[0] = max(best[0], self.net.window_logits(ahead, own, np.ones(own.shape, bool)).max())
            rest = (ahead[len(starts) * STEP :], last)
        if rest and len(rest[1]):
            self._worst(rest[1], [len(rest[1])], best)
        return best

    def scores(self, column: pa.Array) -> list[float]:
        if self.net is None:
            return [0.0] * len(column)
        raw = self.raw(column)
        return _sigmoid(np.where(np.isinf(raw), -30.0, raw * self.net.scale + self.net.shift)).tolist()


def train(rows: list[tuple[int, int, str]], prior: float) -> Network | None:
    """A network from (doc_id, toxic, text) rows; ``prior`` is the share of toxic rows where it is used. None if a class is missing."""
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()[::-1]), r[0]))
    if len({r[1] for r in rows}) < 2:
        return None
    texts, y = [words_of(r[2]) for r in rows], np.array([r[1] for r in rows], np.float32)
    part = np.zeros(len(rows), np.int64)  # within each class: half for log-odds, a third to train on, the rest to calibrate
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        part[own] = np.array([0, 1, 0, 2, 0, 1])[np.arange(len(own)) % 6]
    odds, common_trigrams = _odds([(texts[k], int(y[k])) for k in np.flatnonzero(part == 0)])
    net = Network(*odds, common_trigrams)
    use = [k for k in np.flatnonzero(part == 1) if texts[k]]
    if len({int(y[k]) for k in use}) < 2:
        return None
    words = sorted({w for k in use for w in texts[k]})
    number = {w: k for k, w in enumerate(words)}
    table = net.table(words)
    flat = np.array([number[w] for k in use for w in texts[k]], np.int64)
    at, mask, owner = window_rows([len(texts[k]) for k in use], TRAIN_STEP)
    rowsat, target = flat[at], y[use]
    r, first, second, step = np.random.default_rng(SEED), {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    # before anything is learned, a document's window is the one with the highest log-odds
    value = np.where(mask, table[3][rowsat].max(axis=2), -1).max(axis=1).astype(np.float32)
    for epoch in range(EPOCHS):
        order = np.lexsort((-value, owner))
        top = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        clean = np.flatnonzero(target[owner] == 0)
        chosen = np.r_[top, r.choice(clean, min(len(clean), len(use)), replace=False)]
        r.shuffle(chosen)
        for k in range(0, len(chosen), BATCH):
            pick = chosen[k : k + BATCH]
            unique, at_unique = np.unique(rowsat[pick], return_inverse=True)
            _, grad = net.gradients(tuple(a[unique] for a in table), at_unique.reshape(len(pick), SPAN), mask[pick], target[owner[pick]])
            step += 1
            size = math.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for name, g in grad.items():
                g = g * min(1.0, 5.0 / (size + 1e-9)) + 1e-5 * net.p[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g**2
                net.p[name] = (net.p[name] - RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        gates = net.gates(table)
        value = np.concatenate([net.logits(gates[rowsat[k : k + 2048]], mask[k : k + 2048]) for k in range(0, len(rowsat), 2048)])
    # the network has learned from odds of other documents; what scores uses both parts' odds
    net.learn_odds(*_odds([(texts[k], int(y[k])) for k in np.flatnonzero(part < 2)])[0])
    _calibrate(net, [rows[k][2] for k in np.flatnonzero(part == 2)], y[part == 2], prior)
    return net


def _calibrate(net: Network, texts: list[str | None], y: np.ndarray, prior: float) -> None:
    """Scale and shift of the logit by logistic regression on texts the network has not seen, moved to the prior."""
    scorer = Scorer(net)
    raw = np.concatenate([scorer.raw(pa.array(texts[k : k + 64], pa.string())) for k in range(0, len(texts), 64)])
    ok = ~np.isinf(raw)
    raw, y = raw[ok], y[ok]
    if len(set(y.tolist())) < 2:
        return
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps with a light pull towards scale 1
        p = _sigmoid(a * raw + b)
        g = np.array([((p - y) * raw).sum() + 0.5 * (a - 1), (p - y).sum() + 0.01 * b])
        v = p * (1 - p)
        hess = np.array([[(v * raw * raw).sum() + 0.5, (v * raw).sum()], [(v * raw).sum(), v.sum() + 0.01]])
        move = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -1, 1))
        if abs(move).max() < 1e-6:
            break
    share = float(y.mean())
    net.scale = max(a, 0.05)
    net.shift = b + math.log(max(prior, 1e-4) / max(1 - prior, 1e-4)) - math.log(share / (1 - share))


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network from the labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    rate = F.when(F.col("toxic") == 1, min(1.0, TOXIC / sizes[1])).otherwise(min(1.0, CLEAN / sizes[0]))
    sample = draw(known, rate)  # about TOXIC + CLEAN ids: bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.char_length("text") <= TRAIN_CHARS)
    # one text of an id that repeats, so that there are no more rows than ids drawn
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return train([tuple(r) for r in rows], sizes[1] / (sizes[0] + sizes[1]))


def _score(shared):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in common.slices(rows, n=256, most=1 << 20):
            found = scorer.scores(batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

    return batches


def score(docs: DataFrame, labels: DataFrame | None = None, net: Network | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on). Only ``text`` is scored.

    * null and empty texts, and those without a letter: the lowest score.
    * no labels, or of one class only: every score is 0.
    * labels that repeat an id: toxic if any says so; other values than 0 and 1 are ignored. Of documents that repeat
      a labelled id the first text in order is learned from.
    * null doc_id: scored, never learned from. Repeated ids and rows: each row gets its row.
    * empty table: empty result. Extra columns are ignored.
    """
    if net is None and labels is not None:
        net = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_score(shared), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
