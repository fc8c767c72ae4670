"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words, how near they stand to the second person, capitals, punctuation
and obfuscation rates. The lexicon, the trees and the calibration are learnt from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_sample, short_batches, small

#: Labelled texts of each class to learn from, and their characters, at most (expected); chosen by hash over the whole table.
ROWS_PER_CLASS, CHARS_PER_CLASS = 2000, 60_000_000
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32
#: A word joins the lexicon when so many toxic texts have it, or this share of them, and so many times likelier than other texts.
LEXICON_DOCS, LEXICON_SHARE, LEXICON_ODDS = 3, 0.01, 8.0
NEAR = 8
OUT = "doc_id long, score double, predicted int"
#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself ur u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti tus usted ustedes vosotros".split())
_PLAIN = str.maketrans("013457@$!|", "oleastasil")
_WORD = re.compile(r"[^\W_]+(?:[0-9@$!*|][^\W_]+)*")
_DISGUISED = re.compile(r"[^\W\d_][0-9@$!*|]+[^\W\d_]|[^\W\d_](?:[.\-_*][^\W\d_]\b){2,}")
_CAPS = re.compile(r"\b[A-Z]{3,}\b")
_MARKS = re.compile(r"[!?]")
_RUNS = re.compile(r"(.)\1{3,}|[!?]{2,}")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _stem(word: str) -> str:
    return word.translate(_PLAIN) if not word.isalpha() else word


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The dense features; all 0 for a null or empty text."""
    text = text or ""
    toks = words(text)
    n = max(1, len(toks))
    hits, weight, seen, plain = [], 0.0, set(), 0
    for i, w in enumerate(toks):
        odds = lexicon.get(w)
        if odds is None and not w.isalpha():
            odds = lexicon.get(_stem(w))
            plain += odds is not None
        if odds is not None:
            hits.append(i)
            weight += odds
            seen.add(_stem(w))
    near, least = 0, 64
    if hits:
        you = [i for i, w in enumerate(toks) if w in SECOND_PERSON]
        if you:
            at = np.searchsorted(you, hits)
            for h, k in zip(hits, at, strict=True):
                gap = min(abs(h - you[j]) for j in (k - 1, k) if 0 <= j < len(you))
                near += gap <= NEAR
                least = min(least, gap)
    chars = max(1, len(text))
    return [
        len(hits), 100.0 * len(hits) / n, weight, len(seen), 100.0 * near / n, float(least), plain,
        math.log1p(n), 100.0 * len(_CAPS.findall(text)) / n, 100.0 * len(_MARKS.findall(text)) / chars,
        100.0 * len(_RUNS.findall(text)) / n, 100.0 * len(_DISGUISED.findall(text)) / n,
    ]


def learn_lexicon(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Words likelier in toxic texts, with their log odds.

    A toxic text counts for a word once for each word that is new before it, so that copies of one text count as one; other texts count
    as they are. A word needs LEXICON_SHARE of the toxic texts, and LEXICON_DOCS at least.
    """
    toxic = sum(labels)
    least = max(LEXICON_DOCS, LEXICON_SHARE * toxic)
    count = Counter()
    for t, y in zip(texts, labels, strict=True):
        if y:
            count.update(set(words(t)))
    # What follows is gathered for candidates only, which are few.
    before: dict[str, set] = {w: set() for w, k in count.items() if k >= least and len(w) > 2}
    del count
    plain = Counter()
    for t, y in zip(texts, labels, strict=True):
        toks = words(t)
        if y:
            first = {}
            for prev, w in zip(["", *toks], toks, strict=False):
                first.setdefault(w, prev)
            for w, prev in first.items():
                if w in before:
                    before[w].add(prev)
        else:
            plain.update(before.keys() & set(toks))
    out = {}
    for w, seen in before.items():
        k = len(seen)
        odds = (k + 0.5) / (toxic + 1) / ((plain[w] + 0.5) / (len(labels) - toxic + 1))
        if k >= least and odds >= LEXICON_ODDS:
            out[w] = math.log(odds)
    return out


class Boosted:
    """Trees over binned features for the logistic loss; a node is (feature, cut, left, right) or a leaf value."""

    def __init__(self):
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(mean / (1 - mean))
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            raw += self._run(tree, x)
        return self

    def _grow(self, binned, edges, g, h, rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = RATE * gs / (hs + 1.0)
        if not depth or len(rows) < 8:
            return leaf
        best = (1e-6, None, None)
        for f, e in enumerate(edges):
            if len(e):
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 0.05) | (hs - hl < 0.05)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            return leaf
        _, f, k = best
        left = binned[rows, f] <= k
        return (f, edges[f][k], self._grow(binned, edges, g, h, rows[left], depth - 1), self._grow(binned, edges, g, h, rows[~left], depth - 1))

    def _run(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, a, b = tree
        left = x[:, f] <= cut
        return np.where(left, self._run(a, x), self._run(b, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._run(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw, probability), rising. Each pool is drawn a little towards its neighbours' side, never to 0 or 1."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, least raw, greatest raw
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(r), float(r)])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, top = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = top
    knots = [(x, (s + 0.01) / (n + 0.02)) for s, n, lo, hi in pools for x in ((lo, hi) if hi > lo else (lo,))]
    xs, ps = np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots])
    return xs, ps


class Model:
    """Lexicon, trees and calibration; without toxic or without other training rows every score is 0."""

    def __init__(self, lexicon, trees, knots):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not len(texts):
            return np.zeros(len(texts))
        x = np.array([features(t, self.lexicon) for t in texts])
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def fit(texts: list[str | None], labels: list[int], seed: int = 11) -> Model:
    """Lexicon and trees from four fifths of the rows, with the lexicon of each half used on the other so that the trees
    don't see words through labels they came from; calibration from the last fifth."""
    y = np.array(labels, dtype=int)
    if len(set(labels)) < 2:
        return Model({}, None, None)
    part = np.random.default_rng(seed).permutation(len(y)) % 5
    if len(set(y[part == 0])) < 2 or len(set(y[part != 0])) < 2:
        part = np.where(np.arange(len(y)) % 2, 0, 1)
    fold = np.where(part % 2 == 1, 0, 1)
    train = np.flatnonzero(part != 0)
    own = learn_lexicon([texts[i] for i in train], y[train].tolist())
    x = np.zeros((len(y), len(features("", {}))))
    for k in (0, 1):
        other = [i for i in train if fold[i] != k]
        lex = learn_lexicon([texts[i] for i in other], y[other].tolist())
        for i in train:
            if fold[i] == k:
                x[i] = features(texts[i], lex)
    rest = np.flatnonzero(part == 0)
    for i in rest:
        x[i] = features(texts[i], own)
    trees = Boosted().fit(x[train], y[train].astype(float))
    return Model(own, trees, isotonic(trees.raw(x[rest]), y[rest].astype(float)))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fit on a sample, bounded per class, of docs (doc_id, text) by labels (doc_id, toxic 0 or 1); a document labelled twice counts as toxic if either says so.

    The sample's numbers are drawn from the labels first, so what is broadcast to find its texts is bounded by rows_per_class too.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: int(min(1.0, rows_per_class / n) * (1 << 30)) for k, n in counts.items()}
    limit = F.when(F.col("toxic") == 1, share.get(1, 0)).otherwise(share.get(0, 0))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < limit)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    # Of a number that many rows share, few texts are taken too.
    known = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id").select("toxic", "text")
    picked = bounded_sample(known, "text", "toxic", rows_per_class, CHARS_PER_CLASS)
    return fit([r["text"] for r in picked], [r["toxic"] for r in picked])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """OUT plus the columns named in keep, for every row of docs (doc_id, text).

    Only the whole text is an input. A null or empty text has features of 0 and the score that these get; predicted is 1 from the
    threshold up; repeated rows get equal scores; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in small(batches):
            s = shared.value.scores(b.column(1).to_pylist())
            cols = [b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols + [b.column(i) for i in range(2, b.num_columns)], names=["doc_id", "score", "predicted", *keep])

    types = dict(docs.dtypes)
    return short_batches(docs).select("doc_id", "text", *keep).mapInArrow(run, ", ".join([OUT, *(f"`{k}` {types[k]}" for k in keep)]))
