"""Language identification: averaged hashed subword embeddings and a linear softmax.

Character trigrams of the letters of a text (every run of other characters counting as one space) are hashed to rows of an embedding table;
their mean goes through a linear softmax. Both are trained together by stochastic gradient descent in numpy.
A held-back part of the training rows gives the temperature of the softmax and the confidence below which a
prediction is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_sample, short_batches, small

#: Different texts of each language to learn from, and characters of all languages, at most (expected); chosen by hash over the whole table.
ROWS_PER_LANGUAGE, TRAINING_CHARS = 1000, 100_000_000
#: Languages to learn, the most frequent ones: each is a column of the model, which every task gets.
MOST_LANGUAGES = 200
TABLE = 1 << 15  # at most 1 << 16: rows are kept as 16-bit numbers
DIM = 16
EPOCHS = 4
RATE = 0.5
#: Share of predictions above the rejection threshold that may be wrong, and the range that the threshold may lie in.
ACCEPTED_ERROR = 0.02
THRESHOLD_RANGE = (0.3, 0.9)
UNKNOWN = "und"
OUT = "doc_id long, lang_pred string, score double, rejected boolean"
_CHUNK = 1 << 17
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point: its simple lower case if it is a letter, else 0."""
    if not _LETTER:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(t)
    return _LETTER[0]


def subwords(texts: list[str | None]):
    """Yield the hashed trigrams of every text, in order; none where it is null or has no letter."""
    table = _letters()
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= _CHUNK):
            size += len(texts[end] or "")
            end += 1
        part = texts[at:end]
        at = end
        joined = "\n" + "\n".join(t or "" for t in part) + "\n"
        cp = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum([1] + [len(t or "") + 1 for t in part])
        # One space stands for every run of other characters; text borders lie in such runs and belong to the text before.
        keep = np.ones(len(cp), bool)
        keep[1:] = (cp[1:] != 0) | (cp[:-1] != 0)
        keep[starts[:-1]] = True
        border = np.cumsum(keep)[starts - 1]
        c = cp[keep].astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        if len(c) >= 3:
            h[1:-1] = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h >> np.uint64(64 - TABLE.bit_length() + 1)).astype(np.uint16)
        middle = np.zeros(len(c), bool)
        middle[1:-1] = c[1:-1] != 0
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            yield h[a:b][middle[a:b]]


class Model:
    """Trained languages, class scores of every subword row, bias, temperature and rejection threshold."""

    def __init__(self, langs, rows, bias, temperature, threshold):
        self.langs, self.rows, self.bias, self.temperature, self.threshold = langs, rows, bias, temperature, threshold

    def confidences(self, grams: np.ndarray) -> np.ndarray:
        z = (self.rows[grams].mean(0, dtype=np.float64) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, grams: np.ndarray) -> tuple[str, float, bool]:
        if not len(grams):
            return UNKNOWN, 0.0, True
        if not self.langs:
            return UNKNOWN, 0.0, False
        p = self.confidences(grams)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k])), bool(p[k] < self.threshold)


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Train on whole texts and on random stretches of them, so that short texts are known as well. Without rows the model knows no language."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((TABLE, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    grams = list(subwords(texts))
    y = np.array([langs.index(x) for x in labels])
    rows = [i for i in range(len(grams)) if len(grams[i])]
    held = set(rng.permutation(rows)[: len(rows) // 5].tolist()) if len(rows) >= 10 else set()
    train = [i for i in rows if i not in held]
    emb = (rng.standard_normal((TABLE, DIM)) * 0.1).astype(np.float32)
    w, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    weight = len(train) / (len(langs) * np.maximum(1, np.bincount(y[train], minlength=len(langs)))) if train else np.ones(len(langs))
    steps, total = 0, EPOCHS * len(train)
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            g = grams[i]
            n = int(min(len(g), 2 ** rng.uniform(3, 10)))
            s = int(rng.integers(0, len(g) - n + 1))
            g = g[s : s + n]
            h = emb[g].mean(0)
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            rate = RATE * (1 - steps / total) * min(2.0, weight[y[i]])
            back = w @ p
            w -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            u, times = np.unique(g, return_counts=True)
            emb[u] -= (4 * rate / n * times)[:, None].astype(np.float32) * back
            steps += 1
    table = emb @ w
    model = Model(langs, table, bias.astype(np.float64), 1.0, 0.0)
    if held:
        _calibrate(model, [grams[i] for i in sorted(held)], y[sorted(held)], rng)
    return model


def _calibrate(model: Model, grams: list[np.ndarray], y: np.ndarray, rng) -> None:
    """Temperature of least loss on held-back rows; then the least threshold above which few enough are wrong, within THRESHOLD_RANGE."""
    z = np.stack([model.rows[g].mean(0, dtype=np.float64) + model.bias for g in grams])

    def probabilities(t):
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    losses = [(-np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12).mean(), t) for t in np.geomspace(0.05, 5, 60)]
    model.temperature = float(min(losses)[1])
    p = probabilities(model.temperature)
    conf, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-conf)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    # Rows of equal confidence are accepted together.
    ends = np.append(conf[order][1:] < conf[order][:-1], True)
    ok = np.flatnonzero((wrong <= ACCEPTED_ERROR) & ends)
    least = float(conf[order][ok[-1]]) if len(ok) and ok[-1] < len(y) - 1 else (0.0 if len(ok) else 1.0)
    model.threshold = min(max(least, THRESHOLD_RANGE[0]), THRESHOLD_RANGE[1])


def train(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """Fit on a sample of labelled (text, lang), bounded per language; rows without text or lang are not used, nor are languages beyond the most frequent ones (of equals the first by name)."""
    rows = labelled.select("text", "lang").where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_languages)
    langs = [r["lang"] for r in counts.collect()]
    picked = bounded_sample(rows.where(F.col("lang").isin(langs)), "text", "lang", rows_per_language, TRAINING_CHARS // max(1, len(langs))) if langs else []
    return fit([r["text"] for r in picked], [r["lang"] for r in picked])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """OUT plus the columns named in keep, for every row of docs (doc_id, text).

    Only the text is an input. A null text or one without letters is 'und' with score 0 and rejected; any other gets the
    likeliest language the model knows and its calibrated probability, and is rejected below the model's threshold. A
    model without languages says 'und' and rejects only texts without letters. Repeated rows get equal results; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in small(batches):
            found = [m.predict(g) for g in subwords(b.column(1).to_pylist())]
            cols = [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols + [b.column(i) for i in range(2, b.num_columns)], names=["doc_id", "lang_pred", "score", "rejected", *keep])

    types = dict(docs.dtypes)
    return short_batches(docs).select("doc_id", "text", *keep).mapInArrow(run, ", ".join([OUT, *(f"`{k}` {types[k]}" for k in keep)]))
