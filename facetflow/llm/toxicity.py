"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed; an embedding is the sum over a word's buckets (the whole word
and its first 4, 5 and 6 bytes, so that inflected forms share weight).  Filters
of several widths slide over the words of a text, each keeps its maximum, and a
logistic unit weighs the maxima.  Since only the maximal windows carry
gradient, training is cheap.

Thresholds are calibrated by language on rows that the weights never saw.  The
language comes from the text itself (function words), never from a column; the
score is stretched so that the language's threshold lies at 0.5.

Fitting uses a bounded sample, ``per_class`` rows of each label; scoring runs
over all whole texts in blocks of bounded size.

Defined results: null and empty texts get the score of a text without words;
rows without a label are scored but not learned from; with no or one class of
labels every score is the share of that class; repeated ids are scored row by
row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .sampling import bounded, fold

#: Documented bound of the training sample, rows of each label.
PER_CLASS = 2500
#: Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "for", "with", "was", "this"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "von", "auf", "den"),
    "fr": ("le", "et", "les", "est", "dans", "une", "des", "du", "pour", "qui"),
    "es": ("el", "los", "y", "del", "por", "las", "con", "se", "su", "para"),
}


def hash_words(data: np.ndarray, off: np.ndarray, buckets: int):
    """Bucket ids (n, 4), row of each word, and the hash of the whole word."""
    s, e, row = B.word_spans(data, off, B.PUNCT)
    pre = B.prefix_hashes(data)
    full = B.span_hashes(pre, s, e)
    ids = np.empty((len(s), 4), np.int32)
    ids[:, 0] = full % np.uint64(buckets)
    for c, n in enumerate((4, 5, 6), 1):
        ids[:, c] = (B.span_hashes(pre, s, np.minimum(s + n, e)) ^ np.uint64(n * 0x9E37)) % np.uint64(buckets)
    return ids, row, full


def word_code(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(B.span_hashes(B.prefix_hashes(raw), np.array([0]), np.array([len(raw)]))[0])


def guess_languages(full: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Index into FUNCTION_WORDS per row, by count of function words; len() if none."""
    names = list(FUNCTION_WORDS)
    codes = np.array([word_code(w) for k in names for w in FUNCTION_WORDS[k]], np.uint64)
    lang = np.repeat(np.arange(len(names)), [len(FUNCTION_WORDS[k]) for k in names])
    order = np.argsort(codes)
    codes, lang = codes[order], lang[order]
    at = np.minimum(np.searchsorted(codes, full), len(codes) - 1)
    hit = codes[at] == full
    votes = np.zeros((n_rows, len(names)), np.int64)
    np.add.at(votes, (row[hit], lang[at[hit]]), 1)
    return np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), len(names))


@dataclass
class TextCNN:
    """Hashed embeddings, filters of several widths, max pooling, logistic output."""

    buckets: int = 1 << 15
    dim: int = 12
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    seed: int = 7
    prior: float = 0.5
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(FUNCTION_WORDS) + 1, 0.5))

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.table = rng.normal(0, 0.1, (self.buckets, self.dim)).astype(np.float32)
        self.conv = [rng.normal(0, 0.3, (w, self.dim, self.filters)).astype(np.float32) for w in self.widths]
        self.shift = [np.zeros(self.filters, np.float32) for _ in self.widths]
        self.out = rng.normal(0, 0.3, len(self.widths) * self.filters).astype(np.float32)
        self.bias = np.float32(0)
        self.fitted = False

    def embed(self, ids: np.ndarray) -> np.ndarray:
        out = self.table[ids[:, 0]].copy()
        for c in range(1, ids.shape[1]):
            out += self.table[ids[:, c]]
        return out

    def _laid(self, ids: np.ndarray, row: np.ndarray, n_rows: int):
        """Word places with a gap of zeros behind each text, and where texts begin."""
        gap = max(self.widths) - 1
        place = np.arange(len(row)) + row * gap
        count = np.bincount(row, minlength=n_rows)
        begin = np.concatenate([[0], np.cumsum(count)])[:-1] + np.arange(n_rows) * gap
        x = np.zeros((len(row) + n_rows * gap + gap, self.dim), np.float32)
        x[place] = self.embed(ids)
        return x, place, begin, count

    def pooled(self, ids: np.ndarray, row: np.ndarray, n_rows: int, want_places: bool = False):
        x, _, begin, count = self._laid(ids, row, n_rows)
        gap = max(self.widths) - 1
        n = len(x) - gap
        some = np.flatnonzero(count)
        out = np.zeros((n_rows, len(self.widths) * self.filters), np.float32)
        places = np.zeros(out.shape, np.int64) if want_places else None
        for i, (w, filt, shift) in enumerate(zip(self.widths, self.conv, self.shift)):
            a = x[:n] @ filt[0]
            for j in range(1, w):
                a += x[j : j + n] @ filt[j]
            a += shift
            sl = slice(i * self.filters, (i + 1) * self.filters)
            # the gap rows behind a text belong to it and hold only its last windows
            for r, b, c in zip(some, begin[some], count[some]) if want_places else ():
                part = a[b : b + c]
                top = part.argmax(axis=0)
                places[r, sl] = b + top
                out[r, sl] = np.maximum(part[top, np.arange(self.filters)], 0)
            if not want_places and len(some):
                edge = np.empty(2 * len(some), np.int64)
                edge[0::2], edge[1::2] = begin[some], begin[some] + count[some]
                out[some, sl] = np.maximum(np.maximum.reduceat(a, np.minimum(edge, n - 1), axis=0)[0::2], 0)
        return (out, places, x) if want_places else out

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30)))

    def fit(self, texts: list[tuple[np.ndarray, int]], epochs: int = 8, rate: float = 0.02, batch: int = 32) -> None:
        """Adam on mini-batches of (bucket ids, label)."""
        rng = np.random.default_rng(self.seed)
        y = np.array([t[1] for t in texts], np.float32)
        if not len(y) or y.min() == y.max():
            self.prior = float(y.mean()) if len(y) else 0.0
            return
        self.fitted = True
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        params = [self.table, *self.conv, *self.shift, self.out]
        mom = [np.zeros_like(p) for p in params]
        vel = [np.zeros_like(p) for p in params]
        bm = bv = 0.0
        step = 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(texts)), max(len(texts) // batch, 1)):
                ids = np.concatenate([texts[i][0] for i in part])
                row = np.repeat(np.arange(len(part)), [len(texts[i][0]) for i in part])
                out, places, x = self.pooled(ids, row, len(part), want_places=True)
                err = (self.raw(out) - y[part]) * weight[part] / len(part)
                d_out = out.T @ err
                d_pool = np.outer(err, self.out) * (out > 0)
                step += 1
                gap = max(self.widths) - 1
                word_at = np.full(len(x), -1, np.int64)
                word_at[np.arange(len(row)) + row * gap] = np.arange(len(row))
                grads_w, grads_b = [], []
                hit_words, hit_grads = [], []
                for i, (w, filt) in enumerate(zip(self.widths, self.conv)):
                    sl = slice(i * self.filters, (i + 1) * self.filters)
                    g, p = d_pool[:, sl], places[:, sl]
                    gw = np.zeros_like(filt)
                    for j in range(w):
                        seen = x[p + j]
                        gw[j] = np.einsum("rfd,rf->df", seen, g)
                        word = word_at[p + j].ravel()
                        back = (g[:, :, None] * filt[j].T[None]).reshape(-1, self.dim)
                        ok = (word >= 0) & (g.ravel() != 0)
                        hit_words.append(word[ok])
                        hit_grads.append(back[ok])
                    grads_w.append(gw)
                    grads_b.append(g.sum(axis=0))
                word, grad = np.concatenate(hit_words), np.concatenate(hit_grads)
                touched, inverse = np.unique(ids[word].ravel(), return_inverse=True)
                g_rows = np.zeros((len(touched), self.dim), np.float32)
                np.add.at(g_rows, inverse, np.repeat(grad, ids.shape[1], axis=0))
                lr = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in enumerate([(touched, g_rows), *grads_w, *grads_b, d_out]):
                    at, g = g if isinstance(g, tuple) else (slice(None), g)
                    mom[k][at] = 0.9 * mom[k][at] + 0.1 * g
                    vel[k][at] = 0.999 * vel[k][at] + 0.001 * g * g
                    params[k][at] -= lr * mom[k][at] / (np.sqrt(vel[k][at]) + 1e-7)
                g = float(err.sum())
                bm, bv = 0.9 * bm + 0.1 * g, 0.999 * bv + 0.001 * g * g
                self.bias = np.float32(self.bias - lr * bm / (np.sqrt(bv) + 1e-7))

    def calibrate(self, raw: np.ndarray, y: np.ndarray, lang: np.ndarray) -> None:
        """Per language the threshold of the fewest errors, half way to its neighbours."""

        def best(p: np.ndarray, t: np.ndarray) -> float:
            order = np.argsort(p, kind="stable")
            p, t = p[order], t[order]
            errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
            low = np.flatnonzero(errors == errors.min())
            cut = low[len(low) // 2]
            lo = p[cut - 1] if cut else 0.0
            hi = p[cut] if cut < len(p) else 1.0
            return float(np.clip((lo + hi) / 2, 0.02, 0.98))

        common = best(raw, y) if len(y) and 0 < y.mean() < 1 else 0.5
        self.thresholds[:] = common
        for k in range(len(self.thresholds)):
            own = lang == k
            if own.sum() >= 50 and 5 <= y[own].sum() <= own.sum() - 5:
                self.thresholds[k] = best(raw[own], y[own])

    def score(self, ids: np.ndarray, row: np.ndarray, full: np.ndarray, n_rows: int) -> np.ndarray:
        if not self.fitted:
            return np.full(n_rows, self.prior)
        raw = self.raw(self.pooled(ids, row, n_rows)).astype(np.float64)
        t = self.thresholds[guess_languages(full, row, n_rows)]
        return np.where(raw < t, 0.5 * raw / t, 0.5 + 0.5 * (raw - t) / (1 - t))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> TextCNN:
    """Fit on rows whose fold is not 0; a fifth of them only calibrates."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = F.broadcast(bounded(known, "toxic", per_class))  # at most 4 * per_class rows
    rows = docs.select("doc_id", "text").join(picked, "doc_id").limit(4 * per_class).toArrow()
    model = TextCNN()
    data, off = B.column_bytes(rows.column("text"))
    y = np.asarray(rows.column("toxic")).astype(np.int64)
    order = np.argsort(np.asarray(rows.column("doc_id")).astype(np.int64), kind="stable")
    per: list = [None] * len(y)
    lang = np.zeros(len(y), np.int64)
    for i, j in B.blocks(off):
        local = off[i : j + 1] - off[i]
        ids, row, full = hash_words(B.LOWER[data[off[i] : off[j]]], local, model.buckets)
        bound = np.searchsorted(row, np.arange(j - i + 1))
        lang[i:j] = guess_languages(full, row, j - i)
        for r in range(j - i):
            per[i + r] = ids[bound[r] : bound[r + 1]]
    fit, held = [i for n, i in enumerate(order) if n % 5], [i for n, i in enumerate(order) if n % 5 == 0]
    model.fit([(per[i], y[i]) for i in fit])
    if model.fitted and held:
        row = np.repeat(np.arange(len(held)), [len(per[i]) for i in held])
        raw = model.raw(model.pooled(np.concatenate([per[i] for i in held]), row, len(held)))
        model.calibrate(raw, y[held], lang[held])
    return model


def score_batches(model: TextCNN):
    def run(batches):
        for batch in batches:
            data, off = B.column_bytes(batch.column(1))
            score = np.zeros(len(batch))
            for i, j in B.blocks(off, 1 << 20):
                ids, row, full = hash_words(B.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], model.buckets)
                score[i:j] = model.score(ids, row, full, j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    model = train(docs, labels, per_class)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(score_batches(model), "id long, score double")
    return out.select(F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_batches(model: TextCNN, text_at: int):
    def run(batches):
        for batch in batches:
            data, off = B.column_bytes(batch.column(text_at))
            score = np.zeros(len(batch))
            for i, j in B.blocks(off, 1 << 20):
                ids, row, full = hash_words(B.LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], model.buckets)
                score[i:j] = model.score(ids, row, full, j - i)
            yield batch.filter(pa.array(score < 0.5))

    return run


def clean_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = train(docs, labels, per_class)
    return docs.mapInArrow(clean_batches(model, docs.columns.index("text")), docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The query: every whole text of ``documents``, learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
