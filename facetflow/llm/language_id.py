"""Language identification of spans: script ranges, word scores, Viterbi.

Words are maximal runs of letters.  A word's script (by code point ranges)
leaves only the languages that were seen in that script; the others pay a fixed
penalty.  Among them a word is scored by its hashed byte trigrams, with its
edges marked.  Viterbi over the words of a text, with a penalty for every
switch, labels spans; the language that covers most letters is the text's, and
its share of the letters, times the mean margin of its words, is the score.

The tables are counted on a bounded sample, ``per_language`` rows of each
language; whole texts are labelled, all texts of a batch step by step together.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a table without any labelled row gives ``und`` everywhere; repeated ids are
labelled row by row; ties go to the first language in sorted order; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .sampling import bounded, fold

#: Documented bound of the training sample, rows of each language.
PER_LANGUAGE = 800
TABLE = 1 << 16
SWITCH = 12.0
WRONG_SCRIPT = 25.0
#: First code points of script ranges and the script that begins there.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFB50, "arabic"), (0xFF00, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """2 for letters, 1 for marks, which belong to words, by code point; else 0."""
    kind = {"L": 2, "M": 1}
    return np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def decode(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: code point of the character it belongs to; whether it begins one."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(np.int32)
    cp = first.copy()
    pad = np.concatenate([data, np.zeros(4, np.uint8)])
    for n, low, high, mask in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
        sel = np.flatnonzero((first >= low) & (first < high))
        if not len(sel):
            continue
        value = first[sel] & mask
        for j in range(1, n):
            value = (value << 6) | (pad[at[sel] + j] & 0x3F)
        cp[sel] = value
    return np.repeat(cp, np.diff(np.concatenate([at, [len(data)]]))), lead


def letter_words(data: np.ndarray, off: np.ndarray):
    """Starts, ends, rows, letters and script (index) of the words of a block."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    cp, lead = decode(data)
    kind = letters()[np.minimum(cp, 0x10FFFF)]
    inside = kind > 0
    sep = ~inside
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= sep[:-1] | first[1:-1]
    ends[:-1] &= sep[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    real = np.concatenate([[0], np.cumsum(kind == 2)])
    some = real[e] > real[s]
    s, e = s[some], e[some]
    chars = np.concatenate([[0], np.cumsum(lead)])
    bounds = np.array([b for b, _ in SCRIPTS])
    index = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
    script = index[np.searchsorted(bounds, cp[s], "right") - 1]
    return s, e, np.searchsorted(off, s, "right") - 1, chars[e] - chars[s], script


def lower_letters(data: np.ndarray) -> np.ndarray:
    """A-Z, and the two-byte capitals U+00C0 to U+00DE, to lower case."""
    out = B.LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    cap = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[cap] += 0x20
    return out


def trigram_slots(data: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Table slots of the trigrams of ``_word_`` by bytes, and word of each."""
    size = e - s
    n = size  # a word of m bytes has m trigrams with one mark on either side
    word = np.repeat(np.arange(len(s)), n)
    k = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    mid = s[word] + k
    wide = np.concatenate([data, np.zeros(1, np.uint8)]).astype(np.uint32)
    left = np.where(k == 0, 1, wide[np.maximum(mid - 1, 0)])
    right = np.where(k == size[word] - 1, 2, wide[mid + 1])
    code = (left * np.uint32(0x9E3779B1) + wide[mid] * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)).astype(np.uint32)
    return ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64), word


class LanguageModel:
    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.logp = np.zeros((TABLE, len(names)), np.float32)
        self.allowed = np.zeros((len(SCRIPT_NAMES), len(names)), bool)

    def fit(self, data: np.ndarray, off: np.ndarray, lang: np.ndarray) -> "LanguageModel":
        counts = np.zeros((TABLE, len(self.names)))
        scripts = np.zeros(self.allowed.shape)
        for i, j in B.blocks(off):
            part = lower_letters(data[off[i] : off[j]])
            s, e, row, _, script = letter_words(part, off[i : j + 1] - off[i])
            slot, word = trigram_slots(part, s, e)
            own = lang[i:j][row]
            np.add.at(counts, (slot, own[word]), 1)
            np.add.at(scripts, (script, own), 1)
        p = counts + 0.1
        self.logp = np.log(p / p.sum(axis=0)).astype(np.float32)
        self.allowed = scripts >= np.maximum(0.01 * scripts.sum(axis=0), 1)
        return self

    def words(self, data: np.ndarray, off: np.ndarray):
        """Row, letters and per-language score of each word."""
        part = lower_letters(data)
        s, e, row, size, script = letter_words(part, off)
        score = np.zeros((len(s), len(self.names)), np.float32)
        if len(s):
            slot, word = trigram_slots(part, s, e)
            first = np.searchsorted(word, np.arange(len(s)))
            score = np.add.reduceat(self.logp[slot], first, axis=0)
            # a script that no language has says nothing
            ok = self.allowed[script]
            score = np.where(ok | ~ok.any(axis=1)[:, None], score, score - np.float32(WRONG_SCRIPT))
            score[~ok.any(axis=1)] = 0
        return row, size, score


def viterbi(score: np.ndarray, begin: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word; texts advance together, longest first."""
    n_lang = score.shape[1]
    kind = np.min_scalar_type(-max(n_lang, 1))  # signed, wide enough for every label
    out = np.zeros(len(score), kind)
    if not len(score):
        return out
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    begin, count = begin[order], count[order]
    active = np.searchsorted(-count, -np.arange(count[0]), "left")  # texts with more than t words
    back = np.zeros(score.shape, kind)
    best = score[begin].copy()
    last = np.zeros((len(begin), n_lang), np.float32)
    stay_id = np.arange(n_lang, dtype=kind)
    last[:] = best
    for t in range(1, count[0]):
        n = active[t]
        top = best[:n].argmax(axis=1)
        move = best[np.arange(n), top] - np.float32(switch)
        keep = best[:n] >= move[:, None]
        at = begin[:n] + t
        back[at] = np.where(keep, stay_id, top[:, None].astype(kind))
        best = np.where(keep, best[:n], move[:, None]) + score[at]
        last[:n] = best
    state = last.argmax(axis=1)
    # walk back; texts join as their last word is reached
    for t in range(count[0] - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        out[at] = state[:n]
        state[:n] = back[at, state[:n]] if t else state[:n]
    return out


def label_batches(model: LanguageModel, switch: float, with_spans: bool):
    def run(batches):
        names = np.array([*model.names, "und"], object)
        for batch in batches:
            data, off = B.column_bytes(batch.column(1))
            rows, sizes, scores = [], [], []
            for i, j in B.blocks(off):
                row, size, score = model.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                rows.append(row + i)
                sizes.append(size)
                scores.append(score)
            n, k = len(batch), len(model.names)
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            score = np.concatenate(scores) if scores else np.zeros((0, max(k, 1)), np.float32)
            count = np.bincount(row, minlength=n)
            begin = np.cumsum(count) - count
            pick, conf = np.full(n, k), np.zeros(n)
            label = np.zeros(len(row), np.int8)
            if k and len(row):
                label = viterbi(score, begin, count, switch)
                mass = np.bincount(row * k + label, weights=size, minlength=n * k).reshape(n, k)
                total = mass.sum(axis=1)
                some = total > 0
                pick[some] = mass[some].argmax(axis=1)
                own = label == pick[row]
                second = np.partition(score, -2, axis=1)[:, -2] if k > 1 else score[:, 0] - 10
                margin = np.clip(score[np.arange(len(row)), label] - second, 0, 10) / 10
                mean = np.bincount(row[own], weights=margin[own] * size[own], minlength=n) / np.maximum(np.bincount(row[own], weights=size[own], minlength=n), 1)
                conf[some] = mass[some].max(axis=1) / total[some] * (0.5 + 0.5 * mean[some])
            cols = [batch.column(0), pa.array(names[pick], pa.string()), pa.array(np.clip(conf, 0, 1))]
            if with_spans:
                new = np.ones(len(row), bool)
                new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                head = np.flatnonzero(new)
                tail = np.concatenate([head[1:], [len(row)]]).astype(np.int64)
                per = np.concatenate([[0], np.cumsum(np.bincount(row[head], minlength=n))])
                kind = [pa.array((head - begin[row[head]]).astype(np.int64)), pa.array((tail - begin[row[head]]).astype(np.int64)), pa.array(names[label[head]] if k else np.full(len(head), "und", object), pa.string())]
                cols.append(pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.StructArray.from_arrays(kind, ["first", "last", "lang"])))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "lang_pred", "score", "spans"][: len(cols)])

    return run


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    rows = docs.where(F.col("lang").isNotNull() & (fold() != 0) & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    held = bounded(rows, "lang", per_language).toArrow()
    lang = np.array(held.column("lang").to_pylist(), object)
    names = sorted(set(lang))
    data, off = B.column_bytes(held.column("text"))
    return LanguageModel(names).fit(data, off, np.array([names.index(x) for x in lang], np.int64))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score[, spans])`` for every row.

    ``spans`` are runs of words (first, last + 1) with their language.
    """
    model = train(docs, per_language)
    kind = "id long, lang_pred string, score double" + (", spans array<struct<first:long,last:long,lang:string>>" if spans else "")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(label_batches(model, switch, spans), kind)
    return out.select(F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "lang_pred", "score", *(["spans"] if spans else []))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """The query: every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, spans=False)
