"""Removal of byte strings that occur more than once, by run-length indexes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else.  One suffix array over a corpus fits no machine, so the corpus is first
reduced to the places where repeats can be:

1. Anchors.  Every window of ``length`` bytes selects its smallest ``k``-gram
   (leftmost on ties).  The windows that select the same place form a span.
   Equal windows select equal k-grams at equal offsets, so a window whose
   k-gram occurs once in the corpus occurs once itself.
2. Equal spans.  All windows of a span that occurs again whole are repeated;
   one copy of each distinct span is enough for all further comparisons.
3. Run-length index.  Distinct spans that share a k-gram meet in a shard.  The
   shard sorts the suffixes of its spans that are long enough, forms the
   Burrows-Wheeler transform, compresses it into runs, and keeps suffix and
   longest common prefix at the ends of runs only.  Within a run those values
   go down by one from text position to text position, so streaming over the
   text gives every matching statistic from the run ends; starts that match
   ``length`` bytes or more are marked.
4. Large groups.  A k-gram with more distinct context than a shard takes is
   split by longer k-grams, up to whole windows; nothing is capped.

Every step is exact but for 128-bit fingerprints of spans.

Defined results: a null text is empty; a text shorter than ``length`` loses
nothing; texts that occur twice lose everything if long enough; rows that
repeat an id with the same text get the same result; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Scratch
from . import bytesops as B

LENGTH = 200
LEVELS = (32, 128, 192, 200)
#: Bytes of span text per index, and of one k-gram's distinct spans before it is split.
SHARD_BYTES = 1 << 19
HOT_BYTES = 1 << 19
#: Starts handled at a time within a long text.
STRETCH = 1 << 20

_SPAN_CODE = B.random_u64(256, 43)
_LOW = np.uint64((1 << 22) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (block prefixes and suffixes)."""
    if w == 1:
        return x
    n = len(x) - w + 1
    pad = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def spans_of(data: np.ndarray, off: np.ndarray, k: int, length: int):
    """Spans of a block of texts: fingerprint of the k-gram and of the span, row, start, size.

    Starts count from the row's begin.  The block must be shorter than 4 MB.
    """
    n = len(data)
    starts = n - length + 1
    if starts <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    pre = B.prefix_hashes(data)
    at = np.arange(n - k + 1)
    gram = B.span_hashes(pre, at, at + k)
    packed = (gram & ~_LOW) | at.astype(np.uint64)
    least = sliding_min(packed, length - k + 1)[:starts]
    row_end = np.repeat(off[1:], np.diff(off))[:starts]
    ok = np.arange(starts) + length <= row_end
    v = np.flatnonzero(ok)
    if not len(v):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    pick = least[v]
    new = np.ones(len(v), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (v[1:] != v[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(v)]]) - 1
    lo, hi = v[head], v[tail] + length
    fp = gram[(pick[head] & _LOW).astype(np.int64)]
    whole = B.span_hashes(B.prefix_hashes(data, _SPAN_CODE), lo, hi)
    row = np.searchsorted(off, lo, "right") - 1
    return fp.view(np.int64), whole.view(np.int64), row, lo - off[row], hi - lo


def stretches(off: np.ndarray, length: int):
    """Blocks of rows, long texts in overlapping stretches: (row i, row j, begin, end, skip)."""
    for i, j in B.blocks(off, STRETCH):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= STRETCH:
            yield i, j, lo, hi, 0
            continue
        for s in range(lo, max(hi - length + 1, lo + 1), STRETCH):
            yield i, j, s, min(s + STRETCH + length - 1, hi), s - lo


def anchor_batches(k: int, length: int):
    def run(batches):
        for batch in batches:
            data, off = B.column_bytes(batch.column(1))
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, s, e, skip in stretches(off, length):
                local = off[i : j + 1] - s if not skip and e == off[j] else np.array([0, e - s])
                fp, whole, row, lo, size = spans_of(data[s:e], local, k, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp), pa.array(whole), pa.array(uid[i + row]), pa.array(lo + skip), pa.array(size.astype(np.int32))],
                    names=["fp", "span", "uid", "lo", "size"],
                )

    return run


def slice_batches(batches):
    """(uid, body, wanted[(lo, size, fp, ask)]) to one row per wanted span."""
    for batch in batches:
        data, off = B.column_bytes(batch.column(1))
        wanted = batch.column(2)
        flat = wanted.flatten()
        lo, size, fp, ask = (np.asarray(flat.field(c)) for c in range(4))
        owner = np.repeat(np.arange(len(batch)), wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        uid = batch.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, len(lo), 20_000):
            sl = slice(a, a + 20_000)
            begin = off[owner[sl]] + lo[sl]
            bodies = [data[x : x + y].tobytes() for x, y in zip(begin, size[sl])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[owner[sl]]), pa.array(lo[sl]), pa.array(fp[sl]), pa.array(ask[sl].astype(bool)), pa.array(bodies, pa.binary())],
                names=["uid", "lo", "fp", "ask", "body"],
            )


class RunIndex:
    """Run-compressed BWT over the long suffixes of a set of short texts.

    ``order`` sorts the starts with ``length`` bytes to go; ``heads`` and
    ``tails`` are the ends of BWT runs with their sampled common prefixes.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int) -> None:
        self.n, self.length = len(data), length
        size = np.diff(off)
        end = np.repeat(off[1:], size)
        self.left = end - np.arange(self.n)
        self.starts = np.flatnonzero(self.left >= length)
        self._rank(data, end, int(size.max(initial=1)))
        text = np.repeat(np.arange(len(size)), size)
        top = self.ranks[-1][1]
        self.order = self.starts[np.lexsort((text[self.starts], top[self.starts]))]
        # a text's first suffix has a sentinel of its own before it
        before = np.where(self.order == off[text[self.order]], 256 + text[self.order], data[np.maximum(self.order - 1, 0)])
        change = np.ones(len(self.order) + 1, bool)
        change[1:-1] = before[1:] != before[:-1]
        self.heads, self.tails = np.flatnonzero(change[:-1]), np.flatnonzero(change[1:])
        self.runs = len(self.heads)

    def _rank(self, data: np.ndarray, end: np.ndarray, longest: int) -> None:
        """Ranks of the strings of 7, 14, 28, … bytes at every position, cut at text ends."""
        step = 7
        value = np.zeros(self.n, np.uint64)
        for j in range(step):
            value <<= np.uint64(9)
            inside = np.arange(self.n) + j < end
            moved = np.zeros(self.n, np.uint64)
            moved[: self.n - j] = data[j:].astype(np.uint64) + np.uint64(1)
            value |= np.where(inside, moved, 0).astype(np.uint64)
        self.ranks = [(step, self._dense(value))]
        while step < longest:
            one = self.ranks[-1][1]
            two = np.zeros(self.n, np.uint64)
            two[: max(self.n - step, 0)] = one[step:]
            two[np.arange(self.n) + step >= end] = 0
            step *= 2
            self.ranks.append((step, self._dense((one << np.uint64(32)) | two)))

    @staticmethod
    def _dense(value: np.ndarray) -> np.ndarray:
        order = np.argsort(value)
        held = value[order]
        step = np.ones(len(held), np.uint64)
        step[1:] = held[1:] != held[:-1]
        out = np.empty(len(held), np.uint64)
        out[order] = np.cumsum(step)
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes in ranked strings; up to six bytes short."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        most = np.minimum(self.left[i], self.left[j])
        for step, rank in reversed(self.ranks):
            ok = (total + step <= most) & (np.maximum(i, j) < self.n)
            ok[ok] = rank[i[ok]] == rank[j[ok]]
            i[ok] += step
            j[ok] += step
            total[ok] += step
        return total

    def matches(self, data: np.ndarray) -> np.ndarray:
        """Starts whose string of ``length`` bytes occurs at another start."""
        hit = np.zeros(self.n, bool)
        for ends, towards in ((self.heads, -1), (self.tails, 1)):
            other = ends + towards
            real = (other >= 0) & (other < len(self.order))
            here = self.order[ends]
            shared = np.zeros(len(ends), np.int64)
            shared[real] = self._exact(data, here[real], self.order[other[real]])
            # stream: between sampled places the statistic falls by one a byte
            sample = np.full(self.n, -1, np.int64)
            sample[here] = here
            last = np.maximum.accumulate(sample)
            value = np.zeros(self.n, np.int64)
            value[here] = shared
            s = self.starts
            hit[s] |= value[last[s]] - (s - last[s]) >= self.length
        return self.starts[hit[self.starts]]

    def _exact(self, data: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefix of suffixes, not past either text's end."""
        total = self.common(i, j)
        most = np.minimum(self.left[i], self.left[j])
        for _ in range(6):
            more = total < most
            if not more.any():
                break
            at = np.flatnonzero(more)
            same = data[i[at] + total[at]] == data[j[at] + total[at]]
            total[at[same]] += 1
            most[at[~same]] = total[at[~same]]
        return total


def index_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        data, off = B.column_bytes(table.column("body"))
        index = RunIndex(data, off, length)
        found = index.matches(data)
        text = np.searchsorted(off, found, "right") - 1
        ask = table.column("ask").to_numpy()
        keep = ask[text]
        found, text = found[keep], text[keep]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1] + 1) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(found)]]).astype(np.int64) - 1 if len(head) else head
        t = text[head]
        base = table.column("lo").to_numpy()[t] - off[t]
        return pa.table(
            {"uid": pa.array(table.column("uid").to_numpy()[t]), "lo": pa.array(base + found[head]), "hi": pa.array(base + found[tail] + length)},
            schema=pa.schema([("uid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]),
        )

    return run


RUNS = "uid long, lo long, hi long"


def repeated_runs(units: DataFrame, length: int = LENGTH, levels: tuple[int, ...] = LEVELS, scratch: Scratch | None = None) -> DataFrame:
    """Byte runs ``(uid, lo, hi)`` to remove from units ``(uid, body)``; runs may overlap."""
    scratch = scratch or Scratch(units.sparkSession)
    cut = scratch.cut
    k, deeper = levels[0], levels[1:]
    spans = cut(units.mapInArrow(anchor_batches(k, length), "fp long, span long, uid long, lo long, size int"), "spans")
    again = spans.groupBy("fp").agg(F.count("*").alias("t")).where("t > 1").select("fp")
    held = cut(spans.join(again, "fp"), "occurrences")
    scratch.release(spans)
    kinds = held.groupBy("fp", "span", "size").agg(F.count("*").alias("c"), F.min(F.struct("uid", "lo")).alias("at"))
    kinds = cut(kinds, "kinds")
    groups = kinds.groupBy("fp").agg(F.count("*").alias("kinds"), F.sum("size").alias("mass")).where("kinds > 1")
    whole = held.join(kinds.where("c > 1").select("fp", "span", "size"), ["fp", "span", "size"], "left_semi")
    out = whole.select("uid", "lo", (F.col("lo") + F.col("size")).alias("hi"))
    compare = kinds.join(groups, "fp").select("fp", F.col("at.uid").alias("uid"), F.col("at.lo").alias("lo"), "size", (F.col("c") == 1).alias("ask"), "mass")
    compare = cut(compare, "compare")
    # groups where every span is repeated whole have nothing to ask
    asks = compare.groupBy("fp").agg(F.max("ask").alias("any_ask")).where("any_ask").select("fp")
    compare = compare.join(asks, "fp", "left_semi")
    lists = compare.groupBy("uid").agg(F.collect_list(F.struct("lo", "size", "fp", "ask")).alias("wanted"))
    # a unit that occurs twice has no span to ask for, so its repeats are harmless here
    pieces = cut(units.join(lists, "uid").select("uid", "body", "wanted").mapInArrow(slice_batches, "uid long, lo long, fp long, ask boolean, body binary"), "pieces")
    hot = compare.where(F.col("mass") > HOT_BYTES).select("fp").distinct() if deeper else None
    cool = pieces.join(hot, "fp", "left_anti") if deeper else pieces
    total = compare.agg(F.sum("size")).first()[0] or 0
    shards = int(total // SHARD_BYTES) + 1
    indexed = cool.groupBy(F.pmod(F.xxhash64("fp"), F.lit(shards)).alias("shard")).applyInArrow(index_shard(length), RUNS)
    out = out.unionByName(cut(indexed, "indexed"))
    if deeper:
        rest = pieces.join(hot, "fp", "left_semi").select(F.xxhash64("uid", "lo").alias("sub"), "uid", F.col("lo").alias("base"), "body")
        rest = cut(rest, "rest")
        if not rest.isEmpty():
            below = repeated_runs(rest.select(F.col("sub").alias("uid"), "body"), length, deeper, scratch)
            placed = below.withColumnRenamed("uid", "sub").join(rest.select("sub", "uid", "base"), "sub")
            out = out.unionByName(placed.select("uid", (F.col("base") + F.col("lo")).alias("lo"), (F.col("base") + F.col("hi")).alias("hi")))
    return out


def keep_batches(batches):
    """(id, text, runs) to sizes, merged runs and the digest of what is left."""
    for batch in batches:
        data, off = B.column_bytes(batch.column(1))
        runs = batch.column(2)
        n_bytes, removed, spans, digest, merged = np.diff(off), [], [], [], []
        for r in range(len(batch)):
            text = data[off[r] : off[r + 1]]
            gone = sorted((x["lo"], x["hi"]) for x in runs[r].as_py() or ())
            own: list[tuple[int, int]] = []
            for lo, hi in gone:
                if own and lo <= own[-1][1]:
                    own[-1] = (own[-1][0], max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
            h, at = hashlib.sha256(), 0
            for lo, hi in own:
                h.update(text[at:lo].tobytes())
                at = hi
            h.update(text[at:].tobytes())
            removed.append(sum(hi - lo for lo, hi in own))
            spans.append(len(own))
            digest.append(h.hexdigest())
            merged.append([{"lo": lo, "hi": hi} for lo, hi in own])
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(merged, kind)],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"],
        )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, runs)`` for every row.

    ``runs`` are the maximal removed byte runs ``[lo, hi)`` of the input text.
    """
    if levels[-1] != length or any(k > length for k in levels):
        raise ValueError("the last level must be the window's length")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    texts = texts.withColumn("uid", F.xxhash64("id", "body"))
    scratch = Scratch(docs.sparkSession)
    found = repeated_runs(texts.select("uid", "body"), length, levels, scratch)
    per = scratch.cut(found.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "runs")
    scratch.release(but=(per,))
    joined = texts.join(per, "uid", "left").select("id", "body", "runs")
    return joined.mapInArrow(keep_batches, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs array<struct<lo:long,hi:long>>")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: all whole texts of ``documents`` at 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
