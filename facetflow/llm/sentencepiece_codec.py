"""SentencePiece encoding by sampling, and decoding.

Each text is a lattice: nodes are byte places, edges the pieces that match
there, and bytes of characters that no piece covers.  Forward filtering sums the
weights of all ways to a node; backward sampling draws an edge at a time from
the end, so a segmentation comes with its probability under the lattice.  The
draws are a hash of seed, row key, unit and step, hence the same on any
partitioning.  Pieces never hold a space behind a letter, so the lattice splits
into units (spaces and what follows them); equal units share one filtering pass, kept
for the next block up to a bound, and all occurrences of a block are sampled
side by side.  A text longer than a block is handled in stretches that end where
units end, and a unit longer than ``LONG_UNIT`` window by window, so memory does
not grow with a text but for its own pieces.

A piece of rank r weighs ``(r + 10) ** -alpha``; a large ``alpha`` prefers few
and frequent pieces.  The model holds merges and no probabilities, and ranks are
what it has instead.

Decoding joins the pieces and drops the leading space that encoding adds.  It is
lossless for every text: a literal U+2581, control characters and unknown
characters go through byte pieces.

Defined results: a null text encodes like an empty one, to no pieces; a row
without a key draws from its text; repeated rows get the same pieces; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bytesops as B

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Text handled at a time; a longer text is handled in stretches.
BLOCK_BYTES = 1 << 18
#: Bytes of distinct units whose lattices are kept.
KEPT_BYTES = 1 << 19
#: A longer unit is filtered window by window.
LONG_UNIT = 1 << 15
#: Probabilities are held as shares of this many; draws are below it.
SCALE = 1 << 40
MADE = ("n_pieces", "pieces", "lossless")
KIND = "n_pieces long, pieces array<int>, lossless boolean"


@dataclass
class Pieces:
    """Vocabulary as byte strings, read on the driver and shipped with the task."""

    data: np.ndarray
    off: np.ndarray
    weight: np.ndarray
    byte_id: np.ndarray
    usable: np.ndarray

    @classmethod
    def load(cls, path: str, alpha: float) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        strings, byte_id, usable = [], np.full(256, -1, np.int64), np.zeros(n, bool)
        rank = np.full(n, float(n))
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                byte_id[value] = i
                strings.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                strings.append(b"")
            else:
                strings.append(piece.replace(MARK, " ").encode())
                usable[i] = True
                if model.get_score(i) > -1e8:
                    rank[i] = -model.get_score(i)
        if (byte_id < 0).any():
            raise ValueError("the model has no byte fallback, so it cannot be lossless")
        off = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        return cls(np.frombuffer(b"".join(strings), np.uint8), off, -alpha * np.log(rank + 10.0), byte_id, usable)

    def lookup(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length in bytes: sorted hashes, piece ids, and which leading 16 bits occur."""
        pre = B.prefix_hashes(self.data)
        size = np.diff(self.off)
        out = {}
        for n in np.unique(size[self.usable]):
            ids = np.flatnonzero(self.usable & (size == n))
            h = B.span_hashes(pre, self.off[ids], self.off[ids] + n)
            order = np.argsort(h)
            seen = np.zeros(1 << 16, bool)
            seen[h >> np.uint64(48)] = True
            out[int(n)] = (h[order], ids[order], seen)
        return out


class Edges:
    """All matches of pieces in a set of units laid out one after the other.

    ``src``, ``dst`` are places in bytes, one more per unit than it has bytes.
    """

    def __init__(self, pieces: Pieces, table: dict, data: np.ndarray, off: np.ndarray) -> None:
        n = len(data)
        size = np.diff(off)
        unit = np.repeat(np.arange(len(size), dtype=np.int32), size)
        left = (off[1:][unit] - np.arange(n)).astype(np.int32)
        lead = (data & 0xC0) != 0x80
        # nodes: one per byte place and one more behind each unit
        node = np.arange(n, dtype=np.int32) + unit
        pre = B.prefix_hashes(data)
        src, dst, ids = [], [], []
        covered = np.zeros(n, bool)
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))).astype(np.int32)
        at = np.flatnonzero(lead)
        for length, (hashes, own, seen) in sorted(table.items()):
            at = at[left[at] >= length]
            if not len(at):
                break
            h = B.span_hashes(pre, at, at + length)
            may = np.flatnonzero(seen[h >> np.uint64(48)])
            h = h[may]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[k] == h
            p = at[may[hit]]
            src.append(node[p])
            dst.append(node[p] + np.int32(length))
            ids.append(own[k[hit]].astype(np.int32))
            single = p[width[p] == length]
            covered[single] = True
        del pre
        begin = np.flatnonzero(lead & ~covered)
        if len(begin):
            reps = np.minimum(width[begin], left[begin])
            p = np.repeat(begin, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            src.append(node[p])
            dst.append(node[p] + np.int32(1))
            ids.append(pieces.byte_id[data[p]].astype(np.int32))
        self.src, self.dst, self.ids = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (src, dst, ids))


class Lattice:
    """Filtered lattice of a set of distinct units.

    The edges that end at a node lie side by side, the likeliest first, with
    running sums of their probabilities in ``cum``.  These are formed node by
    node, so they do not depend on what else is in the set.
    """

    def __init__(self, pieces: Pieces, table: dict, data: np.ndarray, off: np.ndarray) -> None:
        size = np.diff(off)
        n = len(data) + len(size)
        found = Edges(pieces, table, data, off)
        self.start, self.end = off[:-1] + np.arange(len(size)), off[1:] + np.arange(len(size))
        depth = (np.arange(n) - np.repeat(self.start, size + 1)).astype(np.uint16)  # a unit here is no longer than LONG_UNIT
        # by distance of the edge's end from the unit's begin, then by end: one step per distance
        order = np.argsort(found.dst, kind="stable")
        order = order[np.argsort(depth[found.dst[order]], kind="stable")]
        src, dst, ids = found.src[order], found.dst[order], found.ids[order]
        del found, order
        w = pieces.weight[ids]
        total = np.full(n, -np.inf)
        total[self.start] = 0.0
        begin = np.flatnonzero(np.diff(dst, prepend=-1))  # the first edge of each node
        level = np.searchsorted(depth[dst[begin]], np.arange(1, int(depth.max(initial=0)) + 2))
        value = np.empty(len(src))
        for a, b in zip(level[:-1], level[1:]):
            if a == b:
                continue
            lo, hi = begin[a], begin[b] if b < len(begin) else len(src)
            offs = begin[a:b] - lo
            count = np.diff(offs, append=hi - lo)
            v = total[src[lo:hi]] + w[lo:hi]
            top = np.maximum.reduceat(v, offs)
            # a place inside a character that pieces cover is never reached
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                total[dst[begin[a:b]]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count)), offs))
            value[lo:hi] = v
        with np.errstate(invalid="ignore"):
            p = np.nan_to_num(np.exp(value - total[dst]))
        # whole numbers, so that running sums are exact wherever a node stands
        q = np.rint(np.minimum(p, 1.0) * SCALE).astype(np.int64)
        order = np.argsort((dst.astype(np.int64) << 41) - q, kind="stable")
        self.src, self.dst, self.ids, q = src[order], dst[order], ids[order], q[order]
        self.first = np.searchsorted(self.dst, np.arange(n + 1, dtype=np.int32)).astype(np.int32)
        run = np.concatenate([[0], np.cumsum(q)])
        self.cum = run[1:] - run[self.first[self.dst]]
        some = np.diff(self.first) > 0
        self.cum[self.first[1:][some] - 1] = SCALE  # the last edge takes what rounding leaves
        self.loglik = total[self.end]

    def sample(self, unit: np.ndarray, seed: np.ndarray):
        """Pieces of each occurrence in order: ids and counts."""
        here = self.end[unit]
        live = np.arange(len(unit))
        steps = []
        t = np.uint64(0)
        while len(live):
            u = draws(seed[live], t)
            e = self.first[here[live]]
            more = np.flatnonzero(self.cum[e] <= u)
            while len(more):
                e[more] += 1
                more = more[self.cum[e[more]] <= u[more]]
            steps.append((live, self.ids[e]))
            here[live] = self.src[e]
            live = live[here[live] != self.start[unit[live]]]
            t += np.uint64(1)
        count = np.zeros(len(unit), np.int64)
        for at, _ in steps:
            count[at] += 1
        last = np.cumsum(count) - 1
        out = np.zeros(int(count.sum()), np.int32)
        for k, (at, ids) in enumerate(steps):
            out[last[at] - k] = ids
        return out, count


def draws(seed: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Whole numbers below ``SCALE`` by seed and number of the step."""
    with np.errstate(over="ignore"):
        return (B.mix(seed + step * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(24)).astype(np.int64)


def sample_long(pieces: Pieces, table: dict, data: np.ndarray, seed: np.uint64, window: int = 1 << 14) -> np.ndarray:
    """Pieces of one long unit.

    Forward sums are kept for every place, eight bytes each; edges are formed
    window by window, once forward and once more backward, so that memory stays
    bounded for a text of any length without a space.
    """
    n, longest = len(data), max(max(table), 4)
    total = np.full(n + 1, -np.inf)
    total[0] = 0.0

    def edges(a: int, b: int):
        """Edges that end in (a, b], sorted by their end; first edge of each end."""
        lo, hi = max(a - longest, 0), min(b + longest, n)
        found = Edges(pieces, table, data[lo:hi], np.array([0, hi - lo]))
        src, dst = found.src.astype(np.int64) + lo, found.dst.astype(np.int64) + lo
        inside = np.flatnonzero((dst > a) & (dst <= b))
        inside = inside[np.argsort(dst[inside], kind="stable")]
        first = np.searchsorted(dst[inside], np.arange(a + 1, b + 2))
        ids = found.ids[inside]
        return src[inside], ids, pieces.weight[ids], first

    for a in range(0, n, window):
        b = min(a + window, n)
        src, _, w, first = edges(a, b)
        for k in range(b - a):
            i, j = first[k], first[k + 1]
            if i < j:
                value = total[src[i:j]] + w[i:j]
                top = value.max()
                if top > -np.inf:
                    total[a + 1 + k] = top + np.log(np.exp(value - top).sum())
    out: list[np.ndarray] = []
    here, t = n, 0
    for a in range((n - 1) // window * window, -1, -window):
        b = min(a + window, n)
        src, ids, w, first = edges(a, b)
        u = draws(np.full(b - a, seed), np.arange(t, t + b - a, dtype=np.uint64))
        picked = []
        while here > a:
            i, j = first[here - a - 1], first[here - a]
            p = np.exp(total[src[i:j]] + w[i:j] - total[here])
            order = np.argsort(-p, kind="stable")
            k = min(int(np.searchsorted(np.cumsum(p[order]) * SCALE, u[len(picked)], "right")), len(p) - 1)
            e = i + order[k]
            picked.append(ids[e])
            here = int(src[e])
        t += len(picked)
        out.append(np.array(picked[::-1], np.int32))
    return np.concatenate(out[::-1]) if out else np.zeros(0, np.int32)


class Sampler:
    """Samples units; lattices of the last distinct ones are kept up to a bound.

    What is kept only saves work: a unit's draws come from its own lattice.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.table = pieces, pieces.lookup()
        self._forget()

    def _forget(self) -> None:
        self.code = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        self.data, self.off = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.lattice: Lattice | None = None

    def _number(self, h: np.ndarray) -> np.ndarray:
        """Number of the kept unit with each hash, or -1."""
        if not len(self.code):
            return np.full(len(h), -1, np.int64)
        k = np.minimum(np.searchsorted(self.code, h), len(self.code) - 1)
        return np.where(self.code[k] == h, self.number[k], -1)

    def _learn(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> None:
        """Keep the lattices of further distinct units."""
        size = e - s
        off = np.concatenate([[0], np.cumsum(size)])
        flat = data[np.repeat(s - off[:-1], size) + np.arange(off[-1])]
        made = Lattice(self.pieces, self.table, flat, off)
        old = self.lattice
        if old is not None:
            n, m = len(self.data) + len(self.off) - 1, len(old.src)
            made.src, made.dst = made.src + np.int32(n), made.dst + np.int32(n)
            for name in ("src", "dst", "ids", "cum", "loglik"):
                setattr(made, name, np.concatenate([getattr(old, name), getattr(made, name)]))
            made.first = np.concatenate([old.first[:-1], made.first + np.int32(m)])
            made.start, made.end = np.concatenate([old.start, made.start + n]), np.concatenate([old.end, made.end + n])
        self.lattice = made
        number = np.concatenate([self.number, len(self.off) - 1 + np.arange(len(h))])
        code = np.concatenate([self.code, h])
        order = np.argsort(code)
        self.code, self.number = code[order], number[order]
        self.off = np.concatenate([self.off, self.off[-1] + off[1:]])
        self.data = np.concatenate([self.data, flat])

    def _same(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether the bytes of each unit are those of the kept one."""
        size = np.diff(self.off)[which]
        ok = size == e - s
        at = np.flatnonzero(ok)
        if len(at):
            size = size[at]
            bound = np.cumsum(size) - size
            k = np.arange(size.sum())
            equal = data[np.repeat(s[at] - bound, size) + k] == self.data[np.repeat(self.off[:-1][which[at]] - bound, size) + k]
            ok[at] = np.logical_and.reduceat(equal, bound)
        return ok

    def sample(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: np.ndarray):
        """Pieces and their count for the units ``data[s:e]``."""
        long = e - s > LONG_UNIT
        if long.any():
            parts, count = [], np.zeros(len(s), np.int64)
            cuts = np.flatnonzero(np.diff(long, prepend=not long[0]))
            for a, b in zip(cuts, [*cuts[1:], len(s)]):
                if long[a]:
                    for i in range(a, b):
                        parts.append(sample_long(self.pieces, self.table, data[s[i] : e[i]], seed[i]))
                        count[i] = len(parts[-1])
                else:
                    ids, count[a:b] = self.sample(data, s[a:b], e[a:b], seed[a:b])
                    parts.append(ids)
            return np.concatenate(parts), count
        h = B.span_hashes(B.prefix_hashes(data), s, e)
        which = self._number(h)
        fresh = np.flatnonzero(which < 0)
        if len(fresh):
            some = fresh[np.unique(h[fresh], return_index=True)[1]]
            if len(self.data) and len(self.data) + int((e - s)[some].sum()) > KEPT_BYTES:
                self._forget()
                some = np.unique(h, return_index=True)[1]
            self._learn(data, s[some], e[some], h[some])
            which = self._number(h)
        same = self._same(data, s, e, which)
        if same.all():
            return self.lattice.sample(which, seed)
        # units of one hash that differ: each gets a lattice of its own
        ids, count = self.lattice.sample(np.where(same, which, 0), seed)
        parts = np.split(ids, np.cumsum(count)[:-1])
        for i in np.flatnonzero(~same):
            own = Lattice(self.pieces, self.table, data[s[i] : e[i]], np.array([0, e[i] - s[i]]))
            parts[i], count[i : i + 1] = own.sample(np.zeros(1, np.int64), seed[i : i + 1])
        return np.concatenate(parts), count


def units(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Begins of units: a space behind something else, a control character, what follows one, a row."""
    space, control = data == 0x20, data < 0x20
    start = control.copy()
    start[1:] |= (space[1:] & ~space[:-1]) | control[:-1]
    start[off[:-1][np.diff(off) > 0]] = True
    return np.flatnonzero(start)


def with_space(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before every text that is not empty."""
    size = np.diff(off)
    extra = (size > 0).astype(np.int64)
    new = np.concatenate([[0], np.cumsum(size + extra)])
    out = np.full(int(new[-1]), 0x20, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.cumsum(extra), size)
    out[place] = data
    return out, new


def encode_block(sampler: Sampler, data: np.ndarray, off: np.ndarray, key: np.ndarray):
    """Ids and offsets of the rows of a block."""
    data, off = with_space(data, off)
    rows = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    s = units(data, off)
    e = np.concatenate([s[1:], [len(data)]])
    row = np.searchsorted(off, s, "right") - 1
    begin = np.searchsorted(row, np.arange(rows))
    ids, count = sampler.sample(data, s, e, unit_seeds(key[row], np.arange(len(s)) - begin[row]))
    per = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(per)])


def unit_seeds(key: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return B.mix(key ^ (ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def encode_long(sampler: Sampler, data: np.ndarray, key: np.uint64):
    """Ids of one long text, in stretches that end where units end; and whether decoding gives it back."""
    parts, same, done, ordinal = [], True, 0, 0
    while done < len(data):
        end, size = len(data), BLOCK_BYTES
        # the last begin of a unit in the stretch, or the first one behind it
        while done + size < len(data):
            s = units(data[done : done + size], np.array([0, size]))
            if len(s) > 1 or s[0]:
                end = done + int(s[-1])
                break
            size *= 2
        body = data[done:end]
        if not done:
            body = np.concatenate([np.full(1, 0x20, np.uint8), body])
        s = units(body, np.array([0, len(body)]))
        e = np.concatenate([s[1:], [len(body)]])
        ids, _ = sampler.sample(body, s, e, unit_seeds(np.full(len(s), key), ordinal + np.arange(len(s))))
        back, _ = join_pieces(sampler.pieces, ids, np.array([0, len(ids)]))
        same = same and np.array_equal(back, body)
        parts.append(ids)
        ordinal += len(s)
        done = end
    return np.concatenate(parts), same


def join_pieces(pieces: Pieces, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of rows of ids, the leading space included."""
    size = np.diff(pieces.off)[ids]
    bound = np.concatenate([[0], np.cumsum(size)])
    data = pieces.data[np.repeat(pieces.off[:-1][ids] - bound[:-1], size) + np.arange(bound[-1])]
    return data, bound[off]


def decode_block(pieces: Pieces, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of rows of ids."""
    data, text = join_pieces(pieces, ids, off)
    some = np.diff(text) > 0
    drop = text[:-1][some]
    keep = np.ones(len(data), bool)
    keep[drop[data[drop] == 0x20]] = False
    moved = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], moved[text]


def encoded_rows(sampler: Sampler, data: np.ndarray, off: np.ndarray, key: np.ndarray):
    """Per block of rows: first and last + 1, ids, offsets, and whether decoding gives the text back."""
    for i, j in B.blocks(off, BLOCK_BYTES):
        part, local = data[off[i] : off[j]], off[i : j + 1] - off[i]
        if len(part) > BLOCK_BYTES:
            ids, same = encode_long(sampler, part, key[i])
            yield i, j, ids, np.array([0, len(ids)]), np.array([same])
            continue
        ids, bound = encode_block(sampler, part, local, key[i:j])
        back, boff = decode_block(sampler.pieces, ids, bound)
        if np.array_equal(boff, local) and np.array_equal(back, part):
            same = np.ones(j - i, bool)
        else:
            same = np.array([np.array_equal(back[boff[r] : boff[r + 1]], part[local[r] : local[r + 1]]) for r in range(j - i)])
        yield i, j, ids, bound, same


def encode_batches(pieces: Pieces, seed: int, text_at: int, draw_at: int, names: list[str]):
    """Rows of ``names`` columns, text and draw among or behind them, with their encoding."""

    def run(batches):
        sampler = Sampler(pieces)
        for batch in batches:
            data, off = B.column_bytes(batch.column(text_at))
            draw = batch.column(draw_at).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            key = B.mix(draw ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
            for i, j, ids, bound, same in encoded_rows(sampler, data, off, key):
                # rows leave in groups that keep the batches small
                for a in range(0, j - i, 256):
                    b = min(a + 256, j - i)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c).slice(i + a, b - a) for c in range(len(names))),
                            pa.array(np.diff(bound[a : b + 1])),
                            pa.ListArray.from_arrays(pa.array((bound[a : b + 1] - bound[a]).astype(np.int32)), pa.array(ids[bound[a] : bound[b]])),
                            pa.array(same[a:b]),
                        ],
                        names=[*names, *MADE],
                    )
            del data, off
            B.trim()

    return run


def decode_batches(pieces: Pieces):
    def run(batches):
        for batch in batches:
            held = batch.column(1)
            count = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.asarray(held.flatten()).astype(np.int64)
            data, off = decode_block(pieces, ids, np.concatenate([[0], np.cumsum(count)]))
            texts = [data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") for r in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def _draw(id_col: str, text):
    return F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col(id_col).cast("long")))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """``(id, n_pieces, pieces, lossless)``: ids of the pieces, and whether decoding gives the text back."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), _draw(id_col, text).alias("draw"))
    return rows.mapInArrow(encode_batches(Pieces.load(model, alpha), seed, 1, 2, ["id"]), f"id long, {KIND}")


def with_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` with all their columns, and ``n_pieces``, ``pieces``, ``lossless`` behind them.

    An own column of such a name is kept under that name with ``_in`` behind it.
    """
    names = list(docs.columns)
    for c in MADE:
        while c in names:
            to = c + "_in"
            while to in names:
                to += "_in"
            names[names.index(c)] = to
    draw = _draw(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)))
    schema = StructType([*own.schema.fields, *StructType.fromDDL(KIND).fields])
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), draw.alias("_draw"))
    at = docs.columns.index(text_col)
    return rows.mapInArrow(encode_batches(Pieces.load(model, alpha), seed, at, len(names), names), schema)


def decode(rows: DataFrame, id_col: str = "id", pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """``(id, text)`` from arrays of piece ids; a null array is an empty text."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(pieces_col).cast("array<int>").alias("pieces")).mapInArrow(decode_batches(Pieces.load(model, 1.0)), "id long, text string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The query: every whole text of ``documents``, encoded, and checked by decoding."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).withColumnRenamed("id", "doc_id")
