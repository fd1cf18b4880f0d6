"""A small editable triangle mesh for kernels: face table plus vertex incidence."""

from __future__ import annotations

import numpy as np


class TriMesh:
    """Faces by id, and the faces around every vertex; ids are never reused."""

    def __init__(self, points: np.ndarray, faces) -> None:
        self.p = {i: np.array(x, float) for i, x in enumerate(points)}
        self.f: dict[int, tuple[int, int, int]] = {}
        self.around: dict[int, set[int]] = {i: set() for i in self.p}
        self.next_v, self.next_f = len(self.p), 0
        for t in faces:
            if len(t) == 3 and len({*t}) == 3:
                self.add_face(*t)

    def add_vertex(self, x) -> int:
        v = self.next_v
        self.next_v += 1
        self.p[v] = np.array(x, float)
        self.around[v] = set()
        return v

    def add_face(self, a: int, b: int, c: int) -> int:
        k = self.next_f
        self.next_f += 1
        self.f[k] = (a, b, c)
        for v in (a, b, c):
            self.around[v].add(k)
        return k

    def drop_face(self, k: int) -> None:
        for v in self.f.pop(k):
            self.around[v].discard(k)

    def ring(self, v: int) -> set[int]:
        return {w for k in self.around[v] for w in self.f[k]} - {v}

    def sides(self, a: int, b: int) -> list[int]:
        """Faces at the edge, smallest id first."""
        return sorted(self.around[a] & self.around[b])

    def apex(self, k: int, a: int, b: int) -> int:
        return next(v for v in self.f[k] if v != a and v != b)

    def forward(self, k: int, a: int, b: int) -> bool:
        t = self.f[k]
        return (a, b) in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))

    def edges(self) -> list[tuple[int, int]]:
        return sorted({(min(a, b), max(a, b)) for t in self.f.values() for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))})

    def on_border(self, v: int) -> bool:
        return any(len(self.sides(v, w)) == 1 for w in self.ring(v))

    def length(self, a: int, b: int) -> float:
        return float(np.linalg.norm(self.p[a] - self.p[b]))

    def normal(self, k: int) -> np.ndarray:
        a, b, c = (self.p[v] for v in self.f[k])
        return np.cross(b - a, c - a)

    def split_edge(self, a: int, b: int, at=None) -> int:
        """A vertex on the edge (its middle unless given); each side becomes two faces."""
        m = self.add_vertex((self.p[a] + self.p[b]) / 2 if at is None else at)
        for k in self.sides(a, b):
            s, t = (a, b) if self.forward(k, a, b) else (b, a)
            c = self.apex(k, a, b)
            self.drop_face(k)
            self.add_face(s, m, c)
            self.add_face(m, t, c)
        return m

    def flip(self, a: int, b: int) -> bool:
        """Replace ab by cd; not on the border, nor if cd is there or a face would turn over."""
        pair = self.sides(a, b)
        if len(pair) != 2:
            return False
        k, l = pair if self.forward(pair[0], a, b) else pair[::-1]
        c, d = self.apex(k, a, b), self.apex(l, a, b)
        if c == d or self.sides(c, d) or not self.forward(k, a, b) or not self.forward(l, b, a):
            return False
        was = self.normal(k) + self.normal(l)
        p = self.p
        one, two = np.cross(p[a] - p[c], p[d] - p[c]), np.cross(p[b] - p[d], p[c] - p[d])
        if one @ was <= 0 or two @ was <= 0:
            return False
        self.drop_face(k)
        self.drop_face(l)
        self.add_face(c, a, d)
        self.add_face(d, b, c)
        return True

    def link_ok(self, a: int, b: int) -> bool:
        """The common neighbours of an interior edge are exactly its two opposite corners."""
        pair = self.sides(a, b)
        if len(pair) != 2:
            return False
        return self.ring(a) & self.ring(b) == {self.apex(k, a, b) for k in pair} and len({self.apex(k, a, b) for k in pair}) == 2

    def folds(self, a: int, b: int, at: np.ndarray) -> bool:
        """Whether moving a and b to ``at`` turns over or flattens a face that stays."""
        gone = set(self.sides(a, b))
        for v in (a, b):
            for k in self.around[v] - gone:
                was = self.normal(k)
                x = [at if w in (a, b) else self.p[w] for w in self.f[k]]
                now = np.cross(x[1] - x[0], x[2] - x[0])
                if np.linalg.norm(now) < 1e-14 or now @ was <= 0:
                    return True
        return False

    def collapse(self, a: int, b: int, at: np.ndarray) -> bool:
        """Merge b into a at a place; the link condition must hold."""
        if not self.link_ok(a, b):
            return False
        for k in self.sides(a, b):
            self.drop_face(k)
        for k in sorted(self.around[b]):
            t = tuple(a if v == b else v for v in self.f[k])
            self.drop_face(k)
            self.add_face(*t)
        del self.around[b], self.p[b]
        self.p[a] = np.array(at, float)
        return True

    def split_face(self, k: int) -> int:
        a, b, c = self.f[k]
        m = self.add_vertex((self.p[a] + self.p[b] + self.p[c]) / 3)
        self.drop_face(k)
        for s, t in ((a, b), (b, c), (c, a)):
            self.add_face(s, t, m)
        return m

    def result(self) -> tuple[np.ndarray, list[list[int]]]:
        order = {v: i for i, v in enumerate(sorted(self.p))}
        points = np.array([self.p[v] for v in sorted(self.p)]).reshape(-1, 3)
        return points, [[order[v] for v in self.f[k]] for k in sorted(self.f)]
