"""Sparse systems in numpy: COO assembly, conjugate gradients, BiCGSTAB."""

from __future__ import annotations

import numpy as np


class Coo:
    """Square sparse matrix by triplets; repeated entries add up."""

    def __init__(self, n: int, i=(), j=(), v=()) -> None:
        self.n = n
        self.i, self.j, self.v = np.asarray(i, np.int64), np.asarray(j, np.int64), np.asarray(v, float)

    def plus(self, i, j, v) -> "Coo":
        return Coo(self.n, np.concatenate([self.i, i]), np.concatenate([self.j, j]), np.concatenate([self.v, v]))

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.i, weights=self.v * x[self.j], minlength=self.n)

    def diagonal(self) -> np.ndarray:
        on = self.i == self.j
        return np.bincount(self.i[on], weights=self.v[on], minlength=self.n)

    def part(self, keep: np.ndarray) -> "Coo":
        """Rows and columns of a mask, renumbered."""
        at = np.cumsum(keep) - 1
        on = keep[self.i] & keep[self.j]
        return Coo(int(keep.sum()), at[self.i[on]], at[self.j[on]], self.v[on])

    def couple(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For masked rows, the product with values at the other columns."""
        on = rows[self.i] & ~rows[self.j]
        full = np.bincount(self.i[on], weights=self.v[on] * x[self.j[on]], minlength=self.n)
        return full[rows]


def conjugate_gradient(a, b: np.ndarray, max_iter: int = 5000, tol: float = 1e-10, jacobi: bool = True) -> np.ndarray | None:
    """Solution to a relative residual, zeros for a vanishing right side, None if it does not converge."""
    size = np.linalg.norm(b)
    x = np.zeros_like(b)
    if size < 1e-30:
        return x
    d = a.diagonal() if jacobi else np.ones(len(b))
    inv = 1.0 / np.where(np.abs(d) > 1e-300, d, 1.0)
    r = b.copy()
    z = inv * r
    p, rz = z.copy(), r @ z
    for _ in range(max_iter):
        ap = a @ p
        q = p @ ap
        if abs(q) < 1e-30:
            return None
        step = rz / q
        x += step * p
        r -= step * ap
        if np.linalg.norm(r) <= tol * size:
            return x
        z = inv * r
        rz, old = r @ z, rz
        p = z + rz / old * p
    return None


def bicgstab(a, b: np.ndarray, max_iter: int = 5000, tol: float = 1e-10) -> np.ndarray | None:
    """For matrices that are not symmetric; Jacobi preconditioned."""
    size = np.linalg.norm(b)
    x = np.zeros_like(b)
    if size < 1e-30:
        return x
    d = a.diagonal()
    inv = 1.0 / np.where(np.abs(d) > 1e-300, d, 1.0)
    r = b.copy()
    shadow, rho, alpha, omega = r.copy(), 1.0, 1.0, 1.0
    v = p = np.zeros_like(b)
    for _ in range(max_iter):
        rho, old = shadow @ r, rho
        if abs(rho) < 1e-300:
            return None
        p = r + rho / old * alpha / omega * (p - omega * v)
        y = inv * p
        v = a @ y
        alpha = rho / (shadow @ v)
        s = r - alpha * v
        z = inv * s
        t = a @ z
        omega = (t @ s) / max(t @ t, 1e-300)
        x = x + alpha * y + omega * z
        r = s - omega * t
        if np.linalg.norm(r) <= tol * size:
            return x
        if omega == 0:
            return None
    return None


def triangles(faces) -> np.ndarray:
    return np.array([f for f in faces if len(f) == 3], np.int64).reshape(-1, 3)


def corner_cotangents(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Cotangent at each corner (n, 3), zero where a triangle is flat."""
    out = np.zeros(t.shape)
    for k in range(3):
        u, w = p[t[:, (k + 1) % 3]] - p[t[:, k]], p[t[:, (k + 2) % 3]] - p[t[:, k]]
        size = np.linalg.norm(np.cross(u, w), axis=1)
        out[:, k] = np.where(size < 1e-14, 0.0, (u * w).sum(axis=1) / np.where(size < 1e-14, 1, size))
    return out


def cotan_matrix(p: np.ndarray, t: np.ndarray, weights: np.ndarray | None = None) -> Coo:
    """Positive semidefinite Laplacian: off-diagonal -(cot α + cot β)/2, rows sum to 0."""
    w = (corner_cotangents(p, t) if weights is None else weights) / 2
    i = np.concatenate([t[:, (k + 1) % 3] for k in range(3)])
    j = np.concatenate([t[:, (k + 2) % 3] for k in range(3)])
    v = np.concatenate([w[:, k] for k in range(3)])
    return Coo(len(p), np.concatenate([i, j, i, j]), np.concatenate([j, i, i, j]), np.concatenate([-v, -v, v, v]))


def uniform_matrix(n: int, t: np.ndarray) -> Coo:
    e = np.unique(np.sort(np.concatenate([t[:, [0, 1]], t[:, [1, 2]], t[:, [2, 0]]]), axis=1), axis=0)
    i, j, one = e[:, 0], e[:, 1], np.ones(len(e))
    return Coo(n, np.concatenate([i, j, i, j]), np.concatenate([j, i, i, j]), np.concatenate([-one, -one, one, one]))


def triangle_areas(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.linalg.norm(np.cross(p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]]), axis=1) / 2


def lumped_mass(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.bincount(t.ravel(), weights=np.repeat(triangle_areas(p, t) / 3, 3), minlength=len(p))


def dirichlet(a: Coo, fixed: np.ndarray, values: np.ndarray, rhs: np.ndarray | None = None, solve=conjugate_gradient) -> np.ndarray | None:
    """Solve with values prescribed where ``fixed``; values has a column per right side."""
    out = np.array(values, float)
    free = ~fixed
    if not free.any():
        return out
    inner = a.part(free)
    for c in range(out.shape[1]):
        b = -a.couple(free, np.where(fixed, out[:, c], 0.0))
        if rhs is not None:
            b = b + rhs[free, c]
        x = solve(inner, b)
        if x is None:
            return None
        out[free, c] = x
    return out


def border_loops(faces) -> list[list[int]]:
    """Loops of border vertices in face order (interior on the left), longest first."""
    count: dict[tuple[int, int], int] = {}
    for f in faces:
        for a, b in zip(f, [*f[1:], f[0]]):
            count[a, b] = count.get((a, b), 0) + 1
    nxt: dict[int, int] = {}
    for a, b in sorted(count):
        if (b, a) not in count:
            nxt.setdefault(a, b)
    loops, seen = [], set()
    for s in sorted(nxt):
        if s in seen:
            continue
        loop, v = [], s
        while v is not None and v not in seen:
            seen.add(v)
            loop.append(v)
            v = nxt.get(v)
        loops.append(loop)
    return sorted(loops, key=lambda l: (-len(l), l))
