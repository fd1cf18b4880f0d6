"""Mesh file formats: OBJ, OFF, PLY, STL and GLB, text and binary.

Parsers and writers work on one file's bytes; ``read_meshes`` runs the parsers
over Spark's binary file source, so any path Spark can open works and files are
read in parallel, and ``format_meshes`` runs the writers one kernel per mesh.
Text writers print six decimals.
"""

from __future__ import annotations

import json
import os
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..plans.kernels import MESH_ROWS, per_mesh
from ..plans.lineage import cut


class MeshError(Exception):
    """A file that cannot be read or written as a mesh."""


class UnsupportedFormat(MeshError):
    pass


@dataclass
class Soup:
    """Points, polygons by point number, and per-point attributes."""

    points: np.ndarray
    faces: list[list[int]]
    normals: np.ndarray | None = None
    uvs: np.ndarray | None = None
    skipped: int = 0
    extra: dict = field(default_factory=dict)

    def checked(self) -> "Soup":
        n = len(self.points)
        for f in self.faces:
            for i in f:
                if not 0 <= i < n:
                    raise MeshError(f"index {i} out of range for {n} vertices")
        ok = [f for f in self.faces if len(f) >= 3]
        self.skipped += len(self.faces) - len(ok)
        self.faces = ok
        return self


def _floats(words, n: int, what: str) -> list[float]:
    if len(words) < n:
        raise MeshError(f"{what}: {n} numbers expected")
    try:
        return [float(w) for w in words[:n]]
    except ValueError as e:
        raise MeshError(f"{what}: {e}") from e


def parse_obj(data: bytes) -> Soup:
    """``v``, ``vt``, ``vn`` and ``f`` with v, v/vt, v//vn or v/vt/vn; negative numbers count back.

    Texture places and normals become attributes of the vertex that uses them
    first; other records are ignored.
    """
    points, uv, vn, faces = [], [], [], []
    use_t: dict[int, int] = {}
    use_n: dict[int, int] = {}

    def index(word: str, count: int) -> int:
        try:
            k = int(word)
        except ValueError as e:
            raise MeshError(f"f: {e}") from e
        i = k - 1 if k > 0 else count + k
        if k == 0 or not 0 <= i < count:
            raise MeshError(f"f: index {k} out of range for {count}")
        return i

    for line in data.decode("utf-8", "replace").splitlines():
        w = line.split("#")[0].split()
        if not w:
            continue
        if w[0] == "v":
            points.append(_floats(w[1:], 3, "v"))
        elif w[0] == "vt":
            uv.append(_floats(w[1:], 2, "vt"))
        elif w[0] == "vn":
            vn.append(_floats(w[1:], 3, "vn"))
        elif w[0] == "f":
            poly = []
            for ref in w[1:]:
                part = ref.split("/")
                i = index(part[0], len(points))
                poly.append(i)
                if len(part) > 1 and part[1]:
                    use_t.setdefault(i, index(part[1], len(uv)))
                if len(part) > 2 and part[2]:
                    use_n.setdefault(i, index(part[2], len(vn)))
            faces.append(poly)
    out = Soup(np.array(points, float).reshape(-1, 3), faces)
    if use_t:
        out.uvs = np.full((len(points), 2), np.nan)
        out.uvs[list(use_t)] = np.array(uv)[list(use_t.values())]
    if use_n:
        out.normals = np.full((len(points), 3), np.nan)
        out.normals[list(use_n)] = np.array(vn)[list(use_n.values())]
    return out.checked()


def format_obj(s: Soup) -> bytes:
    """Attributes, if any, are written with the vertex's own number; missing ones as zeros."""
    out = [f"v {x:.6f} {y:.6f} {z:.6f}" for x, y, z in s.points]
    if s.uvs is not None:
        out += [f"vt {u:.6f} {v:.6f}" for u, v in np.nan_to_num(s.uvs)]
    if s.normals is not None:
        out += [f"vn {x:.6f} {y:.6f} {z:.6f}" for x, y, z in np.nan_to_num(s.normals)]
    t, n = s.uvs is not None, s.normals is not None
    ref = lambda i: f"{i}/{i}/{i}" if t and n else f"{i}/{i}" if t else f"{i}//{i}" if n else f"{i}"
    out += ["f " + " ".join(ref(i + 1) for i in f) for f in s.faces]
    return ("\n".join(out) + "\n").encode()


def parse_off(data: bytes) -> Soup:
    words = []
    for line in data.decode("utf-8", "replace").splitlines():
        words += line.split("#")[0].split()
    if not words or not words[0].upper().startswith("OFF"):
        raise MeshError("OFF: no header")
    words[0] = words[0][3:]
    if not words[0]:
        words.pop(0)
    try:
        nv, nf = int(words[0]), int(words[1])
        at = 3
        points = np.array(words[at : at + 3 * nv], float).reshape(nv, 3)
        at += 3 * nv
        faces = []
        for _ in range(nf):
            k = int(words[at])
            faces.append([int(x) for x in words[at + 1 : at + 1 + k]])
            if len(faces[-1]) != k:
                raise MeshError("OFF: file ends within a face")
            at += 1 + k
    except (ValueError, IndexError) as e:
        raise MeshError(f"OFF: {e}") from e
    return Soup(points, faces).checked()


def format_off(s: Soup) -> bytes:
    out = ["OFF", f"{len(s.points)} {len(s.faces)} 0"]
    out += [f"{x:.6f} {y:.6f} {z:.6f}" for x, y, z in s.points]
    out += [" ".join(map(str, [len(f), *f])) for f in s.faces]
    return ("\n".join(out) + "\n").encode()


#: Scalar type names of the format and their little-endian layout.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}


def parse_ply(data: bytes) -> Soup:
    """ASCII and binary little-endian; x, y, z by name; a list property holds the faces."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise MeshError("PLY: no header")
    body = data[data.index(b"\n", end) + 1 :]
    elements: list[tuple[str, int, list]] = []
    kind = ""
    for line in data[:end].decode("ascii", "replace").splitlines()[1:]:
        w = line.split()
        if not w or w[0] in ("comment", "obj_info"):
            continue
        try:
            if w[0] == "format":
                kind = w[1]
            elif w[0] == "element":
                elements.append((w[1], int(w[2]), []))
            elif w[0] == "property":
                elements[-1][2].append((w[-1], None, PLY_TYPES[w[1]]) if w[1] != "list" else (w[-1], PLY_TYPES[w[2]], PLY_TYPES[w[3]]))
        except (IndexError, KeyError, ValueError) as e:
            raise MeshError(f"PLY header: {e}") from e
    if kind not in ("ascii", "binary_little_endian"):
        raise UnsupportedFormat(f"PLY: {kind or 'no format'}")
    points, faces = np.zeros((0, 3)), []
    words = body.split() if kind == "ascii" else []
    at = 0
    try:
        for name, count, props in elements:
            flat = all(p[1] is None for p in props)
            if flat:
                if kind == "ascii":
                    rows = np.array(words[at : at + count * len(props)], float).reshape(count, len(props))
                    at += count * len(props)
                    cols = {p[0]: rows[:, i] for i, p in enumerate(props)}
                else:
                    dt = np.dtype([(p[0], p[2]) for p in props])
                    rows = np.frombuffer(body, dt, count, at)
                    at += count * dt.itemsize
                    cols = {p[0]: rows[p[0]].astype(float) for p in props}
                if name == "vertex":
                    points = np.column_stack([cols[c] for c in "xyz"])
                continue
            for _ in range(count):
                for label, size, item in props:
                    if kind == "ascii":
                        k = int(words[at]) if size else 1
                        at += bool(size)
                        got = [float(x) for x in words[at : at + k]]
                        at += k
                    else:
                        k = 1
                        if size:
                            k = int(np.frombuffer(body, size, 1, at)[0])
                            at += np.dtype(size).itemsize
                        got = np.frombuffer(body, item, k, at).tolist()
                        at += k * np.dtype(item).itemsize
                    if name == "face" and label in ("vertex_indices", "vertex_index"):
                        faces.append([int(x) for x in got])
    except (ValueError, KeyError, IndexError) as e:
        raise MeshError(f"PLY: {e}") from e
    return Soup(points, faces).checked()


def _ply_header(s: Soup, kind: str) -> bytes:
    return (
        f"ply\nformat {kind} 1.0\nelement vertex {len(s.points)}\nproperty float x\nproperty float y\nproperty float z\n"
        f"element face {len(s.faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    ).encode()


def format_ply(s: Soup) -> bytes:
    rows = [f"{x:.6f} {y:.6f} {z:.6f}" for x, y, z in s.points] + [" ".join(map(str, [len(f), *f])) for f in s.faces]
    return _ply_header(s, "ascii") + ("\n".join(rows) + "\n").encode()


def format_ply_binary(s: Soup) -> bytes:
    body = s.points.astype("<f4").tobytes()
    return _ply_header(s, "binary_little_endian") + body + b"".join(struct.pack(f"<B{len(f)}i", len(f), *f) for f in s.faces)


def _weld_bits(corners: np.ndarray) -> Soup:
    """Triangle soup to shared vertices by exact bit pattern, in order of appearance."""
    bits = np.ascontiguousarray(corners).view(np.uint8).reshape(len(corners), -1)
    _, first, which = np.unique(bits, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Soup(corners[first[order]].astype(float), rank[which.ravel()].reshape(-1, 3).tolist()).checked()


def parse_stl(data: bytes) -> Soup:
    """Binary if the length fits the triangle count, else ASCII."""
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack("<I", data[80:84])[0]:
        dt = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])
        rows = np.frombuffer(data, dt, offset=84)
        return _weld_bits(rows["v"].reshape(-1, 3)) if len(rows) else Soup(np.zeros((0, 3)), [])
    text = data.decode("utf-8", "replace")
    if not text.lstrip().lower().startswith("solid"):
        raise MeshError("STL: neither binary nor ASCII")
    corners = [_floats(line.split()[1:], 3, "vertex") for line in text.splitlines() if line.split()[:1] == ["vertex"]]
    if len(corners) % 3:
        raise MeshError("STL: a facet has no three corners")
    return _weld_bits(np.array(corners, float)) if corners else Soup(np.zeros((0, 3)), [])


def _facets(s: Soup):
    for f in s.faces:
        if len(f) == 3:
            a, b, c = s.points[f]
            n = np.cross(b - a, c - a)
            size = np.linalg.norm(n)
            yield (n / size if size > 1e-12 else np.array([0.0, 0.0, 1.0])), (a, b, c)


def format_stl_ascii(s: Soup) -> bytes:
    num = lambda p: f"{p[0]:.6f} {p[1]:.6f} {p[2]:.6f}"
    out = ["solid mesh"]
    for n, corners in _facets(s):
        out += [f"  facet normal {num(n)}", "    outer loop", *(f"      vertex {num(p)}" for p in corners), "    endloop", "  endfacet"]
    return ("\n".join([*out, "endsolid mesh"]) + "\n").encode()


def format_stl_binary(s: Soup) -> bytes:
    rows = list(_facets(s))
    return bytes(80) + struct.pack("<I", len(rows)) + b"".join(np.concatenate([n, *c]).astype("<f4").tobytes() + b"\0\0" for n, c in rows)


def parse_glb(data: bytes) -> Soup:
    """First primitive of the first mesh: POSITION as float vec3, optional indices, triangles."""
    if len(data) < 20 or data[:4] != b"glTF" or struct.unpack("<I", data[4:8])[0] != 2:
        raise MeshError("GLB: no version 2 header")
    chunks, at = {}, 12
    while at + 8 <= len(data):
        size, kind = struct.unpack("<I4s", data[at : at + 8])
        chunks.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size
    try:
        doc = json.loads(chunks[b"JSON"])
        blob = chunks.get(b"BIN\0", b"")
        prim = doc["meshes"][0]["primitives"][0]

        def accessor(i: int) -> np.ndarray:
            acc = doc["accessors"][i]
            view = doc["bufferViews"][acc["bufferView"]]
            kind = {5121: "u1", 5123: "<u2", 5125: "<u4", 5126: "<f4"}[acc["componentType"]]
            width = {"SCALAR": 1, "VEC3": 3}[acc["type"]]
            start = view.get("byteOffset", 0) + acc.get("byteOffset", 0)
            item = np.dtype(kind).itemsize * width
            step = view.get("byteStride", item)
            raw = np.frombuffer(blob, np.uint8)
            rows = np.stack([raw[start + k * step : start + k * step + item] for k in range(acc["count"])]) if acc["count"] else np.zeros((0, item), np.uint8)
            return rows.copy().view(kind).reshape(-1, width)

        if prim.get("mode", 4) != 4:
            raise UnsupportedFormat("GLB: only triangles")
        points = accessor(prim["attributes"]["POSITION"]).astype(float)
        ids = accessor(prim["indices"]).ravel().astype(int) if "indices" in prim else np.arange(len(points))
    except (KeyError, IndexError, ValueError, struct.error) as e:
        raise MeshError(f"GLB: {e}") from e
    return Soup(points, ids[: len(ids) // 3 * 3].reshape(-1, 3).tolist()).checked()


def format_glb(s: Soup) -> bytes:
    pos = s.points.astype("<f4")
    ids = np.array([f for f in s.faces if len(f) == 3], "<u4").reshape(-1, 3)
    blob = pos.tobytes() + ids.tobytes()
    box = {"min": pos.min(axis=0).tolist(), "max": pos.max(axis=0).tolist()} if len(pos) else {}
    doc = {
        "asset": {"version": "2.0"},
        "scene": 0,
        "scenes": [{"nodes": [0]}],
        "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "mode": 4}]}],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "count": len(pos), "type": "VEC3", **box},
            {"bufferView": 1, "componentType": 5125, "count": int(ids.size), "type": "SCALAR"},
        ],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": pos.nbytes}, {"buffer": 0, "byteOffset": pos.nbytes, "byteLength": ids.nbytes}],
        "buffers": [{"byteLength": len(blob)}],
    }
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    blob += b"\0" * (-len(blob) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(blob)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(blob), b"BIN\0") + blob


PARSERS = {"obj": parse_obj, "off": parse_off, "ply": parse_ply, "stl": parse_stl, "glb": parse_glb, "gltf": parse_glb}
WRITERS = {
    "obj": format_obj, "off": format_off, "ply": format_ply, "ply_binary": format_ply_binary, "stl": format_stl_ascii, "stl_binary": format_stl_binary, "glb": format_glb,
}


def parse(name: str, data: bytes) -> Soup:
    kind = os.path.splitext(name)[1].lower().lstrip(".")
    if kind not in PARSERS:
        raise UnsupportedFormat(f"no reader for .{kind}")
    return PARSERS[kind](data)


ROWS = MESH_ROWS + ", n_x double, n_y double, n_z double, uv_u double, uv_v double, error string"


def _rows(name: str, data: bytes, mode: str) -> pd.DataFrame:
    cols = [c.split()[0] for c in ROWS.split(", ")]
    try:
        s = parse(name, data)
    except MeshError as e:
        if mode == "FAILFAST":
            raise
        return pd.DataFrame([{**dict.fromkeys(cols), "mesh_id": name, "kind": "e", "error": str(e)}], columns=cols)
    n, m = len(s.points), len(s.faces)
    v = pd.DataFrame({"mesh_id": name, "kind": "v", "id": np.arange(n), **{c: s.points[:, i] for i, c in enumerate("xyz")}, "vs": [None] * n}, columns=cols)
    if s.normals is not None:
        v[["n_x", "n_y", "n_z"]] = s.normals
    if s.uvs is not None:
        v[["uv_u", "uv_v"]] = s.uvs
    f = pd.DataFrame({"mesh_id": name, "kind": "f", "id": np.arange(m), "vs": s.faces}, columns=cols)
    out = pd.concat([x for x in (v, f) if len(x)], ignore_index=True) if n or m else v
    return out.astype({c: "float64" for c in cols if c in ("x", "y", "z", "n_x", "n_y", "n_z", "uv_u", "uv_v")})


def read_meshes(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> tuple[Mesh, DataFrame]:
    """All mesh files under a path as one Mesh (mesh_id = file name) and the files that failed.

    ``FAILFAST`` raises on the first bad file instead.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["name"], pdf["content"]):
                yield _rows(name, bytes(data), mode)

    rows = cut(files.mapInPandas(run, ROWS), "files")
    v = rows.where("kind = 'v'").select("mesh_id", F.col("id").alias("vid"), "x", "y", "z", "n_x", "n_y", "n_z", "uv_u", "uv_v")
    f = rows.where("kind = 'f'").select("mesh_id", F.col("id").alias("fid"), "vs")
    return Mesh(v, f), rows.where("kind = 'e'").select("mesh_id", "error")


def format_meshes(mesh: Mesh, kind: str) -> DataFrame:
    """(mesh_id, content): one file's bytes per mesh; vertices are numbered in id order."""
    if kind not in WRITERS:
        raise UnsupportedFormat(f"no writer for {kind}")

    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        s = Soup(v[["x", "y", "z"]].to_numpy(float), faces)
        if {"n_x", "n_y", "n_z"} <= set(v.columns) and v["n_x"].notna().any():
            s.normals = v[["n_x", "n_y", "n_z"]].to_numpy(float)
        if {"uv_u", "uv_v"} <= set(v.columns) and v["uv_u"].notna().any():
            s.uvs = v[["uv_u", "uv_v"]].to_numpy(float)
        return pd.DataFrame({"content": [WRITERS[kind](s)]})

    return per_mesh(mesh, run, "mesh_id string, content binary")


def save_meshes(mesh: Mesh, folder: str, kind: str) -> None:
    """Write one file per mesh into a folder that the executors share (or a local one in tests)."""
    suffix = "." + kind.split("_")[0]

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            name = os.path.basename(r["mesh_id"])
            with open(os.path.join(folder, name if name.endswith(suffix) else name + suffix), "wb") as out:
                out.write(bytes(r["content"]))

    format_meshes(mesh, kind).foreachPartition(write)


def index_buffers(mesh: Mesh) -> DataFrame:
    """(mesh_id, positions array<float>, indices array<int>): triangles only, vertices in id order."""

    def run(v: pd.DataFrame, faces, _ids) -> pd.DataFrame:
        tri = [i for f in faces if len(f) == 3 for i in f]
        return pd.DataFrame({"positions": [v[["x", "y", "z"]].to_numpy(np.float32).ravel().tolist()], "indices": [tri]})

    return per_mesh(mesh, run, "mesh_id string, positions array<float>, indices array<int>")
