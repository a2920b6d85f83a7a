"""Layouts of binary records: how bytes become columns, and rows bytes."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are read at once.
WINDOW = 1 << 22

CELL = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("level", "<i4")])
SCALAR = np.dtype("<f4")
CUBE = np.dtype([("lower", "<f4", 3), ("level", "<i4"), ("ids", "<i4", 8)])
DOMAIN = np.dtype([("lower", "<f4", 3), ("upper", "<f4", 3), ("majorant", "<f4")])
NODE = np.dtype([("split", "<u4"), ("bits", "<u4"), ("max_level", "<i4")])
BRICK_HEAD = ("sx", "sy", "sz", "lx", "ly", "lz", "level")
GRIDLET_HEAD = ("lx", "ly", "lz", "level", "dx", "dy", "dz")


class Window:
    """Reads of a file at any place, through a buffer of WINDOW bytes."""

    def __init__(self, file: object, size: int) -> None:
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if at + n > self.size:
            raise ValueError(f"a record at byte {at} goes on beyond the end of the file")
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, min(WINDOW, self.size - at)))
        return self.held[at - self.at : at - self.at + n]


@dataclass(frozen=True)
class Layout:
    """How a kind of file is read and written.

    record: bytes of every record, or 0 where they vary; then length gives the bytes of the record at a place, from as many
    bytes as it asks for. head: bytes before a file's first record; header makes them from the number of records. decode gives
    columns from whole records, the file's name and the number of the first. encode gives the bytes of rows that come in
    order. one_number: records are numbered over all files, not over each.
    """

    schema: str
    decode: Callable[[bytes, str, int], dict]
    encode: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]] | None = None
    record: int = 0
    length: Callable[[Window, int], int] | None = None
    head: int = 0
    header: Callable[[int], bytes] | None = None
    one_number: bool = True


def lists(values: np.ndarray, sizes: list[int], empty: np.ndarray | None = None) -> pa.Array:
    """A list column from all values and each list's size; empty: places that are null."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, mask=empty))


def _numbered(first: int, n: int) -> np.ndarray:
    return np.arange(first, first + n)


def _column(batch: pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        raise ValueError(f"a null {name} can't be written")
    return column.to_numpy(zero_copy_only=False).astype(kind)


def _flat(batch: pa.RecordBatch, name: str, kind: pa.DataType, null: object = None) -> tuple[np.ndarray, np.ndarray]:
    """(all values, bounds of each row's) of a list column."""
    column = batch.column(batch.schema.get_field_index(name))
    values = column.flatten().cast(kind)
    bounds = np.asarray(column.offsets)
    return (values if null is None else values.fill_null(null)).to_numpy(zero_copy_only=False), bounds - bounds[0]


def _decode_scalars(b: bytes, name: str, first: int) -> dict:
    return {"idx": _numbered(first, len(b) // 4), "value": np.frombuffer(b, SCALAR).astype(float)}


def _decode_cells(b: bytes, name: str, first: int) -> dict:
    c = np.frombuffer(b, CELL)
    return {"cell_id": _numbered(first, len(c))} | {k: np.ascontiguousarray(c[k]) for k in ("x", "y", "z", "level")}


def _decode_cubes(b: bytes, name: str, first: int) -> dict:
    c = np.frombuffer(b, CUBE)
    tail = name.rsplit("_", 1)[-1].split(".")[0]
    level = int(tail) if tail.isdigit() else -1
    lower = {f"l{a}": c["lower"][:, i].astype(float) for i, a in enumerate("xyz")}
    return {"file_level": np.full(len(c), level), "level": np.ascontiguousarray(c["level"]), "ids": lists(c["ids"].reshape(-1), [8] * len(c))} | lower


def _decode_domains(b: bytes, name: str, first: int) -> dict:
    c = np.frombuffer(b, DOMAIN)
    ends = {f"{e}{a}": c[side][:, i].astype(float) for e, side in (("l", "lower"), ("h", "upper")) for i, a in enumerate("xyz")}
    return {"domain_id": _numbered(first, len(c)), "majorant": c["majorant"].astype(float)} | ends


def _decode_tree(b: bytes, name: str, first: int) -> dict:
    c = np.frombuffer(b, NODE)
    return {"idx": _numbered(first, len(c)), "split": c["split"].astype(np.int64), "bits": c["bits"].astype(np.int64), "max_level": np.ascontiguousarray(c["max_level"])}


def _headed(names: tuple[str, ...], count: object, mark_empty: bool):
    """decode and length of records of seven numbers and, after them, as many identifiers as these say."""

    def decode(b: bytes, name: str, first: int) -> dict:
        values, at, heads, ids = np.frombuffer(b, "<i4"), 0, [], []
        while at < len(values):
            head = values[at : at + 7].tolist()
            n = count(dict(zip(names, head)))
            heads.append(head)
            ids.append(values[at + 7 : at + 7 + n])
            at += 7 + n
        flat = np.concatenate(ids)
        columns = dict(zip(names, np.array(heads, np.int32).T))
        return columns | {"file": [name] * len(heads), "n": _numbered(first, len(heads)), "ids": lists(flat, list(map(len, ids)), flat < 0 if mark_empty else None)}

    def length(window: Window, at: int) -> int:
        return 28 + 4 * count(dict(zip(names, struct.unpack("<7i", window(at, 28)))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            heads = np.stack([_column(batch, c, "<i4") for c in names], 1)
            flat, bounds = _flat(batch, "ids", pa.int32(), -1)
            for i, (a, z) in enumerate(zip(bounds, bounds[1:])):
                yield heads[i].tobytes() + flat[a:z].astype("<i4").tobytes()

    return {"decode": decode, "length": length, "encode": encode}


def _mesh_length(window: Window, at: int) -> int:
    (vertices,) = struct.unpack("<i", window(at, 4))
    (triangles,) = struct.unpack("<i", window(at + 4 + 12 * vertices, 4))
    return 8 + 12 * vertices + 12 * triangles


def _decode_triangles(b: bytes, name: str, first: int) -> dict:
    out: dict[str, list] = {c: [] for c in ("mesh_id", "tri_id", "v1", "v2", "v3")}
    at, mesh = 0, first
    while at < len(b):
        (n,) = struct.unpack_from("<i", b, at)
        v = np.frombuffer(b, "<f4", 3 * n, at + 4).reshape(n, 3).astype(float)
        at += 4 + 12 * n
        (m,) = struct.unpack_from("<i", b, at)
        t = np.frombuffer(b, "<i4", 3 * m, at + 4).reshape(m, 3)
        at += 4 + 12 * m
        if m and (t.min() < 0 or t.max() >= n):
            raise ValueError(f"{name}: a triangle of mesh {mesh} has no such vertex")
        for c, column in (("mesh_id", np.full(m, mesh)), ("tri_id", np.arange(m)), *((f"v{k + 1}", v[t[:, k]]) for k in range(3))):
            out[c].append(column)
        mesh += 1
    whole = {c: np.concatenate(parts) for c, parts in out.items()}
    return {c: lists(x.reshape(-1), [3] * len(x)) if x.ndim == 2 else x for c, x in whole.items()}


def _encode_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for b in batches:
        yield np.stack([_column(b, c, "<i4") for c in ("x", "y", "z", "level")], 1).tobytes()


def _encode_scalars(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for b in batches:
        yield _column(b, "value", "<f4").tobytes()


def _encode_cubes(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for b in batches:
        c = np.zeros(b.num_rows, CUBE)
        c["level"] = _column(b, "level", "<i4")
        c["lower"] = (np.stack([_column(b, f"i{a}", "f8") for a in "xyz"], 1) + 0.5) * 2.0 ** c["level"][:, None].astype(float)
        c["ids"] = _flat(b, "ids", pa.int32())[0].reshape(-1, 8)
        yield c.tobytes()


def _encode_domains(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for b in batches:
        d = np.zeros(b.num_rows, DOMAIN)
        d["lower"], d["upper"] = (np.stack([_column(b, f"{e}{a}", "<f4") for a in "xyz"], 1) for e in "lh")
        d["majorant"] = _column(b, "majorant", "<f4")
        yield d.tobytes()


def _encode_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """A mesh's vertices as they come, three a triangle, then their numbers; column _n says how many triangles it has."""

    def numbers(n: int) -> Iterator[bytes]:
        yield struct.pack("<i", n)
        for at in range(0, 3 * n, 3_000_000):
            yield np.arange(at, min(3 * n, at + 3_000_000), dtype="<i4").tobytes()

    mesh, n = None, 0
    for b in batches:
        ids, counts = _column(b, "mesh_id", "<i8"), _column(b, "_n", "<i8")
        corners = np.stack([_flat(b, c, pa.float64())[0].reshape(-1, 3) for c in ("v1", "v2", "v3")], 1).astype("<f4")
        starts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
        for a, z in zip(starts, [*starts[1:], len(ids)]):
            if ids[a] != mesh:
                if mesh is not None:
                    yield from numbers(n)
                mesh, n = ids[a], int(counts[a])
                yield struct.pack("<i", 3 * n)
            yield corners[a:z].tobytes()
    if mesh is not None:
        yield from numbers(n)


LAYOUTS: dict[str, Layout] = {
    "scalars": Layout("idx long, value double", _decode_scalars, _encode_scalars, record=4),
    "cells": Layout("cell_id long, x int, y int, z int, level int", _decode_cells, _encode_cells, record=16),
    "cubes": Layout("file_level int, level int, lx double, ly double, lz double, ids array<int>", _decode_cubes, _encode_cubes, record=48),
    "domains": Layout("domain_id long, lx double, ly double, lz double, hx double, hy double, hz double, majorant double", _decode_domains, _encode_domains, record=28, head=8, header=lambda n: struct.pack("<Q", n)),
    "tree": Layout("idx long, split long, bits long, max_level int", _decode_tree, record=12),
    "bricks": Layout("file string, n long, lx int, ly int, lz int, sx int, sy int, sz int, level int, ids array<int>", **_headed(BRICK_HEAD, lambda h: h["sx"] * h["sy"] * h["sz"], False), one_number=False),
    "gridlets": Layout("file string, n long, lx int, ly int, lz int, dx int, dy int, dz int, level int, ids array<int>", **_headed(GRIDLET_HEAD, lambda h: math.prod(h[k] + 1 for k in ("dx", "dy", "dz")), True), one_number=False),
    "triangles": Layout("mesh_id long, tri_id long, v1 array<double>, v2 array<double>, v3 array<double>", _decode_triangles, _encode_triangles, length=_mesh_length),
}
