"""LAS and PLY point clouds as tables, and LAS files from tables."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "scan string, pid long, x double, y double, z double, r int, g int, b int"
# Where a point format keeps its colour, and PLY's scalar names.
COLOUR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
SCALARS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def las_header(data: bytes) -> dict:
    """Fields of a LAS 1.0 to 1.4 header; compressed files are refused."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = data[25]
    offset = struct.unpack_from("<I", data, 96)[0]
    n_vlr = struct.unpack_from("<I", data, 100)[0]
    kind, size, n = data[104], *struct.unpack_from("<HI", data, 105)
    if kind & 0x80:
        raise ValueError("compressed LAS (LAZ) is not read")
    if minor >= 4:
        n = struct.unpack_from("<Q", data, 247)[0] or n
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    return {"offset": offset, "format": kind & 0x7F, "size": size, "n": n, "scale": scale, "shift": shift, "epsg": _epsg(data, n_vlr)}


def _epsg(data: bytes, n_vlr: int) -> int | None:
    """Projected system from the GeoKey directory (key 3072) or the WKT record's last authority."""
    at = struct.unpack_from("<H", data, 94)[0]
    for _ in range(n_vlr):
        if at + 54 > len(data):
            break
        record, length = struct.unpack_from("<HH", data, at + 18)
        body = data[at + 54 : at + 54 + length]
        if record == 34735:
            keys = np.frombuffer(body[: len(body) // 8 * 8], "<u2").reshape(-1, 4)
            hit = keys[keys[:, 0] == 3072]
            if len(hit):
                return int(hit[0, 3])
        elif record == 2112:
            found = re.findall(r'(?:AUTHORITY\["EPSG",\s*"|ID\["EPSG",\s*)(\d+)', body.decode("latin-1"))
            if found:
                return int(found[-1])
        at += 54 + length
    return None


def read_las(data: bytes, every: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Point numbers, coordinates (n x 3) and colours (n x 3, 0 to 255) or None."""
    h = las_header(data)
    n = min(h["n"], (len(data) - h["offset"]) // h["size"])
    raw = np.frombuffer(data, np.uint8, n * h["size"], h["offset"]).reshape(n, h["size"])[::every]
    whole = np.ascontiguousarray(raw[:, :12]).view("<i4").astype(np.float64)
    xyz = whole * h["scale"] + h["shift"]
    at = COLOUR_AT.get(h["format"])
    rgb = None
    if at is not None and len(raw):
        wide = np.ascontiguousarray(raw[:, at : at + 6]).view("<u2")
        rgb = (wide >> 8 if wide.max() > 255 else wide).astype(np.int32)
    return np.arange(0, n, every), xyz, rgb


def read_ply(data: bytes, every: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """As read_las, of an ASCII or binary little-endian PLY whose vertices come first."""
    end = data.index(b"end_header\n") + len(b"end_header\n")
    lines = data[:end].decode("latin-1").split("\n")
    form = next(x.split()[1] for x in lines if x.startswith("format"))
    names, kinds, n, inside = [], [], 0, False
    for x in map(str.split, lines):
        if x[:1] == ["element"]:
            if inside:
                break
            if x[1] != "vertex":
                raise ValueError("vertices must come first")
            n, inside = int(x[2]), True
        elif x[:1] == ["property"] and inside:
            names.append(x[2])
            kinds.append(SCALARS[x[1]])
    if form == "ascii":
        table = np.array([r.split()[: len(names)] for r in data[end:].decode("latin-1").split("\n")[:n]], np.float64)
        col = {c: table[:, k] for k, c in enumerate(names)}
    elif form == "binary_little_endian":
        table = np.frombuffer(data, np.dtype([(c, "<" + k) for c, k in zip(names, kinds, strict=True)]), n, end)
        col = {c: table[c] for c in names}
    else:
        raise ValueError(f"PLY format {form} is not read")
    xyz = np.stack([np.asarray(col[c], np.float64) for c in "xyz"], axis=1)[::every]
    colour = [next((c for c in (k, k[0]) if c in col), None) for k in ("red", "green", "blue")]
    rgb = np.stack([np.asarray(col[c]).astype(np.int32) for c in colour], axis=1)[::every] if all(colour) else None
    return np.arange(0, n, every), xyz, rgb


def points(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Points of all LAS and PLY files under a path; scan is the file's name. most: a file is thinned to so many by a constant stride."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                las = data[:4] == b"LASF"
                n = las_header(data)["n"] if las else int(re.search(rb"element vertex (\d+)", data[:4096])[1])
                every = max(1, -(-n // most)) if most else 1
                pid, xyz, rgb = (read_las if las else read_ply)(data, every)
                scan = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for lo in range(0, len(pid), 100_000):
                    s = slice(lo, lo + 100_000)
                    m = len(pid[s])
                    colours = [pa.array(rgb[s, k], pa.int32()) for k in range(3)] if rgb is not None else [pa.nulls(m, pa.int32())] * 3
                    yield pa.RecordBatch.from_arrays([pa.array([scan] * m), pa.array(pid[s], pa.int64()), *[pa.array(xyz[s, k]) for k in range(3)], *colours], names=["scan", "pid", "x", "y", "z", "r", "g", "b"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower("path").rlike(r"\.(las|ply)$")).select("path", "content")
    return files.mapInArrow(run, POINTS)


def las_bytes(xyz: np.ndarray, rgb: np.ndarray | None = None, scale: float = 1e-4, vlr: bytes = b"", n_vlr: int = 0) -> bytes:
    """A LAS 1.2 file of format 2 (with colours) or 0."""
    size, kind = (26, 2) if rgb is not None else (20, 0)
    low = xyz.min(axis=0) if len(xyz) else np.zeros(3)
    high = xyz.max(axis=0) if len(xyz) else np.zeros(3)
    shift = np.floor(low)
    whole = np.rint((xyz - shift) / scale)
    if len(whole) and np.abs(whole).max() > 2**31 - 1:
        raise ValueError("the extent is too large for the scale")
    head = bytearray(227)
    head[0:4], head[24:26] = b"LASF", bytes([1, 2])
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<II", head, 96, 227 + len(vlr), n_vlr)
    struct.pack_into("<BHI", head, 104, kind, size, len(xyz))
    struct.pack_into("<I", head, 111, len(xyz))
    struct.pack_into("<3d", head, 131, *[scale] * 3)
    struct.pack_into("<3d", head, 155, *shift)
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    out = np.zeros((len(xyz), size), np.uint8)
    out[:, :12] = np.ascontiguousarray(whole.astype("<i4")).view(np.uint8).reshape(-1, 12)
    if rgb is not None:
        out[:, 20:26] = np.ascontiguousarray(rgb.astype("<u2") * 257).view(np.uint8).reshape(-1, 6)
    return bytes(head) + vlr + out.tobytes()


def las_files(pts: DataFrame) -> DataFrame:
    """scan and the bytes of its LAS file. A scan is one file by nature and is built in one task."""

    def run(rows):
        scan = rows["scan"].iloc[0]
        rows = rows.sort_values("pid")
        rgb = rows[["r", "g", "b"]].to_numpy() if rows["r"].notna().all() else None
        import pandas as pd

        return pd.DataFrame({"scan": [scan], "content": [las_bytes(rows[["x", "y", "z"]].to_numpy(float), rgb)]})

    return pts.groupBy("scan").applyInPandas(run, "scan string, content binary")


def move_las(data: bytes, pivot: tuple[float, float], degrees: float, shift: tuple[float, float], scale: float = 1.0, scale_z: bool = False) -> bytes:
    """A LAS file turned and scaled about a pivot and shifted: only coordinates, offsets and bounds are written anew.

    scale_z scales heights too, about their median. Offsets are set anew so that whole numbers stay small; what still does
    not fit in 32 bits is an error.
    """
    h, out = las_header(data), bytearray(data)
    n = min(h["n"], (len(data) - h["offset"]) // h["size"])
    raw = np.frombuffer(out, np.uint8, n * h["size"], h["offset"]).reshape(n, h["size"])
    xyz = np.ascontiguousarray(raw[:, :12]).view("<i4") * h["scale"] + h["shift"]
    a, new = np.radians(degrees), xyz.copy()
    x, y = xyz[:, 0] - pivot[0], xyz[:, 1] - pivot[1]
    new[:, 0] = pivot[0] + shift[0] + scale * (np.cos(a) * x - np.sin(a) * y)
    new[:, 1] = pivot[1] + shift[1] + scale * (np.sin(a) * x + np.cos(a) * y)
    if scale_z and n:
        new[:, 2] = np.median(xyz[:, 2]) + scale * (xyz[:, 2] - np.median(xyz[:, 2]))
    return _rewritten(out, h, raw, new)


def _rewritten(out: bytearray, h: dict, raw: np.ndarray, xyz: np.ndarray) -> bytes:
    """The file with its records' coordinates replaced."""
    if not len(xyz):
        return bytes(out)
    low, high = xyz.min(axis=0), xyz.max(axis=0)
    shift = np.array([*np.floor(low[:2]), h["shift"][2]])
    whole = np.rint((xyz - shift) / h["scale"])
    if np.abs(whole).max() > 2**31 - 1:
        raise ValueError("the extent is too large for the scale")
    raw[:, :12] = np.ascontiguousarray(whole.astype("<i4")).view(np.uint8).reshape(-1, 12)
    struct.pack_into("<3d", out, 155, *shift)
    struct.pack_into("<6d", out, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    return bytes(out)


def join_las(files: list[bytes]) -> bytes:
    """Files of one point format as one, under the first one's header and projection records; other fields stay as they are."""
    heads = [las_header(d) for d in files]
    first = heads[0]
    if any((h["format"], h["size"]) != (first["format"], first["size"]) for h in heads):
        raise ValueError("the files have different point formats")
    parts, places = [], []
    for d, h in zip(files, heads, strict=True):
        n = min(h["n"], (len(d) - h["offset"]) // h["size"])
        raw = np.frombuffer(d, np.uint8, n * h["size"], h["offset"]).reshape(n, h["size"])
        parts.append(raw)
        places.append(np.ascontiguousarray(raw[:, :12]).view("<i4") * h["scale"] + h["shift"])
    total = sum(map(len, parts))
    out = bytearray(files[0][: first["offset"]] + np.concatenate(parts).tobytes())
    struct.pack_into("<I", out, 107, total)
    struct.pack_into("<5I", out, 111, total, 0, 0, 0, 0)
    raw = np.frombuffer(out, np.uint8, total * first["size"], first["offset"]).reshape(total, first["size"])
    return _rewritten(out, first, raw, np.concatenate(places))


def moved_files(files: DataFrame, motions: DataFrame) -> DataFrame:
    """scan and content of LAS files (scan, content), each under its motion: scan, px, py, degrees, dx, dy, scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [move_las(r["content"], (r["px"], r["py"]), r["degrees"], (r["dx"], r["dy"]), r["scale"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.binary())], names=["scan", "content"])

    kind = files.schema["scan"].dataType.simpleString()
    met = files.join(motions, "scan").select("scan", "content", *[F.col(c).cast("double") for c in ("px", "py", "degrees", "dx", "dy", "scale")])
    return met.mapInArrow(run, f"scan {kind}, content binary")


def joined_files(files: DataFrame) -> DataFrame:
    """site and content: the LAS files of each site (site, scan, content) as one, in order of their names. The result is one file by nature."""
    kind = files.schema["site"].dataType.simpleString()

    def run(key, rows):
        import pandas as pd

        return pd.DataFrame({"site": [key[0]], "content": [join_las([bytes(c) for c in rows.sort_values("scan")["content"]])]})

    return files.groupBy("site").applyInPandas(run, f"site {kind}, content binary")
