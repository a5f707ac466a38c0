"""GeoTIFF elevation models as DataFrames of cells, and back.

Plain numpy: strips or tiles, without compression, with deflate or with LZW, one band of
integers or floats, horizontal predictor included.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _unlzw(data: bytes) -> bytes:
    """LZW with codes of rising width, most significant bit first."""
    table: list[bytes] = []
    out = bytearray()
    width, bits, value, before = 9, 0, 0, b""
    for byte in data:
        value, bits = value << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = value >> bits & ((1 << width) - 1)
            value &= (1 << bits) - 1
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            if not before:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else before + before[:1]
                table.append(before + entry[:1])
            out += entry
            before = entry
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def decode(content: bytes) -> tuple[np.ndarray, dict[str, Any]]:
    """(band, information) of a file's bytes: ``origin``, ``pixel`` and ``nodata`` where given."""
    order = "<" if content[:2] == b"II" else ">"
    if struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", content[4:8])[0]
    tags: dict[int, Any] = {}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        size = _SIZES.get(kind, 1) * n
        where = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", content[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        raw = content[where : where + size]
        tags[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else struct.unpack(order + str(n) + _CODES[kind], raw) if kind in _CODES else raw
    width, height = tags[256][0], tags[257][0]
    depth, form = tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(depth // 8))
    packing, predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    tiled = 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, tags.get(278, (height,))[0])
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    out = np.zeros((height, width), dtype)
    across = -(-width // tw)
    for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        data = content[start : start + size]
        data = zlib.decompress(data) if packing in (8, 32946) else _unlzw(data) if packing == 5 else data
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, height - y)
        block = np.frombuffer(data, dtype, rows * tw).reshape(rows, tw)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype)
        h, w = min(rows, height - y), min(tw, width - x)
        out[y : y + h, x : x + w] = block[:h, :w]
    info: dict[str, Any] = {}
    if 33922 in tags and 33550 in tags:
        info["origin"], info["pixel"] = (tags[33922][3], tags[33922][4]), tags[33550][:2]
    if 42113 in tags:
        info["nodata"] = float(tags[42113])
    return out, info


def encode(band: np.ndarray, origin: tuple[float, float], pixel: float, nodata: float) -> bytes:
    """The bytes of a one-band float32 file with deflate."""
    data = zlib.compress(np.ascontiguousarray(band, "<f4").tobytes())
    text = f"{nodata:g}\0".encode()
    entries = [
        (256, 4, [band.shape[1]]), (257, 4, [band.shape[0]]), (258, 3, [32]), (259, 3, [8]), (262, 3, [1]), (273, 4, [8]), (277, 3, [1]),
        (278, 4, [band.shape[0]]), (279, 4, [len(data)]), (339, 3, [3]), (33550, 12, [pixel, pixel, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *origin, 0.0]), (42113, 2, text),
    ]
    at = 8 + len(data) + len(data) % 2
    tail_at, tail, head = at + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, values in entries:
        raw = values if kind == 2 else struct.pack("<" + str(len(values)) + _CODES[kind], *values)
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, len(values), tail_at + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(entries)) + head + b"\0\0\0\0" + tail


def read_dem(spark: SparkSession, path: str, low: float = -100.0, high: float = 9000.0) -> DataFrame:
    """``file, ix, iy, x, y, z`` of all files of a path, row 0 in the north.

    Values that the file calls missing, NaN and values below ``low`` or above ``high`` are
    null. One task reads one file, so large models should come as tiles.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                band, info = decode(bytes(content))
                ox, oy = info.get("origin", (0.0, 0.0))
                px, py = info.get("pixel", (1.0, 1.0))
                for y in range(0, band.shape[0], 256):
                    z = band[y : y + 256].astype(float)
                    iy, ix = np.indices(z.shape)
                    bad = np.isnan(z) | (z < low) | (z > high) | (z == info.get("nodata", np.nan))
                    z[bad] = np.nan
                    iy = iy + y
                    frame = {"file": name, "ix": ix.ravel(), "iy": iy.ravel(), "x": ox + (ix.ravel() + 0.5) * px, "y": oy - (iy.ravel() + 0.5) * py}
                    out = pd.DataFrame(frame)
                    out["z"] = pd.Series(z.ravel()).where(~bad.ravel(), None).astype(object)
                    yield out

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, ix int, iy int, x double, y double, z double")


def write_band(df: DataFrame, value: str, path: str, origin: tuple[float, float], pixel: float, nodata: float = -9999.0, most_cells: int = 50_000_000) -> None:
    """Write a grid as one float32 GeoTIFF, null as ``nodata``. The grid must fit the driver: at most ``most_cells`` cells."""
    rows = df.select("ix", "iy", value).limit(most_cells + 1).toPandas()
    if len(rows) > most_cells:
        raise ValueError(f"more than {most_cells} cells")
    band = np.full((int(rows["iy"].max()) + 1, int(rows["ix"].max()) + 1), nodata, np.float32)
    band[rows["iy"], rows["ix"]] = rows[value].astype(float).fillna(nodata)
    with open(path, "wb") as f:
        f.write(encode(band, origin, pixel, nodata))
