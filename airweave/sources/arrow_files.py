"""Feather, NetCDF and GeoTIFF through ``binaryFile``: Spark lists and fetches, a worker decodes one file at a time."""

from __future__ import annotations

import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, content) of the files under ``path`` whose names match a glob."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "content")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a table of this name is there."""
    if "/" not in path and spark.catalog.tableExists(path):
        return True
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def decoded(found: DataFrame, decode: Callable[[bytes, str], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of each file by ``decode(content, path)``, one file in memory at a time."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield decode(bytes(content), path)

    return found.mapInPandas(run, schema)


def feather(found: DataFrame, schema: str, names: list[str] | None = None, endings: dict[str, str] | None = None) -> DataFrame:
    """Feather files with the columns of ``schema`` (and ``path``): chosen by name, or renamed by position to ``names``.

    ``endings``: columns that are found by how their name in the file ends.
    """
    from pyspark.sql.types import StructType

    wanted = [f.name for f in StructType.fromDDL(schema).fields if f.name != "path"]

    def decode(content: bytes, path: str) -> pd.DataFrame:
        import pyarrow.feather

        pdf = pyarrow.feather.read_table(io.BytesIO(content)).to_pandas()
        if names:
            pdf = pdf.set_axis(names, axis=1)
        for name, ending in (endings or {}).items():
            pdf = pdf.rename(columns={next(c for c in pdf.columns if c.endswith(ending)): name})
        return pdf[wanted].assign(path=path)

    return decoded(found, decode, schema if "path" in schema.split() else schema + ", path string")


def netcdf(found: DataFrame, variables: list[str], dims: dict[str, str], attributes: tuple[str, ...] = ()) -> DataFrame:
    """Long cells of NetCDF-3 or -4 files: ``dims`` maps file dimensions to columns (double; times as in the file).

    Needs ``netCDF4`` or ``scipy`` on the workers and says so where both are missing.
    """
    schema = ", ".join([*(f"`{c}` double" for c in dims.values()), *(f"`{v}` double" for v in variables), *(f"`{a}` string" for a in attributes), "path string"])

    def decode(content: bytes, path: str) -> pd.DataFrame:
        import numpy as np

        try:
            import netCDF4

            f = netCDF4.Dataset("in-memory", memory=content)
            f.set_auto_mask(False)
        except ImportError:
            try:
                from scipy.io import netcdf_file
            except ImportError as e:
                raise ImportError("reading NetCDF needs netCDF4 or scipy; Parquet cells are read without them") from e
            f = netcdf_file(io.BytesIO(content), "r", mmap=False)
        axes = [np.array(f.variables[d][:], float) for d in dims]
        grid = np.meshgrid(*axes, indexing="ij")
        out = {c: g.ravel() for c, g in zip(dims.values(), grid, strict=True)}
        for v in variables:
            x = f.variables[v]
            a = np.array(x[:], float)
            fill = getattr(x, "_FillValue", None)
            a = np.where(a == fill, np.nan, a) if fill is not None else a
            if not hasattr(f, "set_auto_mask"):
                a = a * getattr(x, "scale_factor", 1.0) + getattr(x, "add_offset", 0.0)
            out[v] = np.transpose(a, [x.dimensions.index(d) for d in dims]).ravel()
        text = lambda a: a.decode() if isinstance(a, bytes) else str(a)
        return pd.DataFrame(out).assign(**{a: text(getattr(f, a)) for a in attributes}, path=path)

    return decoded(found, decode, schema)


def geotiff(found: DataFrame) -> DataFrame:
    """(y, x, value, path): first band of plain GeoTIFFs (uncompressed or deflate, strips or tiles, float or integer samples)."""

    def decode(content: bytes, path: str) -> pd.DataFrame:
        x, y, v = read_geotiff(content)
        return pd.DataFrame({"y": y, "x": x, "value": v, "path": path})

    return decoded(found, decode, "y double, x double, value double, path string")


#: TIFF field types (bytes each, struct letter) and the tags that are read.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, PER_PIXEL, STRIP_ROWS, STRIP_BYTES, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SCALE, TIE, NODATA = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 42113


def read_geotiff(content: bytes):
    """(x, y, value) of pixel centres; no-data is missing."""
    import struct
    import zlib

    import numpy as np

    order = {b"II": "<", b"MM": ">"}[content[:2]]
    (at,) = struct.unpack_from(order + "I", content, 4)
    (n,) = struct.unpack_from(order + "H", content, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
        if kind not in TYPES:
            continue
        size, letter = TYPES[kind]
        where = at + 10 + 12 * i
        if size * count > 4:
            (where,) = struct.unpack_from(order + "I", content, where)
        tags[tag] = content[where : where + count] if letter == "s" else struct.unpack_from(f"{order}{count}{letter}", content, where)
    one = lambda t, d=None: tags[t][0] if t in tags else d
    w, h, packed, per = one(WIDTH), one(HEIGHT), one(COMPRESSION, 1), one(PER_PIXEL, 1)
    if packed not in (1, 8, 32946):
        raise ValueError(f"TIFF compression {packed} isn't read here")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(one(BITS, 8) // 8))
    tiled = TILES in tags
    bw, bh = (one(TILE_W), one(TILE_H)) if tiled else (w, one(STRIP_ROWS, h))
    across = -(-w // bw)
    out = np.full((h, w), np.nan)
    for i, (start, size) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        raw = content[start : start + size]
        raw = zlib.decompress(raw) if packed != 1 else raw
        a = np.frombuffer(raw, kind)
        rows = len(a) // (bw * per)
        a = a[: rows * bw * per].reshape(rows, bw, per)
        if one(PREDICTOR, 1) == 2:
            a = np.cumsum(a, axis=1, dtype=kind)
        r, c = i // across * bh, i % across * bw
        part = a[: max(0, h - r), : w - c, 0]
        out[r : r + part.shape[0], c : c + part.shape[1]] = part
    if NODATA in tags:
        out[out == float(tags[NODATA].strip(b"\0 "))] = np.nan
    sx, sy, *_ = tags.get(SCALE, (1.0, 1.0, 0.0))
    i0, j0, _, x0, y0, _ = tags.get(TIE, (0.0,) * 6)[:6]
    xs, ys = x0 + (np.arange(w) + 0.5 - i0) * sx, y0 - (np.arange(h) + 0.5 - j0) * sy
    return np.tile(xs, h), np.repeat(ys, w), out.ravel()
