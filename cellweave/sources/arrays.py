"""Image arrays from files: npy, npz and plain TIFF, read by planes.

Tasks read headers alone, a few kilobytes of each file, and say where each plane lies; the planes are then dealt to tasks in ranges of some
megabytes, each read by its place in the file. So a large file is read by many tasks, and none holds it. What cannot be read in parts (a
compressed entry, a file that only Spark reaches, other formats, which plug in as a function of bytes) is read whole.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources.named import file_system, opened_by_tasks, save_files

PLANES = "path string, name string, frame_i long, z long, height int, width int, data array<float>, dtype string"
#: Bytes of planes that are read together.
RANGE_BYTES = 32 << 20
#: TIFF tags, and the bytes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 273, 278, 279, 339
FIELD = {1: "B", 3: "H", 4: "I"}
DECODERS: dict[str, Callable[[bytes], dict[str, np.ndarray]]] = {}


def tiff_pages(raw: bytes) -> np.ndarray:
    """The pages of an uncompressed grey TIFF as (pages, height, width)."""
    e = _tiff_entry(io.BytesIO(raw))
    return np.stack([np.frombuffer(b"".join(raw[a : a + n] for a, n in page), e.dtype).reshape(e.shape[1:]) for page in e.planes])


def tiff_bytes(pages: np.ndarray) -> bytes:
    """Pages (pages, height, width) as an uncompressed grey TIFF."""
    kind = {"u": 1, "i": 2, "f": 3}[pages.dtype.kind]
    out = io.BytesIO(struct.pack("<2sHI", b"II", 42, 8))
    out.seek(8)
    for k, page in enumerate(pages):
        body = np.ascontiguousarray(page.astype(page.dtype.newbyteorder("<"))).tobytes()
        at = out.tell()
        data = at + 2 + 12 * 9 + 4
        tags = [(WIDTH, page.shape[1]), (HEIGHT, page.shape[0]), (BITS, 8 * page.dtype.itemsize), (COMPRESSION, 1), (262, 1), (OFFSETS, data), (ROWS, page.shape[0]), (COUNTS, len(body)), (FORMAT, kind)]
        following = 0 if k == len(pages) - 1 else data + len(body) + len(body) % 2
        out.write(struct.pack("<H", 9) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + struct.pack("<I", following))
        out.write(body + b"\0" * (len(body) % 2))
    return out.getvalue()


def decode(path: str, raw: bytes) -> dict[str, np.ndarray]:
    """The named arrays of a file; a file of one array calls it ``arr_0``."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in DECODERS:
        return DECODERS[ending](raw)
    if ending == "npy":
        return {"arr_0": np.load(io.BytesIO(raw))}
    if ending == "npz":
        with np.load(io.BytesIO(raw)) as z:
            return {n: z[n] for n in z.files}
    if ending in ("tif", "tiff"):
        return {"arr_0": tiff_pages(raw)}
    raise ValueError(f"no decoder for .{ending}; add one to DECODERS")


def volume_shape(shape: Sequence[int], size_t: int | None = None, size_z: int | None = None) -> tuple[int, int, int, int]:
    """An array's shape as (t, z, y, x). Three axes are time, unless the sizes say that they are depth; single axes elsewhere go."""
    n = [int(k) for k in shape]
    if len(n) > 4:
        n = [k for k in n[:-2] if k != 1] + n[-2:]
    if len(n) == 2:
        return 1, 1, *n
    if len(n) == 3:
        if size_t and size_z and size_t * size_z == n[0]:
            return size_t, size_z, *n[1:]
        return (1, *n) if size_z == n[0] and (size_t or 1) == 1 and n[0] > 1 else (n[0], 1, *n[1:])
    if len(n) == 4:
        if (size_t and n[0] != size_t) or (size_z and n[1] != size_z):
            raise ValueError(f"a shape of {tuple(n)} does not agree with {size_t} frames of {size_z} slices")
        return tuple(n)
    raise ValueError(f"no image has a shape of {tuple(shape)}")


def as_volume(array: np.ndarray, size_t: int | None = None, size_z: int | None = None) -> np.ndarray:
    """An array as (t, z, y, x): see ``volume_shape``."""
    return array.reshape(volume_shape(array.shape, size_t, size_z))


@dataclass
class Entry:
    """An array of a file: its name, type and shape, and the byte ranges of each of its planes, or none if it is read whole."""

    name: str
    dtype: str
    shape: tuple[int, ...]
    planes: Sequence[Sequence[tuple[int, int]]] | None


def _npy_entry(name: str, head: bytes, start: int | None) -> Entry:
    """An entry from the beginning of an npy file, whose bytes lie from ``start`` on, or nowhere in parts."""
    f = io.BytesIO(head)
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    planes = None
    if start is not None and not (fortran and len(shape) > 1) and len(shape) >= 2:
        size = int(shape[-1] * shape[-2]) * dtype.itemsize
        planes = [[(start + f.tell() + k * size, size)] for k in range(int(np.prod(shape[:-2], dtype=np.int64)))]
    return Entry(name, dtype.str if planes else str(dtype), tuple(int(x) for x in shape), planes)


def _tiff_entry(file: BinaryIO) -> Entry:
    """The pages of an uncompressed grey TIFF, all of one size and type."""
    at = lambda place, size: (file.seek(place), file.read(size))[1]
    order = {b"II": "<", b"MM": ">"}.get(at(0, 2))
    if order is None or struct.unpack(f"{order}H", at(2, 2))[0] != 42:
        raise ValueError("not a TIFF file")
    where, pages, kinds = struct.unpack(f"{order}I", at(4, 4))[0], [], set()
    while where:
        n = struct.unpack(f"{order}H", at(where, 2))[0]
        table, tags = at(where + 2, 12 * n + 4), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", table, 12 * k)
            code = FIELD.get(kind)
            if code:
                size = struct.calcsize(code) * count
                raw = table[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else at(struct.unpack_from(f"{order}I", table, 12 * k + 8)[0], size)
                tags[tag] = struct.unpack(f"{order}{count}{code}", raw)
        if tags.get(COMPRESSION, (1,))[0] != 1 or len(tags.get(BITS, (1,))) != 1:
            raise ValueError("only uncompressed grey TIFF files are read")
        kinds.add((f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(FORMAT, (1,))[0]] }{tags[BITS][0] // 8}", tags[HEIGHT][0], tags[WIDTH][0]))
        pages.append(list(zip(tags[OFFSETS], tags[COUNTS])))
        where = struct.unpack_from(f"{order}I", table, 12 * n)[0]
    if len(kinds) != 1:
        raise ValueError("the pages of a TIFF file differ in size or type")
    dtype, height, width = kinds.pop()
    return Entry("arr_0", dtype, (len(pages), height, width), pages)


def entries(path: str, file: BinaryIO) -> list[Entry]:
    """The arrays of an npy, npz or TIFF file from its headers alone."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "npy":
        return [_npy_entry("arr_0", file.read(4096), 0)]
    if ending in ("tif", "tiff"):
        return [_tiff_entry(file)]
    found = []
    with zipfile.ZipFile(file) as z:
        for info in z.infolist():
            start = None
            if info.compress_type == zipfile.ZIP_STORED:
                file.seek(info.header_offset)
                names = struct.unpack("<HH", file.read(30)[26:])
                start = info.header_offset + 30 + sum(names)
            with z.open(info) as inner:
                found.append(_npy_entry(info.filename.removesuffix(".npy"), inner.read(4096), start))
    return found


def _opened(path: str) -> BinaryIO:
    system, place = file_system(path)
    return system.open_input_file(place)


def _paths(spark: SparkSession, path: str | list[str] | DataFrame) -> DataFrame:
    return path.select("path").distinct() if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path).select("path")


def _in_parts(path: str | list[str] | DataFrame) -> bool:
    if isinstance(path, DataFrame):
        return True
    each = [path] if isinstance(path, str) else path
    return all(opened_by_tasks(p) and p.rstrip("*").rsplit(".", 1)[-1].lower() in ("npy", "npz", "tif", "tiff") for p in each)


RANGES = "path string, name string, dtype string, shape array<long>, first long, planes array<array<struct<at: long, size: long>>>"


def plane_ranges(spark: SparkSession, path: str | list[str] | DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, name, dtype, shape, first, planes)``: where the planes of each array lie, from ``first`` on, in ranges of some megabytes.

    Only headers are read. An array that cannot be read in parts is one range without ``planes``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RANGES.split(", ", 4)[:4]] + ["first", "planes"]
        for batch in batches:
            for p in batch["path"]:
                rows = []
                with _opened(p) as file:
                    for e in entries(p, file):
                        if e.planes is None:
                            rows.append((p, e.name, e.dtype, list(e.shape), 0, None))
                            continue
                        together = max(1, range_bytes // max(1, sum(size for _, size in e.planes[0]) if e.planes else 1))
                        rows += [(p, e.name, e.dtype, list(e.shape), k, [[{"at": a, "size": n} for a, n in plane] for plane in e.planes[k : k + together]]) for k in range(0, len(e.planes), together)]
                yield pd.DataFrame(rows, columns=names)

    return _paths(spark, path).mapInPandas(run, RANGES)


def _read_ranges(ranges: DataFrame, size_t: int | None, size_z: int | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                t, depth, height, width = volume_shape(r.shape, size_t, size_z)
                with _opened(r.path) as file:
                    if r.planes is None:
                        if r.path.lower().endswith(".npz"):
                            with zipfile.ZipFile(file) as z, z.open(f"{r.name}.npy") as inner:
                                whole = np.lib.format.read_array(inner)
                        else:
                            whole = np.lib.format.read_array(file)
                        found = enumerate(as_volume(whole, size_t, size_z).reshape(-1, height, width))
                    else:
                        part = lambda p: b"".join(file.read_at(int(s["size"]), int(s["at"])) for s in p)  # noqa: B023, E731
                        found = ((r.first + k, np.frombuffer(part(p), r.dtype)) for k, p in enumerate(r.planes))
                    for k, plane in found:
                        row = (r.path, r.name, k // depth, k % depth, height, width, plane.astype(np.float32).ravel(), np.dtype(r.dtype).name)
                        yield pd.DataFrame([row], columns=[c.split()[0] for c in PLANES.split(", ")])

    dealt = ranges.repartition(F.xxhash64("path", "name", "first"))
    return dealt.mapInPandas(run, PLANES)


def _read_whole(spark: SparkSession, path: str | list[str], size_t: int | None, size_z: int | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, raw in zip(batch["path"], batch["content"]):
                for name, array in decode(p, bytes(raw)).items():
                    v = as_volume(np.asarray(array), size_t, size_z)
                    for t in range(v.shape[0]):
                        rows = [(p, name, t, z, v.shape[2], v.shape[3], v[t, z].astype(np.float32).ravel(), v.dtype.name) for z in range(v.shape[1])]
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLANES.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PLANES)


def read_planes(spark: SparkSession, path: str | list[str] | DataFrame, size_t: int | None = None, size_z: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, name, frame_i, z, height, width, data, dtype)``: a row per plane, values as 32-bit floats.

    Npy, npz and TIFF files are read in ranges of planes if their paths end so and tasks can open them; others whole, a file to a task.
    Paths may also be a table (``path``) of such files.
    """
    if _in_parts(path):
        return _read_ranges(plane_ranges(spark, path, range_bytes), size_t, size_z)
    return _read_whole(spark, path, size_t, size_z)


def pixels_of(planes: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """A row per pixel, with the columns ``keep`` of its plane.

    Spark takes pixels to be as few as planes: do not join them with what it may set beside them as small, but keep what is needed.
    """
    rows = planes.select("path", "name", "frame_i", "z", "width", *keep, F.posexplode("data").alias("i", column))
    return rows.select("path", "name", "frame_i", "z", F.floor(F.col("i") / F.col("width")).alias("y"), (F.col("i") % F.col("width")).cast("long").alias("x"), column, *keep)


def labels_of(planes: DataFrame) -> DataFrame:
    """A row per pixel of an object: values below 0 are background, fractions are cut off."""
    return pixels_of(planes, "v").withColumn("label", F.greatest(F.lit(0).cast("long"), F.col("v").cast("long"))).drop("v").where("label <> 0")


def probe(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, name, shape, dtype)`` of npy, npz and TIFF files; of each only headers are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch["path"]:
                with _opened(p) as file:
                    rows += [(p, e.name, list(e.shape), np.dtype(e.dtype).name) for e in entries(p, file)]
            yield pd.DataFrame(rows, columns=["path", "name", "shape", "dtype"])

    return _paths(spark, path).mapInPandas(run, "path string, name string, shape array<long>, dtype string")


def to_type(plane: np.ndarray, dtype: str) -> np.ndarray:
    """A plane as another type; integers are rounded, and stretched if the values do not fit or are fractions.

    Fractions (0 to 1) count as parts of the type's largest; values below 0 or above it are stretched from the plane's least to its greatest.
    """
    if np.dtype(dtype).kind == "f":
        return plane.astype(dtype)
    top, v = float(np.iinfo(dtype).max), plane.astype(np.float64)
    low, high = float(v.min(initial=np.inf)), float(v.max(initial=-np.inf))
    if v.size and (low < 0 or high > top or high <= 1):
        v = v * top if low >= 0 and high <= 1 else np.zeros_like(v) if high - low <= np.finfo(np.float32).eps else (v - low) / (high - low) * top
    return np.clip(np.floor(v + 0.5), 0, top).astype(dtype)


def file_bytes(arrays: dict[str, np.ndarray], fmt: str) -> bytes:
    """Arrays as an npz file (deflated), one as an npy or TIFF file."""
    f = io.BytesIO()
    if fmt == "npz":
        np.savez_compressed(f, **arrays)
    elif fmt == "npy":
        np.save(f, next(iter(arrays.values())))
    else:
        array = next(iter(arrays.values()))
        f.write(tiff_bytes(array.reshape(-1, *array.shape[-2:])))
    return f.getvalue()


def encode_images(pixels: DataFrame, shape: tuple[int, ...], keys: list[str], column: str = "value", dtype: str = "float32", fmt: str = "tif") -> DataFrame:
    """``(…, content)``: the dense image of each key as a file of ``dtype``, plane by plane by ``to_type``; pixels without a row are 0.

    ``shape`` is (t, y, x), (t, z, y, x) or, for one frame, (y, x). A task holds one image.
    """
    return _encoded(pixels, shape, keys, column, fmt, lambda dense: np.stack([to_type(p, dtype) for p in dense.reshape(-1, *shape[-2:])]).reshape(shape))


def encode_archives(archives: DataFrame, keys: list[str]) -> DataFrame:
    """``(…, content)``: the arrays of regions (``areas.archives``: ``name, frame_i, [z,] y, x, value``) of each key as an npz file of 32-bit floats."""
    axes = [a for a in ("frame_i", "z", "y", "x") if a in archives.columns]
    source = archives.select(*keys, "name", *axes, F.col("value").cast("float").alias("value"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        arrays = {}
        for name, own in rows.groupby("name", sort=True):
            at = tuple(own[a].to_numpy(np.int64) for a in axes)
            arrays[name] = np.zeros([int(x.max()) + 1 for x in at], np.float32)
            arrays[name][at] = own["value"]
        return pd.DataFrame({k: [rows[k].iloc[0]] for k in keys} | {"content": [file_bytes(arrays, "npz")]})

    return source.groupBy(*keys).applyInPandas(run, _content(source, keys))


def freehand_pixels(planes: DataFrame) -> DataFrame:
    """``(path, y, x)`` of every pixel of free-hand regions: of each file's first array, whose name is its box, ``x0_y0_x1_y1``, in the image."""
    parts = F.split("name", "_").cast("array<long>")
    bad = F.raise_error(F.concat(F.lit("not the box of a region: "), "name")).cast("array<long>")
    box = F.when(F.col("name").rlike(r"^\d+_\d+_\d+_\d+$"), parts).otherwise(bad)
    first = planes.groupBy("path").agg(F.min_by(F.struct("name", "width", "data"), "name").alias("r")).select("path", "r.*").withColumn("box", box)
    each = first.select("path", "box", "width", F.posexplode("data").alias("i", "v")).where("v <> 0")
    return each.select("path", (F.col("box")[1] + F.floor(F.col("i") / F.col("width"))).alias("y"), (F.col("box")[0] + F.col("i") % F.col("width")).alias("x"))


def encode_freehand(rois: DataFrame, keys: list[str]) -> DataFrame:
    """``(…, content)``: the region (y, x) of each key as an npz file of one array of flags, called by its box ``x0_y0_x1_y1``, last row and column included."""
    source = rois.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        return pd.DataFrame({k: [rows[k].iloc[0]] for k in keys} | {"content": [file_bytes({f"{x.min()}_{y.min()}_{x.max()}_{y.max()}": mask}, "npz")]})

    return source.groupBy(*keys).applyInPandas(run, _content(source, keys))


def _content(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", content binary"


def _encoded(pixels: DataFrame, shape: tuple[int, ...], keys: list[str], column: str, fmt: str, finish: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    axes = [a for a, _ in zip(("frame_i", "z", "y", "x") if len(shape) == 4 else ("frame_i", "y", "x")[3 - len(shape) :], shape)]
    source = pixels.select(*keys, *axes, column)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros(shape, np.float64)
        dense[tuple(rows[a].to_numpy(np.int64) for a in axes)] = rows[column].to_numpy(np.float64)
        return pd.DataFrame({k: [rows[k].iloc[0]] for k in keys} | {"content": [file_bytes({"arr_0": finish(dense)}, fmt)]})

    return source.groupBy(*keys).applyInPandas(run, _content(source, keys))


def encode_labels(labels: DataFrame, shape: tuple[int, ...], keys: list[str], fmt: str = "npz") -> DataFrame:
    """``(…, content)``: the dense label image of each position (``keys``) as an npz (``arr_0``), npy or TIFF file of 32-bit integers.

    ``shape`` is (t, y, x), (t, z, y, x) or, for one frame, (y, x). A task holds one position's image.
    """
    return _encoded(labels, shape, keys, "label", fmt, lambda dense: dense.astype(np.uint32))


def convert(planes: DataFrame, fmt: str, cast_labels: bool = False) -> DataFrame:
    """``(path, content)``: the array of each file as a file of another format and the same type; labels as 32-bit integers, none below 0.

    ``planes`` are those of ``read_planes``; axes of length 1 stay out of the shape. A task holds one file's array.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_i", "z"])
        t, z, y, x = int(rows["frame_i"].max()) + 1, int(rows["z"].max()) + 1, int(rows["height"].iloc[0]), int(rows["width"].iloc[0])
        values = np.stack(list(rows["data"])).reshape([n for n in (t, z) if n > 1] + [y, x])
        values = np.floor(np.maximum(values, 0) + 0.5).astype(np.uint32) if cast_labels else values.astype(rows["dtype"].iloc[0])
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [file_bytes({"arr_0": values}, fmt)]})

    return planes.groupBy("path").applyInPandas(run, "path string, content binary")


__all__ = ["convert", "decode", "encode_archives", "encode_freehand", "encode_images", "encode_labels", "entries", "freehand_pixels", "labels_of", "pixels_of", "plane_ranges", "probe", "read_planes", "save_files", "to_type"]
