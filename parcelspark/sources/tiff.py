"""TIFF rasters as rows: files read by Spark, decoded in tasks.

Baseline files with strips or tiles: integers and floats of 8 to 64 bits, pixels
or planes apart, plain, LZW or deflate, with or without horizontal differences.
Anything else is refused with a ValueError that names it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Numbers of the tags that are read, and the sizes and codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE = 256, 257, 258, 259, 273, 277, 278, 279
PLANES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT = 284, 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def tags(read) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first image; ``read(at, size)`` gives bytes of the file."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", head[4:8])
    (n,) = struct.unpack(order + "H", read(at, 2))
    table = read(at + 2, 12 * n)
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", table, 12 * i)
        if kind not in TYPES:
            continue
        code = f"{order}{count}{TYPES[kind]}"
        size = struct.calcsize(code)
        own = table[12 * i + 8 : 12 * i + 12]
        out[tag] = struct.unpack(code, read(struct.unpack(order + "I", own)[0], size) if size > 4 else own[:size])
    return order, out


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first, which grow one code early."""
    table, out, previous = [], bytearray(), b""
    width, bits, held = 9, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            code = (held >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, previous, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
                continue
            piece = table[code] if code < len(table) else previous + previous[:1]
            if previous:
                table.append(previous + piece[:1])
            out += piece
            previous = piece
            width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


class Raster:
    """The first image of a file, of which windows are read by the strips or tiles they touch."""

    def __init__(self, read):
        self.read = read
        order, field = tags(read)
        one = lambda tag, usual=None: field[tag][0] if tag in field else usual
        self.h, self.w, self.bands = one(HEIGHT), one(WIDTH), one(SAMPLES, 1)
        kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
        bits, packing = set(field.get(BITS, (1,))), one(COMPRESSION, 1)
        if kind is None or len(bits) != 1 or min(bits) % 8:
            raise ValueError(f"samples of {sorted(bits)} bits in format {one(FORMAT, 1)}")
        self.unpack = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress}.get(packing)
        if self.unpack is None or one(PREDICTOR, 1) not in (1, 2):
            raise ValueError(f"compression {packing} with predictor {one(PREDICTOR, 1)}")
        self.dtype = np.dtype(f"{order}{kind}{min(bits) // 8}")
        self.apart, self.tiled, self.differences = one(PLANES, 1) == 2, TILE_AT in field, one(PREDICTOR, 1) == 2
        self.block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if self.tiled else (min(one(STRIP_ROWS, self.h), self.h), self.w)
        self.places = list(zip(*((field[TILE_AT], field[TILE_SIZE]) if self.tiled else (field[STRIP_AT], field[STRIP_SIZE])), strict=True))

    def _block(self, plane: int, down: int, across: int) -> np.ndarray:
        """One strip or tile, (bands, height, width) without what lies beyond the image."""
        rows, columns = self.block
        per_plane = -(-self.h // rows) * -(-self.w // columns)
        at, size = self.places[plane * per_plane + down * -(-self.w // columns) + across]
        each = 1 if self.apart else self.bands
        high = rows if self.tiled else min(rows, self.h - down * rows)
        out = np.frombuffer(self.unpack(self.read(at, size)), self.dtype, high * columns * each).reshape(high, columns, each)
        out = out.astype(self.dtype.newbyteorder("="))
        if self.differences:
            out = np.cumsum(out, axis=1, dtype=out.dtype)
        return out[: self.h - down * rows, : self.w - across * columns].transpose(2, 0, 1)

    def window(self, top: int, left: int, h: int, w: int) -> np.ndarray:
        """(bands, h, w) from a pixel on, as far as the image goes."""
        h, w = min(h, self.h - top), min(w, self.w - left)
        rows, columns = self.block
        out = np.zeros((self.bands, h, w), self.dtype.newbyteorder("="))
        for down in range(top // rows, -(-(top + h) // rows)):
            for across in range(left // columns, -(-(left + w) // columns)):
                for plane in range(self.bands if self.apart else 1):
                    part = self._block(plane, down, across)
                    y, x = down * rows - top, across * columns - left
                    low_y, low_x = max(0, -y), max(0, -x)
                    part = part[:, low_y : h - y, low_x : w - x]
                    bands = slice(plane, plane + 1) if self.apart else slice(None)
                    out[bands, y + low_y : y + low_y + part.shape[1], x + low_x : x + low_x + part.shape[2]] = part
        return out


def decoded(data: bytes) -> np.ndarray:
    """The raster of a file's first image: (bands, height, width)."""
    image = Raster(lambda at, size: data[at : at + size])
    return image.window(0, 0, image.h, image.w)


def samples(spark: SparkSession, records: DataFrame, root: str, glob: str = "*.tif") -> DataFrame:
    """(country, patch_id, h, w, bands, image, gt) of ``records`` (country, patch_id, window_a, window_b, label: paths).

    Files under ``root`` meet the records by their path. The windows, of which one
    may be a row or column larger, and the label are cut to their common size, and
    the bands of window b stand before those of a. Files stay packed until a
    patch's three are in one row; a record without one of them has no row here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    files = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.regexp_replace(r, "^file:/*", "/").alias("path")) for r in ("window_a", "window_b", "label")))
    wanted = records.select("country", "patch_id", F.explode(roles).alias("x")).select("country", "patch_id", "x.*").distinct()
    each = wanted.join(files, "path")
    content = lambda r: F.max(F.when(F.col("role") == r, F.col("content"))).alias(r)
    rows = each.groupBy("country", "patch_id").agg(content("window_a"), content("window_b"), content("label"))
    rows = rows.where("window_a is not null and window_b is not null and label is not null")
    schema = "country string, patch_id string, h int, w int, bands int, image array<float>, gt array<int>"

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, b, label = (decoded(batch.column(c)[r].as_py()) for c in ("window_a", "window_b", "label"))
                h, w = (min(x.shape[i] for x in (a, b, label)) for i in (1, 2))
                image = np.concatenate([b[:, :h, :w], a[:, :h, :w]]).astype(np.float32)
                row = [batch.column("country")[r].as_py(), batch.column("patch_id")[r].as_py(), h, w, len(image)]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
                arrays = [pa.array([v], t) for v, t in zip(row, kinds, strict=True)]
                arrays.append(pa.array([image.ravel()], pa.list_(pa.float32())))
                arrays.append(pa.array([label[0, :h, :w].ravel().astype(np.int32)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["country", "patch_id", "h", "w", "bands", "image", "gt"])

    rows = rows.select(F.col("country").cast("string"), F.col("patch_id").cast("string"), "window_a", "window_b", "label")
    return rows.mapInArrow(run, schema)
