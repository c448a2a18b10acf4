"""TIFF in media columns: directories are walked, strips and tiles decoded, one row per page.

`pages(df, media)` is the operator: for every row of df it walks the image file
directories of the TIFF in a binary column, decodes PackBits, LZW or deflate strips
and tiles, undoes horizontal predictors and emits one row per page. Null or
malformed media give one row with page 0 and an error text, so no row is lost.

`store(df, text)` is the matching writer: texts become lossless multi-page TIFFs.

8-bit samples of any number a pixel are read, side by side and in either byte order; other
bit depths, separate planes and reversed bit order give an error row, and so do sizes that
the bytes present can't hold. Null and empty texts are stored as 576 bytes of 255. Repeated
rows are media of their own, equal texts equal ones; texts of any length are stored whole.
`digests` folds error rows too, with null in what there is no payload for. Columns beyond
those named in `keep` are not read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of_bytes

#: Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FILL_ORDER, PLANAR = 266, 284
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257
#: More samples than this for each byte of a file come out of no compression read here.
MOST_RATIO = 4096

SIDE = 24
BLOCK = SIDE * SIDE


def packbits_encode(raw: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(len(piece) - 1)
            out.extend(piece)

    for m in re.finditer(rb"(?s)(.)\1{2,127}", raw):
        literal(raw[at : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.append(m[0][0])
        at = m.end()
    literal(raw[at:])
    return bytes(out)


def packbits_decode(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += raw[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw_encode(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, the width grows one code early."""
    table = {bytes((i,)): i for i in range(256)}
    acc, bits, width, following, out, prefix = CLEAR, 9, 9, 258, bytearray(), b""
    for i in range(len(raw)):
        longer = prefix + raw[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        acc, bits = acc << width | table[prefix], bits + width
        table[longer] = following
        following += 1
        if following == 4095:
            acc, bits = acc << width | CLEAR, bits + width
            table, following, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif following + 1 > 1 << width:
            width += 1
        prefix = longer[-1:]
        if bits > 4096:
            keep = bits % 8
            out += (acc >> keep).to_bytes((bits - keep) // 8, "big")
            acc, bits = acc & (1 << keep) - 1, keep
    if prefix:
        acc, bits = acc << width | table[prefix], bits + width
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    acc, bits = acc << width | END, bits + width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) // 8, "big")


def lzw_decode(raw: bytes) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last, out = list(first), 9, b"", []
    acc = bits = 0
    for byte in raw:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if code == END:
            break
        if not last:
            last = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            last = entry
        out.append(last)
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


ENCODE = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 4)}


def inflate(raw: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(raw, max(most, 1))


DECODE = {NONE: lambda raw, _: raw, PACKBITS: lambda raw, _: packbits_decode(raw), LZW: lambda raw, _: lzw_decode(raw), DEFLATE: inflate, OLD_DEFLATE: inflate}


def write_tiff(images: list[dict]) -> bytes:
    """A little-endian TIFF of 8-bit grey pages. Each image: samples (2-d), compression, predictor, and rows_per_strip or tile (width, length)."""
    out, patch = bytearray(b"II*\0\0\0\0\0"), 4
    for image in images:
        a, compression, predictor = image["samples"], image["compression"], image.get("predictor", 1)
        height, width = a.shape
        if tile := image.get("tile"):
            tw, tl = tile
            padded = np.zeros((-(-height // tl) * tl, -(-width // tw) * tw), np.uint8)
            padded[:height, :width] = a
            parts = [padded[y : y + tl, x : x + tw] for y in range(0, padded.shape[0], tl) for x in range(0, padded.shape[1], tw)]
        else:
            rows = image["rows_per_strip"]
            parts = [a[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            # PackBits packs each row by itself.
            packed = b"".join(packbits_encode(row.tobytes()) for row in part) if compression == PACKBITS else ENCODE[compression](part.tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        tags = {WIDTH: [width], LENGTH: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tw], TILE_LENGTH: [tl], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows], STRIP_COUNTS: counts}
        entries = b""
        for tag, values in sorted(tags.items()):
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                where, _ = len(out), out.extend(packed)
                packed = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, 4, len(values)) + packed
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, patch, len(out))
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
        patch = len(out) - 4
    return bytes(out)


def read_tiff(raw: bytes) -> Iterator[dict]:
    """The pages of a TIFF of 8-bit samples, either byte order. Raises ValueError for what it can't read."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if not order:
        raise ValueError("not a TIFF")
    (at,), seen, number = struct.unpack_from(order + "I", raw, 4), set(), 0
    while at:
        if at in seen or at + 2 > len(raw):
            raise ValueError("broken chain of directories")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", raw, at)
        tags: dict[int, list[int]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            where = at + 10 + 12 * i
            if TYPE_SIZES.get(kind, 8) * count > 4:
                (where,) = struct.unpack_from(order + "I", raw, where)
            if letter := {1: "B", 3: "H", 4: "I"}.get(kind):
                tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", raw, where))
        width, height = tags[WIDTH][0], tags[LENGTH][0]
        spp, predictor, compression = tags.get(SAMPLES, [1])[0], tags.get(PREDICTOR, [1])[0], tags.get(COMPRESSION, [1])[0]
        if set(tags.get(BITS, [8])) != {8} or compression not in DECODE or predictor not in (1, 2):
            raise ValueError(f"page {number}: compression {compression}, predictor {predictor}, bits {tags.get(BITS)}")
        if tags.get(PLANAR, [1])[0] != 1 or tags.get(FILL_ORDER, [1])[0] != 1:
            raise ValueError(f"page {number}: planes {tags.get(PLANAR)}, fill order {tags.get(FILL_ORDER)}")
        tiled = TILE_OFFSETS in tags
        tw, tl = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (width, min(tags.get(ROWS_PER_STRIP, [height])[0], height))
        if min(width, height, spp, tw, tl) < 1 or max(width * height, tw * min(tl, height)) * spp > MOST_RATIO * len(raw):
            raise ValueError(f"page {number}: {width} x {height} in parts of {tw} x {tl}, {spp} samples a pixel, {len(raw)} bytes")
        samples, across = np.zeros((height, width, spp), np.uint8), -(-width // tw)
        parts = list(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True))
        if len(parts) != across * -(-height // tl) or max(tl, 1) * tw * spp > MOST_RATIO * len(raw):
            raise ValueError(f"page {number}: {len(parts)} parts of {tw} x {tl} for {width} x {height}")
        for k, (o, c) in enumerate(parts):
            y, x = k // across * tl, k % across * tw
            rows = tl if tiled else min(tl, height - y)
            part = np.frombuffer(DECODE[compression](raw[o : o + c], rows * tw * spp), np.uint8, rows * tw * spp).reshape(rows, tw, spp)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            samples[y : y + tl, x : x + tw] = part[: height - y, : width - x]
        yield {"page": number, "width": width, "height": height, "samples_per_pixel": spp, "compression": compression, "predictor": predictor, "tiled": tiled, "samples": samples.tobytes()}
        number += 1
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)


def text_to_tiff(text: bytes) -> bytes:
    """Text, filled up with bytes 255 to a multiple of 576, as pages of 24 samples' width: one LZW page, one PackBits page, the rest in deflate tiles."""
    padded = np.full(max(1, -(-len(text) // BLOCK)) * BLOCK, 255, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    a = padded.reshape(-1, SIDE)
    images = [{"samples": a[:SIDE], "compression": LZW, "predictor": 2, "rows_per_strip": 12}]
    if len(a) > SIDE:
        images.append({"samples": a[SIDE : 2 * SIDE], "compression": PACKBITS, "rows_per_strip": SIDE})
    if len(a) > 2 * SIDE:
        images.append({"samples": a[2 * SIDE :], "compression": DEFLATE, "tile": (32, min(1024, -(-(len(a) - 2 * SIDE) // 16) * 16))})
    return write_tiff(images)


def _fresh(df: DataFrame, *names: str) -> None:
    if clash := set(names) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts as TIFFs: the columns `keep`, n_bytes (UTF-8, null: 0) and media. Other columns are dropped, so clashing names do no harm."""
    source = df.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*source.select(*keep).schema, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, "_text"):
            raws = [(x or "").encode() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array([len(x) for x in raws], pa.int64()), pa.array([text_to_tiff(x) for x in raws], pa.binary())], names=schema.names)

    return source.mapInArrow(encode, schema)


PAGE = T.StructType([T.StructField(n, t) for n, t in (("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("page", T.IntegerType()), ("n_pages", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("samples_per_pixel", T.IntegerType()), ("compression", T.IntegerType()), ("predictor", T.IntegerType()), ("tiled", T.BooleanType()), ("samples", T.BinaryType()), ("error", T.StringType()))])


def pages(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """One row per page of the TIFF in column `media`; see the module's text for null and broken media. Pages of a file follow each other in order."""
    _fresh(df.select(*keep), *PAGE.names)
    source = df.select(*keep, F.col(media).alias("_media"))
    schema = T.StructType([*source.select(*keep).schema, *PAGE])
    types = [pa.int64(), pa.string(), *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, "_media"):
            index, rows = [], []
            for i, raw in enumerate(batch.column(len(keep)).to_pylist()):
                head = {"media_bytes": len(raw), "media_sha256": hashlib.sha256(raw).hexdigest()} if raw is not None else {}
                try:
                    found = list(read_tiff(raw or b""))
                    rows += [head | p | {"n_pages": len(found)} for p in found]
                    index += [i] * len(found)
                except (ValueError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                    rows.append(head | {"page": 0, "n_pages": 0, "error": str(e) or type(e).__name__})
                    index.append(i)
            kept = batch.take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[kept.column(i) for i in range(len(keep))], *[pa.array([r.get(n) for r in rows], t) for n, t in zip(PAGE.names, types, strict=True)]], names=schema.names)

    return source.mapInArrow(decode, schema)


def digests(paged: DataFrame) -> DataFrame:
    """Folds the pages of each file, which follow each other within a partition, into one row of digests.

    feature: number of pages, mean sample, and an average hash of the samples' 64 equal stretches.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    source = paged.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "n_pages", "samples")

    def row(head: dict, parts: list[bytes]) -> dict:
        if not head["n_pages"]:  # null or broken media
            return {n: head[n] for n in ("doc_id", "n_bytes", "media_bytes", "media_sha256")}
        payload = b"".join(parts)
        means = np.add.reduceat(np.frombuffer(payload, np.uint8), np.arange(64) * len(payload) // 64, dtype=np.int64) / max(1, len(payload) / 64)
        bits = int("".join("1" if m > means.mean() else "0" for m in means), 2)
        return {"doc_id": head["doc_id"], "n_bytes": head["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": head["media_bytes"], "media_sha256": head["media_sha256"], "feature": f"{head['n_pages']}:{means.mean():.3f}:{bits:016x}"}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        target = pa.schema([(n, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                parts.append(r["samples"])
                if r["page"] + 1 >= r["n_pages"]:
                    done.append(row(r, parts))
                    parts = []
            yield pa.RecordBatch.from_pylist(done, schema=target)

    return source.mapInArrow(fold, schema)


def op1_tiff(spark, sf_dir: str) -> DataFrame:
    from .common import load

    return digests(pages(store(load(spark, sf_dir, "documents"))))
