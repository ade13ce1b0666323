"""Media columns: Netpbm and BMP to numpy arrays, area-resized tiles, and difference hashes."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import saved, ship, trimmed

_BLANK = b" \t\n\r\x0b\x0c"


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The decimal fields behind the magic of a Netpbm file, comments skipped, and where they end."""
    out, at = [], 2
    while len(out) < fields:
        while at < len(data) and (data[at] in _BLANK or data[at] == 35):
            if data[at] == 35:
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at:
            raise ValueError("Netpbm header is cut short")
        out.append(int(data[start:at]))
    return out, at


def _arbitrary_header(data: bytes) -> tuple[list[int], int]:
    """Width, height, maximum and channels of a P7 file, and where its header ends."""
    end = data.find(b"\nENDHDR")
    if end < 0:
        raise ValueError("Netpbm header is cut short")
    lines = [x.split() for x in data[2:end].split(b"\n") if not x.lstrip().startswith(b"#")]
    said = {x[0]: x[1] for x in lines if len(x) == 2}
    try:
        return [int(said[k]) for k in (b"WIDTH", b"HEIGHT", b"MAXVAL", b"DEPTH")], data.find(b"\n", end + 1)
    except KeyError as e:
        raise ValueError("Netpbm header is cut short") from e


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P7 as an array (height, width, channels) of uint8, or of uint16 where the maximum is above 255.

    Samples are scaled from the file's maximum to the type's; one above the maximum is an error.
    """
    kind = data[1] - 48 if data[:1] == b"P" and len(data) > 2 else 0
    if not 1 <= kind <= 7:
        raise ValueError("not a Netpbm file")
    bitmap, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    if kind == 7:
        (width, height, top, channels), at = _arbitrary_header(data)
    else:
        fields, at = _header(data, 2 if bitmap else 3)
        width, height, top = fields[0], fields[1], 1 if bitmap else fields[2]
    if width <= 0 or height <= 0 or channels <= 0 or not 1 <= top <= 65535:
        raise ValueError("bad size or maximum")
    count = width * height * channels
    if kind <= 3:
        body = b"\n".join(line.split(b"#", 1)[0] for line in data[at:].split(b"\n"))
        if kind == 1:
            flat = np.frombuffer(bytes(c for c in body if c in b"01"), np.uint8)[:count] - 48
        else:
            try:
                flat = np.array(body.split()[:count], dtype=np.int64)
            except OverflowError as e:
                raise ValueError("a sample is above the maximum") from e
    else:
        body = memoryview(data)[at + 1 :]
        if kind == 4:
            row = (width + 7) // 8
            bits = np.unpackbits(np.frombuffer(body[: row * height], np.uint8).reshape(-1, row), axis=1)
            flat = bits[:, :width].reshape(-1)
        else:
            unit = np.dtype(np.uint8) if top < 256 else np.dtype(">u2")
            flat = np.frombuffer(body[: count * unit.itemsize], unit)
    if flat.size < count:
        raise ValueError("samples are cut short")
    full = 255 if top < 256 else 65535
    if bitmap:
        flat = (1 - flat) * 255
    elif (kind <= 3 or top != full) and (flat.min() < 0 or flat.max() > top):
        raise ValueError("a sample is above the maximum")
    elif top != full:
        flat = (flat.astype(np.int64) * (2 * full) + top) // (2 * top)
    return flat.astype(np.uint8 if top < 256 else np.uint16).reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits as (height, width, channels) of uint8; masks for
    16 and 32 bits are followed, and what they leave out is dropped."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    word = lambda at, n=4, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, head, width, height = word(10), word(14), word(18, 4, True), word(22, 4, True)
    bits, packing, used = word(28, 2), word(30), word(46)
    if head < 40 or packing not in (0, 3) or width <= 0 or not height or bits not in (1, 4, 8, 16, 24, 32):
        raise ValueError("unsupported BMP")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    raw = np.frombuffer(memoryview(data)[start : start + stride * rows], np.uint8)
    if raw.size < stride * rows:
        raise ValueError("samples are cut short")
    raw = raw.reshape(rows, stride)[:: -1 if height > 0 else 1]
    if packing == 3 and bits not in (16, 32):
        raise ValueError("unsupported BMP")
    if bits == 24 or bits == 32 and packing == 0:
        pixels = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)
        return np.ascontiguousarray(pixels[:, :, [2, 1, 0]])
    if bits in (16, 32):
        # five bits a colour, or what the masks after the first 40 bytes of the header say
        masks = [word(at) for at in (54, 58, 62)] if packing == 3 else [0x7C00, 0x3E0, 0x1F]
        if not all(0 < mask < 1 << bits for mask in masks):
            raise ValueError("unsupported BMP")
        values = np.ascontiguousarray(raw[:, : bits // 8 * width]).view(f"<u{bits // 8}").astype(np.int64)
        lows = [mask & -mask for mask in masks]
        tops = [mask // low for mask, low in zip(masks, lows, strict=True)]
        parts = [((values & m) // low * 510 + top) // (2 * top) for m, low, top in zip(masks, lows, tops, strict=True)]
        return np.stack(parts, axis=2).astype(np.uint8)
    index = raw[:, :width]
    if bits < 8:
        parts = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)[:, :width]
        index = (parts * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)
    entries = used or 1 << bits
    palette = np.frombuffer(data[14 + head : 14 + head + 4 * entries], np.uint8).reshape(-1, 4)[:, [2, 1, 0]]
    if index.max(initial=0) >= len(palette):
        raise ValueError("palette is cut short")
    colours = palette[index]
    grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return np.ascontiguousarray(colours[:, :, :1] if grey else colours)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    """Rows of 8-bit samples as a binary grey map."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Rows of 8-bit samples as a grey BMP, bottom row first."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    put = lambda v, n: int(v).to_bytes(n, "little")
    head = put(40, 4) + put(width, 4) + put(height, 4) + put(1, 2) + put(8, 2) + put(0, 4)
    head += put(body.size, 4) + put(2835, 4) * 2 + put(256, 4) + put(0, 4)
    return b"BM" + put(1078 + body.size, 4) + put(0, 4) + put(1078, 4) + head + palette.tobytes() + body.tobytes()


def area_resize(image: np.ndarray, height: int, width: int, block: int = 4096) -> np.ndarray:
    """Mean of every output cell's area, fractional edges included, by an integral image.

    The integral is needed only at the cells' edges: rows are summed up to each vertical edge
    (interpolated linearly, as samples are constant over their square), then down to each
    horizontal edge.  Rows are read in blocks, so memory beside the image is bounded.
    """
    rows, cols, channels = image.shape
    xs = np.linspace(0, cols, width + 1)
    ys = np.linspace(0, rows, height + 1)
    left = np.minimum(xs.astype(np.int64), cols - 1)
    top = np.minimum(ys.astype(np.int64), rows - 1)
    at_edges = np.zeros((height + 1, width + 1, channels))
    total = np.zeros((width + 1, channels))
    for start in range(0, rows, block):
        part = image[start : start + block].astype(np.float64)
        along = np.zeros((len(part), cols + 1, channels))
        np.cumsum(part, axis=1, out=along[:, 1:])
        edge = along[:, left] + (xs - left)[None, :, None] * part[:, left]
        down = np.concatenate([total[None], total + np.cumsum(edge, axis=0)])
        here = (top >= start) & (top < start + len(part))
        local = top[here] - start
        at_edges[here] = down[local] + (ys[here] - top[here])[:, None, None] * edge[local]
        total = down[-1]
    sums = np.diff(np.diff(at_edges, axis=0), axis=1)
    return sums / ((rows / height) * (cols / width))


def tile(image: np.ndarray, side: int) -> bytes:
    """The area-resized image as a NPY file of uint8."""
    scale = 257 if image.dtype == np.uint16 else 1
    small = np.clip(np.rint(area_resize(image, side, side) / scale), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.lib.format.write_array(out, small, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """64 bits in hexadecimal: is each of 8 x 9 area means less than its right neighbour?"""
    small = area_resize(image, side, side + 1).mean(axis=2)
    # Means that are equal but for rounding count as equal.
    bits = (small[:, 1:] - small[:, :-1]) > 1e-6
    return np.packbits(bits.reshape(-1)).tobytes().hex()


_MEDIA = {"height": pa.int32(), "width": pa.int32(), "channels": pa.int32(), "tile": pa.binary(), "dhash": pa.string(), "error": pa.string()}
#: What ``media_columns`` adds with ``samples``: of the decoded samples, of the file and of the tile.
_SAMPLES = {
    "payload_bytes": pa.int64(),
    "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(),
    "media_sha256": pa.string(),
    "tile_sha256": pa.string(),
    "tile_sum": pa.int64(),
}
MEDIA_DDL = "height int, width int, channels int, tile binary, dhash string, error string"
SAMPLES_DDL = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, tile_sha256 string, tile_sum bigint"


def media_features(media: bytes | None, side: int = 32, samples: bool = False) -> tuple:
    """Size, NPY tile and difference hash of one file, or the reason why it has none."""
    none = (None,) * len(_SAMPLES) if samples else ()
    if media is None:
        return None, None, None, None, None, "no media", *none
    try:
        image = decode(media)
    except (ValueError, OverflowError) as e:
        return None, None, None, None, None, str(e), *none
    small = tile(image, side)
    if samples:
        read = image.tobytes()
        # a NPY file of version 1: ten bytes, a header of the length that the last two state, the samples
        back = np.frombuffer(small, np.uint8, offset=10 + int.from_bytes(small[8:10], "little"))
        digest = lambda x: hashlib.sha256(x).hexdigest()
        none = (len(read), digest(read), zlib.crc32(read[-64:]), len(media), digest(media), digest(small), int(back.sum(dtype=np.int64)))
    return *image.shape, small, difference_hash(image), None, *none


def media_columns(rows: DataFrame, column: str = "media", id_column: str = "doc_id", side: int = 32, *, samples: bool = False) -> DataFrame:
    """Decode a binary column of Netpbm or BMP files: id, height, width, channels, tile (NPY), dhash, error.

    ``samples`` adds digests of the decoded samples, of the file and of the tile, which is read
    back.  A null or undecodable file gives null features and its reason in ``error``; repeated rows
    repeat, an empty table gives an empty result, other columns are ignored.  Each file is
    decoded by itself, so memory follows the largest file, not the table.
    """
    ship(rows.sparkSession)
    kind = rows.schema[id_column].dataType.simpleString()
    added = _MEDIA | (_SAMPLES if samples else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keystrata.llm.media import media_features

        for batch in batches:
            made = [media_features(x.as_py(), side, samples) for x in batch.column(1)]
            columns = zip(*made, strict=True) if made else [[] for _ in added]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, added.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_column, *added])

    return rows.select(id_column, column).mapInArrow(trimmed(run), f"{id_column} {kind}, {MEDIA_DDL}" + (f", {SAMPLES_DDL}" if samples else ""))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, zeros appended up to a positive multiple of 64, and the length without them."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data)), len(data)


def store_media(docs: DataFrame, width: int = 64) -> DataFrame:
    """Store every whole text as an image of ``width`` columns, in a table (id, media) of the shared folder.

    The payload's bytes are the samples: of a grey map (P5), or of a BMP where its checksum is
    odd, so that equal texts have equal files.  The id is a struct (doc_id, n_bytes).  Null text
    is empty: 64 zero samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from keystrata.llm.media import encode_bmp, encode_pgm, payload_of

        for batch in batches:
            sizes, files = [], []
            for text in batch.column(1):
                payload, n_bytes = payload_of(text.as_py())
                encode = encode_bmp if zlib.crc32(payload) & 1 else encode_pgm
                sizes.append(n_bytes)
                files.append(encode(np.frombuffer(payload, np.uint8).reshape(-1, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(trimmed(run), "doc_id bigint, n_bytes bigint, media binary")
    return saved(rows.select(F.struct("doc_id", "n_bytes").alias("id"), "media"), "media")


def text_as_media(docs: DataFrame, width: int = 64) -> DataFrame:
    """Store every whole text as an image (``store_media``), read the files back and describe them.

    Digests, checksum, difference hash and tile come from the stored files, decoded by
    ``media_columns``.  Repeated rows repeat, equal texts have equal values, other columns are
    ignored, and an empty table gives an empty result.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (the difference hash), tile (NPY), tile_sha256 and tile_sum (of the tile read back).
    """
    made = media_columns(store_media(docs, width), id_column="id", samples=True)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return made.select("id.doc_id", "id.n_bytes", *names, F.col("dhash").alias("feature"), "tile", "tile_sha256", "tile_sum")
