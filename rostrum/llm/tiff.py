"""TIFF columns: image directories are walked, strips or tiles decoded (none, PackBits, LZW, deflate), predictors undone, and
each page gives one row.

Pages have 1, 2, 4, 8 or 16 bits a sample, alike in all channels, chunky or planar; pixels are one byte a sample, of 16 bits two, low
byte first. What a file's header claims is held against its size before anything is allocated. The writer stores bytes as greyscale pages of 64 columns, deflated with the
horizontal predictor, so that any payload can be kept losslessly as an image and read back.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

# Fixed values of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_SIZE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
LZW_CLEAR, LZW_END, LZW_MOST_BITS = 256, 257, 12

COLUMNS = 64
ROWS_PER_STRIP = 1024
PAGE = "struct<page: int, width: int, height: int, channels: int, bits: int, compression: int, predictor: int, pixels: binary, feature: string>"


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """PackBits: a head below 128 brings so many literals and one, above 128 the next byte 257 - head times; 128 is skipped."""
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more as runs, the rest as literals."""
    out, at, plain = bytearray(), 0, 0

    def literals(end):
        for k in range(plain, end, 128):
            part = data[k : min(k + 128, end)]
            out.extend([len(part) - 1, *part])

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            literals(at)
            out.extend([257 - run, data[at]])
            plain = at + run
        at += run
    literals(len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, high bits first, that widen one code early; not much beyond so many bytes."""
    out, table, width, size = [], [], 9, 0
    pool = bits = 0
    last: bytes | None = None
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        pool, bits = (pool << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = pool >> bits & ((1 << width) - 1)
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            table = table or list(first)
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < LZW_MOST_BITS:
                width += 1
        out.append(entry)
        last, size = entry, size + len(entry)
        if most is not None and size >= most:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, pool, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code):
        nonlocal pool, bits
        pool, bits = pool << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(pool >> bits & 255)
        pool &= (1 << bits) - 1

    put(LZW_CLEAR)
    at, n = 0, 258
    while at < len(data):
        end = at + 1
        code = data[at]
        while end < len(data) and (longer := table.get(data[at : end + 1])) is not None:
            code, end = longer, end + 1
        put(code)
        if end < len(data):
            table[data[at : end + 1]] = n
            n += 1
            if n >= (1 << width) and width < LZW_MOST_BITS:
                width += 1
            if n >= (1 << LZW_MOST_BITS) - 2:
                put(LZW_CLEAR)
                table, n, width = {}, 258, 9
        at = end
    put(LZW_END)
    if bits:
        out.append(pool << (8 - bits) & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    """What is deflated in data, so many bytes at most; an error if that isn't all there."""
    stream = zlib.decompressobj()
    out = stream.decompress(data, max(1, most))
    if len(out) < most and not stream.eof:
        raise ValueError("deflated data ends early")
    return out


DECODERS = {NONE: lambda data, most: data[:most], LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
#: Bytes that one byte of stored data can stand for, at most.
GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 128}
DEPTHS = (1, 2, 4, 8, 16)
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: pack_bits}


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """The entries of the image directory at this place, by tag, and the place of the next one."""
    (count,) = struct.unpack_from(order + "H", data, at)
    entries = {}
    for k in range(count):
        tag, kind, n, raw = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * k)
        if kind in TYPES:
            form = f"{order}{n}{TYPES[kind]}"
            size = struct.calcsize(form)
            place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", raw)[0]
            entries[tag] = struct.unpack_from(form, data, place)
    return entries, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def undo(block: bytes, rows: int, columns: int, channels: int, predictor: int, bits: int = 8, order: str = "<") -> np.ndarray:
    """A decoded strip or tile as rows of samples; each row begins a byte. Predictor 2 holds differences from the sample of the pixel
    to the left. What is missing at the end is zero."""
    if predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise ValueError(f"predictor {predictor} at {bits} bits")
    width = -(-columns * channels * bits // 8)
    raw = np.frombuffer(block[: rows * width].ljust(rows * width, b"\0"), dtype=np.uint8).reshape(rows, width)
    if bits == 16:
        samples = raw.view(f"{order}u2").astype(np.uint16)
    elif bits < 8:
        single = np.unpackbits(raw, axis=1)[:, : columns * channels * bits].reshape(rows, -1, bits)
        samples = (single << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    else:
        samples = raw
    samples = samples.reshape(rows, columns, channels)
    return np.cumsum(samples, axis=1, dtype=samples.dtype) if predictor == 2 else samples


def decode(data: bytes) -> list[dict]:
    """The file's pages: width, height, channels, compression, predictor and samples, row by row."""
    return list(decoded(data))


def decoded(data: bytes) -> Iterator[dict]:
    """The pages of decode(), one by one: those before a bad one come before its error."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise ValueError(f"version {magic}")
    seen, spent = set(), 0.0
    while at and at not in seen:  # a loop of directories ends
        seen.add(at)
        tags, at = directory(data, at, order)
        one = lambda tag, default: tags.get(tag, (default,))[0]  # noqa: B023, E731
        width, height, channels = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2
        depths = set(tags.get(BITS, (1,)))
        bits = min(depths)
        if len(depths) > 1 or bits not in DEPTHS:
            raise ValueError(f"bits a sample {sorted(depths)}")
        if compression not in DECODERS:
            raise ValueError(f"compression {compression}")
        tiled = TILE_AT in tags
        columns, rows = (one(TILE_W, width), one(TILE_H, height)) if tiled else (width, min(height, one(STRIP_ROWS, height)))
        if min(width, height, channels, columns, rows) < 1:
            raise ValueError(f"size {width} x {height} x {channels} in parts of {columns} x {rows}")
        places, sizes = (tags[TILE_AT], tags[TILE_SIZE]) if tiled else (tags[STRIP_AT], tags[STRIP_SIZE])
        across, down = -(-width // columns), -(-height // rows)
        planes = channels if planar else 1
        here = 1 if planar else channels
        part_bytes = rows * -(-columns * here * bits // 8)
        # in bytes of samples, an image of what these parts can stand for, or a part of one, is no larger than this
        if max(height * width * channels * bits // 8, part_bytes) > len(data) * GROWTH[compression] + 64:
            raise ValueError(f"size {width} x {height} x {channels} is beyond the data")
        spent += height * -(-width * channels * bits // 8) / GROWTH[compression]
        if spent > len(data) + 64:  # pages that share parts; of parts of their own all pages together are no larger
            raise ValueError(f"the sum of pages, {len(seen)} so far, is beyond the data")
        if min(len(places), len(sizes)) < across * down * planes:
            raise ValueError(f"{min(len(places), len(sizes))} of {across * down * planes} parts")
        image = np.zeros((height, width, channels), dtype=np.uint16 if bits == 16 else np.uint8)
        for k, (place, size) in enumerate(zip(places[: across * down * planes], sizes, strict=False)):
            plane, cell = divmod(k, across * down)
            y, x = cell // across * rows, cell % across * columns
            tall = rows if tiled else min(rows, height - y)
            need = tall * -(-columns * here * bits // 8)
            block = undo(DECODERS[compression](data[place : place + size], need), tall, columns, here, predictor, bits, order)
            into = image[y : y + tall, x : x + columns, plane : plane + 1] if planar else image[y : y + tall, x : x + columns]
            into[:] = block[: into.shape[0], : into.shape[1]]
        pixels = image.astype("<u2").tobytes() if bits == 16 else image.tobytes()
        yield {"width": width, "height": height, "channels": channels, "bits": bits, "compression": compression, "predictor": predictor, "pixels": pixels}


def encode(pages: list[tuple[bytes, int, int]], compression: int = DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, rows_per_strip: int = ROWS_PER_STRIP, order: str = "<") -> bytes:
    """A file of these pages (samples, columns, channels), in strips or in tiles (columns, rows)."""
    out, links = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), [4]
    for samples, columns, channels in pages:
        height = len(samples) // (columns * channels)
        image = np.frombuffer(samples, dtype=np.uint8).reshape(height, columns, channels)
        wide, tall = tile or (columns, min(rows_per_strip, max(1, height)))
        places, sizes = [], []
        for y in range(0, height, tall):
            for x in range(0, columns, wide):
                block = image[y : y + tall, x : x + wide]
                if tile:
                    block = np.pad(block, ((0, tall - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                data = ENCODERS[compression](block.tobytes())
                places.append(len(out))
                sizes.append(len(data))
                out += data
        fields = [(WIDTH, "I", [columns]), (HEIGHT, "I", [height]), (BITS, "H", [8] * channels), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [1 if channels == 1 else 2]), (SAMPLES, "H", [channels]), (PREDICTOR, "H", [predictor])]
        fields += [(TILE_W, "I", [wide]), (TILE_H, "I", [tall]), (TILE_AT, "I", places), (TILE_SIZE, "I", sizes)] if tile else [(STRIP_AT, "I", places), (STRIP_ROWS, "I", [tall]), (STRIP_SIZE, "I", sizes)]
        entries = b""
        for tag, form, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{form}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, place = struct.pack(order + "I", len(out)), raw
                out += place
            entries += struct.pack(order + "HHI", tag, 3 if form == "H" else 4, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, links[-1], len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        links.append(len(out))
        out += bytes(4)
    return bytes(out)


def feature(page: dict) -> str:
    """What is computed from a page's samples: size, least, greatest and mean sample, and the share of left-right changes."""
    samples = np.frombuffer(page["pixels"], dtype="<u2" if page["bits"] == 16 else np.uint8)
    lines = samples.reshape(page["height"], -1)
    changes = int((lines[:, 1:] != lines[:, :-1]).sum())
    return f"{page['width']}x{page['height']} min={samples.min()} max={samples.max()} mean={int(samples.sum(dtype=np.int64)) * 1000 // len(samples)}m changes={changes}"


def stored_texts(text="text"):
    """A struct column: n_bytes of a text as UTF-8 (null: empty) and media, its bytes with zeros up to a multiple of 64 as a TIFF."""

    def make():
        def store(text):
            data = (text or "").encode("utf-8", "replace")
            payload = data.ljust(max(COLUMNS, -(-len(data) // COLUMNS) * COLUMNS), b"\0")
            return len(data), encode([(payload, COLUMNS, 1)])

        return lambda texts: list(zip(*map(store, texts), strict=True))

    return text_column(make, "n_bytes long, media binary")(text)


def pages(media="media"):
    """A struct column with pages, an array of PAGE, and error: what a column of TIFF files holds. A file that can't be read
    says why in error and has the pages before the bad one; null has neither."""

    def make():
        def walk(data):
            if data is None:
                return [], None
            found, error = [], None
            try:
                for page in decoded(data):
                    found.append(page)
            except (KeyError, ValueError, TypeError, ArithmeticError, IndexError, MemoryError, struct.error, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
            return [{"page": k, **p, "feature": feature(p)} for k, p in enumerate(found)], error

        return lambda files: list(zip(*map(walk, files), strict=True))

    return text_column(make, f"pages array<{PAGE}>, error string")(media)


def page_rows(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each page of each file: df's other columns, p, a PAGE, and error, what of the file couldn't be read (p_ and error_
    where df has such columns). A file without pages, a null one too, has a row whose p is null."""
    others = [c for c in df.columns if c != media]
    taken = {c.lower() for c in others}
    p, error = (f"{n}_" if n in taken else n for n in ("p", "error"))
    return df.withColumn(media, pages(df[media])).select(*others, F.col(f"{media}.error").alias(error), F.explode_outer(F.col(f"{media}.pages")).alias(p))


def media_report(docs: DataFrame) -> DataFrame:
    """Texts as stored in images and read back: sizes and digests for every row of docs, which is one page each.

    Null and empty texts give a payload of 64 zeros; equal texts and repeated rows give equal values; a very long text is one page,
    held whole by one task; an empty table gives no rows; other columns are left out.
    """
    kept = docs.select("doc_id", stored_texts(docs["text"]).alias("m")).select("doc_id", "m.n_bytes", F.length("m.media").cast("long").alias("media_bytes"), F.sha2("m.media", 256).alias("media_sha256"), F.col("m.media").alias("media"))
    read = page_rows(kept)
    payload = F.col("p.pixels")
    return read.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.col("p.feature").alias("feature"),
    )
