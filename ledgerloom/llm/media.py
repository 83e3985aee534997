"""Media columns: TIFF files in a binary column, one row per page.

``tiff_pages`` walks the image directories of every file, classic or BigTIFF, decodes PackBits, LZW or deflate strips and
tiles, and undoes horizontal and floating-point predictors.  Samples are integers of 1, 2, 4, 8, 16, 32 or 64 bits or
floats of 16, 32 or 64; those under 8 bits come out as a byte each, others in this machine's byte order.  ``store_tiff``
writes raw sample bytes as a one-page greyscale file.  A file is read within one task and needs memory for one decoded
page; a strip or tile is never inflated beyond what its place in the page holds; nothing is shuffled.

Defined cases: a null file gives no page; an empty, truncated or foreign file gives one row with ``page`` null and
``error`` set; a directory loop ends the walk with the pages before it and a row with ``error``.  Repeated rows give
repeated pages; an empty table gives none.  A page of over ``LARGEST`` bytes gives a row with ``error``, as no binary
value can hold it; a text of any smaller length is stored whole.  Columns to keep are named by the caller; a kept name that is also a page column gets the suffix ``_in``.
"""

from __future__ import annotations

import struct as st
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import INT, LONG, STR, BIN, map_rows, struct

# Fixed values of the TIFF format: tags, compression codes and the sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
SHORTS = {BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR, SAMPLE_FORMAT}
#: Sample formats: unsigned, signed, float, undefined.
KINDS = {1: "u", 2: "i", 3: "f", 4: "u"}

#: Bytes of a decoded page, the most that a binary value holds.
LARGEST = (1 << 31) - 1

PAGE = struct(page=INT, width=INT, height=INT, samples=INT, bits=INT, compression=INT, predictor=INT, segments=INT, pixels=BIN, feature=STR, error=STR)


def unpack_bits(data: bytes, most: int = LARGEST) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
        else:
            while i + run < len(data) and run < 128 and (i + run + 1 >= len(data) or data[i + run] != data[i + run + 1]):
                run += 1
            out.append(run - 1)
            out += data[i : i + run]
        i += run
    return bytes(out)


def lzw_decode(data: bytes, most: int = LARGEST) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table and 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257 or len(out) >= most:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    table, width, word = {bytes((i,)): i for i in range(256)}, 9, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        codes.append((table[word], width))
        table[longer] = len(table) + 2
        word = data[i : i + 1]
        if len(table) + 2 >= 1 << width:
            width += 1
        if len(table) + 2 >= 4094:
            codes.append((256, min(width, 12)))
            table, width = {bytes((j,)): j for j in range(256)}, 9
    if word:
        codes.append((table[word], width))
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    codes.append((257, width))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def inflate(data: bytes, most: int) -> bytes:
    """At most so many bytes and one; the checksum is tested where the stream ends there."""
    stream = zlib.decompressobj()
    out = stream.decompress(data, most + 1)
    if not stream.eof and len(out) <= most:
        raise ValueError("deflate stream is cut off")
    return out


def _expand(data: bytes, how: int, most: int) -> bytes:
    if how == NONE:
        return data
    if how in (DEFLATE, OLD_DEFLATE):
        return inflate(data, most)
    if how == LZW:
        return lzw_decode(data, most)
    if how == PACKBITS:
        return unpack_bits(data, most)
    raise ValueError(f"compression {how} is not supported")


def _fields(data: bytes, order: str, at: int, big: bool) -> tuple[dict[int, tuple], int]:
    """The directory's fields and where the next one is."""
    head, word, room = ("Q", "Q", 8) if big else ("H", "I", 4)
    (count,) = st.unpack_from(order + head, data, at)
    at += st.calcsize("=" + head)
    size_of_entry = 4 + 2 * room
    if count * size_of_entry > len(data):
        raise ValueError("image directory does not fit the file")
    found = {}
    for i in range(count):
        place = at + size_of_entry * i
        tag, kind, n = st.unpack_from(f"{order}HH{word}", data, place)
        if kind in FIELD:
            letter, size = FIELD[kind]
            place += 4 + room
            if n * size > room:
                (place,) = st.unpack_from(order + word, data, place)
            if place + n * size > len(data):
                raise ValueError("field does not fit the file")
            found[tag] = st.unpack_from(f"{order}{n}{letter}", data, place)
    return found, st.unpack_from(order + word, data, at + size_of_entry * count)[0]


def _samples(data: bytes, rows: int, columns: int, n: int, bits: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """A decoded strip or tile as rows x columns x samples."""
    if bits < 8:
        width = -(-columns * n * bits // 8)
        cells = np.unpackbits(np.frombuffer(data[: rows * width], np.uint8).reshape(rows, width), axis=1)[:, : columns * n * bits].reshape(rows, columns, n, bits)
        return np.packbits(cells, axis=-1)[..., 0] >> (8 - bits)
    raw, native = data[: rows * columns * n * kind.itemsize], kind.newbyteorder("=")
    if predictor == 3:
        # differences of bytes, each row's first bytes of all samples before their second ones
        planes = np.frombuffer(raw, np.uint8).reshape(rows, kind.itemsize * columns, n)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, columns * n)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0].reshape(rows, columns, n).astype(native)
    out = np.frombuffer(raw, dtype=kind).reshape(rows, columns, n).astype(native)
    if predictor == 2:
        whole = out.view(f"u{kind.itemsize}")
        out = np.cumsum(whole, axis=1, dtype=whole.dtype).view(native)
    return out


def _pixels(data: bytes, order: str, tags: dict[int, tuple]) -> tuple[np.ndarray, int]:
    """The page as rows of sample values, and the number of strips or tiles."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, bits, how, n, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1), one(COMPRESSION, NONE), one(SAMPLES, 1), one(PREDICTOR, 1)
    form = KINDS.get(one(SAMPLE_FORMAT, 1), "?")
    fits = {"u": (1, 2, 4, 8, 16, 32, 64), "i": (8, 16, 32, 64), "f": (16, 32, 64)}.get(form, ())
    if bits not in fits or len(set(tags.get(BITS, ()))) > 1 or predictor not in ((1, 2, 3) if form == "f" else (1, 2) if bits >= 8 else (1,)):
        raise ValueError(f"{bits} bits of format {form} with predictor {predictor} are not supported")
    kind = np.dtype(f"{form}{max(1, bits // 8)}").newbyteorder(order)
    planes, n = (n, 1) if one(PLANAR, 1) == 2 else (1, n)
    tiled = TILE_OFFSETS in tags
    sw, sh = (one(TILE_WIDTH, w), one(TILE_HEIGHT, h)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    across, down = -(-w // sw) if w else 0, -(-h // sh) if h else 0
    if across * down * planes > min(len(offsets), len(counts)) or max(w * h * planes, sw * sh) * n * kind.itemsize > LARGEST:
        raise ValueError("image size does not fit its segments")
    page = np.zeros((planes, h, w, n), dtype=kind.newbyteorder("="))
    for i in range(across * down * planes):
        p, j = divmod(i, across * down)
        y, x = j // across * sh, j % across * sw
        rows = sh if tiled else min(sh, h - y)
        raw = _expand(data[offsets[i] : offsets[i] + counts[i]], how, rows * -(-sw * n * bits // 8))
        part = _samples(raw, rows, sw, n, bits, kind, predictor)[: h - y, : w - x]
        page[p, y : y + part.shape[0], x : x + part.shape[1]] = part
    return np.moveaxis(page, 0, 2).reshape(h, w, -1), across * down * planes


def _feature(a: np.ndarray) -> str:
    """Size, mean, spread and the three most frequent levels of a page; a level is the first eight bits of a sample."""
    if not a.size:
        return "0x0"
    first = np.ascontiguousarray(a).view(f"u{a.itemsize}").ravel() >> np.array(8 * (a.itemsize - 1), f"u{a.itemsize}")
    counts = np.bincount(first.astype(np.uint8), minlength=256)
    levels = np.arange(256)
    mean = float((counts * levels).sum() / a.size)
    spread = float(np.sqrt((counts * (levels - mean) ** 2).sum() / a.size))
    top = np.argsort(-counts, kind="stable")[:3]
    return f"{a.shape[1]}x{a.shape[0]};mean={mean:.4f};spread={spread:.4f};top={','.join(map(str, top))}"


def walk_pages(data: bytes) -> Iterator[tuple]:
    """Tuples of PAGE for each image directory."""
    bad = lambda why: (None,) * (len(PAGE) - 1) + (why,)
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        kind = st.unpack_from(order + "H", data, 2)[0] if order else 0
        big = kind == 43 and st.unpack_from(order + "HH", data, 4) == (8, 0)
        if kind != 42 and not big:
            raise ValueError("not a TIFF file")
        (at,) = st.unpack_from(order + "Q", data, 8) if big else st.unpack_from(order + "I", data, 4)
    except (ValueError, st.error) as e:
        yield bad(str(e))
        return
    seen: set[int] = set()
    while at:
        try:
            if at in seen:
                raise ValueError("image directories form a loop")
            seen.add(at)
            tags, following = _fields(data, order, at, big)
            page, segments = _pixels(data, order, tags)
        except (ValueError, KeyError, IndexError, st.error, zlib.error, OverflowError, ZeroDivisionError) as e:
            yield bad(f"{type(e).__name__}: {e}")
            return
        one = lambda tag, default: int(tags.get(tag, (default,))[0])  # noqa: B023, E731
        yield (len(seen) - 1, page.shape[1], page.shape[0], page.shape[2], one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), segments, page.tobytes(), _feature(page), None)
        at = following


def _differences(part: np.ndarray, predictor: int) -> np.ndarray:
    """What a predictor leaves of a strip or tile."""
    if predictor == 1:
        return part
    a = part.view(f"<u{part.itemsize}")
    if predictor == 3:
        rows, columns, n = part.shape
        planes = np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, columns * n, part.itemsize)
        a = np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(rows, part.itemsize * columns, n)
    return np.concatenate([a[:, :1], a[:, 1:] - a[:, :-1]], axis=1)


def encode_tiff(
    pages: Sequence[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 64, tile: tuple[int, int] | None = None, level: int = 3, big: bool = False
) -> bytes:
    """A little-endian file, BigTIFF if asked for, of pages of integers or floats, each rows x columns or rows x columns x samples; tile is (width, height)."""
    word, long, room = ("Q", 16, 8) if big else ("I", 4, 4)
    out = bytearray(st.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else st.pack("<2sHI", b"II", 42, 0))
    link = len(out) - room
    squeeze = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, level), LZW: lzw_encode, PACKBITS: pack_bits}[compression]
    for page in pages:
        a = page[:, :, None] if page.ndim == 2 else page
        a = a.astype(a.dtype.newbyteorder("<"), copy=False)
        h, w, n = a.shape
        offsets, counts = [], []
        sw, sh = tile or (w, rows_per_strip)
        for y in range(0, h, sh):
            for x in range(0, w, sw):
                part = a[y : y + sh, x : x + sw]
                if tile:
                    part = np.pad(part, ((0, sh - part.shape[0]), (0, sw - part.shape[1]), (0, 0)))
                data = squeeze(np.ascontiguousarray(_differences(np.ascontiguousarray(part), predictor)).tobytes())
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        where = ((TILE_WIDTH, [sw]), (TILE_HEIGHT, [sh]), (TILE_OFFSETS, offsets), (TILE_COUNTS, counts)) if tile else ((STRIP_OFFSETS, offsets), (ROWS_PER_STRIP, [sh]), (STRIP_COUNTS, counts))
        form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        fields = [(WIDTH, [w]), (HEIGHT, [h]), (BITS, [8 * a.itemsize] * n), (COMPRESSION, [compression]), (PHOTOMETRIC, [2 if n == 3 else 1]), (SAMPLES, [n]), (PLANAR, [1]), (PREDICTOR, [predictor]), *where]
        fields = sorted(fields + ([(SAMPLE_FORMAT, [form] * n)] if form > 1 else []))
        entries = bytearray()
        for tag, values in fields:
            letter, kind = ("H", 3) if tag in SHORTS else (word, long)
            packed = st.pack(f"<{len(values)}{letter}", *values)
            if len(packed) > room:
                out += b"\0" * (len(out) % 2)
                packed, beyond = st.pack("<" + word, len(out)), packed
                out += beyond
            entries += st.pack(f"<HH{word}", tag, kind, len(values)) + packed.ljust(room, b"\0")
        out += b"\0" * (len(out) % 2)
        out[link : link + room] = st.pack("<" + word, len(out))
        out += st.pack("<Q" if big else "<H", len(fields)) + entries
        link = len(out)
        out += bytes(room)
    return bytes(out)


def store_tiff(df: DataFrame, payload: str, keep: Sequence[str], width: int = 576) -> DataFrame:
    """Adds ``media``: the bytes of column ``payload``, a multiple of ``width``, as one greyscale page with predicted deflate strips."""

    def rows(it):
        for data, *kept in it:
            yield (*kept, None if data is None else encode_tiff([np.frombuffer(data, np.uint8).reshape(-1, width)], DEFLATE, 2))

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("media", BIN)])
    return map_rows(df.select(payload, *keep), rows, schema)


def tiff_pages(df: DataFrame, media: str, keep: Sequence[str]) -> DataFrame:
    """One row per page of every file in column ``media``: the kept columns, then those of PAGE."""
    names = [f"{c}_in" if c in PAGE.names else c for c in keep]

    def rows(it):
        for data, *kept in it:
            for page in walk_pages(bytes(data)) if data is not None else ():
                yield (*kept, *page)

    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for n, c in zip(names, keep, strict=True)] + PAGE.fields)
    return map_rows(df.select(media, *keep), rows, schema)


def op5_tiff(docs: DataFrame, unit: int = 576) -> DataFrame:
    """The digests of every text stored as a TIFF page and read back.  A null text counts as empty."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    n = F.length(text)
    pad = F.when(n == 0, unit).otherwise(F.pmod(-n, F.lit(unit))).cast("int")
    padded = F.concat(text, F.unhex(F.repeat(F.lit("FF"), pad)))
    stored = store_tiff(docs.select("doc_id", n.cast("long").alias("n_bytes"), padded.alias("payload")), "payload", ["doc_id", "n_bytes"], unit)
    pages = tiff_pages(stored.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)}), "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return pages.select(
        "doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -32, 32)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
