"""Media columns: bytes kept as GIF, and GIF decoded to timed frames with colour histograms.

``store_gif``   text or binary column -> a binary GIF column. Samples are palette indexes of a grey ramp, so storage is lossless.
``decode_gif``  binary GIF column -> index planes as stored, and frames as displayed after palettes, interlacing, transparency
                and disposal: place, delay, digest of the canvas and its colour histogram.

Both run as Arrow maps: no shuffle, and memory holds one document (and its frames) at a time.

Defined cases: a null payload counts as empty; an empty payload is stored as one block of 255s; equal bytes give equal
media; bytes that are no GIF decode to zero frames with ``error`` set; a stream that ends early keeps the frames and
samples it has, the rest being index 0. Extra columns pass through by name unless they clash with the operator's own
output names, in which case the operator's column wins.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, table

WIDTH = 576
BLOCK = 576  # payloads are padded to a positive multiple of this
ROWS_PER_FRAME = 96
DELAY_CS = 4
BINS = 16
#: Samples of the largest screen or frame that is drawn: some bytes can claim four billion. A canvas takes four bytes for each.
MOST_PIXELS = 1 << 26

# ---- LZW -------------------------------------------------------------------------------------------------------------


def lzw_codes(data: bytes, literal_bits: int = 8) -> list[int]:
    """Greedy LZW codes of data, with clear codes whenever the table of 4096 is full, and the end code."""
    clear = 1 << literal_bits
    codes = [clear]
    if not data:
        return [clear, clear + 1]
    emit = codes.append
    table: dict[int, int] = {}  # what is held and the next sample, as one number -> the code that stands for both, in the same form
    free, held = clear + 2, data[0] << 8
    for byte in data[1:]:
        key = held + byte
        if key in table:
            held = table[key]
            continue
        emit(held >> 8)
        table[key] = free << 8
        free += 1
        held = byte << 8
        if free == 4096:
            emit(clear)
            table.clear()
            free = clear + 2
    emit(held >> 8)
    emit(clear + 1)
    return codes


@lru_cache
def code_widths(n: int, literal_bits: int) -> np.ndarray:
    """Bits of the codes number 0..n-1 after a clear code, as a reader of the stream sees them."""
    free = (1 << literal_bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.floor(np.log2(free)).astype(np.int64) + 1, 12)


def pack_codes(codes: list[int], literal_bits: int = 8) -> bytes:
    """Codes as a little-endian bit stream of growing width."""
    c = np.asarray(codes, np.int64)
    at = np.arange(len(c))
    cleared = np.maximum.accumulate(np.where(c == 1 << literal_bits, at, 0))
    nth = at - np.where(at == cleared, np.concatenate(([0], cleared[:-1])), cleared) - 1  # a clear code ends the run before it
    widths = code_widths(4100, literal_bits)[np.clip(nth, 0, 4099)]
    widths[0] = literal_bits + 1
    ends = np.cumsum(widths)
    begin = ends - widths
    word = c << (begin & 7)
    size = int(ends[-1] + 7) // 8
    out = np.zeros(size + 3, np.uint8)
    for k in range(3):  # codes have 9 bits or more (literals of 8), or else may start in the same byte
        if literal_bits >= 8:
            out[(begin >> 3) + k] |= ((word >> (8 * k)) & 255).astype(np.uint8)
        else:
            np.bitwise_or.at(out, (begin >> 3) + k, ((word >> (8 * k)) & 255).astype(np.uint8))
    return out[:size].tobytes()


@lru_cache
def code_offsets(literal_bits: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(code_widths(4096, literal_bits))))


def expanded(codes: np.ndarray, literal_bits: int, room: int) -> tuple[bytes, bool]:
    """Samples of the codes between two clear codes, about ``room`` of them at most, and whether all codes were possible.

    The n-th entry of the table is what the n-th code stood for and one sample more, which lies right behind it in the output.
    So a code that names an entry is a reference to an earlier place of the output; lengths, then places, are followed
    to literals by doubling: a step goes twice as far as the one before, over all codes at once.
    """
    clear = 1 << literal_bits
    entry, number = codes.astype(np.int64) - clear - 2, np.arange(len(codes))
    literal = codes < clear
    wrong = np.flatnonzero(~literal & (entry >= number))  # the newest entry may be the code's own; the first code must be a literal
    n = int(wrong[0]) if len(wrong) else len(codes)
    if not n:
        return b"", not len(wrong)
    codes, literal, number = codes[:n], literal[:n], number[:n]
    to = np.where(literal, number, entry[:n])
    length = np.where(literal, 0, 1)
    link = to
    while not np.array_equal(further := link[link], link):
        length, link = length + length[link], further
    ends = np.cumsum(length + 1)
    if ends[-1] > room:
        n = int(np.searchsorted(ends, room)) + 1
        codes, literal, to, ends, length, wrong = codes[:n], literal[:n], to[:n], ends[:n], length[:n], wrong[:0]
    starts = ends - length - 1
    place = np.arange(int(ends[-1])) - np.repeat(starts - starts[to], length + 1)
    while not np.array_equal(further := place[place], place):
        place = further
    samples = np.zeros(len(place), np.uint8)
    samples[starts[literal]] = codes[literal]
    return samples[place].tobytes(), not len(wrong)


def lzw_decode(stream: bytes, literal_bits: int, limit: int) -> bytes:
    """Samples of an LZW stream, at most ``limit``. Ends at the end code, at the stream's end or at an impossible code."""
    clear = 1 << literal_bits
    bits = len(stream) * 8
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    widths = code_widths(4096, literal_bits)
    offsets = code_offsets(literal_bits)
    out: list[bytes] = []
    held: list[np.ndarray] = []  # codes since the last clear code
    size, at, nth = 0, 0, 0
    while at < bits and size < limit:
        if nth < 4096:
            begin = at + offsets[nth:4096] - offsets[nth]
            width = widths[nth:]
        else:  # the table is full and the writer hasn't cleared it
            begin, width = at + 12 * np.arange(4096), np.full(4096, 12)
        keep = int(np.searchsorted(begin + width, bits, side="right"))
        if not keep:
            break
        begin, width = begin[:keep], width[:keep]
        codes = (words[begin >> 3] >> (begin & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else keep
        held.append(codes[:stop])
        if stop == keep:
            at, nth = int(begin[-1] + width[-1]), nth + keep
            if sum(map(len, held)) < limit - size:  # each code stands for a sample at least
                continue
        got, whole = expanded(np.concatenate(held), literal_bits, limit - size)
        out.append(got)
        size, held = size + len(got), []
        if not whole or stop == keep or int(codes[stop]) == clear + 1:
            break
        at, nth = int(begin[stop] + width[stop]), 0
    if held:
        out.append(expanded(np.concatenate(held), literal_bits, limit - size)[0])
    return b"".join(out)[:limit]


# ---- GIF -------------------------------------------------------------------------------------------------------------


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part := data[k : k + 255])]) + part for k in range(0, len(data), 255)) + b"\0"


#: A palette of 256 greys.
GREYS = bytes(v for k in range(256) for v in (k, k, k))


def gif_of(payload: bytes, width: int = WIDTH, rows: int = ROWS_PER_FRAME, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF89a whose palette indexes are the payload's bytes, ``rows`` lines a frame; the payload is a multiple of width."""
    lines = len(payload) // width
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(lines, rows), 0xF7, 0, 0), GREYS]
    for top in range(0, lines, rows):
        high = min(rows, lines - top)
        samples = payload[top * width : (top + high) * width]
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, high, 0) + b"\x08" + sub_blocks(pack_codes(lzw_codes(samples))))
    return b"".join([*parts, b"\x3b"])


class NotGif(ValueError):
    """The bytes don't start as a GIF does, or claim a larger picture than is drawn."""


def gif_frames(data: bytes, draw: bool = True, most: int = MOST_PIXELS) -> Iterator[dict]:
    """Frames in order: index samples as stored, place, delay, palette, transparent index; with ``draw`` also the canvas in
    RGBA after disposal and transparency. A screen or frame of more than ``most`` samples raises NotGif, after the frames before it."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise NotGif("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(packed: int) -> np.ndarray | None:
        nonlocal at
        if not packed & 0x80:
            return None
        n = 2 << (packed & 7)
        colours = np.zeros((256, 3), np.uint8)
        raw = np.frombuffer(data[at : at + 3 * n], np.uint8)
        raw = raw[: len(raw) // 3 * 3].reshape(-1, 3)
        colours[: len(raw)] = raw
        at += 3 * n
        return colours

    def blocks() -> bytes:
        nonlocal at
        got = []
        while at < len(data) and (n := data[at]):
            got.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(got)

    shared = palette(flags)
    if draw and width * height > most:
        raise NotGif(f"a screen of {width} x {height} samples")
    canvas = np.zeros((height, width, 4) if draw else (0, 0, 4), np.uint8)
    delay, clear, disposal = 0, -1, 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x21 and at < len(data):
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear = body[3] if body[0] & 1 else -1
        elif kind == 0x2C and at + 9 < len(data):
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            if w * h > most:
                raise NotGif(f"a frame of {w} x {h} samples")
            colours = palette(packed)
            colours = shared if colours is None else colours
            literal = data[at] if at < len(data) else 0
            at += 1
            stream = blocks()
            samples = lzw_decode(stream, literal, w * h) if 1 <= literal <= 8 else b""
            index = np.zeros(w * h, np.uint8)
            index[: len(samples)] = np.frombuffer(samples, np.uint8)
            index = index.reshape(h, w)
            if packed & 0x40:  # interlaced: four passes
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                straight = np.empty_like(index)
                straight[order] = index
                index = straight
            colours = colours if colours is not None else np.zeros((256, 3), np.uint8)
            shown = index[: max(0, height - top), : max(0, width - left)]
            frame = {"left": left, "top": top, "width": w, "height": h, "delay_ms": 10 * delay, "index": index, "shown": shown, "palette": colours, "clear": clear}
            if draw:
                before = canvas.copy() if disposal == 3 else None
                area = canvas[top : top + shown.shape[0], left : left + shown.shape[1]]
                if clear < 0:  # nothing is transparent
                    area[..., :3], area[..., 3] = colours[shown], 255
                else:
                    seen = shown != clear
                    area[..., :3][seen] = colours[shown][seen]
                    area[..., 3][seen] = 255
                yield frame | {"canvas": canvas.copy()}
                if disposal == 2:
                    area[...] = 0
                elif disposal == 3:
                    canvas = before
            else:
                yield frame
            delay, clear, disposal = 0, -1, 0
        elif kind == 0x3B:
            break


def colour_histogram(frame: dict, bins: int = BINS) -> list[int]:
    """Counts over what a frame paints (its transparent samples apart): ``bins`` each for red, green and blue."""
    counts = np.bincount(frame["shown"].ravel(), minlength=256)
    if frame["clear"] >= 0:
        counts[frame["clear"]] = 0
    place = frame["palette"].astype(np.int64) * bins // 256
    return [int(n) for k in range(3) for n in np.bincount(place[:, k], weights=counts, minlength=bins)]


def canvas_histogram(canvas: np.ndarray, bins: int = BINS) -> list[int]:
    """The same over a displayed frame (its transparent pixels apart)."""
    pixels = canvas.reshape(-1, 4)
    solid = pixels[:, 3] == 255
    pixels = pixels if solid.all() else pixels[solid]
    place = np.arange(256) * bins // 256
    return [int(n) for k in range(3) for n in np.bincount(place, weights=np.bincount(pixels[:, k], minlength=256), minlength=bins)]


# ---- operators -------------------------------------------------------------------------------------------------------


def padded(payload: bytes) -> bytes:
    want = max(BLOCK, -(-len(payload) // BLOCK) * BLOCK)
    return payload + b"\xff" * (want - len(payload))


def store_gif(df: DataFrame, payload: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes (of the unpadded payload), media (GIF). Null payloads count as empty."""
    schema = T.StructType([df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    source = df.select(F.col(key), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))

    def run(batches):
        for batch in batches:
            arrow = pa.schema([batch.schema.field(0), ("n_bytes", pa.int64()), ("media", pa.binary())])

            def rows():
                for k, body in zip(batch.column(0), batch.column(1)):
                    raw = body.as_py()
                    media = gif_of(padded(raw))
                    yield [k.as_py(), len(raw), media], len(media)

            yield from batches_of(rows(), arrow)

    return source.mapInArrow(run, schema)


FRAME = "array<struct<delay_ms: int, left: int, top: int, width: int, height: int, canvas_sha256: string, histogram: array<bigint>>>"


def decode_gif(df: DataFrame, media: str = "media") -> DataFrame:
    """df with samples (the frames' index planes, joined), frames (times, places, and of each displayed canvas the SHA-256 of its
    RGBA bytes and the histogram) and error."""
    keep = [f for f in df.schema.fields if f.name not in ("samples", "frames", "error")]
    names = [f.name for f in keep]
    frame_type = T._parse_datatype_string(FRAME)
    schema = T.StructType([*keep, T.StructField("samples", T.BinaryType()), T.StructField("frames", frame_type), T.StructField("error", T.StringType())])
    arrow_frame = pa.list_(pa.struct([("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("canvas_sha256", pa.string()), ("histogram", pa.list_(pa.int64()))]))

    def run(batches):
        for batch in batches:
            arrow = pa.schema([*batch.schema, ("samples", pa.binary()), ("frames", arrow_frame), ("error", pa.string())])
            where = batch.schema.get_field_index(media)

            def rows():
                for n in range(batch.num_rows):
                    data = batch.column(where)[n].as_py()
                    planes, frames, error = [], [], None
                    try:
                        for x in gif_frames(data or b""):
                            planes.append(x["index"].tobytes())
                            frames.append({k: x[k] for k in ("delay_ms", "left", "top", "width", "height")} | {"canvas_sha256": hashlib.sha256(x["canvas"]).hexdigest(), "histogram": canvas_histogram(x["canvas"])})
                    except NotGif as e:
                        error = str(e)
                    yield [*(c[n].as_py() for c in batch.columns), b"".join(planes), frames, error], len(data or b"") + sum(map(len, planes))

            yield from batches_of(rows(), arrow)

    return df.select(*(F.col(n) for n in names)).mapInArrow(run, schema)


# ---- query -----------------------------------------------------------------------------------------------------------


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decode_gif(store_gif(table(spark, sf_dir, "documents")))
    bins = range(3 * BINS)
    total = F.expr("aggregate(frames, cast(array_repeat(0L, %d) as array<bigint>), (a, f) -> zip_with(a, f.histogram, (x, y) -> x + y))" % len(bins))
    return read.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.size("frames").alias("n_frames"),
        F.expr("aggregate(frames, 0L, (a, f) -> a + f.delay_ms)").alias("duration_ms"), total.alias("histogram"),
    ).withColumn("feature", F.concat_ws(",", F.concat(F.lit("frames="), F.col("n_frames")), F.concat(F.lit("grey="), F.array_join(F.slice("histogram", 1, BINS).cast("array<string>"), "."))))
