"""Media columns: AVI motion-JPEG.

Any bytes become a clip of grey 24 x 24 frames, 576 bytes a frame, and come back exactly. A byte is one quantised DCT
coefficient: JPEG's magnitude category 8 has 256 values, -255 to -128 and 128 to 255, and the 8 bits that name a value
there are the byte. With all quantisers 1, and one Huffman code for "no zeros, category 8", each of a frame's 9 blocks is
64 x 9 bits, and a restart marker after each block sets the prediction of the first coefficient back to zero. The frames are
baseline JPEG images, indexed by idx1 in a RIFF file.

Reading goes by the index, parses each frame's markers and decodes its coefficients and pixels; frames laid out in another
way (other Huffman tables, runs of zeros, no restarts) are decoded code by code. A shot begins where the histogram of
pixels differs from the frame before by more than the running mean and deviation of the clip's differences allow.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import raw, slices, table

SIDE, BLOCKS, FRAME, FPS = 24, 9, 576, 25
BINS = 16
#: Fixed by the JPEG standard: the zigzag order of the coefficients of a block.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (s := i // 8 + i % 8, (i // 8 if s % 2 else i % 8))))
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
#: From 64 coefficients in zigzag order to 64 pixels, as one product.
_IDCT = np.einsum("xu,yv->xyuv", _COS, _COS).reshape(64, 64)[:, _ZIGZAG].T.astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: All of a frame before its scan. The only Huffman code, "0", is category 8 for the first coefficient, and (no zeros, category 8) for others.
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0")
    + _segment(0xC4, b"\x00" + bytes([1, *[0] * 15]) + b"\x08")
    + _segment(0xC4, b"\x10" + bytes([1, *[0] * 15]) + b"\x08")
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of a frame."""
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def frames_of(payload: bytes) -> list[bytes]:
    """A JPEG image for each 576 bytes."""
    values = np.frombuffer(payload, np.uint8).reshape(-1, 64, 1)
    bits = np.zeros((len(values), 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(values, axis=2)
    coded = np.packbits(bits.reshape(len(values), -1), axis=1).tobytes()
    out = []
    for at in range(0, len(coded), 72 * BLOCKS):
        parts = [_HEAD]
        for k in range(BLOCKS):
            parts.append(coded[at + 72 * k : at + 72 * (k + 1)].replace(b"\xff", b"\xff\0"))
            parts.append(bytes((0xFF, 0xD0 + k % 8)))
        parts[-1] = b"\xff\xd9"
        out.append(b"".join(parts))
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(data: bytes) -> bytes:
    frames = frames_of(padded(data))
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for frame in frames:
        movi.append(part := _chunk(b"00dc", frame))
        index.append(b"00dc" + struct.pack("<3I", 0x10, at, len(frame)))
        at += len(part)
    body = b"AVI " + header + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def indexed_frames(avi: bytes) -> list[bytes]:
    """The images that the index of a RIFF file names, in its order. Its offsets count from `movi` or from the file's start."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(avi):
        name, n = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = avi[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    out = []
    for name, _, offset, n in struct.iter_unpack("<4s3I", index):
        if name[2:] == b"dc":
            place = movi + offset if avi[movi + offset : movi + offset + 4] == name else offset
            out.append(avi[place + 8 : place + 8 + n])
    return out


@dataclass
class _Image:
    width: int = 0
    height: int = 0
    restart: int = 0
    quantisers: np.ndarray = field(default_factory=lambda: np.ones(64, np.int32))
    #: (class, id) to {(length, code): symbol}
    codes: dict = field(default_factory=dict)
    scan: bytes = b""


def _parse(frame: bytes) -> _Image:
    image, tables, at = _Image(), {}, 2
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    while True:
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisers aren't baseline")
                tables[body[0]], body = np.frombuffer(body[1:65], np.uint8).astype(np.int32), body[65:]
        elif marker == 0xC0:
            depth, image.height, image.width, parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts != 1:
                raise ValueError("only grey baseline frames are read")
            image.quantisers = tables[body[8]]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == 0xC4:
            while body:
                sizes, code, use, own = body[1:17], 0, 17, {}
                for length, count in enumerate(sizes, 1):
                    for _ in range(count):
                        own[length, code] = body[use]
                        code, use = code + 1, use + 1
                    code <<= 1
                image.codes[body[0] >> 4, body[0] & 15] = own
                body = body[use:]
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            image.codes = {0: image.codes[0, body[2] >> 4], 1: image.codes[1, body[2] & 15]}
            image.scan = frame[at + 2 + n : frame.rindex(b"\xff\xd9")]
            return image
        at += 2 + n


_UNIFORM = {0: {(1, 0): 8}, 1: {(1, 0): 8}}


def _restarts(scan: bytes) -> list[bytes]:
    """The parts of a scan between restart markers, without stuffing."""
    data = np.frombuffer(scan, np.uint8)
    marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] >= 0xD0) & (data[1:] <= 0xD7))
    ends = [*marks.tolist(), len(scan)]
    return [scan[a:b].replace(b"\xff\0", b"\xff") for a, b in zip([0, *(x + 2 for x in ends[:-1])], ends, strict=True)]


def _by_code(image: _Image, blocks: int) -> np.ndarray:
    """Quantised coefficients of any grey baseline scan, code by code."""
    out = np.zeros((blocks, 64), np.int32)
    parts = iter(_restarts(image.scan))
    bits, at, before = "", 0, 0

    def symbol(codes: dict) -> int:
        nonlocal at
        for n in range(1, 17):
            if (got := codes.get((n, int(bits[at : at + n], 2)))) is not None:
                at += n
                return got
        raise ValueError("no such code")

    def value(n: int) -> int:
        nonlocal at
        if not n:
            return 0
        got = int(bits[at : at + n], 2)
        at += n
        return got if got >> (n - 1) else got - (1 << n) + 1

    for k in range(blocks):
        if k == 0 or image.restart and k % image.restart == 0:
            bits, at, before = "".join(f"{x:08b}" for x in next(parts)), 0, 0
        before = out[k, 0] = before + value(symbol(image.codes[0]))
        i = 1
        while i < 64:
            run, n = divmod(symbol(image.codes[1]), 16)
            if n == 0 and run < 15:
                break
            i += run
            if n:
                out[k, i] = value(n)
            i += 1
    return out


def read_frames(frames: list[bytes]) -> tuple[np.ndarray, list[_Image]]:
    """Quantised coefficients of all blocks of all frames, in zigzag order, and what else the frames say."""
    images, out, same = [], [], []

    def together() -> None:
        if same:
            bits = np.unpackbits(np.frombuffer(b"".join(same), np.uint8).reshape(-1, 72), axis=1).reshape(-1, 64, 9)
            if bits[:, :, 0].any():
                raise ValueError("no such code")
            byte = np.packbits(bits[:, :, 1:], axis=2).reshape(-1, 64).astype(np.int32)
            out.append(np.where(byte >= 128, byte, byte - 255))
            same.clear()

    head = None
    for frame in frames:
        if head is not None and frame.startswith(head):  # the same tables as in the frame before
            image = _Image(images[-1].width, images[-1].height, images[-1].restart, images[-1].quantisers, images[-1].codes, frame[len(head) : frame.rindex(b"\xff\xd9")])
        else:
            image = _parse(frame)
            head = frame[: len(frame) - len(image.scan) - 2]
        images.append(image)
        blocks = -(-image.width // 8) * -(-image.height // 8)
        parts = _restarts(image.scan) if image.codes == _UNIFORM and image.restart == 1 else []
        if len(parts) == blocks and all(len(x) == 72 for x in parts):
            same += parts
        else:
            together()
            out.append(_by_code(image, blocks))
    together()
    return np.concatenate(out), images


def shots_of(histograms: np.ndarray, window: int = 8, k: float = 3.0, least: float = 0.15) -> list[tuple[int, int, float]]:
    """(first frame, frame after the last, difference at its start) of each shot.

    A frame begins a shot if half the sum of absolute differences to the histogram before, as a share of the pixels, is over
    `least` and over mean + k deviations of the last `window` differences within the shot.
    """
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2 * max(1, int(histograms[0].sum())))
    starts, scores = [0], [0.0]
    for t, d in enumerate(change.tolist(), 1):
        past = change[max(starts[-1], t - 1 - window) : t - 1]
        if d > least and d > (past.mean() + k * past.std() if len(past) else least):
            starts.append(t)
            scores.append(d)
    return list(zip(starts, [*starts[1:], len(histograms)], scores, strict=True))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, 1 << 20):
        texts = raw(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(write_avi, texts), pa.binary())], ["id", "n_bytes", "media"])


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) for each row: the whole text's UTF-8 bytes as an AVI file; null texts are empty, with one frame of padding."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_write, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


_CLIP = [("start_ms", pa.int64()), ("end_ms", pa.int64()), ("change", pa.float64())]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2, 1 << 20):
        payloads, clips, counts, means = [], [], [], []
        for avi in raw(batch.column(2)):
            coefficients, images = read_frames(indexed_frames(avi))
            byte = np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8)
            payloads.append(byte.tobytes())
            sizes = [-(-x.width // 8) * -(-x.height // 8) for x in images]
            scale = np.repeat(np.stack([x.quantisers for x in images]), sizes, axis=0) if any((x.quantisers != 1).any() for x in images) else 1
            pixels = np.clip((coefficients * scale).astype(np.float32) @ _IDCT + 128, 0, 255).astype(np.int64)
            frame = np.repeat(np.arange(len(images)), sizes)
            histograms = np.bincount((frame[:, None] * BINS + pixels * BINS // 256).ravel(), minlength=BINS * len(images)).reshape(-1, BINS)
            clips.append([{"start_ms": a * 1000 // FPS, "end_ms": b * 1000 // FPS, "change": round(d, 6)} for a, b, d in shots_of(histograms)])
            counts.append(len(images))
            means.append(float(pixels.mean()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(counts, pa.int64()), pa.array(means), pa.array(clips, pa.list_(pa.struct(_CLIP)))], ["id", "n_bytes", "media", "payload", "n_frames", "brightness", "clips"])


def read_media(media: DataFrame) -> DataFrame:
    """media of write_media() with the payload that its file holds, the frames' number and mean brightness, and the clips (timed shots)."""
    return media.mapInArrow(_read, f"id {media.schema['id'].dataType.simpleString()}, n_bytes long, media binary, payload binary, n_frames long, brightness double, clips array<struct<start_ms:long,end_ms:long,change:double>>")


def clips(read: DataFrame) -> DataFrame:
    """A row (id, clip, start_ms, end_ms, change) for each shot."""
    return read.select("id", F.posexplode("clips").alias("clip", "c")).select("id", "clip", "c.*")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read_media(write_media(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("brightness="), F.format_number("brightness", 3)), F.concat(F.lit("shots="), F.array_join(F.transform("clips", lambda c: F.concat(c["start_ms"], F.lit("-"), c["end_ms"])), ",")))
    return done.select(
        F.col("id").alias("doc_id"), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
