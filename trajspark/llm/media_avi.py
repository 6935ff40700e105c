"""Media columns: AVI motion-JPEG.

`pack` stores bytes as an AVI file whose frames are baseline greyscale JPEGs.  JPEG's own
unit is the quantised DCT coefficient; with all quantisers 1, each payload byte is one
coefficient of a 64-coefficient block, so storage is lossless.  A byte becomes a signed value
that fits its place (the first coefficient is coded as a difference; the others are never 0),
and the Huffman tables give a value of s bits a code of 9 - s, so that every coefficient takes
9 bits and frames are coded and decoded as whole arrays.  Frames with other tables, as other
writers make them, are decoded coefficient by coefficient: baseline images of 8 bits, grey or of
three components under any sampling, of which the first (luma) is kept, in one scan or one for
each component; the usual Huffman tables stand in for missing ones.

`unpack` reads RIFF chunks and the idx1 index (or the movi list, where there is none) and
gives the payload back; `clips_of` decodes frames to pixels and cuts shots where the change
of the brightness histogram stands out from the changes before it, yielding timed clips.  Files
of other writers have no payload; their digests have nulls for it.

Payloads are zero-padded to a positive multiple of 64; the last frame is padded with blocks,
and an INFO comment holds the payload's length.  Null and empty texts give one block of
zeros.  Equal bytes give equal files.  `read_media` raises ValueError for broken files; `clips_of` yields no
clips of them, nor of null media, and `media_digests` only their size and hash (null for null).  Repeated rows are
packed each; an empty table gives an empty result; other columns are carried by `pack`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import arrow_rows

SIDE, WIDTH, FPS = 8, 64, 25
BLOCKS = 64  # of a full frame
BINS = 16
#: A cut: the change exceeds mean + SPREAD * deviation of the last MEMORY changes, and FLOOR.
MEMORY, SPREAD, FLOOR = 8, 3.0, 0.05

#: Fixed by the JPEG format: rows and columns in the order of the zigzag scan.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """9-bit symbols of the values -255..255 as differences, and of the bytes as coefficients."""

    def symbol(v: int) -> int:
        s = abs(v).bit_length()
        return ((1 << 8 - s) - 1) << s + 1 | (v if v >= 0 else v + (1 << s) - 1)

    return np.array([symbol(v) for v in range(-255, 256)], np.uint16), np.array([symbol(b - 128 if b < 128 else b - 127) for b in range(256)], np.uint16)


DIFF, COEF = _codes()
UNDIFF, UNCOEF = np.full(512, 1000, np.int64), np.full(512, -1, np.int64)
UNDIFF[DIFF], UNCOEF[COEF] = np.arange(-255, 256), np.arange(256)


def _table(kind: int, sizes: range) -> bytes:
    lengths = [0] * 16
    for s in sizes:
        lengths[8 - s] += 1
    return struct.pack(">BBHB", 0xFF, 0xC4, 2 + 17 + len(sizes), kind) + bytes(lengths) + bytes(reversed(sizes))


TABLES = _table(0x00, range(0, 9)) + _table(0x10, range(1, 9))


def _standard() -> dict[int, tuple[bytes, bytes]]:
    """The usual Huffman tables, which motion-JPEG frames may leave out."""

    def rest(head: str, rows: tuple[tuple[int, int], ...]) -> bytes:
        return bytes.fromhex(head) + bytes(16 * run + size for run, low in rows for size in range(low, 11))

    return {
        0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
        0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
        0x10: (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), rest("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282", ((0, 9), (1, 6), (2, 5), (3, 4), (4, 3), (5, 3), (6, 3), (7, 3), (8, 3), (9, 2), (10, 2), (11, 2), (12, 2), (13, 2), (14, 1), (15, 1)))),
        0x11: (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), rest("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1", ((1, 7), (2, 6), (3, 5), (4, 3), (5, 3), (6, 3), (7, 3), (8, 2), (9, 2), (10, 2), (11, 2), (12, 2), (13, 2), (14, 2), (15, 2)))),
    }


STANDARD = _standard()

_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: Coefficients in zigzag order to pixels.
TO_PIXELS = np.stack([np.outer(_COS[p // 8], _COS[p % 8]).ravel() for p in ZIGZAG])


def _head(height: int) -> bytes:
    return b"\xff\xd8" + b"\xff\xdb\x00\x43\x00" + b"\x01" * 64 + struct.pack(">BBHBHHBBBB", 0xFF, 0xC0, 11, 8, height, WIDTH, 1, 1, 0x11, 0) + TABLES + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 if raw else 64)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) % 2)


def pack_bytes(payload: bytes) -> bytes:
    """An AVI file that holds payload, whose length is a positive multiple of 64."""
    n = len(payload) // 64
    per = BLOCKS if n >= BLOCKS else -(-n // 8) * 8
    frames = -(-n // per)
    height = per
    blocks = np.zeros((frames * per, 64), np.uint8)
    blocks.ravel()[: len(payload)] = np.frombuffer(payload, np.uint8)
    symbols = COEF[blocks]
    first = blocks[:, 0].reshape(frames, per).astype(np.int64) - 128
    symbols[:, 0] = DIFF[np.diff(first, axis=1, prepend=0).ravel() + 255]
    s = symbols.reshape(-1, 8)
    out = np.zeros((len(s), 9), np.uint16)
    for k in range(8):
        out[:, k] |= s[:, k] >> (k + 1)
        out[:, k + 1] = s[:, k] << (7 - k) & 255
    coded = out.astype(np.uint8).reshape(frames, -1)
    head = _head(height)
    images = [head + f.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for f in coded]
    movi, index = [b"movi"], []
    at = 4
    for image in images:
        movi.append(c := _chunk(b"00dc", image))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += len(c)
    most = max(map(len, images))
    avih = struct.pack("<10I4I", 1_000_000 // FPS, most * FPS, 0, 0x10, frames, 0, 1, most, WIDTH, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", f"payload={len(payload)}".encode())
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(media: bytes) -> dict:
    """Frames (JPEG bytes), frames a second and the comment of an AVI file."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"fps": float(FPS), "comment": "", "frames": []}
    movi = index = None

    def walk(at: int, end: int) -> None:
        nonlocal movi, index
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            body, stop = at + 8, at + 8 + size
            if stop > len(media):
                raise ValueError("a chunk runs past the file's end")
            if name == b"LIST" and media[body : body + 4] == b"movi":
                movi = (body, stop)
            elif name == b"LIST":
                walk(body + 4, stop)
            elif name == b"avih" and (us := struct.unpack_from("<I", media, body)[0]):
                out["fps"] = 1e6 / us
            elif name == b"ICMT":
                out["comment"] = media[body:stop].rstrip(b"\x00").decode("latin-1")
            elif name == b"idx1":
                index = (body, stop)
            at = stop + size % 2

    walk(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))
    if movi is None:
        raise ValueError("no movi list")
    if index is not None:
        entries = [struct.unpack_from("<4sIII", media, p) for p in range(index[0], index[1] - 15, 16)]
        # offsets count from the list's name or from the file's start
        base = movi[0] if entries and entries[0][2] < movi[0] else 0
        out["frames"] = [media[base + at + 8 : base + at + 8 + size] for name, _, at, size in entries if name[2:4] in (b"dc", b"db") and size]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST":  # frames in groups
                at += 12
                continue
            if name[2:4] in (b"dc", b"db") and size:
                out["frames"].append(media[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return out


def _scan_end(jpeg: bytes, at: int) -> int:
    """Where the image data from `at` on end: at a marker that is no restart."""
    while (at := jpeg.find(b"\xff", at)) >= 0 and at + 1 < len(jpeg):
        if jpeg[at + 1] and not 0xD0 <= jpeg[at + 1] <= 0xD7:
            return at
        at += 2
    raise ValueError("image data without an end")


def _segments(jpeg: bytes) -> dict:
    """The tables of a frame, and the scan that holds its first component (grey or luma)."""
    out: dict = {"quant": {}, "huff": dict(STANDARD), "raw_huff": b"", "restart": 0}
    at = 2
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    while True:
        while jpeg[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF or jpeg[at + 1] == 0xD9:
            raise ValueError("an image without a scan")
        mark, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            out["raw_huff"] += jpeg[at : at + 2 + size]
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif mark in (0xC0, 0xC1):
            out["height"], out["width"], n = struct.unpack_from(">HHB", body, 1)
            # name: sampling factors across and down, quantiser
            out["parts"] = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if body[0] != 8 or n not in (1, 3) or len(out["parts"]) != n:
                raise ValueError("only images of 8 bits and one or three components are read")
            out["first"] = body[6]
            out["table"] = body[8]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("only baseline images are read")
        at += 2 + size
        if mark == 0xDA:
            if "parts" not in out:
                raise ValueError("a scan before its frame")
            scan = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            stop = _scan_end(jpeg, at)
            if out["first"] in scan:
                # the blocks of a unit: component, numbers of its tables
                alone = len(scan) == 1
                out["unit"] = [(name, tables) for name, tables in scan.items() for _ in range(1 if alone else out["parts"][name][0] * out["parts"][name][1])]
                out["data"] = jpeg[at:stop]
                most = [max(x[k] for x in out["parts"].values()) for k in (0, 1)]
                h, v, _ = out["parts"][out["first"]]
                # the size of the first component, and its blocks in a unit
                out["size"] = (-(-out["width"] * h // most[0]), -(-out["height"] * v // most[1]))
                out["grid"] = (1, 1) if alone else (h, v)
                out["units"] = tuple(-(-n // (8 * g)) if alone else -(-full // (8 * m)) for n, g, full, m in zip(out["size"], out["grid"], (out["width"], out["height"]), most, strict=True))
                return out
            at = stop


@lru_cache(64)
def _book(lengths: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """Length and symbol of the code that the next 16 bits begin with; length 0 if none does."""
    out, code, k = [(0, 0)] * 65536, 0, 0
    for length, many in enumerate(lengths, 1):
        for _ in range(many):
            low = code << 16 - length
            out[low : low + (1 << 16 - length)] = [(length, symbols[k])] * (1 << 16 - length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _slow_blocks(seg: dict, n: int) -> np.ndarray:
    """Coefficients of the first component's n blocks, symbol by symbol, under any Huffman tables."""
    out, done = np.zeros((n, 64), np.int64), 0
    parts, cur, p = [], bytearray(), 0
    data = seg["data"]
    while p < len(data):
        if data[p] == 0xFF and p + 1 < len(data):
            if data[p + 1] == 0:
                cur.append(0xFF)
            elif 0xD0 <= data[p + 1] <= 0xD7:
                parts.append(bytes(cur))
                cur = bytearray()
            p += 2
        else:
            cur.append(data[p])
            p += 1
    try:
        unit = [(name, name == seg["first"], _book(*seg["huff"][t >> 4]), _book(*seg["huff"][0x10 | t & 15])) for name, t in seg["unit"]]
    except KeyError:
        raise ValueError("no such Huffman table") from None
    units = left = seg["units"][0] * seg["units"][1]
    for part in [*parts, bytes(cur)]:
        bits, at, dc = "".join(f"{b:08b}" for b in part) + "1" * 16, 0, dict.fromkeys(seg["parts"], 0)
        end = len(bits) - 16

        def value(size: int) -> int:
            nonlocal at
            if not size:
                return 0
            v = int(bits[at : at + size] or "0", 2)
            at += size
            return v if v >> size - 1 else v - (1 << size) + 1

        def symbol(book: list) -> int:
            nonlocal at
            if at >= end:
                raise ValueError("image data end early")
            length, s = book[int(bits[at : at + 16], 2)]
            if not length:
                raise ValueError("no such Huffman code")
            at += length
            return s

        for _ in range(min(seg["restart"] or units, left)):
            left -= 1
            for name, first, low, high in unit:
                dc[name] += value(symbol(low))
                k = 1
                if first:
                    out[done, 0] = dc[name]
                while k < 64:
                    rs = symbol(high)
                    if rs == 0:
                        break
                    k += rs >> 4
                    if rs & 15:
                        if k > 63:
                            raise ValueError("a block of too many coefficients")
                        v = value(rs & 15)
                        if first:
                            out[done, k] = v
                    k += 1
                done += first
            if at > end:
                raise ValueError("image data end early")
    if left:
        raise ValueError("image data end early")
    return out


def decode_blocks(jpeg: bytes) -> tuple[np.ndarray, dict]:
    """Quantised coefficients of the blocks of a frame's first component in zigzag order, and its segments."""
    seg = _segments(jpeg)
    n = seg["units"][0] * seg["units"][1] * seg["grid"][0] * seg["grid"][1]
    if seg["raw_huff"] != TABLES or seg["restart"] or len(seg["parts"]) > 1:
        return _slow_blocks(seg, n), seg
    coded = np.frombuffer(seg["data"].replace(b"\xff\x00", b"\xff"), np.uint8)
    if len(coded) != 72 * n:
        raise ValueError("image data of a wrong length")
    b = coded.reshape(-1, 9).astype(np.int64)
    s = np.stack([(b[:, k] << (k + 1) | b[:, k + 1] >> (7 - k)) & 511 for k in range(8)], axis=1).reshape(n, 64)
    out = UNCOEF[s]
    out = np.where(out < 128, out - 128, out - 127)
    out[:, 0] = np.cumsum(UNDIFF[s[:, 0]])
    return out, seg


def _payload(blocks: np.ndarray) -> np.ndarray:
    out = np.where(blocks < 0, blocks + 128, blocks + 127)
    out[:, 0] = blocks[:, 0] + 128
    if out.min(initial=0) < 0 or out.max(initial=0) > 255:
        raise ValueError("no payload in these frames")
    return out.astype(np.uint8)


def unpack_bytes(media: bytes) -> bytes:
    """The payload that pack_bytes stored."""
    avi = read_avi(media)
    raw = b"".join(_payload(decode_blocks(f)[0]).tobytes() for f in avi["frames"])
    if not avi["comment"].startswith("payload="):
        raise ValueError("the file says no payload length")
    return raw[: int(avi["comment"][8:])]


def luma(blocks: np.ndarray, seg: dict) -> np.ndarray:
    """The pixels of a frame's first component, rows by columns, without the blocks' padding."""
    if seg["table"] not in seg["quant"]:
        raise ValueError("no such quantiser")
    pixels = np.clip(np.rint((blocks * seg["quant"][seg["table"]]) @ TO_PIXELS + 128), 0, 255).astype(np.int64)
    (across, down), (h, v), (width, height) = seg["units"], seg["grid"], seg["size"]
    return pixels.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)[:height, :width]


def _histogram(blocks: np.ndarray, seg: dict) -> np.ndarray:
    return np.bincount((luma(blocks, seg) * BINS >> 8).ravel(), minlength=BINS)


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """First frame and end of each shot, from the frames' histograms."""
    share = histograms / np.maximum(1, histograms.sum(1, keepdims=True))
    change = np.abs(np.diff(share, axis=0)).sum(1) / 2
    starts = [0]
    for i, c in enumerate(change):
        before = change[max(0, i - MEMORY) : i]
        if c > FLOOR and (len(before) < 2 or c > before.mean() + SPREAD * before.std()):
            starts.append(i + 1)
    return list(zip(starts, [*starts[1:], len(share)], strict=True)) if len(share) else []


def read_media(media: bytes, payload: bool = True) -> tuple[bytes | None, list[tuple[int, int]], float, str]:
    """Payload (None in files of other writers, or if not asked for), shots, frames a second and a feature line, decoding each frame once."""
    try:
        return _read_media(media, payload)
    except (struct.error, IndexError, KeyError, TypeError) as e:  # what stands there ends too early, or is none
        raise ValueError("a broken file") from e


def _read_media(media: bytes, payload: bool) -> tuple[bytes | None, list[tuple[int, int]], float, str]:
    avi = read_avi(media)
    payload = payload and avi["comment"].startswith("payload=")
    raw, histograms, size = [], [], (0, 0)
    for f in avi["frames"]:
        blocks, seg = decode_blocks(f)
        if payload:
            raw.append(_payload(blocks).tobytes())
        histograms.append(_histogram(blocks, seg))
        size = (seg["width"], seg["height"])
    table = np.array(histograms).reshape(-1, BINS)
    cuts = shots(table)
    total = ",".join(map(str, table.sum(0).tolist()))
    feature = f"{len(table)}x{size[0]}x{size[1]};shots={','.join(f'{a}-{b}' for a, b in cuts)};luma={total}"
    return b"".join(raw)[: int(avi["comment"][8:])] if payload else None, cuts, avi["fps"], feature


def _read_or_none(media: bytes | None, payload: bool = True) -> tuple | None:
    try:
        return None if media is None else read_media(media, payload)
    except ValueError:
        return None


def pack(docs: DataFrame) -> DataFrame:
    """docs without text, with n_bytes long and media binary."""
    arrow_rows(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in ("text", "n_bytes", "media")]
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 250) for b in batches for k in range(0, b.num_rows, 250)):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([len(r) for r in raw], pa.int64()), pa.array([pack_bytes(pad(r)) for r in raw], pa.binary())], [*keep, "n_bytes", "media"])

    return docs.select(*keep, F.col("text").cast("string")).mapInArrow(run, schema)


def clips_of(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, clip, start_frame, end_frame, start_s, end_s): one row for each shot of each media value."""
    schema = media.select(key).schema.add("clip", "integer").add("start_frame", "long").add("end_frame", "long").add("start_s", "double").add("end_s", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, a, b, a / fps, b / fps) for k, m in zip(batch.column(key).to_pylist(), batch.column("media").to_pylist(), strict=True) if (found := _read_or_none(m, payload=False)) for _, cuts, fps, _ in [found] for n, (a, b) in enumerate(cuts)]
            types = (batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [key, "clip", "start_frame", "end_frame", "start_s", "end_s"])

    return media.select(key, "media").mapInArrow(run, schema)


def media_digests(media: DataFrame) -> DataFrame:
    """The digest row of each (doc_id, n_bytes, media), from the stored bytes read back."""
    fields = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column("media").to_pylist():
                payload, _, _, feature = _read_or_none(m) or (None,) * 4
                of = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
                rows.append((*of, *((None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())), feature))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], list(fields))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
