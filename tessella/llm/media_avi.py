"""Media columns: byte payloads as AVI motion-JPEG, read back through the RIFF index, with shots as timed clip rows.

A frame is a grayscale baseline JPEG of 24 x 24 blocks, and each payload byte is the level of one block: quantised by
8, a flat block of value v is the DC coefficient v - 128 and no other, so any baseline decoder returns v exactly. The
frame's Huffman tables give DC category s a code of 9 - s bits, so a difference takes 9 bits with its extra bits and
the end-of-block code one more; whole batches of frames are coded and decoded as arrays. Frames with other tables
(any one-component baseline JPEG) are decoded by a general, slower routine.

Shots: the histogram difference between neighbouring frames is a cut where it exceeds the mean of the last ``window``
differences by ``k`` standard deviations and a floor. A cut needs two earlier differences of the same document, so frames
1 and 2 never begin a shot, and a payload of up to 3 frames (1,728 bytes) is always one shot.

Defined cases: null or empty text: one frame of padding; very long texts: batches are cut by payload bytes; repeated
rows and equal texts: each gets its row, with equal values; ties (a difference just at the bound): no cut; null doc_id: kept; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_arrays, ids_out, plain, small_batches, text_arrays, tidy

FRAME = 576  # payload bytes in a frame: 24 x 24 blocks
SIDE = 24
FPS = 24

# The orders of JPEG's 8 x 8 coefficients.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """10-bit code of each difference -255..255 (9 bits and the end-of-block bit), and back."""
    code = np.zeros(511, np.uint16)
    back = np.zeros(1024, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << s) - 1
        prefix = ((1 << (8 - s)) - 1) << 1 if s else 0b111111110
        code[d + 255] = ((prefix << s | extra) if s else prefix) << 1
        back[code[d + 255]] = d
    return code, back


CODE, BACK = _tables()
_segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0] + [8] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, 8 * SIDE, 8 * SIDE, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, bytes([0x00, *([1] * 9), *([0] * 7), 8, 7, 6, 5, 4, 3, 2, 1, 0]))
    + _segment(0xC4, bytes([0x10, 1, *([0] * 15), 0]))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def encode_frames(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """frames [n, 576] uint8 to (all JPEGs as AVI chunks one after another, chunk offsets of n + 1)."""
    n = len(frames)
    level = np.empty((n, FRAME + 1), np.int16)
    level[:, 0] = 128  # the DC prediction starts at 0
    level[:, 1:] = frames
    c = CODE[np.diff(level, axis=1) + 255].astype(np.uint64).reshape(n, FRAME // 4, 4)
    word = c[:, :, 0] << np.uint64(30) | c[:, :, 1] << np.uint64(20) | c[:, :, 2] << np.uint64(10) | c[:, :, 3]
    body = np.ascontiguousarray(word.astype(">u8")).view(np.uint8).reshape(n, FRAME // 4, 8)[:, :, 3:].reshape(n, -1)
    ff = body == 255
    size = len(HEADER) + body.shape[1] + ff.sum(axis=1) + 2
    offs = np.concatenate(([0], np.cumsum(8 + size + size % 2)))
    out = np.zeros(offs[-1], np.uint8)
    head = np.frombuffer(b"00dc\0\0\0\0" + HEADER, np.uint8)
    out[offs[:-1, None] + np.arange(len(head))] = head
    out[offs[:-1, None] + np.arange(4, 8)] = np.ascontiguousarray(size.astype("<u4")).view(np.uint8).reshape(n, 4)
    # a zero follows every 255 of the entropy-coded bytes
    at = offs[:-1, None] + len(head) + np.arange(body.shape[1]) + np.cumsum(ff, axis=1) - ff
    out[at] = body
    out[offs[:-1] + 8 + size - 2], out[offs[:-1] + 8 + size - 1] = 0xFF, 0xD9
    return out, offs


def avi(chunks: bytes, offs: np.ndarray) -> bytes:
    """An AVI file of '00dc' chunks; offs: their places, the end included."""
    n = len(offs) - 1
    most = int(np.diff(offs).max())
    part = lambda name, body: name + struct.pack("<I", len(body)) + body
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, 8 * SIDE, 8 * SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, 8 * SIDE, 8 * SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, 8 * SIDE, 8 * SIDE, 1, 24, b"MJPG", (8 * SIDE) ** 2 * 3, 0, 0, 0, 0)
    head = part(b"LIST", b"hdrl" + part(b"avih", main) + part(b"LIST", b"strl" + part(b"strh", stream) + part(b"strf", picture)))
    index = np.empty((n, 4), "<u4")
    index[:, 0] = struct.unpack("<I", b"00dc")[0]
    index[:, 1] = 0x10
    index[:, 2] = offs[:-1] - offs[0] + 4
    index[:, 3] = np.frombuffer(chunks, np.uint8)[(offs[:-1] - offs[0])[:, None] + np.arange(4, 8)].copy().view("<u4")[:, 0]
    body = b"AVI " + head + part(b"LIST", b"movi" + chunks) + part(b"idx1", index.tobytes())
    return part(b"RIFF", body)


def parse_index(file: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, sizes) of the video frames, by walking the RIFF lists to 'movi' and 'idx1'."""
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"LIST" and file[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(file, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no movi list or idx1 index")
    video = index[(index[:, 0] & 0xFFFF) == struct.unpack("<H", b"00")[0]]
    start = movi if len(video) and file[movi + int(video[0, 2]) :][:4] == b"00dc" else 0  # offsets count from 'movi' or from the file
    return video[:, 2].astype(np.int64) + start + 8, video[:, 3].astype(np.int64)


def decode_blocks(jpeg: bytes) -> np.ndarray:
    """Samples [height, width] of any one-component baseline JPEG (whole blocks)."""
    quant, huff, at = {}, {}, 2
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(float)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            table = body[8]
            if parts != 1:
                raise ValueError("one component only")
        elif marker == 0xC4:
            while body:
                counts, code, symbols, k = body[1:17], 0, {}, 17
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        symbols[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huff[body[0]] = symbols
                body = body[k:]
        elif marker == 0xDA:
            dc, ac = huff[body[2] >> 4], huff[0x10 | body[2] & 15]
            break
    bits = np.unpackbits(np.frombuffer(jpeg[at : jpeg.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
    pos = 0

    def take(n: int) -> int:
        nonlocal pos
        out = 0
        for b in bits[pos : pos + n]:
            out = out << 1 | b
        pos += n
        return out

    def symbol(table: dict) -> int:
        nonlocal pos
        code = length = 0
        while True:
            code, length, pos = code << 1 | bits[pos], length + 1, pos + 1
            if (length, code) in table:
                return table[length, code]

    def signed(s: int) -> int:
        v = take(s)
        return v if not s or v >> (s - 1) else v - (1 << s) + 1

    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) / 2 * np.where(u == 0, np.sqrt(0.5), 1)
    out, last = np.empty((-(-height // 8) * 8, -(-width // 8) * 8)), 0
    for y in range(0, out.shape[0], 8):
        for x in range(0, out.shape[1], 8):
            zz = np.zeros(64)
            last += signed(symbol(dc))
            zz[0], k = last, 1
            while k < 64:
                run = symbol(ac)
                if run == 0:
                    break
                k += run >> 4
                if run & 15:
                    zz[k] = signed(run & 15)
                k += 1
            block = np.zeros(64)
            block[ZIGZAG] = zz * quant[table]
            out[y : y + 8, x : x + 8] = basis @ block.reshape(8, 8) @ basis.T + 128
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)[:height, :width]


def decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Frames [n, 576] of the JPEGs at ``starts`` in ``data``."""
    head = np.frombuffer(HEADER, np.uint8)
    own = (sizes > len(head)) & (data[np.minimum(starts[:, None] + np.arange(len(head)), len(data) - 1)] == head).all(axis=1)
    out = np.empty((len(starts), FRAME), np.uint8)
    for i in np.flatnonzero(~own):
        out[i] = decode_blocks(data[starts[i] : starts[i] + sizes[i]].tobytes())[::8, ::8].ravel()
    if own.any():
        first, length = starts[own] + len(head), sizes[own] - len(head) - 2
        begin = np.cumsum(length) - length
        raw = data[np.repeat(first - begin, length) + np.arange(length.sum())]
        stuffed = np.concatenate(([False], (raw[1:] == 0) & (raw[:-1] == 255)))
        stuffed[begin] = False
        five = raw[~stuffed].reshape(-1, 5).astype(np.uint64)
        word = five[:, 0] << np.uint64(32) | five[:, 1] << np.uint64(24) | five[:, 2] << np.uint64(16) | five[:, 3] << np.uint64(8) | five[:, 4]
        codes = (word[:, None] >> np.array([30, 20, 10, 0], np.uint64)) & np.uint64(1023)
        out[own] = (np.cumsum(BACK[codes.astype(np.int64)].reshape(-1, FRAME), axis=1, dtype=np.int32) + 128).astype(np.uint8)
    return out


def shot_cuts(frames: np.ndarray, clip_of: np.ndarray, window: int = 8, k: int = 3, floor: float = 0.1) -> np.ndarray:
    """Mask of the frames that begin a shot; clip_of: the file of each frame (files are adjacent).

    Everything is counted in whole numbers, so a file's shots don't depend on what lies beside it in a batch: with n
    differences before d, of sum s and square sum q, d is more than k deviations above their mean if
    n d - s > 0 and (n d - s)^2 > k^2 (n q - s^2).
    """
    n = len(frames)
    hist = np.bincount((np.arange(n)[:, None] * 16 + (frames >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    diff = np.zeros(n, np.int64)
    diff[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    new = np.concatenate(([True], clip_of[1:] != clip_of[:-1]))
    diff[new] = 0
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(new, at, 0))
    lo = np.minimum(np.maximum(first + 1, at - window), at)
    one, two = (np.concatenate(([0], np.cumsum(x))) for x in (diff, diff * diff))
    count, total, square = at - lo, one[at] - one[lo], two[at] - two[lo]
    above = count * diff - total
    return new | ((count > 1) & (above > 0) & (above * above > k * k * (count * square - total * total)) & (diff > floor * 2 * FRAME))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<first_frame:int,n_frames:int,start_s:double,end_s:double>>"


def media_rows(docs: DataFrame, with_file: bool = False, batch_bytes: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: digests of payload (read back) and file, shots as timed clips, and on request the file."""

    def rows_of(data: np.ndarray, lens: np.ndarray):
        frames_n = np.maximum(-(-lens // FRAME), 1)
        padded = np.full(int(frames_n.sum()) * FRAME, 255, np.uint8)
        end = np.cumsum(frames_n) * FRAME
        begin = end - frames_n * FRAME
        src = np.cumsum(lens) - lens
        padded[np.repeat(begin - src, lens) + np.arange(lens.sum())] = data
        chunks, offs = encode_frames(padded.reshape(-1, FRAME))
        edge = np.concatenate(([0], np.cumsum(frames_n)))
        files = [avi(chunks[offs[a] : offs[b]].tobytes(), offs[a : b + 1]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        # from here on only the stored files are read
        stored = np.frombuffer(b"".join(files), np.uint8)
        base = np.concatenate(([0], np.cumsum([len(f) for f in files])))
        index = [parse_index(f) for f in files]
        got = decode_frames(stored, np.concatenate([s + b for (s, _), b in zip(index, base[:-1], strict=True)]), np.concatenate([z for _, z in index]))
        owner = np.repeat(np.arange(len(files)), [len(z) for _, z in index])
        cuts = shot_cuts(got, owner)
        edge = np.searchsorted(owner, np.arange(len(files) + 1))
        for i, file in enumerate(files):
            own = got[edge[i] : edge[i + 1]].tobytes()
            at = [*np.flatnonzero(cuts[edge[i] : edge[i + 1]]).tolist(), int(edge[i + 1] - edge[i])]
            clips = [{"first_frame": a, "n_frames": b - a, "start_s": a / FPS, "end_s": b / FPS} for a, b in zip(at[:-1], at[1:], strict=True)]
            yield int(lens[i]), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(file), hashlib.sha256(file).hexdigest(), f"frames={at[-1]};fps={FPS};shots={len(clips)};cuts=" + ",".join(map(str, at[1:-1])), clips, file

    def run(batches):
        kind = pa.list_(pa.struct([("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind, pa.binary()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "file"]
        for b in batches:
            data, offs, _ = text_arrays(b)
            ids, null = id_arrays(b.column(0))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(offs, offs[at] + batch_bytes, side="right")) - 1)
                cols = list(zip(*rows_of(data[offs[at] : offs[to]], np.diff(offs[at : to + 1])), strict=True))
                take = 9 if with_file else 8
                out = [pa.array(c, k) for c, k in zip(cols[:take], kinds[:take], strict=True)]
                yield pa.RecordBatch.from_arrays([ids_out(ids[at:to], null[at:to]), *out], names=["doc_id", *names[:take]])
                at = to

    small_batches(docs.sparkSession)
    return plain(docs, id_col, text_col).mapInArrow(tidy(run), SCHEMA + ", file binary" * with_file)


def clip_rows(media: DataFrame) -> DataFrame:
    """(doc_id, clip, first_frame, n_frames, start_s, end_s): a row per shot of ``media_rows``."""
    return media.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.first_frame", "c.n_frames", "c.start_s", "c.end_s")
