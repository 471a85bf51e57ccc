"""Media columns: AVI files of motion JPEG.

Writing: a payload is cut into frames of 16 x 12 samples. A sample is the mean (DC) coefficient of a flat block of 8 x 8
pixels, quantised so that the pixels equal the sample; so the file is a plain baseline motion JPEG that loses nothing.
The Huffman table gives difference category s a code of 9 - s bits, hence 10 bits a block (with its end-of-block bit),
and frames can be packed and unpacked by whole arrays. Reading: the RIFF lists and the idx1 index are parsed; frames with
this table are decoded by arrays, any other baseline frame by the general decoder below (luminance). Shots: the
histogram difference of neighbouring frames is held against the differences around it (an adaptive threshold), in whole
numbers, so results never depend on rounding; a clip is a run of frames between two cuts, with its times.

Every document is by itself: a scan, one Python stage and no shuffle; memory is bounded by WORK payload bytes and one
document. A lost executor costs its running tasks.

Defined results: null text counts as empty, an empty text is one frame of spaces; texts are stored whole, up to the 4 GB that the sizes of a
RIFF file can say (texts of about 1.8 GB; a longer one raises struct.error); equal texts give equal values; repeated rows each get a row; an empty
table gives an empty result; other columns, whatever their names, are not read. A file that is no AVI or lacks an index raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table

UNIT, COLS, ROWS, FPS = 192, 16, 12, 25
#: Payload bytes that a task works on at once.
WORK = 4 << 20
#: A cut differs by CUT_LEAST samples at least, and by CUT_TIMES the mean difference of AROUND frames on either side.
CUT_LEAST, CUT_TIMES, AROUND = 32, 2, 4


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Start of each frame that is written: quantiser 8 for the DC coefficient, grey, code lengths 1 to 9 for categories 8 to 0, end of block in 1 bit.
HEAD = b"".join((
    b"\xff\xd8",
    _segment(0xDB, bytes([0, 8] + [1] * 63)),
    _segment(0xC0, struct.pack(">BHHB3B", 8, ROWS * 8, COLS * 8, 1, 1, 0x11, 0)),
    _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1)))),
    _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0])),
    _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
))
TAIL = b"\xff\xd9"


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """10-bit code of each difference -255..255; difference (plus 255) of each code without its last bit."""
    code, back = np.zeros(511, np.uint16), np.full(512, 1023, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        nine = (((1 << (9 - s)) - 2) << s) | (d if d > 0 else d + (1 << s) - 1)
        code[d + 255], back[nine] = nine << 1, d
    return code, back


CODE, BACK = _codes()


def pack(payload: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded data of all frames, and where each begins and the last ends."""
    x = payload.reshape(-1, UNIT).astype(np.int16)
    d = np.diff(x, axis=1, prepend=np.int16(128))
    v = CODE[d + 255].reshape(len(x), UNIT // 4, 4)
    out = np.empty((len(x), UNIT // 4, 5), np.uint8)
    out[..., 0] = v[..., 0] >> 2
    out[..., 1] = (v[..., 0] & 3) << 6 | v[..., 1] >> 4
    out[..., 2] = (v[..., 1] & 15) << 4 | v[..., 2] >> 6
    out[..., 3] = (v[..., 2] & 63) << 2 | v[..., 3] >> 8
    out[..., 4] = v[..., 3] & 255
    flat = out.reshape(-1)
    full = np.flatnonzero(flat == 255)
    ends = np.cumsum(UNIT * 10 // 8 + np.bincount(full // (UNIT * 10 // 8), minlength=len(x)))
    return np.insert(flat, full + 1, 0).tobytes(), np.concatenate([[0], ends])


def unpack(entropy: bytes) -> np.ndarray:
    """Samples of frames that pack() made, from their joined entropy-coded data."""
    flat = np.frombuffer(entropy, np.uint8)
    full = np.flatnonzero(flat[:-1] == 255)
    keep = np.ones(len(flat), bool)
    keep[full + 1] = False
    b = flat[keep].reshape(-1, UNIT // 4, 5).astype(np.uint16)
    v = np.empty((len(b), UNIT // 4, 4), np.uint16)
    v[..., 0] = b[..., 0] << 2 | b[..., 1] >> 6
    v[..., 1] = (b[..., 1] & 63) << 4 | b[..., 2] >> 4
    v[..., 2] = (b[..., 2] & 15) << 6 | b[..., 3] >> 2
    v[..., 3] = (b[..., 3] & 3) << 8 | b[..., 4]
    d = BACK[v.reshape(-1, UNIT) >> 1]
    if (v & 1).any() or (d == 1023).any():
        raise ValueError("not a frame of this table")
    return (np.cumsum(d, axis=1) + 128).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi(frames: list[bytes], sizes: np.ndarray) -> bytes:
    """frames: whole chunks; sizes: of their bodies."""
    n, most = len(frames), int(sizes.max(initial=0))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, COLS * 8, ROWS * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, COLS * 8, ROWS * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, COLS * 8, ROWS * 8, 1, 24, b"MJPG", COLS * ROWS * 192, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index = np.empty((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    index[:, 2] = 4 + np.concatenate([[0], np.cumsum(8 + sizes + (sizes & 1))[:-1]])
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(frames)) + _chunk(b"idx1", index.tobytes()))


def payload_of(text: str | bytes | None) -> bytes:
    """UTF-8, filled with spaces to a positive multiple of UNIT."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def write_all(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload."""
    entropy, ends = pack(np.frombuffer(b"".join(payloads), np.uint8))
    sizes = np.diff(ends) + len(HEAD) + len(TAIL)
    heads = {int(s): b"00dc" + struct.pack("<I", s) + HEAD for s in np.unique(sizes)}
    tails = (TAIL, TAIL + b"\0")
    at, size = ends.tolist(), sizes.tolist()
    frames = [heads[s] + entropy[a:b] + tails[s & 1] for s, a, b in zip(size, at, at[1:], strict=False)]
    out, first = [], 0
    for p in payloads:
        n = len(p) // UNIT
        out.append(_avi(frames[first : first + n], sizes[first : first + n]))
        first += n
    return out


def parse(data: bytes) -> tuple[dict, np.ndarray]:
    """Header values, and (start, size) of every video frame by the idx1 index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    head: dict = {}
    movi, index = -1, None
    stack = [(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                else:
                    stack.append((at + 12, at + 8 + size))
            elif name == b"avih":
                head |= dict(zip(("frame_us", "frames", "width", "height"), (struct.unpack_from("<14I", data, at + 8)[k] for k in (0, 4, 8, 9)), strict=True))
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
            at += 8 + size + (size & 1)
    if movi < 0 or index is None or not head:
        raise ValueError("no frames, index or header")
    video = index[(index[:, 0] >> 16) & 0xFFFF == int.from_bytes(b"dc", "little")]
    return head, np.stack([video[:, 2].astype(np.int64) + movi + 8, video[:, 3].astype(np.int64)], axis=1)


def read_all(files: list[bytes]) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """Headers, samples of all frames, and the number of frames of each file; for files of write_all()."""
    heads, counts, parts = [], [], []
    n = len(HEAD)
    for data in files:
        head, at = parse(data)
        for start, size in at.tolist():
            if not data.startswith(HEAD, start):
                raise ValueError("frame of another table: use decode_frame()")
            parts.append(data[start + n : start + size - 2])
        heads.append(head)
        counts.append(len(at))
    return heads, unpack(b"".join(parts)) if parts else np.empty((0, UNIT), np.uint8), np.array(counts)


#: Order of the coefficients of a block, by diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_U = np.arange(8)
COSINE = np.sqrt(np.where(_U == 0, 1, 2) / 8)[:, None] * np.cos((2 * _U[None, :] + 1) * _U[:, None] * np.pi / 16)


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Luminance of a baseline JPEG image, as rows of pixels."""
    at, quant, huff, restart, frame = 2, {}, {}, 0, None
    while True:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                code, k, found = 0, 17, {}
                for bits in range(1, 17):
                    for _ in range(body[bits]):
                        found[bits, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huff[body[0]], body = found, body[k:]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack(">HH", body[1:5])
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline frames are decoded")
    most_h, most_v = max(f[1] for f in frame), max(f[2] for f in frame)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    runs = []
    data = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    start = k = 0
    while (k := data.find(b"\xff", k)) >= 0:
        if 0xD0 <= data[k + 1] <= 0xD7:
            runs.append(data[start:k])
            start = k + 2
        k += 2
    runs.append(data[start:])
    runs = [np.unpackbits(np.frombuffer(r.replace(b"\xff\0", b"\xff"), np.uint8)).tolist() for r in runs]
    first_h, first_v = frame[0][1], frame[0][2]
    blocks = np.zeros((down * first_v, across * first_h, 64), np.int64)
    bits, p, before = runs[0], 0, [0] * len(frame)

    def symbol(found: dict) -> int:
        nonlocal p
        code = 0
        for n in range(1, 17):
            code = code << 1 | bits[p]
            p += 1
            if (n, code) in found:
                return found[n, code]
        raise ValueError("no such code")

    def value(n: int) -> int:
        nonlocal p
        v = 0
        for _ in range(n):
            v = v << 1 | bits[p]
            p += 1
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            bits, p, before = runs[mcu // restart], 0, [0] * len(frame)
        for c, (ident, h, v, _) in enumerate(frame):
            dc, ac = huff[tables[ident] >> 4], huff[16 | tables[ident] & 15]
            for b in range(h * v):
                coded = np.zeros(64, np.int64)
                before[c] += value(symbol(dc))
                coded[0] = before[c]
                k = 1
                while k < 64:
                    s = symbol(ac)
                    if s & 15:
                        k += s >> 4
                        coded[k] = value(s & 15)
                        k += 1
                    elif s == 0xF0:
                        k += 16
                    else:
                        break
                if c == 0:
                    blocks[mcu // across * v + b // h, mcu % across * h + b % h] = coded
    plain = np.zeros_like(blocks)
    plain[..., ZIGZAG] = blocks * quant[frame[0][3]]
    pixels = np.einsum("ux,rcuv,vy->rxcy", COSINE, plain.reshape(*blocks.shape[:2], 8, 8), COSINE)
    pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
    return pixels.reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)[:height, :width]


def clips(samples: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each file the first frames of its clips."""
    n = len(samples)
    held = np.bincount((np.arange(n)[:, None] * 16 + (samples >> 4)).ravel(), minlength=16 * n).reshape(n, 16)
    differ = np.zeros(n + 1, np.int64)
    differ[1:n] = np.abs(np.diff(held, axis=0)).sum(axis=1)
    ends = np.cumsum(counts)
    starts = ends - counts
    differ[starts] = 0  # a file's first frame differs from none
    sums = np.concatenate([[0], np.cumsum(differ)])
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(n)
    low, high = np.maximum(at - AROUND, starts[owner] + 1), np.minimum(at + AROUND + 1, ends[owner])
    others, around = high - low - 1, sums[np.maximum(high, low)] - sums[low] - differ[:n]
    cut = (differ[:n] >= CUT_LEAST) & (differ[:n] * np.maximum(others, 1) > CUT_TIMES * around) & (at > starts[owner])
    cut[starts[counts > 0]] = True
    first = np.flatnonzero(cut)
    return [first[a:b] - s for a, b, s in zip(np.searchsorted(first, starts), np.searchsorted(first, ends), starts, strict=True)]


def _parts(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or b"") + UNIT
        if size >= WORK:
            yield part
            part, size = [], 0
    if part:
        yield part


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: an AVI file for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in _parts(batch.column(1).cast(pa.binary()).to_pylist()):
                files = write_all([payload_of(t) for t in part])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(files, pa.binary())], ["doc_id", "media"])
                done += len(part)

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """A row for each clip of each file in (doc_id, media): clip, first and last frame, start and end in ms, mean luminance in thousandths. Frames may be any baseline JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                head, at = parse(data)
                try:
                    samples = read_all([data])[1]
                except ValueError:
                    samples = np.stack([decode_frame(data[a : a + s]).ravel() for a, s in at.tolist()])
                first = clips(samples, np.array([len(samples)]))[0].tolist()
                for k, (a, b) in enumerate(zip(first, [*first[1:], len(samples)], strict=True)):
                    rows.append((doc, k, a, b - 1, a * head["frame_us"] // 1000, b * head["frame_us"] // 1000, int(samples[a:b].sum(dtype=np.int64)) * 1000 // samples[a:b].size))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, list(CLIP))

    return mapped(media.select("doc_id", "media"), run, ", ".join(f"{c} long" for c in CLIP))


CLIP = ("doc_id", "clip", "first_frame", "last_frame", "start_ms", "end_ms", "luma_thousandths")


def stored_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as an AVI file, read back through its index, and what was read as digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in _parts(batch.column(1).cast(pa.binary()).to_pylist()):
                files = write_all([payload_of(t) for t in part])
                heads, samples, counts = read_all(files)
                firsts, flat, out, at = clips(samples, counts), samples.tobytes(), [], 0
                luma = np.add.reduceat(samples.sum(axis=1, dtype=np.int64), np.cumsum(counts) - counts).tolist()
                for t, data, head, n, first, light in zip(part, files, heads, counts.tolist(), firsts, luma, strict=True):
                    back = flat[at : at + n * UNIT]
                    at += n * UNIT
                    longest = int(np.diff(np.append(first, n)).max())
                    feature = f"{head['width']}x{head['height']}/{head['frame_us']}us frames={n} clips={len(first)} longest={longest} luma={light * 1000 // (n * UNIT)} cuts={zlib.crc32(first.astype('<i8').tobytes()):08x}"
                    out.append((len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), *(pa.array(x) for x in zip(*out, strict=True))], DIGESTS)
                done += len(part)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


DIGESTS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op9_avi(spark, sf_dir: str) -> DataFrame:
    """Every whole document stored as motion JPEG and read back."""
    return stored_digests(table(spark, sf_dir, "documents"))
