"""Media columns: AVI files of motion-JPEG frames, written, read back and cut into timed clips.

`store_avi` keeps a text's bytes, padded with 255 to a positive multiple of 576, as grey 192 x 192
frames. Each byte is one 8 x 8 block of even brightness; with a quantiser of 8 for the mean, block
means of 8-bit samples survive baseline JPEG exactly, so any decoder gives the bytes back. Frames
are Huffman-coded baseline JPEG (DC differences, end of block), indexed by an idx1 chunk.

`read_clips` parses the RIFF chunks and the index, decodes the frames (baseline, 8-bit, any number of
components with their sampling, restart intervals, Huffman tables as given in the frame) to the block means of the
first component, the brightness, and detects shots: a cut is where the histogram difference of neighbouring frames
exceeds the mean of the differences in a window around it by `FACTOR` standard deviations and `FLOOR`. It yields clip
rows with times. A null file, and one that can't be read whole (not AVI, broken or other frames, frames of different
sizes), has null digests of what is read back and no clips; a file without frames has an empty payload and no clips.

All symbols of all frames of a slice are coded, and read, side by side with numpy: reading advances one
symbol in every frame at a time. Nulls and empty texts are one frame of 255. Equal texts give equal
media. A text is handled whole, in slices of bounded bytes; only a longer text is a slice of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common

SIDE, BLOCK, FRAME, FPS = 24, 8, 576, 25
WINDOW, FACTOR, FLOOR, BINS = 8, 2.0, 0.25, 32

# fixed values: code lengths of the DC sizes 0 to 11 and of the one AC symbol used, end of block
_DC_COUNTS = [0, 1, 3, 3, 2, 1, 1, 1]  # codes of 1, 2, ... 8 bits
_DC_SYMBOLS = [5, 4, 3, 6, 2, 0, 7, 1, 8, 9, 10, 11]
_AC_COUNTS, _AC_SYMBOLS = [1], [0]
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, bits), by the canonical rule."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, bits)
            code += 1
            at += 1
        code <<= 1
    return out


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, mark, len(body) + 2) + body


def _table(kind: int, counts: list[int], symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(counts + [0] * (16 - len(counts))) + bytes(symbols))


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE * BLOCK, SIDE * BLOCK, 1) + b"\1\x11\0")
    + _table(0x00, _DC_COUNTS, _DC_SYMBOLS)
    + _table(0x10, _AC_COUNTS, _AC_SYMBOLS)
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def frames_of(payload: np.ndarray) -> list[bytes]:
    """JPEG frames of a payload whose length is a multiple of FRAME."""
    level = payload.reshape(-1, FRAME).astype(np.int32) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = np.zeros(1024, np.int64)
    for s in range(1, 11):
        size[1 << (s - 1) : 1 << s] = s
    n = size[np.abs(diff)]
    codes = _codes(_DC_COUNTS, _DC_SYMBOLS)
    code, bits = (np.array([codes[s][i] for s in range(12)], np.int64) for i in (0, 1))
    eob, eob_bits = _codes(_AC_COUNTS, _AC_SYMBOLS)[0]
    extra = np.where(diff < 0, diff + (1 << n) - 1, diff)
    value = ((code[n] << n | extra) << eob_bits) | eob  # at most 8 + 9 + 1 bits
    width = bits[n] + n + eob_bits
    end = np.cumsum(width, axis=1)
    total = end[:, -1]
    room = int(-(-total.max() // 8)) + 4
    out = np.zeros((len(level), room), np.uint8)
    start = end - width
    shifted = (value.astype(np.uint64) << (32 - width - (start & 7)).astype(np.uint64)).astype(np.uint64)
    flat = out.ravel()
    base = (start >> 3) + np.arange(len(level))[:, None] * room
    # neighbours share at most one byte each, and bits never overlap: sums are unions
    acc = np.zeros(flat.size, np.int64)
    for k in range(4):
        acc += np.bincount((base + k).ravel(), ((shifted >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64).ravel(), flat.size).astype(np.int64)
    out = acc.astype(np.uint8).reshape(len(level), room)
    length = -(-total // 8)
    pad = (length * 8 - total).astype(np.int64)
    rows = np.arange(len(level))
    out[rows, length - 1] |= ((1 << pad) - 1).astype(np.uint8)
    return [_HEAD + r[:m].tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for r, m in zip(out, length.tolist(), strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_of(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames, with an index."""
    w = SIDE * BLOCK
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, w, w, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, w, w)
    look = struct.pack("<IiiHH4sIiiII", 40, w, w, 1, 24, b"MJPG", w * w * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", look)))
    body, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        c = _chunk(b"00dc", f)
        body.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + n, end)
        at += 8 + n + (n & 1)


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, the JPEG frames by the index; by their chunks if there is no index)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index = float(FPS), None, None
    for name, s, e in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[s : s + 4] == b"hdrl":
            for n2, s2, _ in _chunks(data, s + 4, e):
                if n2 == b"avih":
                    rate = 1e6 / max(struct.unpack_from("<I", data, s2)[0], 1)
        elif name == b"LIST" and data[s : s + 4] == b"movi":
            movi = (s, e)
        elif name == b"idx1":
            index = (s, e)
    if movi is None:
        return rate, []
    if index is None:
        return rate, [data[s:e] for n, s, e in _chunks(data, movi[0] + 4, movi[1]) if n[2:] in (b"dc", b"db")]
    entries = [struct.unpack_from("<4sIII", data, a) for a in range(index[0], index[1] - 15, 16)]
    # offsets count from the list's type, in some files from the start of the file
    shift = movi[0] if not entries or data[movi[0] + entries[0][2] :][:4] == entries[0][0] else 0
    return rate, [data[shift + o + 8 : shift + o + 8 + n] for name, _, o, n in entries if name[2:] in (b"dc", b"db")]


def _jpeg_head(frame: bytes) -> tuple[bytes, int]:
    """(the segments before the entropy-coded data, where that begins)."""
    at = 2
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        mark, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        at += 2 + n
        if mark == 0xDA:
            return frame[:at], at


_BROKEN = (ValueError, IndexError, KeyError, struct.error)


def _frames_in(media: bytes | None) -> tuple[float, list[tuple[bytes, bytes]]] | None:
    """(frames a second, (frame, its segments) of each); None if the file can't be taken apart."""
    try:
        rate, frames = parse_avi(media or b"")
        return rate, [(f, _jpeg_head(f)[0]) for f in frames]
    except _BROKEN:
        return None


class Head:
    """What a frame's segments say: its size, and of each component of its scan the sampling, the quantiser of the
    mean and the Huffman lookups (16 bits ahead: symbol << 5 | bits of its code)."""

    def __init__(self, head: bytes) -> None:
        at, quants, tables, shape, parts = 2, {}, {}, None, {}
        self.restart, self.scan = 0, []
        while at < len(head):
            mark, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
            body = head[at + 4 : at + 2 + n]
            i = 0
            if mark == 0xDB:
                while i < len(body):
                    wide = body[i] >> 4
                    quants[body[i] & 15] = struct.unpack_from(">H", body, i + 1)[0] if wide else body[i + 1]
                    i += 65 + 64 * wide
            elif mark == 0xC0:
                shape = struct.unpack_from(">HH", body, 1)
                if body[0] != 8:
                    raise ValueError("only 8-bit frames")
                parts = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)}
            elif mark == 0xC4:
                while i < len(body):
                    counts = list(body[i + 1 : i + 17])
                    lookup = np.zeros(1 << 16, np.int32)
                    for symbol, (code, bits) in _codes(counts, list(body[i + 17 : i + 17 + sum(counts)])).items():
                        lookup[code << (16 - bits) : (code + 1) << (16 - bits)] = symbol << 5 | bits
                    tables[body[i]] = lookup
                    i += 17 + sum(counts)
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif mark == 0xDA:
                for j in range(body[0]):
                    across, down, q = parts[body[1 + 2 * j]]
                    use = body[2 + 2 * j]
                    self.scan.append((across, down, quants[q], tables[use >> 4], tables[0x10 | use & 15]))
            elif 0xC1 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
                raise ValueError("only baseline frames")
            at += 2 + n
        if shape is None or 0 in shape or len(self.scan) != len(parts):
            raise ValueError("no frame, or its components in several scans")
        self.height, self.width = shape
        if len(self.scan) == 1:  # a scan of one component has its blocks in plain order
            self.scan = [(1, 1, *self.scan[0][2:])]
        self.most = max(c[0] for c in self.scan), max(c[1] for c in self.scan)

    def order(self):
        """(component, row and column of its block) of all blocks of the scan; None where an interval may end."""
        across, down = (-(-n // (8 * m)) for n, m in zip((self.width, self.height), self.most, strict=True))
        for unit in range(across * down):
            if unit and self.restart and unit % self.restart == 0:
                yield None
            for c, (h, v, *_) in enumerate(self.scan):
                for i in range(v * h):
                    yield c, unit // across * v + i // h, unit % across * h + i % h


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(block means of the first component of frames with equal segments, [frame, block], as 8-bit samples; whether
    each frame could be read whole)."""
    segments, at = _jpeg_head(frames[0])
    head = Head(segments)
    h, v = head.scan[0][:2]
    rows, across = (-(-n * s // (8 * m)) for n, s, m in ((head.height, v, head.most[1]), (head.width, h, head.most[0])))
    scans = [f[at : len(f) - 2 if f.endswith(b"\xff\xd9") else len(f)].replace(b"\xff\0", b"\xff") for f in frames]
    starts = np.concatenate(([0], np.cumsum([len(s) + 8 for s in scans])))
    ends = starts[:-1] * 8 + np.array([len(s) * 8 for s in scans])
    pad = np.frombuffer(b"".join(s + b"\0" * 8 for s in scans) + b"\0" * 8, np.uint8).astype(np.int64)
    word = pad[:-4] << 32 | pad[1:-3] << 24 | pad[2:-2] << 16 | pad[3:-1] << 8 | pad[4:]  # 40 bits from each byte on
    position = starts[:-1] * 8
    last = np.int64(len(word) * 8 - 1)
    level = np.zeros((len(head.scan), len(frames)), np.int64)
    whole = np.ones(len(frames), bool)
    out = np.zeros((len(frames), rows * across), np.int64)
    for step in head.order():
        if step is None:  # the next interval begins at a byte, behind a marker of two
            position = np.minimum((position + 7 >> 3) + 2 << 3, last)
            level[:] = 0
            continue
        c, row, column = step
        _, _, _, dc, ac = head.scan[c]
        ahead = word[position >> 3] << (position & 7) & 0xFFFFFFFFFF
        entry = dc[ahead >> 24]
        used, n = entry & 31, entry >> 5
        whole &= used > 0
        v = ahead >> (40 - used - n) & (1 << n) - 1
        level[c] += np.where((n > 0) & (v < (1 << n) >> 1), v - (1 << n) + 1, v)
        if c == 0 and row < rows and column < across:
            out[:, row * across + column] = level[0]
        position = np.minimum(position + used + n, last)
        open_, k = None, None
        while open_ is None or len(open_):  # AC symbols, until each block has ended; they don't touch the mean
            p = position if open_ is None else position[open_]
            entry = ac[(word[p >> 3] << (p & 7) & 0xFFFFFFFFFF) >> 24]
            symbol, bits = entry >> 5, entry & 31
            on = np.minimum(p + bits + (symbol & 15), last)
            if open_ is None:
                whole &= bits > 0
                position = on
                if not symbol.any():
                    break
                open_ = np.flatnonzero(symbol)
                k = (symbol[open_] >> 4) + 2
            else:
                whole[open_[bits == 0]] = False
                position[open_] = on
                k += (symbol >> 4) + 1
                open_, k = open_[symbol != 0], k[symbol != 0]
            open_, k = open_[k < 64], k[k < 64]
    whole &= position <= ends
    return np.clip((out * int(head.scan[0][2]) + 4) // 8 + 128, 0, 255).astype(np.uint8), whole


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end) of each shot."""
    n = len(samples)
    if n == 0:
        return []
    bins = samples.astype(np.int64) * BINS // 256 + np.arange(n)[:, None] * BINS
    h = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS) / samples.shape[1]
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    cuts = [0]
    if len(d):
        total, square = np.concatenate(([0], np.cumsum(d))), np.concatenate(([0], np.cumsum(d * d)))
        i = np.arange(len(d))
        lo, hi = np.maximum(i - WINDOW, 0), np.minimum(i + WINDOW + 1, len(d))
        mean = (total[hi] - total[lo]) / (hi - lo)
        sd = np.sqrt(np.maximum((square[hi] - square[lo]) / (hi - lo) - mean**2, 0))
        cuts += (np.flatnonzero((d > mean + FACTOR * sd) & (d > FLOOR)) + 1).tolist()
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def store_avi(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the AVI file of every text."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = common.raw(part.column(1))
        size = np.diff(at)
        padded = np.maximum(-(-size // FRAME), 1) * FRAME
        ends = np.cumsum(padded)
        payload = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
        payload[np.arange(len(data)) + np.repeat(ends - padded - at[:-1], size)] = data
        frames = frames_of(payload)
        cuts = np.concatenate(([0], ends // FRAME))
        return common.batch_of({"doc_id": (part.column(0), None), "n_bytes": (size, pa.int64()), "media": ([avi_of(frames[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return common.map_rows(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_clips(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Per file: digests of what is read back, and its clips (clip, first_frame, end_frame, start_s, end_s)."""
    files = files.select(F.col(id_col).alias("doc_id"), "n_bytes", F.col(media_col).alias("media"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        media = part.column(2).to_pylist()
        parsed = [_frames_in(m) for m in media]
        # frames of equal segments are read side by side
        by_head: dict[bytes, list[tuple[int, int]]] = {}
        for i, found in enumerate(parsed):
            for j, (_, head) in enumerate(found[1] if found else ()):
                by_head.setdefault(head, []).append((i, j))
        samples: list[dict[int, np.ndarray]] = [{} for _ in media]
        for places in by_head.values():
            try:
                got, whole = decode_frames([parsed[i][1][j][0] for i, j in places])
            except _BROKEN:
                continue
            for (i, j), row, good in zip(places, got, whole.tolist(), strict=True):
                if good:
                    samples[i][j] = row
        rows = []
        for m, found, own in zip(media, parsed, samples, strict=True):
            stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
            n = len(found[1]) if found else 0
            if found is None or len(own) < n or len({len(x) for x in own.values()}) > 1:
                rows.append((None, None, None, *stored, []))
                continue
            x = np.stack([own[j] for j in range(n)]) if n else np.zeros((0, 1), np.uint8)
            payload = x.tobytes()
            clips = [{"clip": c, "first_frame": a, "end_frame": b, "start_s": a / found[0], "end_s": b / found[0]} for c, (a, b) in enumerate(shots(x))]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, clips))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), _CLIPS)
        return common.batch_of({"doc_id": (part.column(0), None), "n_bytes": (part.column(1), None)} | {n: ([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)})

    kind = files.schema["doc_id"].dataType.simpleString()
    clip = "struct<clip: int, first_frame: int, end_frame: int, start_s: double, end_s: double>"
    return common.map_rows(files, run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<{clip}>", "media")


_CLIPS = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def clip_rows(files: DataFrame) -> DataFrame:
    """A row a clip: (doc_id, clip, first_frame, end_frame, start_s, end_s)."""
    return read_clips(files).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_clips(store_avi(common.table(spark, sf_dir, "documents")))
    feature = F.array_join(F.transform("clips", lambda c: F.format_string("%d:%d-%d", c.clip, c.first_frame, c.end_frame)), ",")
    return read.withColumn("feature", feature).drop("clips")
