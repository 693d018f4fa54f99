"""FLAC in numpy: media columns are decoded to PCM blocks and text payloads are stored.

Frames are worked on side by side.  The decoder finds frames by their sync codes and
header checksums, then reads the Rice codes of many frames in lockstep (one vector
operation reads one sample of every frame), undoes fixed and quantised linear predictors,
and compares each frame's CRC-16 and the stream's MD5.  It reads any channel layout and
sample size up to 24 bits; the encoder writes mono 8-bit streams with constant, verbatim
and fixed-predictor subframes and a seek table.

Nulls and empty texts give the padding alone (576 bytes of 255); equal texts give equal
values; a stream that is cut or damaged gives ``ok`` false and the blocks before the
damage; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

BLOCK = 576
#: Frames that are worked on at a time, frames between seek points, Rice partitions of a frame (log 2).
LANES, SEEK_EVERY, PARTS = 2048, 16, 2
RATE = 8000


def _crc_table(width: int, poly: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for value in range(256):
        crc = value << (width - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ (poly if crc & top else 0)) & mask
        out.append(crc)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_CLZ16 = np.array([16] + [16 - v.bit_length() for v in range(1, 1 << 16)], np.uint8)


def crc_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """CRC of each data[start:end]; ranges advance together, aligned at their ends.

    The register starts at 0, so leading zero bytes change nothing.
    """
    table, crc = (CRC8 if width == 8 else CRC16), np.zeros(len(start), np.uint32)
    longest = int((end - start).max(initial=0))
    shift, mask = np.uint32(width - 8), np.uint32((1 << width) - 1)
    for back in range(longest, 0, -1):
        at = end - back
        byte = np.where(at >= start, data[np.maximum(at, 0)], 0)
        crc = table[(crc >> shift) ^ byte] ^ ((crc << np.uint32(8)) & mask) if width > 8 else table[crc ^ byte]
    return crc


def _utf8_number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([(0xFF ^ (room << 1 | 1)) & 0xFF | n, *reversed(tail)])


# ---------------------------------------------------------------- encoder


def _encode_frames(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of the rows of samples (frames, BLOCK), int16 of 8-bit values."""
    count = len(samples)
    best, order, u = None, np.zeros(count, np.int64), np.zeros((count, BLOCK), np.int32)
    diff = samples.astype(np.int32)
    for o in range(5):  # fixed predictor of order o leaves the o-th differences
        cost = np.abs(diff).sum(1) + 8 * o
        take = np.ones(count, bool) if best is None else cost < best
        best = cost if best is None else np.where(take, cost, best)
        order[take] = o
        u[take, :o] = 0
        u[take, o:] = (diff[take] << 1) ^ (diff[take] >> 31)
        diff = np.diff(diff, axis=1)
    parts = 1 << PARTS
    by_part = u.reshape(count, parts, -1)
    size = np.full((count, parts), BLOCK // parts)
    size[:, 0] -= order
    bits = np.stack([(by_part >> k).sum(2) + size * (k + 1) for k in range(10)])
    k, coded = bits.argmin(0), bits.min(0).sum(1)
    flat = samples.min(1) == samples.max(1)
    body = np.where(flat, 8 + 8, np.where(8 + 8 * order + 6 + 4 * parts + coded >= 8 + 8 * BLOCK, 8 + 8 * BLOCK, 8 + 8 * order + 6 + 4 * parts + coded))
    verbatim, fixed = ~flat & (body == 8 + 8 * BLOCK), None
    fixed = ~flat & ~verbatim
    heads = [b"\xff\xf8\x24\x02" + _utf8_number(n) for n in numbers]  # 576 samples, 8 kHz, mono, 8 bits
    head_len = np.array([len(h) + 1 for h in heads])
    total = head_len + (body + 7) // 8 + 2
    end = np.cumsum(total)
    start = end - total
    joined = np.frombuffer(b"".join(h + b"\0" for h in heads), np.uint8)
    head_at = np.cumsum(head_len) - head_len
    check = crc_ranges(joined, head_at, head_at + head_len - 1, 8)
    stream = np.zeros(8 * int(end[-1]), np.uint8)  # one byte a bit
    at = 8 * (start + head_len)  # of the subframe

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            stream[where + j] = (value >> (width - 1 - j)) & 1

    put(at, np.where(flat, 0, np.where(verbatim, 1, 8 + order)) << 1, 8)
    raw = samples.astype(np.int64) & 0xFF
    put(at[flat] + 8, raw[flat, 0], 8)
    put((at[verbatim, None] + 8 + 8 * np.arange(BLOCK)).ravel(), raw[verbatim].ravel(), 8)
    for o in range(5):
        rows = np.flatnonzero(fixed & (order == o))
        if not len(rows):
            continue
        where = at[rows] + 8
        for j in range(o):
            put(where + 8 * j, raw[rows, j], 8)
        where = where + 8 * o
        put(where, np.full(len(rows), PARTS), 6)  # 4-bit parameters, 2**PARTS partitions
        where = where + 6
        code, rice = u[rows][:, o:], np.repeat(k[rows], BLOCK // parts, axis=1)[:, o:]
        quotient = code >> rice
        length = quotient + 1 + rice
        length[:, [0, *(np.arange(1, parts) * (BLOCK // parts) - o)]] += 4  # each partition opens with its parameter
        stop = np.cumsum(length, axis=1) - 1 - rice + where[:, None]
        first = np.concatenate([[0], np.arange(1, parts) * (BLOCK // parts) - o])
        put((stop[:, first] - quotient[:, first] - 4).ravel(), k[rows].ravel(), 4)
        stream[stop] = 1
        for width in range(1, int(rice.max(initial=0)) + 1):
            has = rice >= width  # bit `width` from the right of the remainder
            place = stop[has] + 1 + rice[has] - width
            stream[place] = (code[has] >> (width - 1)) & 1
    packed = np.packbits(stream)
    spread = np.repeat(start - head_at, head_len) + np.arange(len(joined))
    packed[spread] = joined
    packed[start + head_len - 1] = check
    crc = crc_ranges(packed, start, end - 2, 16)
    packed[end - 2], packed[end - 1] = crc >> 8, crc & 0xFF
    data = packed.tobytes()
    return [data[a:b] for a, b in zip(start, end, strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload (length a positive multiple of BLOCK), bytes as 8-bit samples."""
    counts = [len(p) // BLOCK for p in payloads]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int16) - 128
    numbers = [n for c in counts for n in range(c)]
    frames: list[bytes] = []
    for i in range(0, len(samples), LANES):
        frames += _encode_frames(samples[i : i + LANES], numbers[i : i + LANES])
    out, at = [], 0
    for payload, count in zip(payloads, counts, strict=True):
        own, at = frames[at : at + count], at + count
        sizes = [len(f) for f in own]
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        offset = np.concatenate([[0], np.cumsum(sizes)])
        points = b"".join((n * BLOCK).to_bytes(8, "big") + int(offset[n]).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for n in range(0, count, SEEK_EVERY))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


# ---------------------------------------------------------------- decoder


@dataclass
class Stream:
    """What a decoded stream holds: PCM samples (channels, n) and where its blocks start."""

    rate: int = 0
    bits: int = 0
    samples: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.int32))
    offsets: list[int] = field(default_factory=list)  # first sample of each block
    seek: list[tuple[int, int, int]] = field(default_factory=list)  # sample, byte offset, samples
    ok: bool = False
    error: str = ""


@dataclass
class Frame:
    start: int
    body: int  # first byte of the first subframe
    end: int
    size: int
    layout: int
    bits: int
    number: int
    variable: bool


_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
_CRC8, _CRC16 = CRC8.tolist(), CRC16.tolist()


def _header(data: bytes, at: int, bits: int) -> Frame | None:
    """The frame header at a place, if its checksum and fields hold."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size_code, rate_code, layout, bit_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if size_code == 0 or rate_code == 15 or layout > 10 or bit_code in (3, 7):
        return None
    p = at + 4
    more = 0
    while more < 7 and data[p] & (0x80 >> more):
        more += 1
    if more == 1 or p + max(more, 1) + 5 > len(data):
        return None
    number = data[p] & (0x7F >> more)
    for byte in data[p + 1 : p + max(more, 1)]:
        if byte & 0xC0 != 0x80:
            return None
        number = number << 6 | byte & 0x3F
    p += max(more, 1)
    size = _SIZES.get(size_code, 0)
    if size_code in (6, 7):
        size, p = int.from_bytes(data[p : p + size_code - 5], "big") + 1, p + size_code - 5
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if p >= len(data):
        return None
    crc = 0
    for byte in data[at:p]:
        crc = _CRC8[crc ^ byte]
    return Frame(at, p + 1, 0, size, layout, _BITS.get(bit_code, bits), number, bool(data[at + 1] & 1)) if crc == data[p] else None


def _open(data: bytes) -> tuple[Stream, bytes, int, int]:
    """The stream's metadata: (stream, MD5, samples told, first frame's place)."""
    out = Stream()
    if data[:4] != b"fLaC":
        out.error = "no FLAC marker"
        return out, b"", 0, len(data)
    at, md5, told, last = 4, b"", 0, False
    while not last and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block, at = data[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0 and len(block) == 34:
            packed = int.from_bytes(block[10:18], "big")
            out.rate, out.bits, told, md5 = packed >> 44, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1), block[18:34]
        elif kind == 3:
            points = [(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big"), int.from_bytes(block[i + 16 : i + 18], "big")) for i in range(0, len(block) - 17, 18)]
            out.seek = [p for p in points if p[0] != 0xFFFFFFFFFFFFFFFF]
    if not out.bits:
        out.error = "no STREAMINFO"
    return out, md5, told, at


class _Bits:
    """64 bits from any bit place of a buffer, for many places at once."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + b"\0" * 16, np.uint8)
        self.words = np.zeros(len(raw) - 7, np.uint64)
        for j in range(8):
            self.words |= raw[j : len(raw) - 7 + j].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.top = len(self.words) - 1

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(at >> 3, self.top)] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned, up to 57 bits; width 0 reads 0."""
        width = np.asarray(width, np.uint64)
        return np.where(width > 0, self.window(at) >> np.minimum(np.uint64(64) - width, np.uint64(63)), 0).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        value, width = self.read(at, width), np.asarray(width, np.int64)
        return np.where((width > 0) & (value >> np.maximum(width - 1, 0) & 1 == 1), value - (np.int64(1) << width), value)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one bit."""
        zeros = _CLZ16[(self.window(at) >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        more = np.flatnonzero(zeros == 16)
        while len(more):
            step = _CLZ16[(self.window(at[more] + zeros[more]) >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            zeros[more] += step
            more = more[(step == 16) & ((at[more] + zeros[more]) >> 3 < self.top)]
        return zeros


def _residuals(bits: _Bits, at: np.ndarray, order: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rice-coded residuals (size - order, lanes) of lanes of one order, and where they end."""
    method, split = bits.read(at, 2), bits.read(at + 2, 4)
    at = at + 6
    out = np.zeros((size, len(at)), np.int32)
    for depth in np.unique(split):
        lanes = np.flatnonzero(split == depth)
        place, wide = at[lanes], 4 + method[lanes]
        per = size >> int(depth)
        for part in range(1 << int(depth)):
            k = bits.read(place, wide)
            place = place + wide
            raw = k == (1 << wide) - 1
            width = np.where(raw, bits.read(place, 5), 0)
            place = place + 5 * raw
            k64 = np.where(raw, 0, k).astype(np.uint64)
            plain, some = not raw.any(), k64 > 0
            shift = np.minimum(np.uint64(64) - k64, np.uint64(63))
            for i in range(max(part * per, order), (part + 1) * per):
                window = bits.window(place)
                zeros = _CLZ16[(window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                if zeros.max() >= 16:
                    zeros = bits.unary(place)
                    rest = np.where(some, bits.window(place + zeros + 1) >> shift, 0).astype(np.int64)
                else:
                    rest = np.where(some, (window << (zeros + 1).astype(np.uint64)) >> shift, 0).astype(np.int64)
                code = (zeros << k64.astype(np.int64)) | rest
                value = (code >> 1) ^ -(code & 1)
                step = zeros + 1 + k64.astype(np.int64)
                if not plain:
                    value, step = np.where(raw, bits.signed(place, width), value), np.where(raw, width, step)
                out[i, lanes] = value
                place = place + step
        at[lanes] = place
    return out[order:], at


def _subframes(bits: _Bits, at: np.ndarray, depth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One subframe of every lane: samples (size, lanes) and where it ends."""
    head = bits.read(at, 8)
    kind, at = head >> 1 & 63, at + 8
    wasted = np.where(head & 1, bits.unary(at) + 1, 0)
    at, depth = at + wasted, depth - wasted
    out = np.zeros((size, len(at)), np.int64)
    for code in np.unique(kind):
        lanes = np.flatnonzero(kind == code)
        place, wide = at[lanes], depth[lanes]
        if code == 0:
            out[:, lanes] = bits.signed(place, wide)
            at[lanes] = place + wide
        elif code == 1:
            steps = place + wide * np.arange(size)[:, None]
            out[:, lanes] = bits.signed(steps, np.broadcast_to(wide, steps.shape))
            at[lanes] = place + wide * size
        elif 8 <= code <= 12 or code >= 32:
            order = int(code) - 8 if code < 32 else int(code) - 31
            warm = np.zeros((order, len(lanes)), np.int64)
            for j in range(order):
                warm[j] = bits.signed(place, wide)
                place = place + wide
            if code >= 32:
                precision, shift = bits.read(place, 4) + 1, bits.signed(place + 4, np.full(len(lanes), 5))
                place = place + 9
                factors = np.zeros((order, len(lanes)), np.int64)
                for j in range(order):
                    factors[j] = bits.signed(place, precision)
                    place = place + precision
            rest, at[lanes] = _residuals(bits, place, order, size)
            values = np.empty((size, len(lanes)), np.int64)
            values[:order] = warm
            if code >= 32:
                for i in range(order, size):
                    values[i] = rest[i - order] + ((factors * values[i - order : i][::-1]).sum(0) >> np.maximum(shift, 0))
            else:
                series = rest.astype(np.int64)
                for j in range(order - 1, -1, -1):  # running sums undo one difference at a time
                    series = np.cumsum(series, axis=0) + np.diff(warm, n=j, axis=0)[-1]
                values[order:] = series
            out[:, lanes] = values
        else:
            raise ValueError(f"reserved subframe type {int(code)}")
    return out << wasted, at


def _decode_frames(data: bytes, frames: list[Frame]) -> list[np.ndarray]:
    """Samples (channels, size) of frames that lie in one buffer."""
    bits, out = _Bits(data), [np.zeros((0, 0), np.int32)] * len(frames)
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault((f.size, f.layout, f.bits), []).append(i)
    for (size, layout, depth), which in groups.items():
        at = np.array([8 * frames[i].body for i in which])
        channels = []
        for c in range(layout + 1 if layout < 8 else 2):
            side = (layout == 8 and c == 1) or (layout == 9 and c == 0) or (layout == 10 and c == 1)
            values, at = _subframes(bits, at, np.full(len(which), depth + side), size)
            channels.append(values)
        if layout == 8:
            channels[1] = channels[0] - channels[1]
        elif layout == 9:
            channels[0] = channels[0] + channels[1]
        elif layout == 10:
            mid = (channels[0] << 1) | (channels[1] & 1)
            channels = [(mid + channels[1]) >> 1, (mid - channels[1]) >> 1]
        stacked = np.stack(channels).astype(np.int32)
        for lane, i in enumerate(which):
            out[i] = stacked[:, :, lane]
    return out


def _follows(then: Frame | None, now: Frame) -> bool:
    """Whether a header continues the sequence of another."""
    return then is not None and then.layout == now.layout and then.number == now.number + (now.size if now.variable else 1)


def _frames(data: bytes, at: int, depth: int) -> tuple[list[Frame], str]:
    """The frames from a place on: a frame ends where the next in sequence or the data starts."""
    found, size = [], len(data)
    now = _header(data, at, depth) if at < size else None
    if now is None:
        return [], "no frame" if at < size else ""
    while now is not None:
        here, then = now.body, None
        while (here := data.find(b"\xff", here)) >= 0:
            then = _header(data, here, depth)
            if _follows(then, now):
                break
            then, here = None, here + 1
        now.end = here if then is not None else size
        found.append(now)
        now = then
    return found, ""


def _confirmed(data: bytes, at: int, depth: int) -> tuple[list[Frame], str]:
    """The frames from a place on, each ended only where its own checksum holds too.

    For streams whose samples hold bytes that look like the next header.  One register runs
    over each frame, so this is linear; no such end is an error.
    """
    found, now = [], _header(data, at, depth)
    while now is not None:
        crc, done, here, then = 0, now.start, now.body - 1, None
        while done < len(data):
            here = data.find(b"\xff", here + 1)
            end = here if here >= 0 else len(data)
            then = _header(data, end, depth) if here >= 0 else None
            if here < 0 or _follows(then, now):
                for byte in data[done:end]:
                    crc = _CRC16[crc >> 8 ^ byte] ^ (crc << 8 & 0xFFFF)
                done = end
                if crc == 0:
                    break
        if crc:
            return [], "frame checksum"
        now.end = done
        found.append(now)
        now = then
    return found, ""


def decode(streams: list[bytes | None]) -> list[Stream]:
    """Decode streams together; each tells by ``ok`` and ``error`` whether all checks held."""
    found = _decode(streams, _frames)
    again = [i for i, s in enumerate(found) if s.error == "frame checksum"]
    for i, stream in zip(again, _decode([streams[i] for i in again], _confirmed), strict=True):
        if stream.ok:
            found[i] = stream
    return found


def _decode(streams: list[bytes | None], split: Callable[[bytes, int, int], tuple[list[Frame], str]]) -> list[Stream]:
    opened = [_open(s or b"") for s in streams]
    base, todo = 0, []  # frames with their places in the joined buffer
    for i, (raw, (stream, _, _, first)) in enumerate(zip(streams, opened, strict=True)):
        if not stream.error:
            frames, stream.error = split(raw, first, stream.bits)
            todo += [(i, f) for f in frames]
        base += len(raw or b"")
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    for k in range(0, len(todo), LANES):
        group = todo[k : k + LANES]
        pieces, moved, at = [], [], 0
        for i, f in group:
            pieces.append(streams[i][f.start : f.end])
            moved.append(Frame(at, at + f.body - f.start, at + f.end - f.start, f.size, f.layout, f.bits, f.number, f.variable))
            at += f.end - f.start
        buffer = b"".join(pieces)
        raw = np.frombuffer(buffer, np.uint8)
        start, end = np.array([f.start for f in moved]), np.array([f.end for f in moved])
        good = (end - start > 4) & (crc_ranges(raw, start, end, 16) == 0)  # a frame with its own CRC leaves 0
        kept = [(i, f) for (i, _), f, ok in zip(group, moved, good, strict=True) if ok]
        for (i, _), ok in zip(group, good, strict=True):
            if not ok and not opened[i][0].error:
                opened[i][0].error = "frame checksum"
        done = iter(_decode_frames(buffer, [f for _, f in kept]))
        for (i, f), ok in zip(group, good, strict=True):
            if ok:
                values = next(done)
                if not opened[i][0].error or len(parts[i]) == f.number:
                    parts[i].append(values)
    for (stream, md5, told, _), own in zip(opened, parts, strict=True):
        if own:
            stream.samples = np.concatenate(own, axis=1)
            stream.offsets = np.concatenate([[0], np.cumsum([p.shape[1] for p in own])[:-1]]).tolist()
        if not stream.error and told and stream.samples.shape[1] != told:
            stream.error = "stream is cut"
        if not stream.error and md5 != b"\0" * 16 and hashlib.md5(pcm(stream)).digest() != md5:
            stream.error = "stream digest"
        stream.ok = not stream.error
    return opened and [o[0] for o in opened]


def pcm(stream: Stream, start: int = 0, end: int | None = None) -> bytes:
    """Interleaved little-endian signed PCM of a range of samples."""
    width = (stream.bits + 7) // 8
    flat = np.ascontiguousarray(stream.samples[:, start:end].T).astype("<i4").view(np.uint8).reshape(-1, 4)
    return flat[:, :width].tobytes()


def groups(items: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring items, as many as fill the lanes, with the place of the first."""
    at = 0
    while at < len(items):
        end, filled = at, 0
        while end < len(items) and (end == at or filled < LANES * BLOCK):
            filled += len(items[end])
            end += 1
        yield at, items[at:end]
        at = end


def blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """PCM blocks of a binary FLAC column, with the sample at which each starts.

    A row a block: key, block, sample_offset, n_samples, channels, rate, bits, pcm, ok,
    error.  Streams without a readable block give one row with null block and pcm.
    """

    def step():
        def work(rows):
            out = {n: [] for n in ("key", "block", "sample_offset", "n_samples", "channels", "rate", "bits", "pcm", "ok", "error")}
            for at, group in groups([r or b"" for r in rows["media"]]):
                for name, s in zip(rows["key"][at : at + len(group)], decode(group), strict=True):
                    ends = [*s.offsets[1:], s.samples.shape[1]]
                    for i, (a, b) in enumerate(zip(s.offsets, ends, strict=True)) if s.offsets else [(None, (None, None))]:
                        values = (name, i, a, b - a if a is not None else None, s.samples.shape[0], s.rate, s.bits, pcm(s, a, b) if a is not None else None, s.ok, s.error)
                        for column_name, value in zip(out, values, strict=True):
                            out[column_name].append(value)
            return out

        return work

    from pyspark.sql import functions as F

    rows = media.select(F.col(key).cast("string").alias("key"), F.col(column).alias("media"))
    return map_rows(rows, ["key", "media"], "key string, block int, sample_offset long, n_samples int, channels int, rate int, bits int, pcm binary, ok boolean, error string", step)


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text and its payload: padded by 255 to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def feature(samples: np.ndarray) -> str:
    """Blocks, peak, mean energy and zero crossings of decoded samples."""
    x = samples.astype(np.int64)
    crossings = int((np.diff(np.signbit(samples).view(np.int8)) != 0).sum())
    return f"blocks={len(x) // BLOCK};peak={int(np.abs(x).max())};energy={int((x * x).sum()) // len(x)};crossings={crossings}"


def streams(docs: DataFrame) -> DataFrame:
    """doc_id and media, the FLAC stream of each text's payload, as ``store`` describes it."""

    def step():
        def work(rows):
            payloads = [payload(text)[1] for text in rows["text"]]
            return {"doc_id": rows["doc_id"], "media": [m for _, group in groups(payloads) for m in encode(group)]}

        return work

    return map_rows(docs, ["doc_id", "text"], "doc_id long, media binary", step)


def store(docs: DataFrame) -> DataFrame:
    """Store each text as a FLAC stream, read it back and describe what was read."""
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "verified")

    def step():
        def work(rows):
            out = {n: [] for n in names}
            sized = [payload(text) for text in rows["text"]]
            for at, group in groups([p for _, p in sized]):
                media = encode(group)
                for (size, _), raw, stream in zip(sized[at : at + len(group)], media, decode(media), strict=True):
                    back = (stream.samples[0] + 128).astype(np.uint8).tobytes()
                    values = (size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(stream.samples[0]), stream.ok)
                    for n, value in zip(names, values, strict=True):
                        out[n].append(value)
            return out | {"doc_id": rows["doc_id"]}

        return work

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, verified boolean", step)
