"""Baseline JPEG media columns: write, parse, Huffman-decode and summarise, vectorised over restart segments.

The decoder takes any baseline sequential JPEG: its own quantisation and Huffman tables, sampling factors,
restart intervals, components in one scan or in several. All entropy-coded segments of a batch that share tables
advance in lockstep, a symbol for each at a time, so numpy works on arrays as long as the number of segments. An
image that cannot be read gets its error, the others of the batch their results.

Carrier of arbitrary bytes: the format's unit is the quantised coefficient. Every byte becomes one nonzero
coefficient (DC ones as differences) of a three-component image; ranks by frequency in prose get the small
magnitudes, so the file is shorter than the payload. A comment segment holds the two lengths. Texts and images
are worked on some bytes at a time, also within a long one, whose restart segments stand on their own.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from addrloom.llm.common import text_batches, write_table

UNIT = 192
RESTART = 4
#: Bytes of texts encoded and of images decoded at a time; a long one is cut. The encoder's arrays hold about 80 bytes for each byte.
ENCODE_CHUNK, DECODE_CHUNK = 1 << 20, 2 << 20
#: Units of a payload turned into bytes at a time.
PAYLOAD_STEP = 1 << 14
#: The end of entropy-coded data: a marker that is no restart, stuffing or fill byte.
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)
COMMENT = b"payload "

#: Bytes by rank, the frequent ones of European prose first; all others follow in order.
_FIRST = b" etanioshrdlcu\xc3gmpwbfy.,vk\n\xa9\xa8TAEOISHRDNLCUx0123456789-"
ORDER = bytes(_FIRST) + bytes(b for b in range(256) if b not in _FIRST)
RANK = np.argsort(np.frombuffer(ORDER, np.uint8)).astype(np.int64)
#: Code lengths of the categories 1 to 8; the all-ones code stays unused, as the format demands.
CODE_BITS = (2, 2, 2, 3, 4, 5, 6, 7)


def _zigzag() -> np.ndarray:
    """Place of each zigzag index in the natural order."""
    at = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in at])


ZIGZAG = _zigzag()
VALUE_OF_BYTE = np.where(RANK % 2 == 0, RANK // 2 + 1, -(RANK // 2 + 1)).astype(np.int16)
BYTE_OF_VALUE = np.zeros(1024, np.int16) - 1
BYTE_OF_VALUE[VALUE_OF_BYTE.astype(int) + 512] = np.arange(256)


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The bits that stand for each byte, code and magnitude together, and their number."""
    code, starts, last = 0, [], CODE_BITS[0]
    for n in CODE_BITS:
        code <<= n - last
        starts.append(code)
        code, last = code + 1, n
    bits, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for b, v in enumerate(VALUE_OF_BYTE.tolist()):
        size = abs(v).bit_length()
        bits[b] = starts[size - 1] << size | (v if v > 0 else v + (1 << size) - 1)
        lengths[b] = CODE_BITS[size - 1] + size
    return bits, lengths


BITS, LENGTHS = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _shape(mcus: int) -> tuple[int, int]:
    """Height and width in MCUs, near square: with less than a row to spare."""
    h = isqrt(mcus)
    return h, -(-mcus // h)


def _head(n_bytes: int, payload: int, h: int, w: int) -> bytes:
    dht = bytes(sum(n == k for n in CODE_BITS) for k in range(1, 17)) + bytes(range(1, 9))
    return b"".join((
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, COMMENT + b"%d of %d" % (n_bytes, payload)), _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, h * 8, w * 8, 3) + b"\1\x11\0\2\x11\0\3\x11\0"), _segment(0xC4, b"\0" + dht + b"\x10" + dht),
        _segment(0xDD, struct.pack(">H", RESTART)), _segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0"),
    ))


def pad(data: bytes) -> bytes:
    """``data`` with bytes 32 appended up to a positive multiple of UNIT."""
    return data + b" " * (UNIT - len(data) if not data else -len(data) % UNIT)


def encode(texts: list[bytes]) -> list[bytes]:
    """A JPEG for each of ``texts``, padded by ``pad``."""
    out = [bytearray() for _ in texts]
    pieces, waiting = [], 0  # (text, bytes of whole restart segments, number of the first, whether the last is the text's last)
    cut = max(1, ENCODE_CHUNK // (RESTART * UNIT)) * RESTART * UNIT

    def flush() -> None:
        for (i, *_), scan in zip(pieces, _scans([p[1:] for p in pieces])):
            out[i] += scan
        pieces.clear()

    for i, t in enumerate(texts):
        p = pad(t)
        h, w = _shape(len(p) // UNIT)
        out[i] += _head(len(t), len(p), h, w)
        whole = h * w * UNIT
        for at in range(0, whole, cut):
            piece = p[at : at + cut]
            piece += b" " * (min(cut, whole - at) - len(piece))
            if waiting + len(piece) > ENCODE_CHUNK:
                flush()
                waiting = 0
            pieces.append((i, piece, at // (RESTART * UNIT), at + cut >= whole))
            waiting += len(piece)
    flush()
    return [bytes(x) + b"\xff\xd9" for x in out]


def _scans(pieces: list[tuple[bytes, int, bool]]) -> list[bytes]:
    """Entropy-coded data of each (bytes, number of its first restart segment, whether it ends its image)."""
    if not pieces:
        return []
    data = np.frombuffer(b"".join(p for p, _, _ in pieces), np.uint8)
    units = np.array([len(p) // UNIT for p, _, _ in pieces])
    piece_start = np.concatenate(([0], np.cumsum(units)))[:-1]
    segs = -(-units // RESTART)
    seg_piece = np.repeat(np.arange(len(units)), segs)
    seg_in_piece = np.arange(len(seg_piece)) - np.repeat(np.cumsum(segs) - segs, segs)
    seg_no = seg_in_piece + np.array([n for _, n, _ in pieces])[seg_piece]
    seg_at = (piece_start[seg_piece] + seg_in_piece * RESTART) * UNIT
    bits, lengths = BITS[data], LENGTHS[data]
    total = np.add.reduceat(lengths, seg_at)
    seg_bytes = (total + 7) // 8
    seg_out = np.cumsum(seg_bytes) - seg_bytes
    starts = np.cumsum(lengths) - lengths
    starts += np.repeat(seg_out * 8 - starts[seg_at], np.diff(np.append(seg_at, len(data))))
    out = np.zeros(int(seg_bytes.sum()) + 3, np.uint8)
    word, byte = bits << (24 - lengths - (starts & 7)), starts >> 3
    first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
    at = byte[first]
    for k in range(3):
        out[at + k] |= np.bitwise_or.reduceat((word >> (16 - 8 * k)) & 255, first).astype(np.uint8)
    out = out[:-3]
    out[seg_out + seg_bytes - 1] |= ((1 << (seg_bytes * 8 - total)) - 1).astype(np.uint8)
    # stuffing bytes after 0xFF, a restart marker after each segment but an image's last
    ends_piece = np.append(seg_piece[1:] != seg_piece[:-1], True)
    last = ends_piece & np.array([end for _, _, end in pieces])[seg_piece]
    stuffed = np.cumsum(out == 0xFF)
    restarts = np.cumsum(~last)
    shift = np.zeros(len(out), np.int64)
    shift[1:] = stuffed[:-1]
    before = np.concatenate(([0], restarts[:-1]))
    place = np.arange(len(out)) + shift + 2 * np.repeat(before, seg_bytes)
    final = np.zeros(len(out) + int(stuffed[-1]) + 2 * int(restarts[-1]), np.uint8)
    final[place] = out
    seg_last = seg_out + seg_bytes - 1
    seg_end = place[seg_last] + 1 + (out[seg_last] == 0xFF)
    inner = np.flatnonzero(~last)
    final[seg_end[inner]] = 0xFF
    final[seg_end[inner] + 1] = 0xD0 + seg_no[inner] % 8
    ends = (seg_end + 2 * ~last)[ends_piece]
    raw, begins = final.tobytes(), np.concatenate(([0], ends[:-1]))
    return [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist())]


def parse(data: bytes) -> dict:
    """Markers of one baseline JPEG and its scans. Raises ValueError for what isn't a whole baseline sequential image."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    at, out = 2, {"quant": {}, "huff": {}, "restart": 0, "comment": b"", "scans": []}
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if data[at : at + 1] != b"\xff" or at + 1 >= len(data):
            raise ValueError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError(f"a segment without end at {at}")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                if len(body) <= n:
                    raise ValueError("a short quantisation table")
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("a short Huffman table")
                out["huff"][body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0 or marker == 0xC1 and body[:1] == b"\x08":
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise ValueError("a short frame head")
            _, out["height"], out["width"], n = struct.unpack(">BHHB", body[:6])
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if not out["height"] or not out["width"] or not n or any(not 1 <= f <= 4 for c in out["parts"] for f in c[1:3]):
                raise ValueError("a frame without pixels or with sampling factors beyond 1 to 4")
        elif 0xC0 < marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError(f"not baseline: frame marker {marker:#x}")
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body, "big")
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            end = SCAN_END.search(data, at)
            if end is None:
                raise ValueError("a scan without end")
            out["scans"].append(_scan_head(out, body) | {"at": at, "end": end.start(), "restart": out["restart"]})
            at = end.start()
    if "parts" not in out or {c[0] for c in out["parts"]} != {c for s in out["scans"] for c in s["ids"]}:
        raise ValueError("components without a scan")
    if any(c[3] not in out["quant"] for c in out["parts"]):
        raise ValueError("a quantisation table is missing")
    return out


def _scan_head(found: dict, body: bytes) -> dict:
    """Components of a scan, its MCUs and its layout (sampling factors and Huffman tables of each component)."""
    by_id = {c[0]: c for c in found.get("parts", ())}
    n = body[0] if body else 0
    if len(body) < 1 + 2 * n or not n or any(body[1 + 2 * i] not in by_id for i in range(n)):
        raise ValueError("a scan of unknown components")
    ids, hm, vm = [body[1 + 2 * i] for i in range(n)], max(c[1] for c in by_id.values()), max(c[2] for c in by_id.values())
    try:
        tables = [(found["huff"][body[2 + 2 * i] >> 4], found["huff"][16 | body[2 + 2 * i] & 15]) for i in range(n)]
    except KeyError:
        raise ValueError("a Huffman table is missing") from None
    if n == 1:  # blocks of one component, row by row
        _, h, v, _ = by_id[ids[0]]
        w, t = -(-(-(-found["width"] * h // hm)) // 8), -(-(-(-found["height"] * v // vm)) // 8)
        return {"ids": ids, "mcu_w": w, "mcu_h": t, "layout": ((1, 1, *tables[0]),)}
    layout = tuple((by_id[c][1], by_id[c][2], *t) for c, t in zip(ids, tables))
    return {"ids": ids, "mcu_w": -(-found["width"] // (8 * hm)), "mcu_h": -(-found["height"] // (8 * vm)), "layout": layout}


@lru_cache(64)
def _lut(table: bytes) -> np.ndarray:
    """For each 16 bits: code length, run << 8, size << 16; 0 where no code fits."""
    lut, code, k = np.zeros(65536, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            sym = table[k]
            lut[code << (16 - n) : (code + 1) << (16 - n)] = n | (sym >> 4) << 8 | (sym & 15) << 16
            code, k = code + 1, k + 1
        code <<= 1
    return lut


def _lockstep(words: np.ndarray, start: np.ndarray, stop: np.ndarray, mcus: np.ndarray, layout: tuple) -> np.ndarray:
    """Coefficients, in zigzag order, of the blocks of all segments one after another; DC as differences.

    words: for each byte the 64 bits from there on. start, stop, mcus: of each segment; one that needs more bits than it has is an error.
    """
    order = [i for i, (h, v, _, _) in enumerate(layout) for _ in range(h * v)]
    luts = np.concatenate([_lut(layout[i][2 + ac]) for i in order for ac in (0, 1)])
    n_in = len(order)
    blocks = mcus * n_in
    out = np.zeros(int(blocks.sum()) * 64, np.int16)
    base = (np.cumsum(blocks) - blocks) * 64
    end, pos, most = base + blocks * 64, start * 8, stop * 8
    top, k, part = base.copy(), np.zeros_like(base), np.zeros_like(base)
    one = np.uint64(1)
    while len(pos):
        w = words[pos >> 3] << (pos & 7).astype(np.uint64)
        e = luts[(part * 2 + (k > 0)) * 65536 + (w >> np.uint64(48)).astype(np.int64)]
        n, run, size = e & 31, e >> 8 & 15, e >> 16
        if not n.all():
            raise ValueError("a code that no Huffman table has")
        x = ((w << n.astype(np.uint64)) >> one >> (63 - size).astype(np.uint64)).astype(np.int64)
        x = np.where(x >> np.maximum(size - 1, 0) & 1, x, x - (1 << size) + 1)
        pos = pos + n + size
        if (pos > most).any():
            raise ValueError("a segment ends before its blocks do")
        ac = k > 0
        k = k + np.where(ac, run, 0)
        has = size > 0
        if (k[has] > 63).any():
            raise ValueError("more than 64 coefficients in a block")
        out[top[has] + k[has]] = x[has]
        k = np.where(has | ~ac | (run == 15), k + 1, 64)
        if (over := k > 63).any():
            top = np.where(over, top + 64, top)
            k, part = np.where(over, 0, k), np.where(over, (part + 1) % n_in, part)
            if (ended := top >= end).any():
                on = ~ended
                pos, top, k, part, end, most = pos[on], top[on], k[on], part[on], end[on], most[on]
    return out.reshape(-1, 64)


def decode(images: list[bytes]) -> list[tuple[dict, list[np.ndarray]] | ValueError]:
    """For each image its markers and, for each scan, the coefficients (blocks in scan order, zigzag order, DC with prediction undone); or why it can't be read."""
    found: list = [None] * len(images)
    groups = defaultdict(list)
    for i, data in enumerate(images):
        try:
            p = parse(data)
            for s in p["scans"]:
                s["segments"] = _segments(data, s)
        except ValueError as e:
            found[i] = e
            continue
        found[i] = (p, [None] * len(p["scans"]))
        for k, s in enumerate(p["scans"]):
            groups[s["layout"]].append((i, k))
    for layout, units in groups.items():
        try:
            _decode_units(images, found, units, layout)
        except ValueError:
            for i, k in units:  # one by one, so that only the bad ones fail
                try:
                    if not isinstance(found[i], ValueError):
                        _decode_units(images, found, [(i, k)], layout)
                except ValueError as e:
                    found[i] = e
    return found


def _segments(data: bytes, scan: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each restart segment begins and ends, and its MCUs."""
    raw = np.frombuffer(data, np.uint8)[scan["at"] : scan["end"]]
    total = scan["mcu_w"] * scan["mcu_h"]
    every = scan["restart"] or total
    n = -(-total // every)
    marks = np.zeros(0, np.int64)
    if n > 1:
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        marks = ff[(after >= 0xD0) & (after <= 0xD7)][: n - 1]
        if len(marks) < n - 1:
            raise ValueError("restart markers are missing")
    starts, ends = np.concatenate(([0], marks + 2)), np.append(marks, len(raw))
    return starts + scan["at"], ends + scan["at"], np.minimum(every, total - every * np.arange(n))


def _decode_units(images: list[bytes], found: list, units: list[tuple[int, int]], layout: tuple) -> None:
    """Decodes scans (image, number) of one layout, DECODE_CHUNK bytes of segments at a time, into ``found``."""
    runs, waiting, parts = [], 0, defaultdict(list)  # runs: (unit, first segment, end)

    def flush() -> None:
        if runs:
            for (u, _, _), coefs in zip(runs, _decode_runs(images, found, runs, layout)):
                parts[u].append(coefs)
        runs.clear()

    for u in units:
        starts, ends, _ = found[u[0]][0]["scans"][u[1]]["segments"]
        lo = 0
        while lo < len(starts):
            if waiting >= DECODE_CHUNK:
                flush()
                waiting = 0
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + DECODE_CHUNK - waiting, "right")))
            runs.append((u, lo, hi))
            waiting += int(ends[hi - 1] - starts[lo])
            lo = hi
    flush()
    for (i, k), own in parts.items():
        found[i][1][k] = own[0] if len(own) == 1 else np.concatenate(own)


def _decode_runs(images: list[bytes], found: list, runs: list, layout: tuple) -> list[np.ndarray]:
    n_in = sum(h * v for h, v, _, _ in layout)
    pieces, starts, ends, mcus, counts, at = [], [], [], [], [], 0
    for (i, k), lo, hi in runs:
        a, b, m = (x[lo:hi] for x in found[i][0]["scans"][k]["segments"])
        pieces.append(images[i][a[0] : b[-1]])
        starts.append(a - a[0] + at)
        ends.append(b - a[0] + at)
        mcus.append(m)
        counts.append(int(m.sum()))
        at += len(pieces[-1])
    starts, ends, mcus = map(np.concatenate, (starts, ends, mcus))
    raw = np.frombuffer(b"".join(pieces) + b"\0" * 8, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    drop = np.zeros(len(raw), bool)
    drop[ff[after == 0] + 1] = True
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop[marks] = drop[marks + 1] = True
    new_at = np.cumsum(~drop) - ~drop
    data = np.append(raw[~drop], np.zeros(8, np.uint8))
    words = np.zeros(len(data) - 8, np.uint64)
    for k in range(8):
        words |= data[k : len(data) - 8 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    coefs = _lockstep(words, new_at[starts], new_at[ends], mcus, layout)
    # DC prediction: sums by component within each segment
    part = np.repeat(np.arange(len(layout)), [h * v for h, v, _, _ in layout])
    dc = coefs[:, 0].astype(np.int64).reshape(-1, n_in)
    seg = np.cumsum(mcus) - mcus
    for c in range(len(layout)):
        own = dc[:, part == c]
        run = np.cumsum(own.reshape(-1)).reshape(own.shape)
        run -= np.repeat(np.where(seg > 0, run[seg - 1, -1], 0), mcus)[:, None]
        dc[:, part == c] = run
    coefs[:, 0] = dc.reshape(-1)
    return np.split(coefs, np.cumsum(counts)[:-1] * n_in)


def thumbnail(p: dict, coefs: list[np.ndarray]) -> np.ndarray:
    """Luminance (the first component) at one pixel for each 8 x 8 block, from the DC coefficients alone."""
    first = p["parts"][0]
    k = next(k for k, s in enumerate(p["scans"]) if first[0] in s["ids"])
    scan = p["scans"][k]
    sizes = [h * v for h, v, _, _ in scan["layout"]]
    c = scan["ids"].index(first[0])
    h, v = scan["layout"][c][:2]
    dc = coefs[k][:, 0].reshape(scan["mcu_h"], scan["mcu_w"], sum(sizes))[:, :, sum(sizes[:c]) : sum(sizes[: c + 1])].reshape(scan["mcu_h"], scan["mcu_w"], v, h)
    dc = dc.transpose(0, 2, 1, 3).reshape(scan["mcu_h"] * v, scan["mcu_w"] * h).astype(np.float64)
    hm, vm = max(x[1] for x in p["parts"]), max(x[2] for x in p["parts"])
    rows, cols = -(-(-(-p["height"] * first[2] // vm)) // 8), -(-(-(-p["width"] * first[1] // hm)) // 8)
    return np.clip(np.rint(dc * p["quant"][first[3]][0] / 8 + 128), 0, 255).astype(np.uint8)[:rows, :cols]


def thumb_hash(thumb: np.ndarray) -> str:
    """64-bit mean hash of the thumbnail, averaged over areas down to 8 x 8, as 16 hex digits: every pixel counts."""
    small = thumb.astype(np.float64)
    for axis, n in enumerate(thumb.shape):
        at = np.arange(8) * n // 8
        if n >= 8:
            sizes = np.diff(np.append(at, n))
            small = np.add.reduceat(small, at, axis=axis) / (sizes[:, None] if axis == 0 else sizes)
        else:
            small = np.take(small, at, axis=axis)
    return np.packbits(small.reshape(-1) > small.mean()).tobytes().hex()


def payload(p: dict, coefs: list[np.ndarray]) -> tuple[int, bytes] | None:
    """The number of carried bytes that aren't padding and the bytes; None for an image that carries none."""
    if not p["comment"].startswith(COMMENT):
        return None
    n, size = map(int, p["comment"].removeprefix(COMMENT).split(b" of "))
    units, step, out = coefs[0].reshape(-1, 3, 64), p["restart"] or len(coefs[0]), []
    for at in range(0, len(units), PAYLOAD_STEP // step * step or step):
        own = units[at : at + (PAYLOAD_STEP // step * step or step)].astype(np.int64)
        firsts = own[:, :, 0].copy()
        own[1:, :, 0] -= firsts[:-1]
        starts = np.arange(0, len(own), step)
        own[starts, :, 0] = firsts[starts]
        data = BYTE_OF_VALUE[own.reshape(-1) + 512]
        if (data < 0).any():
            raise ValueError("a coefficient that stands for no byte")
        out.append(data.astype(np.uint8).tobytes())
    return n, b"".join(out)[:size]


MEDIA = "doc_id bigint, media binary"
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int, thumb_hash string, thumb_crc32 bigint, error string"


def _chunks(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of ``most`` bytes at most; a longer item has a slice of its own."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if len(sizes) > at:
        yield slice(at, len(sizes))


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): a JPEG that carries each whole text. Null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                for s in _chunks([len(t) for t in texts], ENCODE_CHUNK):
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")[s.start : s.stop], "media": pa.array(encode(texts[s]), pa.binary())})

    text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, MEDIA)


def _features(media: bytes, got: tuple[dict, list[np.ndarray]] | ValueError) -> tuple:
    """The columns of FEATURES after doc_id for one image."""
    own = (len(media), hashlib.sha256(media).hexdigest())
    try:
        if isinstance(got, ValueError):
            raise got
        p, coefs = got
        thumb = thumbnail(p, coefs)
        h, crc = thumb_hash(thumb), zlib.crc32(thumb.tobytes())
        carried = payload(p, coefs)
    except ValueError as e:
        return None, None, None, None, *own, None, None, None, None, None, str(e)
    told = (None,) * 4 if carried is None else (carried[0], len(carried[1]), hashlib.sha256(carried[1]).hexdigest(), zlib.crc32(carried[1][-16:]))
    return *told, *own, f"{p['width']}x{p['height']}:{h}:{crc:08x}", p["width"], p["height"], h, crc, None


def read_media(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hashes and digests of each image of (doc_id, media), of any baseline JPEG; of the carried payload where there is one.

    An image that can't be read (null, cut off, progressive, ...) keeps its row, with ``error`` and null features.
    """
    names = [f.split()[0] for f in FEATURES.split(", ")]
    types = [pa.int64() if " bigint" in f else pa.int32() if " int" in f else pa.string() for f in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                images, ids = [m or b"" for m in part.column("media").to_pylist()], part.column("doc_id").to_pylist()
                for s in _chunks([len(m) for m in images], DECODE_CHUNK):
                    rows = [(doc, *_features(m, got)) for doc, m, got in zip(ids[s], images[s], decode(images[s]))]
                    yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, map(list, zip(*rows)), types)})

    return media.mapInArrow(run, FEATURES)


def op3_jpeg(docs: DataFrame) -> DataFrame:
    """Store every whole text in a JPEG, in a table in the shared folder, and read the images back.

    Null and empty texts are one unit of padding; repeated rows and null ids keep their rows; an empty
    table gives no rows; other columns are ignored.
    """
    return read_media(write_table(encode_media(docs), "jpeg-media"))
