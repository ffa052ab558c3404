"""Baseline JPEG as a store of bytes, and a decoder for thumbnails.

A payload of a multiple of 64 bytes becomes a grey baseline JPEG of one 8 x 8 block for each 64
bytes: each byte is one quantised coefficient of size class 8 (extra bits equal to the byte), so a
coefficient takes one code bit and eight value bits. A restart marker follows each block, which
resets the DC prediction and lets all blocks decode side by side. The decoder parses the markers,
builds Huffman tables from DHT, decodes the scan with look-up tables over 16 bits, one coefficient
of every restart interval at a time, and makes the DC-only luminance thumbnail, one pixel a block.
It reads any grey baseline file; files without restart markers are one interval. A thumbnail, and so
the feature, sees the DC coefficient of each block alone: one byte in 64.

Defined results: null and empty texts are 64 zero bytes, of n_bytes 0; equal texts have equal
values; repeated rows repeat their results; extra columns are ignored; an empty table gives an
empty result. No text is cut; sides grow to 8191 blocks, which bounds a payload at 4.2 GB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from groundwork.llm.common import per_text

WIDE, MOST = 64, 8191  # blocks in a row; blocks a side may have
DC_CODES, AC_CODES = {8: "0"}, {0x08: "0", 0x00: "10"}  # symbol -> code; both tables avoid codes of ones alone

#: The order in which a block's coefficients are sent.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(kind: int, codes: dict[int, str]) -> bytes:
    lengths = [sum(len(c) == n for c in codes.values()) for n in range(1, 17)]
    return segment(0xC4, bytes([kind, *lengths, *sorted(codes, key=lambda s: (len(codes[s]), codes[s]))]))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def encode(payload: bytes) -> bytes:
    """The JPEG file of a payload whose length is a positive multiple of 64; blocks that only fill the last row up are zeros."""
    blocks = len(payload) // 64
    wide = min(blocks, max(WIDE, -(-blocks // MOST)))
    high = -(-blocks // wide)
    if wide > MOST:
        raise ValueError("payload too long for one image")
    values = np.zeros((wide * high, 64), np.uint8)
    values[:blocks] = np.frombuffer(payload, np.uint8).reshape(blocks, 64)
    bits = np.zeros((len(values), 64, 9), np.uint8)  # code bit 0, then the byte
    bits[:, :, 1:] = np.unpackbits(values, axis=1).reshape(-1, 64, 8)
    coded = np.packbits(bits.reshape(len(values), -1), axis=1)  # 72 bytes a block
    full = coded.ravel() == 0xFF
    width = 1 + full.reshape(coded.shape).sum(axis=1) + 71 + 2  # with stuffing and a restart marker
    place = np.arange(coded.size) + np.concatenate([[0], np.cumsum(full)[:-1]]) + 2 * np.repeat(np.arange(len(values)), 72)
    scan = np.zeros(int(width.sum()), np.uint8)
    scan[place] = coded.ravel()
    ends = np.cumsum(width)
    scan[ends - 2] = 0xFF
    scan[ends - 1] = 0xD0 + np.arange(len(values)) % 8
    scan = scan[:-2].tobytes()  # the last interval ends with the image
    head = [
        b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), segment(0xDB, b"\0" + b"\1" * 64),
        segment(0xC0, struct.pack(">BHHB3B", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0)),
        huffman(0x00, DC_CODES), huffman(0x10, AC_CODES), segment(0xDD, struct.pack(">H", 1)), segment(0xFE, b"blocks=%d" % blocks), segment(0xDA, b"\1\1\0\0\x3f\0"),
    ]
    return b"".join([*head, scan, b"\xff\xd9"])


def lookup(body: bytes) -> np.ndarray:
    """16 bits ahead -> symbol << 8 | code length; length 0 where no code begins so."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            span = 1 << (16 - n)
            table[code << (16 - n) : (code << (16 - n)) + span] = body[at] << 8 | n
            code, at = code + 1, at + 1
        code <<= 1
    return table


class Image:
    """A decoded file: height, width, quantised coefficients (block, 64 in sent order), DC step, comment."""

    def __init__(self, raw: bytes):
        dc, ac, steps, at, interval, self.comment = {}, {}, {}, 2, 0, b""
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            mark, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    steps[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1")
                    body = body[65 + 64 * wide :]
            elif mark == 0xC0:
                _, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if parts != 1:
                    raise ValueError("only grey images are read")
                quant = body[8]
            elif mark in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("only baseline images are read")
            elif mark == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    (ac if body[0] >> 4 else dc)[body[0] & 15] = body[1:n]
                    body = body[n:]
            elif mark == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif mark == 0xFE:
                self.comment = body
            elif mark == 0xDA:
                tables = body[2]
                break
        data = np.frombuffer(raw, np.uint8, offset=at)
        marks = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] != 0))
        stop = marks[(data[marks + 1] < 0xD0) | (data[marks + 1] > 0xD7)][0]
        data, marks = data[:stop], marks[marks < stop]
        keep = np.ones(len(data), bool)
        keep[1:][(data[:-1] == 0xFF) & (data[1:] == 0)] = False
        keep[marks] = keep[marks + 1] = False
        before = np.cumsum(keep)
        starts = np.concatenate([[0], before[marks]])
        total = -(-self.height // 8) * -(-self.width // 8)
        each = interval or total
        counts = np.minimum(each, total - each * np.arange(len(starts)))
        if counts.sum() != total or counts.min() < 1:
            raise ValueError("restart markers do not fit the size")
        self.step = int(steps[quant][0])
        self.tables = dc[tables >> 4], ac[tables & 15]
        self.scan = data[keep], starts, counts

    @classmethod
    def read(cls, files: list[bytes]) -> list["Image"]:
        """Decode many files, those with the same Huffman tables side by side."""
        images, alike = [cls(f) for f in files], {}
        for image in images:
            alike.setdefault(image.tables, []).append(image)
        for (dc, ac), group in alike.items():
            data, starts, counts = zip(*(x.scan for x in group))
            shift = np.cumsum([0, *map(len, data)])
            blocks = decode_scan(np.concatenate(data), np.concatenate([s + d for s, d in zip(starts, shift)]), np.concatenate(counts), lookup(dc), lookup(ac))
            ends = np.cumsum([c.sum() for c in counts])
            for image, i, j in zip(group, [0, *ends[:-1]], ends):
                image.blocks = blocks[i:j]
                del image.scan
        return images

    def thumbnail(self) -> np.ndarray:
        """DC-only luminance: the mean of each block."""
        mean = np.clip(np.rint(self.blocks[:, 0] * self.step / 8 + 128), 0, 255).astype(np.uint8)
        return mean.reshape(-(-self.height // 8), -(-self.width // 8))


def decode_scan(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    """Coefficients of all blocks: the same step of every interval at once. counts: blocks of each interval."""
    data = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    n, base = len(starts), np.cumsum(counts) - counts
    out = np.zeros((int(counts.sum()), 64), np.int16)
    bit, level = starts.astype(np.int64) * 8, np.zeros(n, np.int64)
    top = (len(data) - 5) * 8

    def ahead(rows, bits):
        at = np.minimum(bit[rows], top)
        byte, shift = at >> 3, (at & 7).astype(np.uint32)
        word = data[byte] << 24 | data[byte + 1] << 16 | data[byte + 2] << 8 | data[byte + 3]
        return (word << shift) >> np.uint32(32 - bits)

    def value(rows, size):
        raw = ahead(rows, 16).astype(np.int64) >> (16 - size)
        bit[rows] += size
        return np.where(size == 0, 0, np.where(raw >> np.maximum(size - 1, 0) > 0, raw, raw - (1 << size) + 1))

    def symbol(rows, table):
        found = table[ahead(rows, 16)]
        if (found == 0).any():
            raise ValueError("no Huffman code fits")
        bit[rows] += found & 255
        return found >> 8

    for k in range(int(counts.max())):
        rows = np.flatnonzero(counts > k)
        block = base[rows] + k
        level[rows] += value(rows, symbol(rows, dc))
        out[block, 0] = level[rows]
        place = np.ones(len(rows), np.int64)
        while len(rows):
            s = symbol(rows, ac)
            run, size = s >> 4, s & 15
            place += np.where(s == 0, 64, run)
            live = (size > 0) & (place < 64)
            v = value(rows, size)
            out[block[live], place[live]] = v[live]
            place += 1
            go = place < 64
            if not go.all():
                rows, block, place = rows[go], block[go], place[go]
    return out


def payload(image: Image) -> bytes:
    """The bytes that encode() stored: the coefficients' extra bits, without the blocks that fill the last row up."""
    blocks = int(image.comment.rpartition(b"=")[2])
    v = image.blocks[:blocks]
    return np.where(v < 0, v + 255, v).astype(np.uint8).tobytes()


def feature(image: Image) -> str:
    """Size in pixels, the thumbnail's digest, and a difference hash over its 8 x 9 means."""
    small = image.thumbnail()
    rows = np.array_split(np.arange(small.shape[0]), 8) if small.shape[0] >= 8 else [np.array([i * small.shape[0] // 8]) for i in range(8)]
    cols = np.array_split(np.arange(small.shape[1]), 9) if small.shape[1] >= 9 else [np.array([i * small.shape[1] // 9]) for i in range(9)]
    sums = small.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    sums = np.pad(sums, ((1, 0), (1, 0)))
    r0, r1 = np.array([r[0] for r in rows]), np.array([r[-1] + 1 for r in rows])
    c0, c1 = np.array([c[0] for c in cols]), np.array([c[-1] + 1 for c in cols])
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    mean = (sums[r1][:, c1] - sums[r0][:, c1] - sums[r1][:, c0] + sums[r0][:, c0]) / area
    bits = np.packbits((mean[:, 1:] > mean[:, :-1]).ravel()).tobytes().hex()
    return f"{image.width}x{image.height}:{hashlib.sha256(small.tobytes()).hexdigest()[:32]}:{bits}"


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, keep_files: bool = False) -> DataFrame:
    """docs (doc_id, text) -> the columns of MEDIA, computed from the file read back; with the files themselves on request."""

    def run(parts):
        for doc_id, text in parts:
            out = {k.split()[0]: [] for k in MEDIA.split(", ")} | ({"file": []} if keep_files else {})
            raws = [(t or "").encode() for t in text]
            files = [encode(padded(raw)) for raw in raws]
            for d, raw, file, image in zip(doc_id, raws, files, Image.read(files)):
                back = payload(image)
                values = [d, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(image)]
                for column, v in zip(out.values(), values + [file] * keep_files):
                    column.append(v)
            yield out

    return per_text(docs, run, MEDIA + ", file binary" * keep_files)
