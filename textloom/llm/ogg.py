"""Media columns in Ogg: pages with verified checksums, packets from lacing values, demultiplexed streams, granule times."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import slices, table

REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
RATE, UNIT, PACKET, PAGE = 8000, 64, 2048, 4096
SAMPLES, MARKS = 1, 2
MAGIC = b"RAW8"


def checksum(page: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04c11db7, most significant bit first, nothing inverted.

    zlib's runs the same polynomial the other way round, so the bits of each byte and of the result are reversed.
    """
    raw = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(REVERSED), "big")


@dataclass
class Stream:
    """A logical stream: its packets, the granule position at each packet's end (-1: not on this page's last packet), and flaws."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    ended: bool = False
    lost: int = 0

    def seconds(self, rate: int) -> list[float | None]:
        return [g / rate if g >= 0 else None for g in self.granules]


@dataclass
class Reader:
    streams: dict[int, Stream]
    pages: int
    bad: int


def pages_of(serial: int, packets: list[tuple[bytes, int]], most: int = PAGE) -> list[bytes]:
    """The pages of one logical stream of (packet, granule at its end): headers alone on the first page, then about `most` bytes each."""
    groups: list[tuple[list[int], list[bytes], int, bool]] = []
    lacing: list[int] = []
    body: list[bytes] = []
    granule, goes_on, size = -1, False, 0

    def flush(next_goes_on: bool) -> None:
        nonlocal lacing, body, granule, goes_on, size
        groups.append((lacing, body, granule, goes_on))
        lacing, body, granule, goes_on, size = [], [], -1, next_goes_on, 0

    for n, (packet, end) in enumerate(packets):
        at, left = 0, len(packet)
        while True:
            # as many whole segments of 255 bytes as the page still takes
            room = min(255 - len(lacing), max(1, (most - size) // 255))
            if left >= 255 * room:
                lacing += [255] * room
                body.append(packet[at : at + 255 * room])
                at, left, size = at + 255 * room, left - 255 * room, size + 255 * room
                flush(True)
                continue
            lacing += [255] * (left // 255) + [left % 255]
            body.append(packet[at:])
            size, granule = size + left, end
            break
        if n == 0 or size >= most - 255 or len(lacing) >= 255:
            flush(False)
    if lacing or not groups:
        flush(False)
    out = []
    for n, (lacing, body, granule, goes_on) in enumerate(groups):
        kind = CONTINUED * goes_on | FIRST * (n == 0) | LAST * (n == len(groups) - 1)
        rest = bytes(lacing) + b"".join(body)
        page = HEADER.pack(b"OggS", 0, kind, granule, serial, n, 0, len(lacing)) + rest
        out.append(page[:22] + struct.pack("<I", checksum(page)) + page[26:])
    return out


def multiplexed(streams: list[list[bytes]]) -> bytes:
    """One physical stream: all first pages, then the streams' pages in turn."""
    out = [pages[0] for pages in streams]
    for n in range(1, max(map(len, streams))):
        out += [pages[n] for pages in streams if n < len(pages)]
    return b"".join(out)


def read(data: bytes) -> Reader:
    """All logical streams. A page whose checksum fails is skipped, and so is every packet with a part on a page that is lost."""
    streams: dict[int, Stream] = {}
    open_packet: dict[int, list[bytes] | None] = {}
    following: dict[int, int] = {}
    at, pages, bad = 0, 0, 0
    while (at := data.find(b"OggS", at)) >= 0 and at + HEADER.size <= len(data):
        _, version, kind, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            bad, at = bad + 1, at + 4
            continue
        pages += 1
        s = streams.setdefault(serial, Stream())
        part = open_packet.get(serial)
        if number != following.get(serial, 0):
            s.lost += 1
            part = None
        elif not kind & CONTINUED:
            part = []
        if kind & CONTINUED and part is None:
            skip = True
        else:
            skip, part = False, part or []
        following[serial] = number + 1
        where, ends = at + 27 + n, []
        for v in lacing:
            if not skip:
                part.append(data[where : where + v])
            where += v
            if v < 255:
                if skip:
                    skip, part = False, []
                    continue
                ends.append(b"".join(part))
                part = []
        s.packets += ends
        s.granules += [-1] * (len(ends) - 1) + [granule] if ends else []
        s.ended |= bool(kind & LAST)
        open_packet[serial] = None if skip else part
        at = end
    return Reader(streams, pages, bad)


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit samples in packets of `PACKET` bytes, beside a stream that marks each packet with its crc32."""
    head = MAGIC + struct.pack("<IQ", rate, len(payload))
    cuts = range(0, len(payload), PACKET)
    parts = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in cuts]
    marks = [(struct.pack("<I", zlib.crc32(p)), end) for p, end in parts]
    return multiplexed([pages_of(SAMPLES, [(head, 0), *parts]), pages_of(MARKS, [(head, 0), *marks])])


def decode(media: bytes) -> tuple[bytes, str]:
    """(payload, feature) from the stored bytes alone; ValueError where they are damaged."""
    got = read(media)
    samples, marks = got.streams.get(SAMPLES), got.streams.get(MARKS)
    if got.bad or samples is None or marks is None or not samples.packets or samples.packets[0][:4] != MAGIC or not samples.ended:
        raise ValueError(f"damaged Ogg: {got.bad} bad pages of {got.bad + got.pages}")
    rate, size = struct.unpack_from("<IQ", samples.packets[0], 4)
    parts = samples.packets[1:]
    payload = b"".join(parts)
    if len(payload) != size or [zlib.crc32(p) for p in parts] != [struct.unpack("<I", m)[0] for m in marks.packets[1:]]:
        raise ValueError("packets and marks differ")
    level = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((level[1:] < 0) != (level[:-1] < 0)))
    seconds = [t for t in samples.seconds(rate) if t is not None][-1]
    return payload, f"rate={rate};seconds={seconds:.6f};pages={got.pages};packets={len(parts)};mean={level.mean():.6f};rms={np.sqrt((level * level).mean()):.6f};crossings={crossings}"


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + bytes(-len(text) % unit if text else unit)


def media_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, zero-padded to a positive multiple of 64, in Ogg; null texts are empty. Other columns are ignored."""

    def run(batches):
        for batch in slices(batches, "text", 1 << 23):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """What is read back from each row of `media_of`: sizes, digests and features. Rows stay as they are, repeated ones too; a damaged medium raises."""

    def run(batches):
        for batch in slices(batches, "media", 1 << 23):
            rows = []
            for i, n, m in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                payload, feature = decode(m)
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            names = [c.split()[0] for c in DIGESTS.split(", ")]
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.mapInArrow(run, DIGESTS)


def op10_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as Ogg, read back, digested."""
    return media_digests(media_of(table(spark, sf_dir, "documents").select("doc_id", "text")))
