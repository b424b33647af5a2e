"""MPEG audio columns: frames, tags and variable-bitrate tables, written and read.

``encode`` stores bytes losslessly in an MPEG-1 Layer III stream: an ID3v2 tag that
names the length, a first frame with a variable-bitrate table (frame count, byte
count, 100 seek points), then silent mono frames at 32 kHz whose main data are empty
and whose ancillary room holds the payload.  Every frame is protected by the standard
CRC-16 over header and side information.  The last frame takes the lowest bitrate that
fits, which is why the stream needs its table.

``Stream`` reads any MPEG-1/2/2.5 Layer III stream: it skips ID3v2 (with extended header
and footer), ID3v1 and APE tags, reads both kinds of variable-bitrate tables (Xing, VBRI),
finds frame headers again after rubbish (a header counts if another one, the end, or a
tag follows where its length says), checks CRCs, and yields exact durations (samples over
their rate) and the byte offset of every frame.

Defined results.  A null text counts as empty; a payload is padded with zero bytes to
a positive multiple of 64.  Very long texts are stored whole.  Equal texts give equal bytes.  Rows are independent, so
repeated rows and ids, and null ids, are harmless; extra columns are ignored; an empty
table gives an empty table.  A stream without frames has no payload and duration 0.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.llm.common import slices, table

# fixed values of the format: kbit/s by index (MPEG-1 and MPEG-2 Layer III), Hz by version
_KBPS_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
_KBPS_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
_HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_RATE_INDEX, _SIDE = 2, 17
_CRC_START, _CRC_POLYNOMIAL = 0xFFFF, 0x8005


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the format, most significant bit first."""
    crc = _CRC_START
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ _CRC_POLYNOMIAL) & 0xFFFF if crc & 0x8000 else crc << 1 & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    """A frame header."""

    version: int
    protected: bool
    kbps: int
    hz: int
    padding: int
    mono: bool

    @property
    def samples(self) -> int:
        return 1152 if self.version == 3 else 576

    @property
    def length(self) -> int:
        return self.samples // 8 * self.kbps * 1000 // self.hz + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def header_at(data: bytes, at: int) -> Header | None:
    """The Layer III header at an offset, if there is one."""
    return _header(data[at : at + 4])


@lru_cache(maxsize=4096)
def _header(four: bytes) -> Header | None:
    if len(four) < 4:
        return None
    word = int.from_bytes(four, "big")
    version, layer, bitrate, rate = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer != 1 or bitrate in (0, 15) or rate == 3:
        return None
    return Header(version, not word >> 16 & 1, (_KBPS_1 if version == 3 else _KBPS_2)[bitrate], _HZ[version][rate], word >> 9 & 1, word >> 6 & 3 == 3)


def _frame(bitrate: int, body: bytes) -> bytes:
    """A silent protected mono frame with ``body`` after its side information, filled up with zeros."""
    head = bytes((0xFF, 0xFA, bitrate << 4 | _RATE_INDEX << 2, 0xC0))
    side = bytes(_SIDE)
    length = _header(head).length
    return (head + struct.pack(">H", crc16(head[2:] + side)) + side + body).ljust(length, b"\0")


def _room(bitrate: int) -> int:
    return 144 * _KBPS_1[bitrate] * 1000 // 32000 - 4 - 2 - _SIDE


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """An MPEG stream that holds the payload."""
    top = _room(14)
    cuts = range(0, len(payload), top)
    frames = []
    for at in cuts:
        part = payload[at : at + top]
        rate = 14 if len(part) == top else next(i for i in range(1, 15) if _room(i) >= len(part))
        frames.append(_frame(rate, part))
    size = 4 + 4 + 4 + 4 + 100
    first_rate = next(i for i in range(1, 15) if _room(i) >= size)
    ends, total = [0], len(_frame(first_rate, b""))
    for f in frames:
        ends.append(total)
        total += len(f)
    toc = bytes(min(255, ends[min(len(ends) - 1, i * len(ends) // 100)] * 256 // total) for i in range(100))
    table_ = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    said = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    text = b"TXXX" + _synchsafe(len(said)) + b"\0\0" + said
    return b"ID3\x04\0\0" + _synchsafe(len(text)) + text + _frame(first_rate, table_) + b"".join(frames)


@dataclass
class Stream:
    """What a stream holds: tags, table, and for each audio frame its offset and header."""

    data: bytes
    tags: dict[str, str] = field(default_factory=dict)
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    seek_steps: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0

    def __post_init__(self) -> None:
        at, first, end = self._tag(), True, len(self.data)
        start, ends = at, [end]
        if self.data[-128:-125] == b"TAG":
            end -= 128
            ends.append(end)
        if self.data[end - 32 : end - 24] == b"APETAGEX":
            end -= min(end, int.from_bytes(self.data[end - 20 : end - 16], "little") + 32 * (self.data[end - 9] >> 7))
        last: tuple | None = None  # of the frame that ends here
        while at + 4 <= len(self.data):
            h = header_at(self.data, at)
            like = h and (h.version, h.hz, h.mono, h.protected)
            # bytes like a trailing tag are audio if the chain goes on over them
            after = at + h.length if h else 0
            if end < after <= len(self.data) and (after in ends or header_at(self.data, after)) and (at == start or like == last) and (self.table_frames is None or len(self.offsets) < self.table_frames):
                end = min(e for e in ends if e >= after)
            if at + 4 > end:
                break
            if h and at + h.length <= end and (like == last or at + h.length == end or header_at(self.data, at + h.length)):
                if not (first and self._table(at, h)):
                    self.offsets.append(at)
                    self.headers.append(h)
                    self._check(at, h)
                first, last, at = False, like, at + h.length
            else:
                # resynchronise: on to the next byte that can begin a header
                last = None
                new = self.data.find(b"\xff", at + 1, end)
                new = end if new < 0 else new
                self.skipped += new - at
                at = new

    def _tag(self) -> int:
        d = self.data
        if d[:3] != b"ID3" or len(d) < 10:
            return 0
        size = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
        end, at = 10 + size(d[6:10]), 10
        if d[5] & 0x40:  # extended header: in version 4 its size holds itself
            at += size(d[10:14]) if d[3] == 4 else 4 + int.from_bytes(d[10:14], "big")
        while at + 10 <= end and d[at : at + 4].strip(b"\0"):
            n = size(d[at + 4 : at + 8]) if d[3] == 4 else int.from_bytes(d[at + 4 : at + 8], "big")
            name, body = d[at : at + 4].decode("latin-1"), d[at + 10 : at + 10 + n]
            if name[0] == "T" and body:
                said = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
                key, _, value = said.rstrip("\0").partition("\0")
                self.tags[key if name == "TXXX" else name] = value if name == "TXXX" else key
            at += 10 + n
        return end + 10 * (d[3] == 4 and bool(d[5] & 0x10))  # a footer follows

    def _table(self, at: int, h: Header) -> bool:
        """Read the variable-bitrate table, if this frame holds one."""
        for p in (at + 4 + 2 * h.protected + h.side, at + 4 + h.side):
            if self.data[p : p + 4] in (b"Xing", b"Info"):
                flags, q = int.from_bytes(self.data[p + 4 : p + 8], "big"), p + 8
                if flags & 1:
                    self.table_frames, q = int.from_bytes(self.data[q : q + 4], "big"), q + 4
                if flags & 2:
                    self.table_bytes, q = int.from_bytes(self.data[q : q + 4], "big"), q + 4
                if flags & 4:
                    self.toc = self.data[q : q + 100]
                return True
        p = at + 4 + 32
        if self.data[p : p + 4] == b"VBRI":
            field = lambda q, n: int.from_bytes(self.data[p + q : p + q + n], "big")
            self.table_bytes, self.table_frames = field(10, 4), field(14, 4)
            entries, scale, width = field(18, 2), field(20, 2), field(22, 2)
            self.toc = self.data[p + 26 : p + 26 + entries * width]
            self.seek_steps = [scale * field(26 + i * width, width) for i in range(entries)]
            return True
        return False

    def _check(self, at: int, h: Header) -> None:
        if h.protected:
            good = crc16(self.data[at + 2 : at + 4] + self.data[at + 6 : at + 6 + h.side]) == int.from_bytes(self.data[at + 4 : at + 6], "big")
            self.crc_good, self.crc_bad = self.crc_good + good, self.crc_bad + (not good)

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def seconds(self) -> float:
        """Exact duration: samples over their rate."""
        by_rate = Counter()
        for h in self.headers:
            by_rate[h.hz] += h.samples
        return sum(n / hz for hz, n in sorted(by_rate.items()))

    def payload(self) -> bytes:
        """What ``encode`` stored."""
        parts = [self.data[at + 6 + h.side : at + h.length] for at, h in zip(self.offsets, self.headers, strict=True)]
        whole, n = b"".join(parts), int(self.tags.get("payload_bytes", 0))
        if len(whole) < n:
            raise ValueError(f"the stream holds {len(whole)} of {n} bytes")
        return whole[:n]

    def feature(self) -> str:
        """Frames, samples, rate, CRCs, table against stream, and a digest of the seek offsets."""
        seek = zlib.crc32(struct.pack(f"<{len(self.offsets)}Q", *self.offsets))
        agrees = self.table_frames == len(self.offsets)
        hz = self.headers[0].hz if self.headers else 0
        return f"frames={len(self.offsets)};samples={self.samples};hz={hz};crc={self.crc_good}/{self.crc_good + self.crc_bad};table={'ok' if agrees else 'bad'};skipped={self.skipped};seek={seek:08x}"


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes filled up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        made = [padded(x) for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([encode(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text stored as an MPEG stream."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_encoded, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, media binary")


_READ = "payload binary, seconds double, samples bigint, frame_offsets array<bigint>, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        streams = [Stream(x or b"") for x in batch.column(batch.num_columns - 1).to_pylist()]
        new = [
            pa.array([s.payload() for s in streams], pa.binary()), pa.array([s.seconds for s in streams], pa.float64()), pa.array([s.samples for s in streams], pa.int64()),
            pa.array([s.offsets for s in streams], pa.list_(pa.int64())), pa.array([s.feature() for s in streams]),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "payload", "seconds", "samples", "frame_offsets", "feature"])


def read_media(rows: DataFrame) -> DataFrame:
    """The rows (``media`` last) with payload, duration, seek offsets and feature of each stream."""
    rows = rows.select(*[c for c in rows.columns if c != "media"], "media")
    return rows.mapInArrow(_read, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", " + _READ)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Store each text, read the stream back, and keep sizes and digests of both."""
    for batch in slices(batches, 200):
        rows = []
        for text in batch.column(1).to_pylist():
            n, raw = padded(text)
            media = encode(raw)
            stream = Stream(media)
            payload = stream.payload()
            rows.append((n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha256(media).hexdigest(), stream.feature(), stream.seconds, stream.offsets))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *_DIGESTS])


_DIGESTS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "frame_offsets")


def digests(docs: DataFrame) -> DataFrame:
    """Both steps in one task, so that streams and payloads need not leave it: sizes, digests, the feature, duration and seek offsets."""
    types = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, seconds double, frame_offsets array<bigint>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_digested, types)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through MPEG streams: sizes and digests of payload and stream, the feature, duration and seek offsets."""
    return digests(table(spark, sf_dir, "documents"))
