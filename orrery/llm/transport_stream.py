"""Media columns: MPEG transport streams.

``mux`` stores a payload as a stream of 188-byte packets: a program association table, a program map
table and one elementary stream of PES packets, each with a 33-bit timestamp, every fourth one marked as
a random-access point with a clock reference. ``demux`` reads any such stream: it finds the packet grid,
parses both tables, checks each stream's continuity counters (a repeated packet is dropped, a gap is
counted), reassembles the elementary packets and lists them as access units with their timestamps,
random-access marks, places in the data, sizes and checksums.

Null texts count as empty; an empty text is 64 zero bytes; equal texts give equal streams.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import field, map_columns

PACKET = 188
PMT_PID, DATA_PID = 0x100, 0x101
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
UNIT_BYTES = 16_384
#: Ticks of the 90 kHz clock from one unit to the next, the first timestamp, and units from one random-access point to the next.
TICKS, FIRST_TICK, RANDOM_ACCESS_EVERY = 3_600, 90_000, 4
UNITS = "array<struct<pid: int, stream_type: int, pts: bigint, random_access: boolean, at: bigint, bytes: bigint, crc32: bigint>>"


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (0x04C11DB7 if value & 0x80000000 else 0)
        table.append(value & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = (value << 8) & 0xFFFFFFFF ^ _CRC[value >> 24 ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    data = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return data + section_crc(data).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


HEAD = _table_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _table_packet(
    PMT_PID, _section(2, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
)


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 255, 0x01 | pts << 1 & 0xFE])


def _read_timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _unit_packets(number: int, data: bytes, counter: int) -> np.ndarray:
    pts = (FIRST_TICK + number * TICKS) % (1 << 33)
    pes = bytes([0, 0, 1, PRIVATE_STREAM]) + (8 + len(data)).to_bytes(2, "big") + bytes([0x84, 0x80, 5]) + _timestamp(pts) + data
    first = PACKET - 4 - 8  # beside the adaptation field with its clock reference
    n = 1 + max(0, -(-(len(pes) - first) // (PACKET - 4)))
    packets = np.full((n, PACKET), 0xFF, np.uint8)
    packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 255
    packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    packets[0, 1] |= 0x40
    packets[0, 3] |= 0x20
    random = 0x40 if number % RANDOM_ACCESS_EVERY == 0 else 0
    reference = (pts << 15 | 0x7E << 8).to_bytes(6, "big")
    body = np.frombuffer(pes, np.uint8)
    if n == 1:
        packets[0, 4] = PACKET - 5 - len(pes)
        packets[0, 5:12] = np.frombuffer(bytes([0x10 | random]) + reference, np.uint8)
        packets[0, PACKET - len(pes) :] = body
        return packets
    packets[0, 4:12] = np.frombuffer(bytes([7, 0x10 | random]) + reference, np.uint8)
    packets[0, 12:] = body[:first]
    middle = body[first : first + (n - 2) * (PACKET - 4)]
    packets[1 : n - 1, 4:] = middle.reshape(n - 2, PACKET - 4)
    rest = body[first + len(middle) :]
    spare = PACKET - 4 - len(rest)
    if spare:
        packets[n - 1, 3] |= 0x20
        packets[n - 1, 4] = spare - 1
        if spare > 1:
            packets[n - 1, 5] = 0
    packets[n - 1, PACKET - len(rest) :] = rest
    return packets


def mux_bytes(payload: bytes) -> bytes:
    parts, counter = [HEAD], 0
    for number, at in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        packets = _unit_packets(number, payload[at : at + UNIT_BYTES], counter)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


def _grid(data: np.ndarray) -> np.ndarray:
    """The packets of 188 bytes from the first place where sync bytes repeat; bytes outside of the grid are left out."""
    for offset in range(min(PACKET, len(data))):
        n = (len(data) - offset) // PACKET
        if n and data[offset] == 0x47:
            packets = data[offset : offset + n * PACKET].reshape(n, PACKET)
            if (packets[: min(n, 5), 0] == 0x47).all():
                return packets[packets[:, 0] == 0x47]
    return data[:0].reshape(0, PACKET)


def _payload_start(packets: np.ndarray) -> np.ndarray:
    has_field = packets[:, 3] & 0x20 > 0
    return np.where(has_field, np.minimum(5 + packets[:, 4].astype(np.int64), PACKET), 4)


def _sections(packets: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Whole sections with a right checksum in the packets of one table."""
    out, held = [], b""
    for packet, start in zip(packets, starts.tolist(), strict=True):
        body = packet[start:].tobytes()
        if packet[1] & 0x40 and body:
            held = body[1 + body[0] :]
        else:
            held += body
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 15) << 8 | held[2])):
            if section_crc(held[:size]) == 0:
                out.append(held[:size])
            held = held[size:]
    return out


def demux_bytes(stream: bytes) -> tuple[bytes, list[dict], int, int]:
    """The data of all elementary streams in table order, its access units, gaps in the counters, and programs."""
    packets = _grid(np.frombuffer(stream, np.uint8))
    pids = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    starts = _payload_start(packets)
    has_data = packets[:, 3] & 0x10 > 0

    def tables(pid: int, table_id: int) -> list[bytes]:
        own = np.flatnonzero((pids == pid) & has_data)
        return list(dict.fromkeys(s for s in _sections(packets[own], starts[own]) if s[0] == table_id))

    programs: dict[int, int] = {}
    for section in tables(0, 0):
        for at in range(8, len(section) - 4, 4):
            number = section[at] << 8 | section[at + 1]
            if number:
                programs[number] = (section[at + 2] & 0x1F) << 8 | section[at + 3]
    streams: dict[int, int] = {}
    for pid in programs.values():
        for section in tables(pid, 2):
            at = 12 + ((section[10] & 15) << 8 | section[11])
            while at + 5 <= len(section) - 4:
                streams[(section[at + 1] & 0x1F) << 8 | section[at + 2]] = section[at]
                at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
    data, units, gaps, place = [], [], 0, 0
    for pid, kind in streams.items():
        own = np.flatnonzero((pids == pid) & has_data)
        counters = packets[own, 3] & 15
        step = np.diff(counters.astype(np.int64)) % 16
        keep = np.ones(len(own), bool)
        for i in np.flatnonzero(step == 0).tolist():  # as sent twice, or else a gap of 16
            keep[i + 1] = not np.array_equal(packets[own[i + 1]], packets[own[i]])
        gaps += int((step > 1).sum() + (keep[1:] & (step == 0)).sum()) if len(own) else 0
        own = own[keep]
        opens = np.flatnonzero(packets[own, 1] & 0x40)
        for a, b in zip(opens.tolist(), [*opens[1:].tolist(), len(own)], strict=True):
            pes = b"".join(packets[i, s:].tobytes() for i, s in zip(own[a:b].tolist(), starts[own[a:b]].tolist(), strict=True))
            unit = _unit(pes)
            if unit is None:
                continue
            pts, body = unit
            first = packets[own[a]]
            mark = bool(first[3] & 0x20 and first[4] and first[5] & 0x40)
            units.append({"pid": pid, "stream_type": kind, "pts": pts, "random_access": mark, "at": place, "bytes": len(body), "crc32": zlib.crc32(body)})
            data.append(body)
            place += len(body)
    return b"".join(data), units, gaps, len(programs)


def _unit(pes: bytes) -> tuple[int | None, bytes] | None:
    if len(pes) < 9 or pes[:3] != b"\0\0\1":
        return None
    length = pes[4] << 8 | pes[5]
    body = pes[9 + pes[8] : 6 + length if length else len(pes)]
    return (_read_timestamp(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else None), body


def mux(df: DataFrame, key: str = "doc_id", data: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the data) and media: the data, zeros added up to a positive multiple of 64, as a transport stream."""
    rows = df.select(field(key).alias("doc_id"), field(data).cast("binary").alias("data"))

    def run(batch) -> list:
        sizes, media = [], []
        for value in batch.column(1):  # one text at a time as Python bytes
            value = value.as_py() or b""
            sizes.append(len(value))
            media.append(mux_bytes(value.ljust(max(64, -(-len(value) // 64) * 64), b"\0")))
        return [batch.column(0), sizes, media]

    return map_columns(rows, run, "n_bytes bigint, media binary", rows.schema["doc_id"])


def demux(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """doc_id, payload, units (one for each access unit), gaps, programs. Null or broken media give an empty payload and no units."""
    rows = df.select(field(key).alias("doc_id"), field(media).cast("binary").alias("media"))

    def run(batch) -> list:
        found = [demux_bytes(value.as_py() or b"") for value in batch.column(1)]
        return [batch.column(0), *([f[i] for f in found] for i in range(4))]

    return map_columns(rows, run, f"payload binary, units {UNITS}, gaps int, programs int", rows.schema["doc_id"])


def stored_and_read(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's stream and of what is read back from it, and units, the access units that were read: stream, timestamp, random-access mark, place, bytes and checksum of each.

    feature: counts, first and last timestamp, random-access points, and a checksum over those of the units.
    """
    stored = mux(docs, doc_id, text)
    stored = stored.select(F.struct("doc_id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("of"), "media")
    back = demux(stored, "of", "media")
    return back.select(
        F.col("doc_id.doc_id").alias("doc_id"),
        F.col("doc_id.n_bytes").alias("n_bytes"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.col("doc_id.media_bytes").alias("media_bytes"),
        F.col("doc_id.media_sha256").alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("programs="), F.col("programs")),
            F.concat(F.lit("units="), F.size("units")),
            F.concat(F.lit("gaps="), F.col("gaps")),
            F.concat(F.lit("pts="), F.element_at("units", 1).pts, F.lit("-"), F.element_at("units", -1).pts),
            F.concat(F.lit("random="), F.size(F.filter("units", lambda u: u.random_access))),
            F.concat(F.lit("crc="), F.crc32(F.concat_ws(",", F.transform("units", lambda u: u.crc32.cast("string"))).cast("binary"))),
        ).alias("feature"),
        "units",
    )
