"""Captures read one packet after the other, to compare with."""

import struct
from collections.abc import Iterator

PAYLOAD_END = 100


def packets(data: bytes) -> Iterator[tuple]:
    """(packet, ts_ms, addresses, ports, transport, length, flags, ttl, window, payload) of a capture in either byte order."""
    if len(data) < 24:
        raise ValueError("no capture file: shorter than its header")
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">"}.get(data[:4])
    if order is None:
        what = "pcapng isn't supported" if data[:4] == b"\x0a\x0d\x0d\x0a" else "unknown magic number"
        raise ValueError(f"no classic capture file: {what}")
    at, number = 24, -1
    while at + 16 <= len(data):
        seconds, micros, size, original = struct.unpack_from(f"{order}IIII", data, at)
        at += 16
        if not size or at + size > len(data):
            return
        frame, at, number = data[at : at + size], at + size, number + 1
        if len(frame) < 34 or frame[12:14] != b"\x08\x00" or frame[14] >> 4 != 4:
            continue
        ip = frame[14:]
        head, transport = (ip[0] & 15) * 4, {6: "TCP", 17: "UDP"}.get(ip[9])
        part = ip[head:]
        if transport is None or head < 20 or len(part) < (20 if transport == "TCP" else 8):
            continue
        source, target = struct.unpack_from(">HH", part)
        flags, window, begin = (part[13], struct.unpack_from(">H", part, 14)[0], (part[12] >> 4) * 4) if transport == "TCP" else (0, 0, 8)
        yield number, seconds * 1000 + micros // 1000, ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20])), source, target, transport, original, flags, ip[8], window, part[begin : max(begin, min(len(part), PAYLOAD_END))]
