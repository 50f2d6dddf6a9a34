"""Packet captures as a data source: spark.read.format("pcap") and df.write.format("pcap").

Reading: a file is cut into blocks of bytes, a task each; a block's task reads the packets whose record headers begin in
it, a few MB at a time. Classic captures have no marks at which a reader could start, so a task looks at all offsets of
a stretch before its block at which a header could be (a possible length, a possible fraction of a second) and follows
each from header to header. The file's own chain of headers has one within the longest packet from the stretch's begin,
and never breaks. Other chains from there break on the way or run into it, but for one: four bytes behind a header stand
the captured and the original length, which are equal in most packets and read as a fraction and a length, so the
file's chain has a shadow four bytes behind it. So, of two places four bytes apart at which chains arrive in the block the
first one counts. Where there still are several, a longer stretch is taken, up to MOST_BEFORE, where the chain that begins
first counts, or to the file's first header, whose chain is the file's own.

A header that can't be one ends its block (zeros behind the last packet, a file cut short, damage); after damage, blocks
go on at the first offset from which headers follow each other to the end of a window.

Writing: a file per task of header-only packets, moved into place on commit (files.FileWriter). An address has 32 bits in
a capture; flows whose addresses are others (names, IPv6, octets above 255) are written with stand-ins of 240.0.0.0/4,
which no host has, from a table that gives them back after reading (hosts).
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidewire.functions.network import app_protocol
from tidewire.operators.browse import numbered
from tidewire.operators.skew import heavy_keys, spread_join
from tidewire.operators.stored import stored
from tidewire.schema import FLAGS
from tidewire.sources.files import FileWriter, listing, opened

PACKET = "path string, offset long, ts_ms long, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, byte_count long, flags int, ttl int, window_size int, payload binary"
#: Bytes of a segment up to which its payload is kept.
PAYLOAD_END = 100
#: Fixed values of the format: magic numbers with byte order and fractions of a second; bits of the TCP flags in the order of FLAGS.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
FLAG_BITS = (0x02, 0x10, 0x01, 0x04, 0x08, 0x20)
FILE_HEADER, HEADER = 24, 16
#: Bytes of a record that readers of captures accept at most, unless the file names more.
LONGEST = 1 << 18
BLOCK_BYTES = 64 << 20
_READ = 4 << 20
#: Bytes before a block that are looked at where less of them leave several places for its first header.
MOST_BEFORE = 16 << 20
#: First octet of the stand-ins, how many there are, and what stands for itself: dotted quads below them.
STAND_IN, STAND_INS = 240, 1 << 28
PLAIN = r"^(2[0-3][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}\z"

_OCTETS = pa.array([str(i) for i in range(256)])


@dataclass
class Block(InputPartition):
    path: str
    size: int
    start: int
    end: int


@dataclass
class Format:
    order: str
    unit: int
    longest: int

    @classmethod
    def of(cls, head: bytes, path: str) -> Format:
        if len(head) < FILE_HEADER:
            raise ValueError(f"{path} is no capture file: shorter than its header")
        if head[:4] not in MAGICS:
            what = "pcapng isn't supported" if head[:4] == b"\x0a\x0d\x0d\x0a" else "unknown magic number"
            raise ValueError(f"{path} is no classic capture file: {what}")
        order, unit = MAGICS[head[:4]]
        return cls(order, unit, max(LONGEST, struct.unpack_from(f"{order}I", head, 16)[0] % (1 << 30)))

    def next(self, data: np.ndarray, first: int, n: int, size: int) -> np.ndarray:
        """For each of the first n offsets of data, which begins at `first` of a file of some size, where the next
        header would be; -1 where no header can be."""
        n = max(0, min(n, len(data) - HEADER + 1))
        word = lambda at: np.ndarray(n, f"{self.order}u4", data, at, (1,)).astype(np.int64) if n else np.zeros(0, np.int64)
        fraction, length = word(4), word(8)
        then = np.arange(first, first + n) + HEADER + length
        return np.where((length > 0) & (length <= self.longest) & (fraction < self.unit) & (then <= size), then, -1)


def _followed(then: np.ndarray, first: int, end: int) -> np.ndarray:
    """Where the chain from each offset arrives at or behind `end`; -1 where it breaks. Steps are doubled."""
    then = then.copy()
    while len(live := np.flatnonzero((then >= 0) & (then < end))):
        at = then[live] - first
        then[live] = np.where(at < len(then), then[np.minimum(at, len(then) - 1)], -1)
    return then


def _read_at(file, at: int, n: int) -> np.ndarray:
    file.seek(at)
    return np.frombuffer(file.read(n), np.uint8)


def first_header(file, form: Format, start: int, end: int, size: int) -> int:
    """The first header of a block; its end if it has none."""
    longest = form.longest + HEADER
    stretch = 4 * longest
    while start > FILE_HEADER:
        a = max(FILE_HEADER, start - stretch)
        arrives = _followed(form.next(_read_at(file, a, start - a + HEADER - 1), a, start - a, size), a, start)
        if a == FILE_HEADER and arrives[0] >= start:
            return min(int(arrives[0]), end)
        early = arrives[:longest]  # the file's own chain has a header among the first offsets
        places = np.unique(early[early >= start])
        places = places[~np.isin(places - 4, places)]  # without shadows
        if len(places) == 1:
            return min(int(places[0]), end)
        if not len(places):
            return _after_damage(file, form, start, end, size)
        if a == FILE_HEADER or stretch >= MOST_BEFORE:
            return min(int(early[np.isin(early, places)][0]), end)
        stretch *= 4
    return FILE_HEADER


def _after_damage(file, form: Format, start: int, end: int, size: int) -> int:
    window = 2 * (form.longest + HEADER)
    for a in range(start, end, window):
        b = min(a + 2 * window, size)  # chains begin in one window and have to pass the next
        arrives = _followed(form.next(_read_at(file, a, b - a), a, b - a, size), a, b)
        found = np.flatnonzero(arrives[: min(window, end - a)] >= b)
        if len(found):
            return a + int(found[0])
    return end


def block_packets(file, form: Format, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, positions of headers in them, offset of those bytes in the file), some MB at a time."""
    at = first_header(file, form, block.start, block.end, block.size)
    two = struct.Struct(f"{form.order}II").unpack_from
    while at < block.end:
        data = _read_at(file, at, _READ)
        base, found, p, needed, ended = at, [], 0, 0, False
        while base + p < block.end:
            if p + HEADER > len(data):
                ended = base + len(data) >= block.size
                needed = HEADER
                break
            fraction, length = two(data, p + 4)
            if not 0 < length <= form.longest or fraction >= form.unit or base + p + HEADER + length > block.size:
                ended = True
                break
            if p + HEADER + length > len(data):
                needed = HEADER + length
                break
            found.append(p)
            p += HEADER + length
        if found:
            yield data, np.array(found, np.int64), base
        elif needed and not ended:  # a packet longer than what is read at once
            data = _read_at(file, at, needed if needed > HEADER else _READ)
            fraction, length = two(data, 4)
            data = _read_at(file, at, HEADER + length)
            if len(data) < HEADER + length:
                return
            yield data, np.zeros(1, np.int64), base
            p = HEADER + length
        at = base + p
        if ended:
            return


def _addresses(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*[_OCTETS.take(pa.array(data[at + i])) for i in range(4)], ".")


def decoded(data: np.ndarray, at: np.ndarray, base: int, form: Format, path: str) -> pa.RecordBatch | None:
    """The IPv4 TCP and UDP packets among those at the given headers: Ethernet frames, decoded all at once."""
    head = data[at[:, None] + np.arange(HEADER)].view(f"{form.order}u4").astype(np.int64)
    frame, length = at + HEADER, head[:, 2]
    some = np.flatnonzero(length >= 34)
    f = frame[some]
    some = some[(data[f + 12] == 8) & (data[f + 13] == 0) & (data[f + 14] >> 4 == 4)]
    f = frame[some]
    ip_head = (data[f + 14] & 15).astype(np.int64) * 4
    number, left = data[f + 23], length[some] - 14 - ip_head
    fits = (ip_head >= 20) & (((number == 6) & (left >= 20)) | ((number == 17) & (left >= 8)))
    some, f, ip_head, number, left = some[fits], f[fits], ip_head[fits], number[fits], left[fits]
    if not len(some):
        return None
    part, tcp = f + 14 + ip_head, number == 6
    two = lambda where: data[where].astype(np.int32) << 8 | data[where + 1]
    of_tcp = lambda i: np.where(tcp, part + i, part)  # noqa: E731  TCP's fields are looked at where there are any
    begin = np.where(tcp, (data[of_tcp(12)] >> 4).astype(np.int64) * 4, 8)
    size = np.maximum(0, np.minimum(left, PAYLOAD_END) - begin)
    ends = np.cumsum(size)
    payload = data[np.repeat(part + begin - (ends - size), size) + np.arange(int(ends[-1]))]
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.RecordBatch.from_pydict(
        {
            "path": pa.repeat(path, len(some)),
            "offset": base + at[some],
            "ts_ms": head[some, 0] * 1000 + head[some, 1] // (form.unit // 1000),
            "source_ip": _addresses(data, f + 26),
            "destination_ip": _addresses(data, f + 30),
            "source_port": two(part),
            "destination_port": two(part + 2),
            "protocol": pa.array(["UDP", "TCP"]).take(pa.array(tcp.astype(np.int8))),
            "byte_count": head[some, 3],
            "flags": np.where(tcp, data[of_tcp(13)], 0).astype(np.int32),
            "ttl": data[f + 22].astype(np.int32),
            "window_size": np.where(tcp, two(of_tcp(14)), 0).astype(np.int32),
            "payload": pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(payload))]),
        }
    )


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("blockBytes", BLOCK_BYTES))

    def partitions(self) -> list[Block]:
        files = listing(self.path, ".pcap")
        return [Block(p, size, max(a, FILE_HEADER), min(a + self.block, size)) for p, size in files for a in range(0, max(size, 1), self.block) if a == 0 or a + self.block > FILE_HEADER]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if block is None:
            return
        with opened(block.path) as file:
            form = Format.of(file.read(FILE_HEADER), block.path)
            for data, at, base in block_packets(file, form, block):
                batch = decoded(data, at, base, form, block.path)
                if batch is not None:
                    yield batch


class PcapWriter(FileWriter):
    """Takes the columns of flows; a packet of headers alone per flow. TCP for all protocols but UDP and ICMP; lengths on
    the wire are the flows' bytes, at least the headers'. Addresses have to be IPv4."""

    extension = ".pcap"

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        yield struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        for batch in batches:
            yield self._packets(batch)

    def _packets(self, batch: pa.RecordBatch) -> bytes:
        n = len(batch)

        def numbers(name: str, default: int = 0) -> np.ndarray:
            return pc.fill_null(batch.column(name).cast(pa.int64()), default).to_numpy(zero_copy_only=False)

        def octets(name: str) -> np.ndarray:
            parts = pc.split_pattern(pc.fill_null(batch.column(name), ""), ".")
            if pc.any(pc.not_equal(pc.list_value_length(parts), 4)).as_py():
                raise ValueError(f"{name} has other addresses than IPv4")
            return pc.list_flatten(parts).cast(pa.uint8()).to_numpy(zero_copy_only=False).reshape(n, 4)

        protocol = batch.column("protocol")
        kind = np.where(pc.fill_null(pc.equal(protocol, "UDP"), False).to_numpy(zero_copy_only=False), 17, np.where(pc.fill_null(pc.equal(protocol, "ICMP"), False).to_numpy(zero_copy_only=False), 1, 6))
        tcp, udp = kind == 6, kind == 17
        frame = np.where(tcp, 54, 42)
        out = np.zeros((n, HEADER + 54), np.uint8)

        def put(at: int, size: int, values: np.ndarray, where=slice(None), order: str = ">") -> None:
            out[where, at : at + size] = np.ascontiguousarray((values % (1 << 8 * size)).astype(f"{order}u{size}")).view(np.uint8).reshape(-1, size)

        ts = numbers("ts_ms")
        for at, values in ((0, ts // 1000), (4, ts % 1000 * 1000), (8, frame), (12, np.minimum(np.maximum(frame, numbers("byte_count")), (1 << 32) - 1))):
            put(at, 4, values, order="<")
        ip = HEADER + 14
        put(HEADER + 12, 2, np.full(n, 0x0800))
        put(ip, 1, np.full(n, 0x45))
        put(ip + 2, 2, frame - 14)
        put(ip + 8, 1, numbers("ttl", 64))
        put(ip + 9, 1, kind)
        out[:, ip + 12 : ip + 16], out[:, ip + 16 : ip + 20] = octets("source_ip"), octets("destination_ip")
        ported, part = tcp | udp, ip + 20
        put(part, 2, numbers("source_port")[ported], ported)
        put(part + 2, 2, numbers("destination_port")[ported], ported)
        put(part + 4, 2, np.full(n, 8)[udp], udp)
        flags = batch.column("flags")
        mask = sum(pc.fill_null(pc.struct_field(flags, name), False).to_numpy(zero_copy_only=False).astype(np.int64) * bit for name, bit in zip(FLAGS, FLAG_BITS, strict=True))
        put(part + 12, 1, np.full(n, 0x50)[tcp], tcp)
        put(part + 13, 1, mask[tcp], tcp)
        put(part + 14, 2, numbers("window_size")[tcp], tcp)
        return out[np.arange(out.shape[1]) < (HEADER + frame)[:, None]].tobytes()


class PcapSource(DataSource):
    """Options: path (a file, or a folder of .pcap files), blockBytes."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return PACKET

    def reader(self, schema: StructType) -> PcapReader:
        return PcapReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PcapWriter:
        return PcapWriter(self.options["path"], overwrite)


def hosts(flows: DataFrame) -> DataFrame:
    """(name, address): a stand-in for each address of the flows that isn't an IPv4 address below 240.0.0.0."""
    ends = flows.select(F.explode(F.array("source_ip", "destination_ip")).alias("name"))
    table = numbered(ends.filter(~F.col("name").rlike(PLAIN)).distinct(), "name", name="n")
    octets = [(F.shiftright("n", 24) + STAND_IN), *[F.shiftright("n", b).bitwiseAND(255) for b in (16, 8, 0)]]
    table = stored(table.select("name", F.concat_ws(".", *octets).alias("address")))
    if table.count() > STAND_INS:
        raise ValueError(f"more than {STAND_INS} addresses need stand-ins")
    return table


def _replaced(flows: DataFrame, table: DataFrame, key: str, value: str, needed: Callable[[Column], Column], *by: str) -> DataFrame:
    """The flows with those addresses that need it replaced by the table's value for them."""
    table = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    for column in ("source_ip", "destination_ip"):
        keyed = flows.withColumn("_key", F.when(needed(F.col(column)), F.col(column)))
        joined = spread_join(keyed, table, "_key", heavy_keys(keyed.select("_key"), "_key"), *by)
        flows = joined.withColumn(column, F.coalesce("_value", column)).select(*flows.columns)
    return flows


def read_pcap(spark: SparkSession, path: str, resolve_app_protocol: bool = True, block_bytes: int = BLOCK_BYTES, hosts: DataFrame | None = None) -> DataFrame:
    """A flow per IPv4 TCP or UDP packet; path and offset give their order, times are the packets' own. hosts: the table
    of stand-ins that the captures were written with."""
    spark.dataSource.register(PcapSource)
    got = spark.read.format("pcap").option("blockBytes", block_bytes).load(path)
    protocol = app_protocol(F.col("destination_port"), F.col("source_port"), F.col("protocol")) if resolve_app_protocol else F.col("protocol")
    if hosts is not None and not hosts.isEmpty():
        got = _replaced(got, hosts, "address", "name", lambda c: F.split_part(c, F.lit("."), F.lit(1)).cast("int") >= STAND_IN, "path", "offset")
    return got.select(
        F.concat_ws("-", F.sha1("path"), "offset").alias("id"),
        *("path", "offset", "ts_ms", "source_ip", "destination_ip", "source_port", "destination_port"),
        protocol.alias("protocol"),
        F.lit(1).cast("long").alias("packet_count"),
        "byte_count",
        F.lit(0.0).alias("duration"),
        F.struct(*[(F.col("flags").bitwiseAND(b) != 0).alias(n) for n, b in zip(FLAGS, FLAG_BITS, strict=True)]).alias("flags"),
        *("ttl", "window_size", "payload"),
        F.lit(False).alias("is_anomaly"),
    )


def write_pcap(flows: DataFrame, folder: str, overwrite: bool = False, hosts: DataFrame | None = None) -> None:
    """Captures of the flows in their order: files are ranges of seq. hosts: stand-ins for what is no IPv4 address; without
    them such flows are an error."""
    flows.sparkSession.dataSource.register(PcapSource)
    columns = ("ts_ms", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "byte_count", "flags", "ttl", "window_size")
    flows = flows.select("seq", *columns)
    if hosts is not None and not hosts.isEmpty():
        flows = _replaced(flows, hosts, "name", "address", lambda c: ~c.rlike(PLAIN), "seq")
    ordered = flows.repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.select(*columns).write.format("pcap").mode("overwrite" if overwrite else "append").save(folder)
