"""Captures in blocks against captures read packet by packet; the writer's files and what failed tasks leave."""

import io
import os
import random
import struct

import pytest
from plain_pcap import packets
from pyspark.sql import functions as F

from tidewire.plans.views import flows
from tidewire.sources import pcap
from tidewire.sources.pcap import Block, Format, block_packets, decoded, first_header, hosts, read_pcap, write_pcap


def frame(rng, kind, payload):
    part = {6: struct.pack(">HHIIBBHHH", rng.randrange(65536), 443, 0, 0, rng.choice([0x50, 0x60, 0xF0]), rng.randrange(64), 77, 0, 0), 17: struct.pack(">HHHH", 53, 5000, 8, 0), 1: bytes(8)}[kind]
    ip = struct.pack(">BBHHHBBH4s4s", rng.choice([0x45, 0x45, 0x46, 0x65, 0x44]), 0, 0, 0, 0, rng.randrange(256), kind, 0, rng.randbytes(4), rng.randbytes(4))
    return bytes(12) + rng.choice([b"\x08\x00"] * 4 + [b"\x86\xdd"]) + ip + part + payload


def capture(n, seed, order="<", unit=10**6, inner=b"", more=9):
    """Payloads are random, zeros, small numbers, or captures themselves."""
    rng = random.Random(seed)
    out = struct.pack(f"{order}IHHiIII", 0xA1B2C3D4 if unit == 10**6 else 0xA1B23C4D, 2, 4, 0, 0, 400, 1)
    for i in range(n):
        payload = rng.choice([rng.randbytes(rng.randrange(60)), bytes(rng.randrange(90)), struct.pack(f"{order}I", rng.randrange(1, 40)) * rng.randrange(30), inner[24 : 24 + rng.randrange(300)]])
        f = frame(rng, rng.choice([6, 6, 17, 1]), payload) if rng.random() < 0.95 else rng.randbytes(rng.randrange(1, 40))
        out += struct.pack(f"{order}IIII", 1_700_000_000 + i, rng.randrange(unit), len(f), len(f) + rng.randrange(more)) + f
    return out


def offsets(data, start, end, longest=450):
    head = Format.of(data[:24], "x")
    form = Format(head.order, head.unit, longest)
    return [base + int(p) for _, at, base in block_packets(io.BytesIO(data), form, Block("x", len(data), start, end)) for p in at]


def every_offset(data, order="<"):
    at, out = 24, []
    while at + 16 <= len(data):
        size = struct.unpack_from(f"{order}I", data, at + 8)[0]
        if at + 16 + size > len(data):
            break
        out.append(at)
        at += 16 + size
    return out


@pytest.mark.parametrize("order, unit, end", [("<", 10**6, b""), (">", 10**9, b"cut"), ("<", 10**6, struct.pack("<IIII", 1, 1, 99, 99) + b"cut off")])
def test_every_cut_point(order, unit, end):
    inner = capture(20, 1, order, unit)
    data = capture(60, 2, order, unit, inner) + end
    want = every_offset(data, order)
    for cut in range(24, len(data) + 1):
        assert offsets(data, 24, cut) + offsets(data, cut, len(data)) == want
    for size in (16, 100, 333, 1000):
        cuts = [*range(24, len(data), size), len(data)]
        assert [o for a, b in zip(cuts[:-1], cuts[1:]) for o in offsets(data, a, b)] == want


def test_a_capture_within_a_packet():
    """A whole capture as one long payload: its chain lasts for a while, and breaks at the packet's end."""
    inner = capture(200, 3)[24:]
    f = frame(random.Random(5), 17, inner)
    data = capture(30, 4) + struct.pack("<IIII", 1, 1, len(f), len(f)) + f + capture(30, 6)[24:]
    want = every_offset(data)
    for cut in range(24, len(data), 37):
        assert offsets(data, 24, cut, 1 << 15) + offsets(data, cut, len(data), 1 << 15) == want


def test_shadows():
    """Where captured and original lengths are equal, a second chain runs four bytes behind the headers."""
    data = capture(300, 13, more=1)
    want = every_offset(data)
    for cut in range(24, len(data), 7):
        form = Format("<", 10**6, 450)
        assert first_header(io.BytesIO(data), form, cut, len(data), len(data)) == next((o for o in want if o >= cut), len(data))


def test_small_reads(monkeypatch):
    data = capture(60, 7, inner=capture(9, 1))
    for n in (16, 50, 200):
        monkeypatch.setattr(pcap, "_READ", n)
        assert offsets(data, 24, len(data)) == every_offset(data)


def test_after_damage():
    """Behind zeros or noise, later blocks find headers again."""
    rest = capture(80, 9)[24:]
    for damage in (bytes(1000), random.Random(8).randbytes(1000)):
        data = capture(20, 8) + damage + rest
        after = len(data) - len(rest)
        got = offsets(data, after - 300, len(data), 200)
        assert got == [after + o - 24 for o in every_offset(data[:24] + rest)]
    form = Format("<", 10**6, 200)
    zeros = capture(3, 8) + bytes(5000)
    assert first_header(io.BytesIO(zeros), form, 3000, 4000, len(zeros)) == 4000 and offsets(zeros, 24, len(zeros)) == every_offset(capture(3, 8))


def test_decoding():
    for order, unit in (("<", 10**6), (">", 10**9)):
        data = capture(400, 11, order, unit)
        head = Format.of(data[:24], "x")
        got = [tuple(r.values()) for x, at, base in block_packets(io.BytesIO(data), head, Block("x", len(data), 24, len(data))) for r in decoded(x, at, base, head, "p").to_pylist()]
        numbered = every_offset(data, order)
        if unit == 10**6:
            want = [("p", numbered[n], *x) for n, *x in packets(data)]
            assert got == want and len(want) > 100
        else:
            assert len(got) > 100 and all(0 <= r[2] - 1_700_000_000_000 < 400_000 for r in got)


def test_blocks_in_spark(spark, tmp_path):
    data = capture(2000, 12, inner=capture(9, 1))
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pcap").write_bytes(data)
    (tmp_path / "sub" / "b.pcap").write_bytes(capture(0, 1))
    (tmp_path / "_c.pcap").write_bytes(b"hidden")
    whole = read_pcap(spark, str(tmp_path))
    cut = read_pcap(spark, f"file://{tmp_path}", block_bytes=5000)
    assert cut.rdd.getNumPartitions() > 30 and whole.rdd.getNumPartitions() == 2
    assert sorted(map(str, whole.drop("path", "id").collect())) == sorted(map(str, cut.drop("path", "id").collect()))
    assert whole.count() == len(list(packets(data)))
    (tmp_path / "bad.pcap").write_bytes(b"\x0a\x0d\x0d\x0a" + bytes(60))
    with pytest.raises(Exception, match="pcapng isn't supported"):
        read_pcap(spark, str(tmp_path)).count()


def test_writer(spark, tmp_path):
    f = flows(spark, "/root/testdata/sf0.001")
    path = f"file://{tmp_path}/out"
    write_pcap(f, path)
    got = read_pcap(spark, path, resolve_app_protocol=False)
    want = {(r.ts_ms, r.source_ip, r.destination_ip, r.source_port, r.destination_port, "UDP" if udp else "TCP", max(r.byte_count, 42 if udp else 54), r.ttl, r.window_size * (not udp), *(() if udp else r.flags)) for r in f.filter("protocol <> 'ICMP'").collect() for udp in [r.protocol == "UDP"]}
    rows = got.collect()
    assert {(r.ts_ms, r.source_ip, r.destination_ip, r.source_port, r.destination_port, r.protocol, r.byte_count, r.ttl, r.window_size, *(() if r.protocol == "UDP" else r.flags)) for r in rows} == want
    assert len(rows) == f.filter("protocol <> 'ICMP'").count() < f.count()
    once = sorted(os.listdir(tmp_path / "out"))
    write_pcap(f, path)
    assert read_pcap(spark, path).count() == 2 * len(rows)
    write_pcap(f, path, overwrite=True)
    again = sorted(os.listdir(tmp_path / "out"))
    assert len(again) == len(once) and set(again) & set(once) == {"_SUCCESS"} and read_pcap(spark, path).count() == len(rows)


def test_failed_write_leaves_nothing(spark, tmp_path):
    f = flows(spark, "/root/testdata/sf0.001")
    bad = f.withColumn("source_ip", F.when(F.col("seq") == 900, "::1").otherwise(F.col("source_ip")))
    with pytest.raises(Exception, match="other addresses than IPv4"):
        write_pcap(bad, f"file://{tmp_path}/out")
    assert [x for _, _, names in os.walk(tmp_path) for x in names] == []
    write_pcap(f.limit(0), f"file://{tmp_path}/none")
    assert read_pcap(spark, f"file://{tmp_path}/none").count() == 0


def test_addresses_that_need_more_than_four_bytes(spark, tmp_path):
    """Octets above 255 (the tables' sources from user 65536 on), names, and addresses of the stand-ins' own block."""
    f = flows(spark, "/root/testdata/sf0.001").filter("protocol <> 'ICMP'").repartition(5)
    other = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("10.0.258."), F.col("seq") % 40)).when(F.col("seq") % 50 == 1, "240.0.0.1").when(F.col("seq") % 50 == 2, "::1")
    f = f.withColumns({"source_ip": F.coalesce(other, "source_ip"), "destination_ip": F.when(F.col("seq") % 2 == 0, "a host").otherwise(F.col("destination_ip"))})
    table = hosts(f)
    rows = table.collect()
    assert len({r.address for r in rows}) == len(rows) and {"10.0.258.0", "240.0.0.1", "::1", "a host"} <= {r.name for r in rows}
    assert all(r.address.startswith("240.0.0.") for r in rows)
    path = f"file://{tmp_path}/out"
    write_pcap(f, path, hosts=table)
    got = read_pcap(spark, path, hosts=table)
    ends = ("ts_ms", "source_ip", "destination_ip", "source_port", "destination_port")
    assert sorted(tuple(r) for r in got.select(*ends).collect()) == sorted(tuple(r) for r in f.select(*ends).collect())
    assert hosts(flows(spark, "/root/testdata/sf0.001")).count() == 0
