"""Edge rules by hand-made cases."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.functions import network
from tidewire.functions.distance import array_distance
from tidewire.functions.features import Scaler
from tidewire.operators import browse, clustering, detect, models, reduction, sinks, statistics
from tidewire.sources import capture, generator
from plain_pcap import packets
from tidewire.sources.pcap import read_pcap


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def points(spark, rows):
    return spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(rows)], "id string, seq long, x double, y double")


def test_scaling_of_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "a double, b double")
    assert one(Scaler.min_max(df, ["a", "b"]).apply(df), "a", "b") == [(0.0, 0.0), (2 / 3, 0.0), (1.0, 0.0)]
    z = Scaler.z_score(df, ["a", "b"])
    assert round(z.scales[0], 4) == 1.2472 and one(z.apply(df), "b") == [(0.0,)] * 3


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert one(df, array_distance("a", "b", 2, "cosine")) == [(1.0,)]
    with pytest.raises(ValueError, match="unknown metric"):
        array_distance("a", "b", 2, "mahalanobis")


@pytest.mark.parametrize(("score", "level"), [(0.85, "critical"), (0.65, "high"), (0.40, "medium"), (0.39, "low")])
def test_severity(spark, score, level):
    assert one(spark.range(1), network.severity(F.lit(score))) == [(level,)]


def test_addresses(spark):
    ips = ["10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.9.9", "8.8.8.8", "224.0.0.5", "10.0.0.255", "x", "240.0.0.1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    assert [r[0] for r in one(df, network.is_private(F.col("ip")))] == [True, True, False, True, False, False, True, False, False]
    assert [r[0] for r in one(df, network.is_broadcast(F.col("ip")))] == [False] * 5 + [True, True, False, False]
    ports = spark.createDataFrame([(80, "TCP"), (80, "HTTP"), (9999, "TCP"), (5353, "DNS")], "p int, n string")
    assert [r[0] for r in one(ports, network.is_mismatch(F.col("p"), F.col("n")))] == [True, False, False, False]


def test_capture_lines(spark):
    def line(**f):
        return "\t".join(f.get(n, "") for n in capture.FIELDS)

    base = {"time_epoch": "1.5", "src": "10.0.0.1", "dst": "8.8.8.8"}
    lines = [
        line(**base, proto="6", tcp_src="50000", tcp_dst="443", flags="0x0018", window="0"),
        line(**base, proto="6", tcp_src="22", tcp_dst="50000"),
        line(**base, proto="6", tcp_src="50001", tcp_dst="x12"),
        line(**base, proto="17", udp_src="50001", udp_dst="50000", length="0", ttl="7z"),
        *[line(**base, proto=p) for p in ("1", "2", "47", "50", "51", "58", "89", "18", "")],
        line(dst="8.8.8.8", proto="6"),
        "",
    ]
    got = capture.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.protocol for r in got] == ["HTTPS", "SSH", "TCP", "UDP", "ICMP", "IGMP", "GRE", "ESP", "AH", "ICMPv6", "OSPF", "OTHER", "OTHER"]
    assert got[0].flags.psh and got[0].flags.ack and not got[0].flags.syn and got[0].window_size == 0 and got[0].ts_ms == 1500
    assert (got[1].byte_count, got[1].ttl, got[1].window_size, got[2].destination_port) == (64, 64, 65535, 0)
    assert (got[3].byte_count, got[3].ttl) == (64, 7)
    listed = capture.interfaces(spark.createDataFrame([("1. eth0 (Wired)",), ("2. lo",), ("noise",)], "value string")).collect()
    assert [tuple(r) for r in listed] == [(1, "eth0", "Wired"), (2, "lo", None)]


def frame(transport, body, kind=b"\x08\x00", version=0x45):
    ip = struct.pack(">BBHHHBBH4s4s", version, 0, 20 + len(body), 0, 0, 64, transport, 0, bytes([10, 0, 0, 1]), bytes([8, 8, 8, 8]))
    return bytes(12) + kind + ip + body


def capture_file(frames, order="<", end=b""):
    out = struct.pack(f"{order}IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for f in frames:
        out += struct.pack(f"{order}IIII", 10, 250_000, len(f), len(f)) + f
    return out + end


def test_pcap(spark, tmp_path):
    tcp = struct.pack(">HHIIBBHHH", 1000, 443, 0, 0, 0x60, 0x12, 77, 0, 0) + b"opts" + b"hello"
    udp = struct.pack(">HHHH", 5000, 53, 8, 0) + b"q"
    frames = [frame(6, tcp), frame(17, udp), frame(1, b"\0" * 20), frame(6, tcp, b"\x08\x06"), frame(6, tcp, b"\x86\xdd"), frame(17, b"\0" * 4)]
    for order in "<>":
        got = list(packets(capture_file(frames, order, struct.pack(f"{order}IIII", 1, 1, 99, 99) + b"cut")))
        assert [(g[0], g[6]) for g in got] == [(0, "TCP"), (1, "UDP")]
        assert got[0][1] == 10_250 and got[0][4:6] == (1000, 443) and got[0][8:11] == (0x12, 64, 77) and got[0][11] == b"hello"
    assert list(packets(capture_file(frames[:1], end=struct.pack("<IIII", 1, 1, 0, 0)))) and len(list(packets(capture_file([])))) == 0
    for bad in (b"", b"\x0a\x0d\x0d\x0a" + bytes(30), bytes(30)):
        with pytest.raises(ValueError, match="capture file"):
            list(packets(bad))
    (tmp_path / "a.pcap").write_bytes(capture_file(frames))
    (tmp_path / "b.txt").write_bytes(b"no capture")
    rows = read_pcap(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r.protocol for r in rows] == ["HTTPS", "DNS"] and rows[0].flags.syn and rows[0].flags.ack and not rows[0].flags.fin
    assert capture.uploads(spark, str(tmp_path)).count() == 1 and capture.uploads(spark, str(tmp_path), 10).count() == 0


def flow_rows(spark, rows):
    """rows: (seq, ts_ms, source, destination, bytes)"""
    base = generator.generate(spark, len(rows)).drop("ts_ms", "source_ip", "destination_ip", "byte_count")
    return base.join(spark.createDataFrame(rows, "seq long, ts_ms long, source_ip string, destination_ip string, byte_count long"), "seq")


def test_burst_excludes_the_bound(spark):
    df = flow_rows(spark, [(0, 0, "a", "8.8.8.8", 1), (1, 60_000, "a", "8.8.8.8", 1), (2, 119_999, "a", "8.8.8.8", 1)])
    assert sorted(one(statistics.burst_counts(df), "seq", "near_count")) == [(0, 1), (1, 2), (2, 2)]


def test_trailing_zscore_needs_all_rows_before(spark):
    df = spark.createDataFrame([(i, i, 1.0 if i < 11 else 50.0) for i in range(12)], "seq long, ts_ms long, v double")
    for piece in (100, 11, 1000):
        got = dict(one(statistics.trailing_zscore(df, "v", piece=piece), "seq", "is_outlier"))
        assert [got[i] for i in range(12)] == [False] * 11 + [True]


def test_time_series_of_one_moment(spark):
    df = flow_rows(spark, [(0, 5, "a", "b", 1), (1, 5, "a", "b", 2)])
    assert one(statistics.time_series(df), "start_ms", "flow_count", "byte_count") == [(5, 2, 3)]
    assert statistics.time_series(df.limit(0)).count() == 0


def test_rest_stays_apart_from_a_protocol_of_its_name(spark):
    counts = spark.createDataFrame([("OTHER", 9), ("A", 8), ("B", 1), ("C", 1)], "protocol string, flow_count long")
    assert sorted(one(statistics.top_with_rest(counts, n=2), "protocol", "is_rest", "flow_count")) == [("A", False, 8), ("OTHER", False, 9), ("OTHER", True, 2)]


def test_pages_are_clamped(spark):
    df = spark.range(10).withColumnRenamed("id", "seq").orderBy("seq")
    assert one(browse.page(df, 9, 4), "seq") == [(8,), (9,)] and one(browse.page(df, 0, 4), "seq") == [(0,), (1,), (2,), (3,)]


def test_dbscan_counts_others_only(spark):
    two = points(spark, [(0, 0), (0, 0.5)])
    assert one(clustering.dbscan(two, 0.6, 1, ["x", "y"]).assignments, "cluster_id") == [(0,), (0,)]
    # the middle row is no core row and lies near both clusters
    rows = [(-1.3, 0), (-1.2, 0), (-1.1, 0), (-1.0, 0), (0, 0), (1.0, 0), (1.1, 0), (1.2, 0), (1.3, 0), (9, 9)]
    got = dict(one(clustering.dbscan(points(spark, rows), 1.0, 3, ["x", "y"]).assignments, "id", "cluster_id"))
    assert [got[str(i)] for i in range(10)] == [0, 0, 0, 0, 0, 1, 1, 1, 1, -1]


def test_dbscan_against_plain_version(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (25, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [rng.uniform(-2, 5, (15, 2))])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.4
    np.fill_diagonal(near, False)
    core, label, n = near.sum(1) >= 4, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            queue = [i]
            while queue:
                j = queue.pop()
                if label[j] < 0:
                    label[j] = n
                    queue += np.flatnonzero(near[j]).tolist() if core[j] else []
            n += 1
    got = dict(one(clustering.dbscan(points(spark, x), 0.4, 4, ["x", "y"]).assignments, "id", "cluster_id"))
    assert [got[str(i)] for i in range(len(x))] == label.tolist()


def test_k_means_bounds(spark):
    df = points(spark, [(0, 0), (0, 1), (9, 9)])
    found = clustering.k_means(df, 5, columns=["x", "y"])
    assert len(found.centroids) <= 5 and found.inertia < 1e-9 and found.converged
    assert clustering.k_means(df.limit(0), 3, columns=["x", "y"]).assignments.count() == 0


def test_silhouette_edges(spark):
    df = points(spark, [(0, 0), (0, 1), (5, 5)])
    alone = df.select("id", F.lit(0).alias("cluster_id"))
    assert {r[0] for r in one(clustering.silhouette(df, alone, ["x", "y"]), "score")} == {-1.0}
    single = df.select("id", F.col("seq").cast("int").alias("cluster_id"))
    assert {r[0] for r in one(clustering.silhouette(df, single, ["x", "y"]), "score")} == {1.0}


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward", "centroid"])
def test_agglomeration(spark, linkage):
    df = points(spark, [(0, 0), (0, 1), (10, 0), (10, 1), (50, 50)])
    got = dict(one(clustering.hierarchical(df, 3, linkage, ["x", "y"]).assignments, "id", "cluster_id"))
    assert got["0"] == got["1"] != got["2"] == got["3"] != got["4"]
    with pytest.raises(ValueError, match="more than 2 rows"):
        clustering.hierarchical(df, columns=["x", "y"], most=2)


def test_other_algorithms_find_two_groups(spark):
    rng = np.random.default_rng(1)
    df = points(spark, np.concatenate((rng.normal(0, 0.1, (30, 2)), rng.normal(4, 0.1, (30, 2)))))
    for name, parameters in (("Mean Shift", {"bandwidth": 1.0}), ("Gaussian-Mixture Model", {"k": 2}), ("K-Means++", {"k": 2})):
        got = dict(one(clustering.algorithm(name)(df, columns=["x", "y"], **parameters).assignments, "id", "cluster_id"))
        assert len({got[str(i)] for i in range(30)}) == 1 == len({got[str(i)] for i in range(30, 60)}) and got["0"] != got["30"], name
    som = dict(one(clustering.algorithm("som")(df, 2, columns=["x", "y"]).assignments, "id", "cluster_id"))
    assert not {som[str(i)] for i in range(30)} & {som[str(i)] for i in range(30, 60)}
    with pytest.raises(ValueError, match="no algorithm"):
        clustering.algorithm("Spectral")


def test_elbow_chord():
    assert clustering.chord([10, 2, 1, 0.9, 0.8]) == 1 and clustering.chord([1, 1]) == 0 and clustering.chord([0, 0, 0]) == 0


def test_hull_contains_all_points(spark):
    rng = np.random.default_rng(2)
    xy = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(i % 2, float(a), float(b)) for i, (a, b) in enumerate(xy)], "cluster_id int, x double, y double")
    for c, part in reduction.cluster_hulls(df).toPandas().groupby("cluster_id"):
        h = part.sort_values("corner")[["x", "y"]].to_numpy()
        for a, b in zip(h, np.roll(h, -1, 0)):
            own = xy[c::2]
            assert ((b[0] - a[0]) * (own[:, 1] - a[1]) - (b[1] - a[1]) * (own[:, 0] - a[0]) > -1e-9).all()
    assert reduction.cluster_hulls(df.limit(1)).count() == 0


def test_pca_shares(spark):
    df = spark.createDataFrame([(str(i), float(i), 2.0 * i, 3.0) for i in range(10)], "id string, a double, b double, c double")
    rows, shares = reduction.pca(df, 2, ["a", "b", "c"])
    assert rows.count() == 10 and shares[0] > 0.999


def test_attacks_and_injection(spark):
    scan = generator.attack(spark, "Port Scan", "203.0.113.9", intensity=200)
    assert scan.select("source_ip").distinct().count() == 1 and scan.select("destination_port").distinct().count() > 150
    assert generator.attack(spark, "DDoS Attack", "203.0.113.9", intensity=50).select("destination_ip").distinct().count() == 1
    flows = generator.generate(spark, 100, seed=3)
    private = flows.filter(network.is_private(F.col("source_ip"))).count()
    assert 50 <= private <= 90 and flows.count() == 100
    more = generator.inject(flows, 10**12)
    assert more.count() == 105 and more.filter("ts_ms = 1000000000000 and is_anomaly and flags.syn").count() == 5 and more.agg(F.max("seq")).first()[0] == 104


def test_outliers_without_finding_are_appended(spark):
    flows = generator.generate(spark, 60, seed=1)
    quiet = detect.Thresholds(z=1e9, ports=10**6, burst=10**6, deviations=1e9, cv=-1.0, countries=10**6, listed=("US", "CN"))
    found = detect.detect(flows, t=quiet)
    ids = [r.id for r in flows.join(found, "id", "left_anti").limit(2).collect()] + [found.first().id]
    outliers = spark.createDataFrame([(i, 0, 2.0, 0.9, "critical", 1.0) for i in ids], "id string, nearest_id int, distance double, score double, severity string, confidence double")
    every = detect.detect_all(flows, outliers, quiet)
    assert every.count() == found.count() + 2 and every.filter("array_contains(types, 'Cluster Outlier')").count() == 2
    known = detect.detect(flows, baseline=flows, t=quiet)
    assert known.count() == found.count()


def test_report_and_export(spark, tmp_path):
    flows = generator.generate(spark, 30)
    found = detect.detect_all(flows)
    text = sinks.report("Traffic", [("summary", "Summary"), ("flows", "First"), ("anomalies", "Found"), ("other", "Empty")], flows, found, 3)
    assert text.startswith("# Traffic\n\n## Summary\nTotal Flows: 30\n") and "Clusters: 3" in text and text.count("\n- flow-") == 10
    sinks.export({"flows": flows, "anomalies": found}, str(tmp_path), "xml")
    sinks.write_display_csv(flows, str(tmp_path / "display"))
    assert spark.read.option("header", True).csv(str(tmp_path / "display")).columns[:2] == ["Timestamp", "Source IP"]
    with pytest.raises(ValueError, match="can't write"):
        sinks.export({}, str(tmp_path), "pdf")


def test_model_registry(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "kmeans", 1, 0.5, 0.4, 0.0, 0.75, "{}"), (1, "b", "gmm", 2, 0.5, 0.4, 0.0, 0.75, "{}"), (2, "c", "som", 3, 0.1, 0.1, 0.0, 0.5, "{}")], models.MODEL)
    models.save(rows, str(tmp_path / "m"))
    got = models.statistics(models.load(spark, str(tmp_path / "m"))).first()
    assert (got.n_models, got.best, got.latest) == (3, "a", "c") and round(got.avg_quality, 4) == 0.6667
    assert models.without(rows, "a").count() == 2


def test_hot_groups_are_cut_by_time(spark):
    """Bursts and gaps of a busy address, over borders of the pieces of time, equal to a plain loop."""
    import random

    from tidewire.operators.statistics import burst_counts, interarrival

    rng = random.Random(6)
    times = [rng.randrange(-50_000, 200_000) for _ in range(400)] + [0, 9_999, 10_000, 10_001, 19_999, 20_000] * 2
    rows = [(i, "hot" if i % 2 else f"h{i % 7}", t) for i, t in enumerate(times)] + [(9999, None, 5)]
    flows = spark.createDataFrame([(i, a, a, t) for i, a, t in rows], "seq long, source_ip string, destination_ip string, ts_ms long")
    known = spark.createDataFrame([(a, t) for _, a, t in rows[::3]], "destination_ip string, ts_ms long")
    for other, counted in ((None, rows), (known, rows[::3])):
        got = {r.seq: r.near_count for r in burst_counts(flows, 1000, other).collect()}
        assert got == {i: sum(b == a and abs(u - t) < 1000 for _, b, u in counted) for i, a, t in rows}
    for r in interarrival(flows, 10_000).collect():
        own = sorted(t for _, a, t in rows if a == r.source_ip)
        gaps = [y - x for x, y in zip(own, own[1:])]
        assert r.flows == len(own)
        if gaps:
            mean = sum(gaps) / len(gaps)
            assert abs(r.gap_mean - mean) < 1e-6 and abs(r.gap_std - (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5) < 1e-6
