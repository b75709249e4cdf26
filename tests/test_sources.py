import random
import struct

import pytest
from pyspark.sql import functions as F

from alarmloom.plans import triage
from alarmloom.registry import fixtures as fx
from alarmloom.sources import captures, flows, logs, results


def ethernet(payload, kind=0x0800, tags=()):
    head = b"\0" * 12
    for tag in tags:
        head += struct.pack(">HH", tag, 7)
    return head + struct.pack(">H", kind) + payload


def ip(body, protocol=6, fragment=0, version=4, options=b"", pad=b""):
    header = 20 + len(options)
    start = struct.pack(">BBHHHBBH", version << 4 | header // 4, 0, header + len(body), 0, fragment, 64, protocol, 0)
    return start + bytes([10, 0, 0, 1]) + bytes([192, 168, 0, 2]) + options + body + pad


def tcp(data=b"", flags=0x02, sport=50000, dport=443, offset=5):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, offset << 4, flags, 0, 0, 0) + b"\0" * 4 * (offset - 5) + data


def capture(frames, order=">", magic=0xA1B2C3D4, link=1, cut=0):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, frame in enumerate(frames):
        out += struct.pack(order + "IIII", 1700000000 + i, 250000, len(frame), len(frame)) + frame
    return out[: len(out) - cut]


GOOD = [
    ethernet(ip(tcp(b"hello", 0x18))),
    ethernet(ip(tcp(), version=6)),
    ethernet(ip(b"\0" * 20, protocol=17)),
    ethernet(ip(tcp(b"abc"), options=b"\1\1\1\1", pad=b"\0" * 9), tags=(0x8100,)),
    ethernet(ip(tcp(), fragment=5)),
    ethernet(b"\0" * 30, kind=0x0806),
    b"\0" * 5,
    ethernet(ip(tcp(b"xy", 0x11, offset=8))),
    ethernet(ip(tcp(offset=4))),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    files = {
        "FP/big.pcap": capture(GOOD),
        "FP/little.pcap": capture(GOOD, "<"),
        "TP/nano.pcap": capture(GOOD[:1], magic=0xA1B23C4D),
        "TP/empty.pcap": capture([]),
        "TP/cut.pcap": capture(GOOD, cut=len(GOOD[-1]) + 3),
        "TP/junk.pcap": b"not a capture at all, but long enough",
        "TP/link.pcap": capture(GOOD, link=101),
        "TP/notes.txt": b"ignored",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_capture_ingest(spark, folder):
    rows = captures.read_captures(spark, folder).orderBy("label", "case_id", "packet_no").collect()
    assert [(r["case_id"], r["packet_no"]) for r in rows] == [
        (name, n) for name in ("big.pcap", "little.pcap") for n in (1, 2, 3)
    ] + [("nano.pcap", 1)]
    assert [(r["tcp_flag"], r["payload_size"]) for r in rows[:3]] == [("ACK+PSH", 5), ("SYN", 3), ("ACK+FIN", 2)]
    assert rows[0]["src_ip"] == "10.0.0.1" and rows[0]["dst_ip"] == "192.168.0.2"
    assert (rows[0]["client_ip"], rows[0]["direction"], rows[0]["src_port"]) == ("10.0.0.1", "C_to_S", 50000)
    assert rows[0]["ts"].timestamp() == 1700000000.25
    errors = captures.ingest_errors(captures.decode_files(captures.read_files(spark, folder)))
    assert {r["path"].rsplit("/", 1)[1] for r in errors.collect()} == {"cut.pcap", "junk.pcap", "link.pcap"}


def plain_packets(data):
    """Fields of the TCP packets of a capture, record by record."""
    order, units = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9)}[data[:4]]
    at, out = 24, []
    while at < len(data):
        seconds, part, held, _ = struct.unpack_from(order + "IIII", data, at)
        frame = data[at + 16 : at + 16 + held]
        at += 16 + held
        kind, skip = frame[12:14], 14
        while kind in (b"\x81\x00", b"\x88\xa8"):
            kind, skip = frame[skip + 2 : skip + 4], skip + 4
        body = frame[skip:]
        if kind != b"\x08\x00" or len(body) < 20 or body[0] >> 4 != 4 or body[9] != 6 or int.from_bytes(body[6:8]) & 0x1FFF:
            continue
        header, total = (body[0] & 15) * 4, int.from_bytes(body[2:4])
        segment = body[header : total or len(body)]
        if header < 20 or len(segment) < 20 or segment[12] >> 4 < 5:
            continue
        size = max(0, len(segment) - (segment[12] >> 4) * 4)
        out.append((round(seconds + part / units, 6), int.from_bytes(segment[:2]), int.from_bytes(segment[2:4]), segment[13], size))
    return out


def fuzzed(seed, n=150):
    """Frames with random damage and with whole captures as payload, in which other headers chain."""
    rng = random.Random(seed)
    frames = []
    for _ in range(n):
        inner = capture([ethernet(ip(tcp(b"x" * rng.randrange(40))))] * rng.randrange(60))
        frame = bytearray(ethernet(ip(tcp(rng.choice([b"", b"data", inner[24:], inner, bytes(900)]), flags=rng.randrange(64)), options=b"\1" * 4 * rng.randrange(3), pad=b"\0" * rng.randrange(9)), tags=(0x8100, 0x88A8)[: rng.randrange(3)]))
        if rng.random() < 0.3:
            frame[rng.randrange(len(frame))] = rng.randrange(256)
        frames.append(bytes(frame[: rng.randrange(len(frame))] if rng.random() < 0.2 else frame))
    return frames


@pytest.mark.parametrize("range_bytes", [97, 1000, 20_000, 1 << 26])
def test_byte_ranges_give_the_packets_of_whole_files(spark, tmp_path, range_bytes):
    files = {
        "FP/a.pcap": capture(fuzzed(1, 60)),
        "FP/a.1.pcap": capture(fuzzed(2, 20), "<"),
        "FP/a.10.pcap": capture(fuzzed(3, 20), magic=0xA1B23C4D),
        "FP/a.2.pcap": capture(fuzzed(4, 20), cut=9),
        "TP/b.pcap": capture(fuzzed(5, 20) + [ethernet(ip(tcp(b"z" * 60_000)))] + fuzzed(6, 5)),
        "TP/none.pcap": b"",
        "TP/torn.pcap": capture(fuzzed(7, 30)) + b"abc",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    decoded = captures.scan(spark, str(tmp_path), range_bytes)
    fields = ("ts", "src_port", "dst_port", "payload_size")
    for rotated in (False, True):
        rows = captures.packets_of(decoded, rotated).orderBy("label", "case_id", "packet_no").collect()
        found = {}
        for r in rows:
            held = found.setdefault((r["label"], r["case_id"]), [])
            held.append((round(r["ts"].timestamp(), 6), *(r[f] for f in fields[1:])))
            assert r["packet_no"] == len(held)
        plain = {tuple(k.split("/")): [(p[0], p[1], p[2], p[4]) for p in plain_packets(v)] for k, v in files.items() if v and "torn" not in k}
        if rotated:
            plain["FP", "a.pcap"] = sum((plain.pop(("FP", f"a{k}.pcap")) for k in (".1", ".2", ".10")), plain["FP", "a.pcap"])
        assert found == {k: v for k, v in plain.items() if v}
    errors = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in captures.ingest_errors(decoded).collect()}
    assert errors == {"none.pcap": "not a capture file", "torn.pcap": "record header is cut off"}
    if range_bytes == 1000:
        whole = captures.packets_of(captures.decode_files(captures.read_files(spark, str(tmp_path))))
        ranged = captures.packets_of(decoded)
        assert whole.exceptAll(ranged).count() == 0 and ranged.exceptAll(whole).count() == 0


def test_written_captures_are_rotated_and_read_back(spark, tmp_path):
    packets = fx.with_real_addresses(fx.packets(spark, "/root/testdata/sf0.001").rows)
    captures.write_captures(packets, str(tmp_path), file_packets=7)
    names = {p.name for p in tmp_path.rglob("*")}
    assert not [n for n in names if "pcap" in n and not n.endswith(".pcap")] and "flow_0.1.pcap" in names
    read = captures.read_captures(spark, str(tmp_path), range_bytes=300, rotated=True)
    columns = ["label", "packet_no", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "tcp_flag", "payload_size"]
    case = F.regexp_replace("case_id", ".pcap$", "").alias("case_id")
    one, other = read.select(case, *columns), packets.select("case_id", *(F.col(c).cast(read.schema[c].dataType) for c in columns))
    assert one.exceptAll(other).count() == 0 and one.count() == other.count() == 1000


def test_flow_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("duration,protocol\n0.5,TCP\n0,UDP\n1.5,TCP\n")
    (tmp_path / "two.csv").write_text("duration,protocol\n2.5,TCP\n")
    (tmp_path / "notes.txt").write_text("duration\n9\n")
    found = flows.read_flows(spark, str(tmp_path))
    assert {(r["flow_identifier"], r["duration"]) for r in found.collect()} == {
        ("one_flow_0", "0.5"), ("one_flow_1", "0"), ("one_flow_2", "1.5"), ("two_flow_0", "2.5")
    }
    (tmp_path / "three.csv").write_text("protocol,index,extra\nICMP,77,4.0\n")
    mixed = flows.read_flows(spark, str(tmp_path), mixed=True)
    rows = {r["flow_identifier"]: r for r in mixed.collect()}
    assert set(rows) == {"one_flow_0", "one_flow_1", "one_flow_2", "two_flow_0", "three_flow_77"}
    assert rows["three_flow_77"]["duration"] is None and rows["three_flow_77"]["extra"] == "4.0"
    numeric = flows.numeric_columns(mixed, ["flow_identifier", "protocol", "index"])
    assert dict(numeric.dtypes)["duration"] == "double"


def test_missing_flow_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        flows.read_flow_file(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError):
        flows.union_flows([])


def test_alarm_list(spark, tmp_path):
    (tmp_path / "alarms.csv").write_text("ID,ocsvm,other\na,1,0\nb,0,1\nc,1,1\n")
    alarms = flows.read_alarms(spark, str(tmp_path / "alarms.csv"), ["ocsvm", "absent"])
    assert [tuple(r) for r in alarms.orderBy("id").collect()] == [("a", 1, 0), ("b", 0, 0), ("c", 1, 0)]
    packets = spark.createDataFrame([("a", "FP"), ("a", "FP"), ("z", "TP")], "case_id string, label string")
    assert [r["id"] for r in flows.alarms_with_capture(alarms, packets).collect()] == ["a"]
    assert [r["id"] for r in flows.captures_with_label(packets, "TP").collect()] == ["z"]


def test_long_traces_survive_xes(spark, tmp_path):
    rows = [("FP", "STATE_0", "c1", i, f"a{i % 3}", i, i) for i in range(1, 26)] + [("TP", "STATE_1", "c2", 1, "x", 0, 5)]
    events = spark.createDataFrame(
        rows, "label string, state string, case_id string, event_no long, activity string, s long, payload_size long"
    ).withColumn("ts", F.timestamp_micros(F.col("s") * 1234567)).drop("s")
    path = str(tmp_path / "xes")
    logs.write_xes(events, path, piece=10)
    read = logs.numbered_xes(logs.read_xes(spark, path), piece=10).select(*events.columns)
    assert read.exceptAll(events).count() == 0 and events.exceptAll(read).count() == 0
    assert logs.read_xes(spark, path, "TP").count() == 1


def test_results(spark, tmp_path):
    path = str(tmp_path)
    results.write_named_values(spark, {"a": 0.5}, f"{path}/values")
    assert results.read_named_value(spark, f"{path}/values", "a") == 0.5
    with pytest.raises(KeyError):
        results.read_named_value(spark, f"{path}/values", "b")
    alarms = spark.createDataFrame([("m", "false_positives", "x")], "model string, kind string, id string")
    results.write_alarm_lists(alarms, f"{path}/alarms")
    assert results.read_alarm_list(spark, f"{path}/alarms", "m").count() == 1
    assert results.read_alarm_list(spark, f"{path}/alarms", "other").count() == 0


def test_trained_state_is_saved_and_rates_the_same(spark, tmp_path):
    source = fx.packets(spark, "/root/testdata/sf0.001")
    events = fx.numbered_events(source).persist()
    trained = triage.train(fx.training(events), fx.TRACE)
    trained.save(str(tmp_path / "trained"))
    again = triage.Trained.load(spark, str(tmp_path / "trained"))
    one = triage.rate(fx.inference(events), trained, fx.TRACE).table
    other = triage.rate(fx.inference(events), again, fx.TRACE).table
    assert one.exceptAll(other).count() == 0 and one.count() == 5
    nodes, arcs = logs.read_net(spark, str(tmp_path / "trained/model"))
    assert nodes.count() > 0 and arcs.count() > 0
    for name in ("control_flow", "timing", "payload"):
        values = [r["similarity"] for r in logs.read_similarity(spark, str(tmp_path / "trained"), name).collect()]
        assert all(0 <= v <= 1 + 1e-9 for v in values)


def test_rating_is_the_same_with_cut_flows(spark):
    source = fx.packets(spark, "/root/testdata/sf0.001")
    events = fx.numbered_events(source).persist()
    whole = triage.rate(fx.inference(events), triage.train(fx.training(events), fx.TRACE), fx.TRACE)
    cut = triage.rate(fx.inference(events), triage.train(fx.training(events), fx.TRACE, split_at=9), fx.TRACE, split_at=9)
    assert whole.table.exceptAll(cut.table).count() == 0
    assert whole.banded.exceptAll(cut.banded).count() == 0
