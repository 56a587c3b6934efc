import json
import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import flows as fl
from tidemark.sources import capture, logs


def four_packets():
    a, b = ("10.0.0.1", "10.0.0.2", 1000, 80), ("10.0.0.2", "10.0.0.1", 80, 1000)
    frame = capture.encode_frame
    return [(0, frame(*a, 0, flags=fl.SYN, window=1000)), (100, frame(*b, 0, window=2000)), (200, frame(*a, 300, window=1000)), (400, frame(*b, 900, window=2000))]


def packets(spark, tmp_path, records, name="a.pcap", raw=None):
    (tmp_path / name).write_bytes(raw if raw is not None else capture.encode_capture(records))
    return capture.read_captures(spark, str(tmp_path / name))


def features(df, **kw):
    return [r.asDict() for r in fl.flow_features(fl.assign_flows(df, **kw.pop("assign", {})), **kw).orderBy("start_us").collect()]


def test_bidirectional_flow(spark, tmp_path):
    (row,) = features(packets(spark, tmp_path, four_packets()))
    want = {
        "Flow Duration": 400, "Total Fwd Packets": 2, "Total Backward Packets": 2, "Total Length of Fwd Packets": 300, "Total Length of Bwd Packets": 900, "SYN Flag Count": 1, "Init_Win_bytes_forward": 1000, "Init_Win_bytes_backward": 2000,
        "act_data_pkt_fwd": 1, "Flow IAT Mean": 400 / 3, "Down/Up Ratio": 1.0, "Flow Bytes/s": 1200 / 400e-6, "Destination Port": 80, "Fwd IAT Total": 200, "Packet Length Mean": 300,
    }
    for name, value in want.items():
        assert math.isclose(row[name], value), name
    assert (row["src_ip"], row["dst_ip"], row["packets"]) == ("10.0.0.1", "10.0.0.2", 4)
    assert len(set(row) - {"src_ip", "src_port", "dst_ip", "dst_port", "protocol", "start_us", "packets"}) == 77


def test_single_packet_has_no_rates(spark, tmp_path):
    (row,) = features(packets(spark, tmp_path, four_packets()[:1]))
    assert row["Flow Bytes/s"] is None and row["Flow IAT Mean"] == 0.0


def test_idle_and_active_spans(spark, tmp_path):
    one = capture.encode_frame("1.1.1.1", "2.2.2.2", 1, 2, 10)
    (row,) = features(packets(spark, tmp_path, [(t, one) for t in (0, 500, 10_000, 10_400)]), activity_us=1000)
    assert row["Idle Mean"] == 9500 and row["Active Mean"] == 450


def test_flows_end_by_timeout_reset_and_fins(spark, tmp_path):
    a, b = ("1.1.1.1", "2.2.2.2", 1, 2), ("2.2.2.2", "1.1.1.1", 2, 1)
    frame = capture.encode_frame
    at_timeout = [(0, frame(*a, 0)), (1_000_000, frame(*a, 0)), (2_000_001, frame(*a, 0))]
    assert [r["packets"] for r in features(packets(spark, tmp_path, at_timeout), assign={"timeout_us": 1_000_000})] == [2, 1]
    reset = [(0, frame(*a, 0)), (1, frame(*a, 0, flags=fl.RST)), (2, frame(*b, 0))]
    assert [(r["packets"], r["src_ip"]) for r in features(packets(spark, tmp_path, reset))] == [(2, "1.1.1.1"), (1, "2.2.2.2")]
    fins = [(0, frame(*a, 0, flags=fl.FIN)), (1, frame(*a, 0, flags=fl.FIN)), (2, frame(*b, 0, flags=fl.FIN)), (3, frame(*a, 0))]
    assert [r["packets"] for r in features(packets(spark, tmp_path, fins))] == [3, 1]


def test_skips_are_counted(spark, tmp_path):
    vlan = capture.encode_frame("1.1.1.1", "2.2.2.2", 1, 2, 5, "UDP")
    vlan = vlan[:12] + struct.pack("!HH", capture.VLAN, 7) + vlan[12:]
    icmp = bytearray(capture.encode_frame("1.1.1.1", "2.2.2.2", 1, 2, 0))
    icmp[23] = 1
    records = [(5, vlan), (6, bytes(12) + b"\x86\xdd" + bytes(40)), (7, bytes(icmp)), (8, capture.encode_frame("1.1.1.1", "2.2.2.2", 1, 2, 0)[:40])]
    raw = capture.encode_capture(records) + b"\x01\x02\x03"
    (row,) = packets(spark, tmp_path, None, raw=raw).collect()
    assert (row.protocol, row.payload_bytes, row.header_bytes, row.window, row.timestamp_us) == ("UDP", 5, 8, -1, 5)
    stats = {r.outcome: r.n for r in capture.capture_stats(spark, str(tmp_path / "a.pcap")).collect()}
    assert stats == {"parsed": 1, "non_ip": 1, "non_tcp_udp": 1, "malformed": 1, "truncated": 1}


def test_next_generation_container():
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    frame = capture.encode_frame("1.1.1.1", "2.2.2.2", 1, 2, 9)
    nano = struct.pack("<HHI", capture.ETHERNET, 0, 0) + struct.pack("<HHB", 9, 1, 9) + bytes(3) + struct.pack("<HH", 0, 0)
    raw = block(capture.SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, nano)
    raw += block(6, struct.pack("<IIIII", 0, 0, 7_000, len(frame), len(frame)) + frame) + block(3, struct.pack("<I", len(frame)) + frame) + block(99, b"abcd")
    got = [p for _, p in capture.decode_capture(raw)]
    assert [p[0] for p in got] == [7, 0] and got[0][6] == 9


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=120), st.integers(0, 3))
def test_any_bytes_are_read_or_refused(tail, kind):
    head = [b"", capture.encode_capture([]), capture.encode_capture(four_packets())[:-3], struct.pack(">I", capture.SECTION) + bytes(8)][kind]
    try:
        list(capture.decode_capture(head + tail))
    except capture.CaptureError:
        pass


CONN = "#separator \\x09\n#unset_field\t-\n#fields\tuid\tid.orig_h\tid.resp_p\tduration\torig_pkts\tresp_pkts\torig_bytes\tresp_bytes\thistory\nC1\t1.1.1.1\t80\t2.0\t10\t20\t1000\t5000\tShADadFf\nC2\t1.1.1.1\t80\t0\t0\t0\t0\t0\t-\n#close\n"


def test_connection_logs(spark, tmp_path):
    (tmp_path / "conn.log").write_text(CONN)
    (tmp_path / "conn.json").write_text(json.dumps({"uid": "J", "duration": 4, "orig_pkts": 2, "resp_pkts": None, "history": "rR"}) + "\n\n")
    rows = {r["UID"]: r for r in logs.conn_features(logs.read_conn_log(spark, str(tmp_path))).collect()}
    c = rows["C1"]
    assert (c["Flow Duration"], c["Flow Bytes/s"], c["Flow Packets/s"], c["Fwd Packet Length Mean"], c["Bwd Packet Length Mean"], c["Down/Up Ratio"], c["SYN Flag Count"], c["FIN Flag Count"]) == (2e6, 3000, 15, 100, 250, 2.0, 1, 2)
    assert rows["C2"]["Flow Bytes/s"] is None and rows["C2"]["Fwd Packet Length Mean"] == 0.0
    assert (rows["J"]["Fwd Packets/s"], rows["J"]["Total Backward Packets"], rows["J"]["RST Flag Count"]) == (0.5, None, 2)


def test_flow_csvs(spark, tmp_path):
    (tmp_path / "Friday-x.csv").write_bytes(" Flow Duration, Label\n1,Web Attack \x96 XSS\n".encode("latin-1"))
    (row,) = logs.read_flow_csvs(spark, str(tmp_path)).collect()
    assert (row["Day"], row["Label"], row["Flow Duration"]) == ("Friday", "Web Attack - XSS", "1")


@pytest.mark.parametrize("wrap", [False, True])
def test_findings_are_ranked(spark, tmp_path, wrap):
    found = [{"id": "a", "severity": "low", "cvss": 9.0, "flow": {"x": 1.0}}, {"id": "b", "severity": "critical"}, {"id": "c", "severity": "low"}, {"id": "d", "cvss": 15.0, "severity": "low"}]
    (tmp_path / "f.json").write_text(json.dumps({"findings": found} if wrap else found))
    df = logs.read_findings(spark, str(tmp_path / "f.json")).withColumns({"p": F.lit(0.0), "odd": F.lit(False)})
    ranked = logs.triage(df, "p", "odd", {"severity": 0.5, "model": 0.4, "anomaly": 0.1}, "id").orderBy("priority").collect()
    assert [(r.id, round(r.risk, 3)) for r in ranked] == [("b", 0.5), ("d", 0.5), ("a", 0.45), ("c", 0.125)]
    assert logs.unknown_features(df, ["y"]).count() == 1


def test_alert_documents_leave_out_absent_parts(spark, tmp_path):
    df = spark.createDataFrame([(0.875, "DoS", True, None, "1.1.1.1", "80")], "attack_probability double, predicted_class string, is_attack boolean, recommended_action string, `Src IP` string, `Src Port` string")
    logs.append_alerts(logs.alert_documents(df, stamp=F.lit("t")), str(tmp_path / "out"))
    (doc,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert doc["event"]["severity"] == 88 and doc["event"]["action"] == "alert" and doc["source"] == {"ip": "1.1.1.1", "port": 80} and "destination" not in doc
