"""Addresses and scalar rules."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from vigil.functions import ip as addr
from vigil.functions import scalars
from vigil.operators import attribution
from vigil.sources import ingest

GOOD = ["10.0.0.5", "255.255.255.255", "0.0.0.0", "::1", "::", "fd00::1", "2001:db8::8:800:200c:417a", "fe80::1%eth0", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "64:ff9b::192.0.2.33"]
BAD = ["", " ", "1.2.3", "256.1.1.1", "1.2.3.4.5", "10.0.0.0/8", "g::1", "1::2::3", "1:2:3:4:5:6:7", "12345::", "a", ":1", "1:"]


def test_parse(spark):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in GOOD + BAD], "t string").coalesce(1).select(addr.parse(F.col("t"))).collect()]
    for text, value in zip(GOOD, got):
        a = ipaddress.ip_address(text.split("%")[0])
        want = addr.MAPPED + a.packed if a.version == 4 else a.packed
        assert bytes(value) == want, text
    assert got[len(GOOD) :] == [None] * len(BAD)


CLASSES = [
    ("127.0.0.1", True, True, False), ("10.9.9.9", True, False, False), ("172.31.255.255", True, False, False), ("172.32.0.0", False, False, False),
    ("192.168.0.1", True, False, False), ("169.254.169.254", True, True, False), ("224.0.0.1", True, True, True), ("8.8.8.8", False, False, False),
    ("::1", True, True, False), ("fe80::1", True, True, False), ("ff02::1", True, True, True), ("fc00::1", True, False, False), ("2001:db8::1", False, False, False),
    ("0.0.0.0", True, True, False), ("::", True, True, False),
]


def test_classes_and_round_trip(spark):
    rows = spark.createDataFrame([(c[0],) for c in CLASSES], "t string").coalesce(1).withColumn("ip", addr.parse(F.col("t")))
    ip = F.col("ip")
    got = rows.select("t", addr.is_private_or_local(ip), addr.is_local_only(ip), addr.is_multicast(ip), addr.show(ip)).collect()
    for want, row in zip(CLASSES, got):
        assert tuple(row)[:4] == want
        assert ipaddress.ip_address(row[4]) == ipaddress.ip_address(want[0])


@pytest.mark.parametrize("text, want", [("any", "any"), ("ANY", "any"), ("  any  ", "any"), ("in", "in"), ("inbound", "in"), ("dst", "in"), ("  INBOUND  ", "in"), ("out", "out"), ("outbound", "out"), ("src", "out"), ("", "out")])
def test_contact_direction(spark, text, want):
    assert spark.range(1).select(scalars.contact_direction(F.lit(text))).first()[0] == want


def test_contact_direction_is_strict(spark):
    with pytest.raises(Exception, match="unknown contact direction"):
        spark.range(1).select(scalars.contact_direction(F.lit("inboundz"))).collect()


def test_disk_types(spark):
    rows = spark.createDataFrame([("network", None, "rbd/volume-123"), ("network", None, "noslash"), ("file", "/x.img", ""), ("file", "", "")], "k string, f string, n string").coalesce(1)
    kind, volume = scalars.disk_type(F.col("k"), F.col("f"), F.col("n"))
    assert [tuple(r) for r in rows.select(kind, volume).collect()] == [("rbd", "volume-123"), ("unknown", "unknown"), ("local", "/x.img"), ("unknown", "unknown")]


FLOW = "host_id string, zone int, src_ip binary, dst_ip binary"


def owners(spark, flow, zones, ips):
    b = lambda t: addr.packed(t)
    flows = spark.createDataFrame([("h", flow[0], b(flow[1]), b(flow[2]))], FLOW)
    z = spark.createDataFrame([("h", n, i, b(a)) for n, i, a in zones] or [], "host_id string, zone int, instance string, ip binary")
    own = spark.createDataFrame([("h", i, b(a)) for i, a in ips] or [], "host_id string, instance string, ip binary")
    return tuple(attribution.attribute(flows, z, own).select("src_inst", "dst_inst").first())


def test_attribution(spark):
    assert owners(spark, (42, "10.0.0.5", "8.8.8.8"), [(42, "one", "10.0.0.5")], [("one", "10.0.0.5")]) == ("one", None)
    assert owners(spark, (0, "10.0.0.9", "1.1.1.1"), [], [("two", "10.0.0.9")]) == ("two", None)
    assert owners(spark, (1, "10.0.0.1", "10.0.0.2"), [], []) == (None, None)
    shared = [("a", "10.0.0.1"), ("b", "10.0.0.1")]
    assert owners(spark, (0, "10.0.0.1", "8.8.8.8"), [], shared) == (None, None)  # two owners: none
    # a match by zone on one side keeps the other from falling back
    assert owners(spark, (7, "10.0.0.1", "10.0.0.2"), [(7, "a", "10.0.0.1")], [("a", "10.0.0.1"), ("c", "10.0.0.2")]) == ("a", None)


def test_evidence_modes(spark):
    rows = spark.createDataFrame([(0.6, 0.6), (0.5, 0.6), (0.39, 0.39), (0.5, 0.5)], "a double, b double").coalesce(1)
    assert [r[0] for r in rows.select(scalars.evidence_mode(F.col("a"), F.col("b"))).collect()] == ["dominant_remote", "dominant_port", "distributed", "mixed"]


DOCUMENT = """<domain type='kvm'><name>dom1</name><uuid> u-1 </uuid><metadata><n:instance xmlns:n="urn:n"><n:name>{name}</n:name>
<n:flavor name="small"><n:memory>1024</n:memory><n:vcpus>2</n:vcpus></n:flavor>
<n:owner><n:user uuid="3">a user</n:user><n:project uuid="4">pro&amp;ject</n:project></n:owner>
<n:ports><n:port uuid='A'/><n:port uuid='B'><n:ip type="fixed" address="10.0.0.5" ipVersion="4"/><n:ip address='fd00::1' ipVersion='6'/></n:port>
<n:port uuid=' '><n:ip address='10.0.0.6'/></n:port><n:port uuid='C'><n:ip address='10.0.0.7'/><n:ip address=''/></n:port></n:ports></n:instance></metadata>
<devices><disk type='file' device='disk'><source file='/a&amp;b'/><target dev='vda'/></disk><disk type='file' device='cdrom'><target dev='hda'/></disk>
<interface type='bridge'><target dev=' '/></interface><interface type='bridge'><target dev='tap0'/></interface><interface/></devices></domain>"""


def test_inventory_documents(spark):
    rows = [("h", "dom1", DOCUMENT.format(name="test-vm")), ("h", "dom2", DOCUMENT.format(name="  ")), ("h", "bad", "<domain><uuid>x"), ("h", "none", None), ("h", "few", "<domain><uuid>z</uuid></domain>")]
    docs = spark.createDataFrame(rows, "host_id string, domain_name string, xml string")
    got = {r["domain_name"]: r for r in ingest.inventory(docs).collect()}
    assert len(got) == 5 and got["dom1"]["server_name"] == "test-vm" and got["dom2"]["server_name"] == "dom2"
    one = got["dom1"]
    assert (one["instance"], one["project"], one["owner"], one["mem_mb"], one["vcpus"]) == ("u-1", "pro&ject", "a user", 1024, 2)
    assert one["port_uuids"] == ["A", "B", "C"] and one["ifaces"] == ["tap0"] and one["disk_targets"] == ["vda"]
    assert got["few"]["instance"] == "z" and got["few"]["project"] == "unknown" and got["few"]["mem_mb"] is None
    ports = ingest.inventory_ports(docs.where("domain_name = 'dom1'")).select("port_uuid", "family", addr.show(F.col("ip")).alias("ip")).collect()
    assert sorted(map(tuple, ports)) == [("B", "4", "10.0.0.5"), ("B", "6", "fd00:0000:0000:0000:0000:0000:0000:0001"), ("C", "4", "10.0.0.7")]
    assert [r["path"] for r in ingest.inventory_disks(docs.where("domain_name = 'dom1'")).collect()] == ["vda"]


def test_masked_bits(spark):
    pairs = [("10.1.2.3", n) for n in (0, 1, 7, 8, 9, 24, 29, 31, 32)] + [("fd00::abcd:1", n) for n in (0, 3, 29, 48, 64, 127, 128)]
    rows = spark.createDataFrame([(t, n, 4 if "." in t else 6, str(ipaddress.ip_network(f"{t}/{n}", strict=False)[0]), str(ipaddress.ip_network(f"{t}/{n}", strict=False)[-1])) for t, n in pairs], "t string, n int, f int, first string, last string")
    key = lambda c: addr.masked(addr.parse(F.col(c)), F.col("f"), F.col("n"))
    assert rows.where((key("t") == key("first")) & (key("t") == key("last"))).count() == len(pairs)
    other = lambda t, n: str(ipaddress.ip_address(int(ipaddress.ip_address(t)) ^ (1 << ((32 if "." in t else 128) - n))))
    flipped = spark.createDataFrame([(t, n, 4 if "." in t else 6, other(t, n)) for t, n in pairs if n], "t string, n int, f int, o string")
    assert flipped.where(key("t") == key("o")).count() == 0
