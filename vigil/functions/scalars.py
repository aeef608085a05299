"""Scalar rules used inside the jobs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Destination ports of the named groups.
SMTP = (25, 465, 587)
STRATUM = (3333, 4444, 8333)
ADMIN = (22, 445, 2375, 2379, 3306, 3389, 5432, 5900, 6379, 6443, 8888, 9200, 10250, 27017)
BGP, GENEVE = 179, 6081


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def half_away(x: Column) -> Column:
    """Round to whole numbers, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + F.lit(0.5))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")


def contact_direction(text: Column) -> Column:
    """Out, in or any; anything else is an error."""
    word = F.lower(F.trim(text))
    return (
        F.when(word.isin("", "out", "outbound", "src"), "out")
        .when(word == "any", "any")
        .when(word.isin("in", "inbound", "dst"), "in")
        .otherwise(F.raise_error(F.concat(F.lit("unknown contact direction: "), text)))
    )


def flow_direction(src_is_vm: Column, dst_is_vm: Column) -> Column:
    return F.when(src_is_vm & ~dst_is_vm, "out").when(dst_is_vm & ~src_is_vm, "in").otherwise("any")


def flow_pair(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> Column:
    """The 5-tuple without its direction: the lesser end comes first."""
    a, b = F.struct(src.alias("ip"), sport.alias("port")), F.struct(dst.alias("ip"), dport.alias("port"))
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), proto.alias("proto"))


def evidence_shares(flows: Column, max_remote: Column, max_port: Column, approximate: Column) -> tuple[Column, Column]:
    remote = F.when(approximate, F.lit(0.0)).otherwise(ratio(max_remote, flows))
    return remote, ratio(max_port, flows)


def evidence_mode(remote_share: Column, port_share: Column) -> Column:
    return (
        F.when((remote_share >= 0.60) & (remote_share >= port_share), "dominant_remote")
        .when((port_share >= 0.60) & (port_share > remote_share), "dominant_port")
        .when((remote_share < 0.40) & (port_share < 0.40), "distributed")
        .otherwise("mixed")
    )


def disk_type(kind: Column, file: Column, name: Column) -> tuple[Column, Column]:
    """Type and volume of a disk: pool/volume, a local file, or unknown."""
    pool = F.split(name, "/", 2)
    paired = name.contains("/")
    return (
        F.when(paired, F.get(pool, 0)).when((kind == "file") & (F.coalesce(file, F.lit("")) != ""), "local").otherwise("unknown"),
        F.when(paired, F.get(pool, 1)).when((kind == "file") & (F.coalesce(file, F.lit("")) != ""), file).otherwise("unknown"),
    )


# Domain state codes.
STATES = ("nostate", "running", "blocked", "paused", "shutdown", "shutoff", "crashed", "pmsuspended")


def state_desc(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, STATES)), code.cast("int")), F.lit("unknown"))


def project_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unknown"))


def guest_used_mb(running: Column, current: Column, usable: Column, rss: Column) -> Column:
    kib = F.when((usable > 0) & (current >= usable), current - usable).when(rss > 0, rss).otherwise(current)
    return F.when(running, kib / 1024).otherwise(F.lit(0.0)).cast("double")


def observed(flavor: Column, seen: Column) -> Column:
    """A count seen on the machine overrides that of its flavour."""
    return F.when(seen > 0, seen).otherwise(flavor)


def disk_allocation(allocation: Column, physical: Column) -> Column:
    return F.when(allocation > 0, allocation).otherwise(physical)


def host_impact(instance_flows: Column, own_flows: Column, table_max: Column) -> Column:
    flows = F.when(instance_flows > 0, instance_flows).otherwise(own_flows)
    return ratio(flows, table_max)
