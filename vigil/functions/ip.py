"""Addresses as BINARY(16), IPv4 in its mapped form. Everything is built-in expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAPPED = bytes(10) + b"\xff\xff"


def literal(text: str) -> Column:
    """An address written out, as a BINARY literal."""
    return F.lit(packed(text))


def packed(text: str) -> bytearray:
    a = ipaddress.ip_address(text)
    return bytearray(MAPPED + a.packed if a.version == 4 else a.packed)


def from_long(v4: Column) -> Column:
    """BIGINT IPv4 -> BINARY(16). With the mark of a mapped address before it the number always has twelve digits."""
    return F.concat(F.lit(bytearray(MAPPED[:10])), F.unhex(F.hex(v4.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(0xFFFF << 32)))))


def to_long(ip: Column) -> Column:
    """Mapped IPv4 -> BIGINT; null for IPv6."""
    return F.when(is_v4_mapped(ip), F.conv(F.hex(F.substring(ip, 13, 4)), 16, 10).cast("long"))


def _v4(text: Column) -> Column:
    octets = F.split(text, r"\.")
    right = text.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")
    digits = [F.lpad(F.conv(F.get(octets, i), 10, 16), 2, "0") for i in range(4)]
    return F.when(right, F.concat(*digits))


def _groups(text: Column) -> Column:
    """Hex digits of the colon-separated groups; the number of digits is a multiple of 4."""
    groups = F.filter(F.split(text, ":"), lambda g: g != "")
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")


def _v6(text: Column) -> Column:
    # a dotted tail becomes two groups
    tail = F.regexp_extract(text, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    v4 = _v4(tail)
    plain = F.when(tail == "", text).when(
        v4.isNotNull(), F.concat(F.expr("''"), F.substring(text, F.lit(1), F.length(text) - F.length(tail)), F.substring(v4, 1, 4), F.lit(":"), F.substring(v4, 5, 4))
    )
    halves = F.split(plain, "::", -1)
    head, back = _groups(F.get(halves, 0)), _groups(F.coalesce(F.get(halves, 1), F.lit("")))
    gap = 32 - F.length(head) - F.length(back)
    shaped = plain.rlike(r"^[0-9A-Fa-f:]+$") & plain.contains(":") & ~plain.rlike(r"[0-9A-Fa-f]{5}|:::|^:[^:]|[^:]:$")
    right = shaped & (F.size(halves) <= 2) & F.when(F.size(halves) == 2, gap >= 4).otherwise(gap == 0)
    return F.when(right, F.concat(head, F.repeat(F.lit("0"), gap), back))


def parse(text: Column) -> Column:
    """Text address -> BINARY(16); zone suffixes go, what is no address is null."""
    bare = F.regexp_replace(F.trim(text), "%.*$", "")
    v4 = _v4(bare)
    return F.when(v4.isNotNull(), F.concat(F.lit(bytearray(MAPPED)), F.unhex(v4))).otherwise(F.unhex(_v6(bare)))


def show(ip: Column) -> Column:
    """BINARY(16) -> text: dotted for mapped IPv4, eight full groups otherwise."""
    octets = [F.conv(F.hex(F.substring(ip, i, 1)), 16, 10) for i in range(13, 17)]
    groups = [F.lower(F.hex(F.substring(ip, i, 2))) for i in range(1, 17, 2)]
    return F.when(is_v4_mapped(ip), F.concat_ws(".", *octets)).otherwise(F.concat_ws(":", *groups))


def normalize_ips(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: parse(F.col(c)) for c in columns})


def is_v4_mapped(ip: Column) -> Column:
    return F.substring(ip, 1, 12) == F.lit(bytearray(MAPPED))


def within(ip: Column, network: str) -> Column:
    """In a network, as a range of binary values (they compare unsigned)."""
    net = ipaddress.ip_network(network)
    return ip.between(literal(str(net[0])), literal(str(net[-1])))


def is_multicast(ip: Column) -> Column:
    return within(ip, "224.0.0.0/4") | within(ip, "ff00::/8")


def is_local_only(ip: Column) -> Column:
    """Loopback, link-local, multicast or unspecified."""
    loop = within(ip, "127.0.0.0/8") | (ip == literal("::1"))
    link = within(ip, "169.254.0.0/16") | within(ip, "fe80::/10")
    none = (ip == literal("0.0.0.0")) | (ip == literal("::"))
    return loop | link | is_multicast(ip) | none


def is_private_or_local(ip: Column) -> Column:
    private = within(ip, "10.0.0.0/8") | within(ip, "172.16.0.0/12") | within(ip, "192.168.0.0/16") | within(ip, "fc00::/7")
    return is_local_only(ip) | private


def is_link_infrastructure(ip: Column) -> Column:
    return within(ip, "169.254.0.0/16") | within(ip, "fe80::/10")


def is_metadata_service(ip: Column) -> Column:
    return ip == literal("169.254.169.254")


def mark_infrastructure(df: DataFrame, host_ips: DataFrame, ip: str, out: str = "is_infra") -> DataFrame:
    """Adds whether the address is link infrastructure or one of its host's own. host_ips is (host_id, ip)."""
    own = host_ips.select("host_id", F.col("ip").alias(ip), F.lit(True).alias("_own")).distinct()
    return df.join(own, ["host_id", ip], "left").withColumn(out, is_link_infrastructure(F.col(ip)) | F.coalesce("_own", F.lit(False))).drop("_own")


def masked(ip: Column, family: Column, length: Column) -> Column:
    """The first ``length`` bits (of the 32 or 128 of the family): whole bytes and the bits of the next one, the key of a prefix join."""
    bits = F.when(family == 4, length + 96).otherwise(length)
    whole = F.floor(bits / 8).cast("int")
    byte = F.conv(F.hex(F.substring(ip, whole + 1, F.lit(1))), 16, 10).cast("int")
    shift = 8 - bits % 8
    part = sum((F.when(shift == k, F.shiftright(byte, k)).otherwise(0) for k in range(1, 8)), F.lit(0))
    return F.struct(F.substring(ip, F.lit(1), whole).alias("bytes"), part.alias("bits"))
