"""The scalar rules as SQL functions, and ports, rules' limits and lists as table functions.

``register`` creates temporary functions. Their bodies are SQL, so Catalyst puts them in line: a
query that uses them has the plan of one that spells them out, without Python. Addresses are IPv4
numbers (BIGINT), as in the SQL views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, Config
from ..sources.builtin_ports import BUILTIN
from . import scalars


def ports(*numbers: int) -> str:
    return ", ".join(map(str, sorted(numbers)))


def scalar_functions(config: Config = DEFAULT) -> dict[str, str]:
    """name(arguments) RETURNS type -> its body."""
    s = config.s
    return {
        "flow_bytes(fwd BIGINT, rev BIGINT) RETURNS BIGINT": "fwd + rev",
        "is_unreplied(rev_packets BIGINT) RETURNS BOOLEAN": "rev_packets = 0",
        "is_multicast_v4(ip BIGINT) RETURNS BOOLEAN": "ip BETWEEN 3758096384 AND 4026531839",
        "is_local_only_v4(ip BIGINT) RETURNS BOOLEAN": "ip BETWEEN 2130706432 AND 2147483647 OR ip BETWEEN 2851995648 AND 2852061183 OR ip BETWEEN 3758096384 AND 4026531839 OR ip = 0",
        "is_private_v4(ip BIGINT) RETURNS BOOLEAN": "ip BETWEEN 167772160 AND 184549375 OR ip BETWEEN 2886729728 AND 2887778303 OR ip BETWEEN 3232235520 AND 3232301055 OR is_local_only_v4(ip)",
        "is_metadata_v4(ip BIGINT) RETURNS BOOLEAN": "ip = 2852039166",
        "show_v4(ip BIGINT) RETURNS STRING": "concat_ws('.', ip DIV 16777216, ip DIV 65536 % 256, ip DIV 256 % 256, ip % 256)",
        "in_network_v4(ip BIGINT, network BIGINT, prefix_len INT) RETURNS BOOLEAN": "shiftright(ip, 32 - prefix_len) = shiftright(network, 32 - prefix_len)",
        "is_admin_port(port INT) RETURNS BOOLEAN": f"port IN ({ports(*scalars.ADMIN)})",
        "is_smtp_port(port INT) RETURNS BOOLEAN": f"port IN ({ports(*scalars.SMTP)})",
        "is_stratum_port(port INT) RETURNS BOOLEAN": f"port IN ({ports(*scalars.STRATUM)})",
        "flow_side(src_owned BOOLEAN, dst_owned BOOLEAN) RETURNS STRING": "CASE WHEN src_owned AND dst_owned THEN 'any' WHEN src_owned THEN 'out' WHEN dst_owned THEN 'in' ELSE 'any' END",
        "clamp01(x DOUBLE) RETURNS DOUBLE": "least(1D, greatest(0D, x))",
        "share_of(part DOUBLE, whole DOUBLE) RETURNS DOUBLE": "CASE WHEN whole > 0 THEN part / whole ELSE 0D END",
        "evidence_mode(remote_share DOUBLE, port_share DOUBLE) RETURNS STRING": (
            "CASE WHEN remote_share >= 0.6 AND remote_share >= port_share THEN 'dominant_remote' WHEN port_share >= 0.6 AND port_share > remote_share THEN 'dominant_port' "
            "WHEN remote_share < 0.4 AND port_share < 0.4 THEN 'distributed' ELSE 'mixed' END"
        ),
        "scaled_high(v INT) RETURNS BIGINT": f"CASE WHEN v <= 0 THEN v ELSE greatest(1, ceil(v / {s}D)) END",
        "scaled_ratio(v DOUBLE) RETURNS DOUBLE": f"clamp01(0.5D + (v - 0.5D) / {s}D)",
        "severity_band(score DOUBLE) RETURNS STRING": "CASE WHEN score >= 85 THEN 'critical' WHEN score >= 65 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END",
        "ewma_alpha(dt DOUBLE, tau DOUBLE) RETURNS DOUBLE": "CASE WHEN dt <= 0 OR tau <= 0 THEN 1D ELSE 1 - exp(-dt / tau) END",
    }


def table_functions(config: Config = DEFAULT) -> dict[str, str]:
    known = ", ".join(f"('{d}', {p}, '{n}')" for d, found in BUILTIN.items() for p, n in found.items())
    return {
        "monitored_ports() RETURNS TABLE (direction STRING, port INT, name STRING)": f"SELECT * FROM VALUES {known} AS v(direction, port, name)",
        "monitored_ports_of(side STRING) RETURNS TABLE (port INT, name STRING)": "SELECT port, name FROM monitored_ports() WHERE direction = side",
        "limits() RETURNS TABLE (name STRING, value DOUBLE)": (
            f"SELECT * FROM VALUES ('remote_ceiling', {config.remote_ceiling}D), ('threat_cap', {config.threat_cap}D), ('cooldown_s', {config.cooldown_s}D), "
            f"('throttle_s', {config.throttle_s}D), ('threshold_flows', {config.threshold_flows}D) AS v(name, value)"
        ),
    }


def register(spark: SparkSession, config: Config = DEFAULT, **lists: DataFrame) -> None:
    """All functions; each of ``lists`` becomes a table function <name>_list() over a view of the frame."""
    for head, body in scalar_functions(config).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for head, body in table_functions(config).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, frame in lists.items():
        frame.createOrReplaceTempView(f"{name}_entries")
        columns = ", ".join(f"{c} {t}" for c, t in frame.dtypes)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_list() RETURNS TABLE ({columns}) RETURN SELECT * FROM {name}_entries")
