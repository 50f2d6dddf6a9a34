"""Column functions on addresses, ports and protocols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Application protocol of well-known ports in captured traffic.
APP_PORTS = {
    20: "FTP",
    21: "FTP",
    22: "SSH",
    23: "Telnet",
    25: "SMTP",
    53: "DNS",
    67: "DHCP",
    68: "DHCP",
    80: "HTTP",
    110: "POP3",
    123: "NTP",
    137: "NetBIOS",
    138: "NetBIOS",
    139: "NetBIOS",
    143: "IMAP",
    161: "SNMP",
    162: "SNMP",
    179: "BGP",
    389: "LDAP",
    443: "HTTPS",
    445: "SMB",
    465: "SMTPS",
    520: "RIP",
    554: "RTSP",
    587: "SMTP",
    636: "LDAPS",
    993: "IMAPS",
    995: "POP3S",
    1433: "MSSQL",
    1521: "Oracle",
    1900: "SSDP",
    1935: "RTMP",
    3000: "HTTP",
    3306: "MySQL",
    3389: "RDP",
    5060: "SIP",
    5061: "SIP",
    5353: "mDNS",
    5355: "LLMNR",
    5432: "PostgreSQL",
    5900: "VNC",
    6379: "Redis",
    8000: "HTTP",
    8008: "HTTP",
    8080: "HTTP",
    8443: "HTTPS",
    27017: "MongoDB",
}
# IP protocol numbers that have a name of their own.
IP_PROTOCOLS = {1: "ICMP", 58: "ICMPv6", 2: "IGMP", 89: "OSPF", 47: "GRE", 50: "ESP", 51: "AH"}
# The shorter table that simulated traffic uses.
SIMULATED_PORTS = {
    20: "FTP",
    21: "FTP",
    22: "SSH",
    25: "SMTP",
    53: "DNS",
    80: "HTTP",
    110: "SMTP",
    143: "SMTP",
    443: "HTTPS",
    993: "SMTP",
    995: "SMTP",
}
# Protocols expected on a port.
EXPECTED = {
    20: ("FTP", "FTP-DATA"),
    21: ("FTP",),
    22: ("SSH",),
    25: ("SMTP",),
    53: ("DNS",),
    67: ("DHCP", "UDP"),
    68: ("DHCP", "UDP"),
    80: ("HTTP",),
    123: ("NTP", "UDP"),
    137: ("NetBIOS", "UDP"),
    138: ("NetBIOS", "UDP"),
    139: ("NetBIOS", "TCP"),
    443: ("HTTPS",),
    445: ("SMB", "TCP"),
    1900: ("SSDP", "UDP"),
    5353: ("mDNS", "DNS", "UDP"),
    5355: ("LLMNR", "UDP"),
}
# Single addresses that count as broadcast or multicast.
BROADCASTS = ("255.255.255.255", "224.0.0.1", "224.0.0.2", "224.0.0.251", "224.0.0.252", "239.255.255.250")


def _lookup(table: dict[int, str], port: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[port]


def app_protocol(destination_port: Column, source_port: Column, transport: Column | str) -> Column:
    """The destination port's protocol, else the source port's, else the transport's name."""
    other = F.lit(transport) if isinstance(transport, str) else transport
    return F.coalesce(_lookup(APP_PORTS, destination_port), _lookup(APP_PORTS, source_port), other)


def simulated_protocol(port: Column) -> Column:
    return F.coalesce(_lookup(SIMULATED_PORTS, port), F.lit("TCP"))


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, as lenient parsers read it; null if there is none."""
    return F.coalesce(text.try_cast("bigint"), F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"))


def octet(ip: Column, n: int) -> Column:
    return F.get(F.split(ip, r"\."), F.lit(n)).try_cast("int")


def is_private(ip: Column) -> Column:
    middle = ip.startswith("172.") & octet(ip, 1).between(16, 31)
    return ip.startswith("10.") | ip.startswith("192.168.") | F.coalesce(middle, F.lit(False))


def is_broadcast(ip: Column) -> Column:
    return ip.isin(*BROADCASTS) | ip.endswith(".255") | F.coalesce(octet(ip, 0).between(224, 239), F.lit(False))


def is_mismatch(port: Column, protocol: Column) -> Column:
    """Whether a port has expected protocols and this is none of them."""
    names = F.create_map(*[x for p, names in EXPECTED.items() for x in (F.lit(p), F.array(*map(F.lit, names)))])[port]
    return F.coalesce(~F.array_contains(names, protocol), F.lit(False))


def severity(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.40, "medium").otherwise("low")


def recommendation(level: Column) -> Column:
    """What to do about each severity."""
    texts = {
        "low": "Monitor for further anomalies",
        "medium": "Investigate source and review traffic patterns",
        "high": "Consider blocking source IP and alerting security team",
        "critical": "Immediate action: block source and initiate incident response",
    }
    return F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[level]


def tcp_flags(hexadecimal: Column) -> Column:
    """Struct of six booleans from a hexadecimal number with or without 0x; nothing readable: all false."""
    digits = F.regexp_extract(hexadecimal, r"^\s*(?:0[xX])?([0-9a-fA-F]+)", 1)
    number = F.coalesce(F.conv(F.when(digits != "", digits), 16, 10).try_cast("bigint"), F.lit(0))
    bits = {"syn": 0x02, "ack": 0x10, "fin": 0x01, "rst": 0x04, "psh": 0x08, "urg": 0x20}
    return F.struct(*[(number.bitwiseAND(b) != 0).alias(n) for n, b in bits.items()])


def display_units(bytes_: Column) -> list[Column]:
    return [F.round(bytes_ / 1024**i, 2).alias(n) for i, n in enumerate(("kb", "mb", "gb"), 1)]


def node_radius(flow_count: Column) -> Column:
    return 8 + 3 * F.log10(flow_count + 1)


def edge_width(weight: Column) -> Column:
    return F.greatest(F.lit(1.0), 2 * F.log10(weight))
