"""Column functions: technique rules, service tags, address tests, tokens, stable hashing."""

from __future__ import annotations

import functools
import ipaddress

from pyspark.sql import Column, functions as F

#: Technique rules on an object's file name, first match wins.
NAME_RULES = (("firefox", "T1189"), ("drakon", "T1055"), ("verifier", "T1546.012"), ("sysinfo", "T1082"), ("copykatz", "T1003"), ("mimikatz", "T1003"), ("filefilter-elevate", "T1068"), ("ping", "T1016"), ("cmd", "T1059.003"), ("powershell", "T1059.001"))
#: Technique rules on a host event's paths and command line, first match wins.
EVENT_RULES = (
    ("T1003", ("mimikatz", "lsadump")), ("T1047", ("wmic", "invoke-wmi", "winmgmt")), ("T1059.001", ("powershell", "empire")), ("T1112", ("reg add", "reg.exe", "registry")),
    ("T1046", ("ping", "scan", "nmap")), ("T1113", ("screenshot", "screen", "snipping")), ("T1055", ("psinject", "lsass")),
)
#: Service tokens by port.
SERVICES = {53: "SVC_DNS", 67: "SVC_DHCP", 68: "SVC_DHCP", 80: "SVC_HTTP", 8080: "SVC_HTTP", 8000: "SVC_HTTP", 443: "SVC_HTTPS", 8443: "SVC_HTTPS", 22: "SVC_SSH", 3389: "SVC_RDP", 445: "SVC_SMB", 139: "SVC_SMB", 88: "SVC_KRB", 389: "SVC_LDAP", 636: "SVC_LDAP"}
#: Transport protocols that have ports, by their number.
TRANSPORTS = {6: "TCP", 17: "UDP"}
#: Private, loopback, link-local, test and reserved blocks, and what is public within them.
INTERNAL = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
PUBLIC = ("192.0.0.9/32", "192.0.0.10/32")
INTERNAL_V6 = ("::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
PUBLIC_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
QUAD = rf"{OCTET}(?:\.{OCTET}){{3}}"


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"[^/\\]*$", 0)


def technique(path: Column) -> Column:
    """Technique by the file name's first matching pattern, '' if none."""
    name, out = file_name(path), None
    for pattern, label in NAME_RULES:
        out = F.when(name.contains(pattern), label) if out is None else out.when(name.contains(pattern), label)
    return F.coalesce(out.otherwise(""), F.lit(""))


def event_technique(properties: Column) -> Column:
    """Technique of a host event by its image path, module path and command line, '' if none."""
    text = F.lower(F.concat_ws(" | ", *[F.coalesce(properties[c], F.lit("")) for c in ("image_path", "module_path", "command_line")]))
    found = [F.when(F.array_contains(F.array(*[text.contains(w) for w in words]), True), F.lit(label)) for label, words in EVENT_RULES]
    return F.coalesce(*found, F.lit(""))


def service(port: Column) -> Column:
    """P10: service token of a port, SVC_OTHER if none."""
    table = F.create_map(*[F.lit(x) for pair in SERVICES.items() for x in pair])
    return F.coalesce(table[port.cast("int")], F.lit("SVC_OTHER"))


def port_bucket(port: Column) -> Column:
    """P10: PORT_WELLKNOWN, PORT_REGISTERED or PORT_DYNAMIC; PORT_UNKNOWN for null."""
    return F.when(port.isNull(), "PORT_UNKNOWN").when(port <= 1023, "PORT_WELLKNOWN").when(port <= 49151, "PORT_REGISTERED").otherwise("PORT_DYNAMIC")


def network_event(port: Column) -> Column:
    """NET_DNS, NET_DHCP, or NET_CONNECT_ and the service of the peer's port."""
    token = service(port)
    return F.when(token.isin("SVC_DNS", "SVC_DHCP"), F.replace(token, F.lit("SVC_"), F.lit("NET_"))).otherwise(F.replace(token, F.lit("SVC_"), F.lit("NET_CONNECT_")))


def transport(number: Column) -> Column:
    """TCP, UDP, IP_PROTO_n, or NON_IP for frames without an IP header."""
    table = F.create_map(*[F.lit(x) for pair in TRANSPORTS.items() for x in pair])
    return F.when(number.isNull(), "NON_IP").otherwise(F.coalesce(table[number.cast("int")], F.concat(F.lit("IP_PROTO_"), number.cast("string"))))


def kept_technique(chain: Column) -> Column:
    """The first technique of a chain's steps, '' if none."""
    return F.coalesce(F.get(F.filter(F.transform(chain, lambda x: x["ttp"]), lambda x: x.isNotNull() & (x != "")), F.lit(0)), F.lit(""))


def backfill_technique(chain: Column, ttp: Column) -> Column:
    """The chain with the slice's technique in every step."""
    return F.transform(chain, lambda x: x.withField("ttp", ttp))


def stable_id(columns: list[str], ident: str = "global_id") -> Column:
    """global_id; else day|slice_id; else the whole row as JSON."""
    have = {c for c in columns}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    both = F.when((text("day") != "") | (text("slice_id") != ""), F.concat(text("day"), F.lit("|"), text("slice_id")))
    return F.coalesce(*([F.col(ident).cast("string")] if ident in have else []), both, F.to_json(F.struct(*sorted(have))))


def magnitude(value: Column, low: float, high: float) -> Column:
    """L, M or H."""
    return F.when(value < low, "L").when(value < high, "M").otherwise("H")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ipv4_number(ip: Column) -> Column:
    """The number of a dotted quad, null if it isn't one (octets over 255, leading zeros, blanks)."""
    octets = lambda p: F.aggregate(F.transform(p, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    return F.when(ip.rlike(rf"\A{QUAD}\z"), octets(F.split(ip, r"\.")))


def ipv6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address (with ::, an embedded dotted quad, a zone behind %), null if it isn't one."""
    plain = F.regexp_replace(F.lower(ip), r"%[^%]+\z", "")
    quad = F.nullif(F.regexp_extract(plain, rf":({QUAD})\z", 1), F.lit(""))
    tail = F.lower(F.lpad(F.hex(ipv4_number(quad)), 8, "0"))
    hexed = F.when(quad.isNull(), plain).otherwise(F.concat(F.regexp_replace(plain, r"[0-9.]+\z", ""), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)))
    groups = lambda text: F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))

    def expanded(sides: Column) -> Column:
        left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        zeros = 8 - F.size(left) - F.size(right)
        whole = ((F.size(sides) == 1) & (zeros == 0)) | ((F.size(sides) == 2) & (zeros >= 1))
        every = F.concat(left, F.array_repeat(F.lit("0"), zeros), right)
        return F.when(whole & F.forall(every, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z")), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return F.when(ip.contains(":"), _let(F.split(hexed, "::", -1), expanded))


def _within(value: Column, blocks: tuple[str, ...], bound) -> Column:
    """Whether value lies in one of the blocks; bound(address) is its form of an address."""
    networks = [ipaddress.ip_network(b) for b in blocks]
    tests = [value.between(F.lit(bound(n.network_address)), F.lit(bound(n.broadcast_address))) for n in networks]
    return functools.reduce(lambda a, b: a | b, tests)


def is_internal(ip: Column) -> Column:
    """In a private, loopback or link-local block, IPv4 or IPv6 (mapped IPv4 counts as IPv4); false for what isn't an address."""
    v4 = lambda n: _within(n, INTERNAL, int) & ~_within(n, PUBLIC, int)
    digits = lambda a: f"{int(a):032x}"
    mapped = lambda d: F.conv(F.substring(d, 25, 8), 16, 10).cast("long")
    v6 = lambda d: F.when(d.startswith("0" * 20 + "ffff"), v4(mapped(d))).otherwise(_within(d, INTERNAL_V6, digits) & ~_within(d, PUBLIC_V6, digits))
    return F.coalesce(F.when(ip.contains(":"), _let(ipv6_digits(ip), v6)).otherwise(_let(ipv4_number(ip), v4)), F.lit(False))


def salted_token(value: Column, salt: str, prefix: str, n: int = 8) -> Column:
    """Prefix and the first n hex digits of sha1(salt|value)."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat(F.lit(f"{salt}|"), value).cast("binary")), 1, n))


def keyed_token(value: Column, key: bytes, n: int = 8) -> Column:
    """First n hex digits of HMAC-SHA256; empty or null values give zeros."""
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), value.cast("binary")), 256))), 256)
    return F.when(F.coalesce(value, F.lit("")) == "", "0" * n).otherwise(F.substring(digest, 1, n))


def stable_unit(ident: Column, seed: int) -> Column:
    """A number in [0, 1) from sha1(seed||id)."""
    number = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}||"), ident).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(10**12).cast("decimal(20,0)")).cast("double") / 1e12


def word_tokens(text: Column, most: int = 300) -> Column:
    """H1: lower-case runs of letters, digits and . _ - :, at most `most` of them."""
    return F.slice(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}._:-]+"), lambda x: x != ""), 1, most)


def hashed_slot(token: Column, dim: int) -> Column:
    """H2: slot of a token, the first 8 hex digits of its MD5 modulo dim."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")
