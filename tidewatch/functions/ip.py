"""IP address expressions. Every one is a built-in Column expression.

Addresses are canonical text. IPv4 is recognised by the absence of ``:``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address formats.
OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4_PATTERN = rf"^{OCTET}(\.{OCTET}){{3}}$"
V4_MAPPED_PREFIX = "00000000000000000000ffff"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_v4(ip: Column | str) -> Column:
    return F.instr(_c(ip), ":") == 0


def v4_num(ip: Column | str) -> Column:
    """IPv4 text as a number; null for anything else."""
    ip = _c(ip)
    total = None
    for i in range(1, 5):
        part = F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint")
        total = part if total is None else total * 256 + part
    return total


def v4_text(num: Column | str) -> Column:
    num = _c(num)
    parts = [F.shiftright(num, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def v6_hex(ip: Column | str) -> Column:
    """IPv6 text (``::`` and dotted tails allowed) as 32 hex digits."""

    def hextets(num: Column) -> Column:
        return F.lower(F.concat(F.hex(F.shiftright(num, 16)), F.lit(":"), F.hex(num.bitwiseAND(F.lit(65535)))))

    def without_tail(low: Column) -> Column:
        dotted = F.concat(
            F.regexp_replace(low, r"[^:]+$", ""), bind(v4_num(F.substring_index(low, ":", -1)), hextets)
        )
        return F.when(low.contains("."), dotted).otherwise(low)

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda x: x != "")

    def fill(sides: Column) -> Column:
        missing = F.greatest(F.lit(8) - F.size(sides["l"]) - F.size(sides["r"]), F.lit(0))
        full = F.concat(sides["l"], F.array_repeat(F.lit("0000"), missing), sides["r"])
        return F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), "")

    def halves(text: Column) -> Column:
        left, right = F.substring_index(text, "::", 1), F.substring_index(text, "::", -1)
        return F.struct(
            groups(left).alias("l"), groups(F.when(text.contains("::"), right).otherwise("")).alias("r")
        )

    return bind(F.lower(_c(ip)), lambda low: bind(without_tail(low), lambda text: bind(halves(text), fill)))


def valid_v6(ip: Column | str) -> Column:
    ip = _c(ip)
    shape = ip.rlike(r"^(?i)[0-9a-f:]*:[0-9a-f:]*(\d+\.\d+\.\d+\.\d+)?$")
    hextets = ~ip.rlike(r"(?i)[0-9a-f]{5}") & ~ip.contains(":::") & ~ip.rlike(r"^:[^:]") & ~ip.rlike(r"[^:]:$")
    tail = F.regexp_extract(ip, r"(\d+\.\d+\.\d+\.\d+)$", 1)
    tail_ok = (tail == "") | tail.rlike(V4_PATTERN)
    groups = F.size(F.filter(F.split(ip, ":"), lambda x: x != "")) + F.when(tail != "", 1).otherwise(0)
    gaps = F.size(F.split(ip, "::", -1)) - 1
    count_ok = ((gaps == 0) & (groups == 8)) | ((gaps == 1) & (groups <= 7))
    return shape & hextets & tail_ok & count_ok


def valid_ip(ip: Column | str) -> Column:
    ip = _c(ip)
    return F.when(is_v4(ip), ip.rlike(V4_PATTERN)).otherwise(valid_v6(ip))


def ip_hex(ip: Column | str) -> Column:
    """16-byte mapped form as 32 lower-case hex digits."""
    ip = _c(ip)
    mapped = F.concat(F.lit(V4_MAPPED_PREFIX), F.lpad(F.lower(F.hex(v4_num(ip))), 8, "0"))
    return F.when(is_v4(ip), mapped).otherwise(v6_hex(ip))


def ip_blob(ip: Column | str) -> Column:
    return F.unhex(ip_hex(ip))


def ip_text(blob: Column | str, unmap: bool = True) -> Column:
    """Canonical text of a 16-byte address; mapped IPv4 prints as IPv4, or as
    an IPv6 address with a dotted tail without ``unmap``."""
    def compress(text: Column) -> Column:
        v6 = text
        # The longest run of two or more zero groups, leftmost first, becomes "::".
        for run in range(2, 9):
            zeros = r"0(?::0){%d}" % (run - 1)
            found = text.rlike(rf"(^|:){zeros}(:|$)")
            v6 = F.when(found, F.regexp_replace(text, rf"^(.*?)(?:^|:){zeros}(?:$|:)(.*)$", "$1::$2")).otherwise(v6)
        return v6

    def print_digits(digits: Column) -> Column:
        v4 = v4_text(F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"))
        groups = F.concat_ws(":", *[
            F.regexp_replace(F.substring(digits, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)
        ])
        mapped = v4 if unmap else F.concat(F.lit("::ffff:"), v4)
        return F.when(digits.startswith(V4_MAPPED_PREFIX), mapped).otherwise(bind(groups, compress))

    return bind(F.lower(F.hex(_c(blob))), print_digits)


# Address blocks as text patterns. One pattern per rule keeps the
# generated code small and parses nothing.
_LOOPBACK = r"127\."
_PRIVATE = r"10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\."
_LINK_LOCAL = r"169\.254\."
_BROADCAST = r"255\.255\.255\.255$"
_UNSPECIFIED = r"0\.0\.0\.0$"
_SHARED = r"100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\."
_MULTICAST = r"2(2[4-9]|3\d)\."
_LOOPBACK6, _UNSPECIFIED6 = "::1$", "::$"
_LINK_LOCAL6 = "fe[89ab][0-9a-f]:"
_UNIQUE_LOCAL6 = "f[cd][0-9a-f]{2}:"
_MULTICAST6 = "ff[0-9a-f]{2}:"


def _in_blocks(ip: Column | str, *blocks: str) -> Column:
    return _c(ip).rlike("(?i)^(" + "|".join(blocks) + ")")


def is_infrastructure(ip: Column | str) -> Column:
    """Broadcast or multicast destination."""
    return _in_blocks(ip, _BROADCAST, _MULTICAST, _MULTICAST6)


def is_public(ip: Column | str) -> Column:
    return ~_in_blocks(
        ip, _LOOPBACK, _PRIVATE, _LINK_LOCAL, _BROADCAST, _UNSPECIFIED, _SHARED, _LOOPBACK6, _UNSPECIFIED6, _UNIQUE_LOCAL6
    )


def is_private_v4_block(ip: Column | str) -> Column:
    """The three private IPv4 blocks only; false for IPv6."""
    return _in_blocks(ip, _PRIVATE)


def is_rfc1918(ip: Column | str) -> Column:
    return _in_blocks(ip, _PRIVATE, _LINK_LOCAL6, _UNIQUE_LOCAL6, _LOOPBACK6)


def is_loopback(ip: Column | str) -> Column:
    return _in_blocks(ip, _LOOPBACK, _LOOPBACK6)


def is_unspecified(ip: Column | str) -> Column:
    return _in_blocks(ip, _UNSPECIFIED, _UNSPECIFIED6)


# Accepted block lifetimes.
MIN_TTL_MS = 30_000
MAX_TTL_MS = 86_400_000


def validation_error(ip: Column | str, ttl_ms: Column | str) -> Column:
    """Why a block request is not acceptable; null when it is."""
    ttl = _c(ttl_ms)
    return (
        F.when(ttl < MIN_TTL_MS, "TtlTooSmall").when(ttl > MAX_TTL_MS, "TtlTooLarge")
        .when(is_loopback(ip), "LoopbackIp")
        .when(_in_blocks(ip, _BROADCAST), "BroadcastIp")
        .when(_in_blocks(ip, _MULTICAST, _MULTICAST6), "MulticastIp")
        .when(_in_blocks(ip, _LINK_LOCAL, _LINK_LOCAL6), "LinkLocalIp")
        .when(is_unspecified(ip), "UnspecifiedIp")
    )


def guard_reason(ip: Column | str, is_own: Column, is_gateway: Column) -> Column:
    """Why a remote must not be blocked, first match wins; null when it may be."""
    # Reason texts.
    return (
        F.when(is_own, "remote is own IP")
        .when(is_gateway, "remote is default gateway")
        .when(is_infrastructure(ip), "remote is broadcast/multicast")
        .when(_in_blocks(ip, _LINK_LOCAL), "remote is link-local")
        .when(_in_blocks(ip, _LOOPBACK6, _UNSPECIFIED6), "remote is IPv6 loopback/unspecified")
        .when(_in_blocks(ip, _LINK_LOCAL6), "remote is IPv6 link-local")
    )


def not_after(ip1: Column, num1: Column, port1: Column, ip2: Column, num2: Column, port2: Column) -> Column:
    """(ip1, port1) <= (ip2, port2), every IPv4 before every IPv6.

    ``num1`` and ``num2`` are the ``v4_num`` of the addresses, null for IPv6.
    """
    numeric = (num1 < num2) | ((num1 == num2) & (port1 <= port2))
    text = F.struct(v6_hex(ip1), port1) <= F.struct(v6_hex(ip2), port2)
    both = num1.isNotNull() & num2.isNotNull()
    return F.when(both, numeric).when(num1.isNotNull(), True).when(num2.isNotNull(), False).otherwise(text)
