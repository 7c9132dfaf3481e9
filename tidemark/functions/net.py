"""IPv4 predicates and arithmetic as column expressions over the address number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
ADDRESS = rf"^(?:{OCTET}\.){{3}}{OCTET}$"

# Address blocks (first address, prefix length) of each class.
PRIVATE_BLOCKS = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 29),
    ("192.0.0.170", 31),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("240.0.0.0", 4),
]
SHARED_BLOCKS = [("100.64.0.0", 10)]
RESERVED_BLOCKS = [("240.0.0.0", 4)]
LOOPBACK_BLOCKS = [("127.0.0.0", 8)]
LINK_LOCAL_BLOCKS = [("169.254.0.0", 16)]
MULTICAST_BLOCKS = [("224.0.0.0", 4)]


def _number(text: str) -> int:
    value = 0
    for part in text.split("."):
        value = value * 256 + int(part)
    return value


def is_ip(ip: Column) -> Column:
    return ip.rlike(ADDRESS)


def ip_to_int(ip: Column) -> Column:
    """Address number, null for text that is not an IPv4 address."""
    parts = F.split(ip, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("long")
    return F.when(is_ip(ip), number)


def int_to_ip(number: Column) -> Column:
    octets = [F.shiftright(number, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def in_blocks(number: Column, blocks: list[tuple[str, int]]) -> Column:
    inside = F.lit(False)
    for first, prefix in blocks:
        low = _number(first)
        inside = inside | number.between(low, low + 2 ** (32 - prefix) - 1)
    return F.coalesce(inside, F.lit(False))


def classes(number: Column) -> dict[str, Column]:
    """Every class predicate of an address number, for use on a column computed once by ``ip_to_int``."""
    private = in_blocks(number, PRIVATE_BLOCKS)
    return {
        "private": private,
        "global": ~private & ~in_blocks(number, SHARED_BLOCKS),
        "reserved": in_blocks(number, RESERVED_BLOCKS),
        "loopback": in_blocks(number, LOOPBACK_BLOCKS),
        "link_local": in_blocks(number, LINK_LOCAL_BLOCKS),
        "multicast": in_blocks(number, MULTICAST_BLOCKS),
        "unspecified": F.coalesce(number == 0, F.lit(False)),
    }


def is_private(ip: Column) -> Column:
    return classes(ip_to_int(ip))["private"]


def is_global(ip: Column) -> Column:
    return classes(ip_to_int(ip))["global"]


def is_reserved(ip: Column) -> Column:
    return classes(ip_to_int(ip))["reserved"]


def is_loopback(ip: Column) -> Column:
    return classes(ip_to_int(ip))["loopback"]


def is_link_local(ip: Column) -> Column:
    return classes(ip_to_int(ip))["link_local"]


def is_multicast(ip: Column) -> Column:
    return classes(ip_to_int(ip))["multicast"]


def is_unspecified(ip: Column) -> Column:
    return F.coalesce(ip == "0.0.0.0", F.lit(False))


def netmask(prefix: int) -> Column:
    """Constant per prefix length: the address itself plays no part."""
    return int_to_ip(F.lit(2**32 - 2 ** (32 - prefix)).cast("long"))


def hostmask(prefix: int) -> Column:
    return int_to_ip(F.lit(2 ** (32 - prefix) - 1).cast("long"))


def mask(ip: Column, mask_ip: Column) -> Column:
    return int_to_ip(ip_to_int(ip).bitwiseAND(ip_to_int(mask_ip)))


def subnet24(ip: Column) -> Column:
    return F.substring_index(ip, ".", 3)
