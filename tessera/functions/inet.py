"""Addresses and networks as texts such as 10.1.2.3/24 or 2001:db8::/32; without a mask they are one address.

IPv4 works on numbers, IPv6 on binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import col


def number(a: str | Column) -> Column:
    """The address as a number; null if it is none."""
    own = F.split_part(col(a), F.lit("/"), F.lit(1))
    parts = F.split(own, r"\.")
    out = F.lit(0).cast("long")
    for i in range(4):
        out = out * 256 + F.get(parts, F.lit(i)).try_cast("long")
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return F.when(own.rlike(rf"^{octet}(\.{octet}){{3}}$"), out)


def text(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, 8 * (3 - i)).bitwiseAND(F.lit(255)).cast("string") for i in range(4)))


def host(a: str | Column) -> Column:
    return F.split_part(col(a), F.lit("/"), F.lit(1))


def masklen(a: str | Column) -> Column:
    return F.when(F.contains(col(a), F.lit("/")), F.split_part(col(a), F.lit("/"), F.lit(2)).cast("int")).when(F.contains(col(a), F.lit(":")), 128).otherwise(32)


def _without_tail(own: Column) -> Column:
    """An IPv6 address with its IPv4 tail, if it has one, as two groups of hexadecimal digits."""
    tail = number(F.regexp_extract(own, "([^:]*)$", 1))
    groups = F.concat(F.regexp_extract(own, "^(.*:)[^:]*$", 1), F.hex(F.shiftright(tail, 16)), F.lit(":"), F.hex(tail.bitwiseAND(F.lit(65535))))
    return F.when(own.rlike(r":.*\."), groups).otherwise(own)


def bits(a: str | Column) -> Column:
    """The 32 or 128 binary digits of the address; null if it is none."""
    own = _without_tail(host(a))
    halves, short = F.split(own, "::"), F.contains(own, F.lit("::"))
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: t != "")
    head, tail = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = 8 - F.size(head) - F.size(tail)
    all_groups = F.when(short, F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)).otherwise(head)
    good = (F.size(halves) <= 2) & (F.size(all_groups) == 8) & (~short | (missing > 0)) & F.forall(all_groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    six = F.array_join(F.transform(all_groups, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    return F.when(number(a).isNotNull(), F.lpad(F.bin(number(a)), 32, "0")).when(good, six)


def family(a: str | Column) -> Column:
    """4 or 6; null for what is no address."""
    return F.when(number(a).isNotNull(), 4).when(bits(a).isNotNull(), 6)


def set_masklen(a: str | Column, n: int | Column) -> Column:
    return F.concat(host(a), F.lit("/"), (n if isinstance(n, Column) else F.lit(n)).cast("string"))


def added(a: str | Column, n: int | Column) -> Column:
    """The IPv4 address n further on; null beyond the last one or before the first."""
    to = number(a) + n
    return F.when(to.between(0, (1 << 32) - 1), text(to))


def distance(a: str | Column, b: str | Column) -> Column:
    return number(a) - number(b)


def both_bits(a: str | Column, b: str | Column) -> Column:
    return text(number(a).bitwiseAND(number(b)))


def either_bits(a: str | Column, b: str | Column) -> Column:
    return text(number(a).bitwiseOR(number(b)))


def other_bits(a: str | Column) -> Column:
    return text(F.lit((1 << 32) - 1) - number(a))


def _hosts(a: str | Column) -> Column:
    """The number of addresses in the network."""
    return F.pow(F.lit(2), 32 - masklen(a)).cast("long")


def network_number(a: str | Column) -> Column:
    return number(a) - number(a) % _hosts(a)


def network(a: str | Column) -> Column:
    return F.concat(text(network_number(a)), F.lit("/"), masklen(a).cast("string"))


def broadcast(a: str | Column) -> Column:
    return text(network_number(a) + _hosts(a) - 1)


def netmask(a: str | Column) -> Column:
    return text(F.lit(1 << 32) - _hosts(a))


def hostmask(a: str | Column) -> Column:
    return text(_hosts(a) - 1)


def contained_by_or_equals(a: str | Column, b: str | Column) -> Column:
    """Networks of different families hold nothing of each other."""
    four = number(a) - number(a) % _hosts(b) == network_number(b)
    six = F.left(bits(a), masklen(b)) == F.left(bits(b), masklen(b))
    return (masklen(a) >= masklen(b)) & F.when(family(a) != family(b), False).when(family(a) == 4, four).otherwise(six)


def contained_by(a: str | Column, b: str | Column) -> Column:
    return (masklen(a) > masklen(b)) & contained_by_or_equals(a, b)
