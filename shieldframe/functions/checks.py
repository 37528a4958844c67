"""Checksum and format predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shieldframe.functions.nested import let

IBAN_LENGTHS = {"DE": 22, "ES": 24, "FR": 27, "GB": 22}  # fixed values


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the value's digits, 13 to 19 of them, pass the Luhn check."""

    def total(d: Column) -> Column:
        worth = F.transform(
            F.filter(F.split(F.reverse(d), ""), lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(let(c.cast("int") * 2, lambda x: F.when(x > 9, x - 9).otherwise(x))),
        )
        return F.aggregate(worth, F.lit(0), lambda a, x: a + x)

    return let(digits_of(value), lambda d: F.when(F.length(d).between(13, 19), total(d) % 10 == 0).otherwise(False))


def aba(value: Column) -> Column:
    """Whether the value has nine digits whose sum, weighted 3, 7, 1 in turn, is a multiple of ten."""
    weight = F.array(*(F.lit(w) for w in (3, 7, 1) * 3))
    terms = lambda d: sum((F.substring(d, i + 1, 1).cast("int") * weight[i] for i in range(9)), F.lit(0))
    return let(digits_of(value), lambda d: F.when(F.length(d) == 9, terms(d) % 10 == 0).otherwise(False))


def mod97(text: Column) -> Column:
    """The number that an upper-case text stands for (A is 10 to Z is 35) modulo 97."""
    code = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda a, c: let(code(c), lambda v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def iban(value: Column) -> Column:
    """Whether the value has its country's length and check digits of 1 modulo 97."""
    wanted = F.coalesce(*(F.when(F.substring(F.upper(value), 1, 2) == c, F.lit(n)) for c, n in IBAN_LENGTHS.items()))
    compact = F.upper(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]", ""))
    moved = lambda c: F.concat(F.expr("substring('', 1)"), F.substring(c, 5, 60), F.substring(c, 1, 4))
    return F.coalesce(let(compact, lambda c: F.when((F.length(c) == wanted) & c.rlike("^[0-9A-Z]+$"), mod97(moved(c)) == 1)), F.lit(False))


def ipv4(value: Column) -> Column:
    part = "(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def ipv6(value: Column) -> Column:
    """Whether hexadecimal groups and colons are a valid address: eight groups, or fewer with one `::`."""
    gaps = (F.length(value) - F.length(F.replace(value, F.lit("::"), F.lit("")))) / 2
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    edges = ~value.rlike("^:(?!:)|(?<!:):$")
    full = (gaps == 0) & (groups == 8)
    short = (gaps == 1) & (groups <= 7)
    return value.contains(":") & ~value.contains(":::") & edges & value.rlike("^[0-9A-Fa-f:]+$") & ~value.rlike("[0-9A-Fa-f]{5}") & (full | short)


def ip(value: Column) -> Column:
    return ipv4(value) | ipv6(value)


def url(value: Column) -> Column:
    """Whether a URL is ASCII, http(s), has a host and no user information."""
    authority = F.regexp_extract(value, r"(?i)^https?://([^/?#]*)", 1)
    host = lambda a: a.rlike(r"^[^:\[\]@]+(?::[^\[\]@]*)?$") | a.rlike(r"^\[[0-9A-Fa-f:.]+\](?::[0-9]*)?$")
    return value.rlike(r"^\p{ASCII}+$") & let(authority, host)


def upstream_url(value: Column) -> Column:
    """Whether a forwarding address is https, or http to a loopback host, without user, query or fragment."""
    secure = value.rlike(r"(?i)^https://[^/?#@\s]+(?:/[^?#\s]*)?$")
    local = value.rlike(r"(?i)^http://(?:localhost|127(?:\.[0-9]{1,3}){3}|\[::1\])(?::[0-9]+)?(?:/[^?#\s]*)?$")
    return secure | local
