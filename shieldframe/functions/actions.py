"""Actions on a matched value: labels, keyed hashes, generalization, synthetic values and reversible tokens."""

from __future__ import annotations

import base64
import os
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from shieldframe.functions.nested import let
from shieldframe.functions.checks import digits_of, mod97
from shieldframe.policy import ENTITIES

KEY_BYTES = 32
#: For `spark.sql.redaction.string.regex`: the hexadecimal and binary literals that keys become in plans.
REDACT = r"(?i)(?:[0-9a-f]{128}|0x[0-9a-f]{64}|X'[0-9a-f]{64}')"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A reversible token, as written, and as found in text after small changes of case and blanks.
TOKEN = r"\[\[PG1\|[A-Z_]+\|[A-Z2-7]{26}\|[A-Z2-7]{16}\]\]"
LOOSE_TOKEN = r"(?i)\[\[ ?PG1 ?\| ?[A-Z_]+ ?\| ?[A-Z2-7]{26} ?\| ?[A-Z2-7]{16} ?\]\]"
#: The words that synthetic values are made of.
FIRST_NAMES = ("Alex", "Jordan", "Morgan", "Riley", "Taylor", "Casey")
LAST_NAMES = ("Brooks", "Chen", "Diaz", "Patel", "Rivera", "Singh")
ORGANIZATIONS = ("Northstar Labs", "Juniper Works", "Atlas Harbor", "Cinder Systems")
PLACES = ("Madison, WI", "Raleigh, NC", "Boise, ID", "Albany, NY")


def new_key() -> str:
    """A fresh key, base64url without padding."""
    return encode_key(secrets.token_bytes(KEY_BYTES))


def encode_key(key: bytes) -> str:
    return base64.urlsafe_b64encode(key).decode().rstrip("=")


def decode_key(text: str) -> bytes:
    """The 32 bytes of a base64url key; raises ValueError for anything else."""
    key = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    if len(key) != KEY_BYTES:
        raise ValueError("a key has 32 bytes")
    return key


def key_from_environment(name: str) -> bytes | None:
    """The key in an environment variable of the driver; None where it is unset. Keys don't belong in Spark's settings, which
    are shown and logged."""
    found = os.environ.get(name)
    return decode_key(found) if found else None


def _xored(key: bytes, pad: int) -> str:
    return bytes(b ^ pad for b in key.ljust(64, b"\0")).hex()


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary column, as lower-case hex.

    The key becomes a literal of the plan, so it shows in explain output, the UI and event logs: keep those from whom the
    key is kept from (`spark.redaction.string.regex` masks plans in both, see `REDACT`).
    """
    inner = F.sha2(F.concat(F.unhex(F.lit(_xored(key, 0x36))), message), 256)
    return F.sha2(F.concat(F.unhex(F.lit(_xored(key, 0x5C))), F.unhex(inner)), 256)


def joined_with_nul(*parts: Column | str) -> Column:
    """Texts as bytes with a zero byte between."""
    out = []
    for i, p in enumerate(parts):
        out += [F.unhex(F.lit("00"))] * (i > 0) + [(F.lit(p) if isinstance(p, str) else p).cast("binary")]
    return F.concat(*out)


def keyed_digest(key: bytes | None, entity: Column | str, value: Column) -> Column:
    """The hex digest that hashes and synthetic values start from. It needs a key: a plain hash of a short value can be looked up."""
    if not key:
        raise ValueError("hashes and synthetic values need a key")
    return hmac_sha256(key, joined_with_nul(entity, value))


def base32(hexes: Column, n_bytes: int) -> Column:
    """RFC 4648 base32 without padding of n_bytes bytes given as hex."""
    length = -(-n_bytes * 8 // 5)
    bits = F.array_join(F.transform(F.filter(F.split(hexes, ""), lambda c: c != ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    padded = F.rpad(bits, length * 5, "0")
    table = F.array(*map(F.lit, _BASE32))
    return let(padded, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.element_at(table, F.conv(F.substring(b, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1)), ""))


def token(entity: Column, key: bytes, random_hex: Column) -> Column:
    """A reversible token around 16 random bytes (hex). Random bytes must be stored before the token is used twice."""
    proof = F.substring(hmac_sha256(key, F.unhex(random_hex)), 1, 20)
    return F.concat(F.lit("[[PG1|"), entity, F.lit("|"), base32(random_hex, 16), F.lit("|"), base32(proof, 10), F.lit("]]"))


def money_magnitude(value: Column) -> Column:
    """The power of ten of an amount's whole units; a fraction after the decimal mark doesn't count.

    The last dot or comma is the decimal mark unless that mark occurs again, or it is the only kind and exactly three
    digits follow it.
    """

    def whole(amount: Column) -> Column:
        mark = F.regexp_extract(amount, r"([.,])[^.,]*$", 1)
        after = F.regexp_extract(amount, r"[.,]([^.,]*)$", 1)
        other = F.when(mark == ".", ",").otherwise(".")
        groups = (F.length(amount) - F.length(F.replace(amount, mark, F.lit(""))) > 1) | (~F.contains(amount, other) & after.rlike("^[0-9]{3}$"))
        return F.when((mark == "") | groups, amount).otherwise(F.regexp_replace(amount, r"[.,][^.,]*$", ""))

    amount = F.regexp_extract(value, r"(?s)[0-9](?:.*[0-9])?", 0)
    return let(amount, lambda a: F.greatest(F.lit(0), F.length(F.ltrim(digits_of(whole(a)), F.lit("0"))) - 1))


def generalize(entity: Column, value: Column) -> Column:
    year = F.regexp_extract(value, "(?:19|20)[0-9]{2}", 0)
    symbol = F.regexp_extract(value, "^[$€£]", 0)
    return (
        F.when(entity == "DATE_TIME", F.when(year != "", year).otherwise("[DATE]"))
        .when(entity == "MONEY", F.concat(symbol, F.lit("~10^"), money_magnitude(value).cast("string")))
        .when((entity == "EMAIL_ADDRESS") & F.contains(value, F.lit("@")), F.concat(F.lit("***@"), F.substring_index(value, "@", -1)))
        .otherwise(F.concat(F.lit("["), entity, F.lit("]")))
    )


def _whole(n: Column | int) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("decimal(38,0)")


def _over(seed: Column, n: int) -> Column:
    """seed // n, exactly."""
    return F.floor((seed - seed % n) / F.lit(n).cast("decimal(10,0)")).cast("decimal(38,0)")


def _mod(seed: Column, n: int) -> Column:
    return (seed % _whole(n)).cast("long")


def _pad(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def seed_of(digest: Column) -> Column:
    """The first 16 hex digits as an unsigned number."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(38,0)")


def digit_stream(seed: Column, length: int) -> Column:
    """Decimal digits from a seed: 20 of it, then of the first 64 bits of the SHA-256 of the number before."""
    out, now = [], seed
    for _ in range(-(-length // 20)):
        out.append(F.lpad(now.cast("string"), 20, "0"))
        now = seed_of(F.sha2(now.cast("string").cast("binary"), 256))
    return F.substring(F.concat(*out), 1, length)


def _luhn_digit(prefix: Column) -> Column:
    worth = F.transform(
        F.filter(F.split(F.reverse(prefix), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(let(c.cast("int") * 2, lambda x: F.when(x > 9, x - 9).otherwise(x))),
    )
    return let(F.aggregate(worth, F.lit(0), lambda a, x: a + x), lambda s: ((10 - s % 10) % 10).cast("string"))


def _aba_digit(prefix: Column) -> Column:
    total = sum((F.substring(prefix, i + 1, 1).cast("int") * w for i, w in enumerate((3, 7, 1, 3, 7, 1, 3, 7))), F.lit(0))
    return ((10 - total % 10) % 10).cast("string")


def synthetic(entity: str, value: Column, digest: Column) -> Column:
    """A made-up value of the entity's form, determined by the digest of the real one."""

    def made(seed: Column) -> Column:
        pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (_mod(n, len(names)) + 1).cast("int"))
        if entity == "EMAIL_ADDRESS":
            return F.concat(F.lit("person"), _mod(seed, 100_000).cast("string"), F.lit("@example.test"))
        if entity == "PHONE_NUMBER":
            return F.concat(F.lit("+1-202-555-"), _pad(_mod(seed, 10_000), 4))
        if entity == "PERSON":
            return F.concat(pick(FIRST_NAMES, seed), F.lit(" "), pick(LAST_NAMES, _over(seed, 7)))
        if entity == "ORGANIZATION":
            return pick(ORGANIZATIONS, seed)
        if entity == "LOCATION":
            return pick(PLACES, seed)
        if entity == "DATE_TIME":
            return F.concat(F.lit("20"), _pad(_mod(seed, 7) + 20, 2), F.lit("-"), _pad(_mod(_over(seed, 7), 12) + 1, 2), F.lit("-"), _pad(_mod(_over(seed, 97), 28) + 1, 2))
        if entity == "MONEY":
            return F.concat(F.lit("$"), F.format_number(_mod(seed, 9990) + 10, 0), F.lit(".00"))
        if entity == "CREDIT_CARD":
            return let(F.concat(F.lit("4"), digit_stream(seed, 14)), lambda p: F.concat(p, _luhn_digit(p)))
        if entity == "US_SSN":
            area = let(_mod(seed, 799) + 100, lambda a: F.when(a >= 666, a + 1).otherwise(a))
            return F.concat(_pad(area, 3), F.lit("-"), _pad(_mod(_over(seed, 799), 99) + 1, 2), F.lit("-"), _pad(_mod(_over(seed, 799 * 99), 9999) + 1, 4))
        if entity == "IP_ADDRESS":
            six = F.concat(F.lit("2001:db8::"), F.lower(F.hex(_mod(seed, 65534) + 1)))
            return F.when(F.contains(value, F.lit(":")), six).otherwise(F.concat(F.lit("192.0.2."), (_mod(seed, 254) + 1).cast("string")))
        if entity == "API_KEY":
            body = F.substring(base32(F.sha2(seed.cast("string").cast("binary"), 256), 32), 1, 24)
            return (
                F.when(F.startswith(value, F.lit("AKIA")), F.concat(F.lit("AKIA"), F.substring(body, 1, 16)))
                .when(value.rlike("^gh[pousr]_"), F.concat(F.substring(value, 1, 4), body))
                .otherwise(F.concat(F.lit("sk-pg_"), body))
            )
        if entity == "URL":
            return F.concat(F.lit("https://service-"), _mod(seed, 10_000).cast("string"), F.lit(".example.test/resource/"), _mod(seed, 100_000).cast("string"))
        if entity == "IBAN_CODE":
            country = let(F.upper(F.substring(F.replace(value, F.lit(" "), F.lit("")), 1, 2)), lambda c: F.when(c.isin("DE", "ES", "FR", "GB"), c).otherwise("GB"))
            account = lambda c: F.when(c == "DE", digit_stream(seed, 18)).when(c == "ES", digit_stream(seed, 20)).when(c == "FR", digit_stream(seed, 23)).otherwise(F.concat(F.lit("PGAT"), digit_stream(seed, 14)))
            return let(country, lambda c: let(account(c), lambda b: F.concat(c, _pad(98 - mod97(F.concat(b, c, F.lit("00"))), 2), b)))
        if entity == "US_BANK_NUMBER":
            return let(F.concat(F.lit("01"), digit_stream(seed, 6)), lambda p: F.concat(p, _aba_digit(p)))
        prefix, n = {"PASSPORT": ("P", 8), "DRIVER_LICENSE": ("D", 8), "MEDICAL_LICENSE": ("M", 9)}[entity]
        return F.concat(F.lit(prefix), digit_stream(seed, n))

    return let(seed_of(digest), made)


def replacement(action: str, entity: Column, value: Column, key: bytes | None = None, entities: tuple[str, ...] = ENTITIES) -> Column:
    """What takes a value's place under an action that needs no stored mapping. `entities` bounds the synthetic forms in the plan."""
    if action == "keep":
        return value
    if action == "redact":
        return F.concat(F.lit("[REDACTED:"), entity, F.lit("]"))
    if action == "label":
        return F.concat(F.lit("<"), entity, F.lit(">"))
    if action == "generalize":
        return generalize(entity, value)
    if action == "hash":
        return F.concat(F.lit("sha256:"), F.substring(keyed_digest(key, entity, value), 1, 48))
    if action == "synthetic":
        return let(keyed_digest(key, entity, value), lambda d: F.coalesce(*(F.when(entity == e, synthetic(e, value, d)) for e in entities)))
    raise ValueError(f"{action} needs a mapping")
