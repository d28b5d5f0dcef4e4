"""Identities: UUIDs from names, content hashes, FNV-1a, and small number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 UUID of version 5 of a name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def stable_uuid(namespace: str, *parts: Column) -> Column:
    """UUID of parts joined by the unit separator."""
    return uuid5(namespace, F.concat_ws("\u001f", *[p.cast("string") for p in parts]))


def content_hash(columns: list[str]) -> Column:
    """SHA-1 of the row's JSON with its keys in order; it changes when the content does."""
    return F.sha1(F.to_json(F.struct(*sorted(columns))))


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    return F.aggregate(
        units, F.lit(2166136261).cast("long"),
        lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)),
    )


def asset_id(key: Column) -> Column:
    return F.concat(F.lit("a"), F.lpad(F.lower(F.hex(fnv1a(key))), 8, "0"))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative longs."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(90)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda t, _: F.when(t["b"] == 0, t).otherwise(F.struct(t["b"].alias("a"), F.try_mod(t["a"], t["b"]).alias("b"))),
    )
    return step["a"]


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise((a / gcd(a, b)).cast("long") * b)


def roman(n: Column) -> Column:
    """Roman numerals up to C; 400 is CCCC."""
    symbols = [(100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    table = F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.lit(s).alias("s")) for v, s in symbols])
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))
    done = F.aggregate(
        table, start,
        lambda t, r: F.struct((t["left"] % r["v"]).alias("left"), F.concat(t["out"], F.repeat(r["s"], F.floor(t["left"] / r["v"]).cast("int"))).alias("out")),
    )
    return done["out"]


def is_prime(n: Column) -> Column:
    tries = F.sequence(F.lit(2).cast("long"), F.greatest(F.lit(2).cast("long"), F.floor(F.sqrt(n.cast("double")))))
    return (n >= 2) & ((n == 2) | F.forall(tries, lambda k: n % k != 0))


def half_up(x: Column, places: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x * 10**places + 0.5) / 10**places
