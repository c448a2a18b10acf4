"""Derived columns of traces as expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import enums

BUCKET = 3000  # clocks of a timeline bucket


def page_bytes(code: Column) -> Column:
    """Bytes of a page-size code; unmapped and reserved codes are 0."""
    out = F.when(code == 1, F.lit(enums.PAGE_SIZES[1]).cast("long"))
    for k, v in list(enums.PAGE_SIZES.items())[1:]:
        out = out.when(code == k, v)
    return out.otherwise(0)


def buffer_usage(flags: Column) -> Column:
    """Usage of a buffer: only the exact flag of ray tracing makes an acceleration structure."""
    return F.when(flags == 1 << enums.BUFFER_USAGE.index("RAY_TRACING"), 4).otherwise(3)


def image_usage(flags: Column, color_target: int, depth_stencil: int) -> Column:
    return F.when(flags.bitwiseAND(color_target) != 0, 6).when(flags.bitwiseAND(depth_stencil) != 0, 7).otherwise(5)


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Half-open ranges share a point; empty ranges never do."""
    return (a_lo < b_hi) & (b_lo < a_hi) & (a_lo < a_hi) & (b_lo < b_hi)


def nanoseconds(clocks: Column, frequency: Column) -> Column:
    """Null where the frequency is below 1 MHz."""
    mhz = F.floor(frequency / F.lit(1_000_000))
    return F.when(frequency >= 1_000_000, clocks * F.lit(1000.0) / mhz)


def size_bucket(size: Column) -> Column:
    half = F.shiftright(size, 19)
    return F.when(half > 0, F.least(F.floor(F.log2(half)).cast("int"), F.lit(11))).otherwise(0)


def age_bucket(ts: Column, low: Column, high: Column) -> Column:
    """Ten buckets of whole width; -1 where the width is 0, 0 is oldest."""
    width = F.floor((high - low) / 10).cast("long")
    return F.when(width == 0, -1).otherwise(F.least(F.greatest(F.floor((ts - low) / F.nullif(width, F.lit(0).cast("long"))).cast("int"), F.lit(0)), F.lit(9)))


def slider_bytes(step: Column, most: int = 24) -> Column:
    """Null is no bound."""
    return F.when(step == 0, F.lit(0).cast("long")).when(step < most, F.pow(F.lit(2.0), step + 7).cast("long"))


def memory_text(size: Column, base: int = 1024) -> Column:
    suffixes = ["bytes", "KiB", "MiB", "GiB", "TiB", "PiB"] if base == 1024 else ["bytes", "KB", "MB", "GB", "TB", "PB"]
    out = F.when(size < base, F.concat(F.format_number(size, 0), F.lit(f" {suffixes[0]}")))
    for k, s in enumerate(suffixes[1:], 1):
        out = out.when(size < base ** (k + 1), F.concat(F.format_number(size / F.lit(float(base**k)), 2), F.lit(f" {s}")))
    return out.otherwise(size.cast("string"))


def hex_text(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def hash128_text(high: Column, low: Column) -> Column:
    return F.when((high == 0) & (low == 0), "N/A").when(high == 0, hex_text(low)).otherwise(F.concat(hex_text(high), F.lpad(F.lower(F.hex(low)), 16, "0")))


def range_text(low: Column, high: Column) -> Column:
    """A null upper bound is infinite."""
    return F.concat(memory_text(low), F.lit(" - "), F.coalesce(memory_text(high), F.lit("∞")))


def flags_text(word: Column, names: tuple[str, ...] = enums.BUFFER_USAGE) -> Column:
    parts = [F.when(word.bitwiseAND(1 << k) != 0, n) for k, n in enumerate(names)]
    return F.when(word == 0, "None").otherwise(F.concat(F.concat_ws(" | ", *parts), F.lit(" ("), word.cast("string"), F.lit(")")))


def fnv1a32(value: Column) -> Column:
    """FNV-1a of the value's eight bytes, least significant first."""
    byte = lambda k: F.shiftright(value, 8 * k).bitwiseAND(255)
    out = F.lit(2166136261).cast("long")
    for k in range(8):
        out = (out.bitwiseXOR(byte(k)) * F.lit(16777619)).bitwiseAND(0xFFFFFFFF)
    return out


def subscription(requested: Column, size: Column) -> Column:
    return F.when(requested > size, "Over").when(requested > F.floor(size * F.lit(8) / F.lit(10)), "Close").otherwise("Under")


def device_id(device: Column, revision: Column) -> Column:
    """Upper-case hexadecimal of at least six digits."""
    text = F.hex(F.shiftleft(device.bitwiseAND(0xFFFF), 8).bitwiseOR(revision.bitwiseAND(0xFF)).cast("long"))
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def bandwidth_bytes(megabytes: Column) -> Column:
    return megabytes.cast("long") * F.lit(1 << 20)


def name_key(resource: Column, correlation: Column) -> Column:
    """One key of a resource's number and its correlation's; null is unknown and takes the other's value. Both unknown give null."""
    low, high = F.coalesce(resource, correlation), F.coalesce(correlation, resource)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def swizzle_text(*channels: Column) -> Column:
    return F.concat(*[enums.named(c, enums.SWIZZLES) for c in channels])


def radices(address: Column) -> list[Column]:
    """The four page-table indexes of an address: 10, 10, 8 and 8 bits over 4 KiB pages."""
    page = F.shiftright(address, 12)
    return [F.shiftright(page, s).bitwiseAND((1 << b) - 1).cast("int") for s, b in ((26, 10), (16, 10), (8, 8), (0, 8))]
