"""Bit layout of property ids: group | area | type | number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks and codes that results must match.
GROUP_MASK, AREA_MASK, TYPE_MASK, NUMBER_MASK = 0xF0000000, 0x0F000000, 0x00FF0000, 0x0000FFFF
GROUPS = {0x10000000: "SYSTEM", 0x20000000: "VENDOR"}
AREAS = {0x01000000: "GLOBAL", 0x03000000: "WINDOW", 0x04000000: "MIRROR", 0x05000000: "SEAT", 0x06000000: "DOOR", 0x07000000: "WHEEL"}
TYPES = {0x00100000: "STRING", 0x00200000: "BOOLEAN", 0x00400000: "INT32", 0x00410000: "INT32_VEC", 0x00500000: "INT64", 0x00510000: "INT64_VEC", 0x00600000: "FLOAT", 0x00610000: "FLOAT_VEC", 0x00700000: "BYTES", 0x00E00000: "MIXED"}
UNITS = [
    ("SHOULD_NOT_USE", 0x00), ("METER_PER_SEC", 0x01), ("RPM", 0x02), ("HERTZ", 0x03), ("PERCENTILE", 0x10), ("MILLIMETER", 0x20), ("METER", 0x21), ("KILOMETER", 0x23), ("MILE", 0x24), ("CELSIUS", 0x30), ("FAHRENHEIT", 0x31), ("KELVIN", 0x32),
    ("MILLILITER", 0x40), ("LITER", 0x41), ("GALLON", 0x42), ("US_GALLON", 0x42), ("IMPERIAL_GALLON", 0x43), ("NANO_SECS", 0x50), ("MILLI_SECS", 0x51), ("SECS", 0x53), ("YEAR", 0x59), ("WATT_HOUR", 0x60), ("MILLIAMPERE", 0x61), ("MILLIVOLT", 0x62),
    ("MILLIWATTS", 0x63), ("AMPERE_HOURS", 0x64), ("KILOWATT_HOUR", 0x65), ("AMPERE", 0x66), ("KILOPASCAL", 0x70), ("PSI", 0x71), ("BAR", 0x72), ("DEGREES", 0x80), ("MILES_PER_HOUR", 0x90), ("KILOMETERS_PER_HOUR", 0x91),
]


def _name(code: Column, names: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)]), code.cast("long")) if max(names) > 2**31 - 1 else F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code.cast("int"))


def decode(prop: Column) -> Column:
    """A struct of group, area, type (null if not known) and number."""
    p = prop.cast("long")
    part = lambda mask: p.bitwiseAND(F.lit(mask).cast("long"))
    return F.struct(_name(part(GROUP_MASK), GROUPS).alias("group"), _name(part(AREA_MASK), AREAS).alias("area"), _name(part(TYPE_MASK), TYPES).alias("type"), part(NUMBER_MASK).alias("number"))
