"""Measures: a number and a unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import after, among, before, let, look_up, one_of, only, put, trimmed
from ..functions.numbers import number
from .counts import decimal

# Written units and how they are said.
UNITS = {
    "kWh": ["kilo watt hours"], "gWh": ["giga watt hours"], "MWh": ["mega watt hours"], "Wh": ["watt hours"],
    "kgf": ["kilograms force"], "au": ["astronomical units"], "mph": ["miles per hour"], "km/h": ["kilometers per hour"],
    "km²": ["square kilometers", "square kilometer"], "m²": ["square meters", "square meter"],
    "sq ft": ["square feet", "square foot"], "sq mi": ["square miles", "square mile"],
    "m³": ["cubic meters", "cubic meter"], "dm³": ["cubic deci meters", "cubic decimeters"],
    "pb": ["peta bytes", "petabytes"], "gb": ["giga bytes", "gigabytes"], "mb": ["mega bytes", "megabytes"],
    "kb": ["kilo bytes", "kilobytes", "kilobits"], "b": ["bytes"],
    "mW": ["megawatts", "megawatt"], "kW": ["kilowatts", "kilowatt"], "gW": ["gigawatts"], "W": ["watts", "watt"], "hp": ["horsepower"],
    "gbps": ["gigabits per second", "gigabit per second"], "mbps": ["megabits per second", "megabit per second"],
    "°C": ["degrees celsius", "degree celsius"], "°F": ["degrees fahrenheit", "degree fahrenheit"], "K": ["kelvin"],
    "mhz": ["megahertz"], "khz": ["kilohertz"], "hz": ["hertz"],
    "mv": ["milli volt", "millivolts"], "v": ["volts", "volt"], "ms": ["mega siemens"],
    "μm": ["micrometers", "micrometer"], "nm": ["nanometers", "nanometer"], "mm": ["millimeters", "millimeter"],
    "cm": ["centimeters", "centimeter"], "km": ["kilometers", "kilometer"], "m": ["meters", "meter"],
    "ft": ["feet", "foot"], "mi": ["miles", "mile"], "oz": ["ounces", "ounce"],
    "kg": ["kilograms", "kilogram"], "g": ["grams", "gram"],
    "kl": ["kilo liters"], "ml": ["milliliters", "milliliter"], "l": ["liters", "liter"], "cc": ["c c"],
    "ha": ["hectares", "hectare"], "h": ["hours", "hour"], "lm": ["lumens", "lumen"], "%": ["percent"],
}
# Names of a unit by itself, as after "per".
NAMES = {
    "dm": ["decimeter", "decimeters", "deci meter", "deci meters"], "s": ["second", "seconds"], "min": ["minute", "minutes"],
    "l": ["litre", "litres"],
}

SPOKEN = {said: written for written, ways in UNITS.items() for said in ways}
NAMED: dict[str, str] = {}
for _said, _written in SPOKEN.items():
    NAMED.setdefault(_said, _written)
    NAMED.setdefault(_said.rstrip("s"), _written)
for _written, _ways in NAMES.items():
    for _said in _ways:
        NAMED.setdefault(_said, _written)

SUFFIX = f"(?s)^(.*?) ({one_of(sorted(SPOKEN, key=len, reverse=True))})$"


def unit(name: Column) -> Column:
    return look_up(NAMED, trimmed(name))


def amount(value: Column) -> Column:
    said = value.contains(" point ") | value.startswith("point ")
    return let(trimmed(value), lambda v: F.when(said, decimal(v)).otherwise(number(v).cast("string")))


def _part(sign, head: Column, written: Column) -> Column:
    """What a measure is made of: null if the unit is."""
    sign = F.lit(sign) if isinstance(sign, str) else sign
    return only(written.isNotNull(), F.struct(sign.alias("sign"), head.alias("head"), written.alias("unit")))


def counted(value: Column) -> Column:
    """A number and its unit, in parts; only minus is a sign here."""

    def of(sign: Column, rest: Column) -> Column:
        mark = F.when(rest.contains(" square "), " square ").when(rest.contains(" cubic "), " cubic ")
        # the last such word counts
        head = F.when(mark == " square ", F.regexp_extract(rest, "(?s)^(.*) square ", 1)).otherwise(F.regexp_extract(rest, "(?s)^(.*) cubic ", 1))
        name = F.when(mark == " square ", unit(F.regexp_replace(rest, "(?s)^.* square ", ""))).otherwise(unit(F.regexp_replace(rest, "(?s)^.* cubic ", "")))
        power = let(name, lambda u: F.when(mark == " cubic ", put(u, "³")).when(among(u, "ft", "mi"), put("sq ", u)).otherwise(put(u, "²")))
        return (
            F.when(rest.endswith(" miles per hour"), _part(sign, F.regexp_replace(rest, " miles per hour$", ""), F.lit("mph")))
            .when(mark.isNotNull(), _part(sign, head, power))
            .when(rest.rlike(SUFFIX), _part(sign, F.regexp_extract(rest, SUFFIX, 1), look_up(SPOKEN, F.regexp_extract(rest, SUFFIX, 2))))
        )

    sign = F.when(value.startswith("minus "), "-").otherwise("")
    return let(sign, lambda s: let(F.regexp_replace(value, "^minus ", ""), lambda x: of(s, x)))


def _rate(low: Column) -> Column:
    """A number of units per unit, in parts; the first pattern that fits decides."""
    force = " kilograms force per square centimeter"
    whole = lambda mark, power: _part("", before(low, mark), put("/", unit(after(low, mark)), power))
    per = let(counted(before(low, " per ")), lambda c: _part(c["sign"], c["head"], put(c["unit"], "/", unit(after(low, " per ")))))
    return (
        F.when(low.endswith(" miles per hour"), _part("", F.regexp_replace(low, " miles per hour$", ""), F.lit("mph")))
        .when(low.endswith(force), _part("", F.regexp_replace(low, force + "$", ""), F.lit("kgf/cm²")))
        .when(low.contains(" per square "), whole(" per square ", "²"))
        .when(low.contains(" per cubic "), whole(" per cubic ", "³"))
        .when(low.contains(" per "), per)
    )


GUARD = f"(?: per )|(?: square )|(?: cubic )|(?: {one_of(sorted(SPOKEN, key=len, reverse=True))}$)"


def measure(value: Column) -> Column:
    """The first of a rate and a plain measure whose number can be read."""
    written = lambda c: put(c["sign"], amount(c["head"]), " ", c["unit"])
    found = lambda low: F.filter(F.transform(F.array(_rate(low), counted(low)), written), lambda x: x.isNotNull())
    return let(trimmed(F.lower(value)), lambda low: only(low.rlike(GUARD), F.try_element_at(found(low), F.lit(1))))
