"""Road tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: speed in km/h where none is tagged
DEFAULT_KMH = {
    "motorway": 110, "motorway_link": 60, "trunk": 90, "trunk_link": 50, "primary": 60, "primary_link": 40, "secondary": 60, "secondary_link": 40,
    "tertiary": 60, "tertiary_link": 40, "unclassified": 60, "residential": 40, "living_street": 20, "service": 20, "road": 40,
}
# fixed values: how much likelier a driver is to stay on a road of the class
ROUTE_PRIOR = {
    "motorway": 1.6, "motorway_link": 1.2, "trunk": 1.5, "trunk_link": 1.2, "primary": 1.4, "primary_link": 1.1, "secondary": 1.25, "secondary_link": 1.05,
    "tertiary": 1.1, "unclassified": 1.0, "residential": 1.0, "living_street": 0.8, "service": 0.6, "road": 1.0,
}
# fixed values: functional order of the classes; a link stands one below its class
RANK = {"motorway": 6.0, "trunk": 5.0, "primary": 4.0, "secondary": 3.0, "tertiary": 2.0, "residential": 1.0, "unclassified": 1.0, "living_street": 0.5, "service": 0.0}


def lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def first_of(many: Column, one: Column) -> Column:
    """The first of a list, else the single value."""
    return F.coalesce(F.get(many, 0), one)


def speed_limit_ms(maxspeed: Column, highway: Column) -> Column:
    """Free-form maxspeed in m/s: its digits, in mph if it says so; the class default where there are none."""
    text = F.lower(F.trim(maxspeed))
    digits = F.regexp_replace(text, "[^0-9]", "")
    tagged = F.when(digits != "", digits.cast("double") * F.when(text.contains("mph"), 0.44704).otherwise(1000.0 / 3600.0))
    return F.coalesce(tagged, lookup({k: float(v) for k, v in DEFAULT_KMH.items()}, highway, 40.0) * 1000.0 / 3600.0)


def route_prior(highway: Column) -> Column:
    return lookup(ROUTE_PRIOR, highway, 1.0)


def class_rank(highway: Column) -> Column:
    low = F.lower(F.coalesce(highway, F.lit("")))
    link = low.endswith("_link")
    base = F.regexp_replace(low, "_link$", "")
    return lookup(RANK, base, 1.0) - F.when(link, 1.0).otherwise(0.0)


def restriction_kind(motorcar: Column, motor_vehicle: Column, general: Column) -> Column:
    """no, only or null; the key for cars goes before the general one, and an empty value is none."""
    some = lambda c: F.when(c != "", c)
    value = F.lower(F.trim(F.coalesce(some(motorcar), some(motor_vehicle), some(general))))
    return F.when(value.startswith("no_"), "no").when(value.startswith("only_"), "only")


def applies_to_cars(excepted: Column) -> Column:
    low = F.lower(F.coalesce(excepted, F.lit("")))
    return ~(low.contains("motorcar") | low.contains("motor_vehicle"))
