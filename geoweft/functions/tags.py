"""Rules on tags: areas, indexed keys, zoom levels, numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default rules by which tags make a closed way or a relation an area.
AREA_RULES = (
    "aeroway (except taxiway), amenity, area, area:highway, barrier (city_wall, ditch, hedge, retaining_wall, wall, spikes), boundary, "
    "building, building:part, craft, golf, highway (services, rest_area, escape, elevator), historic, indoor, "
    "natural (except coastline, cliff, ridge, arete, tree_row), landuse, leisure, man_made (except cutline, embankment, pipeline), "
    "military, office, place, power (plant, substation, generator, transformer), public_transport, "
    "railway (station, turntable, roundhouse, platform), ruins, shop, tourism, type (multipolygon, boundary), "
    "waterway (riverbank, dock, boatyard, dam)"
)
# The default keys by which features are indexed; keys joined by a slash share a category.
INDEXED_KEYS = (
    "place highway railway aeroway aerialway tourism amenity shop craft power industrial man_made leisure landuse waterway "
    "natural/geological military historic healthcare office emergency building boundary building:part telecom communication route"
)
# Keys of tags that a build adds, and what they start with.
SYNTHETIC, DUPLICATE, ORPHAN = "geodesk:", "geodesk:duplicate", "geodesk:orphan"
MISSING_MEMBERS, REMOVED_REFCYCLES = "geodesk:missing_members", "geodesk:removed_refcycles"
# Most categories and most indexed keys, and the default zoom levels.
MOST_CATEGORIES, MOST_KEYS = 30, 255
ZOOM_LEVELS = "0/2/4/6/8/10/12"


@dataclass(frozen=True)
class AreaRule:
    """Values that make (or, with `exclude`, do not make) an area of a feature with `key`; no values: any value does."""

    key: str
    values: frozenset[str] = frozenset()
    exclude: bool = False


def parse_area_rules(text: str) -> list[AreaRule]:
    """Rules `key`, `key (value, ...)` and `key (except value, ...)`, separated by commas. A key that comes twice is an error."""
    rules: dict[str, AreaRule] = {}
    at = 0
    item = re.compile(r"\s*([^\s(),]+)\s*(?:\(([^()]*)\))?\s*(,|$)")
    while at < len(text) and text[at:].strip():
        m = item.match(text, at)
        if not m:
            raise ValueError(f"area rule expected at {text[at : at + 20]!r}")
        key, inner = m[1], m[2]
        if key in rules:
            raise ValueError(f"two area rules for {key!r}")
        words = [] if inner is None else [w.strip() for w in inner.split(",")]
        exclude = bool(words) and bool(re.match(r"except\s", words[0] + " "))
        if exclude:
            words[0] = words[0][6:].strip()
        words = [w for w in words if w]
        if inner is not None and not words:
            raise ValueError(f"values expected for {key!r}")
        rules[key] = AreaRule(key, frozenset(words), exclude)
        at = m.end()
    return list(rules.values())


#: Whole numbers and decimals in their one canonical form; such values are numbers, and numbers never make an area.
CANONICAL_NUMBER = r"\A-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?\z"


def strict_decimal(value: Column) -> Column:
    """The number a value is, only if it is written in the canonical form, so that it reads back the same; else null."""
    return F.when(value.rlike(CANONICAL_NUMBER) & (value != "-0"), value.try_cast("decimal(38,10)"))


def _makes_area(rule: AreaRule, value: Column) -> Column:
    hit = F.lit(True) if not rule.values else (~value.isin(*sorted(rule.values)) if rule.exclude else value.isin(*sorted(rule.values)))
    return value.isNotNull() & (value != "no") & strict_decimal(value).isNull() & hit


def area_tags(tags: Column, rules: list[AreaRule], decisive: str) -> Column:
    """Whether tags make an area. If the key `decisive` (`area` for ways, `type` for relations) has a rule and is present, it alone decides;
    a rule with `except` is never decisive. False for null tags."""
    each = {r.key: F.coalesce(_makes_area(r, F.try_element_at(tags, F.lit(r.key))), F.lit(False)) for r in rules}
    # The other element's decisive key counts like any other rule here.
    any_of = reduce(lambda a, b: a | b, [c for c in each.values()], F.lit(False))
    rule = next((r for r in rules if r.key == decisive and not r.exclude), None)
    if rule is None:
        return any_of
    return F.when(F.try_element_at(tags, F.lit(decisive)).isNotNull(), each[decisive]).otherwise(any_of)


def parse_indexed_keys(text: str) -> dict[str, int]:
    """Key to category (from 1). Categories are separated by blanks or commas, keys of one category by slashes."""
    out: dict[str, int] = {}
    groups = [g for g in re.split(r"[\s,]+", text.strip()) if g]
    if len(groups) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories of keys")
    for number, group in enumerate(groups, 1):
        for key in filter(None, group.split("/")):
            if key in out:
                raise ValueError(f"{key!r} is indexed twice")
            out[key] = number
    if len(out) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} indexed keys")
    return out


def parse_zoom_levels(text: str) -> list[int]:
    """Distinct zoom levels 0 to 12, separated by commas or slashes, in ascending order; 0 is always one of them."""
    levels = {0}
    for word in re.split(r"[/,]", text):
        if not re.fullmatch(r"\s*[0-9]{1,2}\s*", word) or int(word) > 12:
            raise ValueError(f"zoom levels are numbers from 0 to 12: {word!r}")
        levels.add(int(word))
    return sorted(levels)


def categories(tags: Column, keys: dict[str, int]) -> Column:
    """Distinct categories of the indexed keys that tags have, ascending; empty for null tags."""
    number = F.create_map(*(F.lit(x) for kv in keys.items() for x in kv))
    hit = F.filter(F.transform(F.map_keys(tags), lambda k: F.try_element_at(number, k)), lambda c: c.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(hit)), F.array().cast("array<int>"))


#: Category of features that have indexed keys of several categories.
MULTI = -1


def category(found: Column) -> Column:
    """0 for no category, the category if there is one, MULTI for several."""
    return F.when(F.size(found) == 0, 0).when(F.size(found) == 1, F.try_element_at(found, F.lit(1))).otherwise(MULTI)


def index_bits(found: Column) -> Column:
    """One bit per category."""
    return F.aggregate(found, F.lit(0), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), c - 1)))


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def sorted_tags(tags: Column) -> Column:
    """Entries (key, value) in the order of keys; empty for null tags."""
    return F.coalesce(F.array_sort(F.map_entries(tags)), F.array().cast("array<struct<key:string,value:string>>"))


def tags_text(tags: Column) -> Column:
    """`key=value` in the order of keys, separated by commas."""
    return F.array_join(F.transform(sorted_tags(tags), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ",")


def without_synthetic(tags: Column) -> Column:
    """Tags without those that a build has added."""
    return F.map_filter(tags, lambda k, v: ~k.startswith(SYNTHETIC))


def keep_tags(tags: Column, keys: list[str] | None) -> Column:
    """Only the given keys, or all for None."""
    return tags if keys is None else F.map_filter(tags, lambda k, v: k.isin(*keys))
