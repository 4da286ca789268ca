"""Escapes, templates and small text forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that XML escapes, and the entities.
XML_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}


def xml_escape(value: Column) -> Column:
    for a, b in XML_ESCAPES.items():
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def csv_escape(value: Column) -> Column:
    """Quoted where it has a comma, a quote or a line end; empty for null."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(value.rlike('[,"\r\n]'), quoted).otherwise(value), F.lit(""))


def json_text(value: Column) -> Column:
    """A JSON string with its quotes; `null` for null."""
    whole = F.to_json(F.struct(value.cast("string").alias("v")))
    return F.when(value.isNull(), "null").otherwise(F.substr(whole, F.lit(6), F.char_length(whole) - 6))


def degrees_text(value: Column, precision: int = 7) -> Column:
    """A coordinate with at most `precision` decimals, without trailing zeros."""
    if not 0 <= precision <= 15:
        raise ValueError("precision is from 0 to 15")
    fixed = F.format_string(f"%.{precision}f", value)
    short = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "") if precision else fixed
    return F.when(short == "-0", "0").otherwise(short)


def degrees_fixed(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.7f", value))


def typed_id(ftype: Column, fid: Column) -> Column:
    """N1, W2, R3."""
    return F.concat(F.upper(F.substring(ftype, 1, 1)), fid.cast("string"))


TYPE_CODES = {"node": 0, "way": 1, "relation": 2}


def type_code(ftype: Column) -> Column:
    return F.when(ftype == "node", 0).when(ftype == "way", 1).when(ftype == "relation", 2)


def packed_id(ftype: Column, fid: Column) -> Column:
    """Id and type in one number: id times four plus the type's code."""
    return F.shiftleft(fid, 2).bitwiseOR(type_code(ftype).cast("long"))


def template(text: str, tags: Column, known: dict[str, Column] | None = None) -> Column:
    """Text with `{key}` replaced by the tag's value or a known column; a missing key leaves nothing."""
    known = known or {}
    parts = re.split(r"\{([^{}]*)\}", text)
    cols = [F.lit(p) if i % 2 == 0 else F.coalesce(known[p].cast("string") if p in known else F.try_element_at(tags, F.lit(p)), F.lit("")) for i, p in enumerate(parts)]
    return F.concat(*cols)


# Where features are shown and edited by default.
FEATURE_URL, EDIT_URL = "https://www.openstreetmap.org/{type}/{id}", "https://www.openstreetmap.org/edit?{type}={id}"


def feature_url(ftype: Column, fid: Column, pattern: str = FEATURE_URL) -> Column:
    return template(pattern, F.create_map().cast("map<string,string>"), {"type": ftype, "id": fid})


def revision_path(number: Column) -> Column:
    """AAA/BBB/CCC of a replication sequence number."""
    n = number.cast("long")
    return F.format_string("%03d/%03d/%03d", F.floor(n / 1_000_000), F.floor(n / 1000) % 1000, n % 1000)


def time_ago(then: Column, now: Column) -> Column:
    """The largest whole unit between two times, such as `3 days ago`."""
    s = F.unix_seconds(now) - F.unix_seconds(then)
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.when(F.floor(s / n) == 1, f" {name} ago").otherwise(f" {name}s ago"))
    return F.when(s < 60, unit(1, "second")).when(s < 3600, unit(60, "minute")).when(s < 86400, unit(3600, "hour")).otherwise(unit(86400, "day"))


def parse_colour(layer: str) -> tuple[str | None, str]:
    """`colour: query` to both; a query without one has colour None."""
    m = re.match(r"\s*([A-Za-z]+|#[0-9A-Fa-f]{3,8})\s*:(?!:)\s*(.*)\Z", layer, re.S)
    return (m[1], m[2]) if m and not m[2].startswith("=") else (None, layer.strip())


def url_parts(url: Column) -> Column:
    """Scheme, host, port and path of a URL; null parts where it has none."""
    part = lambda n: F.nullif(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://([^/:?#]*)(?::([0-9]+))?([^?#]*)", n), F.lit(""))
    return F.struct(part(1).alias("scheme"), part(2).alias("host"), part(3).cast("int").alias("port"), part(4).alias("path"))
