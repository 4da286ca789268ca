"""Output formats of a query's features: one text line (or block) per feature, with header, footer and separators where a format has them.

Lines are made by column expressions and stay distributed; `write_lines` puts them into a folder, `write_file` streams them partition by
partition into one file, which appears under its name when it is complete.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import tags as T
from geoweft.functions import text
from geoweft.operators import geometry

GENERATOR = "geoweft"
#: Format names, their other names, and the formats of file endings.
FORMATS = ("brief", "count", "csv", "geojson", "geojsonl", "list", "wkt", "xml", "pbf")
ALIASES = {"jsonl": "geojsonl", "ndjson": "geojsonl", "json": "geojson", "osm": "xml", "osm.pbf": "pbf"}
CSV_COLUMNS = ["id", "lon", "lat", "tags"]


class FormatError(ValueError):
    """A format that does not exist."""


def resolve_format(name: str | None, output: str | None = None) -> str:
    """The format named, else that of the file's ending, else `brief`; an unknown name is an error, an unknown ending is not."""
    if name:
        found = ALIASES.get(name.lower(), name.lower())
        if found not in FORMATS:
            raise FormatError(f"invalid format: {name}")
        return found
    if output:
        for ending in (".".join(os.path.basename(output).split(".")[1:]), os.path.splitext(output)[1][1:]):
            found = ALIASES.get(ending.lower(), ending.lower())
            if found in FORMATS:
                return found
    return "brief"


def list_line() -> Column:
    return text.typed_id(F.col("ftype"), F.col("id"))


def brief_block(tags: Column | None = None) -> Column:
    """`type/id`, then `key = value` lines, keys padded to the longest of the feature."""
    entries = T.sorted_tags(F.col("tags") if tags is None else tags)
    width = F.coalesce(F.array_max(F.transform(entries, lambda e: F.char_length(e["key"]))), F.lit(0))
    lines = F.transform(entries, lambda e: F.concat(F.lit("\n  "), F.rpad(e["key"], width, F.lit(" ")), F.lit(" = "), F.coalesce(e["value"], F.lit(""))))
    return F.concat(F.col("ftype"), F.lit("/"), F.col("id").cast("string"), F.array_join(lines, ""))


def csv_line(columns: list[str], precision: int = 7) -> Column:
    """A row of special columns (`id`, `lon`, `lat`, `tags`, `geom`) and tags, escaped."""
    lon, lat = geometry.centre(F.col("parts"))
    special = {
        "id": list_line(),
        "lon": text.degrees_text(lon, precision),
        "lat": text.degrees_text(lat, precision),
        "tags": T.tags_text(F.col("tags")),
        "geom": geometry.wkt(F.col("whole"), F.col("parts"), precision),
    }
    return F.array_join(F.array(*(text.csv_escape(special.get(c, T.tag(F.col("tags"), c))) for c in columns)), ",")


def json_properties(tags: Column | None = None) -> Column:
    entries = T.sorted_tags(F.col("tags") if tags is None else tags)
    quoted = lambda v: F.when(v.isNull(), "null").otherwise(_quote(v))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), quoted(e["value"]))), ","), F.lit("}"))


def _quote(value: Column) -> Column:
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substr(whole, F.lit(6), F.char_length(whole) - 6)


def geojson_line(precision: int = 7) -> Column:
    return F.concat(F.lit('{"type":"Feature","id":"'), list_line(), F.lit('","geometry":'), geometry.geojson(F.col("whole"), F.col("parts"), precision), F.lit(',"properties":'), json_properties(), F.lit("}"))


@dataclass(frozen=True)
class Layout:
    """What surrounds the lines of a format in one file."""

    header: str = ""
    separator: str = "\n"
    footer: str = "\n"
    empty: str | None = None
    single: tuple[str, str] | None = None


def layout(name: str, csv_columns: list[str] | None = None) -> Layout:
    """Header, separator and footer; `empty` is the whole output without features, `single` the frame of exactly one."""
    if name == "csv":
        head = ",".join(f'"{c}"' if "," in c or '"' in c else c for c in (csv_columns or CSV_COLUMNS)) + "\n"
        return Layout(head, empty=head)
    if name == "geojson":
        head, foot = '{"type":"FeatureCollection","generator":"' + GENERATOR + '","features":[\n', "\n]}\n"
        return Layout(head, ",\n", foot, empty=head.rstrip("\n") + "]}\n")
    if name == "wkt":
        return Layout("GEOMETRYCOLLECTION(\n", ",\n", ")\n", empty="GEOMETRYCOLLECTION EMPTY\n", single=("", "\n"))
    return Layout(empty="")


def lines(features: DataFrame, name: str, keys: list[str] | None = None, precision: int = 7) -> DataFrame:
    """`features` (ftype, id, tags, and whole, parts for geometric formats) as rows of one column, `line`. `count` is one row."""
    if name == "count":
        return features.agg(F.count("*").cast("string").alias("line"))
    if keys is not None and name != "csv":
        features = features.withColumn("tags", T.keep_tags(F.col("tags"), keys))
    make = {
        "list": list_line,
        "brief": brief_block,
        "csv": lambda: csv_line(keys or CSV_COLUMNS, precision),
        "geojson": lambda: geojson_line(precision),
        "geojsonl": lambda: geojson_line(precision),
        "wkt": lambda: geometry.wkt(F.col("whole"), F.col("parts"), precision),
    }
    if name not in make:
        raise FormatError(f"invalid format: {name}")
    return features.select(make[name]().alias("line"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Lines as text files in a folder, by Spark's commit protocol: for results of any size."""
    rows.write.mode("overwrite").text(path)


def write_file(rows: DataFrame, name: str, path: str, keys: list[str] | None = None) -> int:
    """Lines as one local file with the format's frame; the driver holds one partition at a time. Returns the number of lines."""
    look, n, first = layout(name, keys), 0, None
    with open(path + ".tmp", "w", encoding="utf-8", newline="") as out:
        for r in rows.toLocalIterator():
            if n == 0:
                first = r[0]
            else:
                out.write(look.header + first + look.separator if n == 1 else look.separator)
                out.write(r[0])
            n += 1
        if n == 0:
            out.write(look.empty if look.empty is not None else look.header + look.footer)
        elif n == 1:
            before, after = look.single or (look.header, look.footer)
            out.write(before + first + after)
        else:
            out.write(look.footer)
    os.replace(path + ".tmp", path)
    return n


def map_html(layers: list[tuple[str | None, DataFrame]], path: str, popup: str | None = None, tooltip: str | None = None, link: str | None = None, basemap: str = "https://tile.openstreetmap.org/{z}/{x}/{y}.png") -> int:
    """A web map of layers (colour, features with geometry), zoomed to what they show; the features' text streams into the page. Returns their number."""
    n = 0
    with open(path + ".tmp", "w", encoding="utf-8") as out:
        out.write("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><link rel=\"stylesheet\" href=\"https://unpkg.com/leaflet@1.9.4/dist/leaflet.css\"><script src=\"https://unpkg.com/leaflet@1.9.4/dist/leaflet.js\"></script>")
        out.write(f"<style>html,body,#map{{height:100%;margin:0}}</style></head><body><div id=\"map\"></div><script>\nvar map=L.map('map');L.tileLayer('{basemap}').addTo(map);var all=L.featureGroup().addTo(map);\n")
        out.write("function add(g,c,p,t,u){L.geoJSON(g,{style:{color:c},pointToLayer:(f,q)=>L.circleMarker(q,{radius:5,color:c})}).bindPopup(p).bindTooltip(t).on('click',e=>{if(u&&e.originalEvent.ctrlKey)window.open(u)}).addTo(all)}\n")
        for colour, features in layers:
            known = {"id": F.col("id"), "type": F.col("ftype")}
            table = F.concat(F.lit("<h3>"), F.col("ftype"), F.lit(" "), F.col("id").cast("string"), F.lit("</h3><pre>"), F.array_join(F.transform(T.sorted_tags(F.col("tags")), lambda e: F.concat(text.xml_escape(e["key"]), F.lit("="), text.xml_escape(F.coalesce(e["value"], F.lit(""))))), "\n"), F.lit("</pre>"))
            pop = text.xml_escape(text.template(popup, F.col("tags"), known)) if popup else table
            tip = text.xml_escape(text.template(tooltip, F.col("tags"), known)) if tooltip else list_line()
            url = text.template(link or text.FEATURE_URL, F.col("tags"), known)
            quote = lambda c: F.replace(_quote(c), F.lit("</"), F.lit("<\\/"))
            js = F.concat(F.lit("add("), geometry.geojson(F.col("whole"), F.col("parts"), 6), F.lit(f",'{colour or 'blue'}',"), quote(pop), F.lit(","), quote(tip), F.lit(","), quote(url), F.lit(");\n"))
            for r in features.select(js).toLocalIterator():
                out.write(r[0])
                n += 1
        out.write("if(all.getLayers().length)map.fitBounds(all.getBounds());else map.setView([0,0],2);\n</script></body></html>\n")
    os.replace(path + ".tmp", path)
    return n
