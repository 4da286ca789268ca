"""Change files (OSM XML changes, gzipped or not), replication state files, and the paths of sequences."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoweft.functions.mercator import UNIT, project_x, project_y

CHANGES = (
    "file string, position long, ftype string, id long, version int, op string, lat double, lon double, "
    "refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, tags array<struct<k:string,v:string>>"
)
# Sections and elements of a change file, and the children that each element may have.
SECTIONS = ("create", "modify", "delete")
CHILDREN = {"node": {"tag"}, "way": {"tag", "nd"}, "relation": {"tag", "member"}}


class ChangeFileError(ValueError):
    """A change file that breaks the format; the message names the file and what is wrong."""


def _need(e: ElementTree.Element, names: tuple[str, ...], file: str) -> list[str]:
    values = [e.get(n) for n in names]
    if None in values:
        raise ChangeFileError(f"{file}: <{e.tag}> needs {', '.join(names)}")
    return values


def parse_changes(data: bytes, file: str) -> Iterator[tuple]:
    """Rows of CHANGES in the order of the file; elements are forgotten once read."""
    source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    depth, section, position = [], None, 0
    try:
        for event, e in ElementTree.iterparse(source, events=("start", "end")):
            if event == "start":
                depth.append(e.tag)
                if len(depth) == 1 and e.tag != "osmChange":
                    raise ChangeFileError(f"{file}: <osmChange> expected, not <{e.tag}>")
                if len(depth) == 2:
                    if e.tag not in SECTIONS:
                        raise ChangeFileError(f"{file}: unknown section <{e.tag}>")
                    section = e.tag
                if len(depth) == 3 and e.tag not in CHILDREN:
                    raise ChangeFileError(f"{file}: unknown element <{e.tag}>")
                continue
            depth.pop()
            if len(depth) != 2:
                continue
            if bad := [c.tag for c in e if c.tag not in CHILDREN[e.tag]]:
                raise ChangeFileError(f"{file}: <{bad[0]}> in <{e.tag}>")
            fid = int(_need(e, ("id",), file)[0])
            number = lambda n, kind: None if e.get(n) is None else kind(e.get(n))  # noqa: E731, B023
            tags = [dict(zip("kv", _need(c, ("k", "v"), file))) for c in e if c.tag == "tag"]
            refs = [int(_need(c, ("ref",), file)[0]) for c in e if c.tag == "nd"] if e.tag == "way" else None
            members = [(lambda t, r, o: {"type": t, "ref": int(r), "role": o})(*_need(c, ("type", "ref", "role"), file)) for c in e if c.tag == "member"] if e.tag == "relation" else None
            yield file, position, e.tag, fid, number("version", int), section, number("lat", float), number("lon", float), refs, members, tags
            position += 1
            e.clear()
    except ElementTree.ParseError as x:
        raise ChangeFileError(f"{file}: {x}") from None


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ("file position ftype id version op lat lon refs members tags").split()]
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            held = []
            for row in parse_changes(content, path):
                held.append(row)
                if len(held) == 20_000:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            yield pd.DataFrame(held, columns=names)


def read_changes(spark: SparkSession, *paths: str) -> DataFrame:
    """All changes of files or folders, one task per file at least; files count in the order of their names.

    The result has the columns of the changes table: x and y are projected, `seq` grows with file and position, `is_deleted` follows the section.
    """
    return parse_files(spark.read.format("binaryFile").load(list(paths)))


#: Bits of a change's sequence number: position in its file, number of the file in its batch; the batch has the other 19.
POSITION_BITS, FILE_BITS = 24, 20


def as_changes(rows: DataFrame, files: DataFrame, batch: int = 0) -> DataFrame:
    """Rows of CHANGES in the columns of the changes table. `files` (path) are numbered by their names, a row each: a million in one batch, 16 million changes in one."""
    numbered = files.select(F.col("path").alias("file")).distinct().withColumn("_file", F.row_number().over(Window.orderBy("file")) - 1)
    fits = F.assert_true((F.col("_file") < 2**FILE_BITS) & (F.col("position") < 2**POSITION_BITS), "too many files in a batch, or changes in a file")
    seq = F.lit(batch).cast("long") * 2 ** (FILE_BITS + POSITION_BITS) + F.shiftleft(F.col("_file").cast("long"), POSITION_BITS) + F.col("position")
    at = lambda c: F.round(F.col(c) * UNIT).cast("int")
    return rows.join(numbered, "file").where(fits.isNull()).select(
        seq.alias("seq"), "ftype", "id", "version", "op", (F.col("op") == "delete").alias("is_deleted"), F.lit(None).cast("timestamp").alias("ts"),
        "lat", "lon", project_x(at("lon")).cast("int").alias("x"), project_y(at("lat")).cast("int").alias("y"), "refs", "members", "tags",
    )


def parse_files(files: DataFrame, batch: int = 0) -> DataFrame:
    """Changes of files given as rows `path`, `content`; the numbers of files need no look into them."""
    return as_changes(files.select("path", "content").mapInPandas(_rows, CHANGES), files, batch)


def parse_state(text: str) -> tuple[int, str]:
    """Sequence number and timestamp (ISO) of a state file: `key=value` lines, backslashes before colons, comments after #."""
    values = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    try:
        return int(values["sequenceNumber"].strip()), values["timestamp"].strip().replace("\\", "")
    except KeyError as x:
        raise ChangeFileError(f"state file without {x.args[0]}") from None


def sequence_path(number: int) -> str:
    """AAA/BBB/CCC of a sequence number."""
    if not 0 <= number < 10**9:
        raise ValueError("sequence numbers have up to nine digits")
    return f"{number // 1_000_000:03d}/{number // 1000 % 1000:03d}/{number % 1000:03d}"


def replication_states(spark: SparkSession, folder: str) -> DataFrame:
    """`sequence`, `ts`, `path` of all state files of a local replication folder."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.state.txt").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    number = F.regexp_extract("value", r"(?m)^sequenceNumber=(\d+)", 1).cast("long")
    ts = F.replace(F.regexp_extract("value", r"(?m)^timestamp=(\S+)", 1), F.lit("\\"), F.lit(""))
    return rows.select(number.alias("sequence"), ts.try_cast("timestamp").alias("ts"), "path")


def sequence_at(states: DataFrame, ts) -> DataFrame:
    """The last sequence that is not after a time."""
    return states.where(F.col("ts") <= F.lit(ts)).agg(F.max("sequence").alias("sequence"))
