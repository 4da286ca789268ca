import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from geoweft.model import NODES, RELATIONS, WAYS  # noqa: E402
from geoweft.session import local_session  # noqa: E402
from geoweft.streaming.changes import SCHEMA as CHANGES  # noqa: E402

SCHEMAS = {
    "nodes": NODES,
    "ways": WAYS,
    "relations": RELATIONS,
    "changes": CHANGES,
    "tag_rows": "ftype string, id long, pos int, k string, v string, rev int, ts timestamp",
    "load_areas": "area_id long, area_name string, bounds struct<minx:int,miny:int,maxx:int,maxy:int>",
    "tag_columns": "k string, col_name string, col_type string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, series_key string, paper_key string, revision int, submitted timestamp",
    "containers": "container_kind string, capacity_tokens int",
    "mix_targets": "source string, target_share double, max_repeats int",
}


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


def fill(schema, rows):
    """Rows given as dicts become full tuples of the schema."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    return [tuple(r.get(n) for n in names) for r in rows]


@pytest.fixture
def folder(spark, tmp_path):
    """Write tables (lists of dicts; the rest empty) and return their folder."""

    def make(extra=(), **tables):
        for name, schema in SCHEMAS.items():
            df = spark.createDataFrame(fill(schema, tables.get(name, [])), schema).coalesce(1)
            for c in extra:
                if c not in df.columns:
                    from pyspark.sql import functions as F

                    df = df.withColumn(c, F.lit("clash"))
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
