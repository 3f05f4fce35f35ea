"""Snapshots: all built tables as Parquet under one folder, with a mark for each save."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from waymark.sources.schema import BUILT, GeoDataset

VERSION, INDEX_VERSION = "waymark-2", "waymark-index-1"
INDEX_TABLES = ("postings_context", "postings_primary", "search_docs", "vocabulary")


MARK = "number long, folder string, version string, index_version string, language string"


def _marks(spark: SparkSession, path: str) -> list[Row]:
    """The marks of all saves, newest first; none if there is no snapshot."""
    try:
        return spark.read.schema(MARK).json(f"{path}/_meta").where("number is not null").orderBy(F.desc("number"), F.desc("folder")).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def write_snapshot(data: GeoDataset, path: str) -> None:
    """Postings are sorted by token and entities by idx within files, so that row groups can be skipped.

    Every save goes to a folder of its own; then one line is added to the marks, which makes it the snapshot. A save that
    fails leaves the one before as it was, also where data comes from that snapshot itself. Folders of earlier saves stay
    until they are taken away."""
    spark = next(iter(data.tables.values())).sparkSession
    number = max((m["number"] for m in _marks(spark, path)), default=0) + 1
    folder = f"{number:06d}-{uuid.uuid4().hex}"
    for name, df in data.tables.items():
        if name.startswith("postings"):
            df = df.repartitionByRange("token", "type", "idx").sortWithinPartitions("token", "type", "idx")
        elif name in ("houses", "pois"):
            df = df.sortWithinPartitions("lat_e7", "lon_e7")
        df.write.parquet(f"{path}/{folder}/{name}")
    mark = [(number, folder, VERSION, INDEX_VERSION if data.indexed else "", data.language)]
    spark.createDataFrame(mark, MARK).coalesce(1).write.mode("append").json(f"{path}/_meta")


def load_snapshot(spark: SparkSession, path: str) -> GeoDataset:
    """The dataset of the newest save; ValueError if there is none, or it is of another version."""
    mark = next(iter(_marks(spark, path)), None)
    if mark is None:
        raise ValueError(f"no snapshot at {path}")
    if mark["version"] != VERSION or mark["index_version"] not in ("", INDEX_VERSION):
        raise ValueError(f"{path} is a snapshot of another version")
    names = [n for n in BUILT if mark["index_version"] or n not in INDEX_TABLES]
    return GeoDataset({n: spark.read.schema(BUILT[n]).parquet(f"{path}/{mark['folder']}/{n}") for n in names}, mark["language"])


def sizes(data: GeoDataset) -> dict[str, int]:
    """Rows of each table."""
    return {n: df.agg(F.count("*")).first()[0] for n, df in data.tables.items()}


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """name, files, bytes of the tables of the newest save. The listing tells; no file is read."""
    mark = next(iter(_marks(spark, path)), None)
    if mark is None:
        raise ValueError(f"no snapshot at {path}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/{mark['folder']}").select("path", "length")
    name = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(name.alias("name")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
