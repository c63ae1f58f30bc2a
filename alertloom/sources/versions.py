"""Stores of several tables that are replaced as a whole.

Each version is a folder of its own. It becomes the current one when an empty file with its number and folder name appears under
`versions`, which is one step on every file system; until then, and whenever a writer fails, readers see the version before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Versions before the current one that stay, for readers that have begun.
KEPT = 1


class StoreExists(PySparkException, ValueError):
    """A store would be replaced without being told to."""


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and folder of each published version, the current one last."""
    fs, to_path = _files(spark, path)
    marks = to_path(f"{path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(marks)] if fs.exists(marks) else []
    return sorted((int(number), folder) for number, _, folder in (n.partition("-") for n in names) if number.isdigit() and folder)


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current version; ValueError if nothing has been published."""
    found = _versions(spark, path)
    if not found:
        raise ValueError(f"no store at {path}")
    return f"{path}/{found[-1][1]}"


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{current(spark, path)}/{name}")


def publish(tables: dict[str, DataFrame], path: str, replace: bool = False, check: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
    """Writes the tables as a new version, checks what was written and makes it current. Gives its folder.

    The tables may be read from the store that they replace. Without `replace` a store that is there raises StoreExists. If a table can't be written or
    the check raises, the store stays as it was. Of two versions published at once one is current."""
    spark = next(iter(tables.values())).sparkSession
    if not replace and _versions(spark, path):
        raise StoreExists(f"there is a store at {path}")
    fs, to_path = _files(spark, path)
    name = f"v{uuid.uuid4().hex}"
    folder = f"{path}/{name}"
    try:
        for table, df in tables.items():
            df.write.parquet(f"{folder}/{table}")
        if check is not None:
            check({table: spark.read.parquet(f"{folder}/{table}") for table in tables})
    except BaseException:
        fs.delete(to_path(folder), True)
        raise
    before = _versions(spark, path)
    number = before[-1][0] + 1 if before else 1
    fs.create(to_path(f"{path}/versions/{number:012d}-{name}"), False).close()
    for old, gone in before[: max(0, len(before) - KEPT)]:
        fs.delete(to_path(f"{path}/versions/{old:012d}-{gone}"), False)
        fs.delete(to_path(f"{path}/{gone}"), True)
    return folder
