"""File trees as tables of (relative path, bytes), and back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, root: str, pattern: str = "*", regex: str | None = None, recursive: bool = True) -> DataFrame:
    """(FileName, Content): paths below root with /, by a name pattern and a regular expression on the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    out = files.select(F.substring_index(F.col("path"), base, -1).alias("FileName"), F.col("content").alias("Content"))
    return out.filter(F.col("FileName").rlike(regex)) if regex else out


def restore_tree(table: DataFrame, root: str) -> None:
    """Write each row's file below root, a folder that all executors have mounted; names that lead out of it are refused."""
    scheme, _, rest = root.partition("://") if "://" in root else ("file", "", root.removeprefix("file:"))
    if scheme != "file":
        raise ValueError(f"{root} isn't a mounted folder")
    root = rest

    def write(rows):
        for r in rows:
            path = os.path.normpath(os.path.join(root, r.FileName))
            if not path.startswith(os.path.normpath(root) + os.sep):
                raise ValueError(f"{r.FileName} leads out of {root}")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.part", "wb") as f:
                f.write(r.Content or b"")
            os.replace(f"{path}.part", path)

    table.select("FileName", "Content").foreachPartition(write)
