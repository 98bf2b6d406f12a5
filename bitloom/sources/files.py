"""Files: feature and label CSV, JSON results, bit matrices. Parquet is the format between operators.

A bit matrix file holds two little-endian 32-bit numbers, rows and width, then a byte a bit, row after row.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def datasets(spark: SparkSession, folders: dict[str, str], pattern: str = "*.parquet") -> DataFrame:
    """(name, path, kind, bytes) of all files that match, by the kind of their folder; a listing, no file is read."""
    out = None
    for kind, folder in folders.items():
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"))
        name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
        found = found.select(name.alias("name"), "path", F.lit(kind).alias("kind"), "bytes")
        out = found if out is None else out.unionByName(found)
    return out


def write_features(df: DataFrame, path: str, features: list[str], label: str | None = None) -> None:
    """Features with six significant digits and the label as a whole number, a folder of headed CSV files."""
    cells = [F.format_string("%.6g", F.col(f).cast("double")).alias(f) for f in features]
    df.select(*cells, *([F.col(label).cast("long").alias(label)] if label else [])).write.mode("errorifexists").csv(path, header=True)


def read_features(spark: SparkSession, path: str, features: list[str], label: str | None = None) -> DataFrame:
    """What ``write_features`` wrote; the schema is given, so no pass to find it."""
    schema = ", ".join([*(f"`{f}` double" for f in features), *([f"`{label}` long"] if label else [])])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines; nothing is done where the folder exists already."""
    df.write.mode("ignore").json(path)


def read_results(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at the path, made first if it isn't there or wasn't finished."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_bits(df: DataFrame, path: str, order: str, bits: str = "bits") -> int:
    """One bit matrix file on the driver's file system, rows by order, streamed; returns the row count. For interchange with
    other programs: the format is one file, so this isn't a way to store large results."""
    n, width = 0, None
    with open(path + ".part", "wb") as f:
        f.write(struct.pack("<ii", 0, 0))
        for row in df.select(order, bits).orderBy(order).select(bits).toLocalIterator():
            data = np.asarray(row[0], np.uint8)
            if width is not None and len(data) != width:
                raise ValueError(f"row {n} has {len(data)} bits, not {width}")
            width = len(data)
            f.write(data.tobytes())
            n += 1
        f.seek(0)
        f.write(struct.pack("<ii", n, width or 0))
    os.replace(path + ".part", path)
    return n


def read_bits(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """(path, row, bits) of all bit matrix files under a path; a task a file, ``rows`` rows a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                n, width = struct.unpack_from("<ii", data)
                if len(data) != 8 + n * width:
                    raise ValueError(f"{name}: {len(data)} bytes, not {8 + n * width}")
                m = np.frombuffer(data, np.int8, n * width, 8).reshape(n, width)
                for at in range(0, n, rows):
                    part = m[at : at + rows]
                    yield pd.DataFrame({"path": name, "row": np.arange(at, at + len(part)), "bits": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, bits array<tinyint>")
