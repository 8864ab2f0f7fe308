"""Readers, writers and literal rows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import STRING_BYTES, Catalog, Table


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate files that all executors see: under spark.checkpoint.dir, or on one machine its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, table: Table, header: bool = False, multi_line: bool = False) -> DataFrame:
    """A CSV file under a table's schema; a row that does not fit fails the query.

    multi_line: fields may hold line ends; such a file is read by one task, any other by many."""
    df = spark.read.schema(table.schema).csv(path, header=header, mode="FAILFAST", escape='"', multiLine=multi_line)
    for c in table.columns:
        if c.type == 2:
            fits = F.coalesce(F.octet_length(c.name) <= STRING_BYTES, F.lit(True))
            df = df.withColumn(c.name, F.when(fits, F.col(c.name)).otherwise(F.raise_error(F.lit(f"{table.name}.{c.name} holds more than {STRING_BYTES} bytes"))))
    return df


def load_csvs(spark: SparkSession, catalog: Catalog, paths: list[str], store) -> dict[str, int]:
    """Appends each file to the table of its name; unknown names are skipped. Rows loaded by table."""
    loaded = {}
    for path in paths:
        name = os.path.basename(path.rstrip("/")).removesuffix(".csv")
        if name in catalog.tables:
            rows = read_csv(spark, path, catalog.table(name))
            with store.begin() as transaction:
                loaded[name] = transaction.insert(name, rows)
    return loaded


def formatted(df: DataFrame, limit: int = 1000) -> str:
    """Aligned text of the first rows: strings in quotes, nulls with their type."""
    rows = df.limit(limit).collect()
    kinds = ["string" if isinstance(f.dataType, T.StringType) else "int" if isinstance(f.dataType, T.IntegralType) else f.dataType.simpleString() for f in df.schema]
    cells = [[f"NULL({k})" if x is None else f'"{x}"' if k == "string" else str(x) for x, k in zip(row, kinds)] for row in rows]
    table = [df.columns, *cells]
    width = [max(len(r[k]) for r in table) for k in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in table) + f"\n({len(rows)} rows)"
