"""Enrichment dimensions and host topology snapshots as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatch import schema


def _read(spark: SparkSession, path: str, fields: T.StructType, fmt: str, streaming: bool) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(fields).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(path)


def read_port_pid(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False, hosts: bool = False) -> DataFrame:
    return _read(spark, path, schema.with_host(schema.PORT_PID) if hosts else schema.PORT_PID, fmt, streaming)


def read_geo_networks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schema.GEO_NETWORK, fmt, False)


def read_ptr_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schema.PTR_RECORD, fmt, False)


def read_process_inventory(spark: SparkSession, path: str, fmt: str = "parquet", hosts: bool = False) -> DataFrame:
    return _read(spark, path, schema.with_host(schema.PROCESS) if hosts else schema.PROCESS, fmt, False)


def read_interface_snapshots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schema.INTERFACE, fmt, False)


def read_route_snapshots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schema.ROUTE, fmt, False)
