"""Packet sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.ip import ip_text, v4_text
from tidewatch.schema import FRAME, PACKET, with_host


def read_packets(spark: SparkSession, path: str, streaming: bool = False, hosts: bool = False, **options: str) -> DataFrame:
    """Packet table with the fixed schema (and a host), as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(with_host(PACKET) if hosts else PACKET).options(**options).parquet(path)


def read_frames(spark: SparkSession, path: str, streaming: bool = False, **options: str) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(FRAME).options(**options).parquet(path)


def _number(frame: Column, start: Column | int, size: int) -> Column:
    """Big-endian unsigned number at a zero-based byte offset."""
    at = F.lit(start + 1) if isinstance(start, int) else (start + 1).cast("int")
    return F.conv(F.hex(F.substring(frame, at, F.lit(size))), 16, 10).cast("bigint")


def decode_frames(frames: DataFrame) -> DataFrame:
    """Ethernet frames to packets; frames that are not complete IP are dropped.

    The other columns of ``frames`` are kept.
    """
    columns = [c for c in frames.columns if c != "frame"]
    frame = F.col("frame")
    size = F.octet_length(frame)
    # Ethertypes, header sizes and transport numbers.
    kinds = frames.withColumn(
        "_kind", F.when(size >= 14, F.when(_number(frame, 12, 2) == 0x0800, 4).when(_number(frame, 12, 2) == 0x86DD, 6))
    )
    v4, v6 = F.col("_kind") == 4, F.col("_kind") == 6
    header = _number(frame, 14, 1).bitwiseAND(F.lit(15)) * 4
    shaped = kinds.withColumns({
        "_transport": F.when(v4 & (size >= 34), 14 + header).when(v6 & (size >= 54), F.lit(54).cast("bigint")),
        "protocol": F.when(v4 & (size >= 34), _number(frame, 23, 1)).when(v6 & (size >= 54), _number(frame, 20, 1)).cast("int"),
    })
    transport = F.col("_transport")
    has_ports = F.col("protocol").isin(6, 17)
    room = size >= transport + 4
    whole = F.when(v4, (transport >= 34) & room).when(v6, ~has_ports | room).otherwise(False)
    kept = shaped.filter(transport.isNotNull() & whole)
    payload = _number(frame, 18, 2)
    return kept.select(
        *columns,
        F.when(v4, v4_text(_number(frame, 26, 4))).otherwise(ip_text(F.substring(frame, 23, 16), unmap=False)).alias("src_ip"),
        F.when(v4, v4_text(_number(frame, 30, 4))).otherwise(ip_text(F.substring(frame, 39, 16), unmap=False)).alias("dst_ip"),
        F.when(has_ports, _number(frame, transport, 2)).otherwise(0).cast("int").alias("src_port"),
        F.when(has_ports, _number(frame, transport + 2, 2)).otherwise(0).cast("int").alias("dst_port"),
        "protocol",
        F.when(v4, _number(frame, 16, 2)).when(payload > 0, payload)
        .otherwise(F.pmod(size - 14, F.lit(65536))).cast("int").alias("length"),
    )
