"""Threat feeds: plain blocklists and scored CSV lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.ip import is_v4, valid_ip


# Every character that counts as white space at the ends of a line or field.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(value) -> Column:
    return F.btrim(value, F.lit(WHITE_SPACE))


def _lines(df: DataFrame) -> DataFrame:
    line = trimmed(F.col("value"))
    return df.withColumn("line", line).filter((line != "") & ~line.startswith("#"))


def parse_blocklist(lines: DataFrame) -> DataFrame:
    """(``entry``, ``is_network``, ``score``) of every usable line of ``value``."""
    line = F.col("line")
    address = F.split_part(line, F.lit("/"), F.lit(1))
    bits = F.split_part(line, F.lit("/"), F.lit(2)).try_cast("int")
    network = line.contains("/")
    good_bits = (bits >= 0) & (bits <= F.when(is_v4(address), 32).otherwise(128))
    usable = valid_ip(address) & (F.size(F.split(line, "/")) <= 2) & (~network | F.coalesce(good_bits, F.lit(False)))
    return _lines(lines).filter(usable).select(
        line.alias("entry"), network.alias("is_network"), F.lit(1.0).cast("float").alias("score")
    ).distinct()


def parse_threat_csv(lines: DataFrame, order: list[str]) -> DataFrame:
    """(``ip``, ``score``, ``category``) per address; the last line in ``order`` wins."""
    parts = F.split("line", ",", 3)
    rows = _lines(lines).withColumns({
        "ip": trimmed(F.get(parts, F.lit(0))), "_score": trimmed(F.get(parts, F.lit(1))).try_cast("float"),
        "category": trimmed(F.get(parts, F.lit(2))),
    }).filter((F.size(parts) >= 2) & valid_ip("ip") & F.col("_score").isNotNull())
    zero, one = F.lit(0).cast("float"), F.lit(1).cast("float")
    return rows.groupBy("ip").agg(F.max(F.struct(*order, "_score", "category")).alias("_r")).select(
        "ip", F.greatest(F.least(F.col("_r._score"), one), zero).alias("score"), F.col("_r.category").alias("category")
    )


def _text(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def read_blocklist(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return parse_blocklist(_text(spark, path, glob))


def read_threat_csv(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return parse_threat_csv(_text(spark, path, glob), ["_file", "_block", "_row"])


def read_reputation_dir(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All ``*.txt`` lists and ``*.csv`` feeds of a folder; empty when missing."""
    empty = spark.createDataFrame([], "value string, _file string, _block bigint, _row bigint")
    try:
        lists = read_blocklist(spark, path, "*.txt")
        scored = read_threat_csv(spark, path, "*.csv")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return parse_blocklist(empty), parse_threat_csv(empty, ["_file", "_block", "_row"])
    return lists, scored
