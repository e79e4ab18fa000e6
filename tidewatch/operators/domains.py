"""Host names against domain lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text


def domain_match(hosts: DataFrame, entries: DataFrame, host: str = "dns_name", entry: str = "entry") -> DataFrame:
    """Distinct host names that match a list entry.

    A host matches an entry it equals or is a subdomain of, whatever the case
    of either; an entry without a dot matches any ``.``/``-`` token of the host. Hosts explode into their
    suffixes and tokens, so any list size is an equi-join.
    """
    names = hosts.select(F.col(host)).filter(F.col(host).isNotNull()).distinct()
    lower = F.lower(host)
    listed_name = F.lower(entry)
    suffix = names.select(host, F.explode(text.suffixes(lower)).alias("_part"), F.lit("suffix").alias("_how"))
    token = names.select(host, F.explode(text.tokens(lower)).alias("_part"), F.lit("token").alias("_how"))
    listed = entries.select(
        F.explode(
            F.when(
                listed_name.contains("."),
                F.array(F.struct(listed_name.alias("_part"), F.lit("suffix").alias("_how"))),
            ).otherwise(
                F.array(
                    F.struct(listed_name.alias("_part"), F.lit("suffix").alias("_how")),
                    F.struct(listed_name.alias("_part"), F.lit("token").alias("_how")),
                )
            )
        ).alias("e")
    ).select("e.*").distinct()
    return suffix.unionByName(token).join(listed, ["_part", "_how"], "left_semi").select(host).distinct()


def flag_domains(flows: DataFrame, entries: DataFrame, flag: str, host: str = "dns_name") -> DataFrame:
    """Add a boolean column: does the flow's host match the list."""
    matched = domain_match(flows, entries, host).withColumn("_hit", F.lit(True))
    return flows.join(matched, host, "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")


def match_expr(host, entries: list[str]):
    """The same rule as one expression, for short fixed lists."""
    host = F.lower(host)
    hit = F.lit(False)
    for entry in map(str.lower, entries):
        hit = hit | (host == entry) | host.endswith("." + entry)
        if "." not in entry:
            hit = hit | text.has_label(host, entry)
    return hit
