"""Addresses to places, by a range join with a table ip_from, ip_to, city, country, subdivision, lat, lon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ip_number

PLACE = ("city", "country", "subdivision", "lat", "lon")


def with_geo(df: DataFrame, ranges: DataFrame, ip_col: str = "ip") -> DataFrame:
    """df with a column geo; null where no range holds the address.

    Ranges must not overlap. Each one is listed under every /16 network it touches, so that
    the join is an equality on the network and a check of the bounds, which Spark can run as
    any hash join: no nested loop, and no broadcast unless Spark's own size check allows it.
    A range over many networks, up to 2**16 of them, repeats once for each.
    """
    nets = F.explode(F.sequence(F.shiftright(F.col("ip_from").cast("long"), 16), F.shiftright(F.col("ip_to").cast("long"), 16)))
    r = ranges.select(F.col("ip_from").alias("_from"), F.col("ip_to").alias("_to"), F.struct(*PLACE).alias("geo"), nets.alias("_net"))
    ips = df.select(F.col(ip_col)).where(F.col(ip_col).isNotNull()).distinct().withColumn("_ip", ip_number(F.col(ip_col))).withColumn("_net", F.shiftright("_ip", 16))
    found = ips.join(r, "_net").where(F.col("_ip").between(F.col("_from"), F.col("_to"))).select(ip_col, "geo")
    return df.join(found, ip_col, "left")
