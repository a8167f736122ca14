"""Cluster XML: entries with a representative and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PROPERTY = T.ArrayType(T.StructType([T.StructField("_type", T.StringType()), T.StructField("_value", T.StringType())]))
_REFERENCE = T.StructType([T.StructField("_type", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("property", _PROPERTY)])
_MEMBER = T.StructType([T.StructField("dbReference", _REFERENCE)])
ENTRY = T.StructType([
    T.StructField("_id", T.StringType()), T.StructField("representativeMember", _MEMBER), T.StructField("member", T.ArrayType(_MEMBER)),
])


def _ids(kind: str) -> Column:
    members = F.concat(F.array("representativeMember"), F.coalesce("member", F.array().cast(T.ArrayType(_MEMBER))))
    value = lambda m: F.filter(m["dbReference"]["property"], lambda p: p["_type"] == kind)
    return F.flatten(F.transform(F.filter(members, lambda m: m.isNotNull()), lambda m: F.coalesce(F.transform(value(m), lambda p: p["_value"]), F.array().cast("array<string>"))))


def read_cluster_xml(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, members100, members90): the representative's ids come first."""
    entries = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    return entries.select(F.col("_id").alias("cluster"), _ids("UniRef100 ID").alias("members100"), _ids("UniRef90 ID").alias("members90"))


def cluster_members(entries: DataFrame, members: str = "members100") -> DataFrame:
    """(id, cluster): one row per member id; an id in several clusters gets the last by name."""
    return entries.select(F.explode(members).alias("id"), "cluster").groupBy("id").agg(F.max("cluster").alias("cluster"))
