"""The wordlist view over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import number_rows


def wordlist(spark: SparkSession, sf_dir: str, meaning: Column | None = None) -> DataFrame:
    """id, doculect, concept, form, cogid: words are parts, doculects the nations that supply them, concepts their brands (or the meaning given).

    Doculect and concept are dimension-sized, the words grow with the data. All
    lines and parts count; only the columns that are needed are read.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = read("lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = read("part").select("p_partkey", (F.col("p_brand") if meaning is None else meaning).alias("concept"), "p_name", "p_type")
    suppliers = read("supplier").select("s_suppkey", "s_nationkey")
    nations = read("nation").select("n_nationkey", "n_name")
    rows = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("doculect"), "concept", F.col("p_name").alias("form"), F.col("p_type").alias("cogid"))
        .distinct()
    )
    return number_rows(rows, ["doculect", "concept", "form", "cogid"], leading=2)


#: The same view in DuckDB SQL, as a common table expression named wl.
WORDLIST_SQL = """
wl AS (
  SELECT row_number() OVER (ORDER BY doculect, concept, form, cogid) AS id, doculect, concept, form, cogid
  FROM (
    SELECT DISTINCT n_name AS doculect, p_brand AS concept, p_name AS form, p_type AS cogid
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey
  )
)"""
