"""Name registry: three-valued answers (exists, absent, unknown). A name without a record is unknown, never absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import registry_values as V


def functions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.FUNCTIONS), "name string, verdict string, kind string")


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.METHODS), "name string, verdict string")


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ru, en) for ru, names in V.SYNONYMS.items() for en in names], "ru string, en string")


def disproved(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in V.DISPROVED], "name string")


def syntax_help(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.HELP), "name string, sig string, desc string, since string")


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {"functions": functions(spark), "methods": methods(spark), "synonyms": synonyms(spark), "disproved": disproved(spark), "help": syntax_help(spark)}


def verdicts(names: DataFrame, reg: dict[str, DataFrame]) -> DataFrame:
    """query, name, verdict, kind, scope: global functions first, then manager methods, in any case; else unknown."""
    f = reg["functions"].select("name", "verdict", "kind", F.lit("global_function").alias("scope"), F.lit(1).alias("tier"))
    m = reg["methods"].select("name", "verdict", F.lit(None).cast("string").alias("kind"), F.lit("catalog_manager_method").alias("scope"), F.lit(2).alias("tier"))
    first = Window.partitionBy("low").orderBy("tier", "name")
    known = f.unionByName(m).withColumn("low", F.lower("name")).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "tier")
    # The registry is a fixed list of names, so it is the side to broadcast.
    joined = names.withColumn("low", F.lower("query")).join(F.broadcast(known), "low", "left")
    return joined.select("query", F.coalesce("name", "query").alias("name"), F.coalesce("verdict", F.lit("unknown")).alias("verdict"), "kind", "scope")


def help_for(names: DataFrame, reg: dict[str, DataFrame]) -> DataFrame:
    """query, name, verdict, kind, scope, sig, desc, since, status: help, absent, no_signature or unknown."""
    h = reg["help"].select(F.lower("name").alias("low"), F.col("name").alias("help_name"), "sig", "desc", "since")
    v = verdicts(names, reg).withColumn("low", F.lower("query")).join(F.broadcast(h), "low", "left")
    status = F.when(F.col("help_name").isNotNull(), "help").when(F.col("verdict") == "absent", "absent").when(F.col("verdict") == "exists", "no_signature").otherwise("unknown")
    return v.select("query", F.coalesce("help_name", "name").alias("name"), "verdict", "kind", "scope", "sig", "desc", "since", status.alias("status"))


def find_synonyms(names: DataFrame, reg: dict[str, DataFrame]) -> DataFrame:
    """query, ru, en, verified: pairs whose Russian name is the query in any case, or one of whose English names is the
    query; without a pair one row, absent or unknown."""
    s = reg["synonyms"]
    by_ru = names.withColumn("low", F.lower("query")).join(F.broadcast(s.withColumn("low", F.lower("ru"))), "low").select("query", "ru", "en")
    hit = names.join(F.broadcast(s.select("ru", F.col("en").alias("query"))), "query")
    by_en = hit.join(F.broadcast(s), "ru").select("query", "ru", "en")
    pairs = by_ru.unionByName(by_en).distinct().withColumn("verified", F.lit("exists"))
    rest = names.join(pairs.select("query"), "query", "left_anti").join(F.broadcast(reg["disproved"].select(F.col("name").alias("query"), F.lit(1).alias("d")).distinct()), "query", "left")
    none = F.lit(None).cast("string")
    return pairs.unionByName(rest.select("query", none.alias("ru"), none.alias("en"), F.when(F.col("d") == 1, "absent").otherwise("unknown").alias("verified")))


def version_check(names: DataFrame, reg: dict[str, DataFrame], version: str = "8.3.24") -> DataFrame:
    """query, name, available (null: unknown), verified. Versions are compared as strings."""
    h = help_for(names, reg)
    available = F.when(F.col("verdict") == "absent", False).when(F.col("verdict") == "exists", True).when(F.col("since").isNotNull(), F.col("since") <= version)
    return h.select("query", "name", available.alias("available"), F.col("verdict").alias("verified"))
