"""Ranked search and lookup over a corpus of standards pages(id, title, aliases, body, ord)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = "[a-zа-яё0-9#]+"
NUMBER = r"#?std[_ ]?(\d+)"


def search(pages: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """id, title, score, aliases (the first five, joined by '|'): 100 an alias, 80 part of one, 60 of the title, else twice
    the query's words in title and body, 50 at most."""
    q = query.strip().lower()
    words = sorted(set(re.findall(WORD, q)))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a))
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    overlap = F.size(F.array_intersect(F.array(*map(F.lit, words)).cast("array<string>"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    score = F.when(F.array_contains(aliases, q), 100).when(F.exists(aliases, lambda a: a.contains(q)), 80).when(F.lower(F.coalesce("title", F.lit(""))).contains(q), 60).otherwise(F.least(F.lit(50), 2 * overlap))
    found = pages.withColumn("score", score).filter(F.col("score") > 0 if q else F.lit(False))
    if limit is not None:
        found = found.orderBy(F.desc("score"), "ord").limit(limit)
    return found.select("id", "title", "score", F.array_join(F.slice("aliases", 1, 5), "|").alias("aliases"))


def get(pages: DataFrame, std_id: str, char_limit: int = 4000) -> DataFrame:
    """id, title, aliases, body, truncated of the page of that id, else of that number; the last of several."""
    s = std_id.strip().lower().lstrip("#")
    number = (re.search(r"std[_ ]?(\d+)", s) or re.fullmatch(r"(\d+)", s) or [None, None])[1]
    mine = F.regexp_extract("id", "(?i)" + NUMBER, 1)
    tier = F.when(F.lower("id") == s, 1).when((mine == (number or "")) & (mine != ""), 2)
    found = pages.withColumn("_tier", tier).filter("_tier IS NOT NULL").orderBy("_tier", F.desc("ord")).limit(1)
    body = F.coalesce("body", F.lit(""))
    return found.select("id", "title", F.array_join("aliases", "|").alias("aliases"), F.substring(body, 1, char_limit).alias("body"), (F.length(body) > char_limit).alias("truncated"))


def lookup(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, id for many lookups at once: wanted(query) meets pages by id, else by number; the last page of several."""
    q = wanted.withColumn("_s", F.regexp_replace(F.lower(F.trim("query")), "^#+", ""))
    q = q.withColumn("_n", F.coalesce(F.nullif(F.regexp_extract("_s", r"std[_ ]?(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract("_s", r"^(\d+)$", 1), F.lit(""))))
    last = lambda key, name: pages.withColumn("_k", key).filter("_k <> ''").groupBy("_k").agg(F.max(F.struct("ord", "id"))["id"].alias(name))
    by_id = last(F.lower("id"), "by_id").withColumnRenamed("_k", "_s")
    by_number = last(F.regexp_extract("id", "(?i)" + NUMBER, 1), "by_number").withColumnRenamed("_k", "_n")
    return q.join(by_id, "_s", "left").join(by_number, "_n", "left").select("query", F.coalesce("by_id", "by_number").alias("id"))


def stats(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"))
