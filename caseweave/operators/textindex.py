"""An inverted index of character n-grams: which texts contain a term, or match a LIKE pattern, without trying every pair.

A text that contains a term contains its grams, so only texts that hold the term's rarest gram are compared with it. Terms of one
or two characters use grams of their own length. Every candidate is verified, so the index never changes a result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct runs of n characters of a text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def _grams_up_to(text: Column) -> Column:
    return F.concat(*(grams(text, n) for n in range(1, GRAM + 1)))


def containing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of texts (t, ...) with the `term` that they contain; terms: term (not empty, distinct). Equi-joins alone: the texts' grams
    are counted, the rarest of each term selects its candidates. The joins sort both sides: by the size of their files the texts'
    grams, some forty times as many rows, would pass for small enough to broadcast."""
    own = F.when(F.length("term") >= GRAM, grams(F.col("term"))).otherwise(F.array(F.col("term")))
    asked = terms.select("term", F.explode(own).alias("gram"))
    seen = texts.select(F.explode(_grams_up_to(F.col("t"))).alias("gram")).groupBy("gram").count()
    # a term with a gram that no text holds is contained in none
    known = asked.join(seen.hint("merge"), "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "gram")).alias("g"))
    rare = known.where("g.n > 0").select("term", F.col("g.gram").alias("gram"))
    out = texts.withColumn("gram", F.explode(_grams_up_to(F.col("t")))).hint("merge").join(rare, "gram")
    return out.where(F.col("t").contains(F.col("term"))).drop("gram")


def build(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """gram, key: the postings of rows' columns in lower case; to be written once and searched often."""
    every = F.flatten(F.array(*(grams(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in columns)))
    return rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(every)).alias("gram")).select("gram", "key")


def literal_grams(pattern: str) -> list[str]:
    """Grams that every text matching a LIKE pattern holds; none where its literal runs are shorter than a gram."""
    runs = re.split("[%_]", pattern.lower())
    return sorted({r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)})


def matching(rows: DataFrame, key: str, columns: list[str], pattern: str, index: DataFrame | None = None) -> DataFrame:
    """Rows of which a column matches a LIKE pattern without case. With an index of them, rows without the pattern's grams aren't
    compared; patterns without a run of GRAM literal characters are tried on all rows."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    wanted = literal_grams(pattern)
    if index is None or not wanted:
        return rows.where(hit)
    found = index.where(F.col("gram").isin(wanted)).groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
    return rows.join(found.select(F.col("key").alias(key)), key, "left_semi").where(hit)


def search_case(categories: list[tuple[str, DataFrame, str, list[str]]], question: str, indexes: dict[str, DataFrame] | None = None, per: int = 10, most: int = 60) -> DataFrame:
    """category (its place in the list), id: the newest `per` rows of each category (name, rows, key, columns) that hold the question,
    the first `most` of all in order. Wildcards of the question stay active."""
    out = None
    for i, (name, rows, key, columns) in enumerate(categories):
        found = matching(rows, key, columns, f"%{question}%", (indexes or {}).get(name))
        best = found.orderBy(F.desc(key)).limit(per).select(F.lit(i).alias("category"), F.col(key).cast("long").alias("id"))
        out = best if out is None else out.unionByName(best)
    return out.orderBy("category", F.desc("id")).limit(most)
