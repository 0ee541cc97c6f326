"""Audit of quality filters that are applied one after another, in every order.

Each document fails a set of filters: a bit mask. The corpus is first reduced to
*cells*: the number of documents (and of good and toxic ones) per part and mask,
at most 2^n rows a part. A recursive CTE then extends filter prefixes with the
letters not used yet, for every mask, and carries the bits applied so far; each
recursion level gives the verdicts of its step. An equality join on the mask
turns verdicts into counts, so no order is ever run over the documents.

Filters of texts are column expressions (``text_filters``). The duplicate filter
needs the table: a document fails it if a smaller doc_id has the same text.
Equal texts are found by SHA-256. They are counted per (text, part, labels)
before any row meets another one, so a text with any number of copies reaches
the last shuffle as a few rows.

Defined results: a null text is the empty text; a null part is the part ``''``;
a row without doc_id never fails the duplicate filter and is no smaller row;
repeated rows of the smallest doc_id of a text all pass it; several label rows
of a doc_id are joined by "any row says 1"; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, n_words

#: 2^n masks for each of the n! / (n - k)! prefixes of length k, all in one
#: recursion: 125,000 rows for 6 filters, 1.8 million for 7.
MAX_FILTERS = 6


def text_filters(text: Column) -> list[tuple[str, Column]]:
    """The letters A to D with their failure conditions: short, repetitive, upper
    case, symbols. ``text`` must not be null."""
    parts = F.split(text, f"[{SPACE}]+")
    words = n_words(text)
    # the empty strings before leading and after trailing space are no word
    distinct = F.size(F.array_distinct(parts)) - F.array_contains(parts, "").cast("int")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [("A", words < 50),
            ("B", 100 * distinct < 65 * words),
            ("C", 100 * upper > 5 * F.length(text)),
            ("D", text.rlike("[#$%&*|]"))]


def failure_cells(docs: DataFrame, labels: DataFrame, *, part: str = "source",
                  duplicate: str | None = "E") -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic): how many documents fail exactly the filters of
    ``mask`` (bit i is letter i), and the letters. ``duplicate`` names the filter
    of repeated texts; None leaves it out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        text.alias("body"))
    checks = text_filters(F.col("body"))
    letters = "".join(a for a, _ in checks)
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, (_, c) in enumerate(checks)), F.lit(0))
    rows = plain.select("doc", "part", bits.alias("mask"), F.unhex(F.sha2("body", 256)).alias("digest"))
    marks = labels.groupBy(F.col("doc_id").alias("doc")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = rows.join(marks, "doc", "left").fillna(0, ["good", "toxic"])
    if duplicate is None:
        return _cells(rows.withColumn("n", F.lit(1))), letters
    # copies of one id, then copies of one text: both are counted before they meet
    same = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy(*same, "doc").agg(F.count("*").alias("n"))
    texts = ids.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "n"))).alias("first"))
    smallest = F.min("first.doc").over(Window.partitionBy("digest"))
    passed = F.col("no_id") + F.when(F.col("first.doc") == F.col("smallest"), F.col("first.n")).otherwise(0)
    split = (texts.withColumn("smallest", smallest).withColumn("passed", passed)
             .select("part", "good", "toxic", F.explode(F.array(
                 F.struct(F.col("mask"), F.col("passed").alias("n")),
                 F.struct(F.col("mask").bitwiseOR(1 << len(letters)).alias("mask"),
                          (F.col("n") - F.col("passed")).alias("n")))).alias("x"))
             .select("part", "good", "toxic", "x.*").where("n > 0"))
    return _cells(split), letters + duplicate


def _cells(rows: DataFrame) -> DataFrame:
    n = F.col("n")
    return rows.groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"),
                                            F.sum(n * F.col("toxic")).alias("toxic"))


def prefixes(spark: SparkSession, letters: Sequence[str]) -> DataFrame:
    """(prefix, step, before, applied, bit, mask): every sequence of different
    letters, for every failure mask, by a recursive CTE."""
    n = len(letters)
    if n > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters")
    if any(len(a) != 1 or not a.isalnum() for a in letters) or len(set(letters)) != n:
        raise ValueError("filters are named by different single letters")
    unused = ", ".join(f"named_struct('letter', '{a}', 'bit', {1 << i})" for i, a in enumerate(letters))
    return spark.sql(f"""
        WITH RECURSIVE walk (prefix, step, before, applied, bit, mask) AS (
          SELECT '', 0, 0, 0, 0, mask FROM (SELECT explode(sequence(0, {(1 << n) - 1})) AS mask)
          UNION ALL
          SELECT concat(prefix, f.letter), step + 1, applied, applied | f.bit, f.bit, mask
          FROM walk LATERAL VIEW explode(array({unused})) AS f
          WHERE applied & f.bit = 0)
        SELECT * FROM walk WHERE step > 0""")


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) for every part, order of the filters and step."""
    n = len(letters)
    walk = prefixes(cells.sparkSession, letters)
    hit, seen = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    verdicts = walk.select("prefix", "step", "mask", (F.col("mask").bitwiseAND(F.col("applied")) == 0).alias("keeps"),
                           (hit & ~seen).alias("removes"), (hit & seen).alias("repeats"),
                           (F.col("mask") == F.col("bit")).alias("alone"))

    def total(flag: str, what: str = "n") -> Column:
        return F.sum(F.when(F.col(flag), F.col(what)).otherwise(0)).cast("long")

    # at most one row a part and mask meets the prefixes of that mask
    steps = cells.join(verdicts, "mask").groupBy("part", "prefix", "step").agg(
        total("keeps").alias("kept"), total("removes").alias("removed"), total("repeats").alias("redundant"),
        total("alone").alias("unique_fails"), total("removes", "good").alias("good_lost"),
        total("removes", "toxic").alias("toxic_lost"))
    orders = (walk.where((F.col("step") == n) & (F.col("mask") == 0))
              .select(F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
              .select("filter_order", F.expr("substring(filter_order, 1, k)").alias("prefix")))
    # a prefix of length k opens (n - k)! orders
    letter = F.substring("prefix", -1, 1)
    open_orders = F.element_at(F.array(*[F.lit(math.factorial(n - k)) for k in range(1, n + 1)]), F.col("step"))
    shares = F.sum(F.col("removed") * open_orders).over(Window.partitionBy("part", letter)).cast("long")
    return (steps.withColumn("shapley", shares).join(orders, "prefix")
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                    "toxic_lost", "shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame, *, part: str = "source") -> DataFrame:
    """The audit of the five filters A to E over whole texts, per part."""
    cells, letters = failure_cells(docs, labels, part=part)
    return audit(cells, letters)
