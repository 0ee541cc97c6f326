"""Operator 3: mixing sources to target weights by capped water-filling.

Sources share a total by weight; a source never gives more than ``epochs`` times
its size, and what it cannot give is shared again by weight among the others
until no source is above its cap. A target of 2.4 times a source's size then
means two whole repetitions and a fractional one: documents in a seeded order
until the fraction is reached, the last of them in part.

Scale. Only (source, size, seeded hash) leave the texts. The order is never
sorted as a whole: words are summed per (source, hash bucket), the bucket in
which the fraction ends is found from these sums, and only that bucket of each
source (one part in 65,536) is looked at hash by hash. So a source with a third
of all rows is spread over all tasks. The driver sees one number per
water-filling round. The ranking of sources is a window over one row per source.

Defined results: a null or empty text has size 0 and takes 0; a null source is
a source of its own, ranked last; null or repeated ids share one hash, and if
the fraction ends on that hash its words are shared among the rows in proportion
to their sizes; an empty table gives an empty result. Only the named columns are
read.
"""

from __future__ import annotations

from pyspark.sql import Window

from .common import Column, DataFrame, F, n_words, written

_BUCKET_DIGITS = 4  # hex digits of the hash that name its bucket


def seeded_hash(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def _source_key(col: Column) -> list[Column]:
    return [col.isNull().alias("no_source"), F.coalesce(col.cast("string"), F.lit("")).alias("src")]


def water_level(sources: DataFrame, total: int) -> float:
    """The level λ at which targets ``min(cap, λ * weight)`` add up to the total.

    Every round clamps the sources above their cap and shares the rest by
    weight; the level only rises, so it ends when no further source is clamped."""
    level, clamped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap") if clamped >= 0 else F.lit(False)
        row = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))),
                          F.sum(F.when(over, 1).otherwise(0))).first()
        given, weight, n = row[0] or 0, row[1] or 0, row[2] or 0
        if n == clamped or not weight:
            return level
        level, clamped = (total - given) / weight, n


def plan(sized: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source of ``sized`` (no_source, src, size, h): its size, cap,
    target, whole repetitions, and where its fractional repetition ends."""
    totals = sized.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("no_source", "src")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    totals = written(totals, "mix-sources")
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(totals, total)
    target = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0), F.least(F.col("source_size"),
                                        F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    totals = (totals.withColumn("target", target).withColumn("whole", whole.cast("long"))
              .withColumn("rest", rest.cast("long")))
    # the bucket, then the hash, in which `rest` words are reached
    key = ["no_source", "src"]
    bucket = F.substring("h", 1, _BUCKET_DIGITS)
    per_bucket = sized.groupBy(*key, bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy(*key).orderBy("bucket"))
    ends = (per_bucket.withColumn("upto", upto).join(totals.select(*key, "rest"), key)
            .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
            .select(*key, "bucket", "rest", (F.col("upto") - F.col("words")).alias("before")))
    inside = (sized.withColumn("bucket", bucket).join(ends, [*key, "bucket"])
              .groupBy(*key, "h", "rest", "before").agg(F.sum("size").alias("words")))
    within = F.sum("words").over(Window.partitionBy(*key).orderBy("h")) + F.col("before")
    cut = (inside.withColumn("upto", within)
           .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
           .select(*key, F.col("h").alias("cut"), F.col("words").alias("cut_words"),
                   (F.col("rest") - F.col("upto") + F.col("words")).alias("cut_take")))
    return written(totals.join(cut, key, "left"), "mix-plan")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    return [*_source_key(F.col(f"`{source_col}`")), n_words(F.col(f"`{text_col}`")).alias("size"),
            seeded_hash(F.col(f"`{id_col}`"), seed).alias("h")]


def _extra(size: Column, h: Column) -> Column:
    """Words of a row in the fractional repetition (no cut: none at all)."""
    part = F.floor(size * F.col("cut_take") / F.col("cut_words")).cast("long")
    part = F.when(size == F.col("cut_words"), F.col("cut_take")).otherwise(part)
    return F.when(h < F.col("cut"), size).when(h == F.col("cut"), part).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words the mix takes of each row."""
    sized = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), *_sized(docs, id_col, text_col, source_col, seed)),
                    "mix-sized")
    found = sized.join(plan(sized, epochs, weights), ["no_source", "src"])
    taken = F.col("whole") * F.col("size") + _extra(F.col("size"), F.col("h"))
    return found.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The mix as rows: every document once per repetition, with all its columns.

    Texts stay whole: the document in which a source's fraction ends is repeated
    once more if at least half of it is taken. Texts are not shuffled for this
    unless the table of sources is too large to broadcast."""
    sized = written(docs.select(*_sized(docs, id_col, text_col, source_col, seed)), "mix-sized")
    cols = [F.col(f"d.`{c}`") for c in docs.columns]
    no_source, src, size, h = _sized(docs, id_col, text_col, source_col, seed)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), no_source, src, size, h)
    found = named.join(plan(sized, epochs, weights), ["no_source", "src"])
    extra = _extra(F.col("size"), F.col("h"))
    copies = F.col("whole") + F.when((extra > 0) & (2 * extra >= F.col("size")), 1).otherwise(0)
    each = F.explode(F.array_repeat(F.lit(0), copies.cast("int")))
    return found.select("d", each.alias("copy")).select(*cols)
