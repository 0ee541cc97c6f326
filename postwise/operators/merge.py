"""Key joins and the snapshot merge.

Lookups against a store (seen, scores, previous snapshot) are many-to-one joins.
The store side is first reduced to one row per key with an aggregate that
combines map-side, so a key repeated in a third of the rows never reaches one
task whole; the many side keeps its rows and AQE splits a skewed partition of it.
The lookups of an export build a hash table of the store's part and let the postings
pass: whole postings are not sorted, so a task's memory does not grow with their texts.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.values import date_prefix, first_truthy, posting_key, truthy
from .dedup import dedup_last_by_key

KEY = "__key"


def with_key(df: DataFrame, name: str = KEY) -> DataFrame:
    """The duplicate key ``job_url`` → ``url`` → ''."""
    return df.withColumn(name, posting_key(df.columns))


def salt_missing(c: Column, buckets: int = 4096) -> Column:
    """A lookup value for a join column: NULL or '' (no lookup wanted) becomes a
    salted value that spreads over ``buckets`` partitions and matches nothing."""
    salt = F.concat(F.lit("\u0000"), (F.monotonically_increasing_id() % buckets).cast("string"))
    return F.when(F.coalesce(c, F.lit("")) == "", salt).otherwise(c)


def salt_empty_key(df: DataFrame, name: str = KEY, buckets: int = 4096) -> DataFrame:
    """Rows without a key (often the hottest key of all) can never match a store
    entry — stores hold non-empty keys only — yet would all hash to one shuffle
    partition. They get a salted key that spreads them over ``buckets`` and still
    matches nothing, so the join result is unchanged."""
    return df.withColumn(name, salt_missing(F.col(name), buckets))


def as_of_ts(as_of) -> Column:
    """``as_of`` (text, date, datetime or Column) as a timestamp Column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        return F.lit(as_of).cast("timestamp")
    if isinstance(as_of, _dt.datetime):
        return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    if isinstance(as_of, _dt.date):
        return F.lit(as_of.isoformat()).cast("timestamp")
    raise TypeError(f"as_of: {as_of!r}")


def as_of_date(as_of) -> Column:
    return F.date_format(as_of_ts(as_of), "yyyy-MM-dd")


def seen_keys(seen: DataFrame, url: str = "job_url") -> DataFrame:
    """Distinct non-empty keys of the seen store (map-side combined)."""
    return seen.select(F.col(url).alias(KEY)).filter(truthy(KEY).isNotNull()).distinct()


def seen_first_dates(seen: DataFrame, url: str = "job_url", ts: str = "seen_at") -> DataFrame:
    """Seen store as key → 'YYYY-MM-DD' of its time (one value per key)."""
    return (
        seen.filter(truthy(url).isNotNull())
        .groupBy(F.col(url).alias(KEY))
        .agg(F.max(ts).alias("__seen_ts"))
        .select(KEY, date_prefix("__seen_ts").alias("__seen_date"))
    )


# ---------------------------------------------------------------- J1 / J2

def new_postings(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings with a key that the seen store does not hold (bag semantics)."""
    keyed = with_key(postings).filter(F.col(KEY) != "")
    return keyed.join(seen_keys(seen), KEY, "left_anti").drop(KEY)


def new_postings_incremental(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """J1 for a micro-batch against a large, growing seen store: the store is
    first filtered to the batch's distinct keys, and only what is left enters
    the anti join. Both sides' real sizes decide the join at run time: a small
    batch is broadcast and the store only scanned."""
    keyed = with_key(batch).filter(F.col(KEY) != "")
    keys = keyed.select(KEY).distinct()
    known = seen.select(F.col("job_url").alias(KEY)).join(keys, KEY, "left_semi").distinct()
    return keyed.join(known, KEY, "left_anti").drop(KEY)


def seen_within(postings: DataFrame, seen: DataFrame, as_of, hours: int = C.DAILY_LOOKBACK_HOURS,
                ts: str = "seen_at") -> DataFrame:
    """Postings whose key was seen at or after ``as_of - hours``."""
    cutoff = as_of_ts(as_of) - F.make_interval(hours=F.lit(hours))
    recent = seen.filter(F.col(ts) >= cutoff)
    keyed = with_key(postings).filter(F.col(KEY) != "")
    return keyed.join(seen_keys(recent), KEY, "left_semi").drop(KEY)


# ---------------------------------------------------------------- J3 / J4

def score_table(scores: DataFrame, url: str = "job_url", score: str = "score") -> DataFrame:
    return (scores.filter(truthy(url).isNotNull())
            .groupBy(F.col(url).alias(KEY)).agg(F.max(score).alias("__score")))


def attach_scores(postings: DataFrame, scores: DataFrame, out: str = "ai_score") -> DataFrame:
    """Attach the cached score where the key has one."""
    table = score_table(scores)
    keyed = salt_empty_key(with_key(postings))
    joined = keyed.join(table.hint("shuffle_hash"), KEY, "left")
    if out in postings.columns:
        joined = joined.withColumn(out, F.coalesce(F.col("__score").cast("int"), F.col(out)))
    else:
        joined = joined.withColumn(out, F.col("__score").cast("int"))
    return joined.drop(KEY, "__score")


def backfill_first_seen(postings: DataFrame, seen: DataFrame, as_of) -> DataFrame:
    """J4 (export): first_seen = existing, else seen date, else date_posted[:10], else as_of."""
    keyed = salt_empty_key(with_key(postings)).join(seen_first_dates(seen).hint("shuffle_hash"), KEY, "left")
    fs = F.col("first_seen") if "first_seen" in postings.columns else F.lit(None).cast("string")
    dp = F.col("date_posted") if "date_posted" in postings.columns else F.lit(None).cast("string")
    return keyed.withColumn(
        "first_seen",
        first_truthy(fs, "__seen_date", F.substring(F.coalesce(dp, F.lit("")), 1, 10), default=as_of_date(as_of)),
    ).drop(KEY, "__seen_date")


# ---------------------------------------------------------------- J5

def previous_by_key(prev: DataFrame, order: str = "seq") -> DataFrame:
    """J5 step 1: previous snapshot, keyless rows dropped, last row per key
    (partitioned on the key itself, so the joins on it need no new shuffle)."""
    from .dedup import first_per_key

    if "url" not in prev.columns:
        # the key is job_url itself: dedup on that column, so a snapshot bucketed on
        # job_url needs no shuffle here, and the key alias keeps the partitioning
        keyed = prev.filter(truthy("job_url").isNotNull())
        return first_per_key(keyed, ["job_url"], order, desc=True).withColumn(KEY, F.col("job_url"))
    keyed = with_key(prev).filter(F.col(KEY) != "")
    return first_per_key(keyed, [KEY], order, desc=True)


def stamp_and_retain(new: DataFrame, prev: DataFrame, seen: DataFrame, as_of, retain: bool = True,
                     retain_days: int = C.RETAIN_DAYS, prev_order: str = "seq") -> DataFrame:
    """Stamp every new row and, when ``retain``, carry forward recently seen
    previous rows that the new load lacks (flagged stale).

    * new rows (all of them, keyless and duplicates included): first_seen =
      previous first_seen (non-empty) else seen date else as_of; last_seen =
      as_of; stale cleared.
    * carried rows: previous key not among the new keys and
      first_truthy(last_seen, first_seen, seen date) >= as_of - retain_days.

    Plan: the new rows take their stamp from the previous snapshot (last row per key,
    its first_seen only) and the seen dates, two many-to-one left joins on one
    partitioning of the rows (AQE splits a hot key). The carried rows are the
    previous rows whose key the distinct new keys lack. A snapshot and seen store
    bucketed on ``job_url`` (``sources.snapshots.write_bucketed``) are read without
    any shuffle. Nothing is cached or written.
    """
    today = as_of_date(as_of)
    cutoff = F.date_format(F.date_sub(as_of_ts(as_of).cast("date"), retain_days), "yyyy-MM-dd")
    prev1 = previous_by_key(prev, prev_order)
    prev_cols = [c for c in prev1.columns if c != KEY]
    keyed_new = with_key(new)
    dates = seen_first_dates(seen)
    known = prev1.select(KEY, F.col("first_seen").alias("__first")).join(dates, KEY, "full_outer")
    stamped = (salt_empty_key(keyed_new).join(known, KEY, "left")
               .withColumn("first_seen", first_truthy("__first", "__seen_date", default=today))
               .withColumn("last_seen", today)
               .withColumn("stale", F.lit(None).cast("boolean"))
               .drop("__first", "__seen_date", KEY))
    if not retain:
        return stamped
    last = first_truthy("last_seen", "first_seen", "__seen_date", default="")
    carried = (prev1.join(keyed_new.select(KEY).distinct(), KEY, "left_anti").join(dates, KEY, "left")
               .filter((last != "") & (last >= cutoff)).select(*prev_cols).withColumn("stale", F.lit(True)))
    return stamped.unionByName(carried, allowMissingColumns=True)


# ---------------------------------------------------------------- J6

def sponsor_update(sponsors: DataFrame, companies: DataFrame, company_order: str = "ord",
                   sponsor_order: str = "ord") -> DataFrame:
    """Write each employer's careers_url into the register: only the first
    register row per kvk is touched, the last employer with that kvk wins, empty
    kvk or URL is skipped. Adds ``old_careers_url`` and ``changed``."""
    eff = dedup_last_by_key(
        companies.filter(truthy("kvk").isNotNull() & truthy("careers_url").isNotNull())
        .select("kvk", F.col("careers_url").alias("__new_url"), F.col(company_order).alias("__cord")),
        "kvk", order="__cord",
    )
    firsts = sponsors.groupBy("kvk").agg(F.min(sponsor_order).alias("__first"))
    updates = firsts.join(eff, "kvk").select(F.col("__first").alias(sponsor_order), "__new_url")
    out = sponsors.join(updates, sponsor_order, "left")
    return (
        out.withColumn("old_careers_url", F.col("careers_url"))
        .withColumn("careers_url", F.coalesce("__new_url", "careers_url"))
        .withColumn("changed", F.col("__new_url").isNotNull() & ~F.col("old_careers_url").eqNullSafe(F.col("__new_url")))
        .drop("__new_url")
    )


# ---------------------------------------------------------------- J7

def cache_age_hours(cache: DataFrame, as_of, ts: str = "cached_at") -> DataFrame:
    """age of each cache entry in hours at ``as_of`` (negative for entries after it)."""
    secs = F.unix_micros(as_of_ts(as_of)) - F.unix_micros(F.col(ts).cast("timestamp"))
    return cache.withColumn("age_hours", secs / F.lit(3_600_000_000.0))


def fresh_cache(cache: DataFrame, as_of, ttl_hours: int = C.CACHE_TTL_HOURS, ts: str = "cached_at") -> DataFrame:
    """Cache entries younger than the TTL (strict)."""
    return cache.filter(F.col(ts) > as_of_ts(as_of) - F.make_interval(hours=F.lit(ttl_hours)))


def cache_hits(companies: DataFrame, cache: DataFrame, as_of, force: bool = False,
               name: str = "ind_name", ttl_hours: int = C.CACHE_TTL_HOURS) -> DataFrame:
    """Employers whose cache entry is fresh (they reuse it)."""
    if force:
        return companies.limit(0)
    keys = fresh_cache(cache, as_of, ttl_hours).select(F.col(name).alias("__n")).distinct()
    return companies.join(keys, companies[name] == keys["__n"], "left_semi")


def cache_misses(companies: DataFrame, cache: DataFrame, as_of, force: bool = False,
                 name: str = "ind_name", ttl_hours: int = C.CACHE_TTL_HOURS) -> DataFrame:
    """Employers that must be fetched again."""
    if force:
        return companies
    keys = fresh_cache(cache, as_of, ttl_hours).select(F.col(name).alias("__n")).distinct()
    return companies.join(keys, companies[name] == keys["__n"], "left_anti")


# ---------------------------------------------------------------- J8 / J9

def partial_refresh(existing: DataFrame, fresh: DataFrame, refreshed_names: DataFrame,
                    name_col: str = "ind_name") -> DataFrame:
    """Keep existing rows of employers not refreshed, then the fresh rows."""
    names = refreshed_names.select(F.col(name_col).alias("company")).distinct()
    kept = existing.join(names, "company", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def company_order_concat(results: DataFrame, companies: DataFrame, dedup_employers: bool = True) -> DataFrame:
    """Rows re-assembled in dimension order (``ord``, then arrival ``seq``)."""
    dims = companies.select(F.col("ind_name").alias("company"), "ord")
    if dedup_employers:
        dims = dims.groupBy("company").agg(F.min("ord").alias("ord"))
    return results.join(dims, "company").orderBy("ord", "seq")


# ---------------------------------------------------------------- J10-J12

def description_cache_lookup(postings: DataFrame, cache: DataFrame, fresh: Column) -> DataFrame:
    """Description from the cache when the key has one, else the freshly
    extracted text. Adds ``from_cache``."""
    table = cache.filter(truthy("key").isNotNull()).groupBy(F.col("key").alias(KEY)).agg(
        F.max("body").alias("__cached"))
    keyed = salt_empty_key(with_key(postings)).join(table, KEY, "left")
    return (keyed.withColumn("from_cache", F.col("__cached").isNotNull())
            .withColumn("description", F.when(F.col("from_cache"), F.col("__cached")).otherwise(fresh))
            .drop(KEY, "__cached"))


def cache_entries(postings: DataFrame, body: str = "description") -> DataFrame:
    """New description-cache rows: only non-empty keys and bodies are stored."""
    keyed = with_key(postings)
    return keyed.filter((F.col(KEY) != "") & truthy(body).isNotNull()).select(
        F.col(KEY).alias("key"), F.col(body).alias("body"))


def payload_company_join(payloads: DataFrame, companies: DataFrame, name: str = "ind_name") -> DataFrame:
    """Payload ⋈ employer dimension. An employer listed twice counts once
    (J9): its first row in dimension order, where the dimension has one."""
    cols = [c for c in companies.columns if c not in (name, "source_type")]
    row = F.struct(*[F.col(c) for c in cols])
    pick = F.min_by(row, F.col("ord")) if "ord" in companies.columns else F.first(row)
    dims = companies.groupBy(F.col(name).alias("company")).agg(pick.alias("__d"))
    return payloads.join(dims.select("company", *[F.col(f"__d.{c}").alias(c) for c in cols]), "company")


def last_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per URL of a page table (W4): the page fetched last, where the
    table says when, else the greatest one (map-side combined)."""
    last = F.max_by(html, "fetched_at") if "fetched_at" in pages.columns else F.max(html)
    return pages.filter(F.col(url).isNotNull()).groupBy(url).agg(last.alias(html))


def posting_page_join(postings: DataFrame, pages: DataFrame, url: Column, page_url: str = "url") -> DataFrame:
    """Posting ⋈ page on a URL derived from the posting (left outer); of
    several landings of a URL the last one counts."""
    p = last_pages(pages, page_url).select(F.col(page_url).alias("__page_url"), F.col("html").alias("page_html"))
    return postings.withColumn("__page_url", salt_missing(url)).join(p, "__page_url", "left").drop("__page_url")


# ---------------------------------------------------------------- U1 / U2

def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Bag union of feeds with different columns."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def key_difference(prev: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of the previous snapshot that the new load lacks."""
    pk = with_key(prev).filter(F.col(KEY) != "").select(KEY).distinct()
    nk = with_key(new).select(KEY).distinct()
    return pk.join(nk, KEY, "left_anti").withColumnRenamed(KEY, "job_url")
