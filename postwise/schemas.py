"""Explicit schemas (no inference at read time)."""

from __future__ import annotations

from pyspark.sql.types import (BooleanType, IntegerType, LongType, MapType, StringType, StructField,
                               StructType, TimestampType)

POSTING = StructType([
    StructField("company", StringType()),
    StructField("job_title", StringType()),
    StructField("location", StringType()),
    StructField("careers_url", StringType()),
    StructField("job_url", StringType()),
    StructField("visa_support", BooleanType()),
    StructField("relocation_support", BooleanType()),
    StructField("date_posted", StringType()),
    StructField("recruiter_email", StringType()),
    StructField("description", StringType()),
    StructField("notes", StringType()),
    StructField("first_seen", StringType()),
    StructField("last_seen", StringType()),
    StructField("stale", BooleanType()),
    StructField("ai_score", IntegerType()),
])

POSTING_FIELDS = [f.name for f in POSTING.fields]
BASE_POSTING_FIELDS = POSTING_FIELDS[:11]

POSTING_SEQ = StructType([StructField("seq", LongType())] + POSTING.fields)

SEEN = StructType([StructField("job_url", StringType()), StructField("seen_at", TimestampType())])
SCORE = StructType([StructField("job_url", StringType()), StructField("score", IntegerType())])
DESCRIPTION_CACHE = StructType([StructField("key", StringType()), StructField("body", StringType())])

COMPANY = StructType([
    StructField("ord", LongType()),
    StructField("ind_name", StringType()),
    StructField("kvk", StringType()),
    StructField("source_type", StringType()),
    StructField("careers_url", StringType()),
    StructField("params", MapType(StringType(), StringType())),
])

RAW_PAYLOAD = StructType([
    StructField("company", StringType()),
    StructField("source_type", StringType()),
    StructField("term", StringType()),
    StructField("page", IntegerType()),
    StructField("url", StringType()),
    StructField("status", IntegerType()),
    StructField("fetched_at", TimestampType()),
    StructField("body", StringType()),
])

KV_MAP = MapType(StringType(), StringType())
