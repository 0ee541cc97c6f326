"""Operator 6: quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one failure bit per rule; a policy is a versioned mask over these bits, so new
policies, comparisons and ablations never touch the texts again.

Defined results: a null or empty text has no words, all measurements 0, and fails
``few_words``; null ids are kept as they are; repeated rows each get their own
ledger row; an empty table gives an empty ledger. Only the named columns are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import Column, DataFrame, F, pa, text_bytes
from .stats import NAMES, measure

_STRUCT = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])


@arrow_udf(_STRUCT)
def _measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = [measure(t or b"") for t in texts.to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * len(NAMES)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(NAMES))


def measurements(text: Column | str) -> Column:
    """All measurements of a text as one struct column (one Python pass)."""
    return _measured(text_bytes(text))


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements."""
    name: str
    fails: str


#: The bit of a rule is its place in this list; append only, never reorder.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("shouting", "n_upper > n_lower AND n_upper > 20"),
    Rule("exclamations", "5 * n_bangs > n_words"),
    Rule("repeated_words_mild", "100 * n_repeat_words > 30 * n_words"),
    Rule("single_word_runs", "5 * n_adjacent_same > n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A document is rejected when it fails any rule of the policy."""
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(n) for n in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", BASE.rules + ("symbols", "duplicate_lines", "word_length")),
    Policy("v2", BASE.rules + ("symbols", "duplicate_lines", "word_length", "shouting", "exclamations",
                               "single_word_runs")),
)}
PRODUCTION = POLICIES["v2"]


def failure_bits(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """One long with the bit of every failed rule, from measurement columns."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        cond = rule.fails
        if prefix:
            for n in sorted(NAMES, key=len, reverse=True):
                cond = _qualify(cond, n, prefix)
        bits = bits + F.when(F.expr(cond), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def _qualify(cond: str, name: str, prefix: str) -> str:
    import re

    return re.sub(rf"(?<![\w.]){name}\b", f"{prefix}.{name}", cond)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, measurements..., fail_bits): the rules evaluated once."""
    m = docs.select(F.col(id_col), measurements(F.col(text_col)).alias("__m"))
    flat = m.select(F.col(id_col), *[F.col(f"__m.{n}").alias(n) for n in NAMES])
    return flat.withColumn("fail_bits", failure_bits(rules))


def passes(policy: Policy, bits: Column | str = "fail_bits", rules: tuple[Rule, ...] = RULES) -> Column:
    col = F.col(bits) if isinstance(bits, str) else bits
    return col.bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def apply_policy(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return led.withColumn("kept", passes(policy, "fail_bits", rules))


def ablations(led: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (kept if
    the rule were dropped), and the policy's rejections.

    The ledger is first reduced to one row per bit pattern (map-side combined),
    then every rule is counted on the patterns, of which there are at most
    2^rules whatever the number of documents."""
    mask = policy.mask(rules)
    masked = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    patterns = led.groupBy(masked.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [(k, r.name) for k, r in enumerate(rules) if mask >> k & 1]
    rule_rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << k).cast("long").alias("bit"))
                                    for k, n in chosen])).alias("r")
    x = patterns.select("bits", "n", rule_rows)
    bit = F.col("r.bit")
    hit = F.col("bits").bitwiseAND(bit) != 0
    return x.groupBy(F.col("r.rule").alias("rule"), bit.alias("bit")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"))


def filter_documents(docs: DataFrame, policy: Policy = PRODUCTION, text_col: str = "text",
                     rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass a policy, with all their columns."""
    cols = docs.columns
    tmp = "__measured"
    while tmp in cols:
        tmp += "_"
    x = docs.withColumn(tmp, measurements(F.col(text_col)))
    bits = failure_bits(rules, prefix=f"`{tmp}`")
    return x.filter(passes(policy, bits, rules)).select(*[F.col(f"`{c}`") for c in cols])
