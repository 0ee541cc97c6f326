"""Operator 4: language identification by compression.

Every language gets a Zstandard raw-content dictionary made of sample text. A
text is compressed once per language; the dictionary that gives the smallest
frame names the language (ties: the smaller name). The confidence falls with
the margin to the other sizes, and a narrow margin rejects the answer.

The dictionaries come from a bounded sample: ``sample_docs`` distinct texts per
language in hash order, so every run takes the same ones, and copies count once.
Of each, up to ``sample_chars`` characters are read, in ``pieces`` from seeded
places over the whole text; the texts share ``dict_bytes`` evenly, so of 400 long
texts some 327 bytes each are used. Texts to be classified are compressed whole.
What the driver and each task hold is the dictionaries: ``dict_bytes`` per
language.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
null languages never train; without any training text all rows are ``und``;
repeated rows are classified each; empty tables give empty results. Only the
named columns are read; language, source and id never enter a prediction.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import zstandard
from pyspark.sql import Window
from pyspark.sql.functions import arrow_udf

from .common import Column, DataFrame, F, held_out, pa, text_bytes

UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased runs of letters; empty if the text has none."""
    found = " ".join(_LETTERS.findall(text.lower()))
    return found.encode("utf-8", "replace") if any(map(str.isalpha, found)) else b""


class Classifier:
    def __init__(self, samples: dict[str, bytes], level: int = 6):
        params = zstandard.ZstdCompressionParameters.from_level(
            level, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.compressors = []
        for name in sorted(samples):
            content = zstandard.ZstdCompressionDict(samples[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            self.compressors.append((name, zstandard.ZstdCompressor(dict_data=content, compression_params=params)))

    def classify(self, text: str, min_margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        data = letters(text)
        if not data or not self.compressors:
            return UNDETERMINED, 0.0, True
        sizes = [(len(c.compress(data)), name) for name, c in self.compressors]
        size, best = min(sizes)
        score = 1 / sum(math.exp((size - s) / 2) for s, _ in sizes)
        second = min((s for s, name in sizes if name != best), default=size + len(data))
        return best, round(score, 6), (second - size) < min_margin * size


def _pieces(text: Column, h: Column, chars: int, pieces: int) -> Column:
    """``pieces`` stretches of a text, one at a seeded place of each equal part;
    a text of up to ``chars`` characters as a whole."""
    each = max(1, chars // pieces)
    part = F.floor(F.length(text) / pieces).cast("int")
    starts = [part * j + F.pmod(F.xxhash64(h, F.lit(j)), part - each + 1).cast("int") for j in range(pieces)]
    cut = F.array(*[text.substr(at + 1, F.lit(each)) for at in starts])
    return F.when((F.length(text) > chars) & (part >= each), cut).otherwise(F.array(F.substring(text, 1, chars)))


def _evenly(docs: list[list[bytes]], dict_bytes: int) -> bytes:
    """All documents' pieces in ``dict_bytes``: what short ones leave of their
    equal share goes to the others; a document's share likewise to its pieces."""

    def shares(sizes: list[int], total: int) -> list[int]:
        out, left = [0] * len(sizes), total
        for k, i in enumerate(sorted(range(len(sizes)), key=lambda i: (sizes[i], i))):
            out[i] = min(sizes[i], left // (len(sizes) - k))
            left -= out[i]
        return out

    given = shares([sum(len(p) + 1 for p in d) for d in docs], dict_bytes)
    cut = [p[:max(0, n - 1)] for d, share in zip(docs, given) for p, n in zip(d, shares([len(p) + 1 for p in d], share))]
    return b" ".join(p for p in cut if p)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           sample_docs: int = 400, sample_chars: int = 600, dict_bytes: int = 131072, pieces: int = 4) -> dict[str, bytes]:
    """Language to dictionary content, from the documents outside the held-out part."""
    ident, lang = F.col(f"`{id_col}`"), F.col(f"`{lang_col}`").cast("string")
    known = docs.filter(lang.isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~held_out(ident))
    known = known.select(lang.alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = known.filter(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # texts do not move: distinct hashes are chosen first, at most sample_docs a language
    chosen = known.select("lang", "h").distinct().withColumn("n", place).filter(F.col("n") <= sample_docs)
    rows = known.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).select(
        "lang", "h", _pieces(F.col("text"), F.col("h"), sample_chars, pieces).alias("pieces"))
    parts: dict[str, list[list[bytes]]] = {}
    for r in sorted(rows.distinct().collect(), key=lambda r: (r["lang"], r["h"])):
        parts.setdefault(r["lang"], []).append([x for x in map(letters, r["pieces"]) if x])
    joined = {name: _evenly([d for d in p if d], dict_bytes) for name, p in parts.items()}
    return {name: data for name, data in joined.items() if len(data) >= 8}


def language(text: Column | str, samples: dict[str, bytes], min_margin: float = 0.01, level: int = 6) -> Column:
    """struct(lang, score, rejected) of a text column."""

    @arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(samples, level)
        for texts in batches:
            rows = [model.classify(str(t or b"", "utf-8", "replace"), min_margin) for t in texts.to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * 3
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["lang", "score", "rejected"])

    return identify(text_bytes(text))


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       min_margin: float = 0.01, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row. ``rejected``
    marks narrow margins; ``lang_pred`` stays the best language."""
    samples = sample(docs, id_col, text_col, lang_col, **options)
    ident = F.col(f"`{id_col}`")
    got = docs.select(ident.alias("doc_id"), held_out(ident).alias("held_out"),
                      language(F.col(f"`{text_col}`"), samples, min_margin).alias("r"))
    return got.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score", "r.rejected")
