"""Operator 2: token ids in binary shards with Elias-Fano document boundaries.

Documents are range-partitioned by id; each task encodes its documents in id
order and streams the ids to a shard file: the concatenated id array (16 bits an
id where the vocabulary allows it), then the document boundaries and the ids of
the documents, both Elias-Fano coded with a select structure, then a fixed
footer. A reader finds any document's ids with two ``select`` calls and one
range read; the whole file is read back in blocks of documents whose boundaries two
selects find. A task holds a batch of texts and its shard's boundaries (16 bytes a
document), never the id array; a shard is closed at ``shard_tokens`` ids or
``shard_docs`` documents.

Encoding uses the tokenizers library. Texts whose white space is only single
spaces and line breaks are cut there (the pre-tokenizer always cuts there too),
and the library encodes each distinct word once per worker as long as a table
knows it: two generations of words, the older of which goes when the younger is full,
so words in use stay. Other texts are encoded whole.

Defined results: a null or empty text is one end id; documents with a null id
come first; repeated ids follow each other, ordered by a hash of their text;
empty tables give empty results and no shard. Only the named columns are read.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Window

from .common import DataFrame, F, pa, scratch_path, text_bytes, written
from .eliasfano import EliasFano
from .sharedio import reading, writing

MAGIC = b"PWTOKEF1"
_FOOT = struct.Struct("<QQQQQqBxxxxxxx8s")  # ids end, bounds end, docs end, documents, nulls, least id, id width, magic
CACHE_WORDS = 700_000  # of each generation: about 140 MB
BLOCK_DOCS = 4096
_CLOSING = string.punctuation
#: White space other than spaces and line breaks.
_ODD_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]")
_GAPS = ("  ", "\n\n", " \n", "\n ")
_CACHED_LENGTH = 64


class Encoder:
    """Token ids of texts as little-endian bytes of ``width`` each."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # words come here once, as new ones: the library's own cache of words would only cost
        self.fresh = Tokenizer.from_file(path)
        model = self.fresh.model
        model._resize_cache(0)
        self.fresh.model = model
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        # cutting at single spaces is known to be safe for this pre-tokenizer only
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                     and not pre.get("add_prefix_space") and not spec.get("normalizer"))
        self.ends: dict[str, bool] = {}  # whether a stretch ends between a character and punctuation
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens_word = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with a space
        self.opens_word[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.cache_words = cache_words
        self.spaced: dict[str, bytes] = {}  # words as ``cut`` gives them
        self.older: dict[str, bytes] = {}  # the generation before
        self.words: dict[str, bytes] = {}  # other stretches as they stand

    def _library(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in got]

    def _after_space(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space: one call for all of them, cut again
        where a token begins with a space (only the first of a word does)."""
        if not words:
            return []
        ids = np.array(self.fresh.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids)
        starts = np.flatnonzero(self.opens_word[ids])
        if starts.size != len(words) or starts[0]:
            return self._library([" " + w for w in words])
        raw, cut = ids.astype(self.kind).tobytes(), (starts * self.width).tolist() + [ids.size * self.width]
        return [raw[i:j] for i, j in zip(cut, cut[1:])]

    def cut(self, text: str) -> list[str] | None:
        """Words that are encoded independently, or None for the whole text.
        Every word stands for itself after a space, or after a line break if it
        begins with one; the first word of a text is marked by a leading tab."""
        if not text or not self.cuts or any(s in text for s in self.special):
            return None
        if any(g in text for g in _GAPS) or text[0] in " \n" or text[-1] in " \n" or _ODD_SPACE.search(text):
            return None
        return ("\t" + text).replace("\n", " \n").split(" ")

    def _ends(self, char: str) -> bool:
        """Whether closing punctuation after this character is a stretch of its own: after
        a letter or number, as the library sees them. After any other symbol (a dash, a
        quote of another script) both are one stretch."""
        ends = self.ends.get(char)
        if ends is None:
            ends = self.ends[char] = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(char + ".")) > 1
        return ends

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of words that the young table lacks."""
        got: dict[str, bytes] = {}
        older, spaced = self.older.get, self.spaced.get
        lone, split, whole = [], [], []
        heads: dict[str, bytes | None] = {}
        stretches = {"\n"}
        for w in missing:
            known = older(w)
            if known is not None:
                got[w] = known
            elif w[0] in "\t\n":  # not after a space
                lone.append(w)
                if len(w) > 1:
                    stretches.add(w[1:])
            else:
                b = w.rstrip(_CLOSING)
                if not b:
                    whole.append(w)
                elif len(b) < len(w) and self._ends(b[-1]):
                    split.append((w, b))
                    stretches.add(w[len(b):])
                    heads[b] = None
                else:
                    heads[w] = None
        for b in heads:
            heads[b] = spaced(b) or older(b)
        bases = [b for b, v in heads.items() if v is None]
        heads.update(zip(bases, self._after_space(bases)))
        if len(self.words) > self.cache_words:
            self.words = {}
        plain = list(stretches.difference(self.words))
        text = dict(zip(plain, self._library(plain)))
        self.words.update(x for x in text.items() if len(x[0]) <= _CACHED_LENGTH)
        for w in stretches.difference(text):
            text[w] = self.words[w]
        got.update(heads)
        got.update(zip(whole, self._library([" " + w for w in whole])))
        for w, b in split:
            got[w] = heads[b] + text[w[len(b):]]
        for w in lone:
            got[w] = (text["\n"] if w[0] == "\n" else b"") + (text[w[1:]] if len(w) > 1 else b"")
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(t) for t in texts]
        if len(self.spaced) >= self.cache_words:  # full: from now on the older generation
            self.older, self.spaced = self.spaced, {}
        got = self._learn(set().union(*[c for c in cuts if c is not None]).difference(self.spaced))
        self.spaced.update(got)
        ids_of, rest = self.spaced.__getitem__, iter(self._library([t for t, c in zip(texts, cuts) if c is None]))
        out = [next(rest) if c is None else b"".join(map(ids_of, c)) for c in cuts]
        for w in got:
            if len(w) > _CACHED_LENGTH:  # long words are of this batch only
                del self.spaced[w]
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class ShardWriter:
    """One shard: append documents in id order, then ``close``."""

    def __init__(self, out, width: int):
        self.out, self.width, self.nulls, self.size = out, width, 0, 0
        self.bounds, self.docs = array("Q", [0]), array("q")

    def append(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.size += len(ids)
        self.bounds.append(self.size // self.width)
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)

    def close(self) -> None:
        least = self.docs[0] if self.docs else 0
        bounds = EliasFano.build(self.bounds).to_bytes()
        # differences of 64-bit ids may need all 64 bits: unsigned arithmetic wraps to them
        docs = EliasFano.build(np.array(self.docs).astype(np.uint64) - np.array(least).astype(np.uint64)).to_bytes()
        self.out.write(bounds)
        self.out.write(docs)
        ends = (self.size, self.size + len(bounds), self.size + len(bounds) + len(docs))
        self.out.write(_FOOT.pack(*ends, len(self.bounds) - 1, self.nulls, least, self.width, MAGIC))


class ShardReader:
    """Random access to the documents of a shard file."""

    def __init__(self, path: str):
        self.file = reading(path)
        size = self.file.size()
        foot = self.file.read_at(_FOOT.size, size - _FOOT.size)
        ids, bounds, docs, self.n, self.nulls, self.least, self.width, magic = _FOOT.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        self.bounds = EliasFano.from_bytes(self.file.read_at(bounds - ids, ids))
        self.docs = EliasFano.from_bytes(self.file.read_at(docs - bounds, bounds))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.docs.get(i - self.nulls)

    def span(self, i: int) -> tuple[int, int]:
        return self.bounds.get(i), self.bounds.get(i + 1)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, start, ids) of all documents, in one pass over the file."""
        block, at = b"", 0  # a window of the id array, at byte offset `at`
        for first in range(0, self.n, BLOCK_DOCS):
            last = min(self.n, first + BLOCK_DOCS)
            bounds = self.bounds.range(first, last + 1).astype(np.int64).tolist()
            nulls = min(max(self.nulls - first, 0), last - first)
            named = self.docs.range(first + nulls - self.nulls, last - self.nulls) if first + nulls < last else ()
            docs = [None] * nulls + [self.least + int(d) for d in named]
            for doc, start, end in zip(docs, bounds, bounds[1:]):
                a, b = start * self.width, end * self.width
                if b > at + len(block):
                    block, at = self.file.read_at(max(b - a, 1 << 22), a), a
                yield doc, start, np.frombuffer(block[a - at:b - at], f"<u{self.width}")


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", shard_tokens: int = 1 << 27, shard_docs: int = 1 << 22,
                 batch_chars: int = 1 << 21) -> DataFrame:
    """Write shards under ``folder``; returns the manifest (part, seq, path,
    n_docs, n_tokens), one row per shard."""
    text = text_bytes(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    # a repeated id may hold many rows: the hash lets the range split within it
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions(
        "doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = _encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.kind).tobytes()
        done: list[tuple] = []

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                held, size, first = [], 0, 0
                for i in range(len(ids)):
                    held.append(str(texts[i].as_py(), "utf-8", "replace"))
                    size += len(held[-1])
                    if size >= batch_chars or i == len(ids) - 1:
                        yield from zip(ids[first:i + 1], enc.encode(held))
                        held, size, first = [], 0, i + 1

        stream = encoded()
        item = next(stream, None)
        while item is not None:
            path = f"{folder}/part-{part:05d}-{len(done):03d}.tok"
            with writing(path) as out:
                shard = ShardWriter(out, enc.width)
                while item is not None and shard.size < shard_tokens * enc.width and len(shard.bounds) <= shard_docs:
                    shard.append(item[0], item[1] + end)
                    item = next(stream, None)
                shard.close()
            done.append((part, len(done), path, len(shard.bounds) - 1, shard.bounds[-1]))
        cols = list(zip(*done)) if done else [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)],
                              names=["part", "seq", "path", "n_docs", "n_tokens"])

    schema = "part int, seq int, path string, n_docs long, n_tokens long"
    return written(rows.mapInArrow(write, schema), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.
    The running total is a window over one row per shard."""
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq")) - F.col("n_tokens")
    shards = manifest.withColumn("base", before).select("part", "seq", "path", "base")
    shards = shards.repartitionByRange(max(1, min(manifest.count(), 20_000)), "part", "seq")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                out: list[tuple] = []
                for doc, start, ids in ShardReader(path).documents():
                    out.append((doc, base + start, ids.size, zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [()] * 4
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize_documents(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None,
                       end_id: int = 2, **options) -> DataFrame:
    """Write all documents to shards and read them back."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, tokenizer or default_tokenizer(), folder, end_id, **options))
