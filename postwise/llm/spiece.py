"""Operator 5: SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces runs once over a stretch of text; at
every position its output links name all pieces that end there, and each of them
relaxes the best segmentation of the prefix (a single-pass Viterbi).

What "best" means follows the model. A unigram model adds piece scores. A BPE
model's scores are merge ranks, whose sum is not what its encoder maximises:
there, a piece may follow the last piece of a prefix only if merging the two
texts by rank gives back exactly these two pieces. Exactly one segmentation
satisfies this at every position, and it is the encoder's own, so relaxation
accepts the piece that passes this test (score 0) and rejects the others.

Pieces never reach across the space before a word or across a line break, so
text is cut there and the segmentation of a word is kept in a bounded per-worker
table. Memory per worker: the model, that table, one batch of texts.

Defined results: a null or empty text has no ids; characters without a piece
become byte pieces (or the unknown id, if the model has none); U+2581 counts as
a space, as in the original library, so only texts with that character do not
come back exactly; repeated rows are encoded each; empty tables give empty
results. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
from pyspark.sql.functions import arrow_udf

from .common import Column, DataFrame, F, pa, text_bytes

SPACE_MARK = "▁"
_UNK_PENALTY = 10.0
CACHE_WORDS = 500_000  # per table; about 200 bytes a word
_CACHED_LENGTH = 64


class Encoder:
    """Segmentation of texts with one model (``.model`` file contents)."""

    def __init__(self, model: bytes, cache_words: int = CACHE_WORDS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = _specs(model)
        if spec["charsmap"]:
            raise ValueError("models with a character map are not supported")
        self.is_bpe = spec["model_type"] == 2
        self.dummy_prefix, self.squeeze = spec["dummy_prefix"], spec["squeeze"]
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unk = sp.unk_id()
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.low = min(self.score.values(), default=0.0) - _UNK_PENALTY
        self._pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if not self.is_bpe or len(p) == 1 or self.merge(p) == [p]:  # others can never result
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.single = {p for p in self.score if len(p) == 1}
        self.by_id = ahocorasick.Automaton()  # the same pieces, by number
        for p in self.automaton.keys():
            self.by_id.add_word(p, (self.id_of[p], len(p)))
        self.by_id.make_automaton()
        self.fit_ids: dict[int, bool] = {}
        self.cuts_words = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.score)
        self.cuts_lines = not any("\n" in p for p in self.score if len(p) > 1)
        self.cache_words = cache_words
        self.words: dict[str, bytes] = {}  # stretches as they stand
        self.spaced: dict[str, bytes] = {}  # words after one space, without its mark

    # -- segmentation of one stretch

    def merge(self, s: str) -> list[str]:
        """Merging by rank, step by step: the highest score first, then leftmost. Pairs
        wait in a heap and parts form a chain, so a long run costs n log n."""
        n = len(s)
        parts: list[str | None] = list(s)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        score = self.score.get
        heap = [(-got, i, 2) for i in range(n - 1) if (got := score(s[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = right[i] if parts[i] is not None else n
            # stale: one of the two has been merged since
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n:
                    pair = parts[k] + parts[right[k]]
                    got = score(pair)
                    if got is not None:
                        heappush(heap, (-got, k, len(pair)))
        return [p for p in parts if p is not None]

    def _fits(self, a: str, b: str) -> bool:
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            got = self._pairs[a, b] = self.merge(a + b) == [a, b]
        return got

    def segment(self, s: str) -> list[str]:
        """The best segmentation of a stretch, in one pass of the automaton."""
        n = len(s)
        last: list[str | None] = [None] * (n + 1)  # last piece of the best segmentation of each prefix
        if self.is_bpe:
            if SPACE_MARK * 2 in s:  # runs of spaces share one rank, so order decides
                return self.merge(s)
            pairs, fits = self._pairs.get, self._fits
            for end, p in self.automaton.iter(s):  # longest first at each position
                if last[end + 1] is None:
                    start = end + 1 - len(p)
                    if start == 0:
                        last[end + 1] = p
                    else:
                        before = last[start]
                        if before is None:
                            before = self._fill(last, s, start)
                        got = pairs((before, p))
                        if got if got is not None else fits(before, p):
                            last[end + 1] = p
            if last[n] is None:
                self._fill(last, s, n)
        else:
            best = [0.0] + [float("-inf")] * n
            at = 0
            found: dict[int, list[str]] = {}
            for end, p in self.automaton.iter(s):
                found.setdefault(end, []).append(p)
            for at in range(n):
                for p in found.get(at, ()):
                    got = best[at + 1 - len(p)] + self.score[p]
                    if got > best[at + 1]:
                        best[at + 1], last[at + 1] = got, p
                if s[at] not in self.score and best[at] + self.low > best[at + 1]:
                    best[at + 1], last[at + 1] = best[at] + self.low, s[at]
        out, i = [], n
        while i:
            p = last[i] or s[i - 1]
            out.append(p)
            i -= len(p)
        return out[::-1]

    def _fill(self, last: list, s: str, upto: int) -> str:
        """A prefix that no piece ends at ends in a character without a piece."""
        last[upto] = s[upto - 1]
        return last[upto]

    def _fit_ids(self, a: int, b: int) -> bool:
        if len(self.fit_ids) > 1_000_000:
            self.fit_ids.clear()
        got = self.fit_ids[a * 1_000_003 + b] = self.merge(self.pieces[a] + self.pieces[b]) == [
            self.pieces[a], self.pieces[b]]
        return got

    def _known_bpe(self, s: str) -> bytes:
        """``segment`` for a stretch whose characters all are pieces, on numbers."""
        n = len(s)
        last, size = [-1] * n, [0] * n  # number and length of the last piece of each prefix
        known, fits = self.fit_ids.get, self._fit_ids
        for end, (i, k) in self.by_id.iter(s):
            if last[end] < 0:
                if k > end:
                    last[end], size[end] = i, k
                else:
                    a = last[end - k]
                    got = known(a * 1_000_003 + i)
                    if got or (got is None and fits(a, i)):
                        last[end], size[end] = i, k
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return array("I", out).tobytes()

    def _ids(self, s: str) -> bytes:
        if self.is_bpe and SPACE_MARK * 2 not in s and self.single.issuperset(s):
            return self._known_bpe(s)
        out: list[int] = []
        for p in self.segment(s):
            i = self.id_of.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return array("I", out).tobytes()

    def _after_space(self, s: str) -> bytes:
        got = self._ids(SPACE_MARK + s)
        if len(s) <= _CACHED_LENGTH and len(self.spaced) < self.cache_words:
            self.spaced[s] = got
        return got

    def _word(self, s: str) -> bytes:
        got = self._ids(s)
        if len(s) <= _CACHED_LENGTH and len(self.words) < self.cache_words // 5:
            self.words[s] = got
        return got

    # -- whole texts

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        text = text.replace(SPACE_MARK, " ")
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return b""
        if not (self.cuts_words and self.cuts_lines):
            s = (" " if self.dummy_prefix else "") + text
            return self._ids(s.replace(" ", SPACE_MARK))
        get, word, spaced, after, out = self.words.get, self._word, self.spaced.get, self._after_space, []
        newline = get("\n") or word("\n")
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(newline)
            parts = line.split(" ")
            if k or not self.dummy_prefix:  # no space before the first word
                first, parts = parts[0], parts[1:]
                if first:
                    out.append(get(first) or word(first))
            if "" in parts:
                lead = 0
                for p in parts:
                    lead += 1
                    if p:
                        s = SPACE_MARK * lead + p
                        out.append(get(s) or word(s))
                        lead = 0
                if lead:
                    s = SPACE_MARK * lead
                    out.append(get(s) or word(s))
            else:
                out += [spaced(p) or after(p) for p in parts]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        out: list[bytes] = []
        table = self._table
        for i in ids:
            out.append(table[i])
        text = b"".join(out).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text

    @property
    def _table(self) -> list[bytes]:
        got = self.__dict__.get("table")
        if got is None:
            got = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent
                   else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(self.pieces)]
            got[self.unk] = " ⁇ ".encode()
            self.table = got
        return got


def _specs(model: bytes) -> dict:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(model)
    return {"model_type": m.trainer_spec.model_type, "charsmap": bool(m.normalizer_spec.precompiled_charsmap),
            "dummy_prefix": m.normalizer_spec.add_dummy_prefix,
            "squeeze": m.normalizer_spec.remove_extra_whitespaces}


_ENCODERS: dict[int, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    key = zlib.crc32(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode(text: Column | str, model: bytes) -> Column:
    """Text column to array<int> of piece ids; the model file travels with the function."""

    @arrow_udf("array<int>")
    def piece_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoder(model)
        for texts in batches:
            got = [enc.encode_bytes(str(t or b"", "utf-8", "replace")) for t in texts.to_pylist()]
            offsets = np.cumsum([0] + [len(g) // 4 for g in got]).astype(np.int32)
            flat = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return piece_ids(text_bytes(text))


def decode(ids: Column | str, model: bytes) -> Column:
    """array<int> of piece ids to text (null: null)."""

    @arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoder(model)
        for rows in batches:
            yield pa.array([None if r is None else enc.decode(r) for r in rows.to_pylist()], pa.string())

    return text_of(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(text: Column | str, model: bytes) -> Column:
    """struct(n_tokens, ids_crc32, n_chars, same): a text encoded and decoded again."""

    @arrow_udf("struct<n_tokens: bigint, ids_crc32: bigint, n_chars: bigint, same: boolean>")
    def there_and_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoder(model)
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                s = str(t or b"", "utf-8", "replace")
                ids = enc.encode_bytes(s)
                back = enc.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, zlib.crc32(ids), len(back), back == s))
            cols = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["n_tokens", "ids_crc32", "n_chars", "same"])

    return there_and_back(text_bytes(text))


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row."""
    got = docs.select(F.col(f"`{id_col}`").alias("doc_id"), encode(F.col(f"`{text_col}`"), model).alias("ids"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
