"""Measurements of one text, taken in a single pass over its bytes.

``measure`` is exact for texts of any length: byte classes are counted in
slices, word windows through per-text word numbers. All counts are plain
integers, so rules and features built on them agree on every engine.
"""

from __future__ import annotations

import numpy as np

#: Names of the measurements, in the order ``measure`` returns them.
NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
         "n_upper", "n_lower", "n_digits", "n_bangs", "n_punct", "n_distinct_words", "n_adjacent_same")

_SLICE = 1 << 20
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_PUNCT = np.frombuffer(b".,;:?", np.uint8)


def byte_counts(text: bytes) -> np.ndarray:
    arr = np.frombuffer(text, np.uint8)
    total = np.zeros(256, np.int64)
    for i in range(0, arr.size, _SLICE):
        total += np.bincount(arr[i:i + _SLICE], minlength=256)
    return total


def repeated_positions(ids: np.ndarray, distinct: int) -> int:
    """How many words lie in a 3-word window that occurs twice or more."""
    n = ids.size
    if n < 4:
        return 0
    if distinct < 1 << 21:
        code = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:  # number the pairs first, so that the code stays within 64 bits
        pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        code = pair * distinct + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    starts = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements named in ``NAMES``; all zero for an empty text."""
    words = text.split()  # bytes.split cuts at exactly space and \t \n \v \f \r
    n = len(words)
    if not n:
        return (0,) * len(NAMES)
    count = byte_counts(text)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    spaces = int(count[32] + count[9:14].sum())
    return (
        n,
        len(text) - spaces - int(count[0x80:0xC0].sum()),  # bytes that do not continue a character
        int(count[_SYMBOLS].sum()),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_positions(ids, len(seen)),
        int(count[65:91].sum()),
        int(count[97:123].sum()),
        int(count[48:58].sum()),
        int(count[33]),
        int(count[_PUNCT].sum()),
        len(seen),
        int((ids[1:] == ids[:-1]).sum()),
    )
