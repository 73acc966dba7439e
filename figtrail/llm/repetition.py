"""Quality rules from repetition: how much of a text stands inside repeated word windows and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figtrail.llm.common import as_bytes

#: Most percent of a text's word characters that may stand in windows of so many words that occurred before in it.
MOST_IN_WINDOWS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Most percent of word characters in lines that occurred before.
MOST_IN_LINES = 20
#: A text with more of these than a tenth of its words is rejected.
SYMBOLS = b"#*$%&|<>"
#: Bytes of text that are looked at together; a longer text is looked at alone, its words slice by slice.
CHUNK = 500_000
ODD = 0x9E3779B97F4A7C15

_LETTER = np.random.default_rng(0).integers(1, 1 << 64, 256, np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """ODD**i and its inverse modulo 2**64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, ODD, np.uint64), np.full(n, pow(ODD, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _slices(data: bytes) -> Iterator[tuple[int, int]]:
    """Cuts at blanks, so that no word is cut."""
    lo = 0
    while lo < len(data):
        hi = min(lo + CHUNK, len(data))
        while hi < len(data) and not _BLANK[data[hi]]:
            hi += 1
        yield lo, hi
        lo = hi


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of some bytes: their starts, code points and 64-bit hashes. One running sum of letter values times
    powers of ODD gives every word's hash as a difference, brought back to the word's own start by the inverse power."""
    starts, chars, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in _slices(data):
        b = np.frombuffer(data, np.uint8, hi - lo, lo)
        up, down = _powers(len(b))
        blank = _BLANK[b]
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1))
        first, last = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[b] * up)])
        h = (total[last] - total[first]) * down[first % len(b)]
        h ^= h >> np.uint64(32)
        hashes.append(h * np.uint64(0xD6E8FEB86659FD93))
        leads = np.concatenate([np.zeros(1, np.int64), np.cumsum((b & 0xC0) != 0x80)])
        chars.append(leads[last] - leads[first])
        starts.append(first + lo)
    return np.concatenate(starts), np.concatenate(chars), np.concatenate(hashes)


def _later(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys: which have an equal at all, and which have one before them."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    some, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    before[order[1:][same]] = True
    return some, before


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words stand in a window of n words from one of the starts."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def window_coverage(hashes: np.ndarray, of: np.ndarray, lengths: tuple[int, ...] = tuple(MOST_IN_WINDOWS)) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """For words with their hashes and the number of their text (ascending): which stand in a window of the shortest
    length that its text holds twice or more, and for each length which stand in a window that came before in its text.

    The hash of n words is rolled on from that of n - 1: h * ODD + next word, modulo 2**64. The number of the text is
    mixed in, so texts do not meet. A window can only repeat where its shorter start does, so longer ones are hashed
    there alone."""
    size, first = len(hashes), min(lengths)
    odd = np.uint64(ODD)
    rolled, at = hashes ^ ((of.astype(np.uint64) + np.uint64(1)) * odd), np.arange(size)
    covered, repeated = {}, np.zeros(size, bool)
    for n in range(2, max(lengths) + 1):
        whole = at + n - 1 < size
        at, rolled = at[whole], rolled[whole]
        inside = of[at + n - 1] == of[at]
        at = at[inside]
        rolled = rolled[inside] * odd + hashes[at + n - 1]
        if n < first:
            continue
        some, before = _later(rolled)
        if n == first:
            repeated = _covered(at[some], n, size)
        if n in lengths:
            covered[n] = _covered(at[before], n, size)
        at, rolled = at[some], rolled[some]
    return repeated, covered


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that are equal to an earlier line, and the code points of their words."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0, 0
    seen, count, chars = set(), 0, 0
    for line in lines:
        if line in seen:
            if words := line.split():
                count += 1
                chars += len(b"".join(words).decode("utf-8", "replace"))
        else:
            seen.add(line)
    return count, chars


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of repetition_quality for some texts, which are looked at together."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts, chars, hashes = words_of(b"\n".join(texts))
    of = np.searchsorted(np.cumsum(sizes + 1), starts, "right")
    counts = np.bincount(of, minlength=len(texts)).astype(np.int64)
    repeated, covered = window_coverage(hashes, of)
    per_text = lambda values: np.bincount(of, values, len(texts)).astype(np.int64)
    lines = np.array([repeated_lines(t) for t in texts], np.int64).reshape(-1, 2)
    out = {"n_words": counts, "word_chars": per_text(chars), "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64), "n_dup_lines": lines[:, 0], "n_repeat_words": per_text(repeated)}
    out["dup_line_chars"] = lines[:, 1]
    for n, inside in covered.items():
        out[f"dup_chars_{n}"] = per_text(chars * inside)
    out["base_failed"] = (counts < 10) | (100 * out["n_repeat_words"] > 20 * counts)
    over = 10 * out["n_symbols"] > counts
    over |= 100 * out["dup_line_chars"] > MOST_IN_LINES * out["word_chars"]
    for n, most in MOST_IN_WINDOWS.items():
        over |= 100 * out[f"dup_chars_{n}"] > most * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ~over
    return out


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in MOST_IN_WINDOWS))
SCHEMA = f"doc_id long, {', '.join(f'{c} long' for c in LONGS)}, base_failed boolean, kept boolean"


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts of LONGS, base_failed and kept.

    dup_chars_n counts the characters of words inside an n-word window that occurred before in the text, dup_line_chars
    those in lines that did. A text is kept when it has 10 words or more, at most 20 % of them in 5-word windows that
    occur twice or more, one symbol to ten words at most, and no more characters in repeated windows and lines than
    MOST_IN_WINDOWS and MOST_IN_LINES say.

    Whole texts are read row by row without a shuffle; a task holds one Arrow batch and the arrays of one chunk. A null
    text has no words and is rejected, as an empty one is; null and repeated ids are kept as they are; other columns are
    ignored; an empty table gives an empty result. Words and windows are compared by 64-bit hashes."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            for lo, hi in _chunks(texts):
                found = measures(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(found[c], pa.int64()) for c in LONGS], *[pa.array(found[c], pa.bool_()) for c in ("base_failed", "kept")]],
                                                 names=["doc_id", *LONGS, "base_failed", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(judge, SCHEMA)
