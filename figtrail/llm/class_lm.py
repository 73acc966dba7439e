"""A class-based bigram model: exchange clustering of words, class transitions and word emissions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figtrail.llm.common import as_bytes, part_of, stored

#: Words of high count that every scoring task holds; the counts of all other words are joined.
HEAD = 1 << 18
#: Words of highest count that the exchange moves in several rounds; all others are moved once, by what stands beside them.
MOVED = 1 << 13
CLASSES, SPELLINGS, ROUNDS = 64, 16, 8
END_CLASS, FIRST_SPELLING, ALL = 0, CLASSES + 1, 1 + CLASSES + SPELLINGS
PRIOR = 20.0
FLUSH_WORDS, FLUSH_TOKENS = 200_000, 2_000_000
#: A word moves in a trial by how often its checksum can be halved: all words, then a half, a quarter, an eighth.
TRIALS = 4
#: What a word has to gain by its move, in nats: what it costs to name one class of all.
GAIN = float(np.log(CLASSES + 1))
#: What stands beside a word: the class before it, the class behind it, or the word itself behind it.
BESIDE, ITSELF = 2 * ALL + 1, 2 * ALL
CHUNK_BYTES, CHUNK_WORDS = 1 << 20, 500


def tokens(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at blanks and U+0009 to U+000D; the end of the text is a token of its own behind them."""
    return text.lower().split()


def spelling(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SPELLINGS


def code_of(old: np.ndarray | int, new: np.ndarray | int, level: np.ndarray | int) -> np.ndarray | int:
    """A word's class before and after its move, and in how many trials more it moves, in 16 bits."""
    return (level * ALL + new) * ALL + old


def classes_in(trial: int) -> np.ndarray:
    """The class of each code where the words of that level and above have moved; TRIALS: none has."""
    code = np.arange(TRIALS * ALL * ALL)
    return np.where(code // ALL // ALL >= trial, code // ALL % ALL, code % ALL)


def level_of(word: bytes) -> int:
    x = zlib.crc32(word) | 1 << (TRIALS - 1)
    return (x & -x).bit_length() - 1


@dataclass
class Words:
    """What tasks hold of the words: the most frequent ones and the codes of unknown words, by spelling."""

    words: list[bytes]
    count: np.ndarray
    code: np.ndarray


@dataclass
class Model:
    """What scoring needs, all of it bounded by HEAD and ALL."""

    held: Words
    class_of: np.ndarray
    tokens: int
    types: int
    ends: int
    log_move: np.ndarray
    log_mass: np.ndarray


class _Index(dict):
    """Places of known words; any other word gets the place of its spelling behind them, and is not kept."""

    def __init__(self, words: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(words))
        self.known = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.known + spelling(word)


_open: list = [None, None]


def _index(words: list[bytes]) -> _Index:
    """The index of a broadcast list, built once per worker; the list is held, so that it cannot be mistaken for another."""
    if _open[0] is not words:
        _open[:] = [words, _Index(words)]
    return _open[1]


def _training(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(part_of(F.col(id_col), 5) != 1).select(F.col(text_col).alias("_text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; counts are added up in the task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for text in as_bytes(b.column(0)):
                seen.update(tokens(text))
                if len(seen) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _level(c: str) -> Column:
    return F.floor(F.log2(c) * 16).cast("int")


def _head(vocabulary: DataFrame, most: int) -> tuple[int, list[tuple[bytes, int]]]:
    """The words at or above the lowest level of counts that keeps them within `most`, sorted by count."""
    levels = sorted(vocabulary.groupBy(_level("c").alias("level")).count().collect(), reverse=True)
    least, n = 1 << 30, 0
    for r in levels:
        n += r["count"]
        if n > most:
            break
        least = r["level"]
    got = vocabulary.where(_level("c") >= least).toArrow()
    return least, sorted(zip(got["word"].to_pylist(), got["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def count_pairs(texts: DataFrame, moved: list[bytes]) -> DataFrame:
    """(pair, n): neighbouring codes, prev * codes + cur. A code is a moved word's place, behind them the 16 spellings of
    other words, and last the end, which also stands before the first word."""
    codes, shared = len(moved) + SPELLINGS + 1, texts.sparkSession.sparkContext.broadcast(moved)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, n = _index(shared.value), [], 0

        def flush() -> pa.RecordBatch:
            pair, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(times, pa.int64())], names=["pair", "n"])

        for b in batches:
            for text in as_bytes(b.column(0)):
                at = np.fromiter(map(index.__getitem__, tokens(text)), np.int64)
                at = np.concatenate([[codes - 1], at, [codes - 1]])
                held.append(at[:-1] * codes + at[1:])
                n += len(at)
                if n > FLUSH_TOKENS:
                    yield flush()
                    n = 0
        yield flush()

    return texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(m: np.ndarray) -> float:
    """The part of the training log-likelihood that depends on the classes."""
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())


def best_class(m: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, twice: float) -> int:
    """The exchange class that a word is best moved to, its own where no other is better. left and right: counts of the
    classes before and after it without itself, twice: how often it follows itself."""
    m = m.copy()
    m[:, own] -= left
    m[own, :] -= right
    m[own, own] -= twice
    rows, cols, size_l, size_r = m.sum(1), m.sum(0), left.sum() + twice, right.sum() + twice
    to = np.arange(1, CLASSES + 1)
    l_at, r_at = np.flatnonzero(left), np.flatnonzero(right)
    column, row = m[np.ix_(l_at, to)], m[np.ix_(to, r_at)]
    gain = (_f(column + left[l_at][:, None]) - _f(column)).sum(0) + (_f(row + right[r_at][None, :]) - _f(row)).sum(1)
    # the target's own cell gets both sides at once
    diag = m[to, to]
    gain += _f(diag + left[to] + right[to] + twice) - _f(diag) - (_f(diag + left[to]) - _f(diag)) - (_f(diag + right[to]) - _f(diag))
    gain -= _f(rows[to] + size_r) - _f(rows[to]) + _f(cols[to] + size_l) - _f(cols[to])
    best = int(gain.argmax())
    return int(to[best]) if gain[best] > gain[own - 1] + 1e-6 else own


def cluster(pairs: DataFrame, moved: list[bytes], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Exchange clustering. Every word's neighbour counts stand in one row (at most two entries per code). In a round each
    task goes through a share of its words, moves each to its best class and carries the move into its own copy of the
    class matrix; then the matrix is added up anew. Tasks do not see each other's moves, so a round can lower the
    likelihood: it is then taken back, and the next one moves half as many words. The driver holds the classes and the
    class matrix. Returns the class of each code and the matrix of class transitions."""
    spark, n = pairs.sparkSession, len(moved)
    codes = n + SPELLINGS + 1
    both = pairs.select(F.expr(f"pair div {codes}").cast("int").alias("prev"), (F.col("pair") % codes).cast("int").alias("cur"), "n")
    sides = both.where(f"prev < {n}").select(F.col("prev").alias("word"), F.struct(F.lit(1).alias("side"), F.col("cur").alias("code"), "n").alias("x")).unionByName(
        both.where(f"cur < {n}").select(F.col("cur").alias("word"), F.struct(F.lit(0).alias("side"), F.col("prev").alias("code"), "n").alias("x")))
    rows = stored(sides.groupBy("word").agg(F.collect_list("x").alias("x")).select("word", F.col("x.side").alias("side"), F.col("x.code").alias("code"), F.col("x.n").alias("n")), "lm-neighbours")
    cls = np.array([1 + zlib.crc32(w[-2:]) % CLASSES for w in moved] + [FIRST_SPELLING + i for i in range(SPELLINGS)] + [END_CLASS])
    fixed = np.zeros((ALL, ALL))
    for r in both.where(f"prev >= {n} AND cur >= {n}").collect():  # (SPELLINGS + 1)^2 rows at most
        fixed[cls[r["prev"]], cls[r["cur"]]] += r["n"]

    def neighbours(b: pa.RecordBatch):
        for w, side, code, k in zip(b.column("word").to_pylist(), b.column("side"), b.column("code"), b.column("n"), strict=True):
            yield w, np.asarray(side.values) == 1, np.asarray(code.values), np.asarray(k.values).astype(float)

    def matrix(cls: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros((ALL, ALL))
            for b in batches:
                for w, after, code, k in neighbours(b):
                    m[cls[w]] += np.bincount(cls[code[after]], k[after], ALL)
                    before = ~after & (code >= n)
                    m[:, cls[w]] += np.bincount(cls[code[before]], k[before], ALL)
            at = np.flatnonzero(m)
            yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(m.ravel()[at].astype(np.int64))})

        m = fixed.copy()
        for r in rows.mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            m[r["at"] // ALL, r["at"] % ALL] += r["n"]
        return m

    def moves(cls: np.ndarray, m: np.ndarray, turn: int, share: float) -> np.ndarray:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_m = m.copy()
            for b in batches:
                out = []
                for w, after, code, k in neighbours(b):
                    if zlib.crc32(b"%d:%d" % (turn, w)) >= share * 2.0 ** 32:
                        continue
                    own, at = code == w, int(cls[w])
                    left, right = (np.bincount(cls[code[s]], k[s], ALL) for s in (~after & ~own, after & ~own))
                    twice = float(k[after & own].sum())
                    to = best_class(own_m, at, left, right, twice)
                    if to != at:
                        out.append((w, to))
                        for c, sign in ((at, -1), (to, 1)):
                            own_m[:, c] += sign * left
                            own_m[c, :] += sign * right
                            own_m[c, c] += sign * twice
                yield pa.RecordBatch.from_pydict({"word": pa.array([x for x, _ in out], pa.int32()), "to": pa.array([y for _, y in out], pa.int32())})

        new = cls.copy()
        for r in rows.mapInArrow(find, "word int, to int").collect():
            new[r["word"]] = r["to"]
        return new

    m, share = matrix(cls), 0.5
    for turn in range(rounds):
        new = moves(cls, m, turn, share)
        if (new == cls).all():
            continue
        new_m = matrix(new)
        if likelihood(new_m) > likelihood(m):
            cls, m = new, new_m
        else:
            share /= 2
    return cls, m


def _chunks(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Rows of a batch a few at a time: the first, the one behind the last, the tokens of each."""
    texts, start, size = as_bytes(b.column(column)), 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield start, i + 1, [tokens(t) for t in texts[start:i + 1]]
            start, size = i + 1, 0


def count_beside(texts: DataFrame, moved: list[bytes], cls: np.ndarray) -> DataFrame:
    """(word, beside, n) of every word that is not among the moved: how often each class, in the order of BESIDE, stands
    beside it. The neighbours' classes are those of the exchange, so no look-up of rare words is needed."""
    n, shared = len(moved), texts.sparkSession.sparkContext.broadcast((moved, cls))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cls = _index(shared.value[0]), shared.value[1]
        own: dict[bytes, int] = {}
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            at = np.searchsorted(key, np.arange(len(own) + 1) * BESIDE).astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.ListArray.from_arrays(at, pa.array(key % BESIDE, pa.int16())),
                                              pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))], names=["word", "beside", "n"])
            own.clear()
            held.clear()
            return out

        seen = 0
        for b in batches:
            for _, _, lists in _chunks(b, 0):
                words: list = []
                for one in lists:
                    words += one
                    words.append(None)
                ends = np.cumsum([len(one) + 1 for one in lists]) - 1
                at = np.fromiter((index[w] if w is not None else -1 for w in words), np.int64, len(words))
                classes = np.where(at < 0, END_CLASS, cls[at])
                rest = np.flatnonzero(at >= n)
                ids = np.full(len(words), -1)
                ids[rest] = [own.setdefault(words[i], len(own)) for i in rest.tolist()]
                # the token before the first is an end, as the one behind the last is
                before, after = rest - 1, rest + 1
                same_before, same_after = (before >= 0) & (ids[before] == ids[rest]), ids[after] == ids[rest]
                key = ids[rest] * BESIDE
                held += [(key + np.where(before >= 0, classes[before], END_CLASS))[~same_before], np.where(same_after, key + ITSELF, key + ALL + classes[after])]
                seen += len(words) - len(ends)
                if seen > FLUSH_TOKENS or len(own) > FLUSH_WORDS:
                    yield flush()
                    seen = 0
        yield flush()

    return texts.mapInArrow(count, "word binary, beside array<smallint>, n array<long>")


def best_classes(m: np.ndarray, own: np.ndarray, word: np.ndarray, beside: np.ndarray, n: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """The exchange class that each of several words is best moved to from its class of a spelling, or that class where none
    gains `least` nats. (word, beside, n): what stands beside them, by place in `own`, sorted, each pair once; each word is judged alone."""
    b, fm, to = len(own), _f(m), np.arange(1, CLASSES + 1)
    dense = np.zeros((b, BESIDE))
    dense[word, beside] = n
    left, right, twice = dense[:, :ALL], dense[:, ALL:ITSELF], dense[:, ITSELF]
    rows, cols, size_l, size_r = m.sum(1), m.sum(0), left.sum(1) + twice, right.sum(1) + twice
    diag = np.diag(m)[to]
    both, l_to, r_to = left[:, to] + right[:, to] + twice[:, None], left[:, to], right[:, to]
    gain = _f(diag + both) - _f(diag + l_to) - _f(diag + r_to) + _f(diag)
    gain -= _f(rows[to] + size_r[:, None]) - _f(rows[to]) + _f(cols[to] + size_l[:, None]) - _f(cols[to])
    stay = _f(m[own, own]) - _f(m[own, own] - left[np.arange(b), own] - right[np.arange(b), own] - twice)
    stay -= _f(rows[own]) - _f(rows[own] - size_r) + _f(cols[own]) - _f(cols[own] - size_l)
    for table, f_table, first, other in ((m, fm, 0, r_to), (m.T, fm.T, ALL, l_to)):
        here = np.flatnonzero((beside >= first) & (beside < first + ALL))
        w, c, k = word[here], beside[here] - first, n[here].astype(float)
        # pairs of this word itself stand in its own class's cells and have left them
        mine = c == own[w]
        base, f_base = table[c][:, to], f_table[c][:, to]
        base[mine] -= other[w[mine]]
        f_base[mine] = _f(base[mine])
        if len(w):  # entries are sorted by word
            at = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[at]] += np.add.reduceat(_f(base + k[:, None]) - f_base, at)
        w, c, k = w[~mine], c[~mine], k[~mine]
        stay += np.bincount(w, _f(table[c, own[w]]) - _f(table[c, own[w]] - k), b)
    best = gain.argmax(1)
    return np.where(gain[np.arange(b), best] > stay + least, to[best], own)


def move_rest(beside: DataFrame, m: np.ndarray) -> DataFrame:
    """(word, c, code) of every word that is not among the moved ones: its count and the class it is best moved to, its own
    where the move would not pay for naming the class."""
    least = GAIN

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK_WORDS):
                b = whole.slice(start, CHUNK_WORDS)
                words = b.column("word").to_pylist()
                sizes = np.asarray(b.column("beside").value_lengths())
                key = np.repeat(np.arange(len(words)), sizes) * BESIDE + np.asarray(b.column("beside").flatten())
                key, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, np.asarray(b.column("n").flatten()), len(key))
                own = np.array([FIRST_SPELLING + spelling(w) for w in words], np.int64)
                new = best_classes(m, own, key // BESIDE, key % BESIDE, n, least)
                # each token has one thing before it: a class, or the word itself
                before = (key % BESIDE < ALL) | (key % BESIDE == ITSELF)
                c = np.bincount(key[before] // BESIDE, n[before], len(words))
                code = code_of(own, new, np.array([level_of(w) for w in words], np.int64))
                yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(c.astype(np.int64)), pa.array(code, pa.int16())], names=["word", "c", "code"])

    grouped = beside.groupBy("word").agg(F.flatten(F.collect_list("beside")).alias("beside"), F.flatten(F.collect_list("n")).alias("n"))
    return grouped.mapInArrow(move, "word binary, c long, code smallint")


def learn_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Words, DataFrame, np.ndarray, DataFrame]:
    """From all documents whose crc32(id) mod 5 is not 1: the words that tasks hold, the stored table of the others, the
    class matrix before these and the held ones beyond MOVED are moved, and the counts of moved codes."""
    texts = _training(docs, id_col, text_col)
    least, head = _head(stored(count_words(texts), "lm-words"), HEAD)
    words, count = [w for w, _ in head], np.array([c for _, c in head], np.int64)
    moved = words[:MOVED]
    cls, m = cluster(stored(count_pairs(texts, moved), "lm-pairs"), moved)
    rest = stored(move_rest(count_beside(texts, moved, cls), m), "lm-classes")
    common = rest.where(_level("c") >= least).toArrow()
    codes = dict(zip(common["word"].to_pylist(), common["code"].to_pylist(), strict=True))
    sums = rest.groupBy("code").agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    at = cls[:len(moved)]
    code = np.array([*code_of(at, at, TRIALS - 1), *(codes[w] for w in words[len(moved):])], np.int64)
    return Words(words, count, code), rest.where(_level("c") < least), m, sums


def encode(docs: DataFrame, held: Words, rest: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs, stored: doc_id, held_out, n_tokens, n_known, logs (sum of log10(c + 0.5) over its words), codes (of its
    words in order, 16 bits each; -1 to -16: unknown words by spelling). Words that tasks do not hold are joined by their places."""
    shared = docs.sparkSession.sparkContext.broadcast(held)
    fields = [("row", "long", pa.int64()), ("doc_id", "long", pa.int64()), ("held_out", "boolean", pa.bool_()), ("n_tokens", "long", pa.int64()), ("logs", "double", pa.float64()),
              ("codes", "binary", pa.binary()), ("word", "binary", pa.binary()), ("at", "int", pa.int32()), ("spelling", "smallint", pa.int16())]
    names = [x for x, _, _ in fields]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 36
        index, known = _index(m.words), len(m.words)
        log_count, code = np.append(np.log10(m.count + 0.5), np.zeros(SPELLINGS)), np.append(m.code, -1 - np.arange(SPELLINGS)).astype("<i2")
        for b in batches:
            for start, end, lists in _chunks(b, 0):
                n, words = np.array([len(x) for x in lists]), [w for x in lists for w in x]
                at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                doc = np.repeat(np.arange(len(lists)), n)
                edges, raw = np.append(0, np.cumsum(n)), code[at].tobytes()
                tail = np.flatnonzero(at >= known)
                docs_here = b.slice(start, end - start)
                here = {"row": pa.array(row + np.arange(len(lists))), "doc_id": docs_here.column(1), "held_out": docs_here.column(2), "n_tokens": pa.array(n + 1),
                        "logs": pa.array(np.bincount(doc, log_count[at], len(lists)).astype(float)), "codes": pa.array([raw[2 * i:2 * j] for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())}
                there = {"row": pa.array(row + doc[tail]), "word": pa.array([words[i] for i in tail.tolist()], pa.binary()), "at": pa.array((tail - edges[doc[tail]]).astype(np.int32)),
                         "spelling": pa.array((at[tail] - known).astype(np.int16))}
                for columns, size in ((here, len(lists)), (there, len(tail))):
                    yield pa.RecordBatch.from_arrays([columns.get(x, pa.nulls(size, kind)) for x, _, kind in fields], names=names)
                row += len(lists)

    inner = docs.select(F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("doc_id"), (part_of(F.col(id_col), 5) == 1).alias("held_out"))
    found = stored(inner.mapInArrow(first, ", ".join(f"{x} {kind}" for x, kind, _ in fields)), "lm-encoded")
    tail = found.where("word IS NOT NULL").select("row", "at", "spelling", "word").join(rest, "word", "left")
    place = F.shiftleft(F.col("at").cast("long"), 16) + F.coalesce("code", -1 - F.col("spelling")).cast("long") + 32768
    tail = tail.groupBy("row").agg(F.collect_list(place).alias("places"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_logs"), F.sum(F.when(F.col("c").isNull(), 1).otherwise(0)).alias("_unknown"))
    rows = found.where("word IS NULL").select("row", "doc_id", "held_out", "n_tokens", "logs", "codes").join(tail, "row", "left")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, places in zip(b.column("codes").to_pylist(), b.column("places"), strict=True):
                if places.is_valid:
                    codes, place = np.frombuffer(raw, "<i2").copy(), np.asarray(places.values)
                    codes[place >> 16] = (place & 65535) - 32768
                    raw = codes.tobytes()
                out.append(raw)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "logs")), pa.array(out, pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "codes"])

    rows = rows.select("doc_id", "held_out", "n_tokens", (F.col("n_tokens") - 1 - F.coalesce("_unknown", F.lit(0))).alias("n_known"), (F.col("logs") + F.coalesce("_logs", F.lit(0.0))).alias("logs"), "codes", "places")
    return stored(rows.mapInArrow(fill, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, codes binary"), "lm-sequences")


def _runs(b: pa.RecordBatch, class_of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch a few at a time: the first, the one behind the last, their classes with an end before the first and behind
    each row, and the row of each but the first. The places of unknown words are behind those of the codes."""
    lists, start, size = b.column("codes").to_pylist(), 0, 0
    for end in range(1, len(lists) + 1):
        size += len(lists[end - 1])
        if size < CHUNK_BYTES and end < len(lists):
            continue
        some = lists[start:end]
        # code 0 is that of the end: it never moves
        codes = np.frombuffer(b"\0\0" + b"".join(x + b"\0\0" for x in some), "<i2").astype(np.int64)
        yield start, end, class_of[codes], np.repeat(np.arange(len(some)), [len(x) // 2 + 1 for x in some])
        start, size = end, 0


def transitions(sequences: DataFrame, class_of: np.ndarray) -> np.ndarray:
    """How often each class follows each, in the documents that are not held out."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(ALL * ALL, np.int64)
        for b in batches:
            for _, _, c, _ in _runs(b, class_of):
                m += np.bincount(c[:-1] * ALL + c[1:], minlength=ALL * ALL)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "n": pa.array(m[at])})

    m = np.zeros((ALL, ALL))
    for r in sequences.where("NOT held_out").select("codes").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        m[r["at"] // ALL, r["at"] % ALL] = r["n"]
    return m


def model_of(sequences: DataFrame, held: Words, m: np.ndarray, sums: DataFrame) -> Model:
    """The class model over encoded training documents. Words were judged without each other's moves, so moving all can lower the
    likelihood: then half of them move, or a quarter, or an eighth, or none."""
    counts = [(r["code"], r["c"], r["n"]) for r in sums.collect()]
    for trial in range(TRIALS + 1):
        class_of = classes_in(trial)
        # an unknown word is of the class that most words of its spelling are in
        types = np.zeros((SPELLINGS, ALL), np.int64)
        for code, _, n in counts:
            types[code % ALL - FIRST_SPELLING, class_of[code]] += n
        unknown = np.where(types.any(1), types.argmax(1), FIRST_SPELLING + np.arange(SPELLINGS))
        class_of = np.append(class_of, unknown[::-1])  # code -1 - spelling, counted from the end
        new_m = transitions(sequences, class_of)
        if trial == TRIALS or likelihood(new_m) > likelihood(m):
            break
    at = held.code[:MOVED] % ALL
    mass, types = np.bincount(at, held.count[:MOVED], ALL), np.bincount(at, minlength=ALL)
    for code, c, n in counts:
        mass[class_of[code]] += c
        types[class_of[code]] += n
    ends = int(new_m[:, END_CLASS].sum())
    mass[END_CLASS] = ends
    share = (mass + 0.5) / (mass + 0.5).sum()
    move = (new_m + PRIOR * share[None, :]) / (new_m.sum(1, keepdims=True) + PRIOR)
    log_mass = np.log10(mass + 0.5 * (types + 1))
    return Model(held, class_of, int(round(mass.sum())), int(types.sum()) + (ends > 0), ends, np.log10(move), log_mass)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """Learns from all documents whose crc32(id) mod 5 is not 1: the model, and the stored table of words it does not hold."""
    held, rest, m, sums = learn_words(docs, id_col, text_col)
    training = docs.where(part_of(F.col(id_col), 5) != 1)
    return model_of(encode(training, held, rest, id_col, text_col), held, m, sums), rest


def score(docs: DataFrame, model: Model, rest: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram), score (class bigram: transition
    times emission, log10), perplexity (10 to the minus score per token).

    Null and empty texts hold the end alone. Null ids are never held out; repeated ids are scored row by row. Without
    training documents every token is unknown. A word that was not in training weighs half a count."""
    return score_sequences(encode(docs, model.held, rest, id_col, text_col), model)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`score` of the documents that `fit` learnt from; they are encoded once for both."""
    held, rest, m, sums = learn_words(docs, id_col, text_col)
    sequences = encode(docs, held, rest, id_col, text_col)
    return score_sequences(sequences, model_of(sequences, held, m, sums))


def score_sequences(sequences: DataFrame, model: Model) -> DataFrame:
    shared = sequences.sparkSession.sparkContext.broadcast((model.class_of, model.log_move, model.log_mass))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, log_move, log_mass = shared.value
        emitted = np.where(np.arange(ALL) == END_CLASS, 0.0, log_mass)
        for b in batches:
            for start, end, c, row in _runs(b, class_of):
                logs = np.bincount(row, log_move[c[:-1], c[1:]] - emitted[c[1:]], end - start)
                some = b.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*(some.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "logs")), pa.array(logs)], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "class_logs"])

    rows = sequences.mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, class_logs double")
    whole, log_end = float(np.log10(model.tokens + 0.5 * (model.types + 1))), float(np.log10(model.ends + 0.5))
    rows = rows.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + int(model.ends > 0)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                       (F.col("logs") + log_end - F.col("n_tokens") * whole).alias("base_score"), (F.col("logs") + F.col("class_logs")).alias("score"))
    return rows.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
