"""Repetition coverage, the conversation trie and the filter audit: brute force and odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from conftest import SMALL

from figtrail.llm import conversation_trie as trie
from figtrail.llm import filter_audit, queries, repetition

DOC = "doc_id long, text string, lang string, source string, n_words long, kept boolean, part string, _text string, mask int, n long, _words string"
LONG = "lorem ipsum dolor " * 60_000


def docs_of(spark, rows):
    """Rows of (doc_id, text, source) with extra columns that bear the operators' own names."""
    return spark.createDataFrame([(i, t, None, s, 5, True, "p", "x", 3, 7, "w") for i, t, s in rows], DOC)


ODD = [(1, "One two three four five six seven", "a"), (2, "one TWO three", "a"), (2, "one TWO three", "a"), (None, None, None), (3, "", "b"), (4, None, "b"), (5, LONG, "a"), (6, LONG, None), (None, "alone", ""),
       (7, "é Ünï ſ K \x1c weird blank <|x|> #", "c"), (8, "a b\n\na b\n \n \na  b\n\n", "c"), (9, "\n".join(["same line of ten words that is here again twice"] * 2), "c"), (10, "alone", "d")]


# ---------------------------------------------------------------- repetition

def plain_measures(text):
    text = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    chars = sum(map(len, words))

    def marked(n, later):
        seen, at = defaultdict(list), set()
        for i in range(len(words) - n + 1):
            seen[tuple(words[i:i + n])].append(i)
        for places in seen.values():
            if len(places) > 1:
                at |= {i + k for i in places[1 if later else 0:] for k in range(n)}
        return at

    lines, seen, dup, dup_chars = text.split("\n"), set(), 0, 0
    for line in lines:
        inner = [w for w in __import__("re").split("[\x20\x09-\x0d]+", line) if w]
        if inner and line in seen:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, inner))
        seen.add(line)
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(marked(5, False)), "dup_line_chars": dup_chars}
    out |= {f"dup_chars_{n}": sum(len(words[i]) for i in marked(n, True)) for n in repetition.MOST_IN_WINDOWS}
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    out["kept"] = not out["base_failed"] and 10 * out["n_symbols"] <= len(words) and 100 * dup_chars <= repetition.MOST_IN_LINES * chars and all(100 * out[f"dup_chars_{n}"] <= m * chars for n, m in repetition.MOST_IN_WINDOWS.items())
    return out


def test_repetition_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for size in (5, 9, 10, 12, 40, 90, 300):
        for alphabet in (2, 4, 30, 400):
            blanks = rng.choice([" ", "\n", "\t", "  ", "\x0b", "\r\n"], size)
            texts.append("".join(f"{'é' if w % 3 else 'w#'}{w}{b}" for w, b in zip(rng.integers(0, alphabet, size), blanks, strict=True)))
    body = " ".join(f"u{i}" for i in range(100))
    texts += [body + " " + body[:k] for k in (20, 45, 60, 100, 200)] + [text for _, text, _ in ODD]
    got = {r["doc_id"]: r.asDict() for r in repetition.repetition_quality(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        if t is not LONG:
            assert {k: v for k, v in got[i].items() if k != "doc_id"} == plain_measures(t), t[:80]
    assert 0 < sum(r["kept"] for r in got.values()) < len(texts)


def test_repetition_does_not_depend_on_chunks(monkeypatch):
    texts = [(t or "").encode() for _, t, _ in ODD] + [b"x" * 5000 + b" y " * 40, b""]
    whole = repetition.measures(texts)
    monkeypatch.setattr(repetition, "CHUNK", 64)
    assert list(repetition._chunks(texts))[-1][1] == len(texts)
    parts = [repetition.measures(texts[lo:hi]) for lo, hi in repetition._chunks(texts)]
    assert all(np.array_equal(v, np.concatenate([p[k] for p in parts])) for k, v in whole.items())


def test_repetition_of_odd_rows(spark):
    rows = repetition.repetition_quality(docs_of(spark, ODD)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].n_words == 0 and by_id[4].base_failed and not by_id[4].kept
    assert by_id[5].n_words == by_id[5].n_repeat_words == 180_000
    assert by_id[8].n_dup_lines == 1  # lines of blanks do not count
    assert repetition.repetition_quality(docs_of(spark, [])).count() == 0


# ---------------------------------------------------------------- trie

def plain_trie(sequences):
    """sequences: conv_id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(sequences):
        s = tuple(sequences[c])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    out = set()
    for node, who in members.items():
        below = [x for x in members if x[:len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in members)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.add((who[0], len(node), members[node[:-1]][0] if node else None, len(who), len(kids), sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()))
    return out


def turns_of(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, 2, "z", 9) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, pos long, depth long, part string, block long")


def rows_of(sequences):
    return [(c, i * 2, r, t) for c, s in sequences.items() for i, (r, t) in enumerate(s)]


def as_sequences(rows):
    out = defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for c, _, r, t in sorted(rows, key=key):
        if c is not None:
            out[c].append((r or "", t or ""))
    return out


def rebuilt(sequences):
    out = {}
    for c, s in sequences.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = list(sequences.get(base, []))[:h] + s[h:]
    return out


def got(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def sequences():
    rng = np.random.default_rng(8)
    out = {}
    for c in rng.permutation(np.arange(-20, 90)):
        n = int(rng.integers(1, 12))
        out[int(c)] = [("user" if i % 2 else "bot", f"é{rng.integers(0, 2 if i < 4 else 40)}") for i in range(n)]
    out[200] = out[201] = out[13]
    return out


@pytest.mark.parametrize("block, shard, listed", [(4096, 1 << 17, 1 << 16), (4, 16, 3)])
def test_trie_equals_brute_force(spark, sequences, monkeypatch, block, shard, listed):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("LISTED", listed)):
        monkeypatch.setattr(trie, name, value)
    frame = turns_of(spark, rows_of(sequences)).repartition(7)
    assert got(trie.conversation_trie(frame)) == plain_trie(sequences)
    assert got(trie.conversation_trie(frame, rebuilt=True)) == plain_trie(rebuilt(sequences))


def test_trie_of_one_long_and_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "SHARD", 64)
    monkeypatch.setattr(trie, "LISTED", 10)
    sequences = {1: [("u", f"t{i}") for i in range(200)], 2: [("u", f"t{i}") for i in range(150)], 3: [("u", f"t{i}") for i in range(150)] + [("u", "other")]}
    sequences |= {c: [("u", "t0"), ("b", "hello")] for c in range(10, 90)}
    assert got(trie.conversation_trie(turns_of(spark, rows_of(sequences)).repartition(5))) == plain_trie(sequences)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "user", "a"), (2, None, "", ""), (2, 1, "user", None), (None, 3, "user", "gone"), (None, None, None, None), (7, 5, "bot", LONG), (8, 5, "bot", LONG), (3, 2, "us", "erx"), (4, 2, "user", "x")]
    assert got(trie.conversation_trie(turns_of(spark, rows))) == plain_trie(as_sequences(rows))
    again = as_sequences(rows)
    assert got(trie.conversation_trie(turns_of(spark, rows), rebuilt=True)) == plain_trie(rebuilt(again))
    assert trie.conversation_trie(turns_of(spark, []), rebuilt=True).count() == 0


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    k0, k1 = trie.distinct(rng.integers(0, 50, 20_000, np.uint64), rng.integers(0, 1 << 62, 20_000, np.uint64))
    table = trie.SlotTable(k0, k1)
    assert sorted(table.slots(k0, k1)) == list(range(len(k0)))
    assert (table.slots(k0, k1 + np.uint64(1 << 63)) == -1).all()
    shard = {"k0": np.zeros(2, np.int64), "k1": np.zeros(2, np.int64), "i0": np.array([1, 2]), "conv_id": np.arange(2), "n_turns": np.ones(2, np.int64)} | {n: np.ones(2, np.int64) for n in ("i1", "depth", "l0", "l1", "bytes")}
    with pytest.raises(ValueError, match="share a digest"):
        trie.count_nodes(shard)


# ---------------------------------------------------------------- filter audit

def plain_audit(rows, labels):
    split = lambda t: [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    masks = []
    for i, t, s in rows:
        t = t or ""
        words = split(t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        masks.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        mine, shapley = [m for m in masks if m[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in m[1] for m in mine) - len(gone), sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [r for r in ODD if r[1] is not LONG]
    for i in range(20, 140):
        n = int(rng.choice([3, 150, 250]))
        words = [f"{'W' if rng.random() < 0.05 else 'w'}{w}" for w in rng.integers(0, int(rng.choice([40, 5000])), n)]
        rows.append((i, " ".join(words) + ("#" if rng.random() < 0.2 else ""), f"s{i % 3}"))
    rows += [(200 + k, rows[-1 - k // 4][1], "s9") for k in range(40)]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 230, 2)] + [(20, 1, None), (20, 0, 1), (None, 1, 1), (9999, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.filter_interactions(docs_of(spark, rows), marks).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found} == plain_audit(rows, labels)
    assert len(found) == 600 * len({r.part for r in found})


def test_audit_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.filter_interactions(docs_of(spark, ODD), none).collect()
    first = {r.part: r for r in rows if r.filter_order == "EABCD" and r.step == 1}
    assert first["a"].removed == 0 and first[""].removed == 1  # the long text of id 6 stands under id 5, in another part
    assert first["d"].removed == 0  # "alone" under no id makes no other row fail
    assert filter_audit.filter_interactions(docs_of(spark, []), none).count() == 0


@pytest.mark.parametrize("name", ["op11_repetition", "op12_conversation_trie", "op13_filter_audit"])
def test_audit_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
