"""Token ids of whole texts by a public tokenizer file, with caches for words and pieces of words."""

from __future__ import annotations

import os
import re
import struct
import threading
import unicodedata

from figtrail.llm.common import CACHED

_PLAIN = "\x21-\x7eà-öø-ÿßÀ-ÖØ-Þ"
_LETTERS = "a-zà-öø-ÿß"


class _Cache(dict):
    """Made values of the words seen lately. When `held` are there they become the older half, from which a word that is
    asked for again is taken back, so frequent words are made once; a bound on memory, not on texts."""

    def __init__(self, make, held):
        self.make, self.held, self.older = make, held, {}

    def __missing__(self, key):
        if len(self) >= self.held:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """ids(text) gives the little-endian unsigned 32-bit ids of a UTF-8 text, equal to the tokenizer's own encoding of
    the whole text without special tokens.

    The tokenizer drops white space and never joins across it, so a text is the sequence of its words, and a word is
    encoded once. Inside a word of ASCII and Latin-1 characters the pieces that its split pattern makes are encoded by
    the tokenizer's model directly; every other word goes through the tokenizer itself, and so does the whole of a
    text that holds the mark of a special token."""

    def __init__(self, path: str, held: int = CACHED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.mapped = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in latin}
        self.plain = re.compile(f"[{_PLAIN}]+")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
        self.pieces = _Cache(self._piece, held)
        self.words = _Cache(self._word, held)

    def _packed(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece if piece.isascii() else piece.translate(self.mapped))
        return found[0].id.to_bytes(4, "little") if len(found) == 1 else self._packed([t.id for t in found])

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isprintable():
            parts = self.split.findall(text)
            return self.pieces[parts[0]] if len(parts) == 1 else b"".join(map(self.pieces.__getitem__, parts))
        if self.plain.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return b"".join(map(self.pieces.__getitem__, self.split.findall(text.lower())))
        return self._packed(self.whole.encode(text, add_special_tokens=False).ids)

    def ids(self, text: bytes) -> bytes:
        if b"<|" in text:
            return self._packed(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_open: dict[tuple[str, int], Encoder] = {}
_lock = threading.Lock()


def encoder(path: str, held: int = CACHED) -> Encoder:
    """One encoder per Python worker, file and size of its caches, which outlive a task."""
    with _lock:
        if (path, held) not in _open:
            _open[path, held] = Encoder(path, held)
        return _open[path, held]
