"""Token ids of whole texts with the tokenizers library, through a cache of pieces.

A byte-level tokenizer splits at white space before it merges: a piece is an optional blank with the non-space run after
it, or white space. Pieces encode alone as they do in their text, so each distinct piece is encoded once
per worker. Texts that hold the string of an added token are encoded whole, as it may swallow neighbours. Texts of
plain characters (below PLAIN) are split into the tokenizer's own words at once, which are fewer than pieces.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
# Unicode white space, as the tokenizer's pattern has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the split of byte-level tokenizers, as published with them.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CACHE = 500_000  # pieces in each of two generations
LONGEST = 64  # longer pieces aren't kept
PLAIN = 0x500  # below this code point every Unicode version agrees on what is a letter or digit
BEYOND = re.compile(f"[{chr(PLAIN)}-{chr(sys.maxunicode)}]").search


def _plain_pattern() -> re.Pattern:
    """PATTERN for texts below PLAIN, without classes of properties: several times as fast."""
    import regex

    below = "".join(map(chr, range(PLAIN)))
    letters, numbers = (re.escape("".join(regex.findall(kind, below))) for kind in (r"\p{L}", r"\p{N}"))
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids as bytes."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A byte-level tokenizer without a normaliser: its model can be asked for one word at a time.
        parts = json.loads(self.tokenizer.to_str())
        before = parts.get("pre_tokenizer") or {}
        self.direct = not parts.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.split = regex.compile(PATTERN).findall
        self.plain = _plain_pattern().findall
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {**{b: b for b in shown}, **{b: 256 + k for k, b in enumerate(hidden)}}  # the byte alphabet
        self.blank = chr(self.letters[32])

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """One word of the tokenizer's own split."""
        if word.isascii() and word.isprintable():  # letters of the byte alphabet but for the blank
            mapped = word.replace(" ", self.blank)
        else:
            mapped = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if not self.direct or not piece.isascii() and max(piece) >= chr(PLAIN):
                ids = self._encode(piece)
            elif piece.lstrip(" ").isalpha() or len(found := self.split(piece)) == 1:
                ids = self._word(piece)
            else:
                ids = b"".join([self.cache.get(w) or self._piece(w) for w in found])
        if len(piece) <= LONGEST:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = ids
        return ids

    def _plain(self, word: str) -> bytes:
        ids = self.older.get(word) or self._word(word)
        if len(word) <= LONGEST:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[word] = ids
        return ids

    def forget(self) -> None:
        """Ends a task: the worker lives on, its pieces needn't."""
        self.cache, self.older = {}, {}

    def ids(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self._encode(text)
        # Words of their own are fewer than pieces with their punctuation, and the search for them is cheap in plain texts.
        plain = self.direct and (text.isascii() or not BEYOND(text))
        pieces = self.plain(text) if plain else PIECE.findall(text)
        found = list(map(self.cache.get, pieces))
        if None in found:
            piece = self._plain if plain else self._piece
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.cache.get(pieces[i]) or piece(pieces[i])
        return b"".join(found)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
