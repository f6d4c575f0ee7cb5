"""Whole-text encoding with the tokenizers library, one library call per distinct word.

Both vocabularies split a text at white space before any merge is applied, so the ids of a text are the ids
of its words laid end to end.  A worker therefore encodes each distinct word once with the library and looks
up the rest.  Texts that hold white space beyond blank, line feed, tab and carriage return, or the content of one
of the vocabulary's added tokens, go to the library whole.  ``tests/llm/test_tokens.py`` compares both ways text
by text with an untouched ``Tokenizer.from_file``.
"""

from __future__ import annotations

import functools
import re
from array import array

#: Words in a generation of a worker's cache; its size costs memory or time and never changes ids.
CACHE_WORDS = 250_000
_ODD_SPACE = re.compile(r"[\x00\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_CHUNK = re.compile(r" ?[^ \n\t\r]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]+")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """Ids by key in two generations: when the young one is full it becomes the old one, and keys in use move on."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        if (ids := self.old.get(key)) is None:
            ids = self.make(key)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()
# The splitters of the two vocabularies, written out for the letters and numbers of Latin-1.
_LETTER, _NUMBER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if t.content]
        self.folded = [t.content.lower() for t in added if t.content and t.normalized]  # these match normalised text
        self.byte_level = self.tokenizer.normalizer is None
        self.tokenize = self.tokenizer.model.tokenize
        self.words = _Cache(self._word)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A word not seen of late: Latin-1 is split here and merged by the library's model, the rest is left to the library."""
        if not word.isascii():
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                return self.whole(word)
            pieces = _BYTE_PIECES.findall(word) if self.byte_level else _WORD_PIECES.findall(word.lower())
            pieces = [p.encode().decode("latin-1").translate(_BYTE_CHARS) for p in pieces]
        elif self.byte_level:
            pieces = [p.translate(_BYTE_CHARS) for p in _BYTE_PIECES.findall(word)]
        else:
            pieces = _WORD_PIECES.findall(word.lower())
        return array("I", [t.id for p in pieces for t in self.tokenize(p)]).tobytes()

    def chunks(self, text: str) -> list[str]:
        """Parts that the vocabulary's own splitter never crosses; empty parts are possible and have no ids."""
        if not self.byte_level:
            return text.split()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text:
            return _CHUNK.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")  # as _CHUNK, where no two blanks meet

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not text.replace("\n", " ").isprintable() and _ODD_SPACE.search(text):
            return self.whole(text)
        if any(c in text for c in self.added) or self.folded and any(c in text.lower() for c in self.folded):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, self.chunks(text)))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
