"""Token ids of texts by a public subword vocabulary, with a memory of words already encoded.

The vocabulary's normaliser lower-cases and joins white space, and no token
crosses white space, so a text's ids are those of its words in order. Each
distinct word of a worker's texts is encoded once by the library. A text with
characters for which word by word and whole text could differ (combining marks,
unusual case rules, rare spaces, special tokens) is encoded whole.
"""

from __future__ import annotations

import re
from array import array
from itertools import islice

END_ID = 1
#: Words kept per worker process, about 200 MB at most; a full memory keeps the quarter that came first, where frequent
#: words are. This changes the time taken only.
MEMORY_WORDS = 600_000
#: Characters without composition or special case rules: ASCII without separators 1C-1F, Latin-1 without
#: raised digits and fractions, and Latin letters up to 017E.
PLAIN = re.compile("[\x00-\x1b\x20-\x7e¡-±´¶-¸»¿-įĲ-ňŊ-ž]*")
#: The vocabulary's own split of a word, over the characters of PLAIN.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_]+|[0-9]|(?:[^\\w]|_)+")
#: How byte-level vocabularies write bytes that are not printable: from 256 on, in order of the byte.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_TEXT = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


def plain(text: str | None) -> bool:
    """Whether the ids of a text are those of its words in order."""
    return not text or (PLAIN.fullmatch(text) is not None and "<|" not in text)


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(name: str, most: int | None = None) -> Encoder:
    """The encoder of this process for a public vocabulary file, by the file's name; it keeps `most` words, MEMORY_WORDS if unset."""
    if (name, most) not in _encoders:
        _encoders[name, most] = Encoder(name, most)
    return _encoders[name, most]


class Encoder(dict):
    """word -> its ids as little-endian unsigned 32-bit integers; a missing word is encoded and kept, with its pieces, which are words too."""

    def __init__(self, name: str, most: int | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.library.model
        self.most = most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= (self.most or MEMORY_WORDS):
            for late in list(islice(self, len(self) // 4, None)):
                del self[late]
        if word.isalpha():
            self[word] = ids = self.piece(word)
            return ids
        start, last = word[:-1], word[-1:]
        found = [start, last] if start.isalpha() and not last.isalnum() else PIECE.findall(word)
        ids = self.piece(word) if found == [word] else b"".join(map(self.__getitem__, found))
        self[word] = ids
        return ids

    def piece(self, text: str) -> bytes:
        shown = text if text.isascii() and text.isprintable() else text.encode().decode("latin-1").translate(BYTE_TEXT)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def by_word(self, text: str | None) -> tuple[list[str], list[bytes]] | None:
        """The words of a text that have ids, and their ids; None for a text that is not encoded word by word."""
        if not plain(text):
            return None
        names = text.lower().split() if text else []
        parts = list(map(self.__getitem__, names))
        if not all(parts):
            names, parts = [w for w, p in zip(names, parts) if p], [p for p in parts if p]
        return names, parts

    def encode(self, text: str | None) -> bytes:
        """Ids of a text without special tokens, 4 bytes each; a null text has none."""
        if not text:
            return b""
        if plain(text):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
