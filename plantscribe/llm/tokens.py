"""Token ids by a public tokenizer file, one encoding per distinct word and worker.

The vocabulary ``word_bpe_49k.json`` drops white space before it merges, so a text's ids are its words' ids in a row. It
lower-cases too and parts letters from marks, so ``Foo.`` costs no second entry beside ``foo`` and ``.``: texts are
lower-cased (A-Z) and a mark after an ASCII letter or digit gets a blank before it; where that could change a run of marks
or a special token, the words stay as they are. A worker encodes each distinct word once and joins packed ids. Beyond
CACHE_WORDS entries only the latest words stay, which bounds memory whatever the corpus holds; ids don't depend on it.
"""

from __future__ import annotations

import os
import re
import struct
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

CACHE_WORDS = 500_000
END_ID = 1
#: Words that normalising and pre-tokenising leave whole: letters, each lower-cased alone.
LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+").fullmatch
#: Words that they leave whole: marks alone.
MARKS = b".,!?;:#$%&*|"
ONLY_MARKS = re.compile("[.,!?;:#$%&*|]+").fullmatch
#: A cut before a mark holds after an ASCII letter or digit only.
FALSE_CUT = re.compile(rb"([^a-z0-9\x09-\x0d ])\0").sub


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


def spaced_words(text: str | None) -> list[bytes]:
    """The words of a text as the encoder caches them; their ids in a row are the ids of the text."""
    if text is None:
        return []
    raw = text.encode("utf-8", "replace")
    if b"<|" in raw or b"\0" in raw:
        return raw.split()
    raw = raw.lower()
    for m in MARKS:
        mark = b"%c" % m
        if mark in raw:
            raw = raw.replace(mark, b"\0" + mark)
    return FALSE_CUT(rb"\1", raw).replace(b"\0", b" ").split()


class WordEncoder(dict):
    """Word -> its packed ids, found out when first asked for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize  # ids of one pre-token, without the cost of a whole encoding
        self.alphabet = byte_alphabet()
        self.latest: deque[bytes] = deque(maxlen=CACHE_WORDS // 4)

    def __missing__(self, w: bytes) -> bytes:
        if w.isalpha():  # bytes: A-Z and a-z only
            ids = [t.id for t in self.merge(w.lower().decode())]
        elif LETTERS(text := w.decode("utf-8")):
            ids = [t.id for t in self.merge(text.lower().encode().decode("latin-1").translate(self.alphabet))]
        elif ONLY_MARKS(text):
            ids = [t.id for t in self.merge(text)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        packed = self[w] = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def packed(self, texts: list[str | None]) -> Iterator[bytes]:
        """Of each text, the ids as little-endian unsigned 32-bit integers, END_ID last."""
        end = struct.pack("<I", END_ID)
        for text in texts:
            words = spaced_words(text)
            if len(self) > CACHE_WORDS:
                kept = {w: self[w] for w in self.latest if w in self}
                self.clear()
                self.update(kept)
            self.latest.extend(words)
            yield b"".join(map(self.__getitem__, words)) + end


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
