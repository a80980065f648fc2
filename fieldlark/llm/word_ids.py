"""Token ids of whole texts by the ``tokenizers`` library, whose model sees each new word once.

Both vocabularies used here split a text into words by a fixed pattern before
any merge, so the ids of a text are those of its words in a row. A text that
Latin-1 can hold (where the pattern's classes are written out below) is split
here and its words looked up in a memo; the library's model encodes the words that
the memo lacks. All other texts, and those that hold a special token's string, go to
the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np

#: Words kept in a worker's memo (of some 200 bytes each); it changes no result.
MEMO = 400_000

_latin = [chr(i) for i in range(256)]
_cls = lambda keep: "".join(re.escape(c) for c in _latin if keep(c))
_L = _cls(lambda c: unicodedata.category(c)[0] == "L")
_N = _cls(lambda c: unicodedata.category(c)[0] == "N")
_S = _cls(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0")
#: The contractions that both vocabularies' patterns begin with.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
# Letters come first, as nothing else begins with one.
PATTERNS = {
    "byte": re.compile(f" ?[{_L}]+|{_SHORT}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
    "word": re.compile(f"[{_L}]+|{_SHORT}|[{_N}]|[^{_S}{_L}{_N}]+"),
}


def _byte_letters() -> dict[int, int]:
    """What byte-level vocabularies write for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: 0x100 + i for i, b in enumerate(rest)}


class _Memo(dict):
    """Words met of late; a word that is in neither generation goes to the library's model."""

    def __init__(self, library, size: int):
        super().__init__()
        self.half = size // 2
        self.old: dict[str, bytes] = {}
        self.tokenize = library.model.tokenize
        self.letters = _byte_letters()
        self.space = chr(self.letters[0x20])

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isascii() and word.isprintable():
                letters = word.replace(" ", self.space)
            else:
                letters = word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def age(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


class WordIds:
    """``encode(texts)``: little-endian unsigned 32-bit ids of each text, as bytes (executors are little-endian machines)."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.find = PATTERNS["word" if self.lower else "byte"].findall
        self.size = max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"])) + 1
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.memo = _Memo(self.library, memo)

    def _plain(self, text: str) -> bool:
        if "<|" in text and any(s in text for s in self.specials):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, texts):
        look = self.memo.__getitem__
        for t in texts:
            if self._plain(t):
                yield b"".join(map(look, self.find(t.lower() if self.lower else t)))
                self.memo.age()
            else:
                yield np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


_by_path: dict[str, WordIds] = {}


def word_ids(path: str, memo: int = MEMO) -> WordIds:
    """One per worker process and vocabulary."""
    if path not in _by_path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _by_path[path] = WordIds(path, memo)
    return _by_path[path]
