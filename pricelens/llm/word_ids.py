"""Token ids of whole texts, each distinct word tokenized once.

The public word-level tokenizer lower-cases, drops white space and never merges
across it, nor from a run of letters into what is none.  A text of ASCII and Latin-1
letters is cut at those places, and its ids are its parts' ids in order; runs of
letters go to the tokenizer's model directly.  Any other text is cut at white space
only, or not at all if it holds control characters that only Python takes for white space.
"""

from __future__ import annotations

import os
import re
import sys
import types
from itertools import chain

import numpy as np

#: beyond these, letters may join or change in ways that only the tokenizer knows; ' starts parts like 's
_UNUSUAL = re.compile(r"[^\x20-\x26\x28-\x7e\n\t\rÀ-ÖØ-öø-ÿ]|<\|")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[^\sa-zß-öø-ÿ]+")
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_ODD = re.compile(r"[\x1c-\x1f]")


def worker_state(name: str, make):
    """One object per worker process, kept from task to task."""
    kept = sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet's letters for the UTF-8 bytes of U+0080 to U+00FF:
    printable Latin-1 bytes are themselves, the rest follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


class _Numbers(dict):
    """Numbers its keys from 0 in the order they come up; ``fresh`` lists new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key):
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class WordTokenizer:
    """Holds at most about ``limit`` parts; beyond that it starts anew."""

    def __init__(self, path: str, limit: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.used, self.known = _Numbers(), 0, 0
        self.pool = np.empty(1 << 16, dtype=np.uint32)
        self.starts, self.sizes = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _part(self, part: str) -> list[int]:
        if _LETTERS.fullmatch(part):
            return [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.letters))]
        return self.whole(part)

    def _learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        found = [self._part(p) for p in fresh]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        total = int(sizes.sum())
        self.pool = _room(self.pool, self.used + total)
        self.starts, self.sizes = _room(self.starts, self.known + len(found)), _room(self.sizes, self.known + len(found))
        self.pool[self.used:self.used + total] = list(chain.from_iterable(found))
        here = slice(self.known, self.known + len(found))
        self.starts[here], self.sizes[here] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += total
        self.known += len(found)

    def ids(self, text: str) -> np.ndarray:
        if not _UNUSUAL.search(text):
            parts = _PARTS.findall(text.lower())
        elif not _ODD.search(text):
            parts = text.split()
        else:
            return np.array(self.whole(text), dtype=np.uint32)
        at = np.fromiter(map(self.numbers.__getitem__, parts), dtype=np.int64, count=len(parts))
        if self.numbers.fresh:
            self._learn()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        out = self.pool[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        if self.known > self.limit:
            self._clear()
        return out


def _room(array: np.ndarray, need: int) -> np.ndarray:
    if need <= len(array):
        return array
    return np.concatenate([array, np.empty(max(need - len(array), len(array)), dtype=array.dtype)])
