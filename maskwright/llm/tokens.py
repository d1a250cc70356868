"""Exact ids of the word-level BPE tokenizer, with a cache of words for texts in common Latin letters and signs."""

from __future__ import annotations

import re

import numpy as np

from maskwright.llm.common import held_between_tasks

#: Characters whose lower case and class (letter, digit, sign, white space) need no look at neighbours; a text with
#: any other character goes to the tokenizer as a whole.
_LETTERS = "a-zß-öø-įı-ňŊ-ž"
_SIGNS = "¡¿«»§°·–—‘’“”„…€"
_SIMPLE = re.compile(f"[\t-\r -~À-Ö{_LETTERS[3:]}Ø-Þ{_SIGNS}]*")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\t-\r {_LETTERS}0-9]+")
#: Words kept; the cache starts anew when it is full.
CACHE_WORDS = 1_000_000


class WordIds:
    """ids(texts): for each text its token ids, packed as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}
        self.limit = CACHE_WORDS

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        simple = [i for i, t in enumerate(texts) if _SIMPLE.fullmatch(t)]
        known = set(simple)
        rest = [i for i in range(len(texts)) if i not in known]
        for i, packed in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = packed
        if len(self.cache) > self.limit:
            self.cache.clear()
        parts = [_PARTS.findall(texts[i].lower()) for i in simple]
        new = list(set().union(*parts).difference(self.cache))
        self.cache.update(zip(new, self.whole(new)))
        for i, p in zip(simple, parts):
            out[i] = b"".join(map(self.cache.__getitem__, p))
        return out


_loaded: dict[str, WordIds] = {}
HELD = "tokens"


def word_ids(path: str | None, cache_words: int = CACHE_WORDS) -> WordIds:
    """The tokenizer of this process; no path: the public file as it is installed on this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    held_between_tasks[HELD] = _loaded.clear
    _loaded[path].limit = cache_words
    return _loaded[path]
