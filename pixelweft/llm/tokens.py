"""Encoding of whole texts with a public tokenizer, word by word through a cache.

The vocabularies that these operators take (word_bpe_49k) drop white space before the pair merges, so a token never
crosses a blank: the ids of a text are the ids of its blank-separated words, one after the other. Each distinct word is
therefore encoded once and looked up after that; new words of a batch go to the tokenizer together. `WordEncoder` checks
on creation that the vocabulary behaves so and otherwise encodes whole texts.
"""

from __future__ import annotations

import os

#: Words kept in each of the two generations of the cache, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS = 450_000, 48
#: Characters of text whose new words are looked up together.
BATCH_CHARS = 1 << 20

_TAIL = ".,;:!?*$&%#)|"
_PROBES = ("One two's, THREE!?\n\tfour  five", "x<|endoftext|> y ź İI 12 3", " a\r\nb ́c it's 'll", "ÉTÉ, Über. ΟΔΟΣ! क़ a1.", "")


class WordEncoder:
    """many(texts) gives the little-endian ids of each text, 32 bits each, without special tokens being added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self._tokenizer, self._np = Tokenizer.from_file(path), np
        names = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(names.values()) + 1, bool)
        self._ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._cache: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self.by_word = all(self._split_and_join([x]) == [self._whole(x)] for x in _PROBES)

    def _whole(self, text: str) -> bytes:
        return self._np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, from one call: each ends with the one token that closes a word."""
        ids = self._np.array(self._tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = self._np.flatnonzero(self._ends[ids]) + 1
        if len(ends) != len(words) or len(ends) and ends[-1] != len(ids):
            return [self._whole(w) for w in words]
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, new: set[str]) -> None:
        """Put new words in the cache. Letters with a tail of signs are two pre-tokens at least, so these are encoded apart."""
        cache = self._cache
        if len(cache) + len(new) > CACHE_WORDS:
            self._old, self._cache = cache, {}
            cache = self._cache
        parts, cores = [], set()
        for word in new:
            found = self._old.get(word)
            if found is not None:
                cache[word] = found
                continue
            core = word.rstrip(_TAIL)
            if not core.isalpha() or len(core) > CACHE_CHARS:
                cache[word] = self._whole(word)
                continue
            if "\u03a3" not in core and len(low := core.lower()) == len(core):  # else left to the tokenizer's own folding
                core = low
            parts.append((word, core))
            if core not in cache:
                cores.add(core)
        todo = list(cores)
        cache.update(zip(todo, self._together(todo)))
        for word, core in parts:
            tail = word[len(core):]
            if tail:
                if tail not in cache:
                    cache[tail] = self._whole(tail)
                cache[word] = cache[core] + cache[tail]
            else:
                cache[word] = cache[core]

    def _split_and_join(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            for blank in "\n\t\r":
                if blank in text:
                    text = text.replace(blank, " ")
            split.append(text.split(" "))
        self._learn(set().union(*split).difference(self._cache))
        get = self._cache.get
        try:
            return [b"".join(map(get, words)) for words in split]
        except TypeError:  # the cache was begun anew: some words were only in the generation before
            self._learn(set().union(*split).difference(self._cache))
            get, old = self._cache.__getitem__, self._old
            return [b"".join(self._cache[w] if w in self._cache else old[w] for w in words) for words in split]

    def many(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self._whole(t) for t in texts]
        out, now, chars = [], [], 0
        for text in texts:
            now.append(text)
            chars += len(text)
            if chars >= BATCH_CHARS:
                out += self._split_and_join(now)
                now, chars = [], 0
        return out + self._split_and_join(now) if now else out

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.many(texts)]


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
