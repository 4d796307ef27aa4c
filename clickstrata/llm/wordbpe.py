"""Token ids of a word-level BPE vocabulary, one vocabulary look-up per distinct word.

The tokenizer lower-cases, drops white space and encodes each pre-token on its own, so the ids of a text are the
ids of its pre-tokens, one after the other. Each worker keeps the ids of words it has met; the library encodes new
words, and whole texts that hold a special string or characters outside the plain ranges below.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

#: Latin-1 and Latin Extended-A without the dotted capital I, dashes, quotes and the euro sign. In these
#: ranges lower-casing is character by character and normalisation changes nothing.
UNUSUAL = re.compile("[^\\x00-\\u012f\\u0131-\\u017f\\u2010-\\u2027\\u20ac]")
LETTER, DIGIT, SPACE = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
#: Fixed value: the tokenizer's own split pattern, over the plain ranges.
PIECE = re.compile(f"[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
#: Words kept per worker, and the longest that are.
KEEP, KEEP_CHARS = 800_000, 48


class WordTokens:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # words that are cut out already need neither normalising nor the split pattern
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer = None
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens: encoded as one text, cut where a token ends its word."""
        joined = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4").tobytes()
        cuts = ((np.flatnonzero(self.ends[np.frombuffer(joined, "<u4")]) + 1) * 4).tolist()
        if len(cuts) != len(words):
            raise ValueError("the vocabulary does not end each word with an end-of-word token")
        return {w: joined[a:b] for w, a, b in zip(words, [0, *cuts], cuts, strict=False)}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text, without begin or end tokens."""
        if UNUSUAL.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        words = PIECE.findall(text.lower())
        known = self.known
        parts: list = list(map(known.get, words))
        if None in parts:
            gaps, at = [], -1
            for _ in range(parts.count(None)):
                at = parts.index(None, at + 1)
                gaps.append(at)
            made = self.new(list(dict.fromkeys([words[i] for i in gaps])))
            for i in gaps:
                parts[i] = made[words[i]]
            if len(known) + len(made) > KEEP:
                known.clear()
            known.update((w, p) for w, p in made.items() if len(w) <= KEEP_CHARS)
        return b"".join(parts)


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's own WordTokens for a vocabulary file; loaded once, its words kept between tasks."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = WordTokens(path)
    return _loaded[path]
