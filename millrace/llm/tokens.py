"""Whole texts to token ids with the tokenizers library, each distinct word encoded once per worker.

A tokenizer of these files looks at words apart: text cut where no rule reaches across gives the same ids.
For byte-level files such a place is a single space, or a single line feed, between characters that are no white
space; for files that drop white space it is any space or line feed. A text that spells one of the file's special tokens, which
the library takes out of a text wherever it stands, goes to the library whole. The two caches only save time: each is emptied when full.

A new word that ends in punctuation behind a letter or digit is its stem's ids and the punctuation's, and where the file lowers
case, words that differ in it share a stem: fewer words reach the library. Words of small Latin letters alone are one piece to such
a file's rules, so they go to the same model without its normaliser and pattern."""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words kept after a second sight, and words seen once.
OLD_WORDS = 500_000
YOUNG_WORDS = 450_000
#: What keeps a text from being cut at every space or line feed: runs of them, and white space of other kinds.
_IRREGULAR = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Punctuation that the files' patterns always part from a letter or digit before it, and the end of the blocks whose letters and digits are old enough for every library's tables.
_TAIL = ".,;:!?"
_OLD_BLOCKS = "\u0530"
_DOTTED = "\u0130"  # its small form ends in a mark, which a pattern puts with the punctuation
#: Words that Python and the library lower alike, and words that are one piece, the same in every normal form.
_LATIN = re.compile("[!-\xff]+").fullmatch
_PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
_ROW = 100


class WordEncoder:
    """ids(texts) as little-endian unsigned 32-bit bytes, equal to the library's whole-text encoding without special tokens."""

    def __init__(self, path: str, byte_level: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()) or any(re.search(r"\s", m) for m in marks):
            raise ValueError("special tokens that are normalized or hold white space are not supported")
        self.opening = os.path.commonprefix(marks)
        self.marks = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True))) or r"\b\B")
        self.byte_level = byte_level
        self.cache: dict[str, bytes] = {}  # words seen once
        self.old: dict[str, bytes] = {}  # words seen again
        self.tails: dict[str, bytes] = {}  # _TAIL's runs of up to 8 characters
        vocabulary = self.tokenizer.get_vocab()
        self.bar = vocabulary.get("|</w>", -1)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # how these files write a space
        self.closes = np.zeros(len(self.opens), bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.lowers = not byte_level and self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A\xc9") == "a\xe9"
        self.bare = None
        if self.lowers and self.tokenizer.model.end_of_word_suffix == "</w>":
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _alone(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _stem(self, word: str) -> tuple[str, str]:
        """The word that is looked up for word, and the punctuation that follows it."""
        stem, tail = word.rstrip(_TAIL), ""
        if stem and len(stem) < len(word) <= len(stem) + 8 and stem[-1].isalnum() and stem[-1] < _OLD_BLOCKS and stem[-1] != _DOTTED:
            tail = word[len(stem) :]
            if tail not in self.tails:
                self.tails[tail] = self._alone([tail])[0]
        else:
            stem = word
        if self.lowers and _LATIN(stem):
            low = stem.lower()
            stem = stem if self.opening in low else low  # a special token is one in its own case only
        return stem, tail

    def _meet(self, words: dict[str, None]) -> None:
        """Puts words that are not in old into the cache, those seen once before into old as well."""
        young, old = self.cache, self.old
        again, new, made = {}, {}, []
        for w in words:
            known = young.get(w)
            if known is not None:
                again[w] = known
                continue
            stem, tail = self._stem(w)
            if stem != w:
                made.append((w, stem, tail))
                if stem in old:
                    continue
                known = young.get(stem)
                if known is not None:
                    again[stem] = known
                    continue
            new[stem] = None
        old.update(again)
        self._learn(list(new))
        for w, stem, tail in made:
            known = old.get(stem)
            known = young[stem] if known is None else known
            young[w] = known + self.tails[tail] if tail else known

    def _learn(self, words: list[str]) -> None:
        """Encode new words together: in a row, told apart by the space that opens each, by the end that closes each, or by a bar between them."""
        if self.bare is not None:
            plain, other = [], []
            for w in words:
                (plain if _PLAIN(w) else other).append(w)
            self._learn_rows(plain, self.bare, " ".join, self.closes, str)
            words = other
        spaced = (lambda w: w if w[:1] == "\n" else " " + w) if self.byte_level else str
        apart = [w for w in words if w.strip() != w or " " in w or "\n" in w or not w] if self.byte_level else [w for w in words if "|" in w or not w]
        self.cache.update(zip(apart, self._alone([spaced(w) for w in apart]), strict=True))
        apart_set = set(apart)
        plain = [w for w in words if w not in apart_set]
        if self.byte_level:
            self._learn_rows(plain, self.tokenizer, lambda g: " " + " ".join(g), None, spaced)
        else:
            self._learn_rows(plain, self.tokenizer, " | ".join, None, spaced)

    def _learn_rows(self, words: list[str], tokenizer, row, closes: np.ndarray | None, spaced) -> None:
        groups = [words[i : i + _ROW] for i in range(0, len(words), _ROW)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([row(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            if closes is not None:
                ends = np.flatnonzero(closes[ids]) + 1
                begins = np.append(0, ends[:-1])
            elif self.byte_level:
                begins = np.flatnonzero(self.opens[ids])
                ends = np.append(begins[1:], len(ids))
            else:
                cuts = np.flatnonzero(ids == self.bar)
                begins, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
            if len(begins) != len(group) or len(ends) != len(group):
                self.cache.update(zip(group, self._alone([spaced(w) for w in group]), strict=True))
                continue
            raw = ids.tobytes()
            self.cache.update((w, raw[4 * i : 4 * j]) for w, i, j in zip(group, begins.tolist(), ends.tolist(), strict=True))

    def _words(self, text: str) -> list[str]:
        if not self.byte_level:
            return text.replace("\n", " ").split(" ")
        if text[:1].isspace() or text[-1:].isspace() or any(map(text.__contains__, _IRREGULAR)):
            return _CUT.split(text)
        return text.replace("\n", " \n").split(" ")

    def ids(self, texts: list[str]) -> list[bytes]:
        marked = {i for i, t in enumerate(texts) if self.opening in t and self.marks.search(t)}
        if marked:
            out = self._ids(["" if i in marked else t for i, t in enumerate(texts)])
            for i, found in zip(sorted(marked), self._alone([texts[i] for i in sorted(marked)]), strict=True):
                out[i] = found
            return out
        return self._ids(texts)

    def _ids(self, texts: list[str]) -> list[bytes]:
        parts = [self._words(t) for t in texts]
        heads: list[bytes] = []
        if self.byte_level:  # a text's first word has no space before it
            heads = self._alone([p[0] for p in parts])
            parts = [p[1:] for p in parts]
        if len(self.old) > OLD_WORDS:
            self.old.clear()
        if len(self.cache) > YOUNG_WORDS:
            self.cache.clear()
        flat = list(chain.from_iterable(parts))
        found = list(map(self.old.get, flat))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            self._meet(dict.fromkeys([flat[i] for i in missing]))
            young = self.cache
            for i in missing:
                found[i] = young[flat[i]]
        out, at = [], 0
        for k, p in enumerate(parts):
            joined = b"".join(found[at : at + len(p)])
            out.append(heads[k] + joined if heads else joined)
            at += len(p)
        return out


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, byte_level: bool) -> WordEncoder:
    """One encoder per worker and file."""
    key = (path, byte_level)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(path, byte_level)
    return _encoders[key]
