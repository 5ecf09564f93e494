"""Whole-text tokenisation with the tokenizers library behind exact worker-side caches.

A byte-pair model works on one pre-token at a time, so a text's ids are its pre-tokens' ids put
together. The caches below hold the library's own answers for space-delimited chunks; texts outside
the plain alphabet for which the cut at spaces is known to agree with the library's pre-tokeniser
(other scripts, special-token strings, odd white space) go to the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Code points below this may take the cached path.
PLAIN_END = 0x250
#: Entries a cache holds before it drops those not used since the last drop.
CACHE_ENTRIES = 800_000


def _ranges(test) -> str:
    points = [c for c in range(PLAIN_END) if test(unicodedata.category(chr(c))[0])]
    out, i = "", 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out += re.escape(chr(points[i])) + (f"-{re.escape(chr(points[j]))}" if j > i else "")
        i = j + 1
    return out


_L, _N, _S = _ranges(lambda c: c == "L"), _ranges(lambda c: c == "N"), "\\t-\\r \\x85\\xa0"
#: Outside the plain alphabet: higher code points, the separators U+001C-1F, and U+0130, whose lower case is two characters.
_ODD = re.compile(f"[^\\x00-\\x1b\\x20-\\u012f\\u0131-{chr(PLAIN_END - 1)}]")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_SPLIT = re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_SPLIT = re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_EDGE = re.compile(f"^(?=[{_S}])|[{_S}]$|^$")
_BYTE_CHARS: list[str] = []


def _visible(word: str) -> str:
    """The byte-level alphabet of byte-pair models: each UTF-8 byte as one printable character."""
    if not _BYTE_CHARS:
        extra = 0
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                _BYTE_CHARS.append(chr(b))
            else:
                _BYTE_CHARS.append(chr(256 + extra))
                extra += 1
    return "".join([_BYTE_CHARS[b] for b in word.encode()])


def _plain(word: str) -> str:
    """``_visible`` with a short way for ASCII words after at most one space."""
    tail = word[1:] if word[:1] == " " else word
    if tail.isascii() and tail.isalnum():
        return word if len(tail) == len(word) else "\u0120" + tail
    return _visible(word)


class Codec:
    """Answers of a tokenizer file for whole texts, in batches.

    ``value`` makes an answer of a pre-token's list of tokens, ``put_together`` one of several answers.
    """

    def __init__(self, path: str, split: re.Pattern, prefix: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.findall, self.prefix = split.findall, prefix
        self.words, self.chunks = {}, {}

    def _learn(self, new: set[str], needed: list[str]) -> None:
        """Put the answers for new chunks into the cache, asking the library for pre-tokens not met before.
        A full cache starts again with what the text at hand needs."""
        if len(self.chunks) + len(new) > CACHE_ENTRIES:
            self.chunks = {c: v for c in needed if (v := self.chunks.get(c)) is not None}
        self._learn_pieces(new)

    def _learn_pieces(self, new: set[str]) -> None:
        cache = self.chunks
        prefix, findall = self.prefix, self.findall
        pieces = [findall(prefix + c) for c in new]
        wanted = {w for p in pieces for w in p}
        if len(self.words) + len(wanted) > CACHE_ENTRIES:
            self.words = {w: v for w in wanted if (v := self.words.get(w)) is not None}
        words, tokenize, value = self.words, self.model.tokenize, self.value
        for w in wanted:
            if w not in words:
                words[w] = value(tokenize(_plain(w)))
        get, together = words.__getitem__, self.put_together
        cache.update([(c, get(p[0]) if len(p) == 1 else together(map(get, p))) for c, p in zip(new, pieces, strict=True)])

    def odd(self, text: str) -> bool:
        return _ODD.search(text) is not None or any(s in text for s in self.special)


class IdEncoder(Codec):
    """Ids of whole texts, as bytes of little-endian unsigned 16-bit (or, for large vocabularies, 32-bit) integers."""

    put_together = staticmethod(b"".join)

    def __init__(self, path: str):
        super().__init__(path, _BYTE_SPLIT, " ")
        self.tails: dict[str, bytes] = {}
        self.code, self.dtype = ("H", "<u2") if self.whole.get_vocab_size() <= 65536 else ("I", "<u4")

    def value(self, tokens) -> bytes:
        return array(self.code, [t.id for t in tokens]).tobytes()

    def _learn(self, new: set[str], needed: list[str]) -> bool:
        """As above, with a short way for letters alone and letters with one other character after them: the
        letters with the space before them are one pre-token, and what follows is another. False if a chunk
        begins or ends with white space, where the cut at spaces doesn't agree with the library's."""
        if len(self.chunks) + len(new) > CACHE_ENTRIES:
            self.chunks = {c: v for c in needed if (v := self.chunks.get(c)) is not None}
        cache, tokenize, value, rest, tails = self.chunks, self.model.tokenize, self.value, [], self.tails
        for c in new:
            if c.isalpha():
                word, tail = c, b""
            elif (word := c[:-1]).isalpha():
                if (tail := tails.get(c[-1])) is None:
                    if _EDGE.search(c):
                        return False
                    tail = tails[c[-1]] = value(tokenize(_visible(c[-1])))
            else:
                rest.append(c)
                continue
            if (ids := cache.get(word)) is None:
                ids = cache[word] = value(tokenize("\u0120" + word if word.isascii() else _visible(" " + word)))
            if tail:
                cache[c] = ids + tail
        if any(map(_EDGE.search, rest)):
            return False
        if rest:
            self._learn_pieces(set(rest))
        return True

    def _slow(self, text: str) -> bytes:
        return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._encode(t) for t in texts]

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd(text):
            return self._slow(text)
        chunks = text.split(" ")
        first = chunks.pop(0)
        if chunks and _EDGE.search(first):
            return self._slow(text)
        try:
            rest = b"".join(map(self.chunks.__getitem__, chunks))
        except KeyError:
            cache = self.chunks
            new = {c for c in chunks if c not in cache}
            if not self._learn(new, chunks):
                return self._slow(text)
            rest = b"".join(map(self.chunks.__getitem__, chunks))
        return self._first(first) + rest

    def _first(self, chunk: str) -> bytes:
        """The first chunk of a text has no space before it."""
        words, out = self.words, []
        for w in self.findall(chunk):
            v = words.get(w)
            out.append(self.value(self.model.tokenize(_plain(w))) if v is None else v)
        return b"".join(out)


class LengthCounter(Codec):
    """Token counts of whole texts for a lower-casing word-end tokenizer file.

    ``frequent`` is the first tier, a table of chunk lengths that every worker gets; chunks outside
    it are encoded by the library once and kept in the worker's own cache, the second tier.
    """

    put_together = staticmethod(sum)
    value = staticmethod(len)

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        super().__init__(path, _WORD_SPLIT, "")
        self.frequent = frequent or {}

    def count(self, texts: list[str]) -> list[int]:
        return [self._count(t) for t in texts]

    def _count(self, text: str) -> int:
        if not text:
            return 0
        if self.odd(text):
            return len(self.whole.encode(text, add_special_tokens=False))
        chunks = text.lower().split()
        known = list(map(self.frequent.get, chunks))
        rest = [c for c, n in zip(chunks, known, strict=True) if n is None]
        total = sum(filter(None, known))
        try:
            return total + sum(map(self.chunks.__getitem__, rest))
        except KeyError:
            cache = self.chunks
            self._learn({c for c in rest if c not in cache}, rest)
            return total + sum(map(self.chunks.__getitem__, rest))
