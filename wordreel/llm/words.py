"""How a tokenizer file with word ends cuts a text into words.

The cutting is done by a regular expression, on normalised text, several times
faster than by the tokenizers library. Both follow Unicode, but not the same
version of it, so code points that they treat differently are found first (`odd`,
on the driver, by asking both about every code point of the first two planes);
texts that hold one of them, or one of a higher plane, are cut by the library
itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 20       # code points of a text that are cut into words together

EXAMINED = 0x20000      # code points from here on always go to the library
_SURROGATES = range(0xD800, 0xE000)
_SEPARATOR = "|"        # stands alone: no letter, no digit, never composed


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _lower(text: str) -> str:
    """Composed and lower-cased letter by letter: a final capital sigma has no form of its own."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _pattern(path: str) -> str:
    """The word pattern that the file names for its first splitting step."""
    spec = json.load(open(path, encoding="utf-8"))
    return spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


class _Library:
    """The file's own normaliser and splitter."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.normal, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.bytes = byte_of_char()

    def words(self, text: str) -> list[str]:
        return [bytes(map(self.bytes.__getitem__, w)).decode("utf-8")
                for w, _ in self.cut(self.normal(text))]


@functools.lru_cache(maxsize=4)
def odd(path: str) -> str:
    """Code points below `EXAMINED` that the library normalises or classes otherwise than Python."""
    import regex
    from tokenizers import normalizers

    library, find = _Library(path), regex.compile(_pattern(path)).findall
    chars = [chr(c) for c in range(EXAMINED) if c not in _SURROGATES and chr(c) != _SEPARATOR]
    found: set[str] = set()
    spaces = regex.compile(r"\s+")

    def normal(text: str) -> str:
        return _lower(spaces.sub(" ", unicodedata.normalize("NFC", text)))

    # alone, and between marks that change places around it if it is a mark itself
    for before, after in (("", ""), ("e̕", "̖")):
        line = _SEPARATOR.join(before + c + after for c in chars)
        ours, theirs = normal(line).split(_SEPARATOR), library.normal(line).split(_SEPARATOR)
        found.update(c for c, a, b in zip(chars, ours, theirs, strict=True) if a != b)
    line = _SEPARATOR.join(chars)
    ours = unicodedata.normalize("NFD", line).split(_SEPARATOR)
    theirs = normalizers.NFD().normalize_str(line).split(_SEPARATOR)
    for c, a, b in zip(chars, ours, theirs, strict=True):
        if a != b:
            found.update(c + a + b)
    # letter, digit, space or other: how often each is cut between two letters
    rest = [c for c in chars if c not in found]
    step = 1 << 9
    for i in range(0, len(rest), step):
        part = rest[i: i + step]
        line = " ".join(f"a{c}{c}a" for c in part)
        if find(normal(line)) != library.words(line):
            for c in part:
                if find(normal(f"a{c}{c}a")) != library.words(f"a{c}{c}a"):
                    found.add(c)
    return "".join(sorted(found - {_SEPARATOR}))


class Splitter:
    """text -> words as str; `odd` of the same file comes from the driver."""

    def __init__(self, path: str, odd_chars: str):
        import regex

        self.find = regex.compile(_pattern(path)).findall
        self.odd = np.zeros(EXAMINED + 1, bool)
        self.odd[[*map(ord, odd_chars), EXAMINED]] = True
        self.path, self.library = path, None

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if text.isascii():
            return self.find(text.lower())
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if self.odd[np.minimum(codes, EXAMINED)].any():
            self.library = self.library or _Library(self.path)
            return self.library.words(text)
        return self.find(_lower(text))


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Pieces of about `size` code points, cut before a space; no word goes over a cut."""
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]
