"""Encoding by independent fragments, with a bounded cache of fragment codes in each Python worker.

A text is cut where no token can span the cut; the tokenizer's ids of the text are the fragments' ids in a row.
Words repeat, so most fragments are looked up, the rest go through the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

from textloom.llm.common import trim

#: Bytes that a worker's cache of fragments takes at most, in two generations of half as much; ``release`` frees them.
CACHE_BYTES = 160 << 20
#: Longer fragments are not cached.
CACHE_LENGTH = 64
#: A dictionary slot and the headers of its string and bytes objects.
ENTRY_BYTES = 170
_ASCII_SPACE = r" \t\n\r\x0b\x0c"


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable character of each byte: printable Latin-1 stands for itself, the rest follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _ranges(chars: list[int]) -> str:
    """A regex class body of code points."""
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\U{chars[i]:08x}-\\U{chars[j]:08x}")
        i = j + 1
    return "".join(out)


class FragmentCodes(dict):
    """fragment -> its ids as native unsigned 32-bit integers in a bytes object.

    The dictionary is the young generation of the cache. When it is full it becomes the old one, and what is found there
    later is young again, so frequent fragments stay and the rest goes.
    """

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.held = 0
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.specials = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.byte_of = {c: b for b, c in byte_alphabet().items()}
        self.lowers = "Lowercase" in json.dumps(spec["normalizer"] or {})
        self.find = (self._word_pattern() if self.lowers else self._byte_pattern()).findall
        self.plain = re.compile("[a-zß-öø-ÿ]+" if self.lowers else " ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        # a line end, a word and symbols are pre-tokens of their own, and apostrophes are not among these symbols
        self.parts = None if self.lowers else re.compile("(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*]*)").fullmatch
        self.printable = {b: c for c, b in self.byte_of.items() if chr(b) != c}
        self.not_latin = re.compile("[^\x00-\xff]").search

    def _word_pattern(self) -> re.Pattern:
        """Cuts at ASCII white space, which the tokenizer drops, and between a Latin letter and a full stop or comma."""
        return re.compile(rf"[^{_ASCII_SPACE}.,]++(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,])|[^{_ASCII_SPACE}]++")

    def token_bytes(self, token: str) -> bytes:
        return bytes(self.byte_of[c] for c in token)

    def inner_pairs(self) -> set[tuple[int, int]]:
        """All byte pairs that stand inside some token of the vocabulary."""
        found: set[tuple[int, int]] = set()
        for token in self.vocab:
            b = self.token_bytes(token)
            found.update(zip(b, b[1:], strict=False))
        return found

    def _byte_pattern(self) -> re.Pattern:
        """Forced boundaries: cuts at byte pairs that stand inside no token.

        Of these only such are used that also are boundaries of the pre-tokenizer whatever surrounds them: before white
        space that follows other characters, and between a Latin letter and a full stop or comma.
        """
        pairs = self.inner_pairs()
        last = lambda c: chr(c).encode()[-1]
        before_space = {a for a, b in pairs if b in b" \t\n\r\x0b\x0c"}
        before_stop = {a for a, b in pairs if b in b".,"}
        # wider white space starts with a byte of its own; it is not cut before
        ends = [c for c in [*range(0x21, 0x7F), *range(0xA1, 0xD800)] if not chr(c).isspace() and last(c) not in before_space]
        letters = [c for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7) and last(c) not in before_stop]
        ends_class, letter_class, both_class = _ranges(ends), _ranges(letters), _ranges(sorted(set(ends) & set(letters)))
        # runs that end in no sure cut are held together with what follows
        held = rf"(?:\S++(?:(?<![{ends_class}])|(?=[^{_ASCII_SPACE}\S]))\s++)++\S*+"
        # most words end in a letter that is sure before white space too, and are found by the first branch
        word = rf"\s*+[^\s.,]++(?:(?<=[{both_class}])(?=[.,{_ASCII_SPACE}]|\Z)|(?<=[{letter_class}])(?=[.,]))"
        return re.compile(rf"{word}|\s*+{held}|\s*+\S++|\s++")

    def __missing__(self, fragment: str) -> bytes:
        code = self.old.get(fragment)
        if code is None:
            if self.plain(fragment):  # one pre-token without anything to normalise: the model alone decides
                # of ASCII only the blank is printed as another character
                printed = fragment.replace(" ", self.printable[32]) if fragment.isascii() else fragment.encode().decode("latin-1").translate(self.printable)
                code = array("I", [t.id for t in self.model.tokenize(printed)]).tobytes()
            elif self.parts and (found := self.parts(fragment)):
                code = b"".join(self[part] for part in found.groups() if part)
            else:
                code = array("I", self.tokenizer.encode(fragment, add_special_tokens=False).ids).tobytes()
        if len(fragment) <= CACHE_LENGTH:
            self.held += ENTRY_BYTES + len(fragment) + len(code)
            if self.held > CACHE_BYTES // 2:
                self.old, self.held = dict(self), 0
                self.clear()
            self[fragment] = code
        return code

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, four bytes each; null is empty."""
        if not text:
            return b""
        if self.lowers and (text.isascii() or not self.not_latin(text)):
            text = text.lower()  # Latin-1 is stable under the tokenizer's normal form, so this only merges cache entries
        return b"".join(map(self.__getitem__, self.find(text)))


@lru_cache(maxsize=1)
def codes(path: str) -> FragmentCodes:
    """This worker's codes of a tokenizer file."""
    return FragmentCodes(path)


def release() -> None:
    """Free the codes that an earlier operator's tasks left in this worker; every other operator's tasks begin with it."""
    if codes.cache_info().currsize:
        codes.cache_clear()
    trim()
