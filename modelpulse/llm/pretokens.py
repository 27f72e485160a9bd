"""Texts to pre-tokens for a word-level BPE file of the tokenizers library."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import regex
from tokenizers import Tokenizer

#: Blanks that str.split() takes as such and \s of the pattern doesn't.
ODD_BLANKS = regex.compile("[\x1c-\x1f]")

BELOW_CD = bytes(range(0xCD))


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def unnamed_characters() -> str:
    """Pattern for the characters that this Python's Unicode doesn't have."""
    ranges, start = [], None
    for code in range(0x110001):
        unnamed = code < 0x110000 and unicodedata.category(chr(code)) == "Cn"
        if unnamed and start is None:
            start = code
        elif not unnamed and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return f"[{''.join(ranges)}]"


class PreTokenizer:
    """Special strings, normal form and split pattern of a tokenizer file.

    Reads the forms that word-level BPE files use: normalizers NFC, Replace of blanks by a
    space, Lowercase; a Split pattern whose matches are the pre-tokens, then bytes. Another
    form is an error.
    """

    def __init__(self, spec: dict):
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("normalizer of another form")
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if split["behavior"] != "Removed" or not split["invert"] or byte_level["type"] != "ByteLevel":
            raise ValueError("pre-tokenizer of another form")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        bare = {"type": "BPE", "vocab": {}, "merges": []}
        self.rules = json.dumps({**spec, "model": bare, "added_tokens": [], "post_processor": None})
        self.unnamed = re.compile(unnamed_characters())
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ordered = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, ordered))) if ordered else None

    def has_unnamed(self, text: str) -> bool:
        # Unnamed characters begin above U+0340, so their first byte is at least CD.
        if text.isascii() or not text.encode("utf-8").translate(None, BELOW_CD):
            return False
        return self.unnamed.search(text) is not None

    def segments(self, text: str) -> Iterator[str | int]:
        """Ordinary stretches as text, special strings as their id."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            yield text
            return
        at = 0
        for match in self.special_pattern.finditer(text):
            yield text[at : match.start()]
            yield self.special[match[0]]
            at = match.end()
        yield text[at:]

    def chunks(self, segment: str) -> list[str]:
        """Stretches without blanks, in normal form. No pre-token reaches over a blank.

        The libraries at hand know different versions of Unicode. A text with characters that
        Python has no name for goes through the rules of the tokenizer file itself.
        """
        if self.has_unnamed(segment):
            return Tokenizer.from_str(self.rules).normalizer.normalize_str(segment).split(" ")
        # Lower case goes character by character: a final sigma is like any other.
        text = unicodedata.normalize("NFC", segment).replace("Σ", "σ").lower()
        return self.pattern.findall(text) if ODD_BLANKS.search(text) else text.split()

    def split(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        if self.has_unnamed(chunk):
            pieces = Tokenizer.from_str(self.rules).pre_tokenizer.pre_tokenize_str(chunk)
            return [chunk[a:b] for _, (a, b) in pieces]
        return self.pattern.findall(chunk)
