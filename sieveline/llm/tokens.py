"""Byte-level BPE ids through the tokenizers library, with a bounded cache of pieces between spaces.

The vocabulary's pattern lets a space join only the piece after it, so a text without white space runs that
hold an inner space splits before each space into parts that are encoded independently. Such parts repeat,
and their ids are kept per Python worker; other texts are encoded whole. So are all texts where the vocabulary's
file is not of the kind that this holds for.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import islice

#: Parts kept per Python worker unless the caller says otherwise, about 250 bytes each. Beyond them the later half goes: frequent parts come early.
CACHE_PARTS = 800_000
#: Parts longer than this are not kept.
CACHE_CHARS = 40

_RUN = re.compile(r"\s \s|\s $|^ \s")
#: Letters, then marks that neither start a contraction nor the added token.
_TAIL = re.compile(r"( ?[^\W\d_]+)([!-&(-/:;=?@\[-`{-~]+)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def separable(config: dict) -> bool:
    """Whether a tokenizer's own file says that parts between spaces can be encoded by themselves: byte-level BPE with the usual pattern, nothing before or behind it, added tokens that begin with < alone."""
    before, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    return (
        not any(config.get(k) for k in ("normalizer", "truncation", "padding", "post_processor"))
        and before.get("type") == "ByteLevel"
        and before.get("add_prefix_space") is False
        and before.get("use_regex") is True
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(t["content"].startswith("<") and not t["lstrip"] and not t["rstrip"] for t in config.get("added_tokens") or ())
        and set(_byte_letters().values()) <= set(model.get("vocab") or ())
    )


def _edged(part: str) -> bool:
    return not part or part[0].isspace() or part[-1].isspace()


class Encoder:
    """Little-endian unsigned 32-bit ids of texts; add_special_tokens is off."""

    def __init__(self, path: str, parts: int | None = None):
        from tokenizers import Tokenizer

        self.parts = CACHE_PARTS if parts is None else parts

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        with open(path, encoding="utf-8") as file:
            self.by_parts = separable(json.load(file))
        self.cache: dict[str, bytes] = {}  # ids of " " + part
        self.edges: dict[str, bytes] = {}  # the same of parts that are empty, or begin or end with white space
        self.bare: dict[str, bytes] = {}  # ids of part, without a space before it

    def _direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, piece: str) -> bytes:
        """Ids of what the pattern leaves whole."""
        named = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def _split(self, part: str) -> bytes:
        """Ids of a part, which is cut where the pattern always cuts: at a line break between two non-spaces, and between letters and marks."""
        word = part[1:] if part[0] == " " else part
        if word.isalpha() and max(word) < "\u0250":
            return self._merged(part)
        if "<" in part:  # may hold the added token
            return self._direct(part)
        left, found, right = part.partition("\n")
        if found and left and right and not left[-1].isspace() and not right[0].isspace():
            return self._part(left) + self._part("\n") + self._part(right)
        if m := _TAIL.fullmatch(part):
            return self._part(m[1]) + self._part(m[2])
        return self._direct(part)

    def _part(self, part: str) -> bytes:
        """Ids of a part that may begin with a space."""
        if part[0] == " ":
            return self.cache.get(part[1:]) or self._spaced(part[1:])
        ids = self.bare.get(part)
        if ids is None:
            ids = self._split(part)
            if len(part) <= CACHE_CHARS:
                if len(self.bare) >= self.parts // 8:
                    self.bare.clear()
                self.bare[part] = ids
        return ids

    def _spaced(self, part: str) -> bytes:
        kept = self.edges if _edged(part) else self.cache
        ids = kept.get(part)
        if ids is None:
            ids = self._split(" " + part)
            if len(part) <= CACHE_CHARS:
                if len(kept) >= self.parts:
                    for old in list(islice(reversed(kept), self.parts // 2)):
                        del kept[old]
                kept[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_parts:
            return self._direct(text)
        first, *rest = text.split(" ")
        ids = list(map(self.cache.get, rest))
        try:
            return (self._part(first) if first else b"") + b"".join(ids)
        except TypeError:  # some are not kept
            unknown = [k for k, i in enumerate(ids) if i is None]
        # where a run holds an inner space, parts on both its sides have edges of white space, which are never in the cache
        if any(_edged(rest[k]) for k in unknown) and _RUN.search(text):
            return self._direct(text)
        for k in unknown:
            ids[k] = self._spaced(rest[k])
        return (self._part(first) if first else b"") + b"".join(ids)


_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, parts: int | None = None) -> Encoder:
    """One encoder for each Python worker, vocabulary and number of parts kept."""
    if (path, parts) not in _encoders:
        _encoders[path, parts] = Encoder(path, parts)
    return _encoders[path, parts]
