"""Token encoding of whole texts with the tokenizers library, with a memo of pieces.

A text is first cut at places where the tokenizer's own pre-tokenizer always cuts, so each piece can be
encoded alone, once, and its ids joined. That holds for two kinds of tokenizer, recognised by their
configuration: byte-level BPE with its built-in pattern, and BPE over lower-cased words with white space
dropped. Texts that hold unusual white space or the marker of a special token, and tokenizers of any other
kind, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

MEMO_ENTRIES = 700_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_THEN = r"(?=[\x00-@\[-`{-\x7f]|\Z)"
_SPACE = r" \t\n\r\x0b\x0c"
_MARKS = r"!-/:-@\[-`{-~"
_BYTE_PIECES = re.compile(
    rf" ?[{_LETTERS}]+{_THEN}|(?!')(?: ?[{_MARKS}]+)(?=[{_SPACE}A-Za-z0-9]|\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_WORD_PIECES = re.compile(rf"[{_LETTERS}]+{_THEN}|(?!')[{_MARKS}]+(?=[{_SPACE}A-Za-z0-9]|\Z)|[^{_SPACE}]+")
#: White space and joiners outside ASCII's six, by code point.
_ODD_CODES = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_ODD = re.compile("[" + "".join(map(chr, _ODD_CODES)) + "]")
_NOT_LATIN = re.compile("[^\x00-\xff]")

_made: dict[str, Encoder] = {}


class Encoder:
    """texts -> the ids of each as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        self.special = [t["content"] for t in conf.get("added_tokens") or []]
        pre, norm = conf.get("pre_tokenizer") or {}, conf.get("normalizer") or {}
        self.lower = False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.split = _BYTE_PIECES.findall
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.split, self.lower = _WORD_PIECES.findall, True
        else:
            self.split = None

    def _pieces(self, text: str) -> list[str] | None:
        if self.split is None or _ODD.search(text) or any(s in text for s in self.special):
            return None
        return self.split(text.lower() if self.lower and not _NOT_LATIN.search(text) else text)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Memorise pieces. Runs of letters are encoded many at a time, as one text in which each is one word."""
        join, first = (" ", "") if self.lower else ("", " ")
        runs = [p for p in new if p[len(first) :].isalpha() and p.startswith(first)]
        for at in range(0, len(runs), 256):
            part = runs[at : at + 256]
            one = self.tokenizer.encode(join.join(part), add_special_tokens=False)
            ids, ends = np.array(one.ids, dtype="<u4").tobytes(), np.searchsorted(np.array(one.word_ids), np.arange(len(part) + 1)).tolist()
            if one.word_ids[-1] == len(part) - 1 and all(map(int.__lt__, ends, ends[1:])):
                self.memo.update((p, ids[4 * lo : 4 * hi]) for p, lo, hi in zip(part, ends, ends[1:], strict=False))
        rest = [p for p in new if p not in self.memo]
        for at in range(0, len(rest), 4096):
            self.memo.update(zip(rest[at : at + 4096], self._ids(rest[at : at + 4096]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        known, out, late = self.memo.__getitem__, [b""] * len(texts), {}
        for i, text in enumerate(texts):
            pieces = self._pieces(text)
            try:
                out[i] = self._ids([text])[0] if pieces is None else b"".join(map(known, pieces))
            except KeyError:  # a piece is new
                late[i] = pieces
        self._learn(list(set().union(*late.values()).difference(self.memo)))
        for i, pieces in late.items():
            out[i] = b"".join(map(known, pieces))
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def in_slices(texts: list[str], chars: int = 1 << 21):
    """Consecutive slices of about so many characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]
