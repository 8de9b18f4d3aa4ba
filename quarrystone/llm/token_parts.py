"""Texts as parts that a tokenizer encodes alike alone and in place, and a bounded cache of the parts' ids.

A part ends before each space that stands alone between two characters that are no space. The byte-level pattern of the
public tokenizers never matches over such a place, and no entry of the piece vocabulary holds a space mark after another
character (which is checked when it is read), so ids of a text are the ids of its parts, one after another.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np

from .common import KNOWN_PATTERN, UNUSUAL

_CUT = re.compile(r"(?<! ) (?=\S)")
_UNEVEN = re.compile(r"^\s| \s| $")
#: The mark that stands for a space in piece vocabularies.
MARK = "▁"


def stretches(text: str, size: int = 1_000_000) -> Iterator[str]:
    """The text in stretches of about so many characters that a byte-level tokenizer encodes alike alone and in place."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def spaced_parts(text: str) -> list[str]:
    """The parts of a space and the text, each without the space that it starts with."""
    if _UNEVEN.search(text) is None:
        return text.split(" ")
    first, *rest = _CUT.split(" " + text)
    return [first[1:], *rest] if first else rest


class Cache:
    """Ids of parts under several encoders: parts are numbered, their ids lie in one flat array for each encoder.

    When it holds more than limit parts it forgets all but the third that was used most.
    """

    def __init__(self, encoders: Sequence[Callable[[list[str]], list[list[int]]]], limit: int = 300_000) -> None:
        self._encoders, self._limit = encoders, limit
        self._number: dict[str, int] = {}
        self._uses = np.zeros(0, np.int64)
        self._flat = [array.array("i") for _ in encoders]
        self._ends = [array.array("q", [0]) for _ in encoders]

    def full(self) -> bool:
        return len(self._number) > self._limit

    def numbered(self, keys: list[str]) -> tuple[np.ndarray, list[str]]:
        """(the number of each part, the parts that were unknown); the latter are encoded together."""
        found, unknown = list(map(self._number.get, keys)), []
        if None in found:
            unknown = [k for k in dict.fromkeys(keys) if k not in self._number]
            self._number.update(zip(unknown, range(len(self._number), len(self._number) + len(unknown)), strict=True))
            for encode, flat, ends in zip(self._encoders, self._flat, self._ends, strict=True):
                for ids in encode(unknown):
                    flat.extend(ids)
                    ends.append(len(flat))
            found = list(map(self._number.__getitem__, keys))
        numbers = np.array(found, dtype=np.int64)
        uses = np.bincount(numbers, minlength=len(self._number))
        uses[: len(self._uses)] += self._uses
        self._uses = uses
        return numbers, unknown

    def forget(self) -> np.ndarray:
        """The old numbers of the parts that stay, in their new order."""
        kept = np.sort(np.argsort(-self._uses, kind="stable")[: self._limit // 3])
        names = list(self._number)
        for which in range(len(self._encoders)):
            flat, count = self.gathered(which, kept)
            self._flat[which], self._ends[which] = array.array("i", flat.tolist()), array.array("q", [0, *np.cumsum(count).tolist()])
        self._number = {names[i]: k for k, i in enumerate(kept.tolist())}
        self._uses = self._uses[kept]
        return kept

    def gathered(self, which: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts one after another, how many each part has)."""
        ends, flat = np.frombuffer(self._ends[which], np.int64), np.frombuffer(self._flat[which], np.int32) if self._flat[which] else np.zeros(0, np.int32)
        start, count = ends[numbers], ends[numbers + 1] - ends[numbers]
        at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        return flat[at], count


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, as letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer from its JSON file. plain: strings of special tokens inside texts are ordinary text.

    Where its merges are in the order of their ids, texts of ordinary letters go to the faster library, with the same
    vocabulary; texts with special tokens, or with letters whose classes the libraries' tables may tell apart, do not.
    """

    def __init__(self, file: str, plain: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self._coder, model = Tokenizer.from_file(file), json.loads(Path(file).read_text(encoding="utf-8"))
        self._coder.encode_special_tokens = plain
        special = {t["id"]: t["content"] for t in model["added_tokens"]}
        letters, held, pairs = _byte_of_letter(), model["model"]["vocab"], model["model"]["merges"]
        self._bytes = [b""] * (max([*held.values(), *special]) + 1)
        for token, i in held.items():
            self._bytes[i] = special[i].encode() if i in special else bytes(map(letters.__getitem__, token))
        merged = [held["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in pairs]
        self._special = [] if plain else list(special.values())
        self._fast = _ranked({t: i for i, t in enumerate(self._bytes) if i not in special}) if merged == sorted(merged) else None

    def ids(self, text: str) -> list[int]:
        if self._fast is None or UNUSUAL.search(text) or any(s in text for s in self._special):
            return self._coder.encode(text, add_special_tokens=False).ids
        return self._fast(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return list(map(self.ids, texts))

    def spaced(self, keys: list[str]) -> list[list[int]]:
        return self.encode([" " + k for k in keys])

    def token_bytes(self) -> list[bytes]:
        return self._bytes


def _ranked(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    import tiktoken

    return tiktoken.Encoding("ranked", pat_str=KNOWN_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pieces:
    """A piece tokenizer from its model file, which puts a space before a text."""

    def __init__(self, file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._coder = SentencePieceProcessor(model_file=file)
        names = [self._coder.id_to_piece(i) for i in range(self._coder.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("an entry of the vocabulary goes over the start of a word; texts cannot be encoded in parts")
        self._bytes = [bytes([int(p[3:-1], 16)]) if self._coder.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]

    def spaced(self, keys: list[str]) -> list[list[int]]:
        return self._coder.encode(keys, num_threads=1)

    def token_bytes(self) -> list[bytes]:
        return self._bytes


@functools.cache
def byte_level(file: str) -> ByteLevel:
    """One tokenizer for each worker process; special tokens' strings become special tokens."""
    return ByteLevel(file, plain=False)


def document_ids(text: str | None, file: str, end: int = 0) -> np.ndarray:
    """The ids of a text as little-endian unsigned 32-bit numbers, then the id end; a null text is an empty one."""
    return np.concatenate([np.array(ids, "<u4") for ids in [*map(byte_level(file).ids, stretches(text or "")), [end]]])
