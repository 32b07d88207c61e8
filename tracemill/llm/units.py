"""Texts as sequences of units that a BPE tokenizer encodes one by one, each distinct unit once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import binary_array, flat, text_bytes

#: Byte classes: white space, ASCII letter, ASCII punctuation (but for the apostrophe, which starts contractions), other.
SPACE, LETTER, PUNCTUATION, OTHER = 1, 2, 3, 0
CLASSES = np.array([SPACE if chr(c) in " \t\n\x0b\x0c\r" else LETTER if chr(c).isalpha() and c < 128 else PUNCTUATION if 32 < c < 127 and not chr(c).isdigit() and c != 39 else OTHER for c in range(256)], np.uint8)
#: Texts that the cuts below may change: special tokens, and white space outside ASCII, of which a tokenizer's
#: white-space run may be a part.
UNSAFE = "<\\||[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1C}-\\x{1F}]"
#: One piece for either tokenizer: Latin letters that no normaliser changes, after at most one space.
PLAIN = re.compile("(?: ?)[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Units that a worker remembers, twice.
REMEMBERED = 150_000


def cuts(raw: np.ndarray, offsets: np.ndarray, apart: bool = False) -> np.ndarray:
    """Where units begin: at each text, before white space that follows something else, and between ASCII letters and
    ASCII punctuation. No token of either tokenizer spans such a place. apart: after white space too, for a tokenizer
    that drops it."""
    kind = CLASSES[raw]
    before, after = kind[:-1], kind[1:]
    cut = ((before != SPACE) & (after == SPACE)) | ((before == LETTER) & (after == PUNCTUATION)) | ((before == PUNCTUATION) & (after == LETTER))
    if apart:
        cut |= (before == SPACE) & (after != SPACE)
    inside = np.zeros(len(raw) + 1, bool)
    inside[1:-1] = cut
    inside[offsets[:-1]] = True
    return np.flatnonzero(inside[: len(raw)])


@lru_cache(maxsize=8)
def tokenizer(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)


@lru_cache(maxsize=1)
def byte_chars() -> dict[int, str]:
    """The characters that byte-level BPE writes for bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """ids of units. Each unit is encoded by the tokenizer once, while it is remembered."""

    def __init__(self, name: str, lower: bool):
        self.tok, self.lower = tokenizer(name), lower
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.table = [byte_chars()[b] for b in range(256)]

    def _plain(self, unit: str) -> bytes:
        if self.lower:
            unit = unit.lower()
        return np.array([t.id for t in self.tok.model.tokenize("".join(map(self.table.__getitem__, unit.encode())))], np.uint32).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids (unsigned 32-bit) of texts as the tokenizer gives them."""
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, units: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        found = [young.get(u) for u in units]
        missing = []
        for i, x in enumerate(found):
            if x is None:
                u = units[i]
                x = old.get(u)
                if x is None:
                    s = u.decode()
                    if PLAIN.fullmatch(s):
                        x = self._plain(s)
                    else:
                        missing.append(i)
                        continue
                young[u] = found[i] = x
        for k in range(0, len(missing), 4096):
            part = missing[k : k + 4096]
            for i, x in zip(part, self.whole([units[i].decode() for i in part]), strict=True):
                young[units[i]] = found[i] = x
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return found

    def encode(self, text: pa.LargeStringArray, ends: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's begin (with the end), and positions after the ids of units that end with ``.``,
        ``!``, ``?`` or a line feed (if asked for)."""
        raw, offsets = text_bytes(text)
        unsafe = pc.match_substring_regex(text, UNSAFE).to_numpy(zero_copy_only=False).astype(bool)
        starts = cuts(raw, offsets, self.lower) if len(raw) else np.zeros(0, np.int64)
        if unsafe.any():  # such a text is one unit
            owner = np.searchsorted(offsets, starts, "right") - 1
            starts = starts[~unsafe[owner] | (starts == offsets[owner])]
        bounds = np.append(starts, len(raw)).astype(np.int64)
        if self.lower:
            lower = np.arange(256, dtype=np.uint8)
            lower[65:91] += 32
            if unsafe.any():
                inside = np.zeros(len(raw), bool)
                for i in np.flatnonzero(unsafe):
                    inside[offsets[i] : offsets[i + 1]] = True
                raw = np.where(inside, raw, lower[raw])
            else:
                raw = lower[raw]
        coded = binary_array(raw, bounds).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = pa.array(self.units(distinct), pa.large_binary()).take(coded.indices)
        data, at = flat(ids)
        at = at // 4
        begin = at[np.searchsorted(bounds, offsets)]
        stops = np.zeros(0, np.int64)
        if ends:
            last = np.array([u[-1:] in b".!?\n" for u in distinct], bool)[coded.indices.to_numpy()] if distinct else np.zeros(0, bool)
            stops = at[1:][last]
        return data.view(np.uint32) if len(data) else np.zeros(0, np.uint32), begin, stops
