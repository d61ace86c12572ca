"""Whole-text tokenization with the ``tokenizers`` library, sped up by remembering words.

A tokenizer whose pre-tokenizer always splits between a visible character and a lone space gives a
text's ids as the concatenation of the ids of its space-separated units. Units repeat, so each
worker remembers their ids as bytes; a text's unknown units are cut into pieces together, and each
unknown piece goes through the library's BPE model, or a unit through its full ``encode`` where
anything is unusual. A tokenizer of another kind is
simply applied to whole texts.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

#: Units that a worker remembers at most, and the share of that number it remembers pieces of units for.
MEMO_ENTRIES, PIECE_SHARE = 500_000, 4

#: Fixed value: the pre-tokenization pattern of byte-level BPE vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space other than the space itself.
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_PROBES = [
    "", " ", "a", "The quick, brown fox's 12 dens; don't!\nNew  line \t end ", "Élan naïve größe ñandú",
    "x\n y \n\n z", "漢字 かな 12, Ελλάς ΟΔΟΣ", "áb ́c  d", "UPPER lower 3.14 --- ...", "it'S 'T we'll\x1cq",
]


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


def _touching(text: str) -> bool:
    """Whether a space stands at an end or beside other white space; searches for single strings are fast."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return True
    return any(c in text and (" " + c in text or c + " " in text) for c in _WHITE)


class WordMemoEncoder:
    """Encodes texts to little-endian ids, equal to the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, dtype: str = "<u4", entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.dtype, self.entries = np.dtype(dtype), entries
        self.model = self.full.model
        self.alphabet = byte_alphabet()
        # Two generations: when the younger is half of what is allowed, the older one goes; what is met again moves up.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        added = [re.escape(t.content) for t in self.full.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(["[^\\n\\x20-\\x7e\\xa1-\\u024f]", *added])).search
        self.word = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.spaced_word = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.kind = self._kind(json.loads(self.full.to_str()))
        if sys.byteorder != "little":
            self.kind = ""
        if self.kind and any(self(t) != self._whole(t) for t in _PROBES):
            self.kind = ""

    def _kind(self, spec: dict) -> str:
        """``spaced`` (spaces belong to the next word), ``dropped`` (white space is dropped) or ''."""
        import regex

        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        tame = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]) for t in spec.get("added_tokens", []))
        if not (plain and tame):
            return ""
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.split = regex.compile(BYTE_LEVEL_PATTERN).findall
            return "spaced"
        parts = pre.get("pretokenizers", [])
        if [p.get("type") for p in parts] == ["Split", "ByteLevel"] and parts[0].get("invert") and parts[0].get("behavior") == "Removed":
            steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
            if steps == ["NFC", "Replace", "Lowercase"] and not parts[1].get("use_regex", True) and not parts[1].get("add_prefix_space"):
                self.split = regex.compile(parts[0]["pattern"]["Regex"]).findall
                return "dropped"
        return ""

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _unit(self, unit: str) -> bytes:
        if not unit:
            return b""
        if self.odd(unit):
            return self._whole(unit)
        if self.kind == "dropped":
            unit = unit.lower() if unit.isascii() else self.full.normalizer.normalize_str(unit)
        alone = self.word if self.kind == "dropped" else self.spaced_word
        pieces = [unit] if alone(unit) else self.split(unit)
        found = [self._piece(p) for p in pieces]
        return found[0] if len(found) == 1 else b"".join(found)

    def _ids(self, piece: str) -> bytes:
        if piece.isascii() and "\n" not in piece:
            shown = piece.replace(" ", "Ġ")
        else:
            shown = piece.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        known = self.pieces
        ids = known.get(piece)
        if ids is None and piece[0] == " " and self.kind == "spaced":  # perhaps it was a unit
            ids = self.memo.get(piece[1:]) or self.older.get(piece[1:])
        if ids is None:
            ids = self._ids(piece)
            if len(known) >= self.entries // PIECE_SHARE:
                known.clear()
            known[piece] = ids
        return ids

    def _fresh(self, units: list[str], lead: str) -> dict[str, bytes]:
        """The ids of different units; in one go where all are plain: a word is one piece, a piece that begins with a space begins a unit."""
        text = " " + " ".join(units)
        if not lead or text.count(" ") != len(units) or self.odd(text) or "  " in text or "\n " in text or " \n" in text or text[-1] in " \n":
            return {u: self._unit(lead + u) for u in units}
        known, get, piece, out, rest = self.pieces.get, self._ids, self._piece, {}, []
        for u in units:
            if u.isalpha():
                out[u] = known(" " + u) or get(" " + u)
            else:
                rest.append(u)
        cut: list[bytes] = []
        for p in self.split(" " + " ".join(rest)) if rest else ():
            ids = known(p) or piece(p)
            if p[0] == " ":
                cut.append(ids)
            else:
                cut[-1] += ids
        return out | dict(zip(rest, cut, strict=True))

    def __call__(self, text: str | None) -> bytes:
        """The ids of a whole text; null counts as empty."""
        text = text or ""
        if not self.kind or self.kind == "dropped" and "Σ" in text:  # lower case of Σ depends on its place
            return self._whole(text)
        # The memo holds a unit's ids as they are after a space; a text's first unit has none before it.
        if self.kind == "dropped":
            first, lead, units = b"", "", text.split(" ")
        else:
            first, *units = _LONE_SPACE.split(text) if _touching(text) else text.split(" ")
            first, lead = self._unit(first), " "
        found = list(map(self.memo.get, units))
        if None not in found:
            return first + b"".join(found)
        missing = dict.fromkeys(u for u, ids in zip(units, found) if ids is None)
        older = self.older
        fresh = {u: older[u] for u in missing if u in older}
        if len(fresh) < len(missing):
            fresh |= self._fresh([u for u in missing if u not in fresh], lead)
        if len(self.memo) + len(fresh) > self.entries // 2:
            self.memo, self.older = {}, self.memo
        if len(fresh) <= self.entries // 2:
            self.memo.update(fresh)
        return first + b"".join([fresh[u] if ids is None else ids for u, ids in zip(units, found)])


_encoders: dict[tuple, WordMemoEncoder] = {}


def encoder(path: str, dtype: str = "<u4", entries: int = MEMO_ENTRIES) -> WordMemoEncoder:
    """The worker's encoder of this file, loaded once."""
    if (path, dtype, entries) not in _encoders:
        _encoders[path, dtype, entries] = WordMemoEncoder(path, dtype, entries)
    return _encoders[path, dtype, entries]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
