"""Whole-text encoding by the ``tokenizers`` library, each distinct unit once per batch.

A unit is what stands between two *inner* single spaces, that is spaces with no other white space
beside them. Both vocabularies split text there and never merge across it, so a text's ids are the
ids of its units in order. Arrow splits and dictionary-encodes a batch; only units that a worker has
not met lately go to the library, most of them piece by piece to its model. For byte-level vocabularies units
of printable ASCII and Latin-1 letters are cut to their pieces at once (``cut_pieces``). Texts that may hold an added
token of the file, as its end-of-text marker, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: All characters that some engine takes for white space; only used to be careful beside a space.
_WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BESIDE = re.compile(f" (?:(?=[{_WS}])|(?<=[{_WS}] ))")
_INNER = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")
#: How the two vocabularies cut text before their merges.
GLUED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Units for which cutting, lower-casing and normal forms are beyond doubt: ASCII and the letters of Latin-1.
_PLAIN = re.compile("[ -~\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Units that a worker remembers; beyond it those that came only once go, which costs time only.
REMEMBERED = 500_000
#: Bytes of text that a worker takes at once, but for one text that is longer.
SLICE_BYTES = 4 << 20


def split_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts in order, without their leading space, and how many each text has."""
    texts = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(texts, pattern=r"(\s |  | \s|[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])")
    lists = pc.split_pattern(texts, pattern=" ")
    if pc.any(odd).as_py():
        rows = [_INNER.split(t) if o and _BESIDE.search(t) else t.split(" ") for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
        lists = pa.array(rows, type=pa.large_list(pa.large_string()))
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


#: Kinds of bytes: letters (of Latin-1 too, where they stand), ASCII digits, other signs, space and line end; what only the library cuts, and white space among it.
_LETTER, _DIGIT, _SIGN, _SPACE, _ODD, _ODD_SPACE = range(6)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[*range(65, 91), *range(97, 123)]], _KIND[48:58], _KIND[[10, 32]] = _LETTER, _DIGIT, _SPACE
_KIND[[9, 11, 12, 13, *range(28, 32)]] = _ODD_SPACE
#: White space beyond ASCII in UTF-8, by its first byte.
_FAR = {0xC2: (b"\x85", b"\xa0"), 0xE1: (b"\x9a\x80",), 0xE2: (*(bytes([0x80, k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"), 0xE3: (b"\x80\x80",)}
#: What follows the apostrophe of a shortened word, as ``GLUED`` has them.
_SHORTENED = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def cut_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The matches of ``GLUED`` in texts (large strings) in order, and how many each text has; units with other characters than ``_PLAIN`` stay whole."""
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    n = len(raw)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    kind = _KIND[raw]
    latin = np.flatnonzero(raw == 0xC3)
    if len(latin):
        latin = latin[(raw[latin + 1] != 0x97) & (raw[latin + 1] != 0xB7)]
        kind[latin] = kind[latin + 1] = _LETTER
    first = np.zeros(n + 1, bool)
    first[edges] = True
    cut = first.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    # White space before anything else leaves its last one: a space goes to what follows, a line end stands alone.
    after = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]) + 1
    cut[after - 1] = True
    cut[after[raw[after - 1] == 32]] = False
    # An apostrophe that begins a piece takes the letters of a shortened word.
    marks = np.flatnonzero(raw == 39)
    marks = marks[cut[marks]]
    for letters in _SHORTENED:
        fits = marks[marks + len(letters) < n]
        for k, letter in enumerate(letters, 1):
            fits = fits[(raw[fits + k] == letter) & ~first[fits + k]]
        cut[fits + 1] = False
        cut[fits + len(letters) + 1] = True
    odd = np.flatnonzero(kind >= _ODD)
    if len(odd):
        _leave_whole(cut, raw, kind, first, odd)
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts, n)
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw))
    return pieces, np.diff(np.searchsorted(starts, edges))


def _leave_whole(cut: np.ndarray, raw: np.ndarray, kind: np.ndarray, first: np.ndarray, odd: np.ndarray) -> None:
    """Takes away the cuts inside units that hold an odd byte."""
    n = len(raw)
    for lead, tails in _FAR.items():
        at = odd[raw[odd] == lead]
        for tail in tails if len(at) else ():
            found = at[at + len(tail) < n]
            for k, byte in enumerate(tail, 1):
                found = found[raw[found + k] == byte]
            for k in range(len(tail) + 1):
                kind[found + k] = _ODD_SPACE
    blank = (kind == _SPACE) | (kind == _ODD_SPACE)
    begins = first[:n].copy()
    begins[1:-1] |= (raw[1:-1] == 32) & ~blank[:-2] & ~blank[2:] & ~first[2:n]
    begins = np.flatnonzero(begins)
    held = np.zeros(len(begins), bool)
    held[np.searchsorted(begins, odd, side="right") - 1] = True
    cut[:n] &= ~np.repeat(held, np.diff(np.append(begins, n)))
    cut[begins] = True


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def cuts_as(file: dict, glued: bool) -> bool:
    """Whether a tokenizer file cuts texts as units are cut here; any other file gets whole texts."""
    model, cutter = file["model"], file["pre_tokenizer"] or {}
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return False
    if glued:
        return file["normalizer"] is None and (cutter.get("type"), cutter.get("add_prefix_space"), cutter.get("use_regex")) == ("ByteLevel", False, True)
    steps = [n.get("type") for n in (file["normalizer"] or {}).get("normalizers", [])]
    patterns = [c.get("pattern") for c in cutter.get("pretokenizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"] and patterns == [{"Regex": SPACED}, None]


class Units:
    """Ids of units from a tokenizer file, remembered between batches of one worker."""

    def __init__(self, path: str, glued: bool):
        """``glued``: the space before a unit belongs to it (byte-level vocabularies)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, "rb") as file:
            self.by_rule = cuts_as(json.load(file), glued)
        added = self.library.get_added_tokens_decoder().values()
        #: Added tokens that are matched in normalised text are looked for in any case of letters.
        self.added = [(t.content, t.normalized) for t in added if t.content]
        self.glued = glued
        self.pattern = regex.compile(GLUED if glued else SPACED)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.space = self.shown[32]
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each text."""
        if not self.by_rule:
            return self._whole(texts)
        texts = texts.cast(pa.large_string())
        marked = self._marked(texts)
        if not marked.any():
            return self._by_units(texts)
        found = [(np.flatnonzero(of), *way(texts.filter(pa.array(of)))) for of, way in ((marked, self._whole), (~marked, self._by_units))]
        counts = np.zeros(len(texts), np.int64)
        for places, _, n in found:
            counts[places] = n
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for places, ids, n in found:
            out[spread(starts[places], n)] = ids
        return out, counts

    def _marked(self, texts: pa.Array) -> np.ndarray:
        """Whether a text may hold an added token."""
        found = np.zeros(len(texts), bool)
        for content, normalized in self.added:
            found |= pc.match_substring(texts, content, ignore_case=normalized).to_numpy(zero_copy_only=False)
        return found

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *own]), np.array([len(x) for x in own], np.int64)

    def _by_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts without added tokens."""
        flat, per_text = cut_pieces(texts) if self.glued else split_units(texts)
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(per_text), np.int64)
        coded = flat.dictionary_encode()
        of = self._known(coded.dictionary.to_numpy(zero_copy_only=False))
        index = of[coded.indices.to_numpy()]
        counts = self.lengths[index]
        ids = self.ids[spread(self.starts[index], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        edges = np.concatenate([[0], np.cumsum(per_text)])
        return ids, np.diff(ends[edges])

    def _known(self, units: np.ndarray) -> np.ndarray:
        if len(self.known) + len(units) > REMEMBERED and self.known:
            self._forget()
        found = np.fromiter(map(self.known.get, units.tolist(), repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(new):
            fresh = units[new].tolist()
            ids, lengths = self._by_model(fresh) if self.glued else self._by_library(fresh)
            base, n = len(self.ids), len(self.known)
            self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
            self.again = np.concatenate([self.again, np.zeros(len(fresh), bool)])
            self.known.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            found[new] = np.arange(n, n + len(fresh))
        return found

    def _forget(self) -> None:
        """Only units that were met again stay, or none if those alone are too many."""
        stay = np.flatnonzero(self.again)
        if len(stay) > REMEMBERED // 2:
            stay = stay[:0]
        names = list(self.known)
        self.known = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.ids, self.lengths = self.ids[spread(self.starts[stay], self.lengths[stay])], self.lengths[stay]
        self.starts, self.again = np.cumsum(self.lengths) - self.lengths, np.zeros(len(stay), bool)

    def _by_library(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain units go piece by piece to the library's model, all others through its whole pipeline."""
        out: list[bytes] = [b""] * len(units)
        other: list[int] = []
        plain, pieces, get = _PLAIN.fullmatch, self.pattern.findall, self.pieces.get
        for i, unit in enumerate(units):
            if not plain(unit):
                other.append(i)
                continue
            if not self.glued:
                unit = unit.lower()
            parts = [unit] if unit[self.glued :].isalpha() else pieces(unit)
            out[i] = b"".join([get(p) or self._piece(p) for p in parts])
        for i, e in zip(other, self.library.encode_batch_fast([units[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        return np.frombuffer(b"".join(out), np.uint32), np.array([len(x) // 4 for x in out], np.int64)

    def _by_model(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Single pieces of ``_PLAIN`` by the library's model, all other units as ``_by_library`` has them."""
        every = pa.array(pieces, pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(every, pattern=r"[^ -~\n\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]").to_numpy(zero_copy_only=False))
        own = list(pieces)
        for i in np.flatnonzero(~pc.string_is_ascii(every).to_numpy(zero_copy_only=False)).tolist():
            own[i] = own[i].encode().decode("latin-1").translate(self.shown)
        for i in odd.tolist():
            own[i] = ""
        ids, lengths = array("I"), []
        for found in map(self.library.model.tokenize, "\t".join(own).replace(" ", self.space).replace("\n", self.shown[10]).split("\t")):
            lengths.append(len(found))
            ids.extend([t.id for t in found])
        ids, lengths = np.frombuffer(ids, np.uint32), np.array(lengths, np.int64)
        if not len(odd):
            return ids, lengths
        more, counts = self._by_library([pieces[i] for i in odd.tolist()])
        ids = np.insert(ids, np.repeat((np.cumsum(lengths) - lengths)[odd], counts), more)
        lengths[odd] = counts
        return ids, lengths

    def _piece(self, piece: str) -> bytes:
        mapped = piece.replace(" ", self.space) if piece.isascii() and "\n" not in piece else piece.encode().decode("latin-1").translate(self.shown)
        got = self.pieces[piece] = array("I", [t.id for t in self.library.model.tokenize(mapped)]).tobytes()
        return got


def glue(flat: pa.Array, first: np.ndarray) -> pa.Array:
    """Each unit with its leading space, but for the first of each text."""
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), flat, pa.scalar(" ", pa.large_string()))
    return pc.if_else(pa.array(first), flat, spaced)


_open: dict[tuple[str, bool], Units] = {}


def units_of(path: str, glued: bool) -> Units:
    """The worker's own instance; workers are used again, and so is what they remember."""
    if (path, glued) not in _open:
        _open[path, glued] = Units(path, glued)
    return _open[path, glued]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 3000, most: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows and bytes of ``column`` at most; a longer text is a part of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k, base = 0, 0
        while k < batch.num_rows:
            stop = min(k + rows, max(k + 1, int(np.searchsorted(ends, base + most, side="right"))))
            yield batch.slice(k, stop - k)
            k, base = stop, int(ends[stop - 1])
