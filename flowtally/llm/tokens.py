"""Exact, fast encoding of whole texts with the ``tokenizers`` library.

A BPE model never merges across the borders that its own pre-tokenizer draws.  Each
distinct pre-token is therefore given to the library's model once per Python worker
and its ids are reused; the ids of a text are those of its pre-tokens in order.
Texts whose normal form could move a border (added tokens, combining marks, letters
whose lower case is longer or depends on its place, unassigned characters) are given to the library whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import regex

# The pre-token patterns of the two vocabularies.  In the first of each
# pair, for texts of ASCII and Latin letters, the classes are spelled out.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_BEYOND = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ]")
_SPACED = (
    re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"),
    regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"),
)
_WORDS = (
    re.compile(rf"'[sStTmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL]|[{_LATIN}]+|[0-9]|[^\t-\r {_LATIN}0-9]+"),
    regex.compile(r"'[sStTmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL]|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"),
)
_ENCODERS: dict[tuple[str, bool], "PieceEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable character that byte-level BPE writes for it."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


class _Index(dict):
    """Pre-token -> number; new ones queue up in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


class PieceEncoder:
    """Encodes lists of texts to one flat id array and the number of ids of each text.

    ``keeps_spaces``: the vocabulary codes spaces and case (plain byte-level BPE);
    otherwise texts are brought to NFC and lower case and white space is dropped.
    The memo is emptied beyond ``max_pieces`` pre-tokens or ``max_ids`` ids, so that
    memory is bounded for any input.
    """

    def __init__(self, path: str, keeps_spaces: bool, max_pieces: int = 800_000, max_ids: int = 6_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_spaces, self.max_pieces, self.max_ids = keeps_spaces, max_pieces, max_ids
        self.letters = _byte_letters()
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.starts, self.lengths, self.ids, self.n_ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.int32), 0

    def _learn(self) -> None:
        """Gives pre-tokens seen for the first time to the library's model and keeps their ids."""
        fresh, self.index.fresh = self.index.fresh, []
        if not fresh:
            return
        norm = (lambda p: p) if self.keeps_spaces else (lambda p: p.lower() if p.isascii() else self.tokenizer.normalizer.normalize_str(p))
        model = self.tokenizer.model
        coded = [[t.id for t in model.tokenize(norm(p).encode().decode("latin-1").translate(self.letters))] for p in fresh]
        n, k = len(self.index), len(fresh)
        lens = np.fromiter(map(len, coded), np.int64, k)
        total = int(lens.sum())
        while n > len(self.lengths):
            self.lengths, self.starts = np.concatenate([self.lengths, np.zeros_like(self.lengths)]), np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.n_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.lengths[n - k : n] = lens
        self.starts[n - k : n] = self.n_ids + np.cumsum(lens) - lens
        self.ids[self.n_ids : self.n_ids + total] = np.fromiter((i for c in coded for i in c), np.int32, total)
        self.n_ids += total

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text; None: the library must see the whole text."""
        if "<|" in text:
            return None
        latin, general = _SPACED if self.keeps_spaces else _WORDS
        if text.isascii():
            return latin.findall(text if self.keeps_spaces else text.lower())
        if not _BEYOND.search(text):
            return latin.findall(text) if self.keeps_spaces or "İ" not in text else None
        # Tables of characters differ in what they make of unassigned ones.
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return None
        if self.keeps_spaces:
            return general.findall(text)
        return general.findall(text) if unicodedata.is_normalized("NFC", text) and "Σ" not in text and "İ" not in text else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat int32 ids of all texts, and the number of ids of each."""
        if len(self.index) > self.max_pieces or self.n_ids > self.max_ids:
            self._reset()
        codes, counts, whole = [], np.zeros(len(texts), np.int64), {}
        for k, text in enumerate(texts):
            found = self.pieces(text)
            if found is None:
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                continue
            counts[k] = len(found)
            codes.append(np.fromiter(map(self.index.__getitem__, found), np.int32, len(found)))
        self._learn()
        code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        lens = self.lengths[code]
        ends = np.concatenate([[0], np.cumsum(lens)])
        flat = self.ids[np.repeat(self.starts[code] - ends[:-1], lens) + np.arange(int(ends[-1]))]
        last = np.cumsum(counts)
        sizes = ends[last] - ends[last - counts]
        if whole:
            parts, at = [], 0
            for k in range(len(texts)):
                if k in whole:
                    sizes[k] = len(whole[k])
                    parts.append(whole[k])
                else:
                    parts.append(flat[at : at + sizes[k]])
                    at += sizes[k]
            flat = np.concatenate(parts)
        return flat, sizes


def encoder(path: str, keeps_spaces: bool) -> PieceEncoder:
    """The worker's encoder for a vocabulary; its memo outlives a task."""
    key = (path, keeps_spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, keeps_spaces)
    return _ENCODERS[key]
