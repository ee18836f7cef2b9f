"""Whole texts to token ids through caches of pre-tokens, for any merge engine.

With the pattern ``WORDS`` a token never spans the boundary between a non-space and a following
space, so a text cut at single spaces can be encoded piece by piece, and a piece (with its space in
front) has the same ids wherever it stands. Pieces and pre-tokens are remembered in bounded
dictionaries; texts with other runs of white space, and all texts where the pattern is another, are
cut by the full pattern instead.
"""

from __future__ import annotations

from array import array

import regex


#: Fixed value: the public pattern for which words after a single space are pre-tokens.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Characters of a text up to which its pre-tokens are listed.
AT_ONCE = 1 << 16


class _Run(Exception):
    """A piece touches a run of white space: the text needs the full pattern."""


class _Memo(dict):
    """A dictionary that computes what it lacks. Full, it becomes the old generation of a new one;
    what is asked for again moves back, so frequent keys stay and ``2 * most`` are held at most."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: Marks that are a pre-token of their own at the end of a word.
_MARKS = frozenset(".,;:!?")


class PretokenEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    ``engine(pre_token) -> list of ids`` is called for pre-tokens that aren't remembered; for one of a space and
    letters ``word(letters) -> ids in bytes``, if given.
    """

    def __init__(self, pattern: str, engine, pretokens: int = 100_000, pieces: int = 250_000, word=None):
        cut = regex.compile(pattern)
        self.each = lambda text: (m.group() for m in cut.finditer(text))
        self.find = self.each if cut.groups else cut.findall
        self.known = pattern == WORDS
        self.ids = lambda t: array("I", engine(t)).tobytes()
        self.word = word or (lambda t: self.ids(" " + t))
        self.tokens = _Memo(self.ids, pretokens)
        self.pieces = _Memo(self._piece, pieces)

    def _whole(self, text: str) -> bytes:
        # Long texts without a list of all their parts.
        return b"".join(map(self.tokens.__getitem__, self.find(text) if len(text) <= AT_ONCE else self.each(text)))

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self.word(piece)
        if piece[-1:] in _MARKS and piece[:-1].isalpha():
            return self.pieces[piece[:-1]] + self.tokens[piece[-1]]
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Run
        return self._whole(" " + piece)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ") if self.known else ("",)
        if first and not first[-1].isspace():
            try:
                return self._whole(first) + b"".join(map(self.pieces.__getitem__, rest))
            except _Run:
                pass
        return self._whole(text)
