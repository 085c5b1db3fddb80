"""Ids of a byte-level BPE vocabulary, by the tokenizers library.

A pretoken of this vocabulary never runs from a non-space character over a
following space, so a text can be cut before each single space and at each
single line feed, and the ids of the pieces joined. The pieces repeat, so each
worker keeps the ids of pieces it has met of late, in bounded memory; the
library's model encodes the others. Texts with two white-space characters in a
row are cut more carefully.
"""

from __future__ import annotations

import re
from array import array

import regex

#: Pieces of a generation; a worker remembers two of each kind (some 100 MB each, were they full).
CACHE_PIECES = 1 << 19
#: Longer pieces, in characters, are rare and are not remembered.
CACHED_LENGTH = 64

_CUT = re.compile(r"(?<=\S)(?=[ ]\S)")
#: The pretoken pattern of the vocabulary: a fixed value of the file format.
_PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that stands for it in byte-level BPE.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Spaced(Exception):
    """A piece is empty or has white space at an end, so the cut was not valid."""


class Recent(dict):
    """Ids of pieces by encode(), with those of the last CACHE_PIECES to 2 * CACHE_PIECES different short pieces kept."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, bytes] = {}

    def encode(self, piece: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, piece: str) -> bytes:
        out = self.before.get(piece)
        if out is None:
            out = self.encode(piece)
            if len(piece) > CACHED_LENGTH:
                return out
        if len(self) >= CACHE_PIECES:
            self.before = dict(self)
            self.clear()
        self[piece] = out
        return out


class Pretokens(Recent):
    """Ids of pretokens, as little-endian unsigned 32-bit bytes."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.table = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})

    def encode(self, pretoken: str) -> bytes:
        raw = pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1")
        return array("I", [t.id for t in self.model.tokenize(raw.translate(self.table))]).tobytes()


class Pieces(Recent):
    """Ids of pieces that stand after `lead`."""

    def __init__(self, pretokens: Pretokens, lead: str):
        super().__init__()
        self.pretokens, self.lead = pretokens, lead

    def encode(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Spaced
        whole, n = self.lead + piece, len(self.lead)
        if piece.isalpha():
            return self.pretokens.encode(whole)  # one pretoken, kept as a piece alone
        first, *others = _PRETOKEN.findall(whole)
        head = self[first[n:]] if first[n:].isalpha() else self.pretokens[first]
        return head + b"".join([self.pretokens[p] for p in others])


class Encoder:
    """Encodes whole texts as the library does without special tokens at the ends.

    Strings of added tokens inside a text have their own ids there; such texts
    go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.pretokens = Pretokens(self.tokenizer.model)
        self.first, self.later = Pieces(self.pretokens, ""), Pieces(self.pretokens, " ")
        self.feed = self.pretokens["\n"]

    def __call__(self, text: str) -> bytes:
        """The ids of `text` as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.added.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        later, lines = self.later.__getitem__, []
        try:
            for line in text.split("\n"):
                head, *words = line.split(" ")
                lines.append(self.first[head] + b"".join(map(later, words)))
            return self.feed.join(lines)
        except Spaced:
            pretokens = self.pretokens
            return b"".join([pretokens[p] for c in _CUT.split(text) for p in _PRETOKEN.findall(c)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for the vocabulary at `path`, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
