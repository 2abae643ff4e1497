"""Token ids of whole texts with the tokenizers library, by pieces between white space that are encoded once and kept.

Both kinds of tokenizer that this serves cut a text at white space before they look at anything else, so the ids of a text are
those of its pieces in a row. A piece of plain letters, or letters and a few marks after them, is one or two of the tokenizer's
words and goes to its model at once; any other piece goes through the whole tokenizer. Texts with white space other than space,
tab and line ends, on whose extent the library and Python may differ, or with the string of a special token are encoded in one go.

What is kept is bounded by bytes, whatever the texts hold.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

END_ID = 2
KEPT_BYTES = 128_000_000  # of a generation of pieces, about; two are kept
KEPT_MARKS = 4096
LONGEST_PIECE = 64
_ENTRY = 200  # bytes of a kept piece besides its letters and ids

_PLAIN = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_RUNS = ("\t", "\r", "  ", " \n", "\n ", "\n\n")
_LETTERS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKS = ".,;:!?"
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


def public_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level tokenizers write each byte: itself if it is printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Kept(dict):
    """Ids of pieces that follow a certain space (or none), made at the first use.

    When it holds limit bytes it becomes the old generation and is emptied; pieces used again come back from there.
    """

    def __init__(self, encoder: Encoder, limit: int, space: str = ""):
        super().__init__()
        self.encoder, self.limit, self.space, self.old, self.held = encoder, limit, space, {}, 0

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= LONGEST_PIECE:
            if self.held > self.limit:
                self.old = {}  # freed before the next copy is made
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[piece] = ids
            self.held += _ENTRY + len(piece) + len(ids)
        return ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is not None:
            return self._keep(piece, ids)
        bare = piece.rstrip(_MARKS)
        if not (bare.isascii() and bare.isalpha() or _LETTERS.fullmatch(bare)):
            return self._keep(piece, self.encoder.whole(self.space + piece))
        if len(bare) == len(piece):
            return self._keep(piece, self.encoder.word(self.space, piece))
        known = bare in self
        ids = self[bare] + self.encoder.marks(piece[len(bare) :])
        return self._keep(piece, ids) if known else ids


class Encoder:
    """ids(text) as bytes of little-endian numbers, dtype wide.

    plain_specials: the strings of special tokens in a text are ordinary text; else each is its token's id, as the library has it.
    """

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, name: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else public_path(name))
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        self.dtype, self._code = np.dtype("<u2" if narrow else "<u4"), "H" if narrow else "I"
        self.model, self._letters = self.tokenizer.model, byte_letters()
        # With a normalizer, which makes lower case and drops white space, words are the pieces; without, a space belongs to what follows.
        self.lower = self.tokenizer.normalizer is not None
        self.plain, self.spaced, self._marks = Kept(self, KEPT_BYTES if self.lower else KEPT_BYTES // 4), Kept(self, KEPT_BYTES * 3 // 4, " "), {}
        self.line_end = b"" if self.lower else self.whole("\n")

    @classmethod
    def of(cls, name: str, plain_specials: bool = False) -> Encoder:
        """One encoder per worker process, name and way with special tokens."""
        key = (name, plain_specials)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def whole(self, text: str) -> bytes:
        """The whole tokenizer's ids."""
        return array(self._code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def marks(self, piece: str) -> bytes:
        if len(piece) > LONGEST_PIECE:
            return self.whole(piece)
        if piece not in self._marks:
            if len(self._marks) >= KEPT_MARKS:
                self._marks.clear()
            self._marks[piece] = self.whole(piece)
        return self._marks[piece]

    def word(self, space: str, piece: str) -> bytes:
        """The model's ids of a piece of letters, after what the tokenizer does before: lower case, and letters for bytes."""
        piece = piece.lower() if self.lower else piece
        written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
        return array(self._code, [t.id for t in self.model.tokenize(space.translate(self._letters) + written)]).tobytes()

    def _line(self, line: str) -> bytes:
        first, *rest = line.split(" ")
        return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text) or any(map(text.__contains__, self.specials)):
            return self.whole(text)
        if self.lower:
            return b"".join(map(self.plain.__getitem__, text.split()))
        if any(map(text.__contains__, _RUNS)) or text[0] in " \n" or text[-1] in " \n":
            return b"".join(map(self.plain.__getitem__, _PLAIN.findall(text)))
        return self.line_end.join(map(self._line, text.split("\n")))
