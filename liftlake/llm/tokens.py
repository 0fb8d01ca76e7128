"""Whole texts to token ids with the tokenizers library, one piece at a time.

Byte-pair models treat each pre-token by itself, so a text's ids are the ids of
its pieces in order as long as every cut lies between pre-tokens. Texts are cut
at spaces and ids are kept by piece, which a corpus repeats a lot; a text with
a cut that could be wrong, or with an added token of the file in it, is encoded
whole. Results equal ``encode`` of the whole text by the tokenizer as its file
states it; the tests hold them against it.
"""

from __future__ import annotations

import functools
import re
import sys
from array import array

# Pieces kept at once in a worker, some 200 bytes each, in two generations.
MAX_PIECES = 3 << 19
# Space to str.split, but not to every regex engine's \s.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
_PLAIN_ENDS = ".,;:!?"
_SWAPS = sys.byteorder == "big"
# Latin-1 letters; Latin-1 without white space, controls and the apostrophe; its
# runs of letters, of numbers and of other characters.
_LATIN = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PLAIN = re.compile("[!-&(-~\xa1-\xac\xae-\xff]+")
_RUNS = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]+|[^0-9A-Za-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if _SWAPS:
        packed.byteswap()
    return packed.tobytes()


@functools.lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """Byte-level models write each byte as one printable character: bytes
    that are printable in Latin-1 as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Pieces(dict):
    """Ids by piece as packed 32-bit numbers; None if a piece may not be cut
    out of its text. ``lead`` is put before each piece."""

    def __init__(self, tokenizer, lead: str, lower: bool) -> None:
        super().__init__()
        self.tokenizer, self.model, self.lead, self.lower = tokenizer, tokenizer.model, lead, lower
        letters = _byte_letters()
        self.lead_letters = "".join([letters[b] for b in lead.encode()])
        # Latin-1 characters as the letters of their bytes.
        self.letters = {c: "".join([letters[b] for b in chr(c).encode()]) for c in range(0x100)}
        self.old: dict[str, bytes | None] = {}
        self.ends: dict[str, bytes] = {}  # ids of closing marks
        self.line_end = b""
        self.inner: Pieces | None = None  # pieces after a line end
        self.by_runs = False  # pre-tokens are runs of letters, of numbers and of others

    def __missing__(self, piece: str) -> bytes | None:
        if self.old and piece in self.old:
            ids = self.old[piece]
        elif piece.isalpha() and piece.isascii():
            # One pre-token, so the model alone gives its ids.
            letters = self.lead_letters + (piece.lower() if self.lower else piece)
            ids = _pack([t.id for t in self.model.tokenize(letters)])
        elif self.lower:
            ids = self._ids(piece)
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            ids = None
        elif "\n" in piece and self.inner is not None:
            return self._lines(piece)  # made of kept pieces
        else:
            ids = self._ids(piece)
        if len(self) >= MAX_PIECES // 2:
            # Pieces that are still in use come back from the generation before.
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def _lines(self, piece: str) -> bytes | None:
        """For pieces with single line ends between words."""
        first, *rest = piece.split("\n")
        out = [self[first]]
        for part in rest:
            out += [self.line_end, self.inner[part]]
        return None if None in out else b"".join(out)

    def _ids(self, piece: str) -> bytes:
        if _LATIN.fullmatch(piece):
            text = (piece.lower() if self.lower else piece).translate(self.letters)
            return _pack([t.id for t in self.model.tokenize(self.lead_letters + text)])
        end = piece[-1:]
        if end in _PLAIN_ENDS and len(piece) > 1 and piece[-2].isalnum():
            # Letters or digits and a closing mark are different pre-tokens.
            last = self.ends.get(end)
            if last is None:
                last = self.ends[end] = self._encode(end)
            return self[piece[:-1]] + last
        if self.by_runs and _PLAIN.fullmatch(piece):
            first, *rest = _RUNS.findall(piece)
            if rest:
                return b"".join([self[first], *map(self.inner.__getitem__, rest)])
        return self._encode(self.lead + piece)

    def _encode(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)


class TextIds:
    """Token ids of texts, packed as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens are found before pre-tokens; those that are looked for in
        # the normalized text could be anywhere.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = ["" if t.normalized else t.content for t in added]
        # White space is dropped by the model or part of the next pre-token.
        self.drops_space = self.tokenizer.normalizer is not None
        if self.drops_space:
            self.words = Pieces(self.tokenizer, "", lower=True)
        else:
            self.first = Pieces(self.tokenizer, "", lower=False)
            self.words = Pieces(self.tokenizer, " ", lower=False)
            self.first.inner = self.words.inner = self.first
            self.first.line_end = self.words.line_end = self.whole("\n")
            cut = self.tokenizer.pre_tokenizer
            self.first.by_runs = self.words.by_runs = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex

    def forget(self) -> None:
        """Drops the pieces kept so far. A worker outlives its task, and would hold
        them while tasks without tokens run in it."""
        for pieces in (self.words,) if self.drops_space else (self.words, self.first):
            pieces.clear()
            pieces.old = {}

    def whole(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        for token in self.added:
            if token in text:
                return self.whole(text)
        if self.drops_space:
            if _ODD_SPACE.search(text):
                return self.whole(text)
            return b"".join(map(self.words.__getitem__, text.split()))
        lines = []
        try:
            # A single line end between two words is a pre-token of its own.
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(b"".join([self.first[first], *map(self.words.__getitem__, rest)]))
            return self.first.line_end.join(lines)
        except TypeError:  # a piece of None: spaces in a row and the like
            return self.whole(text)


@functools.lru_cache(maxsize=4)
def text_ids(path: str) -> TextIds:
    """One for each worker and file; its pieces serve all tasks of the worker,
    unless a task forgets them."""
    return TextIds(path)
