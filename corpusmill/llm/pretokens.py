"""Byte-level BPE ids of texts through a cache of space-separated chunks.

A single space between two characters that are not white space always starts a pre-token of the
byte-level pattern, whatever stands around it, so a text may be cut there and each chunk encoded by
itself. The library encodes every chunk that a worker has not met yet; nothing is re-implemented.
Texts that contain the string of an added token are encoded whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: A space that has white space before it, and white space or the end after it.
_RUN = re.compile(r"\s (?:\s|\Z)")
#: A space between two characters that are not white space.
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters and marks that may follow them; twice if a line ends between. Each group is a pre-token of its own.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)?(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)?)?")


def _byte_signs() -> dict[int, str]:
    """Byte -> the sign that stands for it in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class ChunkIds(dict):
    """Chunk without its leading space -> ids of " " + chunk as little-endian uint32 bytes.

    Holds at most half of ``most`` chunks, and as many that were met before: when full it becomes the one before and starts
    anew, so frequent chunks stay and memory is bounded. Other pre-tokens than words after a space are in ``parts``, a third as many.
    """

    def __init__(self, path: str, most: int = 600_000):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.parts: dict[str, bytes] = {}
        #: What the model alone may encode: with nothing but the byte-level step before it, a pre-token.
        self.model = self.tokenizer.model if self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, ByteLevel) else None
        self.signs = _byte_signs()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        """The ids of one pre-token."""
        if (out := self.parts.get(text)) is None:
            if len(self.parts) >= self.most // 3:
                self.parts.clear()
            if self.model:
                out = array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.signs))]).tobytes()
            else:
                out = self.encoded(text)
            self.parts[text] = out
        return out

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text, which are encoded each by itself; the text itself if the tokenizer has other steps."""
        if m := _PLAIN.fullmatch(text.removeprefix(" ")):
            first, *rest = m.groups()
            return [text[: len(text) - len(text.removeprefix(" "))] + first, *(x for x in rest if x)]
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] if self.model else [text]

    def first(self, chunk: str) -> bytes:
        """The ids of a chunk without a space before it."""
        if m := _PLAIN.fullmatch(chunk):
            return b"".join(self.part(x) for x in m.groups() if x)
        return self.encoded(chunk)

    def word(self, letters: str) -> bytes:
        """The ids of a word with a space before it, which is one pre-token."""
        if not self.model:
            return self.encoded(" " + letters)
        signs = self.signs[0x20] + letters if letters.isascii() else (" " + letters).encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if (out := self.before.get(chunk)) is None:
            if not (m := _PLAIN.fullmatch(chunk)):
                out = self.encoded(" " + chunk)
            elif len(m[1]) == len(chunk):
                out = self.word(chunk)
            else:
                out = self[m[1]] + b"".join([self.part(x) for x in m.groups()[1:] if x])
            if "\n" in chunk:
                return out
        if len(self) >= self.most // 2:
            self.before = dict(self)
            self.clear()
        self[chunk] = out
        return out

    def chunks(self, text: str) -> list[str] | None:
        """The chunks of a text; the first has no leading space. None: encode the text whole."""
        if any(a in text for a in self.added):
            return None
        return text.split(" ") if not _RUN.search(text) else _SINGLE.split(text)

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text; null counts as empty."""
        if not text:
            return b""
        chunks = self.chunks(text)
        if chunks is None:
            return self.encoded(text)
        return self.first(chunks[0]) + b"".join(map(self.__getitem__, chunks[1:]))


_CACHES: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """The cache of this Python worker for one tokenizer file."""
    if path not in _CACHES:
        _CACHES[path] = ChunkIds(path)
    return _CACHES[path]
