"""Token ids of whole texts from a word-level BPE file of the tokenizers library.

The file's normaliser (NFC, white space to one space, lower case) and splitter
never join text across ASCII white space, so a text's ids are those of its
chunks between white space, one after another. Chunks repeat; a bounded cache
keeps their ids. Chunks of ASCII and Latin letters are split here and go to the
library's merge model; any other chunk goes to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import ChunkCache, gathered, runs, texts_by_parts

_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_SPLIT = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE files write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordBPE:
    """``ids(texts)`` as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.parts = ChunkCache(self._merge, 200_000)
        self.cache = ChunkCache(self._chunks, 200_000)

    def _merge(self, parts: list[str]) -> list[bytes]:
        merge, letters = self.library.model.tokenize, self.letters
        plain = [p if p.isascii() else p.encode().decode("latin-1").translate(letters) for p in parts]
        return [array("I", [t.id for t in merge(p)]).tobytes() for p in plain]

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk. Parts of all plain chunks are looked up together; other chunks go to the library."""
        out, parts, at, sizes = [b""] * len(chunks), [], [], []
        for k, text in enumerate(b"\n".join(chunks).decode("utf-8", "replace").split("\n")):
            if _PLAIN.fullmatch(text) and "<|" not in text:
                text = text.lower()
                own = [text] if text.isalpha() else _SPLIT.findall(text)
                at.append(k)
                sizes.append(len(own))
                parts += own
            else:
                out[k] = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        ids, begin = self.parts.values(parts), 0
        for k, n in zip(at, sizes):
            out[k] = ids[begin] if n == 1 else b"".join(ids[begin : begin + n])
            begin += n
        return out

    def clear(self) -> None:
        self.parts.clear()
        self.cache.clear()

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Per text of a column its ids. A long text comes as a column by itself."""
        found = [self._ids(part) for part in texts_by_parts(texts)]
        return found[0] if len(found) == 1 else [b"".join(x[0] for x in found)]

    def _ids(self, texts: pa.Array) -> list[bytes]:
        words, codes, sizes = runs(texts)
        ids, n = gathered(self.cache.values(words), codes, sizes, "<u4")
        ends, blob = (4 * np.cumsum(n)).tolist(), ids.tobytes()
        return [blob[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)
