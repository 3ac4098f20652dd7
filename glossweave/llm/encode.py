"""Token ids of whole texts, with a memo of the pieces that no token crosses.

Both public tokenizers cut a text before they merge anything, so the ids of a
text are the ids of its pieces put together.  Text repeats its pieces, so most
of them come from a bounded memo and only unseen ones go through the tokenizers
library.  Equality with encoding each text at once is tested.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

#: White space as the tokenizers' regular expressions know it.
WHITE = "\\t-\\r \x85\xa0  -     　"
#: Letters and marks between which both kinds always cut, if white space or the end follows the mark.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ",.;:!?*%&$#"
_KNOWN = f"[{LETTERS}]+(?![^{MARKS}{WHITE}])|[{MARKS}]+(?![^{WHITE}])"
#: "byte" vocabularies keep white space, "word" vocabularies drop it.
PIECES = {
    "byte": re.compile(f" ?{_KNOWN}| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall,
    "word": re.compile(f"{_KNOWN}|[^{WHITE}]+").findall,
}

_LETTERS_ONLY = re.compile(f" ?[{LETTERS}]+").fullmatch
#: Byte-level vocabularies write bytes as characters: printable ones as themselves, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Encoder(dict):
    """Ids of a text as little-endian bytes of ``dtype``; null is the empty text.

    It is the memo itself, from pieces to ids.  A piece of letters alone is one word to
    both kinds, so it goes straight to the library's model; others take the whole way.  kind: a key of PIECES.  Strings of
    special tokens in a text are ordinary text.  Beyond ``memo`` pieces it starts anew.
    """

    def __init__(self, path: str, kind: str, dtype: str = "<u4", memo: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.lower = self.tokenizer.model, kind == "word"
        self.pieces, self.width, self.limit = PIECES[kind], {"<u2": "H", "<u4": "I"}[dtype], memo

    def __missing__(self, piece: str) -> bytes:
        if _LETTERS_ONLY(piece):
            shown = (piece.lower() if self.lower else piece).encode().decode("latin-1").translate(_SHOWN)
            ids = [t.id for t in self.model.tokenize(shown)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        out = self[piece] = struct.pack(f"<{len(ids)}{self.width}", *ids)
        return out

    def __call__(self, text: str | None) -> bytes:
        if len(self) > self.limit:
            self.clear()
        return b"".join(map(self.__getitem__, self.pieces(text or "")))


@lru_cache(maxsize=2)
def encoder(path: str, kind: str, dtype: str, memo: int) -> Encoder:
    """One per Python worker, which Spark uses for many tasks; 100,000 pieces in the memo take about 30 MB."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, kind, dtype, memo)
