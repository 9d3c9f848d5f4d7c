"""Byte-level BPE ids of whole texts, as the tokenizers library gives them for byte_bpe_50k.json.

The vocabulary is held as ranks (the tiktoken file of the same vocabulary, which encodes the same way and faster).
Text is cut at single spaces, where the split pattern always cuts, and each distinct piece is encoded once, within a
bounded cache. Texts in which white space meets white space, or which hold a special token, take the plain way.
"""

from __future__ import annotations

import base64
import re

import numpy as np

from tideflow.llm.common import Memo

END = "<|endoftext|>"
#: Fixed value: the split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RUN = re.compile(r"\s\s")


class ByteTokenizer:
    """path: the JSON file; the rank file stands beside it with the ending .tiktoken."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = Memo(self._piece, 300_000)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.plain(" " + piece), "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if END in text:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _RUN.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        pieces = self.pieces
        return b"".join([np.array(self.plain(first), "<u4").tobytes() if first else b"", *[pieces[p] for p in rest]])


_LOADED: dict[str, ByteTokenizer] = {}


def load(path: str) -> ByteTokenizer:
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]
