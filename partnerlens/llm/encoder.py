"""Whole-text encoding with a public tokenizer file, one call per distinct
piece of text.

Both tokenizer files cut a text before a single space that precedes a visible
character, around a line feed between visible characters, and before a full
stop or comma that follows a letter or digit.  So the ids of a text are the
ids of the pieces between such cuts, one after another.  A text in which any
cut is not certain to be one of these, or that may hold the text of a special
token, is encoded in one call."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_BYTES = 160 << 20 # the cache is emptied beyond about this size
PIECE_BYTES = 180       # what a piece costs there besides its characters
SLICE = 4096            # pieces given to the tokenizer at a time
CHUNK_BYTES = 1 << 20   # text encoded at a time
_CACHE: dict[str, "PieceEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows of about ``size`` bytes together."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield a, column.slice(a, b - a).to_pylist()
        a = b


def encoder(path: str) -> "PieceEncoder":
    """One encoder per Python worker and file; its cache lives across tasks."""
    if path not in _CACHE:
        _CACHE[path] = PieceEncoder(path)
    return _CACHE[path]


class PieceEncoder(dict):
    """piece -> piece number; ids of all pieces lie in one flat array."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        # a text with the beginning of a special token in it goes to the tokenizer as a whole
        self.marks = sorted({t.content[:2] for t in self.tok.get_added_tokens_decoder().values()})
        self.vocab_size = self.tok.get_vocab_size()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pending: list[str] = []
        self.size = 0
        self.kind = bytearray()  # bit 0: odd, bit 1: ends in neither letter nor digit, bit 2: starts with . or ,
        self.offset = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def __missing__(self, piece: str) -> int:
        i = self[piece] = len(self.kind)
        self.pending.append(piece)
        self.size += PIECE_BYTES + len(piece)
        c = piece[1:2] if piece[:1] == " " else piece[:1]
        sure = piece == "\n" or (("!" <= c <= "~" or (c.isalpha() and c < "\u0250")) and piece[1:].isprintable())
        self.kind.append((not sure) + 2 * (not piece[-1:].isalnum()) + 4 * (piece[:1] in (".", ",")))
        return i

    def _settle(self) -> None:
        if not self.pending:
            return
        lengths, flat = [], []
        for a in range(0, len(self.pending), SLICE):
            new = [e.ids for e in self.tok.encode_batch(self.pending[a:a + SLICE], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, new), np.int64, len(new)))
            flat.append(np.fromiter(chain.from_iterable(new), np.uint32, int(lengths[-1].sum())))
        n = np.concatenate(lengths)
        self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(n) - n])
        self.length = np.concatenate([self.length, n])
        self.flat = np.concatenate([self.flat, *flat])
        self.pending = []

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """uint32 ids of each text, followed by ``end_id``."""
        if self.size > CACHE_BYTES:
            self.reset()
        idx = []
        for t in texts:
            if "\0" in t or any(m in t for m in self.marks):
                idx.append(None)
                continue
            parts = (t.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(",", "\0,").replace(".", "\0.").split("\0"))
            if parts[0] == "" and len(parts) > 1 and parts[1][:1] in (".", ","):
                parts = parts[1:]
            idx.append(np.fromiter(map(self.__getitem__, parts), np.int64, len(parts)))
        self._settle()
        kinds = np.frombuffer(bytes(self.kind), dtype=np.uint8)
        out = []
        for t, a in zip(texts, idx):
            k = None if a is None else kinds[a]
            if a is None or (k & 1).any() or ((k[:-1] & 2) & ((k[1:] & 4) >> 1)).any():
                ids = np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
                out.append(np.append(ids, np.uint32(end_id)))
                continue
            n = self.length[a]
            total = int(n.sum())
            ids = np.empty(total + 1, dtype=np.uint32)
            ids[:total] = self.flat[np.repeat(self.offset[a] - (np.cumsum(n) - n), n) + np.arange(total)]
            ids[total] = end_id
            out.append(ids)
        return out
