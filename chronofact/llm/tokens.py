"""Token ids of whole texts by a public tokenizer file, at the cost of their distinct words."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from chronofact.llm.chunks import GENERATION, LONG, ChunkCoder, gather

#: Pre-tokens of Latin letters, digits, common marks and lone line ends, which every version of the pattern tells apart
#: alike; the pattern's suffixes begin with an apostrophe, which is left out.
PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[.,;:!?#$%&*=_+()\"/-]+|\n(?!\s)")


def _byte_letters() -> list[str]:
    """Byte-level BPE writes printable bytes as themselves and the others as the code points from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder(ChunkCoder):
    """Ids, as little-endian unsigned 32-bit integers, by a tokenizer of kind byte-level BPE."""

    def __init__(self, path: str, generation: int = GENERATION) -> None:
        super().__init__(generation)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = _byte_letters()

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        behind = piece[0] == " " and len(piece) > 1
        key = piece[1:] if behind else " " + piece
        found = self.known(key)
        if found is None:
            found = self.fresh.get(key)
        if found is None:
            ids = [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in piece.encode()]))]
            found = self.fresh[key] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def resolve(self, keys: list[str]) -> dict[str, bytes]:
        self.fresh: dict[str, bytes] = {}
        space, tokenize, pack = self.letters[32], self.tokenizer.model.tokenize, struct.pack
        for k in keys:
            if k in self.fresh:
                continue
            if k.isascii() and k.isalpha() and len(k) <= LONG:
                ids = [t.id for t in tokenize(space + k)]
                self.fresh[k] = pack(f"<{len(ids)}I", *ids)
                continue
            text = k[1:] if k[:1] == " " else " " + k
            pieces = PLAIN.findall(text) if len(text) <= LONG else [""]
            self.fresh[k] = b"".join([self.piece(p) for p in pieces]) if sum(map(len, pieces)) == len(text) else self.whole(text)
        return self.fresh

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, without special tokens, and where each text's ids end.

        Strings of special tokens are ordinary text.
        """
        values, codes, ends = self.code(texts)
        ids, at = gather(values, codes, "<u4")
        return ids, at[ends - 1] if len(ends) else ends


@lru_cache(maxsize=2)
def encoder(path: str, generation: int = GENERATION) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    return Encoder(path, generation)
