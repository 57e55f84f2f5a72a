"""Texts as codes of their distinct chunks, so that costly work is done once for each chunk of a batch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Characters of the texts that are looked at together; bounds memory, but for a single longer text.
CHARS = 8_000_000
#: Values in one of the two generations of a worker's cache.
GENERATION = 300_000
#: Longer keys are not kept.
LONG = 64
#: A space after white space and before white space or the end: only there can a pre-token reach over a space.
ACROSS = regex.compile(r"\s (?:\s|\Z)")
#: Found in every text that has the former; quicker to look for.
NEAR = re.compile(r" (?:\s|\Z)")


def groups(batches: Iterator[pa.RecordBatch], chars: int = CHARS) -> Iterator[tuple[list, list[str]]]:
    """(doc_id, text) batches -> ids and texts of as many rows as hold ``chars`` characters; a null text is empty."""
    for b in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(b.column(0), b.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts
        # What Arrow has freed goes back to the system, as the executor shares its memory with other workers.
        pa.default_memory_pool().release_unused()


def gather(values: list[bytes], codes: np.ndarray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """values[code] of every code end to end as an array, and where each code's part ends."""
    flat = np.frombuffer(b"".join(values), dtype=dtype)
    length = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // np.dtype(dtype).itemsize
    start = length.cumsum() - length
    n = length[codes]
    ends = n.cumsum()
    shift = (start[codes] - (ends - n)).astype(np.int32)
    return flat[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(shift, n)], ends


class ChunkCoder:
    """Base of the byte-level BPE encoders.

    Pre-tokens never have a space behind other characters, so a text is cut at its spaces and each distinct chunk is
    looked at once. The key of a chunk behind a space is the chunk; a first chunk, or a text with odd runs of white
    space, has itself with a space before it as its key.
    """

    def __init__(self, generation: int = GENERATION) -> None:
        self.generation = generation
        self.new: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def resolve(self, keys: list[str]) -> dict[str, Any]:
        """The values of keys that the cache doesn't hold."""
        raise NotImplementedError

    def known(self, key: str) -> Any:
        found = self.new.get(key)
        return self.old.get(key) if found is None else found

    def code(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """-> the values, every text's codes end to end, and where each text's codes end."""
        odd = [bool(NEAR.search(t) and ACROSS.search(t)) for t in texts]
        parts = pc.split_pattern(pa.array(["" if o else t for o, t in zip(odd, texts, strict=True)], pa.large_string()), " ")
        ends = parts.offsets.to_numpy()[1:].astype(np.int64)
        coded = parts.values.dictionary_encode()
        codes, keys = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = parts.offsets.to_numpy()[:-1]
        heads = [" " + (t if o else keys[c]) for o, t, c in zip(odd, texts, codes[first], strict=True)]
        codes[first] = len(keys) + np.arange(len(texts))
        keys += heads
        if len(self.new) > self.generation:
            self.old, self.new = self.new, {}
        new, old, missing, long = self.new, self.old, [], {}
        for k in keys:
            if k not in new:
                if (v := old.get(k)) is None:
                    missing.append(k)
                else:
                    new[k] = v
        for k, v in self.resolve(list(dict.fromkeys(missing))).items():
            (new if len(k) <= LONG else long)[k] = v
        return [new[k] if k in new else long[k] for k in keys], codes, ends
