"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.chunks import GENERATION, LONG, gather, groups

#: SentencePiece writes a space as this marker, and a literal marker in a text is a space to it.
MARKER = "▁"
#: A chunk is a run of spaces with the word behind it, or the run that ends a text.
CHUNK = re.compile(r" +[^ ]+| +\Z")
#: What a normaliser that changes nothing but spaces leaves as it is.
PROBE = "a  ﬁ Ａ é\t①\r\nÅ ​"


class Pieces:
    """A worker's model, its ids' bytes, and a bounded cache from chunks (less their first space) to ids."""

    def __init__(self, path: str, generation: int = GENERATION) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.marker = self.model.piece_to_id(MARKER)
        #: Whether texts may be cut before each run of spaces: every text gets a marker in front and keeps its other
        #: characters, and no piece has a marker behind another character.
        self.apart = (
            self.model.normalize(PROBE) == MARKER + PROBE.replace(" ", MARKER)
            and self.marker != self.model.unk_id()
            and not any(MARKER in n.lstrip(MARKER) for n in names)
        )
        self.surface = [self._bytes(i, n) for i, n in enumerate(names)]
        self.generation = generation
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _bytes(self, i: int, name: str) -> bytes:
        if self.model.is_byte(i):
            return bytes([int(name[1:-1], 16)])
        if self.model.is_control(i):
            return b""
        return self.model.decode([i]).encode() if self.model.is_unknown(i) else name.replace(MARKER, " ").encode()

    def segment(self, keys: list[str]) -> list[bytes]:
        """The ids of each chunk; the model puts the first marker in front by itself."""
        return [np.array(ids, dtype="<i4").tobytes() if k else np.int32(self.marker).tobytes() for k, ids in zip(keys, self.model.encode(keys, num_threads=1), strict=True)]

    def table(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct chunks; those that the cache lacks are segmented, each once."""
        if len(self.new) > self.generation:
            self.old, self.new = self.new, {}
        missing = []
        for k in keys:
            if k not in self.new:
                if (v := self.old.get(k)) is None:
                    missing.append(k)
                else:
                    self.new[k] = v
        got = dict(zip(missing, self.segment(missing), strict=True)) if missing else {}
        self.new |= {k: v for k, v in got.items() if len(k) <= LONG}
        return [self.new[k] if k in self.new else got[k] for k in keys]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids end."""
        if not self.apart:
            each = [np.array(ids, dtype="<i4") for ids in self.model.encode(texts, num_threads=1)] or [np.zeros(0, dtype="<i4")]
            return np.concatenate(each), np.cumsum([len(x) for x in each])
        texts = [t.replace(MARKER, " ") for t in texts]
        odd = [i for i, t in enumerate(texts) if "  " in t or t[-1:] == " " or t[:1] == " " or not t]
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        length = np.diff(lists.offsets.to_numpy())
        values = lists.values
        if odd:
            # Texts with longer runs of spaces, or spaces at an end, are cut by the pattern; an empty text has no chunk.
            cut = {i: [c[1:] for c in CHUNK.findall(" " + texts[i])] if texts[i] else [] for i in odd}
            parts, at, offsets = [], 0, lists.offsets.to_numpy()
            for i in odd:
                parts += [values.slice(offsets[at], offsets[i] - offsets[at]), pa.array(cut[i], pa.large_string())]
                length[i], at = len(cut[i]), i + 1
            values = pa.chunked_array([*parts, values.slice(offsets[at])], pa.large_string()).combine_chunks()
            values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
        coded = values.dictionary_encode()
        ids, at = gather(self.table(coded.dictionary.to_pylist()), coded.indices.to_numpy(), "<i4")
        ends = length.cumsum()
        return ids, np.concatenate([[0], at])[ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of documents' ids, which are end to end in ``ids`` and end at ``ends``."""
        starts = np.concatenate([[0], ends[:-1]])
        if not self.apart:
            return [self.model.decode(ids[a:b].tolist()) for a, b in zip(starts, ends, strict=True)]
        flat, at = gather(self.surface, ids, "u1")
        cut = np.concatenate([[0], at])
        # The marker that encoding puts in front goes again.
        return [flat[cut[a] + int(b > a and flat[cut[a]] == 32) : cut[b]].tobytes().decode("utf-8", "replace") if cut[b] > cut[a] else "" for a, b in zip(starts, ends, strict=True)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The worker's model."""
    return Pieces(path)


def sentence_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (array of int, the end id last), decoded (string), as the sentencepiece library gives them.

    ``model_path`` is a model that each worker can read. Where the model's pieces cannot reach over a space marker, and it
    normalises spaces alone, texts are cut before each run of spaces; each distinct chunk of some million characters of
    texts is segmented once, and ids are joined back by position. With any other model whole texts are encoded. A task
    holds those texts, one very long document at most, and a bounded cache of chunks. Nothing is shuffled.

    A null or empty text has the end id alone and decodes to the empty text. Rows are independent: null and repeated ids
    pass through. An empty table gives no rows; other columns of docs are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model_path)
        end = p.model.eos_id()
        for keys, texts in groups(batches):
            ids, ends = p.encode(texts)
            decoded = p.decode(ids, ends)
            ended = np.insert(ids, ends, end)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ended, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
