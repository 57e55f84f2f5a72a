"""Token-id files: documents compressed one by one with a shared dictionary, with an offset index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm.shared import scratch_path
from chronofact.llm.chunks import groups
from chronofact.llm.tokens import encoder

#: One row is one block: frames back to back, and for each document its id, offset, length and number of ids.
BLOCK = "part int, block int, start long, n_tokens long, dictionary string, width int, payload binary, doc_ids array<long>, offsets array<int>, lengths array<int>, counts array<long>"


def train_dictionary(docs: DataFrame, tokenizer: str, rows: int = 500, chars: int = 8192, size: int = 64 << 10) -> bytes:
    """A zstandard dictionary of serialized id arrays, fitted on ``rows`` documents (by hash of id) and ``chars`` characters of each.

    Only compression depends on the sample. Too few samples for a fit give an empty dictionary.
    """
    sample = docs.select(F.substring(F.coalesce(F.col("text"), F.lit("")), 1, chars).alias("t"), F.xxhash64("doc_id").alias("k")).orderBy("k", "t").limit(rows)
    e, width = encoder(tokenizer), _width(tokenizer)
    arrays = [_narrow(e.encode([r["t"]])[0], width) for r in sample.toLocalIterator()]
    try:
        return zstandard.train_dictionary(size, [a for a in arrays if len(a) > 7]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _width(tokenizer: str) -> int:
    """Bytes of a stored id."""
    return 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4


def _narrow(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_bytes: int = 256 << 10, level: int = 1) -> None:
    """Encodes docs(doc_id, text), appends end_id to each and writes the files to ``path`` in ascending doc_id order.

    path/dictionary has the dictionary under its SHA-256; path/blocks has the blocks. Range partitions keep the order
    across files; a document is never cut, so a block holds one very long document at most beyond its size.
    """
    spark = docs.sparkSession
    data = train_dictionary(docs, tokenizer)
    name, width = hashlib.sha256(data).hexdigest(), _width(tokenizer)
    spark.createDataFrame([(name, bytearray(data))], "dictionary string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    end = np.array([end_id], dtype="<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, block, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data))
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("dictionary", pa.string()), ("width", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        frames, ids, counts, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            lengths = [len(f) for f in frames]
            offsets = [0, *accumulate(lengths[:-1])]
            return pa.RecordBatch.from_pylist([dict(part=part, block=block, start=start, n_tokens=sum(counts), dictionary=name, width=width, payload=b"".join(frames), doc_ids=ids, offsets=offsets, lengths=lengths, counts=counts)], schema)

        for keys, texts in groups(batches):
            flat, at = e.encode(texts)
            for doc_id, a, b in zip(keys, [0, *at[:-1]], at, strict=True):
                raw = np.concatenate([flat[a:b], end])
                frames.append(press.compress(_narrow(raw, width)))
                ids.append(doc_id)
                counts.append(len(raw))
                size += len(frames[-1])
                if size >= block_bytes:
                    yield row()
                    block, start = block + 1, start + sum(counts)
                    frames, ids, counts, size = [], [], [], 0
        if frames:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(pack, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _starts(blocks: DataFrame) -> DataFrame:
    """(part, before): ids in the files before each; one row a file."""
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    rows = sorted((r["part"], r["n"]) for r in sums.toLocalIterator())
    before, out = 0, []
    for part, n in rows:
        out.append((part, before))
        before += n
    return blocks.sparkSession.createDataFrame(out, "part int, before long")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits).

    With ``doc_ids``, only blocks whose index holds one are decompressed, and of those only the frames asked for.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    data = {r["dictionary"]: bytes(r["data"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}
    starts = F.broadcast(_starts(blocks.select("part", "n_tokens")))
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast("long") for x in wanted])))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {k: b.column(k)[r].as_py() for k in b.schema.names}
                if row["dictionary"] not in data or hashlib.sha256(data[row["dictionary"]]).hexdigest() != row["dictionary"]:
                    raise ValueError(f"block {row['part']}/{row['block']} was written with another dictionary")
                plain = zstandard.ZstdDecompressor(dict_data=_dictionary(data[row["dictionary"]]))
                out, at = [], row["before"] + row["start"]
                for doc_id, offset, length, n in zip(row["doc_ids"], row["offsets"], row["lengths"], row["counts"], strict=True):
                    if wanted is None or doc_id in wanted:
                        ids = np.frombuffer(plain.decompress(row["payload"][offset : offset + length]), f"<u{row['width']}")
                        if len(ids) != n:
                            raise ValueError(f"document {doc_id} has {len(ids)} ids; its index says {n}")
                        out.append((doc_id, at, n, ids.astype("<u4").tobytes()))
                    at += n
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(starts, "part").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs(doc_id, text) as token files in the shared folder, reads them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone. A null doc_id comes first. Rows that share a doc_id are documents of
    their own, in text order. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
