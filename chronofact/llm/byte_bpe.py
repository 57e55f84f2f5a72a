"""Byte-level BPE by recursive DuckDB queries inside each partition."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.chunks import ChunkCoder, gather, groups

#: Parts and bytes of one recursive query; bounds its memory.
PARTS, BYTES = 60_000, 600_000
#: Parts of more bytes keep no earlier steps.
LONG_PART = 48
#: Characters of the documents that are looked at together.
CHARS = 6_000_000
#: Ids that are decoded together.
TOKENS = 1_000_000

#: Rows are tokens at places of parts. A step joins neighbours to the merges, finds each part's least rank, leftmost
#: first, and contracts that pair; parts without a pair left drop out, and their last state is the fixpoint.
SHORT = """
with recursive state as (
  select part, pos, token, 0 as step, (m.merged::bigint << 32) + pos as score
  from (select part, pos, token, lead(token) over (partition by part order by pos) as follows from base)
  left join merges m on m.pair = (token::bigint << 20) + follows
  union all (
    with best as (select part, min(score) as least from state group by part having min(score) is not null),
    marked as (
      select s.part, s.pos, s.token, s.step, s.score, best.least, lag(s.score) over (partition by s.part order by s.pos) as before
      from state s join best on best.part = s.part
    ),
    contracted as (
      select part, pos, step, case when score = least then (least >> 32)::integer else token end as token
      from marked where before is distinct from least
    )
    select part, pos, token, step + 1, (m.merged::bigint << 32) + pos
    from (select part, pos, token, step, lead(token) over (partition by part order by pos) as follows from contracted)
    left join merges m on m.pair = (token::bigint << 20) + follows
  )
)
"""
SHORT_IDS = SHORT + """
, last as (select part, max(step) as step from state group by part)
select state.pos, state.token from state join last on last.part = state.part and last.step = state.step order by state.pos
"""
#: The largest rank by which each part was contracted, and how many tokens it ends with.
SHORT_RANKS = SHORT + """
, steps as (select part, step, min(score) >> 32 as least, count(*) as n from state group by part, step)
select part, max(least) as most, arg_max(n, step) as n from steps group by part order by part
"""
#: The same for long parts: the key keeps the last state of each place only (a contracted place has no token), and a step
#: contracts all places of the least rank, each other one where they overlap, or the leftmost alone ({leftmost}).
LONG = """
with recursive state(part, pos, token, score) using key (part, pos) as (
  select part, pos, token, m.merged as score
  from (select part, pos, token, lead(token) over (partition by part order by pos) as follows from base)
  left join merges m on m.pair = (token::bigint << 20) + follows
  union all (
    with best as (select part, min(score) as least from state where token is not null group by part having min(score) is not null),
    living as (
      select s.part, s.pos, s.token, s.score is not distinct from best.least as hit, best.least, row_number() over (partition by s.part order by s.pos) as n
      from state s join best on best.part = s.part where s.token is not null
    ),
    marked as (
      select *, hit and (n - coalesce(max(case when hit then null else n end) over w, 0)) % 2 = 1 and (not {leftmost} or count(case when hit then 1 end) over w = 1) as starts
      from living window w as (partition by part order by pos)
    ),
    contracted as (
      select part, pos, case when lag(starts) over (partition by part order by pos) then null when starts then least else token end as token from marked
    )
    select part, pos, token, m.merged
    from (select part, pos, token, case when token is not null then lead(token) over (partition by part, token is null order by pos) end as follows from contracted)
    left join merges m on m.pair = (token::bigint << 20) + follows
  )
)
select pos, token from state where token is not null order by pos
"""
#: Ordered aggregation of the tokens' bytes, written as the letters of code points 0 to 255.
DECODE = "select doc, string_agg(letters, '' order by pos) as letters from ids join vocabulary using (token) group by doc"


class Encoder(ChunkCoder):
    """A worker's merge table in DuckDB; values are ids (little-endian, 32 bits)."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        super().__init__()
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        merges = [((self.ranks[t[:i]] << 20) + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        #: Pairs of bytes that stand side by side in some token; no merge reaches over any other pair.
        self.inside = np.zeros((256, 256), dtype=bool)
        for t in self.ranks:
            b = np.frombuffer(t, dtype=np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        self.db.register("m", pa.table({"pair": pa.array([p for p, _ in merges], pa.int64()), "merged": pa.array([r for _, r in merges], pa.int32())}))
        self.db.register("v", pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "letters": pa.array([t.decode("latin-1") for t in self.ranks])}))
        self.db.execute("create table merges as from m; create table vocabulary as from v")

    @cached_property
    def steady(self) -> bool:
        """Whether each token's bytes are merged into it by no rank above its own.

        Then no contraction brings forth a pair of lower rank, and equal pairs may be contracted in one step.
        """
        tokens = list(self.ranks)
        for at in range(0, len(tokens), PARTS):
            some = tokens[at : at + PARTS]
            self._base(np.frombuffer(b"".join(some), dtype=np.uint8), np.repeat(np.arange(len(some), dtype=np.int32), [len(t) for t in some]))
            got = self.db.execute(SHORT_RANKS).fetchnumpy()
            most = np.ma.filled(got["most"], -1)
            own = np.array([self.ranks[t] if len(t) > 1 else -1 for t in some])
            if (got["n"] != 1).any() or (most != own).any():
                return False
        return True

    def _base(self, flat: np.ndarray, part: np.ndarray, pos: np.ndarray | None = None) -> None:
        at = np.arange(len(flat), dtype=np.int32) if pos is None else pos.astype(np.int32)
        self.db.register("base", pa.table({"part": part, "pos": at, "token": self.bytes[flat]}))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, which are cut where no merge reaches over into parts first."""
        length = np.array([len(b) for b in words])
        ends = length.cumsum()
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        new = np.ones(len(flat), dtype=bool)
        new[1:] = ~self.inside[flat[:-1], flat[1:]]
        new[ends[:-1]] = True
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(flat)))
        part = np.repeat(np.arange(len(first), dtype=np.int32), size)
        long = (size > LONG_PART)[part]
        pos, token = [], []
        for which, query in ((~long, SHORT_IDS), (long, LONG)):
            # A query takes whole parts: PARTS and BYTES at most, or one longer part.
            at = np.flatnonzero(which)
            if query is LONG and len(at):
                query = LONG.format(leftmost=not self.steady)
            while len(at):
                n = int(np.searchsorted(part[at], part[at[0]] + PARTS))
                if n > BYTES:
                    n = max(int(np.searchsorted(part[at], part[at[BYTES]])), int(np.searchsorted(part[at], part[at[0]], side="right")))
                now, at = at[:n], at[n:]
                self._base(flat[now], part[now], now)
                got = self.db.execute(query).fetchnumpy()
                pos.append(got["pos"])
                token.append(got["token"])
        pos, token = np.concatenate(pos), np.concatenate(token).astype("<u4")
        order = np.argsort(pos, kind="stable")
        token, cut = token[order], np.searchsorted(pos[order], ends)
        return [token[a:b].tobytes() for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def resolve(self, keys: list[str]) -> dict[str, bytes]:
        """Cuts the keys' texts into words by the pattern; all new words go through one query, or some of bounded size."""
        cut = {k: self.pattern.findall(k[1:] if k[:1] == " " else " " + k) for k in keys}
        known: dict[str, bytes] = {}
        hard = []
        for w in {w for ws in cut.values() for w in ws}:
            v = self.known(w[1:] if w[:1] == " " and " " not in w[1:] else " " + w)
            if v is not None:
                known[w] = v
            elif (r := self.ranks.get(w.encode())) is not None:
                known[w] = struct.pack("<I", r)
            else:
                hard.append(w)
        if hard:
            known |= zip(hard, self.merge([w.encode() for w in hard]), strict=True)
        return {k: known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for k, ws in cut.items()}

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of documents' ids, which are end to end in ``ids`` and end at ``ends``."""
        out = [b""] * len(ends)
        at = 0
        while at < len(ends):
            # Documents of TOKENS ids together, or one longer.
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + TOKENS, side="right")))
            doc = np.repeat(np.arange(at, to, dtype=np.int32), np.diff(ends[at:to], prepend=start))
            self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(doc), dtype=np.int32), "token": ids[start : ends[to - 1]].astype(np.int32)}))
            for i, letters in self.db.execute(DECODE).fetchall():
                out[i] = letters.encode("latin-1")
            at = to
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids end."""
        values, codes, ends = self.code(texts)
        ids, at = gather(values, codes, "<u4")
        return ids, at[ends - 1] if len(ends) else ends


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids and decoded: binary, the ids as little-endian 32-bit integers.

    ``ranks_path`` is a file of byte sequences and ranks that each worker can read; ``pattern`` splits texts before the
    merges. A partition's documents are taken some million characters at a time, so a task holds those, one very long
    document at most, and a bounded cache of words; the memory of a word follows its length. A null or empty text has no ids. Rows are independent: null and
    repeated ids pass through, and nothing is shuffled. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks_path, pattern)
        for keys, texts in groups(batches, CHARS):
            ids, ends = e.encode(texts)
            each = [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(each, pa.binary()), pa.array(e.decode(ids, ends), pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")
