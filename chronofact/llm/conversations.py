"""Repair of conversations: generalised LR parsing of their roles, with weighted edits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import batched, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronofact.llm.shared import written

#: Roles by their initials, which are the grammar's terminals.
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: (left side, right side): perhaps a system turn, then pairs of a user's and an assistant's turn, or nothing.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
#: Terminals that rerole and insert may make, and what the edits cost.
MADE = "ua"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a block; a longer conversation is repaired block by block.
BLOCK = 256
#: Results of short blocks that a worker remembers.
REMEMBERED, SHORT = 50_000, 24
NOT_SPACE, SPACES, ENDS = r"([^\x20\x09-\x0D])", r"[\x20\x09-\x0D]*", ".!?"
TURNS = "conv_id long, block long, turns array<struct<role:string,text:string>>"

#: The least edits of each stack: cost, audit, and for each edit the terminal that it made, or ``-``.
Edits = tuple[int, str, str]
Best = dict[int, Edits]


class Automaton:
    """The LR(0) automaton of a grammar, whose conflicts are left to the parser. State 0 starts; ACCEPT is reached by the whole."""

    def __init__(self, grammar: tuple[tuple[str, str], ...]) -> None:
        self.rules = (("", grammar[0][0]), *grammar)
        heads = {left for left, _ in grammar}
        states = [self._closure({(0, 0)})]
        self.goto: list[dict[str, int]] = []
        for items in states:
            moves: dict[str, int] = {}
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                to = self._closure({(r, d + 1) for r, d in items if self.rules[r][1][d : d + 1] == symbol})
                if to not in states:
                    states.append(to)
                moves[symbol] = states.index(to)
            self.goto.append(moves)
        self.reduces = [[r for r, d in sorted(items) if r and d == len(self.rules[r][1])] for items in states]
        self.accept = self.goto[0][self.rules[0][1]]
        self.shifts = [any(s not in heads for s in moves) for moves in self.goto]

    def _closure(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo, seen = list(items), set(items)
        while todo:
            r, d = todo.pop()
            for i, (left, _) in enumerate(self.rules):
                if left and self.rules[r][1][d : d + 1] == left and (i, 0) not in seen:
                    seen.add((i, 0))
                    todo.append((i, 0))
        return frozenset(seen)


class Repairer:
    """Parses rows of roles with edits.

    The graph-structured stack holds each stack as its top state over the stack below, which it shares; equal stacks of a
    frontier are one node with the least (cost, audit). Left recursion keeps stacks short, so there are few nodes however
    long a conversation is.
    """

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR) -> None:
        self.lr = Automaton(grammar)
        self.tops: list[tuple[int, int]] = []
        self.ids: dict[tuple[int, int], int] = {}
        self.moved: dict[tuple[int, str], tuple[int, ...]] = {}
        root = self._stack(0, -1)
        self.start = self._reduced(root)
        #: Every stack that can stand between two turns.
        self.stacks = list(self.start)
        for s in self.stacks:
            for c in ROLES:
                self.stacks += [t for t in self.shifted(s, c) if t not in self.stacks]
        self.accepts = [s for s in self.stacks if self.tops[s] == (self.lr.accept, root)]
        self.known: dict[tuple[str, bool], dict[tuple[int, int], Edits]] = {}

    def _stack(self, state: int, below: int) -> int:
        """The number of the stack that has the state on top of another one."""
        if (state, below) not in self.ids:
            self.ids[state, below] = len(self.tops)
            self.tops.append((state, below))
        return self.ids[state, below]

    def _reduced(self, stack: int) -> tuple[int, ...]:
        """The stack and all that reductions make of it, without those from which nothing more can come."""
        met = [stack]
        for s in met:
            for r in self.lr.reduces[self.tops[s][0]]:
                left, right = self.lr.rules[r]
                below = s
                for _ in right:
                    below = self.tops[below][1]
                to = self.lr.goto[self.tops[below][0]].get(left)
                if to is not None and (t := self._stack(to, below)) not in met:
                    met.append(t)
        return tuple(s for s in met if self.lr.shifts[self.tops[s][0]] or self.tops[s][0] == self.lr.accept)

    def shifted(self, stack: int, terminal: str) -> tuple[int, ...]:
        """The stacks behind a shift of the terminal and any reductions."""
        if (stack, terminal) not in self.moved:
            to = self.lr.goto[self.tops[stack][0]].get(terminal)
            self.moved[stack, terminal] = () if to is None else self._reduced(self._stack(to, stack))
        return self.moved[stack, terminal]

    def _insert(self, best: Best) -> None:
        """Adds what inserts make of a frontier; each costs, so none comes back to a stack for less."""
        todo = sorted(best, key=best.__getitem__)
        for s in todo:
            cost, audit, made = best[s]
            for c in MADE:
                new = (cost + INSERT, audit + "I", made + c)
                for t in self.shifted(s, c):
                    if t not in best or new < best[t]:
                        best[t] = new
                        todo.append(t)

    def edits(self, signs: str, entry: tuple[int, ...]) -> Best:
        """The least (cost, audit) of every stack behind the turns, from stacks before them.

        A turn's sign is its role's initial, in upper case if it is truncated; ``-`` must be deleted, ``?`` has no known
        role and ``!`` none and is truncated. Two audits of equal cost over the same turns never begin one another (only
        inserts read no turn, and they cost), so the least of equal stacks stays the least whatever follows.
        """
        best: Best = {s: (0, "", "") for s in entry}
        self._insert(best)
        for sign in signs:
            own, more = sign.lower(), TRUNCATED if sign.isupper() or sign == "!" else 0
            after: Best = {}
            for s, (cost, audit, made) in best.items():
                options = [(s, (cost + DELETE, audit + "D", made + "-"))]
                if sign != "-":
                    kept = (cost + more, audit + "K", made + "-")
                    options += [(t, kept) for t in self.shifted(s, own)]
                    options += [(t, (cost + REROLE + more, audit + "R", made + c)) for c in MADE if c != own for t in self.shifted(s, c)]
                for t, new in options:
                    if t not in after or new < after[t]:
                        after[t] = new
            best = after
            self._insert(best)
        return best

    def matrix(self, signs: str, first: bool) -> dict[tuple[int, int], Edits]:
        """(stack before, stack behind) -> least edits; those of a conversation's first block from its start alone."""
        found = self.known.get((signs, first))
        if found is None:
            entries = [self.start] if first else [(s,) for s in self.stacks]
            found = {(e[0], t): v for e in entries for t, v in self.edits(signs, e).items()}
            if len(signs) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[signs, first] = found
        return found

    def whole(self, matrices: list[list[tuple[int, int, Edits]]]) -> tuple[int, list[tuple[str, str]]]:
        """Matrices of a conversation's blocks in order -> its least cost, and each block's audit and made terminals."""
        now: Best = {s: (0, "", "") for s in self.start}
        back: list[dict[int, tuple[int, str, str]]] = []
        for entries in matrices:
            after: Best = {}
            via: dict[int, tuple[int, str, str]] = {}
            for before, behind, (cost, audit, made) in entries:
                if before in now:
                    new = (now[before][0] + cost, now[before][1] + audit, now[before][2] + made)
                    if behind not in after or new < after[behind]:
                        after[behind], via[behind] = new, (before, audit, made)
            now = after
            back.append(via)
        at = min((s for s in self.accepts if s in now), key=now.__getitem__)
        cost, parts = now[at][0], []
        for via in reversed(back):
            at, audit, made = via[at]
            parts.append((audit, made))
        return cost, parts[::-1]


@lru_cache(maxsize=1)
def repairer() -> Repairer:
    """The worker's parser."""
    return Repairer()


def faults(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> these, with null roles and texts as one space, and same (128-bit hash of role and
    text), blank, cut (the last character ends no sentence) and seen (a smaller turn has the role and text).

    The first turn of each role and text comes from an aggregation, which combines before the shuffle, so that a long
    conversation's turns need not meet in one task.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("same", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    place = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    repeats = rows.groupBy("conv_id", "same").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.alias("r").join(repeats.alias("f"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.same") == F.col("f.same")), "left")
    last = F.regexp_extract("text", NOT_SPACE + SPACES + r"\z", 1)
    return joined.select("r.conv_id", "turn", "role", "text", "r.same", (last == "").alias("blank"), (~F.lit(ENDS).contains(last)).alias("cut"), F.coalesce(place > F.col("first"), F.lit(False)).alias("seen"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
EDITS = "array<struct<before:int,behind:int,cost:long,audit:string,made:string>>"
BLOCKS = f"conv_id long, roles array<string>, texts array<string>, {', '.join(c + ' long' for c in COUNTS)}, low long, high long, numbers long, first_turn long, last_turn long, first_initial string, last_initial string, entries {EDITS}"


def legal(a: str, b: str) -> bool:
    """Whether two roles' initials may be neighbours."""
    return a + b in ("su", "ua", "au")


def one_block(conv_id: int | None, first: bool, rows: list[tuple]) -> tuple:
    """(turn, role, text, fault) of neighbouring turns -> a row of BLOCKS; ``first`` if no turn is known to be before them."""
    signs, count = [], dict.fromkeys(COUNTS, 0)
    for _, role, _, fault in rows:
        if fault:
            count[fault] += 1
        known, cut = role[:1] in ROLES, fault == "truncated"
        signs.append("-" if fault in ("blank", "duplicate") else ("!" if cut else "?") if not known else role[0].upper() if cut else role[0])
    initials = [r[1][:1] for r in rows]
    count["illegal"] = sum(not legal(a, b) for a, b in pairwise(initials))
    numbers = {r[0] for r in rows} - {None}
    entries = [(a, b, *v) for (a, b), v in repairer().matrix("".join(signs), first).items()]
    return (
        conv_id, [r[1] for r in rows], [r[2] for r in rows], *count.values(), min(numbers, default=None), max(numbers, default=None), len(numbers), rows[0][0], rows[-1][0], initials[0], initials[-1],
        [dict(zip(("before", "behind", "cost", "audit", "made"), e, strict=True)) for e in entries],
    )


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of ``size``."""
    for some in batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """turns with faults -> conversations cut into blocks of at most ``size`` turns (see BLOCKS); ``block`` orders them."""
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, now, before, first, met = [], None, None, False, False
        for conv_id, turn, role, text, same, blank, unended, seen in rows:
            other = not met or conv_id != now
            if held and (other or len(held) == size):
                yield one_block(now, first, held)
                held, first = [], False
            if other:
                # Turns are sorted, so a conversation that isn't the task's first begins here.
                now, before, first, met = conv_id, None, met, True
            # Equal turns of one number stand together; all but the first of them are seen before.
            fault = "blank" if blank else "duplicate" if seen or (turn, same) == before else "truncated" if unended else ""
            before = (turn, same)
            held.append((turn, role, text, fault))
        if held:
            yield one_block(now, first, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, size) for r in zip(*(c.to_pylist() for c in b.slice(at, size).columns), strict=True))
        yield from batches_of(cut(rows), schema, size)

    order = ("conv_id", "turn", "role", "same")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "text", "same", "blank", "cut", "seen").mapInArrow(run, BLOCKS).select(F.monotonically_increasing_id().alias("block"), "*")


SUMMARY = f"conv_id long, gaps long, {', '.join(c + ' long' for c in COUNTS)}, cost long, audit string, parts array<struct<block:long,audit:string,made:string>>"


def summary(conv_id: int | None, found: list[dict]) -> tuple:
    """A conversation's blocks in order, without their texts -> a row of SUMMARY."""
    total = {c: sum(b[c] for b in found) for c in COUNTS}
    seams = list(pairwise(found))
    total["illegal"] += sum(not legal(a["last_initial"], b["first_initial"]) for a, b in seams)
    numbers = sum(b["numbers"] for b in found) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in seams)
    low, high = [b["low"] for b in found if b["low"] is not None], [b["high"] for b in found if b["high"] is not None]
    gaps = max(high) - min(low) + 1 - numbers if low else 0
    cost, parts = repairer().whole([[(e["before"], e["behind"], (e["cost"], e["audit"], e["made"])) for e in b["entries"]] for b in found])
    named = [{"block": b["block"], "audit": audit, "made": made} for b, (audit, made) in zip(found, parts, strict=True)]
    return conv_id, gaps, *total.values(), cost, "".join(a for a, _ in parts), named


def repaired_turns(roles: list[str], texts: list[str], audit: str, made: str) -> list[dict]:
    """A block's turns behind its edits."""
    turns = iter(zip(roles, texts, strict=True))
    out = []
    for edit, c in zip(audit, made, strict=True):
        role, text = (None, "") if edit == "I" else next(turns)
        if edit != "D":
            out.append({"role": role if edit == "K" else ROLES[c], "text": text})
    return out


def repair_conversations(turns: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, turn, role, text) -> (conversations, their repaired turns by blocks).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit. Turns count in order of
    (turn, role, hash of role and text), nulls first; a turn's first fault counts. Edits are the cheapest that make the
    roles' initials fit GRAMMAR: K keeps, R reroles to user or assistant, D deletes (blank and duplicate turns must go),
    I inserts an empty turn; ties go to the least audit. Repaired turns: conv_id, block (orders them), turns (array of
    role, text).

    Turns are dealt by ranges and cut into blocks, so tasks share a conversation of any length. A block's least edits
    between all stacks before and behind it are found at once; each conversation's blocks are then joined without their
    texts, and the chosen edits are applied block by block. Only the audit, a letter an edit, is whole in one place.

    A null role or text reads as one space; a role whose initial is none of s, u and a (or that is empty) is never kept as
    it is. Rows with a null conv_id are one conversation. A table without turns gives no rows; other columns of turns are
    left out, whatever their names.
    """
    # Stored, so that block numbers stay the same whichever task is lost later.
    stored = written(blocks(faults(turns), size), "conversation_blocks")
    lean = F.struct(*[c for c in stored.columns if c not in ("conv_id", "roles", "texts")])
    grouped = stored.groupBy("conv_id").agg(F.array_sort(F.collect_list(lean)).alias("blocks"))
    summary_schema, turn_schema = to_arrow_schema(StructType.fromDDL(SUMMARY)), to_arrow_schema(StructType.fromDDL(TURNS))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((summary(c.as_py(), found.as_py()) for b in batches for c, found in zip(*b.columns, strict=True)), summary_schema, size)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(((c.as_py(), n.as_py(), repaired_turns(*(x.as_py() for x in rest))) for b in batches for c, n, *rest in zip(*b.columns, strict=True)), turn_schema, size)

    conversations = written(grouped.mapInArrow(join, SUMMARY), "conversations")
    edits = conversations.select(F.inline("parts"))
    repaired = stored.select("conv_id", "block", "roles", "texts").join(edits, "block").select("conv_id", "block", "roles", "texts", "audit", "made").mapInArrow(repair, TURNS)
    return conversations.drop("parts"), repaired
