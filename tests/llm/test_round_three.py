"""Conversation repair, periodic runs and SentencePiece against brute force and the public library."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from chronofact.llm import queries
from chronofact.llm.conversations import GRAMMAR, Repairer, faults, repair_conversations
from chronofact.llm.periodic_runs import collapsed, periodic_runs, scan_lags, surviving_segments, text_runs
from chronofact.llm.pieces import Pieces, sentence_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversations


def least_edits(signs):
    """Least (cost, audit) by recursion from the end over a hand-written machine of s?(ua)+."""
    steps = {("start", "s"): "s", ("start", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "")] if i == len(signs) and state in ("start", "a") else []
        if inserted < 3:
            options += [(c + 3, "I" + a) for r in "ua" if (state, r) in steps for c, a in [best(i, steps[state, r], inserted + 1)]]
        if i < len(signs):
            role, must_go, cut = signs[i]
            options += [(c + 4, "D" + a) for c, a in [best(i + 1, state, 0)]]
            if not must_go:
                for r in "sua":
                    if (state, r) in steps and (r == role or r in "ua"):
                        c, a = best(i + 1, steps[state, r], 0)
                        options.append((c + 3 * cut + 3 * (r != role), ("K" if r == role else "R") + a))
        return min(options, default=(10**9, ""))

    for i in range(len(signs), 0, -50):  # fills the memo from the end, so that recursion stays shallow
        for state in ("start", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "start", 0)


def order_of(r):
    turn, role, text = r
    return (turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def repaired_plainly(rows):
    """(turn, role, text) rows -> gaps, counts, cost, audit, repaired lines."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=order_of)
    seen, count, signs = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else ""
        if fault:
            count[fault] += 1
        seen.add((role, text))
        signs.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    initials = [s[0] for s in signs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, audit = least_edits(tuple(signs))
    kept = [c for c in audit if c != "D"]
    at, out = iter(rows), []
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(at)[1:]
        if edit == "D":
            continue
        n = len(out) - len(kept) % 2
        out.append(f"{role if edit == 'K' else ('user', 'assistant')[n % 2]}:{text}")
    return gaps, *count.values(), illegal, cost, audit, "\n".join(out)


def results(spark, found, repaired):
    got = {r["conv_id"]: [r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")] for r in found.collect()}
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: r["block"]):
        lines.setdefault(r["conv_id"], []).extend(f"{t['role']}:{t['text']}" for t in r["turns"])
    return {k: (*v, "\n".join(lines.get(k, []))) for k, v in got.items()}


SCHEMA = "conv_id long, turn long, role string, text string, same string, `block.x` int, value int"


@pytest.mark.parametrize("size", [1, 3, 256])
def test_conversation_repair(spark, size):
    rng = random.Random(size)
    rows = []
    for conv in [None, *range(40)]:
        for i in range(rng.choice([1, 2, 5, 9, 14])):
            turn = None if rng.random() < 0.1 else rng.choice([i, i, i + 1, i + 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No", "Why?", "", " \n", None, "long " * 50 + "!", f"Turn {i}.", f"cut {i}"])))
    rows += [(50, 1, "user", "Same."), (50, 1, "user", "Same."), (50, 1, "user", "Same."), (51, 0, "system", "Only.")]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = repaired_plainly([r[1:] for r in rows if r[0] == conv])
    assert results(spark, *repair_conversations(frame, size)) == want
    found, repaired = repair_conversations(frame.limit(0), size)
    assert found.count() == repaired.count() == 0


def test_a_long_conversation_is_shared(spark):
    """One conversation has nearly all turns: tasks share it, and its edits are those of the whole."""
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["Good.", f"Turn {i}.", f"cut {i}", ""])) for i in range(900)] + [(8, 0, "user", "Hi.")]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = results(spark, *repair_conversations(frame, 50))
    assert got[7] == repaired_plainly([r[1:] for r in rows if r[0] == 7])
    seen = faults(frame).where("seen").count()
    assert seen == sum(1 for r in rows if r[3] in ("Good.", "")) - len({r[2:] for r in rows if r[3] in ("Good.", "")})


def test_parser_is_exhaustive():
    """Every row of up to four signs has the least edits of the plain search; all stacks between turns are known."""
    p = Repairer()
    assert len(p.stacks) < 16 and len(GRAMMAR) == 5
    signs = ["s", "u", "a", "U", "-", "?", "!"]
    sign = {"s": ("s", False, False), "u": ("u", False, False), "a": ("a", False, False), "U": ("u", False, True), "-": ("u", True, False), "?": ("t", False, False), "!": ("t", False, True)}
    todo = [""]
    for _ in range(4):
        todo = [t + c for t in todo for c in signs]
        for t in todo:
            cost, parts = p.whole([[(a, b, v) for (a, b), v in p.matrix(t, True).items()]])
            assert (cost, "".join(a for a, _ in parts)) == least_edits(tuple(sign[c] for c in t)), t


def test_conversation_query(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    damaged = {r["conv_id"]: [] for r in turns}
    for r in turns:
        h = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", r["text"]) if h == 2 else r["text"]
        damaged[r["conv_id"]] += [(r["turn"], "user" if h == 4 else r["role"], text)] * (0 if h == 0 else 2 if h == 3 else 1)
    want = {c: (*v[:-1], sha(v[-1])) for c, v in ((c, repaired_plainly(rows)) for c, rows in damaged.items())}
    got = queries.op11_conversation_repair(spark, sf_dir).collect()
    assert {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got} == want
    assert len(got) == len(want)


# Periodic runs


def plain_runs(words, power=4, length=6):
    """All runs by definition."""
    out = {}
    n = len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(length, power * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((i, e - i, q) for (i, e), q in out.items())


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng):
    words = [rng.choice("abcde") + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 30))]
    for _ in range(rng.randint(0, 4)):
        part = rng.choices("ab" if rng.random() < 0.6 else "abcdef", k=rng.randint(1, 6))
        words += (part * rng.randint(1, 7))[: rng.randint(1, 40)] + rng.choices("abxyz", k=rng.randint(0, 5))
    return words


def test_runs_of_random_words():
    rng = random.Random(5)
    texts = [repetitive(rng) for _ in range(1500)] + [rng.choices("ab", k=200) for _ in range(60)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4]
    got = text_runs(texts, 4, 6)
    assert got == [sorted(plain_runs(t), key=lambda r: (r[0], r[2])) for t in texts]
    assert [collapsed(t, r) for t, r in zip(texts, got, strict=True)] == [plain_collapse(t, r) for t, r in zip(texts, got, strict=True)]
    assert [text_runs([t], 2, 3)[0] for t in texts[:200]] == [sorted(plain_runs(t, 2, 3), key=lambda r: (r[0], r[2])) for t in texts[:200]]


def test_segments_hold_no_rare_word():
    rng = np.random.default_rng(2)
    x = rng.zipf(1.4, 5000).clip(max=2000).astype(np.int64)
    starts, ends = surviving_segments(x, np.array([0, 2500]), np.array([2500, 5000]), 4, 6)
    for a, b in zip(starts, ends, strict=True):
        assert b - a >= 6 and np.unique(x[a:b], return_counts=True)[1].min() >= 4 and not a < 2500 < b


def test_long_scans_are_quick():
    """Lags of long segments are looked at in multiples of themselves."""
    x = np.random.default_rng(1).integers(0, 2, 60_000)
    x[1000:50_000] = np.resize(x[1000:8000], 49_000)
    assert any(q == 7000 and start <= 1000 and start + n >= 50_000 for start, n, q in scan_lags(x, 4, 6))


def test_periodic_runs(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "a a a a a a", "a a a a a", "é\té\né é é é", "x y x y x y x y x y x y", " ".join(rng.choices(["p", "q", "r"], k=30_000)), *(" ".join(repetitive(rng)) for _ in range(40))]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, "b b b b b b", "clash", 1), (None, "a a a a a a", "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, `a.b` int").repartition(3)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect())

    def plain(i, t):
        words = WORD.findall(t or "")
        runs = sorted(plain_runs(words) if len(words) < 5000 else text_runs([words], 4, 6)[0], key=lambda r: (r[0], r[2]))
        return (i is not None, i or 0, len(words), runs, plain_collapse(words, runs))

    assert got == sorted(plain(i, t) for i, t, *_ in rows)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_periodic_query(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        words = WORD.findall(r["text"] or "")
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = sorted(plain_runs(words), key=lambda x: (x[0], x[2])) if n < 3000 else sorted(text_runs([words], 4, 6)[0], key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        shape = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[r["doc_id"]] = (len(runs), *shape, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(plain_collapse(words, runs)))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    assert got == want
    assert sum(v[0] > 0 for v in want.values()) > 5


def test_planting_keeps_the_rest(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "one", "a b  c\nd", "x " * 50])] + [(None, "as it is")]
    got = queries.periodic(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    plain = {i: t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 or not (t or "").split()}
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in plain} == plain


# SentencePiece


ODD = ["", None, " ", "  ", "   x", "a ", " a", "a  b   c    d", "▁", "a▁b ▁ c", "a▁▁b", "中文 字 🙂", "<s> </s> <unk> <0x41>", "tab\tand\r\nline\n \n", "nul\x00l", "ﬁ Å é x", "x" * 3000, " " * 70 + "y" + " " * 40, "　wide▁ marks", "é" * 200 + " end  "]


def test_sentence_pieces(spark):
    rng = random.Random(4)
    letters = "ab  ▁éß中\n\t.🙂" + " "
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(400)] + [" ".join(rng.choices(["the", "house", "Überraschung", "", "of", "1999", "naïve"], k=4000))]
    rows = [(i, t, [1], "c") for i, t in enumerate(texts)] + [(3, "again", [1], "c"), (None, "no id", [1], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, `a.b` string").repartition(3)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"], r["decoded"]) for r in sentence_pieces(docs, MODEL).collect())
    want = sorted((i is not None, i or 0, ids, model.decode(ids)) for i, t, *_ in rows for ids in [model.encode(t or "", add_eos=True)])
    assert got == want
    assert sentence_pieces(docs.limit(0), MODEL).count() == 0


def test_each_chunk_is_segmented_once():
    p = Pieces(MODEL)
    assert p.apart
    asked = []
    segment = p.segment
    p.segment = lambda keys: asked.extend(keys) or segment(keys)
    ids, ends = p.encode(["the house the house", "the  house", "", "house"])
    p.encode(["house the"])
    assert sorted(asked) == sorted({"the", "house", " house"})
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [p.model.encode(t) for t in ["the house the house", "the  house", "", "house"]]
    whole = Pieces(MODEL)
    whole.apart = False
    a, b = p.encode([t or "" for t in ODD]), whole.encode([t or "" for t in ODD])
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert p.decode(*a) == whole.decode(*b)


def test_piece_query(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_sentence_pieces(spark, sf_dir).collect()}
    for r in docs:
        ids = model.encode(r["text"] or "", add_eos=True)
        assert got[r["doc_id"]] == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
    assert len(got) == len(docs)
