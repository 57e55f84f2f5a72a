"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose redacted texts are held at once.
ROWS = 256
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: What each search needs somewhere in the lower-cased bytes of a text; a scan in C tells most texts apart.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_CANDIDATE_MAP = bytes(104 if re.match(r"[A-Za-z0-9+/_=-]", chr(b)) else 32 for b in range(256))

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by size of alphabet; the first that holds all characters of a candidate is inferred.
ENCODINGS = (("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"), ("base36", _DIGITS + _LOWER), ("BASE36", _DIGITS + _UPPER), ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _DIGITS + _UPPER + _LOWER + "+/"), ("base64url", _DIGITS + _UPPER + _LOWER + "-_"))
#: Letters in a thousand of running text (English), a tenth of them spread evenly for names and other languages.
_FREQ = dict(zip(_LOWER, (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 7.7, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 9.8, 24, 1.5, 20, 0.7), strict=True))
_LETTER = {c: -math.log(0.9 * f / sum(_FREQ.values()) + 0.1 / 26) for c, f in _FREQ.items()}
#: Bounds of the chance that neighbours in ordinary text are of different classes (digits, small, large letters, signs).
SWITCH = (0.02, 0.3)


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def ordinary(s: str) -> float:
    """-ln of the chance of a candidate under the null hypothesis of ordinary text, fitted to the candidate.

    Words, identifiers, dates and numbers hold runs of one class; letters come as often as in running text and digits
    evenly. The classes and, within ``SWITCH``, how often they change are the candidate's own, which favours the null.
    """
    kinds = ["d" if c in _DIGITS else "l" if c in _LOWER else "u" if c in _UPPER else "s" for c in s]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    q = min(max(changes / (len(s) - 1), SWITCH[0]), SWITCH[1])
    n = Counter(kinds)
    cost = math.log(len(n)) + changes * math.log(max(len(n) - 1, 1) / q) - (len(s) - 1 - changes) * math.log(1 - q)
    return cost + n["d"] * math.log(10) + n["s"] * math.log(5) + sum(_LETTER[c] for c in s.lower() if c in _LETTER)


def battery(s: str) -> tuple[float, float] | None:
    """(p that ordinary text looks so random, p that random symbols look so uneven) of a candidate; None: not encoded data.

    Only mixtures of letters and digits are taken as encoded data; words and plain numbers are not. The first p is the
    likelihood ratio of ``ordinary`` text to random symbols of the inferred encoding (one of ENCODINGS, each as likely):
    a p by Markov's inequality, as its inverse has mean 1 under the null. Chi-squared uniformity of the alphabet, runs
    about its middle and the serial correlation of neighbours are held against randomness, Bonferroni over the three.
    """
    s = s.rstrip("=")
    found = next((a for _, a in ENCODINGS if not set(s) - set(a)), None)
    if found is None or len(s) < 16 or s.isalpha() or s.isdigit() or not any(c.isalpha() for c in s) or not any(c.isdigit() for c in s):
        return None
    n, k = len(s), len(found)
    chi = k / n * sum(c * c for c in Counter(s).values()) - n
    spread = math.sqrt(2 * (k - 1))
    text = math.exp(min(0.0, n * math.log(k) + math.log(len(ENCODINGS)) - ordinary(s)))
    at = [found.index(c) for c in s]
    high = [a >= k / 2 for a in at]
    ups = sum(high)
    downs = n - ups
    if not ups or not downs:
        return text, 0.0
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 1 + 2 * ups * downs / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    mid = sum(at) / n
    power = sum((a - mid) ** 2 for a in at)
    serial = sum((a - mid) * (b - mid) for a, b in zip(at, at[1:], strict=False)) / power if power else 1.0
    tests = (_upper((chi - (k - 1)) / spread), 2 * _upper(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0, 2 * _upper(abs(serial + 1 / n) * math.sqrt(n)))
    return text, min(1.0, 3 * min(tests))


def discoveries(tested: list[tuple[float, int]], rate: float) -> list[bool]:
    """Benjamini-Hochberg over (p, length), each p divided by its length's share, so that long candidates need less."""
    if not tested:
        return []
    mean = sum(n for _, n in tested) / len(tested)
    weighted = [p * mean / n for p, n in tested]
    passed = [p for i, p in enumerate(sorted(weighted), 1) if p <= rate * i / len(tested)]
    return [p <= max(passed, default=-1.0) for p in weighted]


def find_secrets(text: str | None, rate: float = 0.01, alpha: float = 0.01) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's secrets in code points, by start, then kind.

    Base kinds are leftmost, non-overlapping matches within their kind. A candidate of the battery is a secret if
    randomness is not rejected at ``alpha`` and it is a discovery against ordinary text at ``rate`` among the text's
    candidates; it is added only where it touches no base span.
    """
    if not text:
        return []
    raw = text.encode()
    low = raw.lower()
    out: list[tuple[str, int, int]] = []
    if any(n in low for n in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"h" * 16 in raw.translate(_HEX_MAP):
        out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    if b"h" * 20 in raw.translate(_CANDIDATE_MAP):
        base = list(out)
        tested = []
        for m in CANDIDATE.finditer(text):
            if any(a < m.end() and m.start() < b for _, a, b in base):
                continue
            if (found := battery(m[0])) is not None:
                tested.append((m, *found))
        hits = discoveries([(p, len(m[0])) for m, p, _ in tested], rate)
        out += [("random", *m.span()) for (m, _, r), hit in zip(tested, hits, strict=True) if hit and r >= alpha]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, rate: float = 0.01, alpha: float = 0.01) -> DataFrame:
    """docs(doc_id, text) -> doc_id and spans, an array of (kind, start, end) in code points, for every row.

    Null and empty texts have no spans. Each row is looked at alone and whole: null and repeated ids pass through, and
    nothing is shuffled. An empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t.as_py(), rate, alpha)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(text: str | None, rate: float = 0.01, alpha: float = 0.01) -> str | None:
    """The text with every secret replaced by its kind in brackets; overlapping spans are joined under the first kind."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in find_secrets(text, rate, alpha):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rate: float = 0.01, alpha: float = 0.01) -> DataFrame:
    """docs with secrets in the column text replaced; n_chars, if there, follows the new text. All rows and columns stay.

    Null texts stay null. No helper column is added to docs, so no name can clash. An empty table gives no rows.
    """

    @F.arrow_udf(T.StringType())
    def redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for at in range(0, len(b), ROWS):
                yield pa.array([redact(t.as_py(), rate, alpha) for t in b.slice(at, ROWS)], pa.string())
            pa.default_memory_pool().release_unused()

    both = docs.select(F.struct("*").alias("doc"), redacted(F.col("text")).alias("new"))
    out = {c: F.col(f"doc.`{c}`") for c in docs.columns}
    if "n_chars" in out:
        same = F.col("new").eqNullSafe(F.col("doc.text"))
        out["n_chars"] = F.when(same, out["n_chars"]).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    out["text"] = F.col("new")
    return both.select(*(x.alias(c) for c, x in out.items()))
