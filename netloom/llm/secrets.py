"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

The patterns find assigned keys and tokens, access key ids and long hexadecimal runs.  Passwords chosen by people look
like words, so a value that follows a credential word (as "pwd: ...") is judged by what it costs to guess: a dynamic
program over its characters finds the cheapest split into dictionary words (also backwards), dates, repeats, keyboard
walks (a turn costs more) and spans of brute force (Wheeler, "zxcvbn: Low-Budget Password Strength Estimation", 2016).
A value at or above min_bits is a "password" span, unless an assigned key covers it; placeholders and plain words stay
below.  Assigned values are judged as well: their spans stay, and their bits stand beside them.  The dictionary is a short list of common passwords and then,
where a vocabulary file of a byte-level tokenizer is given, its whole lower-case words in order of their ids, which is
about that of their frequency: a word's rank is its number of guesses.

Offsets count code points, end exclusive.  A null text is an empty one, without spans.
"""

from __future__ import annotations

import json
import math
import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "password")
# The patterns of the three plain kinds.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones may be skipped
# The credential word may end an identifier: after any letters where it is telling, else after "_", "-" and such or as in userPin.
CONTEXT = re.compile(r"""(?i:(?:password|passwd|passphrase|passcode|pwd|credentials?|secret|(?:token|api[_-]?key)(?=["']?\x20*[:=])|(?:(?<![a-z0-9])|(?<=[0-9])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass|pin|login)))["']?\x20*(?::|=|\bis\b)\x20*["']?([^\s"'<>]{6,})""", re.ASCII)

_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_CONTEXT_HINTS = (b"pass", b"pwd", b"pin", b"login", b"credential", b"secret", b"token", b"key")
_HEX_RUN = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

# Common words and passwords, the most common first; a word's rank is its cost.
COMMON = """
password 123456 qwerty admin letmein welcome monkey dragon master login abc123 iloveyou sunshine princess football
shadow superman batman trustno1 hello freedom whatever ninja secret hunter summer winter spring autumn baseball soccer
the and for you not are with this that from have will your test user root guest default changeme example sample
placeholder null none true false undefined password1 passw0rd love money computer internet server system network
database account private public access token key value string number name email phone love you baby angel jesus
michael jordan thomas charlie george andrew daniel jessica ashley michelle robert matthew joshua killer pepper ginger
cheese chocolate coffee orange banana apple purple yellow green black white silver golden diamond flower tiger eagle
""".split()
RANK = {w: k for k, w in reversed(list(enumerate(COMMON, 1)))}
LONGEST = 16
"""Letters of a dictionary word at most."""
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("0134578@$!", "oleastbasi")


TURN_BITS = math.log2(4.6)
"""Guesses of a turn of a keyboard walk: about so many keys lie beside one."""


def _neighbours() -> dict[str, tuple[int, int]]:
    """The way from one key to the next, as rows and columns, of all pairs of keys beside each other.

    Each row lies half a key to the right of the one above it; the digits' row begins one key farther left.
    """
    at = {c: (r, k - (r == 0)) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    ways = [(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)]
    return {a + b: (y[0] - x[0], y[1] - x[1]) for a, x in at.items() for b, y in at.items() if (y[0] - x[0], y[1] - x[1]) in ways}


NEAR = _neighbours()
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d|\d{1,2}[-/._]\d{1,2}[-/._]\d\d(?!\d)")


def _charset(text: str) -> int:
    return max(10, sum(n for n, pattern in ((10, "[0-9]"), (26, "[a-z]"), (26, "[A-Z]"), (33, r"[^0-9a-zA-Z]")) if re.search(pattern, text)))


def _least(starts: list[int], new: int, cost: list[float], more) -> float:
    """The least of cost[i] + more(i) over starts and new, where more grows with the logarithm of the way from i.

    A start that costs no less than a later one is worse for good, as is one that is worse now than an earlier one.
    """
    while starts and cost[starts[-1]] >= cost[new]:
        starts.pop()
    starts.append(new)
    totals = [cost[i] + more(i) for i in starts]
    k = min(range(len(totals)), key=totals.__getitem__)
    del starts[k + 1 :]
    return totals[k]


def ranked_words(raw: bytes) -> dict[str, int]:
    """COMMON and then the words of three letters or more in a tokenizers JSON file (a letter U+0120 for the space before)."""
    words = json.loads(raw)["model"]["vocab"]
    known = [w[1:] for w in sorted(words, key=words.__getitem__) if re.fullmatch(f"\u0120[a-z]{{3,{LONGEST}}}", w)]
    return {w: k for k, w in enumerate(dict.fromkeys([*COMMON, *known]), 1)}


def guess_bits(value: str, rank_of: dict[str, int] = RANK) -> float:
    """log2 of the guesses of the cheapest split of value.

    cost[j], the least over i < j of cost[i] + the cost of value[i:j] + one bit for the join, for each kind of span.
    Of the starts of repeats and walks only those are kept that may still be the best, so that long values cost about
    as much a character as short ones.
    """
    n = len(value)
    lower = value.lower()
    plain = lower.translate(LEET)
    brute = math.log2(_charset(value))
    cost = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    for k in range(n):
        if m := DATE.match(value, k):
            dates.setdefault(m.end(), []).append(k)
    walk: list[int] = []
    walked, turns, way, begun = 1, [0] * (n + 1), None, [0.0] * (n + 1)
    repeats: dict[tuple[int, int], list[int]] = {(size, k): [] for size in (1, 2, 3, 4) for k in range(size)}
    times = {key: 1 for key in repeats}
    for j in range(1, n + 1):
        best = min(cost[j], cost[j - 1] + brute)
        for i in range(max(0, j - LONGEST), j):
            for word, more in ((lower[i:j], 0.0), (plain[i:j], 1.0), (lower[i:j][::-1], 1.0)):
                if (rank := rank_of.get(word)) is not None and j - i > 1:
                    cased = 1.0 if value[i:j] != word else 0.0
                    best = min(best, cost[i] + 1 + math.log2(rank + 1) + more + cased)
        step = NEAR.get(lower[j - 2 : j]) if j > 1 else None
        walked = walked + 1 if step else 1
        turns[j] = turns[j - 1] + (step is not None and way is not None and step != way)
        way = step
        if walked >= 3:
            if walked == 3:
                walk.clear()
            begun[j - 3] = cost[j - 3] - TURN_BITS * turns[j - 1]  # the walk's own turns come after its first step
            best = min(best, TURN_BITS * turns[j] + _least(walk, j - 3, begun, lambda i: 1 + math.log2(94 * (j - i))))
        for i in dates.get(j, ()):
            best = min(best, cost[i] + 1 + (math.log2(365 * 120) if j - i > 4 else math.log2(120)))
        for size in (1, 2, 3, 4):  # a unit of size characters, twice or more
            key = (size, j % size)
            times[key] = times[key] + 1 if j >= 2 * size and value[j - size : j] == value[j - 2 * size : j - size] else 1
            if times[key] >= 2:
                if times[key] == 2:
                    repeats[key].clear()
                best = min(best, _least(repeats[key], j - 2 * size, cost, lambda i: 1 + size * brute + math.log2((j - i) // size)))
        cost[j] = best
    return cost[n]


def find_spans(text: str, min_bits: float, rank_of: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order."""
    out: list[tuple[int, int, int]] = []
    raw = text.encode("utf-8", "replace")
    lower = raw.lower()
    if any(h in lower for h in _HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in raw.translate(_HEX_RUN):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(h in lower for h in _CONTEXT_HINTS):
        assigned = {end for _, kind, end in out if kind == 0}
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)")
            if m.start(1) + len(value) in assigned or m.end(1) in assigned:
                continue
            if len(value) >= 6 and guess_bits(value, rank_of) >= min_bits:
                out.append((m.start(1), 3, m.start(1) + len(value)))
    return sorted(out)


def rated(text: str, spans, rank_of: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    """(start, kind, bits) of the spans whose value people choose: those of assigned keys and passwords."""
    values = [(a, k, ASSIGN.match(text, a)[2] if k == 0 else text[a:b]) for a, k, b in spans if k in (0, 3)]
    return [(a, k, int(guess_bits(v, rank_of))) for a, k, v in values]


def _name(spans, most: int = 4) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < most)


def masked(text: str, spans) -> str:
    """text with each span as [KIND]; of overlapping spans the first one names them all."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _run(min_bits: float, mask: bool, ranks):
    def run(batches):
        rank_of = ranks.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [find_spans(t, min_bits, rank_of) if t else [] for t in texts]
            if mask:
                column = pa.array([masked(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([column if f.name == "text" else c for f, c in zip(batch.schema, batch.columns, strict=True)], schema=batch.schema)
                continue
            counts = [pa.array([sum(1 for x in s if x[1] == k) for s in found], pa.int64()) for k in range(3)]
            digests = pa.array([sha256(_name(s, 3).encode()).hexdigest() for s in found], pa.string())
            bits = pa.array([_name([(a, k, b) for a, k, b in rated(t, s, rank_of)]) if s else "" for t, s in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([_name(s) for s in found], pa.string()), bits], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "guess_bits"])

    return run


def find_secrets(docs: DataFrame, min_bits: float = 28.0, ranks: dict[str, int] = RANK) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) and guess_bits of each row of docs.

    guess_bits has kind:start:bits of assigned values and passwords, joined likewise: what their values cost to guess.
    Repeated rows and null doc_ids are kept one by one, other columns left out; an empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_run(min_bits, False, docs.sparkSession.sparkContext.broadcast(ranks)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, guess_bits string")


def mask_secrets(docs: DataFrame, min_bits: float = 28.0, ranks: dict[str, int] = RANK) -> DataFrame:
    """docs with every secret in text replaced by its kind; other columns, of any names, as they are.

    A null text stays null; repeated rows are masked one by one; an empty table gives an empty one.
    """
    return docs.mapInArrow(_run(min_bits, True, docs.sparkSession.sparkContext.broadcast(ranks)), docs.schema)
