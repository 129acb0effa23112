"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton starts as that of all byte strings: one state per byte token, every arc present.  Each merge (u, v) -> w
is applied as a gadget, in order of rank: the state that u enters loses its arc v; a new state, entered by w, gets the
arcs that v's state has now; and w's arc leaves every state that u's arc leaves now.  What is left after all merges
accepts exactly the token strings that the merges produce (Berglund, Martens and van der Merwe, "Constructing a BPE
Tokenization DFA", 2024), one for each byte string.

The table of transitions holds, for each state, the arcs that it has lost.  A token is numbered in preorder of the tree
in which a token's parent is its left part, younger children first.  A lost arc v takes with it the arcs of the children
of v that are made later, so a gadget's loss is one interval of numbers, and a state's row is a sorted list of intervals.

A pre-split word is read byte by byte.  The table of suffixes (Aho and Corasick, 1975) leads from state to state and
names the tokens that end at each place, the longest first; the one whose arc leaves the state that the word has reached
where the token starts is the last label of the word so far.  There is exactly one at each place, so nothing is undone.
"""

from __future__ import annotations

import json
import os
import struct
from array import array
from bisect import bisect_left, bisect_right
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

# Fixed values of the byte-level format: the word pattern of its pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ASCII_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_SPACE = _ASCII_SPACE + "".join(chr(c) for c in range(0x80, 0x3001) if chr(c).isspace())

MEMO_BYTES = 32 << 20
"""Memory, about, of each of a worker's two generations of words whose ids it remembers."""
SLICE_BYTES = 2 << 20
"""Text that is encoded at once, a longer text alone."""
LONG_WORD = 256
"""Bytes of a word that is encoded by itself."""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Compiled merges: the table of arcs lost (first, lo, hi by state) and the table of suffixes (keys, to, fail, ends)."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None, pattern: str = PATTERN):
        self.pattern = pattern
        self.special = dict(special or {})
        self.labels: dict[int, bytes] = {k: t for t, k in vocabulary.items()}
        # tokens of one byte, or made by a merge, have arcs
        made = [(vocabulary[u], vocabulary[v], vocabulary[u + v]) for u, v in merges]
        self.entered = sorted({k for t, k in vocabulary.items() if len(t) == 1} | {w for _, _, w in made})
        self._compile(made)
        self._suffixes()
        self._tables: tuple | None = None
        self.encoder: Encoder | None = None

    def _compile(self, made: list[tuple[int, int, int]]) -> None:
        children: dict[int, list[int]] = {}  # by left part, in order of birth
        born: dict[int, int] = {}
        for time, (u, _, w) in enumerate(made):
            children.setdefault(u, []).append(w)
            born[w] = time
        number, last = {}, {}
        for root in (t for t in self.entered if t not in born):
            stack = [(root, False)]
            while stack:
                t, closed = stack.pop()
                if closed:
                    last[t] = len(number) - 1
                    continue
                number[t] = len(number)
                stack.append((t, True))
                stack += [(c, False) for c in children.get(t, ())]
        lost: dict[int, list[int]] = {t: [] for t in self.entered}
        begin, end = [], []
        for time, (u, v, w) in enumerate(made):
            own = children.get(v, [])
            # of the children of v those made later go too, and w itself where it is one
            k = bisect_left(own, time if u == v else time + 1, key=born.__getitem__)
            begin.append(number[v])
            end.append(last[own[k]] if k < len(own) else number[v])
            lost[w] = lost[v][:]
            lost[u].append(time)
        self.number = array("i", [-1]) * (max(self.labels, default=0) + 1)
        for t, k in number.items():
            self.number[t] = k
        self.first, self.lo, self.hi = array("i", [0]), array("i"), array("i")
        begin, end = np.array(begin, dtype=np.int32), np.array(end, dtype=np.int32)
        for t in range(len(self.number)):
            if row := lost.get(t):
                a, b = begin[row], end[row]
                order = np.lexsort((-b, a))
                a, b = a[order], b[order]
                new = np.concatenate(([True], b[1:] > np.maximum.accumulate(b)[:-1]))  # intervals of a tree lie apart or one in another
                self.lo.frombytes(a[new].tobytes())
                self.hi.frombytes(b[new].tobytes())
            self.first.append(len(self.lo))

    def _suffixes(self) -> None:
        goto: dict[int, int] = {}
        token = array("i", [-1])
        for t in self.entered:
            at = 0
            for byte in self.labels[t]:
                at = goto.setdefault(at << 8 | byte, len(token))
                if at == len(token):
                    token.append(-1)
            token[at] = t
        self.fail, self.ends = array("i", bytes(4 * len(token))), array("i", token)
        self.shorter = array("i", [-1]) * len(self.number)  # the next token that ends where this one ends
        self.keys, self.to = array("i", sorted(goto)), array("i", [to for _, to in sorted(goto.items())])
        below: dict[int, list[int]] = {}
        for key in goto:
            below.setdefault(key >> 8, []).append(key)
        queue = [0]
        for at in queue:
            for key in below.get(at, ()):
                to = goto[key]
                queue.append(to)
                back = self.fail[at]
                while at and (key & 255 | back << 8) not in goto and back:
                    back = self.fail[back]
                back = self.fail[to] = goto.get(key & 255 | back << 8, 0) if at else 0
                if token[to] < 0:
                    self.ends[to] = self.ends[back]
                else:
                    self.shorter[token[to]] = self.ends[back]

    def __getstate__(self):
        return self.__dict__ | {"_tables": None, "encoder": None}

    def step(self, state: int, byte: int) -> int:
        """The state of the longest suffix that begins a token, after one byte more."""
        while True:
            key = state << 8 | byte
            at = bisect_left(self.keys, key)
            if at < len(self.keys) and self.keys[at] == key:
                return self.to[at]
            if not state:
                return 0
            state = self.fail[state]

    def arc(self, s: int, t: int) -> bool:
        """Does the state that s enters have the arc t?"""
        k = self.number[t]
        at = bisect_right(self.lo, k, self.first[s], self.first[s + 1]) - 1
        return at < self.first[s] or self.hi[at] < k

    def encode_word(self, word: bytes) -> list[int]:
        state, reached = 0, [-1]
        for i, byte in enumerate(word, 1):
            state = self.step(state, byte)
            t = self.ends[state]
            while t >= 0 and (s := reached[i - len(self.labels[t])]) >= 0 and not self.arc(s, t):
                t = self.shorter[t]
            if t < 0:
                raise ValueError(f"no token string spells {word!r}")
            reached.append(t)
        path, i = [], len(word)
        while i:
            path.append(reached[i])
            i -= len(self.labels[reached[i]])
        return path[::-1]

    def tables(self) -> tuple[np.ndarray, ...]:
        """For numpy: sorted arcs of the suffix table and where they lead, its fail, ends and shorter, token sizes and
        numbers, and the lost arcs' first and last numbers, behind their states."""
        if self._tables is None:
            sizes = np.zeros(len(self.number), dtype=np.int64)
            for k, t in self.labels.items():
                sizes[k] = len(t)
            arrays = [np.frombuffer(x, dtype=np.int32) for x in (self.keys, self.to, self.fail, self.ends, self.shorter, self.number)]
            state = np.repeat(np.arange(len(self.number), dtype=np.int64), np.diff(np.frombuffer(self.first, dtype=np.int32))) << 32
            lo, hi = (np.concatenate(([-1], state | np.frombuffer(x, dtype=np.int32))) for x in (self.lo, self.hi))
            self._tables = (*arrays, sizes, lo, hi)
        return self._tables

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word: encode_word() for all of them side by side, one byte of each at a time."""
        if not words:
            return []
        keys, to, fail, ends, shorter, number, width, lo, hi = self.tables()
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32)
        ordered = sizes[order]
        reached = np.full((int(ordered[0]) + 1, len(words)), -1, dtype=np.int32)
        state = np.zeros(len(words), dtype=np.int32)
        for i in range(1, len(reached)):
            n = int(np.searchsorted(-ordered, -i, side="right"))  # words of i bytes or more
            byte, state = data[begin[:n] + i - 1], state[:n].copy()
            todo = np.arange(n)
            while todo.size:
                key = state[todo] << 8 | byte[todo]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[at] == key
                done = there | (state[todo] == 0)
                state[todo] = np.where(there, to[at], fail[state[todo]])
                todo = todo[~done]
            token = ends[state].astype(np.int64)
            todo = np.arange(n)
            while todo.size:
                t = token[todo]
                if t.min() < 0:
                    raise ValueError(f"no token string spells {words[order[todo[t.argmin()]]]!r}")
                s = reached[i - width[t], todo].astype(np.int64)
                key = s << 32 | number[t]
                lost = (s >= 0) & (hi[np.searchsorted(lo, key, side="right") - 1] >= key)
                todo = todo[lost]
                token[todo] = shorter[token[todo]]
            reached[i, :n] = token
        # the labels, from a word's end to its start
        row, at, found = np.arange(len(words)), ordered.copy(), []
        while row.size:
            t = reached[at, row]
            found.append((row, t))
            at = at - width[t]
            row, at = row[at > 0], at[at > 0]
        row = np.concatenate([r for r, _ in found])
        ids = np.concatenate([t for _, t in found])[np.lexsort((-np.arange(len(row)), row))].astype("<u4").tobytes()
        ends_at = np.cumsum(np.bincount(row, minlength=len(words))) * 4
        out: list[bytes] = [b""] * len(words)
        start = 0
        for k, stop in zip(order.tolist(), ends_at.tolist(), strict=True):
            out[k] = ids[start:stop]
            start = stop
        return out

    def decode(self, ids) -> str:
        names = {k: t for t, k in self.special.items()}
        return b"".join(names[k].encode() if k in names else self.labels[k] for k in ids).decode("utf-8", "replace")


def load(raw: bytes) -> Automaton:
    """The automaton of a byte-level BPE file in the tokenizers library's JSON format.

    Raises ValueError for options that change texts or words in ways that this module doesn't follow.
    """
    spec = json.loads(raw)
    model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
    odd = {
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space", True) or not splitter.get("use_regex", True),
        "decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "added_tokens": any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if any(odd.values()):
        raise ValueError("not supported in this file: " + ", ".join(k for k, v in odd.items() if v))
    letters = byte_letters()
    as_bytes = lambda t: bytes(letters[c] for c in t)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    vocabulary = {as_bytes(t): k for t, k in model["vocab"].items() if t not in special}
    return Automaton(vocabulary, [(as_bytes(a), as_bytes(b)) for a, b in pairs], special)


def read_file(spark, path: str) -> bytes:
    """A vocabulary file, a few MB, by Spark's readers or, if it is on the driver's disk only, from there."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


class Encoder:
    """Splits and encodes texts.  Pieces' ids are remembered, packed as little-endian 32-bit integers, in two generations:
    a full one becomes the old one, and what is used of the old one is taken over into the young one."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.words = regex.compile(automaton.pattern)
        names = sorted(automaton.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.names = {t: struct.pack("<I", k) for t, k in automaton.special.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _plain(self, text: str) -> list[str]:
        # A space between two characters that are no white space always begins a word, so a text is cut there.
        if self._loose(text):
            return self.words.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    @staticmethod
    def _loose(text: str) -> bool:
        """Does a space stand at an end of text or beside other white space?"""
        if text[:1] == " " or text[-1:] == " " or "  " in text or "\0" in text:
            return True
        return any(c in text and (" " + c in text or c + " " in text) for c in (_ASCII_SPACE if text.isascii() else _SPACE))

    def pieces(self, text: str) -> list[str]:
        """text, cut into special strings and pieces that hold one word or more."""
        if self.special is None or not any(s in text for s in self.names):
            return self._plain(text) if text else []
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Make young hold the ids of all pieces."""
        young, old = self.young, self.old
        pieces = pieces.difference(young)
        for p in pieces.intersection(old):
            young[p] = old[p]
            self.held += 200 + 2 * len(p) + len(young[p])
        new = pieces.difference(old)
        split = {p: [p] if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else self.words.findall(p) for p in new}
        words = list({w for ws in split.values() for w in ws}.difference(young, old))
        now = {}
        for start in range(0, len(words), 1 << 14):
            part = [w.encode() for w in words[start : start + (1 << 14)]]
            short = [w for w in part if len(w) <= LONG_WORD]
            ids = iter(self.automaton.encode_words(short))
            for w, raw in zip(words[start : start + (1 << 14)], part, strict=True):
                now[w] = next(ids) if len(raw) <= LONG_WORD else np.array(self.automaton.encode_word(raw), dtype="<u4").tobytes()
        for p, ws in split.items():
            if len(ws) != 1:
                now[p] = b"".join([now.get(w) or young.get(w) or old[w] for w in ws])
        young.update(now)
        self.held += sum(200 + 2 * len(p) + len(ids) for p, ids in now.items())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        cut = [self.pieces(t) for t in texts]
        self._learn(set().union(*cut).difference(self.names))
        self.young.update(self.names)
        out = [b"".join(map(self.young.__getitem__, c)) for c in cut]
        if self.held > MEMO_BYTES:
            self.old, self.young, self.held = self.young if self.held < 4 * MEMO_BYTES else {}, {}, 0
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _run(automaton, with_ids: bool):
    def run(batches):
        a = automaton.value  # a worker keeps it from task to task
        encoder = a.encoder = a.encoder or Encoder(a)
        labels = np.zeros(max(max(a.labels), max(a.special.values(), default=0)) + 1, dtype=object)
        for k, t in a.labels.items():
            labels[k] = t
        for t, k in a.special.items():
            labels[k] = t.encode()
        for batch in batches:
            _, at = W.utf8(batch.column("text"))
            for start, stop in W.chunks(at, SLICE_BYTES):
                part = batch.slice(start, stop - start)
                packed = encoder.encode_all([v.as_py() or "" for v in part.column("text")])
                ids = [np.frombuffer(x, dtype="<u4") for x in packed]
                decoded = [sha256(b"".join(labels[x].tolist()).decode("utf-8", "replace").encode()).hexdigest() for x in ids]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n)}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
                out["ids_sha256"] = pa.array([sha256(x).hexdigest() for x in packed], pa.string())
                out["decoded_sha256"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def encode_documents(docs: DataFrame, raw: bytes, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if with_ids), ids_sha256 and decoded_sha256 of each row of docs.

    raw is the vocabulary file.  A null text is an empty one; empty texts have no tokens.  Each row is encoded by itself,
    repeated ones and those of null doc_id too; columns of docs beside doc_id and text are left out, so no name can clash;
    an empty table gives an empty one.  A text of any length is encoded whole.  Strings of the file's added tokens inside
    a text become those tokens.  The digests are of the ids as little-endian unsigned 32-bit integers and
    of the decoded text in UTF-8.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(load(raw))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_run(automaton, with_ids), "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string")
