"""Secret scans by combined deterministic automata.

The rules' regexes are compiled by subset construction and minimisation into two tables of transitions, each for all
rules at once:

* One finds where matches can start. It holds the rules' heads (a beginning of every match that counts, short enough
  that their union stays small), turned round, and reads a block once, from its last byte to its first. The block is
  cut into lanes of equal length that advance together, a byte at a step, as array operations. A lane starts in the
  start state; where the lane before it ends in another state, the lane runs again from there until it meets the
  states it had, so the result is that of one sequential pass. Stretches that met an accepting state are read again
  for the masks of the rules that start at each byte.
* One holds the whole patterns, anchored. It runs forwards from a start and tells where the longest match of a rule
  ends and where the part begins whose length counts. A stretch that an earlier try of the text looped through in the
  same state is not read again, so many starts before one long run stay linear.

The union of the whole patterns, unanchored, has no small table: a count such as {35} over characters that can
start the rule anew has a state for each set of places. Rules and their texts are bytes; spans are code points, end
exclusive.

Defined results: a null text is empty. Matches of a kind are leftmost, the longest there, and do not overlap; those
whose counted part is too short are dropped after matching. A text of any length is read whole, and no match leaves
it. Repeated rows are scanned alike, columns other than doc_id and text are ignored (redacted() keeps them), whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches

#: Bytes from which on the stretch that a try looped through is remembered.
LONG_LOOP = 64


def either(word: str) -> str:
    """The word's letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in word)


@dataclass(frozen=True)
class Rule:
    """A match is `before` and then `body`, which has at least `least` bytes; `head` begins every match that counts."""

    kind: str
    head: str
    before: str
    body: str
    least: int = 0


_KEY = "(" + "|".join([*(either(w) for w in ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")]) + ")"
_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = _KEY + "[\"']?\\x20*[:=]\\x20*[\"']?"
_PEM = "-----BEGIN\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----"

#: Kinds in the order in which spans that start together are listed.
BASE = (
    Rule("assign", _ASSIGN + _VALUE, _ASSIGN, _VALUE + "+", 12),
    Rule("access", "AKIA[A-Z0-9]", "", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16}", "", "[0-9a-f]+", 16),
)
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "", "gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]", "", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]", "", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]", "", "[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]", "", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+"),
    Rule("pem", _PEM, "", _PEM),
)
RULES = BASE + MORE


class _Nfa:
    """States with edges on sets of bytes; built from classes, groups, alternatives and repeats."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.edge: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.edge.append(None)
        return len(self.empty) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern, 0
        out = self._alternatives()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")
        return out

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _alternatives(self) -> tuple[int, int]:
        branches = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            branches.append(self._sequence())
        if len(branches) == 1:
            return branches[0]
        a, b = self.state(), self.state()
        for x, y in branches:
            self.empty[a].append(x)
            self.empty[y].append(b)
        return a, b

    def _sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self._peek() not in ("", "|", ")"):
            x, y = self._repeated()
            self.empty[b].append(x)
            b = y
        return a, b

    def _repeated(self) -> tuple[int, int]:
        began = self.at
        part = self._atom()
        ended, sign = self.at, self._peek()
        if sign not in ("?", "*", "+", "{"):
            return part
        if sign == "{":
            close = self.text.index("}", self.at)
            low, comma, high = self.text[self.at + 1 : close].partition(",")
            after, least, most = close + 1, int(low), (int(high) if high else None) if comma else int(low)
        else:
            after, least, most = self.at + 1, int(sign == "+"), 1 if sign == "?" else None

        def copy() -> tuple[int, int]:
            self.at = began
            out = self._atom()
            self.at = ended
            return out

        a = b = self.state()
        copies = [part] if least or most is None or most else []
        for i in range(least):
            x, y = copies[0] if i == 0 else copy()
            self.empty[b].append(x)
            b = y
        if most is None:
            x, y = part if least == 0 else copy()
            end = self.state()
            self.empty[b] += [x, end]
            self.empty[y] += [x, end]
            b = end
        else:
            end = self.state()
            for i in range(least, most):
                x, y = part if i == 0 else copy()
                self.empty[b] += [x, end]
                b = y
            self.empty[b].append(end)
            b = end
        self.at = after
        return a, b

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        if c == "(":
            self.at += 1
            out = self._alternatives()
            if self._peek() != ")":
                raise ValueError(f"no ) in {self.text!r}")
            self.at += 1
            return out
        if c == "[":
            members = self._class()
        elif c == ".":
            self.at += 1
            members = frozenset(range(256)) - {10}
        else:
            members = frozenset([self._byte()])
        a, b = self.state(), self.state()
        self.edge[a] = (members, b)
        return a, b

    def _byte(self) -> int:
        c = self._peek()
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self._peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def _class(self) -> frozenset[int]:
        self.at += 1
        no = self._peek() == "^"
        self.at += no
        members: set[int] = set()
        while self._peek() != "]":
            low = self._byte()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                members |= set(range(low, self._byte() + 1))
            else:
                members.add(low)
        self.at += 1
        return frozenset(range(256)) - members if no else frozenset(members)


@dataclass
class Automaton:
    """table[state, byte class]: the next state; states from `first` on accept, and masks[state] tells what."""

    table: np.ndarray
    classes: np.ndarray
    first: int
    masks: np.ndarray
    start: int

    def starts(self, data: np.ndarray, lane: int = 1024, every: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(place, mask) of the bytes at which the automaton, reading from the end, accepts; places ascend."""
        n, width = len(data), self.table.shape[1]
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        table = (self.table * width).astype(np.int32).ravel()
        lanes = -(-n // lane)
        padded = np.zeros(lanes * lane, np.uint8)
        padded[:n] = self.classes[data[::-1]]
        steps = np.ascontiguousarray(padded.reshape(lanes, lane).T)
        limit, origin = self.first * width, np.int32(self.start * width)
        state, top = np.full(lanes, origin, np.int32), np.zeros(lanes, np.int32)
        marks = np.empty((lane // every, lanes), np.int32)
        busy = np.zeros((lane // every, lanes), bool)
        for i in range(lane):
            state = table.take(state + steps[i])
            np.maximum(top, state, out=top)
            if (i + 1) % every == 0:
                marks[i // every], busy[i // every] = state, top >= limit
                top[:] = 0
        # Lanes whose predecessor did not end in the state that they began in.
        begun = np.full(lanes, origin, np.int32)
        while True:
            due = np.append(origin, marks[-1][:-1])
            ids = np.flatnonzero(due != begun)
            if not len(ids):
                break
            begun[ids] = due[ids]
            state, top = due[ids], np.zeros(len(ids), np.int32)
            for i in range(lane):
                state = table.take(state + steps[i, ids])
                top = np.maximum(top, state)
                if (i + 1) % every == 0:
                    busy[i // every, ids] |= top >= limit
                    other = marks[i // every, ids] != state
                    marks[i // every, ids] = state
                    ids, state, top = ids[other], state[other], top[other] * 0
                    if not len(ids):
                        break
        part, of = np.nonzero(busy)
        state = np.where(part > 0, marks[part - 1, of], begun[of])
        found = np.empty((every, len(of)), np.int64)
        for i in range(every):
            state = table.take(state + steps[part * every + i, of])
            found[i] = self.masks[state // width]
        step, which = np.nonzero(found)
        place = n - 1 - (of[which].astype(np.int64) * lane + part[which] * every + step)
        masks = found[step, which]
        order = np.argsort(place)
        place, masks = place[order], masks[order]
        return place[place >= 0], masks[place >= 0]


def automaton(patterns: list[tuple[str, int]], backward: bool = False) -> Automaton:
    """The minimal automaton of the patterns (pattern, mask): anchored, or reading backwards from anywhere."""
    nfa = _Nfa()
    ends = [(*nfa.add(p), mask) for p, mask in patterns]
    n = len(nfa.empty)
    edges: list[list[tuple[frozenset[int], int]]] = [[] for _ in range(n)]
    empty: list[list[int]] = [[] for _ in range(n)]
    for x in range(n):
        if nfa.edge[x]:
            members, y = nfa.edge[x]
            edges[y if backward else x].append((members, x if backward else y))
        for y in nfa.empty[x]:
            empty[y if backward else x].append(x if backward else y)
    accept: dict[int, int] = {}
    for a, b, mask in ends:
        accept[a if backward else b] = mask
    roots = {b if backward else a for a, b, _ in ends}

    order = list({members for e in edges for members, _ in e})
    signature: dict[tuple[bool, ...], int] = {(False,) * len(order): 0}  # class 0: bytes of no rule
    classes = np.zeros(256, np.uint8)
    samples = [-1]
    for byte in range(256):
        key = tuple(byte in members for members in order)
        if key not in signature:
            signature[key] = len(signature)
            samples.append(byte)
        classes[byte] = signature[key]
    width = len(signature)

    def closed(states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for x in empty[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(x for x in out if edges[x] or x in accept)

    start = closed(roots)
    always = start if backward else frozenset()
    moves: dict[tuple[int, int], frozenset[int]] = {}
    for c, byte in enumerate(samples):
        for x in range(n):
            there = {y for members, y in edges[x] if byte in members}
            if there:
                moves[x, c] = closed(there)
    numbers, rows, todo = {start: 0}, [], [start]
    while len(rows) < len(todo):
        here, row = todo[len(rows)], []
        for c in range(width):
            there = always.union(*(moves[x, c] for x in here if (x, c) in moves))
            if there not in numbers:
                numbers[there] = len(numbers)
                todo.append(there)
            row.append(numbers[there])
        rows.append(row)
    table = np.array(rows, np.int64)
    masks = np.array([sum({accept[x] for x in states if x in accept}) for states in todo], np.int64)

    # Minimisation: states part until all of a class go to equal classes on each byte.
    _, label = np.unique(masks, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([label, label[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    one = np.zeros(label.max() + 1, np.int64)
    one[label[::-1]] = np.arange(len(label))[::-1]
    rank = np.argsort(masks[one] != 0, kind="stable")  # accepting states last
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    masks = masks[one[rank]]
    return Automaton(place[label[table[one[rank]]]], classes, int((masks == 0).sum()), masks, int(place[label[0]]))


class Scanner:
    """The rules' two automata."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.heads = automaton([(r.head, 1 << k) for k, r in enumerate(rules)], backward=True)
        n = len(rules)
        self.whole = automaton([(r.before + r.body, 1 << k) for k, r in enumerate(rules)] + [(r.before, 1 << n + k) for k, r in enumerate(rules) if r.before])
        self.rows, self.masks = self.whole.table.tolist(), self.whole.masks.tolist()
        stays = (self.whole.table == np.arange(len(self.rows))[:, None]).all(axis=1)
        self.dead = next((int(s) for s in np.flatnonzero(stays & (self.whole.masks == 0))), -1)
        self.letters = self.whole.classes.tobytes()

    def match(self, text: bytes, at: int, stop: int, k: int, seen: dict[int, tuple[int, int, int, int]]) -> tuple[int, int]:
        """(start of the counted part, end) of the longest match of rule k from `at`, an end of -1 if there is none.

        text: byte classes. seen: stretches that earlier tries of this rule looped through before the same stop.
        """
        rows, masks, full, middle = self.rows, self.masks, 1 << k, 1 << len(self.rules) + k
        state, since, begun, last, loops = self.whole.start, at, at, -1, []
        i = at
        while i < stop:
            after = rows[state][text[i]]
            i += 1
            if after != state:
                if i - 1 - since >= LONG_LOOP:
                    loops.append((state, since, i - 1))
                if after == self.dead:
                    break
                known = seen.get(after)
                if known and known[0] <= i <= known[1]:
                    last = known[2] if known[2] >= i else i if masks[after] & full else last
                    begun = known[3] if known[3] >= i else i if masks[after] & middle else begun
                    break
                state, since = after, i
            found = masks[state]
            if found:
                if found & full:
                    last = i
                if found & middle:
                    begun = i
        else:
            if i - since >= LONG_LOOP:
                loops.append((state, since, i))
        for state, x, y in loops:
            seen[state] = (x, y, last, begun)
        return begun, last


def scan_block(texts: pa.Array, scanner: Scanner) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule's number, end) in code points, in order; None where there is none."""
    data, off = as_bytes(texts)
    found: list = [None] * len(texts)
    places, masks = scanner.heads.starts(data)
    coded = data.tobytes().translate(scanner.letters) if len(places) else b""
    ends = off.tolist()
    for k, rule in enumerate(scanner.rules):
        starts = places[(masks >> k & 1).astype(bool)]
        docs = (np.searchsorted(off, starts, side="right") - 1).tolist()
        starts = starts.tolist()
        i, doc = 0, -1
        while i < len(starts):
            if docs[i] != doc:
                doc, seen = docs[i], {}
            at = starts[i]
            begun, end = scanner.match(coded, at, ends[doc + 1], k, seen)
            i += 1
            if end > at:
                if end - begun >= rule.least:
                    if found[doc] is None:
                        found[doc] = []
                    found[doc].append((at - ends[doc], k, end - ends[doc]))
                i = bisect_left(starts, end, i)
    for doc, spans in enumerate(found):
        if spans:
            text = data[off[doc] : off[doc + 1]]
            points = np.zeros(len(text) + 1, np.int64)
            np.cumsum((text & 0xC0) != 0x80, out=points[1:])
            found[doc] = sorted((int(points[a]), k, int(points[b])) for a, k, b in spans)
    return found


def listed(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE)) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256, spans for every row of docs (doc_id, text)."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules[:n_base]]
    names = ["doc_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"]
    none = hashlib.sha256(b"").hexdigest()

    def scan(it):
        for block in batches(it):
            found = scan_block(block["text"].combine_chunks(), scanner)
            counts = np.zeros((n_base, len(found)), np.int64)
            digests, texts = [none] * len(found), [""] * len(found)
            for i, spans in enumerate(found):
                if spans:
                    base = [x for x in spans if x[1] < n_base]
                    for _, k, _ in base:
                        counts[k, i] += 1
                    if base:
                        digests[i] = hashlib.sha256(listed(base, rules).encode()).hexdigest()
                    texts[i] = listed(spans, rules)
            arrays = [block["doc_id"].combine_chunks(), *(pa.array(c) for c in counts), pa.array(digests), pa.array(texts)]
            yield from pa.Table.from_arrays(arrays, names=names).to_batches()

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(scan, schema)


def redacted(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each stretch that spans cover replaced by `mark`; other texts, nulls too, stay as they are."""
    scanner = Scanner(rules)
    at = docs.columns.index("text")

    def hide(it):
        for block in batches(it):
            column = block["text"].combine_chunks()
            texts = None
            for i, spans in enumerate(scan_block(pc.fill_null(column, ""), scanner)):
                if spans:
                    texts = column.to_pylist() if texts is None else texts
                    texts[i] = hidden(texts[i], spans, mark)
            if texts is not None:
                block = block.set_column(at, "text", pa.array(texts, column.type))
            yield from block.to_batches()

    return docs.mapInArrow(hide, docs.schema)


def hidden(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, end = [], 0
    for a, _, b in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])
