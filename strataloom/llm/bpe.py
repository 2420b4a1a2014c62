"""Byte-pair encoding by a pair-occurrence index, and decoding.

The texts of a block are cut at spaces into chunks that tokenise independently; equal chunks, and then equal
pre-tokens, are encoded once. All pre-tokens of the block lie in one array of symbols. The index maps each
mergeable pair's rank to every position where the pair stands. Ranks are applied in ascending order: all
occurrences of a pair merge in one array operation, and the pairs that this makes join the lists of their ranks.
A merge only makes pairs of higher rank (checked when the vocabulary is read), so one ascending pass gives what
merging the lowest pair of each pre-token, again and again, gives.

Defined results: as the tokenizers library encodes without special tokens being added; added tokens that stand
in a text are found as the library finds them. A null text is empty; an empty text has no tokens.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import as_bytes, mixed, ragged

#: How byte-level vocabularies of this kind cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts in which a space between white space, or before white space at the end, makes chunks depend on each other.
_BLANKS = "[ \\t\\n\\x0b\\x0c\\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
DEPENDENT = f"{_BLANKS} ({_BLANKS}|$)"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE read from a tokenizers file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        self.size = max(max(ids.values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for text, i in ids.items():
            self.bytes[i] = bytes(of_letter[c] for c in text)
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        rank_of = {int(m): r for r, m in reversed(list(enumerate(self.made)))}
        if any(rank_of.get(int(x), -1) >= r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)) for x in (a, b)):
            raise ValueError("a merge uses a token that only a later merge makes; ascending ranks would not do")
        keys = self.left * self.size + self.right
        order = np.argsort(keys)
        # An open-addressing table from pair to rank, so that lookups are a few gathers.
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, len(keys), np.int32)
        place = self._slot(keys)
        self.probes = 1
        for i in order.tolist():
            p, n = int(place[i]), 1
            while self.slots[p] >= 0:
                p, n = (p + 1) % len(self.slots), n + 1
            self.slots[p], self.ranks[p], self.probes = keys[i], i, max(self.probes, n)
        self.none = len(keys)
        self.pattern = regex.compile(PATTERN)
        self.added = [(t["content"], t["id"]) for t in spec["added_tokens"]]
        for content, i in self.added:
            self.bytes[i] = content.encode()
        self.added_pattern = regex.compile("|".join(regex.escape(c) for c, _ in sorted(self.added, key=lambda x: -len(x[0])))) if self.added else None
        self.added_ids = dict(self.added)
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; `none` if it is no merge."""
        keys = left.astype(np.int64) * self.size + right
        place = self._slot(keys)
        out = np.full(len(keys), self.none, np.int32)
        hit = self.slots[place] == keys
        out[hit] = self.ranks[place[hit]]
        open_ = np.flatnonzero(~hit & (self.slots[place] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            p = (place[open_] + step) % len(self.slots)
            there = self.slots[p]
            found = there == keys[open_]
            out[open_[found]] = self.ranks[p[found]]
            open_ = open_[~found & (there >= 0)]
        return out

    def merge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pre-tokens given as bytes: every rank is applied once, to all its occurrences."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        sym = self.byte_ids[data]
        # Links to the neighbours within the pre-token; n: none. One more entry takes writes to no neighbour.
        nxt = np.arange(1, n + 2)
        prv = np.arange(-1, n)
        ends = off[1:][off[1:] > off[:-1]]
        nxt[ends - 1] = n
        prv[off[:-1][off[1:] > off[:-1]]] = n
        sym = np.append(sym, np.int32(0))
        alive = np.ones(n + 1, bool)
        alive[n] = False

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that start at these positions into the lists of their ranks."""
            ranks = self.rank(sym[at], sym[nxt[at]])
            able = ranks < self.none
            at, ranks = at[able], ranks[able]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        pairs = np.flatnonzero(nxt[:n] < n)
        enter(pairs)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            a, b, c = self.left[r], self.right[r], self.made[r]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            to = nxt[at]
            ok = alive[at] & (sym[at] == a) & (to < n)
            ok[ok] &= sym[to[ok]] == b
            if not ok.all():
                at, to = at[ok], to[ok]
            if a == b and len(at) > 1:
                # Of a run of equal symbols every other pair merges, from the left.
                follows = np.append(False, to[:-1] == at[1:])
                where = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(follows, 0, where))
                odd = (where - begin) % 2 == 0
                at, to = at[odd], to[odd]
            if not len(at):
                continue
            after = nxt[to]
            sym[at] = c
            alive[to] = False
            nxt[at] = after
            prv[after] = at
            nxt[n], prv[n] = n, n
            before = prv[at]
            new = np.concatenate([before[before < n], at[after < n]])
            if len(new):
                enter(new)
        left = np.flatnonzero(alive[:n])
        return sym[left], np.searchsorted(left, off)

    def _pieces(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The pre-tokens of the texts, and how many each text has."""
        flat: list[str] = []
        counts = []
        find = self.pattern.findall
        for text in texts:
            found = find(text)
            counts.append(len(found))
            flat += found
        return flat, counts

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts without added tokens."""
        flat, counts = self._pieces(texts)
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        ids, off = self.merge(*as_bytes(coded.dictionary))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(off)[codes]
        tokens = ids[ragged(off[:-1][codes], sizes)]
        total = np.append(0, np.cumsum(sizes))
        return tokens, total[np.append(0, np.cumsum(np.array(counts, np.int64)))]

    def _encode_any(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of any texts."""
        if self.added_pattern is None or not any(self.added_pattern.search(t) for t in texts):
            return self._encode_plain(texts)
        parts: list[str] = []
        plan: list[list[int]] = []  # for each text: the numbers of parts, or -1 - id
        for text in texts:
            row, at = [], 0
            for m in self.added_pattern.finditer(text):
                row += [len(parts), -1 - self.added_ids[m[0]]]
                parts.append(text[at : m.start()])
                at = m.end()
            row.append(len(parts))
            parts.append(text[at:])
            plan.append(row)
        ids, off = self._encode_plain(parts)
        rows = [np.concatenate([ids[off[p] : off[p + 1]] if p >= 0 else np.array([-1 - p], np.int32) for p in row]) for row in plan]
        return np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block of texts."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        hard = pc.match_substring_regex(texts, DEPENDENT)
        for content, _ in self.added:
            if " " in content:
                hard = pc.or_(hard, pc.match_substring(texts, content))
        hard = hard.to_numpy(zero_copy_only=False)
        if hard.any():
            easy_at, hard_at = np.flatnonzero(~hard), np.flatnonzero(hard)
            a, a_off = self.encode(texts.take(pa.array(easy_at)))
            b, b_off = self._encode_any(texts.take(pa.array(hard_at)).to_pylist())
            ids = np.concatenate([a, b])
            begin = np.empty(len(texts), np.int64)
            size = np.empty(len(texts), np.int64)
            begin[easy_at], size[easy_at] = a_off[:-1], np.diff(a_off)
            begin[hard_at], size[hard_at] = b_off[:-1] + len(a), np.diff(b_off)
            return ids[ragged(begin, size)], np.append(0, np.cumsum(size))
        cut = pc.split_pattern(texts, " ")
        edges = np.asarray(cut.offsets)
        coded = cut.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        edges = edges - edges[0]
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        chunks = coded.dictionary.to_pylist()
        # The first chunk of a text stands without a space before it, any other with one.
        first = np.zeros(len(codes), bool)
        first[edges[:-1]] = True
        heads, head_codes = np.unique(codes[first], return_inverse=True)
        ids, off = self._encode_any([" " + c for c in chunks] + [chunks[i] for i in heads])
        codes[first] = len(chunks) + head_codes
        size = np.diff(off)[codes]
        return ids[ragged(off[:-1][codes], size)], np.append(0, np.cumsum(size))[edges]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are not UTF-8 become U+FFFD."""
        size = self.lengths[ids]
        data = self.data[ragged(self.begins[ids], size)].tobytes()
        edge = np.append(0, np.cumsum(size))[off].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:], strict=True)]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each worker."""
    return Vocabulary(path)
