"""Hierarchical packing of documents into sequences of several lengths.

Documents are tokenised, ended by a separator, and routed by length to the tier of the smallest context that
holds them; what is longer than the longest context gives whole sequences first. Tiers are packed from the
longest down: a sequence begins with the longest item left, its gap takes the longest items of shorter tiers that
fit, and the last of the gap is cut from the item that just exceeds it. So each sequence is full, and a power of
two long. What a task has left at its end becomes sequences of ever smaller powers of two: nothing is padded.
Sequences of a tier form step groups of equal token counts.

Nothing is shuffled: each input partition packs its own rows, in blocks, and carries over what is left.

Defined results: a null or empty text is its separator only. Repeated rows are packed as often as they stand
there. An empty table gives no sequences.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, batches, ragged

TIERS = (512, 1024, 2048, 4096)
#: Tokens of one step group.
STEP_TOKENS = 64 * 4096
#: Bytes of text that are tokenised and packed together.
BATCH_BYTES = 4 << 20
#: Parts of words whose ids a worker remembers; beyond that it begins anew.
KNOWN_PARTS = 500_000
# Byte classes: 1 letter, 2 digit, 3 other sign, 0 what is left to the library: white space, controls, the
# apostrophe (contractions) and all characters but ASCII and the letters U+00C0 to U+00FF.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[0x27] = 0


def split_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts of parts, whether a word is easy) for words given as bytes.

    Easy words have ASCII signs and letters and the letters from U+00C0 to U+00FF only, which are composed and
    lower-cased one by one; their parts end where the class of the characters changes, and digits stand alone.
    """
    n = len(data)
    kind = _CLASS[data]
    lead = data == 0xC3
    tail = np.zeros(n, bool)
    tail[1:] = lead[:-1]
    letter = tail & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    kind[letter] = 1
    kind[np.append(letter[1:], False) & lead] = 1
    bad = kind == 0
    bad[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # may begin an added token
    total = np.zeros(n + 1, np.int64)
    np.cumsum(bad, out=total[1:])
    easy = total[off[1:]] == total[off[:-1]]
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    lower[letter & (data <= 0x9E)] += 32
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begin[off[:-1][off[:-1] < n]] = True
    return lower, begin, easy


class WordTokenizer:
    """A word-level tokenizers file that drops white space: equal parts of words are encoded once a worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.known_off, self.known_ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct parts."""
        place = pc.index_in(parts, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        sizes, runs = [], []
        for at in range(0, len(new), 20_000):
            texts = [x.decode("utf-8", "replace") for x in parts.take(pa.array(new[at : at + 20_000])).to_pylist()]
            lists = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            runs.append(np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes[-1].sum())))
        place[new] = len(self.known) + np.arange(len(new))
        all_ids = np.concatenate([self.known_ids, *runs])
        all_off = np.append(self.known_off, self.known_off[-1] + np.cumsum(np.concatenate(sizes))) if sizes else self.known_off
        if len(new):
            self.known = pa.concat_arrays([self.known, parts.take(pa.array(new))])
            self.known_ids, self.known_off = all_ids, all_off
        size = np.diff(all_off)[place]
        ids = all_ids[ragged(all_off[:-1][place], size)]
        if len(self.known) > KNOWN_PARTS:
            self._forget()
        return ids, np.append(0, np.cumsum(size))

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct words."""
        data, off = as_bytes(words)
        lower, begin, easy = split_words(data, off)
        hard = np.flatnonzero(~easy)
        # Hard words go to the library whole.
        begin[ragged(off[:-1][hard], np.diff(off)[hard])] = False
        begin[off[:-1][hard]] = True
        whole = np.repeat(~easy, np.diff(off))
        lower[whole] = data[whole]
        starts = np.flatnonzero(begin)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(lower)]).dictionary_encode()
        ids, edges = self._encode_parts(parts.dictionary)
        codes = parts.indices.to_numpy(zero_copy_only=False)
        size = np.diff(edges)[codes]
        return ids[ragged(edges[:-1][codes], size)], np.append(0, np.cumsum(size))[np.searchsorted(starts, off)]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block of texts."""
        w = Words(*as_bytes(texts))
        ids, edge = self._encode_words(w.dictionary)
        size = np.diff(edge)[w.codes]
        return ids[ragged(edge[:-1][w.codes], size)], np.append(0, np.cumsum(size))[w.offsets]


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """Read once in each worker."""
    return WordTokenizer(path)


class Packer:
    """Packs items (key, length) into full sequences; keys only tell pieces apart.

    A piece is (key, start, length); `add` and `finish` return sequences as lists of pieces.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.items: list[tuple[int, int, int]] = []  # (length, key, start), by length
        self.held = 0

    def add(self, items: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
        longest = self.tiers[-1]
        out = []
        new = []
        for key, length in items:
            start = 0
            while length - start >= longest:
                out.append([(key, start, longest)])
                start += longest
            if length > start:
                new.append((length - start, key, start))
        self.items = sorted(self.items + new)
        self.held = sum(x[0] for x in self.items)
        for tier, shorter in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0], strict=True):
            while self.items and self.items[-1][0] > shorter and self.held >= tier:
                out.append(self._sequence(tier))
        return out

    def finish(self) -> list[list[tuple[int, int, int]]]:
        """What is left, in sequences of falling powers of two."""
        out = []
        while self.held:
            out.append(self._sequence(min(self.tiers[-1], 1 << (self.held.bit_length() - 1))))
        return out

    def _sequence(self, size: int) -> list[tuple[int, int, int]]:
        """One full sequence; at least `size` tokens are held."""
        pieces, gap = [], size
        while gap:
            fits = bisect.bisect_right(self.items, (gap, 1 << 62, 0)) - 1
            if fits >= 0 and (not pieces or self.items[fits][0] * 2 >= gap or fits == len(self.items) - 1):
                length, key, start = self.items.pop(fits)
                pieces.append((key, start, length))
                gap -= length
                continue
            # Cut the shortest item that exceeds the gap; its rest stays for shorter tiers.
            length, key, start = self.items.pop(fits + 1)
            pieces.append((key, start, gap))
            bisect.insort(self.items, (length - gap, key, start + gap))
            gap = 0
        self.held -= size
        return pieces


def packed(docs: DataFrame, path: str, end: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of all docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length, step_group, and with_ids the piece's ids as little-endian unsigned 32-bit integers.

    sequence_id: the input partition's number times 2**32 plus the number in it. step_group: sequences of one
    length, of step_tokens tokens in all (the last of a task may have fewer); the id names partition, length, number.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers are rising powers of two")
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]) + (", ids binary" if with_ids else "")

    def pack(it):
        tokenizer = word_tokenizer(path)
        part = TaskContext.get().partitionId()
        packer = Packer(tiers)
        held: dict[int, tuple[object, np.ndarray]] = {}  # documents of which something is still to be packed
        number, key = 0, 0
        done: dict[int, int] = {}  # sequences so far, by length
        rows: list[tuple] = []
        id_type = None

        def emit(sequences):
            nonlocal number
            for pieces in sequences:
                size = sum(p[2] for p in pieces)
                n = done[size] = done.get(size, -1) + 1
                group = (part << 32) | size.bit_length() << 24 | n // max(1, step_tokens // size)
                offset = 0
                for k, start, length in pieces:
                    doc_id, ids = held[k]
                    data = ids[start : start + length].tobytes()
                    rows.append((doc_id, start, length, zlib.crc32(data), len(ids), (part << 32) | number, offset, size, group, data))
                    offset += length
                number += 1

        def table():
            columns = list(zip(*rows, strict=True)) if rows else []
            rows.clear()
            if not columns:
                return []
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:9])]
            if with_ids:
                arrays.append(pa.array(columns[9], pa.binary()))
            return pa.Table.from_arrays(arrays, names=[*names, *["ids"] * with_ids]).to_batches()

        for block in batches(it, limit=BATCH_BYTES):
            id_type = block.schema.field("doc_id").type
            ids, off = tokenizer.encode(block["text"])
            whole = np.insert(ids.astype("<u4"), off[1:], end)
            off = off + np.arange(len(off))
            items = []
            for doc_id, a, b in zip(block["doc_id"].to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                held[key] = doc_id, whole[a:b]
                items.append((key, b - a))
                key += 1
            emit(packer.add(items))
            yield from table()
            held = {k: (held[k][0], held[k][1].copy()) for _, k, _ in packer.items}
        emit(packer.finish())
        yield from table()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pack, schema)
