"""Substring deduplication: words in windows that also start earlier are removed.

A window is `width` consecutive words of one document. Its minimiser is the smallest hash among its m-word
groups; consecutive windows that share a minimiser travel as one packed string of words (a super-k-mer) to the
minimiser's bucket, so equal windows meet there. A bucket sorts its windows by hash, compares the words of
neighbours in that order, and names every window but the one that starts first.

Before anything travels, each block of texts is sorted in the same way: a window that starts earlier in the
same block is settled there, and only first windows travel. So a passage that a third of all documents share
reaches its bucket once a block. All super-k-mers of a block and bucket are one compressed row.

A minimiser that very many different texts hold around different words would overfill its bucket. A first pass
estimates how many each minimiser has; the windows of such are dealt by their own hash instead, which equal
windows share as well.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, compared as they are. Earlier means a smaller doc_id, or the
same document and an earlier start. Every row is a document of its own: rows that share an id, or have none, are
told apart by a 61-bit hash of their texts, which also orders them; null ids come last. Of rows equal in id and text one
comes first and the others repeat it. A null text has no words. Texts of fewer words than a window are kept whole, and
a text of any length is worked on whole. Columns other than doc_id and text are ignored, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, batches, hashed, input_bytes, mixed, near, ragged, stored, trim, windows

WIDTH = 20
GROUP = 4
#: Bytes of packed text that a bucket holds on average; a bucket is worked on in one task.
BUCKET_BYTES = 12 << 20
#: Super-k-mers of one minimiser from which on its windows are dealt one by one, about half a bucket; and how many
#: such minimisers the driver holds at most (8 bytes each). With more of them the first number doubles.
HOT_RUNS = 30_000
MOST_HOT = 500_000
#: A minimiser that a block holds once is counted for this share of its windows' hashes, that many times.
ONCE_SHARE = 16
#: Bytes of text of a block.
BLOCK = 8 << 20
NO_ID = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values; shorter than x by width - 1."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def later_windows(h: np.ndarray, codes: np.ndarray, at: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Of the windows at `at` (into codes), which have an equal one with a smaller (doc, tie, start); a mask.

    h: the windows' hashes. Equal hashes only bring windows together; their words are compared.
    """
    later = np.zeros(len(at), bool)
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    same = sorted_h[1:] == sorted_h[:-1]
    if not same.any():
        return later
    shared = np.zeros(len(at), bool)
    shared[1:] |= same
    shared[:-1] |= same
    idx = order[shared]
    group = np.cumsum(np.append(True, h[idx][1:] != h[idx][:-1])) - 1
    equal = np.ones(len(idx) - 1, bool)
    for j in range(width):
        equal &= codes[at[idx[1:]] + j] == codes[at[idx[:-1]] + j]
    if not equal[group[1:] == group[:-1]].all():
        # Different windows of one hash: order them by their words.
        words = np.lexsort([*(codes[at[idx] + j] for j in range(width)), group])
        idx = idx[words]
        equal = np.ones(len(idx) - 1, bool)
        for j in range(width):
            equal &= codes[at[idx[1:]] + j] == codes[at[idx[:-1]] + j]
        group = np.cumsum(np.append(True, ~equal)) - 1
    by = np.lexsort([start[idx], tie[idx], doc[idx], group])
    first = np.append(True, group[by][1:] != group[by][:-1])
    lead = idx[by[first][group]]  # the first window of each one's group
    later[idx] = (doc[idx] != doc[lead]) | (tie[idx] != tie[lead]) | (start[idx] != start[lead])
    return later


def runs(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Windows as (doc, tie, first word, end) stretches in order, overlapping or touching ones joined."""
    if not len(doc):
        return doc, tie, start, start
    order = np.lexsort([start, tie, doc])
    doc, tie, start = doc[order], tie[order], start[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + width))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], tie[new], start[new], start[last] + width


def _pack(doc, tie, start, n_words, text) -> bytes:
    import zstandard

    head = np.array([len(doc)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + doc.tobytes() + tie.tobytes() + start.tobytes() + n_words.tobytes() + text)


def _unpack(blob: bytes):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    doc, tie, start, n_words = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * k) for k in range(4))
    return doc, tie, start, n_words, np.frombuffer(raw, np.uint8, offset=8 + 32 * n)


class _Windows:
    """The windows of a block of texts: their places, hashes and minimisers."""

    def __init__(self, block: pa.Table, width: int, group: int):
        self.words = w = Words(*as_bytes(block["text"]))
        n = len(w.codes)
        self.row = w.documents()
        self.at = np.flatnonzero(np.arange(n) + width <= w.offsets[1:][self.row]) if n >= width else np.zeros(0, np.int64)
        if len(self.at):
            names = hashed(w.dictionary)[w.codes]
            self.hash = windows(names, width)[self.at]
            self.low = sliding_min(windows(names, group), width - group + 1)[self.at]

    def first_of_runs(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where consecutive windows of one text and key begin."""
        return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (self.row[at[1:]] != self.row[at[:-1]])))


def super_kmers(block: pa.Table, buckets: int, width: int = WIDTH, group: int = GROUP, hot: np.ndarray | None = None):
    """(settled stretches, rows (bucket, blob)) of a block (doc, tie, text)."""
    none = np.zeros(0, np.int64)
    found = _Windows(block, width, group)
    w, at = found.words, found.at
    if not len(at):
        return (none, none, none, none), []
    doc, tie = (block[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)[found.row[at]] for c in ("doc", "tie"))
    start = at - w.offsets[:-1][found.row[at]]
    later = later_windows(found.hash, w.codes, at, doc, tie, start, width)
    settled = runs(doc[later], tie[later], start[later], width)

    key = found.low if hot is None or not len(hot) else np.where(np.isin(found.low, hot), found.hash, found.low)
    at, doc, tie, start, key = at[~later], doc[~later], tie[~later], start[~later], key[~later]
    first = found.first_of_runs(key, at)
    n_words = np.diff(np.append(first, len(at))) + width - 1
    bucket = (mixed(key[first]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first, n_words, bucket = first[order], n_words[order], bucket[order]
    spaced = pa.Array.from_buffers(pa.large_binary(), len(w.dictionary), _spaced(w.dictionary))
    text, edges = as_bytes(spaced.take(pa.array(w.codes[ragged(at[first], n_words)])))
    edge = edges[np.append(0, np.cumsum(n_words))]
    cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    doc, tie, start, n_words = doc[first], tie[first], start[first], n_words.astype(np.int64)
    rows = [(int(bucket[a]), _pack(doc[a:b], tie[a:b], start[a:b], n_words[a:b], text[edge[a] : edge[b]].tobytes())) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return settled, rows


def hot_minimisers(docs: DataFrame, width: int = WIDTH, group: int = GROUP, least: int = HOT_RUNS, most: int = MOST_HOT) -> np.ndarray:
    """The minimisers of at least `least` different super-k-mers, over all rows of docs (text).

    A block hands on the minimisers that it holds more than once, each with its number of different super-k-mers,
    and of those that it holds once the ones whose first window's hash falls into one of ONCE_SHARE parts, with
    ONCE_SHARE for a number: the sums are right on average, at whatever size. They only decide how windows are
    dealt, never what is found.
    """

    def count(it):
        for block in batches(it, limit=BLOCK):
            found = _Windows(block, width, group)
            if not len(found.at):
                continue
            first = found.first_of_runs(found.low, found.at)
            low, head = found.low[first], found.hash[first]
            order = np.lexsort([head, low])
            low, head = low[order], head[order]
            new = np.append(True, (low[1:] != low[:-1]) | (head[1:] != head[:-1]))
            low, head = low[new], head[new]
            keys, at, n = np.unique(low, return_index=True, return_counts=True)
            n = np.where((n == 1) & (head[at] % np.uint64(ONCE_SHARE) == 0), ONCE_SHARE, n)
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["low", "n"])

    counts = docs.select("text").mapInArrow(count, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.limit(most + 1).collect()
    if len(found) > most:
        return hot_minimisers(docs, width, group, 2 * least, most)
    return np.sort(np.array([r["low"] for r in found], np.int64).view(np.uint64))


def _spaced(dictionary: pa.Array) -> list:
    """Buffers of the dictionary's entries with a space after each."""
    data, off = as_bytes(dictionary)
    out = np.full(len(data) + len(dictionary), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(dictionary)), np.diff(off))] = data
    return [None, pa.py_buffer((off + np.arange(len(off))).astype(np.int64)), pa.py_buffer(out)]


def later_in_bucket(blobs: list[bytes], width: int = WIDTH):
    """The stretches of a bucket's windows that have an equal one which starts earlier."""
    parts = [_unpack(b) for b in blobs]
    doc, tie, start, n_words = (np.concatenate([p[k] for p in parts]) for k in range(4))
    text = np.concatenate([p[4] for p in parts])
    del parts
    w = Words(text, np.array([0, len(text)], np.int64))
    codes = w.codes
    del text
    begins = np.cumsum(n_words) - n_words
    counts = n_words - (width - 1)
    at = ragged(begins, counts)
    h = windows(hashed_codes(len(w.dictionary))[codes], width)[at]
    doc, tie = np.repeat(doc, counts), np.repeat(tie, counts)
    start = at - np.repeat(begins, counts) + np.repeat(start, counts)
    later = later_windows(h, codes, at, doc, tie, start, width)
    return runs(doc[later], tie[later], start[later], width)


def hashed_codes(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, doc, tie, text of the rows to judge; doc_id, text, times of the rows that repeat one of them, if any).

    doc and tie name a row: doc is its id, and rows that share their id or have none differ in tie. Rows equal in
    id and text are counted where they are read, so however many there are, a task sends one of them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("doc_id").isNull() | (F.col("doc_id") == NO_ID) | (F.col("n") > 1))
    ids = stored(ids.select("doc_id"), "shared-ids")
    doc = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")
    alone = rows.select("doc_id", doc, F.lit(0).cast("long").alias("tie"), "text")
    if ids.isEmpty():
        return alone, None
    named = near(ids.where("doc_id is not null"))
    alone = alone.where("doc_id is not null").join(named, "doc_id", "left_anti")
    shared = rows.join(named, "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))
    nameless = F.when(F.col("doc_id").isNull(), F.lit(1 << 61)).otherwise(F.lit(0).cast("long"))
    tie = F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(nameless).alias("tie")
    counts = stored(shared.withColumn("part", F.spark_partition_id()).groupBy("doc_id", "text", "part").agg(F.count("*").alias("n")).select("doc_id", doc, tie, "text", "part", "n"), "equal-rows")
    leads = counts.groupBy("doc", "tie").agg(F.min("part").alias("lead"))
    counts = stored(counts.join(leads, ["doc", "tie"]).withColumn("lead", F.col("part") == F.col("lead")), "told-rows")
    rest = counts.select("doc_id", "text", (F.col("n") - F.col("lead").cast("long")).alias("times")).where("times > 0")
    return alone.select("doc_id", "doc", "tie", "text").unionByName(counts.where("lead").select("doc_id", "doc", "tie", "text")), rest


def repeated_stretches(rows: DataFrame, width: int = WIDTH, group: int = GROUP, bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc, tie, low, high): words low .. high - 1 are in windows that also start earlier; stretches may overlap.

    rows: doc, tie, text without nulls, no two rows of one doc and tie.
    """
    # Each word travels about three times; snappy halves a text, nearly.
    buckets = max(16, input_bytes(rows) * 5 // bucket_bytes)

    hot = hot_minimisers(rows, width, group, hot_runs)

    def out(found):
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc", "tie", "low", "high"])

    def emit(it):
        schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
        for number, block in enumerate(batches(it, limit=BLOCK)):
            settled, rows = super_kmers(block, buckets, width, group, hot)
            if len(settled[0]):
                # Stretches settled here go along, to any bucket, so that nothing is computed twice.
                empty = np.concatenate(settled).tobytes()
                to = int(mixed(settled[0][:1].astype(np.uint64) + np.uint64(number))[0] % np.uint64(buckets))
                rows.append((to, b"S" + empty))
            rows = [(b, x if x[:1] == b"S" else b"K" + x) for b, x in rows]
            for a in range(0, len(rows), 1024):
                part = rows[a : a + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.binary())], schema=schema)

    def settle(table: pa.Table) -> pa.Table:
        raw, off = as_bytes(table["blob"])
        blobs = [raw[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
        found = [np.frombuffer(x, np.int64, offset=1).reshape(4, -1) for x in blobs if x[:1] == b"S"]
        packed = [x[1:] for x in blobs if x[:1] == b"K"]
        if packed:
            found.append(np.stack(later_in_bucket(packed, width)))
            del packed, blobs
        trim()
        return out(np.concatenate(found, axis=1))

    sent = rows.select("doc", "tie", "text").mapInArrow(emit, "bucket long, blob binary")
    return sent.groupBy("bucket").applyInArrow(settle, "doc long, tie long, low long, high long")


def without_repeats(docs: DataFrame, width: int = WIDTH, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by spaces) for every row of docs (doc_id long, text)."""
    rows, rest = identified(docs)
    found = repeated_stretches(rows, width, **how).groupBy("doc", "tie").agg(F.collect_list(F.struct("low", "high")).alias("gone"))

    def keep(it):
        for block in batches(it):
            w = Words(*as_bytes(block["text"]))
            gone = block["gone"].combine_chunks()
            spans = gone.flatten()
            counts = np.diff(np.asarray(gone.offsets)) if not gone.null_count else np.array([0 if x is None else x for x in gone.value_lengths().to_pylist()])
            change = np.zeros(len(w.codes) + 1, np.int64)
            if len(spans):
                base = np.repeat(w.offsets[:-1], counts)
                limit = np.repeat(w.offsets[1:], counts)
                low = np.minimum(base + spans.field("low").to_numpy(), limit)
                high = np.minimum(base + spans.field("high").to_numpy(), limit)
                np.add.at(change, low, 1)
                np.add.at(change, high, -1)
            stays = np.cumsum(change)[:-1] == 0
            total = np.zeros(len(stays) + 1, np.int64)
            np.cumsum(stays, out=total[1:])
            left = total[w.offsets]
            spaced = pa.Array.from_buffers(pa.large_binary(), len(w.dictionary), _spaced(w.dictionary))
            text, edges = as_bytes(spaced.take(pa.array(w.codes[stays])))
            edge = edges[left]
            data = text.tobytes()
            kept = [data[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            arrays = [block["doc_id"].combine_chunks(), pa.array(w.counts), pa.array(w.counts - np.diff(left)), pa.array(kept, pa.binary())]
            yield from pa.Table.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"]).to_batches()

    schema = "doc_id long, n_words long, n_removed long, kept binary"
    out = rows.join(found, ["doc", "tie"], "left").select("doc_id", "text", "gone").mapInArrow(keep, schema)
    if rest is not None:
        # Every window of theirs starts earlier, in the row that they repeat.
        words = F.size(F.filter(F.split(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), " "), lambda w: w != "")).cast("long")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), words.alias("high")))
        again = rest.select("doc_id", "text", F.when(words >= width, whole).alias("gone"), F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        out = out.unionByName(again.select("doc_id", "text", "gone").mapInArrow(keep, schema))
    return out.withColumn("kept", F.col("kept").cast("string"))


def digested(docs: DataFrame, width: int = WIDTH, **how) -> DataFrame:
    """As without_repeats, with the kept text's SHA-256 in its place."""
    return without_repeats(docs, width, **how).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
