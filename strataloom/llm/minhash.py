"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, bands, and exact overlap.

A text is the multiset of its shingles (five consecutive words). Each shingle stands for Poisson processes over
its weight: dyadic weight levels [0, 1), [1, 2), [2, 4), [4, 8) ... each have a process of the level's rate, seeded
by shingle and level, whose points fall on the signature's components. The top level, of which the weight covers
a part, keeps the points whose place lies below the weight. A component takes the earliest point that falls
on it, so two texts agree there with the probability of their weighted Jaccard similarity. Points are drawn
only up to the time by which all components are expected to be filled; texts that are not filled draw on.

Bands of components bring candidates together, then multisets are compared exactly:

1. Equal texts are one node. In each bucket every node is compared with one hub; links join nodes to components.
2. A bucket that still holds several components compares the members outside its largest component with all its
   members of other components, in blocks, as matrix products. No pair of rows is made for that: only links come
   out. So any two texts of one bucket that are similar end in one class, and a large group of near copies
   costs no square of its size once its members hang together.

Defined results: similarity is the sum of minima over the sum of maxima of shingle counts. A text of one to four
words is one shingle. Texts without words are near to equal texts only. A null text is empty. Rows without an id
get a class of null ids with equal or near texts. Repeated rows are rows of their class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, batches, hashed, mixed, near, ragged, stored, trim, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
#: Members, and shingles, of one block of an exact comparison.
BLOCK_MEMBERS = 1024
BLOCK_SHINGLES = 1 << 21

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, shingle's hash, count), sorted by text and hash."""
    w = Words(data, off)
    n, n_docs = len(w.codes), len(off) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashed(w.dictionary)[w.codes]
    doc = w.documents()
    at = np.flatnonzero(np.arange(n) + size <= w.offsets[1:][doc])
    keys, docs = [windows(h, size)[at]] if n >= size else [h[:0]], [doc[at]]
    for short in range(1, size):
        texts = np.flatnonzero(w.counts == short)
        if len(texts):
            keys.append(mixed(windows(h, short)[w.offsets[:-1][texts]] + np.uint64(short)))
            docs.append(texts)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    bits = np.uint64(max(1, int(n_docs).bit_length()))
    order = np.argsort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (key >> bits), kind="stable")
    key, doc = key[order], doc[order]
    if ((doc[1:] == doc[:-1]) & (key[1:] < key[:-1])).any():  # equal in the bits that were compared
        order = np.lexsort([key, doc])
        key, doc = key[order], doc[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    return doc[first], key[first], np.diff(np.append(first, len(key)))


def signatures(doc: np.ndarray, key: np.ndarray, count: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """BagMinHash signatures (n_docs, size): the earliest point on each component; infinite without shingles."""
    sig = np.full(n_docs * size, np.inf)
    total = np.bincount(doc, weights=count, minlength=n_docs)
    # Levels: 0 is [0, 1), k is [2**(k-1), 2**k). A shingle of count c reaches levels 0 .. bit_length(c - 1).
    levels = np.where(count > 1, np.floor(np.log2(np.maximum(count - 1, 1))).astype(np.int64) + 2, 1)
    which = np.repeat(np.arange(len(key)), levels)
    level = ragged(np.zeros(len(key), np.int64), levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    rate = np.maximum(low, 1)
    share = np.minimum(count[which] - low, rate)  # how much of the level the weight covers
    with np.errstate(over="ignore"):
        seed = mixed(key[which] + _GOLD * (level.astype(np.uint64) + np.uint64(1)))
    owner = doc[which]
    limit = np.zeros(n_docs)
    due = np.flatnonzero(total > 0)
    stop = size * (np.log(size) + 3)
    pick = np.isin(owner, due) if len(due) < n_docs else np.ones(len(owner), bool)
    while len(due):
        limit[due] = stop / total[due]
        mine = np.flatnonzero(pick)
        state, at, r, s, o = seed[mine], np.zeros(len(mine)), rate[mine], share[mine], owner[mine]
        step = np.uint64(0)
        while len(state):
            step += np.uint64(1)
            with np.errstate(over="ignore"):
                a = mixed(state + _GOLD * (np.uint64(2) * step))
                b = mixed(state + _GOLD * (np.uint64(2) * step + np.uint64(1)))
            at = at - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / r
            live = at <= limit[o]
            if not live.all():
                state, at, r, s, o, b = state[live], at[live], r[live], s[live], o[live], b[live]
            place = (b >> np.uint64(32)).astype(np.int64) % r  # rates are powers of two
            inside = place < s
            component = (b & np.uint64(0xFFFFFFFF)).astype(np.int64) % size
            np.minimum.at(sig, (o * size + component)[inside], at[inside])
        due = due[np.isinf(sig.reshape(n_docs, size)[due]).any(axis=1)]
        pick = np.zeros(n_docs, bool)
        pick[due] = True
        pick = pick[owner]
        stop *= 2
    return sig.reshape(n_docs, size)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    bits = np.ascontiguousarray(sig).view(np.uint64)
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            with np.errstate(over="ignore"):
                key = mixed(key * _GOLD + bits[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def members_of(doc: np.ndarray, key: np.ndarray, count: np.ndarray, n_docs: int) -> list[bytes]:
    """For each text its shingles as a sorted set of 64-bit members: the j-th occurrence is a member of its own."""
    which = np.repeat(np.arange(len(key)), count)
    nth = ragged(np.zeros(len(key), np.int64), count).astype(np.uint64)
    with np.errstate(over="ignore"):
        member = np.where(nth > 0, mixed(key[which] + _GOLD * nth), key[which])
    of = doc[which]
    order = np.lexsort([member, of])
    raw = member[order].astype("<u8").tobytes()
    edges = (np.append(0, np.cumsum(np.bincount(of, minlength=n_docs))) * 8).astype(np.int64).tolist()
    return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of also, node (a 128-bit digest of the text), total (shingles), bands for every row."""
    rest = ["doc_id", *also]

    def sign(it):
        import xxhash

        for block in batches(it, limit=4 << 20):
            data, off = as_bytes(block["text"])
            doc, key, count = shingles(data, off, size)
            n = block.num_rows
            total = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            keys = band_keys(signatures(doc, key, count, n, bands * rows), bands, rows)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))
            raw = data.tobytes()
            nodes = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield from pa.Table.from_arrays([*[block[c].combine_chunks() for c in rest], pa.array(nodes, pa.binary()), pa.array(total), lists], names=[*rest, "node", "total", "bands"]).to_batches()

    kinds = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in rest)
    return docs.select(*rest, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sign, f"{kinds}, node binary, total long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE) -> DataFrame:
    """node, members for the wanted nodes (doc_id, node: one row that holds the node's text; a null id if no row with an id does)."""

    def digests(block: pa.Table) -> pa.Array:
        import xxhash

        data, off = as_bytes(block["text"])
        raw = data.tobytes()
        return pa.array([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())

    def name(it):
        for block in batches(it, limit=4 << 20):
            yield from pa.Table.from_arrays([digests(block), block["text"]], names=["node", "text"]).to_batches()

    def expand(it):
        for block in batches(it, limit=4 << 20):
            block = block.filter(pc.equal(block["node"], pa.chunked_array([digests(block)])))  # an id may have several texts
            found = members_of(*shingles(*as_bytes(block["text"]), size), block.num_rows)
            yield from pa.Table.from_arrays([block["node"].combine_chunks(), pa.array(found, pa.binary())], names=["node", "members"]).to_batches(max_chunksize=500)

    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.join(near(wanted), "doc_id").select("node", "text")
    if not wanted.where("doc_id is null").isEmpty():
        # Texts that only rows without an id hold are found by their digests.
        named = docs.where("doc_id is null").select("text").mapInArrow(name, "node binary, text string")
        rows = rows.unionByName(named.join(near(stored(wanted.where("doc_id is null").select("node"), "nameless")), "node", "left_semi").dropDuplicates(["node"]))
    return rows.mapInArrow(expand, "node binary, members binary")


def similar(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, a_members, b_members) whose sets are similar: a, b."""

    def compare(it):
        for batch in it:
            a_raw, a_off = as_bytes(batch.column(2))
            b_raw, b_off = as_bytes(batch.column(3))
            a_all, b_all = np.frombuffer(a_raw.tobytes(), "<u8"), np.frombuffer(b_raw.tobytes(), "<u8")
            a_off, b_off = a_off // 8, b_off // 8
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = a_all[a_off[i] : a_off[i + 1]], b_all[b_off[i] : b_off[i + 1]]
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep[i] = common >= least * (len(a) + len(b) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))
        trim()

    return pairs.select("a", "b", "a_members", "b_members").mapInArrow(compare, "a binary, b binary")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the component's smallest node) for the nodes of links (a, b): alternating stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        edges = stored(small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "stars")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _open_links(members: DataFrame, roots: DataFrame, sets: DataFrame, least: float, block_members: int, block_shingles: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components.

    members: bucket, node, total. The members outside a bucket's largest component are queries, all are targets.
    """
    placed = stored(members.join(near(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    by_root = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("total").alias("w"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    facts = by_root.groupBy("bucket").agg(
        F.count("*").alias("roots"),
        F.sum("n").alias("n"),
        F.sum("w").alias("w"),
        F.sum("mark").alias("mark"),
        F.max(F.struct("n", "w", "root")).alias("main"),
    )
    # Buckets of two were compared whole; those of the same members are compared once.
    facts = facts.where("roots > 1 and n > 2")
    facts = facts.groupBy("n", "w", "mark", "main").agg(F.min("bucket").alias("bucket"))

    def parts(n: Column, w: Column) -> Column:
        return F.greatest(F.ceil(n / block_members), F.ceil(w / block_shingles)).cast("int")

    facts = stored(
        facts.select(
            "bucket",
            F.col("main.root").alias("main"),
            parts(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("query_parts"),
            parts(F.col("n"), F.col("w")).alias("target_parts"),
        ),
        "open-buckets",
    )
    rows = placed.join(near(facts), "bucket")
    part = F.xxhash64("node")
    queries = rows.where("root != main").select("bucket", "node", "root", F.pmod(part, "query_parts").alias("q"), F.explode(F.sequence(F.lit(0), F.col("target_parts") - 1)).alias("t"), F.lit(True).alias("query"))
    targets = rows.select("bucket", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_parts").cast("long") - 1)).alias("q"), F.pmod(part, "target_parts").cast("int").alias("t"), F.lit(False).alias("query"))
    work = queries.unionByName(targets).join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        query = table["query"].to_numpy()
        nodes = table["node"].to_pylist()
        roots_ = table["root"].to_pylist()
        raw, off = as_bytes(table["members"])
        a, b = block_links(np.frombuffer(raw.tobytes(), "<u8"), off // 8, query, np.unique(np.array(roots_, dtype=object), return_inverse=True)[1], least)
        trim()
        return pa.Table.from_arrays([pa.array([nodes[i] for i in a], pa.binary()), pa.array([nodes[i] for i in b], pa.binary())], names=["a", "b"])

    return work.groupBy("bucket", "q", "t").applyInArrow(compare, "a binary, b binary")


def block_links(members: np.ndarray, off: np.ndarray, query: np.ndarray, root: np.ndarray, least: float, columns: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """(queries, targets) of different roots whose sets are similar: overlaps are a product of 0/1 matrices.

    Of the links that join the same roots, directly or through others of the block, one chain is given: fewer links
    than roots, with the same components.
    """
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    ids, column = np.unique(members, return_inverse=True)
    shared = np.bincount(column, minlength=len(ids)) > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    q, t = np.flatnonzero(query), np.flatnonzero(~query)
    as_q, as_t = np.full(len(size), -1), np.full(len(size), -1)
    as_q[q], as_t[t] = np.arange(len(q)), np.arange(len(t))
    common = np.zeros((len(q), len(t)), np.float64)
    n = int(shared.sum())
    for low in range(0, n, columns):
        high = min(n, low + columns)
        x, y = np.searchsorted(column, [low, high])
        r, c = row[x:y], column[x:y] - low
        left, right = np.zeros((len(q), high - low), np.float32), np.zeros((len(t), high - low), np.float32)
        is_q = as_q[r] >= 0
        left[as_q[r[is_q]], c[is_q]] = 1
        right[as_t[r[~is_q]], c[~is_q]] = 1
        common += left @ right.T
    union = size[q][:, None] + size[t][None, :] - common
    hit = (common >= least * union - 1e-9) & (root[q][:, None] != root[t][None, :])
    parent = np.arange(int(root.max(initial=-1)) + 1)

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    for i in np.flatnonzero(hit.any(axis=1)).tolist():
        others = np.flatnonzero(hit[i])
        for j in others[np.unique(root[t[others]], return_index=True)[1]].tolist():
            a, b = top(int(root[q[i]])), top(int(root[t[j]]))
            if a != b:
                parent[a] = b
                left.append(int(q[i]))
                right.append(int(t[j]))
    return np.array(left, np.int64), np.array(right, np.int64)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, block_members: int = BLOCK_MEMBERS, block_shingles: int = BLOCK_SHINGLES, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, kept (doc_id is class_id) and the columns of also for every row."""
    docs = docs.select("doc_id", "text", *also)
    signed_rows = stored(signed(docs, bands, rows, size, also), "signatures")
    # Equal texts are one node; the partial aggregate leaves a row a task and text.
    nodes = signed_rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("total").alias("total"), F.any_value("bands").alias("bands")).where("total > 0")
    banded = nodes.select("node", "doc_id", "total", F.explode("bands").alias("bucket"))
    hub = F.struct(F.xxhash64("node").alias("order"), F.col("node").alias("node"), F.col("total").alias("total"))
    buckets = stored(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(hub).alias("hub")).where("n > 1"), "buckets")
    members = stored(banded.join(near(buckets.select("bucket", F.col("hub.node").alias("hub"), F.col("hub.total").alias("hub_total"))), "bucket"), "members")

    sets = stored(shingle_sets(docs, stored(members.select("doc_id", "node").distinct(), "candidates"), size).dropDuplicates(["node"]), "sets")
    long_enough = F.least("total", "hub_total") >= least * F.greatest("total", "hub_total") - 1e-9
    edges = members.where((F.col("node") != F.col("hub")) & long_enough).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    with_a = edges.join(sets.select(F.col("node").alias("a"), F.col("members").alias("a_members")), "a")
    links = stored(similar(with_a.join(sets.select(F.col("node").alias("b"), F.col("members").alias("b_members")), "b"), least), "first-links")
    roots = components(links)
    more = stored(_open_links(members.select("bucket", "node", "total"), roots, sets, least, block_members, block_shingles), "more-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    placed = signed_rows.select("doc_id", *also, "node").join(near(roots), "node", "left").select("doc_id", *also, F.coalesce("root", "node").alias("root"))
    classes = stored(placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1"), "classes")
    found = placed.join(near(classes), "root", "left")
    class_id = F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return found.select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.col("doc_id").eqNullSafe(class_id).alias("kept"), *also)
