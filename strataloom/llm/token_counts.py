"""Token counts of documents in flat, unindexed token files, by a scan for separators.

A token file is a plain run of little-endian identifiers in which each document ends with the end-of-document
identifier; nothing says where documents begin. Files are read by ranges of bytes, so one file is worked on by many
tasks, and a range may begin within an identifier: Spark's text source cuts a range at the separator's bytes, wherever
they stand, and what it cut is joined again. The joined bytes of a block are searched at once for the separator at every
alignment, and the block hands on, for each alignment, how many separators it has and where the last one is. A prefix
scan over the blocks' sums gives each block its place in the file, hence its alignment, how many documents and tokens came
before it and where the document that it continues began. Only sums pass through the scan; the separators' places stay
with their blocks and are joined to the scan's result. Documents may span any number of blocks and files.

`write_tokens` writes such files: Spark's text writer takes the separator's bytes for the end of a line. In the same
pass it writes a sidecar, the documents' ids by their number in the file, as the token files know of no ids. It keeps
the separator unambiguous: where encoding emits the end-of-document identifier inside a text (the text holds the marker
itself), the file has the first identifier past the vocabulary instead. It counts as the one token that it is.

Defined results: an empty document, or a null text, has no tokens; a null id stays null; rows of one id are documents of
their own. Identifiers after the last separator are a document that is not terminated. A file whose size is no multiple of
the identifier's is an error, and so is an end-of-document identifier whose bytes overlap themselves (0 has such). Columns
other than doc_id and text are ignored, whatever their names. No files or no rows: no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import as_bytes, batches, shared_folder, stored

#: Bytes of one block of the search.
BLOCK = 4 << 20


def separator(end: int, width: int) -> bytes:
    """The bytes of the end-of-document identifier, none of whose beginnings is one of its ends."""
    raw = end.to_bytes(width, "little")
    if any(raw[:k] == raw[-k:] for k in range(1, width)):
        raise ValueError(f"the bytes of identifier {end} overlap themselves: they cannot separate documents")
    return raw


def _as_lines(raw: bytes) -> dict[str, str]:
    """Options of the text source that make these bytes the end of a line."""
    return {"lineSep": raw.decode("latin-1"), "encoding": "ISO-8859-1"}


def write_tokens(docs: DataFrame, path: str, end: int, width: int = 2) -> str:
    """Flat token files of all docs (doc_id, text) below the shared folder, a file for each input partition; the folder.

    kind=tokens has the files, kind=ids a file of the same name for each with lines of a document's number and its id.
    """
    raw, spark = separator(end, width), docs.sparkSession

    def emit(it):
        vocab = vocabulary(path)
        kind, inner = f"<u{width}", max(vocab.size, end + 1)
        if inner >= 1 << 8 * width:
            raise ValueError(f"identifiers up to {inner} do not fit {width} bytes")
        number = 0
        for block in batches(it):
            tokens, off = vocab.encode(block["text"].combine_chunks())
            run = np.where(tokens == end, inner, tokens).astype(kind).tobytes()
            edges = (off * width).tolist()
            values = [run[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            ids = ["" if i is None else str(i) for i in block["doc_id"].to_pylist()]
            names = [f"{number + k} {i}".encode() for k, i in enumerate(ids)]
            number += block.num_rows
            for k, held in (("tokens", values), ("ids", names)):
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(held)), pa.array(held, pa.binary())], names=["kind", "value"])

    out = shared_folder(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(emit, "kind string, value binary")
    # Both files of a task are open at once, so rows are written in the order in which they come.
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 2)
    try:
        rows.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind").option("compression", "none").options(**_as_lines(raw)).text(out)
    finally:
        spark.conf.set(setting, before)
    return out


def _lines(spark: SparkSession, folder: str, raw: bytes, kind: str | None = None) -> DataFrame:
    """The lines of a folder's files, with their ranges; of one of the kinds that write_tokens writes."""
    df = spark.read.options(**_as_lines(raw)).text(folder)
    if kind is not None:
        df = df.where(F.col("kind") == kind) if "kind" in df.columns else df.where("false")
    at = F.col("_metadata")
    return df.select(at["file_name"].alias("file"), at["file_block_start"].alias("range"), at["file_size"].alias("size"), "value")


def written_documents(spark: SparkSession, folder: str, end: int, width: int = 2) -> DataFrame:
    """file, ordinal, doc_id of what write_tokens wrote."""
    parts = F.split("value", " ")
    lines = _lines(spark, folder, separator(end, width), "ids")
    return lines.select("file", parts[0].cast("long").alias("ordinal"), F.nullif(parts[1], F.lit("")).cast("long").alias("doc_id"))


def searched(spark: SparkSession, folder: str, end: int, width: int = 2, kind: str | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """The blocks of a folder's token files: file, range, part, size (the file's), bytes, counts and last by alignment, hits.

    A block is a part of a range of bytes. hits: the places in it, in bytes, where the separator's bytes stand; of those
    at each alignment, counts has the number and last the last place (-1: none). The last separator of a range is a part
    of its own: the text source does not tell whether it is there or the file just ended.
    """
    raw = separator(end, width)
    schema = pa.schema([("file", pa.string()), ("range", pa.int64()), ("part", pa.int32()), ("size", pa.int64()), ("bytes", pa.int64())] + [(c, pa.list_(pa.int64())) for c in ("counts", "last", "hits")])

    def row(place: tuple, part: int, data: np.ndarray) -> pa.RecordBatch:
        found = data[: len(data) - width + 1] == raw[0]
        for k in range(1, width):
            found &= data[k : len(data) - width + 1 + k] == raw[k]
        hits = np.flatnonzero(found)
        by = [hits[hits % width == p] for p in range(width)]
        name, start, size = place
        values = [[name], [start], [part], [size], [len(data)], [[len(x) for x in by]], [[int(x[-1]) if len(x) else -1 for x in by]], [hits]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def joined(values: pa.Array) -> np.ndarray:
        """The values, a separator after each."""
        data, off = as_bytes(values)
        out = np.empty(len(data) + width * len(values), np.uint8)
        ends = off[1:] + width * np.arange(len(values))
        gaps = (ends[:, None] + np.arange(width)).ravel()
        inside = np.ones(len(out), bool)
        inside[gaps] = False
        out[inside] = data
        out[gaps] = np.tile(np.frombuffer(raw, np.uint8), len(values))
        return out

    def search(it) -> Iterator[pa.RecordBatch]:
        place, part = None, 0
        for table in batches(it, "value", block_bytes):
            columns = [table[c].to_pylist() for c in ("file", "range", "size")]
            places = list(zip(*columns, strict=True))
            cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if places[a] != place:
                    if place is not None:
                        yield row(place, part, np.frombuffer(raw, np.uint8))
                    place, part, pending = places[a], 0, 0
                data = joined(table["value"].slice(a, b - a).combine_chunks())
                # What ended the part before is put before this one, what ends this one is held back.
                data = np.concatenate([np.frombuffer(raw, np.uint8)[: width * pending], data[:-width]])
                pending = 1
                yield row(place, part, data)
                part += 1
        if place is not None:
            yield row(place, part, np.frombuffer(raw, np.uint8))

    lines = _lines(spark, folder, raw, kind).select("file", "range", "size", F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(search, "file string, range long, part int, size long, bytes long, counts array<long>, last array<long>, hits array<long>")


def documents_in(blocks: DataFrame, width: int = 2, one_stream: bool = False) -> DataFrame:
    """stream, ordinal, start, n_tokens (without the separator), terminated for each document of the searched blocks.

    A file is a stream, or in order of names all files are one. The scan has two levels, over the blocks of a file and
    over the files of a stream; a document that goes on from file to file is cut by none.
    """
    blocks = stored(blocks, "searched")
    order = Window.partitionBy("file").orderBy("range", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.select("file", "range", "part", "size", "bytes", "counts", "last").withColumn("at", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    # An end that lies past the file's is the one that the text source may have made up.
    sums = sums.where(F.col("at") < F.col("size"))
    sums = sums.withColumn("shift", F.pmod(-F.col("at"), F.lit(width)).cast("int") + 1)
    sums = sums.withColumn("docs", F.element_at("counts", F.col("shift"))).withColumn("last", F.element_at("last", F.col("shift")))
    sums = sums.withColumn("begun", F.when(F.col("docs") > 0, F.col("at") + F.col("last") + width)).drop("counts", "last")
    local = sums.withColumn("seen", F.coalesce(F.sum("docs").over(before), F.lit(0))).withColumn("carried", F.max("begun").over(before))

    stream = F.lit("") if one_stream else F.col("file")
    files = sums.groupBy("file").agg(F.max("size").alias("f_size"), F.sum("docs").alias("f_docs"), F.max("begun").alias("f_begun")).withColumn("stream", stream)
    torn = F.raise_error(F.concat(F.lit("file "), F.col("file"), F.lit(" ends within an identifier")))
    files = files.withColumn("f_size", F.when(F.col("f_size") % width == 0, F.col("f_size")).otherwise(torn.cast("long")))
    earlier = Window.partitionBy("stream").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("f_at", F.coalesce(F.sum("f_size").over(earlier), F.lit(0))).withColumn("f_seen", F.coalesce(F.sum("f_docs").over(earlier), F.lit(0)))
    files = files.withColumn("f_carried", F.coalesce(F.max(F.col("f_at") + F.col("f_begun")).over(earlier), F.lit(0)))

    told = local.join(files.select("file", "stream", "f_at", "f_seen", "f_carried"), "file").where("docs > 0")
    told = told.select("file", "range", "part", "stream", (F.col("f_at") + F.col("at")).alias("at"), (F.col("f_seen") + F.col("seen")).alias("seen"), F.coalesce(F.col("f_at") + F.col("carried"), F.col("f_carried")).alias("carried"))
    ends = blocks.select("file", "range", "part", "hits").join(told, ["file", "range", "part"])
    ends = ends.withColumn("ends", F.filter("hits", lambda p: (p + F.col("at")) % width == 0))
    each = ends.select("stream", "seen", "at", "carried", "ends", F.posexplode("ends").alias("i", "end"))
    began = F.when(F.col("i") == 0, F.col("carried")).otherwise(F.col("at") + F.element_at("ends", F.greatest("i", F.lit(1))) + width)
    length = F.col("at") + F.col("end") - began
    whole = each.select("stream", (F.col("seen") + F.col("i")).alias("ordinal"), (began / width).cast("long").alias("start"), (length / width).cast("long").alias("n_tokens"), F.lit(True).alias("terminated"))
    tails = files.groupBy("stream").agg(F.sum("f_docs").alias("ordinal"), F.coalesce(F.max(F.col("f_at") + F.col("f_begun")), F.lit(0)).alias("began"), F.sum("f_size").alias("all"))
    tails = tails.where("all > began").select("stream", "ordinal", (F.col("began") / width).cast("long").alias("start"), ((F.col("all") - F.col("began")) / width).cast("long").alias("n_tokens"), F.lit(False).alias("terminated"))
    return whole.unionByName(tails)


def counted(docs: DataFrame, path: str, end: int, width: int = 2, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, stream, ordinal, start, n_tokens for every row of docs (doc_id, text): written, then scanned."""
    spark = docs.sparkSession
    folder = write_tokens(docs, path, end, width)
    found = documents_in(searched(spark, folder, end, width, "tokens", block_bytes), width)
    ids = written_documents(spark, folder, end, width).withColumnRenamed("file", "stream")
    return found.join(ids, ["stream", "ordinal"]).select("doc_id", "stream", "ordinal", "start", "n_tokens")
