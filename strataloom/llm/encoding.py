"""Documents to token ids and back, with the engine of `bpe`."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import batches

#: Bytes of text whose pre-tokens share one pair index.
INDEX_BYTES = 16 << 20


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) for every row of docs (doc_id, text); a null text has no ids."""

    def encode(it):
        vocab = vocabulary(path)
        for block in batches(it, limit=INDEX_BYTES):
            ids, off = vocab.encode(block["text"].combine_chunks())
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            yield from pa.Table.from_arrays([block["doc_id"].combine_chunks(), lists], names=["doc_id", "ids"]).to_batches(max_chunksize=1000)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text for every row of tokens (doc_id, ids); null ids are none."""

    def decode(it):
        vocab = vocabulary(path)
        for batch in it:
            lists = batch.column(1)
            off = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            texts = vocab.decode(lists.flatten().to_numpy(zero_copy_only=False), off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text)."""

    def digest(it):
        vocab = vocabulary(path)
        sha = hashlib.sha256
        for block in batches(it, limit=INDEX_BYTES):
            ids, off = vocab.encode(block["text"].combine_chunks())
            raw = memoryview(ids.astype("<u4").tobytes())
            edges = (off * 4).tolist()
            of_ids = [sha(raw[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            of_text = [sha(t.encode()).hexdigest() for t in vocab.decode(ids, off)]
            arrays = [block["doc_id"].combine_chunks(), pa.array(np.diff(off)), pa.array(of_ids), pa.array(of_text)]
            yield from pa.Table.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).to_batches()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
