"""Similarity of word sets to a stated set of items."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r
from ..functions.text import word_set


def similar_to(docs: DataFrame, items: DataFrame, least: float, block_words: int = 1 << 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, jaccard) whose word sets have at least that Jaccard similarity.

    The items' words are an inverted index that is broadcast in blocks of at most
    ``block_words`` words, one pass over the documents a block.  A document's words are
    looked up in it and the hits counted by item; no words are shuffled, and only pairs that
    pass leave a batch.  Items whose size alone rules a document out are not looked at.
    """
    spark = docs.sparkSession
    sets = items.select(F.col(item_id).alias("item"), word_set(F.coalesce(text, F.lit(""))).alias("w")).where("item is not null")
    total = sets.agg(F.sum(F.size("w"))).head()[0] or 0
    n_blocks = max(1, math.ceil(total / block_words))
    words = docs.select(F.col(doc_id).alias("doc"), word_set(F.coalesce(text, F.lit(""))).alias("w"))
    out = None
    for k in range(n_blocks):
        part = sets if n_blocks == 1 else sets.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k)
        rows = [(x.item, x.w) for x in part.toLocalIterator()]  # one block's words
        ids = np.array([i for i, _ in rows], np.int64)
        sizes = np.array([len(w) for _, w in rows], np.int64)
        flat = pa.array([x for _, w in rows for x in w], pa.string()).dictionary_encode()
        codes = flat.indices.to_numpy().astype(np.int64)
        order = np.argsort(codes, kind="stable")
        heads = np.searchsorted(codes[order], np.arange(len(flat.dictionary) + 1))
        holders = np.repeat(np.arange(len(rows)), sizes)[order]
        shared = spark.sparkContext.broadcast((flat.dictionary, heads, holders, ids, sizes))
        found = words.mapInArrow(_counted(shared, least), "doc long, item long, common long, either long")
        out = found if out is None else out.unionByName(found)
    share = r(F.col("common") / F.col("either"), 4)
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), share.alias("jaccard")).where(F.col("jaccard") >= least)


def _counted(shared, least: float):
    def run(batches):
        import pyarrow.compute as pc

        dictionary, heads, holders, ids, sizes = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                b = batch.slice(a, 512)
                lists = b.column(1)
                n = np.diff(lists.offsets.to_numpy())
                code = pc.fill_null(pc.index_in(lists.flatten(), dictionary), -1).to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(n)), n)
                doc, code = doc[code >= 0], code[code >= 0]
                each = heads[code + 1] - heads[code]
                at = np.repeat(heads[code], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                common = np.bincount(np.repeat(doc, each) * max(1, len(ids)) + holders[at], minlength=len(n) * max(1, len(ids)))
                pair = np.flatnonzero(common)
                i, j = pair // max(1, len(ids)), pair % max(1, len(ids))
                either = n[i] + sizes[j] - common[pair]
                keep = common[pair] + 1e-4 * either >= least * either  # rounding decides the rest
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i[keep])), pa.array(ids[j[keep]]), pa.array(common[pair][keep].astype(np.int64)), pa.array(either[keep].astype(np.int64))], names=["doc", "item", "common", "either"])

    return run
