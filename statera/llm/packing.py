"""Best-fit packing of documents into training sequences, under conflicts of source and duplicate cluster."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import importable, materialise, word_count


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, pieces taken by falling size (ties in the order given).

    Bins are kept ordered by residual. The search starts at the first residual that holds the piece and goes to the next
    larger until a bin has neither the piece's source nor its duplicate cluster in its bitmaps; else a bin is opened.
    """
    bit_of = {x: 1 << i for i, x in enumerate(dict.fromkeys(sources))}
    met: dict = {}
    for c in clusters:
        met[c] = met.get(c, 0) + 1
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in met.items() if n > 1)}  # a lone piece conflicts with none
    ordered: list[tuple[int, int]] = []
    source_map: list[int] = []
    cluster_map: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, s, c = sizes[i], bit_of[sources[i]], cluster_bit.get(clusters[i], 0)
        for k in range(bisect_left(ordered, (size, -1)), len(ordered)):
            residual, b = ordered[k]
            if not (source_map[b] & s or cluster_map[b] & c):
                del ordered[k]
                break
        else:
            residual, b = capacity, len(source_map)
            source_map.append(0)
            cluster_map.append(0)
        bins[i], offsets[i] = b, capacity - residual
        source_map[b] |= s
        cluster_map[b] |= c
        insort(ordered, (residual - size, b))
    return bins, offsets


def pack(docs: DataFrame, cluster: Column, capacity: int = 2048, shard_rows: int = 4096) -> DataFrame:
    """(doc_id, piece, size, start, bin_id, bin_offset): the place of each piece of each row of ``docs`` (doc_id, text, source).

    Sizes are words. A document over ``capacity`` is cut into full pieces, each a bin of its own, and a rest; ``start`` is the
    piece's first word in the document. Rests and shorter documents are dealt at random into shards of about ``shard_rows``
    pieces, and each shard is packed by :func:`best_fit`, so no task holds more than a shard. A bin holds at most one
    piece of a source and one of a duplicate cluster (``cluster``: any column over ``docs``).

    A text without words (null, empty) is a piece of size 0 and takes a place like others. Null sources are one source; a
    null cluster conflicts with none. Repeated rows are packed each; an empty table gives no rows; other columns
    are ignored.
    """
    importable(docs.sparkSession)
    keyed = docs.select("doc_id", "source", cluster.cast("string").alias("cluster"), word_count(F.col("text")).alias("words"))
    light = materialise(keyed.withColumn("row", F.monotonically_increasing_id()), "packing-sizes")
    shards = max(1, -(-light.count() // shard_rows))
    full = F.floor(F.col("words") / capacity)
    rest = light.where((F.col("words") % capacity > 0) | (F.col("words") == 0)).select(
        "doc_id", full.alias("piece"), (F.col("words") % capacity).alias("size"), (full * capacity).alias("start"), "source", "cluster", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row"
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable")
        sources = [x if isinstance(x, str) else None for x in rows["source"]]
        clusters = [x if isinstance(x, str) else (r,) for x, r in zip(rows["cluster"], rows["row"])]
        bins, offsets = best_fit(rows["size"].tolist(), sources, clusters, capacity)
        out = rows[["doc_id", "piece", "size", "start"]].copy()
        out["bin_id"], out["bin_offset"] = [f"{key[0]}-{b}" for b in bins], offsets
        return out

    schema = "doc_id long, piece long, size long, start long, bin_id string, bin_offset long"
    shared = rest.groupBy("shard").applyInPandas(run, schema)
    alone = light.where(full > 0).select("doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
    alone = alone.select("doc_id", "piece", F.lit(capacity).cast("long").alias("size"), (F.col("piece") * capacity).alias("start"), F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    return shared.unionByName(alone)


def content_cluster() -> Column:
    """Duplicate cluster of a row by its text in lower case, outer space removed; null for a null text."""
    return F.md5(F.lower(F.trim("text")))


def packed_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    """:func:`pack` with clusters of equal texts."""
    return pack(docs, content_cluster(), capacity)
