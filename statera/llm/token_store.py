"""Token ids in a content-addressed store: chunks cut by a rolling hash, recipes of documents, Merkle manifests."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from statera.llm.common import groups, importable, materialise, partitions, text_or_empty

#: Ids in a chunk: fewest, mean beyond that (a power of two), most. Ids that the rolling hash sees: a power of two.
FEWEST, MEAN, MOST, WINDOW = 256, 1024, 8192, 16
#: Children of a manifest node.
FANOUT = 4096
#: Bytes of texts that are encoded together, and pieces whose ids are put together at once: both bound a worker's memory.
BYTES_AT_ONCE, PIECES_AT_ONCE = 16 << 20, 1 << 20
#: A piece that is one word of letters, after a line feed or not, and punctuation. The letters end before the first that became one
#: in a later Unicode version than the library may have.
PIECE = r"^(?P<feed>\n?)(?P<word>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
#: White space but the space and the line feed, and the start of special tokens: a text with one of these, or with white space beside
#: white space or at its ends, is encoded in one call.
ODD = (*map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, 6158, *range(8192, 8204), 8232, 8233, 8239, 8287, 12288)), "<|", "  ", " \n", "\n ", "\n\n")


class Encoder:
    """Ids of texts as little-endian bytes, by the tokenizers library.

    A byte-level tokenizer starts a new pre-token at a space between two other characters and makes one of a line feed there, so
    pieces cut at both encode alone as they do in the text, each with the space or the line feed before it. Texts are cut together, and what
    repeats among them is encoded once: a piece of letters with punctuation after them is two pre-tokens, whose letters go to the
    tokenizer's model as they are; any other piece goes to the tokenizer. Nothing is kept between calls.
    """

    def __init__(self, path: str) -> None:
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.model = tokenizers.Tokenizer.from_file(path)
        self.dtype = "<u2" if self.model.get_vocab_size(True) <= 1 << 16 else "<u4"
        self.tokens_of = self.model.model.tokenize
        level = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # what the library makes of each byte, from characters that have them all
        chars = map(chr, (*range(0x800), *range(0x800, 0xD800, 0x800), 0xE000, 0xF000, *range(0x10000, 0x110000, 0x10000)))
        self.byte_chars = {b: x for c in chars for b, x in zip(c.encode(), level.pre_tokenize_str(c)[0][0])}

    def each(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, encoded whole. Without offsets, which is cheaper."""
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return np.array(self.each([text])[0], self.dtype).tobytes()

    def of_words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of words that are one pre-token each, by the library's model alone."""
        mapped = "\n".join(words).encode().decode("latin-1").translate(self.byte_chars).split(self.byte_chars[10]) if words else []
        return ([x.id for x in self.tokens_of(w)] for w in mapped)

    def encode(self, texts: list[str]) -> list[bytes]:
        cuttable = [bool(t) and t[0] not in " \n" and t[-1] not in " \n" and not any(map(t.__contains__, ODD)) for t in texts]
        out = [b"" if c else self.whole(t) for t, c in zip(texts, cuttable)]
        if any(cuttable):
            self._put(texts, [i for i, c in enumerate(cuttable) if c], out)
        return out

    def _put(self, texts: list[str], plain: list[int], out: list[bytes]) -> None:
        """Ids of the texts ``plain``, which can be cut, put together from those of their different units."""
        strings = lambda x: x.to_numpy(zero_copy_only=False).tolist()
        # a text begins like a line
        cut = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
        found = cut.values.dictionary_encode()
        pieces, at = found.dictionary, found.indices.to_numpy()
        part = pc.extract_regex(pieces, PIECE)
        fits, feed = part.is_valid(), pc.starts_with(pieces, "\n")
        words = pc.binary_join_element_wise(pc.if_else(feed, "", " ").cast(pa.large_string()), part.field(1), pa.scalar("", pa.large_string())).filter(fits).dictionary_encode()
        tails = part.field(2).filter(fits).dictionary_encode()
        others = [p[1:] if p[:1] == "\n" else " " + p for p in strings(pieces.filter(pc.invert(fits)))]
        # a piece is three units: the line feed or nothing, its word or all of it, its tail or nothing
        n_words, n_tails = len(words.dictionary), len(tails.dictionary)
        units = np.zeros((len(pieces), 3), np.int32)
        fit = fits.to_numpy(zero_copy_only=False)
        units[:, 0] = feed.to_numpy(zero_copy_only=False)
        units[fit, 1], units[fit, 2] = 2 + words.indices.to_numpy(), 2 + n_words + tails.indices.to_numpy()
        units[~fit, 1] = 2 + n_words + n_tails + np.arange(len(others))
        flat: list[int] = []
        ends = [0]
        for ids in chain(([], self.each(["\n"])[0]), self.of_words(strings(words.dictionary)), self.each(strings(tails.dictionary)), self.each(others)):
            flat += ids
            ends.append(len(flat))
        known, starts, sizes = np.array(flat, self.dtype), np.array(ends[:-1]), np.diff(ends)
        parts = []
        for low in range(0, len(at), PIECES_AT_ONCE):
            some = units[at[low : low + PIECES_AT_ONCE]].ravel()
            n = sizes[some]
            upto = np.cumsum(n)
            parts.append(known[np.repeat(starts[some] - upto + n, n) + np.arange(upto[-1])])
        width, raw = known.itemsize, np.concatenate(parts).tobytes()
        bounds = np.concatenate(([0], np.cumsum(sizes[units].sum(axis=1)[at])))[cut.offsets.to_numpy()] * width
        skip = width * int(sizes[1])
        for i, low, high in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist()):
            out[i] = raw[low + skip : high]

    def ids(self, text: str) -> bytes:
        return self.encode([text])[0]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of a document's chunks. A cut follows an id at which the hash of the last WINDOW ids is 0 modulo MEAN."""
    n = len(ids)
    if n <= FEWEST:
        return [n]
    h, step, factor = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1, 0x100000001B3
    h ^= h >> np.uint64(29)
    while step < WINDOW:  # doubles the window
        more = h[:-step] * np.uint64(factor)
        h[step:] += more
        step, factor = step * 2, factor * factor & 0xFFFFFFFFFFFFFFFF
    found, last = [], 0
    for c in (np.flatnonzero((h >> np.uint64(40)) & np.uint64(MEAN - 1) == 0) + 1).tolist() + [n]:
        while c - last > MOST:
            last += MOST
            found.append(last)
        if c - last >= FEWEST or c == n:
            found.append(c)
            last = c
    return found if found[-1] == n else [*found, n]


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree over digests; an odd last node moves up as it is."""
    level = list(digests)
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


@lru_cache(1 << 16)
def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes, by squaring."""
    out, square, bits = 1 << 31, 1 << 30, 8 * n_bytes
    while bits:
        if bits & 1:
            out = _times(square, out)
        square, bits = _times(square, square), bits >> 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a sequence of bytes from (CRC-32, length) of its parts."""
    crc = 0
    for own, n in parts:
        crc = _times(_shift(n), crc) ^ own
    return crc


#: Rows of parts/: chunks (1) with their digest as key, recipes (0) with their Merkle root as key.
PARTS = "chunk int, key binary, doc_id long, n int, ids binary, digests array<binary>"
#: Rows of a manifest level.
NODES = "node long, children int, hash string"


def _parts(spark: SparkSession, path: str, kind: int) -> DataFrame:
    """Chunks or recipes, from their folder alone; an empty table has neither folder."""
    return spark.read.schema(PARTS).parquet(f"{path}/parts").where(F.col("chunk") == kind).drop("chunk")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) and write the store at ``path``: parts/, recipes/ and manifest/.

    Each text (null: empty) gets ``end_id`` after its ids. parts/chunk=1: digest, bytes of an id, ids (little endian), once for each distinct
    chunk. recipes/: doc_id, start (ids before it in ascending doc_id order, null first), n_tokens, chunk digests, Merkle root,
    rank and block, in files of ascending doc_id. manifest/: a node for each FANOUT documents in that order, with the hash of
    their roots, and levels above up to one root. Texts are encoded once; chunk bytes are shuffled once, after the
    repeats within a task are gone. Repeated rows have a recipe each and share chunks; an empty table writes empty parts.
    """
    spark = docs.sparkSession
    importable(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = encoder(tokenizer), set()
        end = np.array([end_id], model.dtype).tobytes()
        width = len(end)
        for b in batches:
            for run in groups(b.column(1), BYTES_AT_ONCE):
                part, rows = b.slice(*run), []
                for doc, raw in zip(part.column(0).to_pylist(), model.encode(part.column(1).to_pylist())):
                    raw += end
                    at, own = 0, []
                    for to in cuts(np.frombuffer(raw, model.dtype)):
                        piece, at = raw[at * width : to * width], to
                        own.append(hashlib.blake2b(piece, digest_size=16).digest())
                        if own[-1] not in seen:
                            seen.add(own[-1])
                            rows.append((1, own[-1], None, width, piece, None))
                    rows.append((0, merkle(own), doc, len(raw) // width, None, own))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            keep = []
            for kind, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keep.append(kind == 0 or key not in seen)
                if kind:
                    seen.add(key)
            yield b.filter(pa.array(keep, pa.bool_()))

    names, kinds = ["chunk", "key", "doc_id", "n", "ids", "digests"], [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary())]
    cut_up = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, PARTS)
    # Chunks meet by digest. Recipes need not meet, so copies of a document are spread by its id.
    dealt = cut_up.repartition(partitions(spark), F.xxhash64("key", "doc_id")).mapInArrow(once, PARTS)
    dealt.write.option("compression", "zstd").partitionBy("chunk").parquet(f"{path}/parts")
    recipes = _parts(spark, path, 0).drop("ids").select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place"))
    # Ranges cut between rows of one id, or without one, and between equal rows too, which their place in the files tells apart.
    order = [F.col("doc_id").asc_nulls_first(), F.col("key"), F.col("place")]
    numbered = materialise(recipes.repartitionByRange(4 * partitions(spark), *order).withColumn("block", F.spark_partition_id()), "recipes")
    sums = numbered.groupBy("block").agg(F.sum("n").alias("ids"), F.count("*").alias("docs"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    sums = sums.select("block", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ids_before"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"))
    own = W.partitionBy("block").orderBy(*order)
    placed = numbered.join(F.broadcast(sums), "block").select(  # at most 4 rows for each shuffle partition
        "doc_id",
        (F.coalesce(F.sum("n").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("ids_before")).alias("start"),
        F.col("n").cast("long").alias("n_tokens"),
        "digests",
        F.col("key").alias("root"),
        (F.row_number().over(own) - 1 + F.col("docs_before")).alias("rank"),
        "block",
    )
    placed.repartitionByRange(partitions(spark), "block").sortWithinPartitions("block", "rank").write.option("compression", "zstd").parquet(f"{path}/recipes")
    level, children = 0, spark.read.parquet(f"{path}/recipes").select("rank", F.hex("root").alias("hash"))
    while True:
        node_hashes(children).write.parquet(f"{path}/manifest/level={level}")
        nodes = spark.read.schema(NODES).parquet(f"{path}/manifest/level={level}")
        if nodes.count() <= 1:
            break
        level, children = level + 1, nodes.select(F.col("node").alias("rank"), "hash")


def node_hashes(children: DataFrame) -> DataFrame:
    """(node, children, hash): SHA-256 of the hashes of FANOUT children (rank, hash) in order."""
    grouped = children.groupBy(F.floor(F.col("rank") / FANOUT).alias("node")).agg(F.array_sort(F.collect_list(F.struct("rank", "hash"))).alias("c"))
    return grouped.select("node", F.size("c").alias("children"), F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), ""), 256).alias("hash"))


def _proven(spark: SparkSession, path: str, recipes: DataFrame) -> DataFrame:
    """(node, leaf_ok) for each leaf of the manifest: whether its recipes' roots give its hash, and so on up to the one root."""
    levels = spark.read.schema(f"{NODES}, level int").parquet(f"{path}/manifest")
    top, last = levels.agg(F.max(F.struct("level", "node"))).first()[0] or (0, 0)
    out, children = None, recipes.select("rank", F.hex("root").alias("hash"))
    for level in range(top + 1):
        stored = levels.where(F.col("level") == level).drop("level")
        made = node_hashes(children).select("node", F.col("children").alias("made_children"), F.col("hash").alias("made"))
        same = F.coalesce((F.col("hash") == F.col("made")) & (F.col("children") == F.col("made_children")), F.lit(False))
        if level == top:
            same = same & F.lit(last == 0)  # else the root is lost
        own = made.join(stored, "node", "full_outer").select("node", same.alias("ok"))
        if out is None:
            out = own.select("node", F.col("node").alias("above"), F.col("ok").alias("leaf_ok"))
        else:
            out = out.withColumn("above", F.floor(F.col("above") / FANOUT)).join(own.withColumnRenamed("node", "above"), "above", "left")
            out = out.select("node", "above", (F.col("leaf_ok") & F.coalesce("ok", F.lit(False))).alias("leaf_ok"))
        children = stored.select(F.col("node").alias("rank"), "hash")
    return out.select("node", "leaf_ok")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, verified for each document, from the store's files.

    Each chunk's digest and CRC are computed from its bytes where it lies; only these are dealt to the recipes, and a document's
    CRC (over its ids as unsigned 32-bit little-endian integers) is put together from those of its chunks. ``verified``: all its
    chunks are there with their digests, these give the document's Merkle root, the roots give the hash of its manifest leaf, and the
    hashes of each level those of the level above, up to the one root. A document with a lost or changed chunk stays, with the recipe's
    n_tokens, a null CRC and not verified; a lost or changed recipe or manifest node makes the documents below its node unverified.
    """
    importable(spark)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, crc, n = [], [], []
            for width, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(raw, f"<u{width}")
                key.append(hashlib.blake2b(raw, digest_size=16).digest())
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(crc, pa.int64()), pa.array(n, pa.int32())], names=["digest", "crc", "ids"])

    @pandas_udf("crc long, n long, root binary")
    def whole(parts: pd.Series) -> pd.DataFrame:
        out = [(None, None, None) if any(x["crc"] < 0 for x in p) else (joined_crc([(x["crc"], 4 * x["ids"]) for x in p]), sum(x["ids"] for x in p), merkle([x["digest"] for x in p])) for p in parts]
        crc, n, root = zip(*out) if out else ((), (), ())
        return pd.DataFrame({"crc": pd.array(crc, "Int64"), "n": pd.array(n, "Int64"), "root": pd.Series(root, dtype=object)})

    chunks = _parts(spark, path, 1).select("n", "ids").mapInArrow(check, "digest binary, crc long, ids int").groupBy("digest").agg(F.first("crc").alias("crc"), F.first("ids").alias("ids"))
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("rank", F.posexplode("digests").alias("at", "digest")).join(chunks, "digest", "left").fillna({"crc": -1, "ids": 0})  # a lost chunk
    gathered = parts.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "crc", "ids"))).alias("parts"))
    read = gathered.select("rank", whole("parts").alias("w")).select("rank", "w.*")
    both = recipes.select("rank", "doc_id", "start", "n_tokens", "root", F.size("digests").alias("n_chunks")).join(read.withColumnRenamed("root", "read_root"), "rank")
    leaf = _proven(spark, path, recipes)
    fine = (F.col("root") == F.col("read_root")) & (F.col("n") == F.col("n_tokens")) & F.col("leaf_ok")
    return (
        both.withColumn("node", F.floor(F.col("rank") / FANOUT)).join(leaf, "node", "left")
        .select("doc_id", "start", F.coalesce("n", "n_tokens").alias("n_tokens"), F.col("crc").alias("ids_crc32"), "n_chunks", F.coalesce(fine, F.lit(False)).alias("verified"))
    )
