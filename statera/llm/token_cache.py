"""Token counts through a digest cache: each distinct text is encoded once for each tokenizer version."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm.common import importable, listed, materialise, publish, text_or_empty

#: Texts that are encoded at once: their ids are Python lists.
AT_ONCE = 64


@lru_cache(2)
def encoder(path: str):
    """A function from texts to token counts. Libraries by file: sentencepiece for .model, tokenizers for .json."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def version_of(path: str) -> str:
    """Digest of the tokenizer: its file, and the library that reads it with the library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library.__name__} {library.__version__}".encode()).hexdigest()


class TokenCache:
    """Counts by (tokenizer version, content digest) in Parquet tables below ``path``, which only grow.

    Each append is a folder ``version=<v>/run=<id>`` that appears whole by one rename, so any number of writers may append at once.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizer: str) -> None:
        self.spark, self.path, self.tokenizer, self.version = spark, path, tokenizer, version_of(tokenizer)
        self.runs = f"{path}/version={self.version}"

    def stored(self) -> DataFrame | None:
        """(digest, n_tokens) of this tokenizer version, one row for each digest, or None before the first append.

        Two writers that miss a digest at once both append it, with the same count; one of the rows counts.
        """
        if not any(n.startswith("run=") for n in listed(self.spark, self.runs)):
            return None
        found = self.spark.read.schema("digest binary, n_tokens long").parquet(f"{self.runs}/run=*")
        return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def add_misses(self, contents: DataFrame) -> None:
        """Encode the distinct contents (digest, text) that are not stored and append their counts.

        Texts are shuffled only where their digests are missing; without misses nothing is written.
        """
        importable(self.spark)
        stored, path = self.stored(), self.tokenizer
        if stored is not None:
            missing = materialise(contents.select("digest").distinct().join(stored, "digest", "left_anti"), "token-misses")
            if missing.isEmpty():
                return
            contents = contents.join(missing, "digest", "left_semi")
        misses = contents.groupBy("digest").agg(F.first("text").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = encoder(path)
            for b in batches:
                for start in range(0, b.num_rows, AT_ONCE):
                    part = b.slice(start, AT_ONCE)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

        counted = misses.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")
        publish(self.spark, f"{self.runs}/run={uuid.uuid4().hex}", counted.write.parquet)


def token_counts(docs: DataFrame, cache: TokenCache, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text).

    The digest is the SHA-256 of the content as the tokenizer gets it: null is the empty text, nothing else is changed, as
    any other folding could change a count. Equal texts are encoded once at most, also across calls with one cache.
    No tokens are added, cut or padded. Null ids and repeated rows give a row each; an empty table gives none; other columns
    are ignored.
    """
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    cache.add_misses(keyed.select("digest", "text"))
    counts = cache.stored()
    sizes = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
