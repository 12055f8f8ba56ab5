"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statera.llm.common import free_names, materialise, word_count

#: Hash classes in each size class: with the size classes, what a hot source's prefix sum is split by.
SALTS = 16


def size_class(size: Column) -> Column:
    """Sixteen classes to an octave, rising with size: the bit length and the four bits below the leading one."""
    bits = F.length(F.bin(size))
    low = F.greatest(bits - 5, F.lit(0))
    return (low * 16 + F.call_function("shiftright", size, low.cast("int"))).cast("int")


def salt_of(doc_id: Column) -> Column:
    """0 to SALTS - 1 from the MD5 of the id's digits; a null id counts as empty."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int") % SALTS).cast("int")


def offset_of(source: Column, seed: str) -> Column:
    """The source's random offset in [0, 1), the same at every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target) for a table (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``cap`` times its source's size; what is over goes to the others by weight, until no target is above. Each round is an
    aggregate of the table of sources; only its totals reach the driver. A source without words has target 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    at = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int"))
    totals = materialise(totals.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap), "mix-sources")
    whole = totals.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = F.col("most") <= F.col("weight") * F.lit(level) if full >= 0 else F.lit(False)
        n, held, left = totals.agg(F.count_if(capped), F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == full or not left:
            break
        level, full = (whole - (held or 0)) / left, n
    return totals.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", prefix: str = "") -> DataFrame:
    """``docs`` (doc_id, text, source, any more) with the columns size, source_size, target, copies (names after ``prefix``).

    A document's expected copies are target / source_size of its source. Their prefix sum runs over the source's documents in
    the order of size class, hash class and doc_id, so neighbours are alike in size and taken words come near the target; after one
    random offset for each source, a document is emitted once for each integer that its part of the sum crosses. The prefix
    sum is a count within (source, size class, hash class) plus two levels of class counts, so a hot source is spread
    over many tasks. Size is the number of words; a null text has none. Null sources are a source of their own, null ids
    come first in their class; rows equal in source, id and size are interchangeable; an empty table gives no rows.
    """
    size, source_size, target, copies = (prefix + x for x in ("size", "source_size", "target", "copies"))
    own = free_names(docs, *(f"__mix_{x}" for x in ("class", "salt", "key", "n", "before", "ahead")))
    klass, salt, key, n, before, ahead = own
    names = F.col(key)
    keyed = docs.withColumns({size: word_count(F.col("text")), key: F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))})
    keyed = keyed.withColumns({klass: size_class(F.col(size)), salt: salt_of(F.col("doc_id"))})
    groups = materialise(keyed.groupBy(key, klass, salt).agg(F.count("*").alias(n), F.sum(size).alias(size)), "mix-groups")
    sums = groups.groupBy(F.when(names != "", F.substr(names, F.lit(2))).alias("source"), key).agg(F.sum(size).alias("size"))
    shares = source_targets(sums.select("source", "size"), weights, cap).select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target))
    earlier = lambda keys, by: F.coalesce(F.sum(n).over(W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = groups.groupBy(key, klass).agg(F.sum(n).alias(n)).withColumn(ahead, earlier([key], klass)).drop(n)
    inner = earlier([key, klass], salt)
    starts = groups.withColumn(before, inner).join(classes, [key, klass]).select(key, klass, salt, (F.col(before) + F.col(ahead)).alias(before)).join(shares, key)
    rank = F.row_number().over(W.partitionBy(key, klass, salt).orderBy(F.col("doc_id").asc_nulls_first(), size)) + F.col(before)
    ranked = keyed.join(starts, [key, klass, salt]).withColumn(ahead, rank.cast("long"))
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    shift = offset_of(F.when(F.col(key) != "", F.substr(F.col(key), F.lit(2))), seed)
    crossed = F.floor(rate * F.col(ahead) + shift) - F.floor(rate * (F.col(ahead) - 1) + shift)
    return ranked.withColumn(copies, crossed.cast("long")).drop(*own)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is emitted, with the columns of ``docs``."""
    prefix = "__mix_out_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    (time,) = free_names(docs, "__mix_time")
    counted, copies = with_copies(docs, weights, cap, seed, prefix), F.col(prefix + "copies")
    return counted.where(copies > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias(time)).drop(time)


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) for each row."""
    out = with_copies(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
