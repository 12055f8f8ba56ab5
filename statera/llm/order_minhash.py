"""Order MinHash fingerprints of texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statera.llm.common import ordered_blocks, partitions, text_or_empty

#: Bits of a packed value that hold a k-mer's position; the others hold its hash.
POSITION_BITS = 31
POSITION_MASK = (1 << POSITION_BITS) - 1
#: Leading bits of a text's hash by which the rows of a frequent id are dealt.
HOT_BITS = 6


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, POSITION_BITS)


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = 5, bin_bits: int = 6, chosen: int = 2) -> DataFrame:
    """``df`` with the column ``out``: the Order MinHash signature of the column ``text`` as an array of ints.

    Words of a text give k-mers of ``k`` words (a shorter text is one k-mer). A k-mer's occurrences in the text are numbered, and
    (k-mer, number) is hashed once; the hash's leading ``bin_bits`` bits choose one of the signature's bins, as in one-permutation
    hashing. Of each bin the ``chosen`` smallest hashes are kept, put back in text order and hashed as a tuple with the bin. Entries
    are bin * 2^24 + tuple hash, in order of bins; bins without k-mers have no entry, a text without words has none at all.

    Each step is a projection of its own and names the array before it more than once, so the optimizer doesn't copy a
    step into the lambda of the next. All work stays within the row.
    """
    words, packed, starts, keyed, picked, firsts = (f"__omh_{x}" for x in ("words", "packed", "starts", "keyed", "picked", "firsts"))
    shift, bins = 64 - bin_bits, 1 << bin_bits
    tokens = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(words, F.transform(tokens, lambda x: F.xxhash64(x)))
    # hash of the k words from i on, with i in the low bits: sorting brings equal k-mers together, in text order
    last = F.greatest(F.size(words) - k, F.lit(0))
    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    kmer = lambda i: F.shiftleft(F.xxhash64(*(F.get(words, i + j) for j in range(k))), POSITION_BITS).bitwiseOR(i.cast("long"))
    df = df.withColumn(packed, F.sort_array(F.transform(places, kmer))).drop(words)
    new_run = lambda x, j: (j == 0) | (_high(x) != _high(F.get(packed, j - 1)))
    at = F.transform(packed, lambda x, j: F.when(new_run(x, j), j))
    df = df.withColumn(starts, F.filter(at, lambda j: j.isNotNull()))
    run = lambda j, r: F.slice(packed, j + 1, F.coalesce(F.get(starts, r + 1), F.size(packed)) - j)
    number = lambda x, n: F.shiftleft(F.xxhash64(_high(x), n), POSITION_BITS).bitwiseOR(x.bitwiseAND(F.lit(POSITION_MASK).cast("long")))
    df = df.withColumn(keyed, F.sort_array(F.flatten(F.transform(starts, lambda j, r: F.transform(run(j, r), number))))).drop(packed, starts)
    bin_of = lambda x: F.shiftrightunsigned(x, shift)
    df = df.withColumn(picked, F.filter(keyed, lambda x, j: (j < chosen) | (bin_of(x) != bin_of(F.get(keyed, j - chosen))))).drop(keyed)
    first = F.transform(picked, lambda x, j: F.when((j == 0) | (bin_of(x) != bin_of(F.get(picked, j - 1))), j))
    df = df.withColumn(firsts, F.filter(first, lambda j: j.isNotNull()))
    group = lambda j, r: F.slice(picked, j + 1, F.coalesce(F.get(firsts, r + 1), F.size(picked)) - j)
    ordered = lambda g: F.sort_array(F.transform(g, lambda x: F.shiftleft(x.bitwiseAND(F.lit(POSITION_MASK).cast("long")), 32).bitwiseOR(F.shiftrightunsigned(x, 32))))
    tuple_hash = lambda g: F.xxhash64(F.transform(ordered(g), lambda y: y.bitwiseAND(F.lit(0xFFFFFFFF))))
    entry = lambda j, r: (bin_of(F.get(picked, j)) * (1 << 24) + tuple_hash(group(j, r)).bitwiseAND(F.lit(0xFFFFFF).cast("long"))).cast("int")
    assert bins <= 64, "an entry is an int"
    return df.withColumn(out, F.transform(firsts, entry)).drop(picked, firsts)


def likeness(a: str, b: str) -> Column:
    """Share of the bins used by either signature in which both have the same entry; 1.0 if neither has any."""
    bins = lambda c: F.transform(c, lambda e: F.shiftright(e, 24))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def as_text(signature: str) -> Column:
    """Eight lowercase hex digits for each entry: two for the bin, six for the tuple."""
    return F.lower(F.array_join(F.transform(signature, lambda e: F.lpad(F.hex(e), 8, "0")), ""))


def with_next(docs: DataFrame, order: str, carry: list[str]) -> DataFrame:
    """``docs`` with next_<c> for c in ``carry``: its value in the row that follows by falling ``order``, after the last the first.

    Nulls come last, ties go by a hash of the first carried column, then by that. Rows are dealt once, by ranges of ``order``; the first row
    of each range also goes to the range before it, so no window spans the table. A value that more rows have than a range is to hold is
    dealt by leading bits of the hash; rows equal in ``order`` and the first carried column stay together.
    """
    n = 4 * partitions(docs.sparkSession)
    most = max(1, docs.count() // n)
    hot = [r[0] for r in docs.groupBy(order).agg(F.count("*").alias("n")).where(F.col("n") > most).select(order).collect()]  # at most n, as each has over 1 / n of the rows
    tie, value, some = F.xxhash64(carry[0]), F.col(order), sorted(x for x in hot if x is not None)
    is_hot, below = F.lit(False), F.lit(0)
    if some:
        # ranges rise with ``order``: what lies between two hot values is a range of its own, and so is each class of a hot value
        is_hot = F.coalesce(value.isin(some), F.lit(False))
        below = F.coalesce(F.size(F.filter(F.array(*map(F.lit, some)), lambda x: x <= value)), F.lit(0))
    if None in hot:
        is_hot = is_hot | value.isNull()
    between = F.when(value.isNull(), 0).otherwise(1) if None in hot else F.lit(1)
    block = F.struct(ordered_blocks(docs, order, n).alias("range"), between.alias("known"), below.alias("below"), F.when(is_hot, 0).otherwise(1).alias("rest"), F.when(is_hot, F.shiftright(tie, 64 - HOT_BITS)).otherwise(0).alias("class"))
    ranged = docs.withColumns({"__block": block, "__hot": is_hot})
    tops = ranged.groupBy("__block").agg(F.max(order).alias("__top"), (F.max(F.when(F.col("__hot"), tie)) if hot else F.lit(None).cast("long")).alias("__first"))
    few = W.orderBy("__block")  # a row for each range
    above = F.coalesce(F.lead("__block").over(few), F.first("__block").over(few))
    tops = tops.select("__block", "__top", "__first", above.alias("__to"))
    place = lambda b, g: F.struct(b.alias("block"), F.lit(g).alias("ghost"))
    own = F.array(place(F.col("__block"), 0))
    leads = value.eqNullSafe(F.col("__top")) & (~F.col("__hot") | (tie == F.col("__first")))
    copies = F.when(leads, F.concat(own, F.array(place(F.col("__to"), 1)))).otherwise(own)
    dealt = ranged.join(F.broadcast(tops), "__block").withColumn("__at", F.explode(copies))
    window = W.partitionBy("__at.block").orderBy("__at.ghost", value.desc_nulls_last(), tie.desc(), carry[0])
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(window) for c in carry}).where("__at.ghost = 0")
    return out.drop("__block", "__hot", "__top", "__first", "__to", "__at")


def edit_report(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row (doc_id, text).

    The edited text is the text with its last third (whole code points, rounded down) replaced by as many from the start of the next
    document in falling doc_id order; a shorter next document gives all it has. Null texts are empty; an empty text has no entries
    and is like another empty one (1.0). Null ids come last in that order, rows equal in id follow by a hash of their text, then by text; repeated
    rows give a row each; an empty table gives none; other columns are ignored.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "own", k), "doc_id", ["text", "own"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_fingerprint(rows, "edited", "other", k)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next_own").alias("near_next")
    )
