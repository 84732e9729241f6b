"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment.

Method (containment MinHash): the MinHash shingle of an item under one permutation lies in a document with probability
|item & document| / |item|, however long the document is. Each item keeps its MinHash shingles under ``PERMUTATIONS``
permutations, and the share of them found in a document estimates containment. Items and documents are partitioned by size
(powers of two of their shingles), and the partition is part of the join's key: the MinHash shingles of an item stand in every partition of
documents that it fits into. Each partition of items needs its own number of hits: of a few shingles so many must be shared that
small items are only found whole. Candidates are verified on the words of all shingles.

A pair at the threshold is no candidate with probability below ``MISS``. Only DataFrame functions are used. Words are
runs between ASCII white space, in lower case; a shingle is five words. An item of fewer words is one shingle, its
whole sequence.

Defined results: null, empty or wordless texts and items match nothing. Rows without a key are not reported. Rows that
share a key are one document (or item) with the shingles of all of them, so repeated rows change nothing. Empty tables
give an empty result. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from nameshift.session import stage

WORDS = 5
CONTAINMENT = 80
PERMUTATIONS = 32
MISS = 1e-9
#: Signatures or shingles of items are broadcast up to so many rows (about 100 MB); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
_BLANKS = " \t\n\x0b\f\r"


def words(text: str) -> Column:
    """The words of a column; one empty word if there are none."""
    return F.split(F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_BLANKS)), "[ \\t-\\r]+")


def places(size: Column, k: int) -> Column:
    return F.when(size >= k, F.sequence(F.lit(0), size - k)).otherwise(F.array().cast("array<int>"))


#: Sizes beyond 2**62 shingles do not occur.
CLASSES = 63


def least_share(percent: int, size: int) -> float:
    """The least containment of at least ``percent`` that an item of ``2**size`` to ``2**(size+1) - 1`` shingles can have."""
    if size > 12:
        return percent / 100
    return min(-(-percent * q // 100) / q for q in range(1 << size, 2 << size))


def needed_hits(percent: int, size: int) -> int:
    """The largest number of hits that a pair at the threshold misses with probability ``MISS`` at most, for a partition of items."""
    p, below, hits = least_share(percent, size), 0.0, 0
    if p == 1:
        return PERMUTATIONS
    while (below := below + comb(PERMUTATIONS, hits) * p**hits * (1 - p) ** (PERMUTATIONS - hits)) <= MISS:
        hits += 1
    return max(hits, 1)


def size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def item_shingles(items: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """``item_id``, ``k`` (words in its shingles) and each distinct ``shingle`` of its words."""
    w = items.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("item_id"), words(text).alias("w")).where(F.col("w")[0] != "")
    w = w.withColumn("k", F.least(F.lit(k), F.size("w")))
    each = w.select("item_id", "k", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("i"))
    return each.select("item_id", "k", F.slice("w", F.col("i") + 1, F.col("k")).alias("shingle")).distinct()


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def signatures(shingles: DataFrame) -> DataFrame:
    """``item_id``, ``k``, ``q`` (its size), and its MinHash shingles ``h`` with the number of permutations ``hits``."""
    hashed = shingles.select("item_id", "k", F.xxhash64("k", F.array_join("shingle", " ")).alias("h"))
    q = hashed.groupBy("item_id").agg(F.count("*").alias("q"))
    low = hashed.select("*", F.explode(F.sequence(F.lit(1), F.lit(PERMUTATIONS))).alias("seed")).groupBy("item_id", "k", "seed").agg(F.min(F.struct(F.xxhash64("seed", "h"), "h")).alias("m"))
    return low.groupBy("item_id", "k", F.col("m.h").alias("h")).agg(F.count("*").alias("hits")).join(q, "item_id")


def candidates(docs: DataFrame, signed: DataFrame, rows: int, size_classes: int, k: int, percent: int) -> DataFrame:
    """Pairs ``doc_id``, ``item_id`` with enough hits, for items whose shingles have ``k`` words.

    ``rows`` bounds the MinHash shingles, ``size_classes`` is the last partition of documents.
    """
    split = docs.select("doc_id", words("text").alias("w"))
    each = split.select("doc_id", "w", F.explode(places(F.size("w"), k)).alias("i"))
    hashed = each.select("doc_id", size_class(F.size("w") - (k - 1)).alias("partition"), F.xxhash64(F.lit(k), F.concat_ws(" ", *[F.col("w")[F.col("i") + j] for j in range(k)])).alias("h"))
    least = F.ceil(F.col("q") * percent / 100)  # a document holds at least so many shingles
    fits = signed.where(F.col("k") == k).withColumn("partition", F.explode(F.sequence(size_class(least), F.lit(size_classes))))
    own = fits.select("item_id", "q", "h", "hits", "partition")
    found = hashed.join(sized(own, rows * (size_classes + 1)), ["partition", "h"]).select("doc_id", "item_id", "q", "h", "hits").distinct()
    needed = F.element_at(F.array(*[F.lit(needed_hits(percent, c)) for c in range(CLASSES)]), size_class(F.col("q")) + 1)
    return found.groupBy("doc_id", "item_id").agg(F.sum("hits").alias("hits"), F.first("q").alias("q")).where(F.col("hits") >= needed).select("doc_id", "item_id")


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = WORDS, percent: int = CONTAINMENT
) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_item_shingles`` and ``n_shared`` for every item with at least ``percent`` of its shingles in a document."""
    docs = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    shingles = stage(item_shingles(items, item_key, item_text, k), "item-shingles")
    signed = stage(signatures(shingles), "signatures")
    sizes = sorted(r["k"] for r in shingles.select("k").distinct().collect())  # at most k values
    rows = shingles.count()
    if not sizes:
        return docs.limit(0).select("doc_id", F.lit(None).cast(items.schema[item_key].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_item_shingles"), F.lit(0).cast("long").alias("n_shared"))
    longest = docs.agg(F.max(F.size(words("text")))).first()[0]
    last = int(longest or 1).bit_length()
    hit = stage(reduce(DataFrame.unionByName, [candidates(docs, signed, rows, last, n, percent) for n in sizes]), "candidates")
    few = docs.join(hit.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words("text").alias("w"))
    every = reduce(DataFrame.unionByName, [few.select("doc_id", "w", F.explode(places(F.size("w"), n)).alias("i")).select("doc_id", F.slice("w", F.col("i") + 1, F.lit(n)).alias("shingle")) for n in sizes])
    shared = every.join(sized(shingles.select("item_id", "shingle"), rows), "shingle").select("doc_id", "item_id", "shingle").distinct()
    counts = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared")).join(hit, ["doc_id", "item_id"], "left_semi")
    sizes_of = shingles.groupBy("item_id").agg(F.count("*").alias("n_item_shingles"))
    return counts.join(sizes_of, "item_id").where(100 * F.col("n_shared") >= percent * F.col("n_item_shingles")).select("doc_id", "item_id", "n_item_shingles", "n_shared")


def remove_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that hold a benchmark item. Rows without a key are judged by their text alone."""
    own = F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.sha2(F.col(f"`{text}`"), 256), F.lit(""))
    named = docs.select(own.alias("doc_id"), F.col(f"`{text}`").alias("text"))
    hit = stage(contaminated(named, items, **options).select(F.col("doc_id").alias("__hit")).distinct(), "contaminated")
    return docs.join(hit, own == hit["__hit"], "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') if x <> ''] AS w
           FROM documents WHERE doc_id IS NOT NULL),
     b AS (SELECT item_id, w, least(5, len(w)) AS k
           FROM (SELECT item_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') if x <> ''] AS w
                 FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
     s AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS shingle
           FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
     n AS (SELECT item_id, count(*) AS n_item_shingles FROM s GROUP BY item_id),
     e AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS shingle
           FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i
                 FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k)),
     c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM e JOIN s USING (k, shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item_shingles, n_shared FROM c JOIN n USING (item_id)
WHERE 100 * n_shared >= 80 * n_item_shingles
"""
