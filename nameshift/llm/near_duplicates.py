"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets.

Method: two collections of ``SUBKEYS`` hashes of ``WIDTH`` MinHash values each. A table key combines one hash of
either collection, so SUBKEYS**2 tables cost 2 * SUBKEYS * WIDTH MinHash values. Two documents can only share a
combined key if they share both parts: keys are combined only from parts that another document has too.

Texts with equal shingle sets form one class, and only its smallest document goes on. Shingles that no other member of
any bucket has bound a member's similarity to all others: s shared and u own shingles allow at most s / (s + u). In every
bucket of a shared key, members are compared with the one that has the smallest share of own shingles (in a group of edited
copies, what they were copied from), and linked members form components. What is left are the members of buckets that hold
several components. Of these, pairs from different components are compared that share one of their rarest shingles at a place
that still allows a link (prefix and position filter): this finds all links among them without going through a group's pairs.
A shingle that leaves its holder too little room even for its smallest possible partner is not sent, and holders in a shingle's
most frequent component don't meet each other, so a template's documents just below the threshold give no rows to meet.
Candidates are confirmed on the whole sets. A pair at the threshold 0.85 shares no bucket with probability
2 * (1 - 0.85**3)**16, that is 5e-7 (2e-5 at 0.8), and differs too much in its sketch with probability 3e-7.

Shingles are compared by 64-bit hashes of all their words.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing. A text with
fewer words than a shingle has one shingle, the whole sequence. Repeated rows are copies of each other. A row with a
null key is linked with nothing and kept. Rows that share a key but not a text each go with their own text. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from nameshift.llm.buffers import hash_spans, lower_ascii, mix, words
from nameshift.llm.components import connected_components
from nameshift.llm.frames import longs, map_text
from nameshift.session import stage

SUBKEYS, WIDTH = 16, 3
SKETCH_BITS = 128
#: Standard deviations below the expected agreement of sketches at the threshold that still go to the full check.
SKETCH_SIGMAS = 5.0

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MINHASHES = max(2 * SUBKEYS * WIDTH, SKETCH_BITS)
_FACTORS = mix(np.arange(1, _MINHASHES + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
_MASKS = mix(np.arange(1, _MINHASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_hashes(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """For every row the sorted distinct hashes of its shingles of ``size`` words, A-Z in lower case."""
    data = lower_ascii(data)
    starts, ends, rows = words(data, offs)
    each = hash_spans(data, starts, ends - starts)
    n = len(each)
    joined = each.copy()
    for k in range(1, size):
        if n > k:
            joined[: n - k] = mix(joined[: n - k] * _ODD + np.uint64(k)) ^ each[k:]
    joined = mix(joined)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            h = each[a : a + 1].copy()
            for k in range(1, b - a):
                h = mix(h * _ODD + np.uint64(k)) ^ each[a + k]
            out.append(mix(h ^ np.uint64(b - a)))
        else:
            out.append(each[:0])
    return out


def minhashes(shingles: np.ndarray) -> np.ndarray:
    low = np.full(_MINHASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[None, i : i + 2048] ^ _MASKS[:, None]
        part *= _FACTORS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def subkeys(low: np.ndarray) -> np.ndarray:
    """The hashes of the first collection, then of the second."""
    groups = low[: 2 * SUBKEYS * WIDTH].reshape(2 * SUBKEYS, WIDTH)
    key = np.zeros(2 * SUBKEYS, np.uint64)
    for k in range(WIDTH):
        key = mix(key * _ODD + groups[:, k])
    return key


def sketch_bits(low: np.ndarray) -> np.ndarray:
    bits = (mix(low[:SKETCH_BITS]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, a 128-bit ``digest`` of the set, the ``parts`` of its table keys, and its sketch."""

    def make():
        def function(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            sets = shingle_hashes(data, offs, size)
            lows = [minhashes(s) for s in sets]
            parts = np.concatenate([subkeys(x) for x in lows]).view(np.int64)
            bits = np.array([sketch_bits(x) for x in lows]).reshape(-1, SKETCH_BITS // 64)
            return [
                longs(np.array([len(s) for s in sets])),
                pa.array([set_digest(s) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * 2 * SUBKEYS, pa.array(parts)),
                longs(bits[:, 0]),
                longs(bits[:, 1]),
            ]

        return function

    fields = [StructField("n_shingles", LongType()), StructField("digest", BinaryType()), StructField("parts", ArrayType(LongType())), StructField("s0", LongType()), StructField("s1", LongType())]
    return map_text(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", make, fields, ["doc_id"])


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``digest`` and ``shingles``, its set."""

    def make():
        def function(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
            sets = shingle_hashes(data, offs, size)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            digests = [set_digest(x) for x in sets]
            return [pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))]

        return function

    return map_text(docs, "text", make, [StructField("digest", BinaryType()), StructField("shingles", ArrayType(LongType()))], ["doc_id"])


def shared(rows: DataFrame, *by: str) -> DataFrame:
    """The rows whose key another row has too. Counts are pre-aggregated; the join's hot keys can be split."""
    return rows.join(rows.groupBy(*by).count().where("count > 1").drop("count"), list(by))


def table_keys(classes: DataFrame) -> DataFrame:
    """``bucket`` and ``node`` of every combined key that at least two classes share."""
    parts = shared(classes.select(F.col("node"), F.posexplode("parts").alias("p", "part")), "p", "part")
    own = parts.groupBy("node").agg(F.collect_list(F.struct("p", "part")).alias("parts"))
    first, second = F.filter("parts", lambda x: x["p"] < SUBKEYS), F.filter("parts", lambda x: x["p"] >= SUBKEYS)
    combined = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["p"], x["part"], y["p"], y["part"]))))
    return shared(own.select("node", F.explode(combined).alias("bucket")), "bucket")


def similar(x: str, y: str, percent: int) -> Column:
    """What a linked pair meets: exact bounds from sizes and own shingles, and a sketch (all but 3e-7 of such pairs)."""
    c = lambda side, name: F.col(f"{side}.{name}")
    p = (1 + percent / 100) / 2
    least = int(SKETCH_BITS * p - SKETCH_SIGMAS * (SKETCH_BITS * p * (1 - p)) ** 0.5)
    differ = F.bit_count(c(x, "s0").bitwiseXOR(c(y, "s0"))) + F.bit_count(c(x, "s1").bitwiseXOR(c(y, "s1")))
    common = [c(side, "n") - c(side, "own") for side in (x, y)]
    sizes = 100 * F.least(c(x, "n"), c(y, "n")) >= percent * F.greatest(c(x, "n"), c(y, "n"))
    owns = 100 * F.least(*common) >= percent * (c(x, "own") + c(y, "own") + F.greatest(*common))
    return sizes & owns & (differ <= SKETCH_BITS - least)


def own_shingles(sets: DataFrame) -> DataFrame:
    """``node`` and ``own``, how many of its shingles no other node has; nodes without any are left out."""
    each = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    single = each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("doc_id").alias("node")).where("c = 1")
    return single.groupBy("node").agg(F.count("*").alias("own"))


def star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each bucket's members with its centre, the member with the smallest share of own shingles."""
    columns = ("node", "n", "own", "s0", "s1")
    order = F.floor(1000 * F.col("own") / F.col("n")).alias("o")
    centre = members.select("bucket", order, *columns).groupBy("bucket").agg(F.min(F.struct("o", *columns)).alias("c")).select("bucket", *[f"c.{x}" for x in columns])
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") != F.col("y.node")) & similar("x", "y", percent)
    return centre.alias("x").join(members.alias("y"), meet).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def size_band(percent: int) -> Column:
    """Sizes in bands as wide as the threshold: a linked pair lies in one band or in two that adjoin."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(max(1.000001 * math.log(100 / percent), 1e-6)))


def prefix_rows(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``shingle``, what ``similar`` compares, ``room`` and ``main`` of the prefix shingles that a link may start with.

    A node's shingles are ordered by how many nodes have them. Of n shingles, n - ceil(t * n) + 1 stand in its prefix: linked
    nodes share one there. The first shared one leaves room for all the others behind it on either side, or there is no link.
    Shingles that only one node has come first and are not sent. A row goes if its room is too small even for the smallest
    holder of its shingle in reach of its size, or if all holders are of its own component. ``main`` marks the rows of the
    component that has most of a shingle's holders: they need not meet each other.
    """
    each = sets.select(F.col("doc_id").alias("node"), "shingles").join(nodes.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    common = shared_counts(each)
    ordered = each.join(common, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("rest"))
    n, alone = F.col("n"), F.col("n") - F.size("rest")
    length = n - F.floor((percent * n + 99) / 100) + 1 - alone
    first = ordered.join(nodes, "node").withColumn("alone", alone).withColumn("length", F.greatest(length, F.lit(0)).cast("int"))
    rows = first.where("length > 0").select("node", "n", "s0", "s1", "component", "alone", F.posexplode(F.slice("rest", F.lit(1), F.col("length"))).alias("at", "x"))
    rows = rows.select("node", "n", "component", "s0", "s1", F.lit(0).alias("own"), F.col("x.shingle").alias("shingle"), (n - F.col("alone") - F.col("at")).alias("room"))
    # no partner is smaller than percent * n / 100: what lacks the room for that one needs no look at the other holders
    rows = stage(rows.where(100 * (100 + percent) * F.col("room") >= percent * (100 + percent) * n), "prefix-rows").withColumn("band", size_band(percent))
    sizes = rows.groupBy("shingle", "band").agg(F.min("n").alias("least")).groupBy("shingle").agg(F.collect_list(F.struct("band", "least")).alias("bands"))
    held = rows.groupBy("shingle", "component").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("components"))
    met = rows.join(held.where("components > 1"), "shingle").join(sizes, "shingle")
    near = F.array_min(F.transform(F.filter("bands", lambda x: F.abs(x["band"] - F.col("band")) <= 1), lambda x: x["least"]))
    fits = 100 * (100 + percent) * F.col("room") >= percent * (100 * n + F.greatest(100 * near, percent * n))
    main = F.col("component") == F.col("most.component")
    return met.where(fits).select("shingle", "node", "n", "component", "s0", "s1", "own", "room", main.alias("main"))


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``nodes`` from different components that may be linked: they share a row of ``prefix_rows``."""
    rows = stage(prefix_rows(nodes, sets, percent), "prefix-met")
    c = lambda side, name: F.col(f"{side}.{name}")
    room = (100 + percent) * F.least(c("x", "room"), c("y", "room")) >= percent * (c("x", "n") + c("y", "n"))
    once = c("y", "main") | (c("x", "node") < c("y", "node"))
    meet = (c("x", "shingle") == c("y", "shingle")) & once & (c("x", "component") != c("y", "component")) & room & similar("x", "y", percent)
    pairs = rows.where("NOT main").alias("x").join(rows.alias("y"), meet)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def shared_counts(each: DataFrame) -> DataFrame:
    return each.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    right = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Documents are linked where 100 * intersection >= ``percent`` * union of their shingle sets; a component's
    smallest document is kept.
    """
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    all_rows = stage(sketches(docs, "doc_id", "text", size), "sketches")
    filled = all_rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("parts", "s0", "s1")])
    classes = stage(classes, "classes")
    keys = stage(table_keys(classes), "keys")
    wanted = classes.join(keys.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("doc_id"), "digest")
    sets = shingle_sets(docs.join(keys.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), size)
    if not filled.groupBy("doc_id").count().where("count > 1").isEmpty():  # a key has several rows: one of the class's own
        sets = stage(sets, "raw-sets").join(wanted, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"])
    sets = stage(sets.drop("digest"), "sets")
    nodes = classes.select("node", "n", "s0", "s1").join(own_shingles(sets), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    able = nodes.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    members = stage(shared(keys.join(able, "node"), "bucket"), "members")
    found = stage(confirm(star_pairs(members, percent), sets, percent), "star-links")
    labels = stage(connected_components(found), "labels")
    now = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    left = stage(now.join(mixed, "bucket").drop("bucket", "own").distinct(), "mixed")
    more = stage(confirm(prefix_pairs(left, sets, percent), sets, percent), "prefix-links")
    labels = stage(connected_components(found.unionByName(more)), "labels")
    named = classes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    result = filled.select("doc_id", "n_shingles", "digest").join(named, "digest").select("doc_id", "n_shingles", "component_id")
    alone = all_rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the smallest document stays.

    Rows that share a key are one document: it goes if any of their texts belongs to a smaller document's component,
    else one of its rows stays, the one of the smallest text. Rows without a key stay.
    """
    found = near_duplicates(docs, key, text, size, percent)
    gone = stage(found.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    left = docs.join(gone, F.col(f"`{key}`").cast("long") == gone["__gone"], "left_anti")
    again = stage(docs.groupBy(F.col(f"`{key}`").alias("__again")).count().where("count > 1 AND __again IS NOT NULL").select("__again"), "again")
    if again.isEmpty():
        return left
    once = left.join(again, F.col(f"`{key}`") == again["__again"], "left_anti")
    many = left.join(again, F.col(f"`{key}`") == again["__again"], "left_semi")
    row = F.named_struct(F.lit("t"), F.col(f"`{text}`"), F.lit("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return once.unionByName(many.groupBy(F.col(f"`{key}`").alias("__again")).agg(F.min(row).alias("first")).select("first.row.*"))


#: ``near_duplicates`` of ``documents`` with shingles of three words and 85 per cent.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                  ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END) AS shingle FROM d),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
     l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
     m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id,
       coalesce(m.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
