"""Near-duplicates, components and decontamination against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from helpers import DOCS, awkward, clashing

from pyspark.sql import functions as F

from nameshift.llm import components, decontamination, near_duplicates, queries


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    holders, links = defaultdict(list), []
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        links += [(i, j) for j, k in common.items() if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k)]
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), c) for i, c in roots(sets, links).items()}


def edited(n, seed=5):
    """A group of copies with zero to many edits around the threshold, and bystanders that share a passage."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        own = list(words)
        for _ in range(r.choice((0, 1, 2, 3, 4, 5, 6, 8))):
            own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(5000 + i, " ".join(words[:60] + [f"o{i}x{k}" for k in range(60)])) for i in range(n // 2)]
    return rows


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, size, percent):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()] + edited(120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


def template(n, own, seed=3):
    """Documents of 300 words of one template, of which each replaces the last ``own`` by words of its own."""
    words = [f"t{k}" for k in range(300)]
    return [(i, " ".join(words[: 300 - own] + [f"d{i}x{k}" for k in range(own)])) for i in range(n)]


def prefix_work(spark, rows, component, size=3, percent=85):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_duplicates.shingle_sets(docs, size)
    nodes = near_duplicates.sketches(docs, "doc_id", "text", size).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "s0", "s1", component.alias("component"))
    met = near_duplicates.prefix_rows(nodes, sets, percent)
    by = met.groupBy("shingle").agg(F.count(F.expr("CASE WHEN NOT main THEN 1 END")).alias("rest"), F.count("*").alias("all"))
    return by.agg(F.coalesce(F.sum(F.col("rest") * F.col("all")), F.lit(0))).first()[0]


def test_a_template_just_below_the_threshold_meets_nothing(spark):
    # 10 % of own words: similarity 0.81, 0.04 below the threshold
    assert [prefix_work(spark, template(n, 30), F.col("doc_id")) for n in (100, 300)] == [0, 0]


def test_one_component_with_outsiders_meets_in_proportion(spark):
    # 3 % of own words: every document is linked with every other; two stay outside the component
    small, large = (prefix_work(spark, template(n, 9), F.least(F.col("doc_id"), F.lit(2))) for n in (100, 300))
    assert 0 < large <= 3.1 * small


def test_links_of_mixed_sizes_equal_brute_force(spark):
    r = random.Random(11)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(150):
        cut = r.choice((0, 5, 12, 20, 30))
        own = base[: 200 - cut] + [f"v{r.randrange(12)}x{k}" for k in range(r.choice((0, 4, 9, 14, 18, 25)))]
        rows.append((i, " ".join(own)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 3, 85)
    # every document a component of its own: all links come from the prefixes
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_duplicates.shingle_sets(docs, 3)
    nodes = near_duplicates.sketches(docs, "doc_id", "text", 3).groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("s0").alias("s0"), F.first("s1").alias("s1")).drop("digest")
    nodes = nodes.withColumn("component", F.col("node"))
    found = {(x.a, x.b) for x in near_duplicates.confirm(near_duplicates.prefix_pairs(nodes, sets, 85), sets, 85).collect()}
    kept, sets_of = {x.node for x in nodes.collect()}, {i: shingles(t, 3) for i, t in rows}
    assert found == {(a, b) for a in kept for b in kept if a < b and 100 * len(sets_of[a] & sets_of[b]) >= 85 * len(sets_of[a] | sets_of[b])}


def test_near_duplicates_of_awkward_rows(spark):
    docs = clashing(awkward(spark))
    got = near_duplicates.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id == 1] == [(9, 1, True)] * 2
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.doc_id in (2, 3, 4))
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "zz yy"), (None, "a b c d e f g"), (3, "a b c d e f g"), (4, "zz yy"), (5, ""), (6, None)]
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS))
    kept = near_duplicates.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c d e f g"), (1, "a b c d e f g"), (2, "zz yy"), (5, ""), (6, "")]
    assert near_duplicates.deduplicated(docs.limit(0)).count() == 0


def test_connected_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (7, 8), (None, 3), (3, None), (301, 300), (300, 301)]
    got = dict(components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    clean = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == roots({n for link in clean for n in link}, clean)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact(docs, items, k=5, percent=80):
    def sets(rows, own=None):
        out = defaultdict(set)
        for i, t in rows:
            w = (t or "").lower().split()
            for size in ([own] if own else [min(k, len(w))] if w else []):
                out[i] |= {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
        return out

    by_size = {n: sets(docs, n) for n in range(1, k + 1)}
    found = []
    for item, own in sets(items).items():
        for doc, all_of in by_size[len(next(iter(own)))].items():
            if 100 * len(own & all_of) >= percent * len(own):
                found.append((doc, item, len(own), len(own & all_of)))
    return sorted(found)


def test_decontamination_equals_brute_force(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    words = items[0][1].split()
    docs += [(9000, "before " * 3000 + items[1][1].upper() + " after" * 3000), (9001, " ".join(words[: len(words) * 9 // 10])), (9002, " ".join(words[: len(words) // 2])), (9003, None), (9004, "short item"), (9004, "short item"), (9005, "a short item here")]
    items += [(900, "Short  item"), (901, "short"), (902, None), (903, " "), (904, items[2][1])]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS)
    got = decontamination.contaminated(clashing(frame), spark.createDataFrame(items, "item_id long, text string"))
    want = exact(docs, items)
    assert sorted(map(tuple, got.collect())) == want
    left = decontamination.remove_contaminated(clashing(frame), spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == clashing(frame).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in docs if i not in {w[0] for w in want})


def test_decontamination_of_awkward_rows(spark):
    items = spark.createDataFrame([(1, "a document without a key"), (None, "quick brown fox jumps over"), (2, "over the lazy dog The quick")], "item_id long, text string")
    docs = clashing(awkward(spark))
    assert [tuple(r) for r in decontamination.contaminated(docs, items).collect()] == [(1, 2, 2, 2)]
    more = docs.unionByName(docs.where("doc_id IS NULL").withColumn("text", F.lit("another document without one")))
    left = decontamination.remove_contaminated(more, items).where("doc_id IS NULL").collect()
    assert [r.text for r in left] == ["another document without one"]
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_runs_no_python(spark, folder):
    text = queries.QUERIES["op1_decontamination"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Arrow", "CartesianProduct", "NestedLoop"))
