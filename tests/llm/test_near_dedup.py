"""Near-dedup against all pairs on full sets, on each of its ways: hubs, small buckets, blocks, broadcast and shuffled."""

import random
from collections import Counter

import pytest

pytest.importorskip("bucketloom.llm")

from bucketloom.llm import common, near_dedup  # noqa: E402


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(text, k):
    w = lower(text).encode().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def components_of(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    return sets, root


def crowd(seed):
    """Chains of texts that change word by word, copies of them, and unrelated texts that share a passage."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, shared = [], [r.choice(words) for _ in range(30)]
    for _ in range(3):
        text = [r.choice(words) for _ in range(70)]
        for _ in range(45):
            text = list(text)
            for _ in range(r.choice((0, 1, 1, 2, 6))):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append(" ".join(text))
    rows += [" ".join(shared + [r.choice(words) for _ in range(60)]) for _ in range(20)] + [None, "", "one", "one", "ONE two"]
    r.shuffle(rows)
    rows = [(i if i % 11 else None, t) for i, t in enumerate(rows)]
    return rows + [rows[5], rows[5], (None, rows[7][1]), (None, rows[7][1])]


def check(spark, rows, k=4, whole=False):
    sets, root = components_of(rows, k)
    low = {c: min((i for (i, _), x in zip(rows, root, strict=True) if x == c and i is not None), default=None) for c in set(root)}
    want = Counter((i, len(s), low[c]) for (i, _), s, c in zip(rows, sets, root, strict=True))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(4)
    got = near_dedup.grouped(df.select("doc_id", "text"), k).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    if not whole:
        return
    kept = near_dedup.kept_rows(df, k).collect()
    of = {}
    for (i, t), c in zip(rows, root, strict=True):
        of.setdefault((i, t), c)
    empty = [r for r in kept if not shingles(r.text, k)]
    assert Counter(of[(r.doc_id, r.text)] for r in kept if shingles(r.text, k)) == Counter(set(c for s, c in zip(sets, root, strict=True) if s))
    assert len(empty) == sum(not s for s in sets) and all(r.node == "x" for r in kept)


def test_on_hubs(spark):
    check(spark, crowd(1), whole=True)


def test_in_blocks_and_by_shuffles(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("BLOCK", 8), ("TURNS", (1,)), ("A_HUB", 4), ("BROADCAST_ROWS", 5)):
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(common, "LIGHT", 2)
    check(spark, crowd(2))


def test_pairs_in_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TURNS", ())
    check(spark, crowd(3)[:60])


def test_sets_that_share_a_name(spark, monkeypatch):
    rows = [(k, f"a b c d e f g {k}") for k in range(6)] + [(9, "a b c d e f g 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 7)], "node long, again long")
    apart = near_dedup.clashes(own)
    got = near_dedup._apart(own, apart).collect()
    assert len({r.node for r in got}) == 3 and [r.node for r in got if r.again == 7] == [2]
    assert near_dedup.clashes(near_dedup.sketches(df, 4).where("node is not null")) is None


def test_the_test_loses_no_similar_pair():
    """Of pairs with similarity 0.8 a share of MISS a batch at most is pruned."""
    import numpy as np

    g = np.random.default_rng(3)
    a = g.integers(0, 256, (20_000, near_dedup.BANDS * near_dedup.ROWS), dtype="uint8")
    b = np.where(g.random(a.shape) < 0.8, a, g.integers(0, 256, a.shape, dtype="uint8"))
    assert near_dedup.plausible(a, b).mean() > 0.999
    assert near_dedup.plausible(a, np.where(g.random(a.shape) < 0.4, a, b[::-1])).mean() < 0.01


def test_lookups_equal_joins(spark, monkeypatch):
    from pyspark.sql import functions as F

    left = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 3000, 2).select(F.col("id").alias("r"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, -1)], "r long, v long"))
    want = left.join(right, F.col("k") == F.col("r")).agg(F.count(F.lit(1)), F.sum("v"), F.sum("id")).first()
    for bound in (10**6, 10):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        assert common.lookup(left, "k", right, "r", 1501, "id").agg(F.count(F.lit(1)), F.sum("v"), F.sum("id")).first() == want
    listed = spark.range(0, 100).select(F.col("id").alias("x"))
    for bound in (10**6, 10):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        rows = spark.range(200).unionByName(spark.range(50)).withColumnRenamed("id", "y")
        assert common.drop_listed(rows, listed, ["x"], ["y"], F.col("x"), F.col("y")).count() == 100
        once = common.one_of_listed(rows, listed, ["x"], ["y"], F.col("x"), F.col("y"))
        assert once.columns == ["y"] and once.count() == 200


def test_ranks_are_gapless_with_a_hot_group(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "LEAST_NUMBERED", 20)
    df = spark.range(1000).select(F.when(F.col("id") < 600, F.lit("hot")).when(F.col("id") < 610, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), "id").repartition(5)
    got = common.group_ranks(df, "g", ["id"], "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r["rank"])
    assert len(got) == 1000 and all(sorted(x) == list(range(len(x))) for x in by.values())
    again = {r.id: r["rank"] for r in common.group_ranks(df.repartition(2), "g", ["id"], "rank").collect()}
    assert again == {r.id: r["rank"] for r in got}
    numbered, n = common.row_numbers(df, ["id"], "n")
    assert n == 1000 and sorted(r.n for r in numbered.collect()) == list(range(1000))
