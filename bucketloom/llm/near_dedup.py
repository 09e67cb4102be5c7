"""MinHash near-dedup with sequential Bayesian verification.

A document is its set of distinct word shingles, hashed to 64 bits. Documents with one set are one node, named by a hash
of the set; a second hash of the set finds sets that share a name, which then get names of their own. Of each node the
signature (BANDS x ROWS minima) and band keys are computed in one pass; nodes that share a band key may be similar (at
similarity 0.8 all bands miss with probability 7e-6).

Candidates are pruned in turn, batch after batch of the signatures: with m equal minima of n the similarity is
Beta(m + 1, n - m + 1) distributed, and a pair goes once the chance of 0.8 or more is under MISS. The test sees one byte
of each minimum: unequal ones agree in 1 of 256 cases, which can only keep a pair longer. Survivors are compared on the
full sets; only that makes a link. The sets of nodes that share a band key are made once and kept in a table.

No bucket is expanded into all its pairs. In turns, every bucket that still holds nodes of several components names a
few of its nodes, hubs, and each node is compared with one hub of each other component. Dense groups collapse into their
component in a turn or two. What is left is compared exhaustively: pair by pair in buckets of SMALL nodes, and in blocks
of BLOCK by BLOCK nodes in larger ones, where signatures go first and only nodes with a surviving partner send their
sets, and where a block emits a spanning forest of its links. So every candidate pair is compared or already in one
component.

All pairs of a hub come to one task in the order (hub, node), a hub with many in several with a copy of it each; a task
holds one hub and one batch of rows. Short tables are broadcast under a counted bound, long ones joined with hot keys
salted. Links and components stay in tables.

Defined results: null and empty texts have empty sets and are alone; null ids count as larger than any id and are kept
only if no other id is in their component; repeated rows are in one component and are kept alike by the query, while
`kept_rows` leaves one row of a component, whatever repeats; an empty table gives no rows; extra columns are ignored by
the query and kept by `kept_rows`. Texts of any length are taken whole, signatures in slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketloom.llm.common import BROADCAST_ROWS, TEXTS_A_TASK, components, documents, drop_listed, filtered, lookup, one_of_listed, release_memory, skew_join, small_batches, stash

BANDS, ROWS = 30, 5
BATCH = 15
MISS = 1e-6
NUMERATOR, DENOMINATOR = 80, 100
HOT_SHARE = 1000
#: How many nodes a mixed bucket names in each turn before the exhaustive one.
TURNS = (1, 4)
SMALL = 48
BLOCK = 512
#: Pairs of one hub that a task gets with one copy of it.
A_HUB = 2000
#: Bytes of shingle sets in a block.
BLOCK_BYTES = 16_000_000
CACHED_WORDS = 100_000
RUN_BYTES = 2_000_000
#: Fixed value: the odd multiplier of Fibonacci hashing, 2**64 / golden ratio.
MIX = 0x9E3779B97F4A7C15


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def multipliers(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype="uint64") * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    from bucketloom.llm.near_dedup import _HASHES

    split = [(x or "").encode("utf-8", "surrogatepass").lower().split() for x in texts]
    n = np.fromiter(map(len, split), "int64", len(split))
    words = np.fromiter((h for ws in split for h in map(_HASHES.__getitem__, ws)), "uint64", int(n.sum()))
    ends = np.cumsum(n)
    out = []
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - k + 1), "uint64")
        for j in range(k):
            rolled = rolled * np.uint64(MIX) + words[j : j + len(rolled)]
        rolled = mixed(rolled + np.uint64(k))
        for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                one = np.uint64(b - a)
                for w in words[a:b]:
                    one = one * np.uint64(MIX) + w
                out.append(mixed(np.array([one + np.uint64(b - a)], "uint64") ^ np.uint64(0x5555)))
            else:
                out.append(words[:0])
    return out


def node_of(shingles: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), seed) - 2**63


def signature(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the set, high 32 bits; sets are taken in slices, so memory is bounded."""
    low = np.full(len(by), np.iinfo("uint64").max, "uint64")
    for at in range(0, len(shingles), 4096):
        np.minimum(low, (shingles[None, at : at + 4096] * by[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("uint32")


def text_runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of about RUN_BYTES of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + RUN_BYTES)))
        yield batch.slice(begin, end - begin)
        begin = end


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text) to doc_id, text_key, n_shingles, node, again, bands, sig; the last four are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = multipliers(BANDS * ROWS)
        weights = multipliers(ROWS, 11)
        for b in batches:
            for part in text_runs(b):
                sizes, nodes, again, keys, sigs = [], [], [], [], []
                for s in shingle_sets(part["text"].to_pylist(), k):
                    sizes.append(len(s))
                    if not len(s):
                        nodes.append(None), again.append(None), keys.append(None), sigs.append(None)
                        continue
                    sig = signature(s, by)
                    with np.errstate(over="ignore"):
                        band = mixed((sig.reshape(BANDS, ROWS).astype("uint64") * weights).sum(axis=1) * np.uint64(BANDS) + np.arange(BANDS, dtype="uint64"))
                    nodes.append(node_of(s)), again.append(node_of(s, 1)), keys.append(band.view("int64")), sigs.append(sig.astype("uint8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_key"], pa.array(sizes, "int64"), pa.array(nodes, "int64"), pa.array(again, "int64"), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, "binary")],
                    ["doc_id", "text_key", "n_shingles", "node", "again", "bands", "sig"],
                )
        _tidy()

    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, again bigint, bands array<bigint>, sig binary"
    )


def _tidy() -> None:
    from bucketloom.llm.near_dedup import _HASHES

    _HASHES.clear()
    release_memory()


def least_equal(n: int) -> int:
    """The fewest equal minima of n with which a similarity of 0.8 or more keeps a posterior chance of MISS."""
    t, total = NUMERATOR / DENOMINATOR, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= MISS:
            return m
    return n


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two signature matrices that survive the sequential test."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), "int64")
    for at in range(0, a.shape[1], BATCH):
        end = min(at + BATCH, a.shape[1])
        equal = equal + (a[alive, at:end] == b[alive, at:end]).sum(axis=1)
        keep = equal >= least_equal(end)
        alive, equal = alive[keep], equal[keep]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "uint8").reshape(-1, BANDS * ROWS)


def raw_sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in column]


def similar(hub: bytes, others: pa.Array) -> np.ndarray:
    """Which of the sets have the similarity with the hub's set."""
    x = np.frombuffer(hub, "<u8")
    out = np.zeros(len(others), bool)
    for at, y in enumerate(raw_sets(others)):
        both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
        out[at] = DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)
    return out


def alike(hub: bytes, others: pa.Array) -> np.ndarray:
    """Which signatures survive the sequential test with the hub's."""
    own = matrix(others.to_pylist())
    return plausible(np.broadcast_to(np.frombuffer(hub, "uint8"), own.shape), own)


def against_hubs(pairs: DataFrame, n: int, of: DataFrame, payload: str, test: Callable[[bytes, pa.Array], np.ndarray]) -> DataFrame:
    """Those of n pairs (a, b), a the hub, that pass a test on the payloads of their nodes; of has (node, payload).

    Each payload travels once for each pair that its node is the second of, and once for each A_HUB pairs of a hub."""
    hubs = stash(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / A_HUB).cast("int").alias("salts")).withColumnRenamed("a", "hub"), "hubs", rows=n)
    n_hubs = hubs.count()
    salted = lookup(pairs, "a", hubs, "hub", n_hubs, "b").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    held = of.select("node", payload)
    if n <= BROADCAST_ROWS:
        second = held.join(F.broadcast(salted), F.col("node") == F.col("b"))
    else:
        second = skew_join(salted, "b", "hub", held, "node")
    second = second.select("hub", "salt", F.lit(1).alias("role"), "node", payload)
    first = lookup(held, "node", hubs, "hub", n_hubs, "node").select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "node", payload)
    rows = first.unionByName(second).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, b""
        for b in batches:
            hub, role = b["hub"].to_numpy(), b["role"].to_numpy()
            a, kept = [], []
            edge = np.append(np.append(0, np.flatnonzero((np.diff(hub) != 0) | (np.diff(role) < 0)) + 1), len(hub))
            for at, to in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                firsts = int((role[at:to] == 0).sum())
                if firsts:
                    name, own = hub[at], b[payload][at].as_py()
                if at + firsts < to:
                    assert name == hub[at], "a hub comes before its pairs"
                    others = b[payload].slice(at + firsts, to - at - firsts)
                    found = np.flatnonzero(test(own, others)) + at + firsts
                    a += [name] * len(found)
                    kept += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, "int64"), b["node"].take(pa.array(kept, "int64"))], ["a", "b"])
        release_memory()

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of wanted (node, doc_id, text_key): the texts of one document a node are read again and shingled."""
    n = wanted.count()
    chosen = wanted.select(F.col("text_key").alias("w_key"), F.col("doc_id").alias("w_id")).distinct()
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    if n <= BROADCAST_ROWS:
        found = found.join(F.broadcast(chosen), (F.col("text_key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    else:  # one row a text before the join, made where copies meet in a task; keys are unique but for texts that share a hash
        keys = chosen.select("w_key").distinct()
        found = filtered(found, F.col("text_key"), keys, F.col("w_key"), n)
        found = found.groupBy("text_key", F.xxhash64(F.lit("again"), "text").alias("__bl_again")).agg(F.first("text").alias("text"))
        found = found.join(keys, F.col("text_key") == F.col("w_key"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # nodes of this task: rows can be repeated
        for b in batches:
            for part in text_runs(b):
                nodes, sets = [], []
                for s in shingle_sets(part["text"].to_pylist(), k):
                    if len(s) and (node := node_of(s)) not in done:
                        done.add(node)
                        nodes.append((node, node_of(s, 1))), sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in nodes], "int64"), pa.array([y for _, y in nodes], "int64"), pa.array(sets, "binary")], ["node", "again", "shingles"])
        _tidy()

    return stash(found.select("text").mapInArrow(shingle, "node bigint, again bigint, shingles binary"), "sets", rows=docs.count(), a_file=TEXTS_A_TASK)


def few_pairs(members: DataFrame) -> DataFrame:
    """All pairs with different labels of buckets of SMALL nodes or fewer: at most SMALL rows a member."""
    t = members.where(F.col("n") <= SMALL)
    other = t.select(F.col("key").alias("o_key"), F.col("node").alias("b"), F.col("label").alias("o_label"))
    both = t.join(other, (F.col("key") == F.col("o_key")) & (F.col("node") < F.col("b")) & (F.col("label") != F.col("o_label")))
    return both.select(F.col("node").alias("a"), "b").distinct()


def crowd_links(members: DataFrame, shared: DataFrame, sets: DataFrame, n_shared: int) -> DataFrame | None:
    """Links between components in buckets over SMALL nodes.

    A bucket of m nodes is cut into m / BLOCK blocks, or more if their sets are over BLOCK_BYTES. Each pair of blocks is
    first compared on signatures; nodes with a partner that survives, and no others, then send their sets to that pair
    of blocks, which emits a spanning forest of its links: fewer rows than it has nodes, whatever it compares."""
    large = stash(members.where(F.col("n") > SMALL).select("key", "node", "label"), "crowded")
    n_large = large.count()
    if not n_large:
        return None
    # few rows, much work: tasks by the number of blocks, not by the bytes that they read
    tasks = max(spread_tasks(large), n_large // BLOCK)
    facts = shared.select(F.col("node").alias("s_node"), "sig", "n_shingles")
    known = lookup(large, "node", facts.drop("sig"), "s_node", n_shared, "key")
    n = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")
    blocks = stash(known.groupBy("key").agg(n).withColumnRenamed("key", "b_key"), "blocks")
    dealt = skew_join(large, "key", "node", blocks, "b_key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "node", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def survivors(key: tuple, t: pa.Table) -> pa.Table:
        """The nodes of a pair of blocks that have a plausible partner of another component."""
        i, j = key[1].as_py(), key[2].as_py()
        own, label, node, size = (t[c].to_numpy() for c in ("own", "label", "node", "n_shingles"))
        sig, alive = matrix(t["sig"].to_pylist()), np.zeros(len(node), bool)
        for x in np.flatnonzero(own == i):
            at = np.flatnonzero((own == j) & (label != label[x]) & ((np.arange(len(node)) > x) | (i != j)))
            at = at[DENOMINATOR * np.minimum(size[x], size[at]) >= NUMERATOR * np.maximum(size[x], size[at])]
            at = at[plausible(np.broadcast_to(sig[x], (len(at), sig.shape[1])), sig[at])]
            alive[at] = True
            alive[x] |= len(at) > 0
        kept = t.filter(pa.array(alive))
        return kept.select(["key", "i", "j", "node", "label", "own", "sig"])

    alive = _with_facts(spread, facts).repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(survivors, "key bigint, i int, j int, node bigint, label bigint, own int, sig binary")
    alive = stash(alive, "alive")
    if alive.isEmpty():
        return None

    def forest(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        t = t.sort_by("node")
        own, nodes, sig = t["own"].to_numpy(), t["node"].to_numpy(), matrix(t["sig"].to_pylist())
        _, component = np.unique(t["label"].to_numpy(), return_inverse=True)
        sets = raw_sets(t["shingles"].combine_chunks())
        size = np.fromiter(map(len, sets), "int64", len(sets))
        words, item = np.unique(np.concatenate(sets), return_inverse=True)
        begin, held, out = np.cumsum(size) - size, np.zeros(len(words), "int64"), []
        for x in np.flatnonzero(own == i):
            at = np.flatnonzero((own == j) & (component != component[x]) & ((np.arange(len(nodes)) > x) | (i != j)))
            # sets whose sizes alone rule the similarity out go first
            at = at[DENOMINATOR * np.minimum(size[x], size[at]) >= NUMERATOR * np.maximum(size[x], size[at])]
            at = at[plausible(np.broadcast_to(sig[x], (len(at), sig.shape[1])), sig[at])] if len(at) else at
            if not len(at):
                continue
            mine = item[begin[x] : begin[x] + size[x]]
            held[mine] = 1
            both = np.array([held[item[begin[y] : begin[y] + size[y]]].sum() for y in at])
            held[mine] = 0
            for y in at[DENOMINATOR * both >= NUMERATOR * (size[x] + size[at] - both)]:
                if component[x] != component[y]:
                    out.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
                    component[component == component[y]] = component[x]
        found = np.array(out, "int64").reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    asked = stash(alive.select(F.col("node").alias("q_node")).distinct(), "asked", rows=n_large)
    needed = lookup(sets.select("node", "shingles"), "node", asked, "q_node", asked.count(), "node").select(F.col("node").alias("s_node"), "shingles").dropDuplicates(["s_node"])
    return _with_facts(alive, needed).repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(forest, "a bigint, b bigint").distinct()


def spread_tasks(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    return rows.join(facts, F.col("node") == F.col("s_node")).drop("s_node")


def relabelled(t: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """t with the root of its label where that has one; roots has n rows."""
    to = roots.select(F.col("node").alias("r_node"), "root")
    to = F.broadcast(to) if n <= BROADCAST_ROWS else to
    return t.join(to, F.col("label") == F.col("r_node"), "left").withColumn("label", F.coalesce("root", "label")).drop("r_node", "root")


def with_labels(t: DataFrame, on: str, labels: DataFrame, n: int, out: str, spread: str) -> DataFrame:
    """t with the label of its column `on`, from n labels (node, label), which has one for each."""
    return lookup(t, on, labels.select(F.col("node").alias("r_node"), F.col("label").alias(out)), "r_node", n, spread).drop("r_node")


def link_nodes(docs: DataFrame, own: DataFrame, nodes: DataFrame, k: int) -> DataFrame | None:
    """(node, label) for every node that shares a band key, the label that of its component; None if none does.
    own: the sketches of rows with a set; nodes: (node, doc_id, text_key, rows), a document of each."""
    keyed = own.select("node", F.explode("bands").alias("key"))
    salts = [0] + [int(x) for x in multipliers(sum(TURNS), 13).view("int64")]
    buckets = stash(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select(F.col("key").alias("b_key")), "buckets")
    n_buckets = buckets.count()
    if not n_buckets:
        return None
    # copies are dropped before hot keys are looked for: (node, key) spreads evenly
    members = lookup(keyed, "key", buckets, "b_key", n_buckets, "node") if n_buckets <= BROADCAST_ROWS else lookup(keyed.distinct(), "key", buckets, "b_key", n_buckets, "node")
    members = stash(members.select("node", "key").distinct(), "members")
    names = stash(members.select(F.col("node").alias("m_node")).distinct(), "shared-names")
    n_members, n_shared = members.count(), names.count()
    facts, once = own.select("node", "sig", "n_shingles"), [F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")]
    # a short list picks its rows where they are; before a long one copies are dropped, so no node is hot
    facts = facts if n_shared <= BROADCAST_ROWS else facts.groupBy("node").agg(*once)
    facts = lookup(facts, "node", names, "m_node", n_shared, "n_shingles")
    shared = stash(facts.groupBy("node").agg(*once), "signatures")
    wanted = lookup(nodes.select("node", "doc_id", "text_key"), "node", names, "m_node", n_shared, "node").select("node", "doc_id", "text_key")
    with small_batches(docs.sparkSession):
        sets = renamed(sets_of(docs, stash(wanted, "wanted", rows=n_shared), k), own)

    labels = stash(names.select(F.col("m_node").alias("node"), F.col("m_node").alias("label")), "labels", rows=n_shared)
    used, seen = 0, None
    for turn in (*TURNS, None):
        t = stash(with_labels(members, "node", labels, n_shared, "label", "key"), "labelled", rows=n_members)
        hubs = [F.min(F.col("node").bitwiseXOR(F.lit(s))).bitwiseXOR(F.lit(s)).alias(f"c{x}") for x, s in enumerate(salts[used : used + (turn or 0)])]
        still = stash(t.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), *hubs).where("low <> high"), "mixed", rows=n_buckets)
        n_still = still.count()
        if not n_still:
            break
        bound = still.select(F.col("key").alias("m_key"), "n", *([F.array_distinct(F.array(*[F.col(f"c{x}") for x in range(turn)])).alias("named")] if turn else []))
        left = lookup(t, "key", bound, "m_key", n_still, "node").drop("m_key")
        found = []
        if turn:
            used += turn
            named = left.select(F.explode("named").alias("hub"), F.col("node").alias("b"), "label").where("hub <> b")
            # one hub of each other component is enough for a node in a turn, whatever number of its buckets name some
            named = with_labels(named, "hub", labels, n_shared, "h_label", "b").where("label <> h_label").groupBy("b", "h_label").agg(F.min("hub").alias("hub"))
            pairs = named.groupBy(F.least("hub", "b").alias("low"), F.greatest("hub", "b").alias("high")).agg(F.min("hub").alias("a"))
            pairs = pairs.select("a", (F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low"))).alias("b"))
        else:
            left = stash(left, "left-over", rows=n_members)
            with small_batches(docs.sparkSession):
                new = crowd_links(left, shared, sets, n_shared)
                found += [] if new is None else [stash(new, "links")]
            pairs = few_pairs(left)
        if seen is not None:
            ordered = [F.least("a", "b"), F.greatest("a", "b")]
            pairs = pairs.join(seen.select(ordered[0].alias("s_a"), ordered[1].alias("s_b")), (ordered[0] == F.col("s_a")) & (ordered[1] == F.col("s_b")), "left_anti")
        pairs = stash(pairs, "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        if n_pairs := pairs.count():
            with small_batches(docs.sparkSession):
                alive = stash(against_hubs(pairs, n_pairs, shared, "sig", alike), "survivors")
                if n_alive := alive.count():
                    found.append(stash(against_hubs(alive, n_alive, sets, "shingles", similar), "verified"))
        for links in found:
            one = with_labels(links, "a", labels, n_shared, "la", "b")
            two = with_labels(one, "b", labels, n_shared, "lb", "a").select(F.col("la").alias("a"), F.col("lb").alias("b"))
            roots = components(two)
            labels = stash(relabelled(labels, roots, n_shared), "labels", rows=n_shared)
    return labels


def renamed(sets: DataFrame, own: DataFrame) -> DataFrame:
    """sets with the names that nodes have among the rows; see `clashes`."""
    apart = clashes(own)
    return sets if apart is None else _apart(sets, apart)


def clashes(own: DataFrame) -> DataFrame | None:
    """Names that sets with different second hashes share; none in nearly every corpus, some dozens among 5e10 documents."""
    found = stash(own.groupBy(F.col("node").alias("c_node")).agg(F.min("again").alias("low"), F.max("again").alias("high")).where("low <> high").select("c_node"), "clashes")
    return None if found.isEmpty() else found


def _apart(rows: DataFrame, apart: DataFrame) -> DataFrame:
    t = rows.join(F.broadcast(apart), F.col("node") == F.col("c_node"), "left")
    return t.withColumn("node", F.when(F.col("c_node").isNotNull(), F.xxhash64("node", "again")).otherwise(F.col("node"))).drop("c_node")


def answers(rows: DataFrame, several: DataFrame, total: int) -> DataFrame:
    """rows with the columns of several (i_node, rows, ..) joined on node; null where it has none. Nodes with many rows are
    broadcast, HOT_SHARE at most; the others have few rows each; rows without a set go straight through."""
    hot = F.broadcast(several.where(F.col("rows") * HOT_SHARE > total).drop("rows"))
    cold = several.where(F.col("rows") * HOT_SHARE <= total).drop("rows")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in cold.schema.fields if f.name != "i_node"]
    empty = rows.where("node is null").select("*", *none)
    first = rows.where("node is not null").join(hot, F.col("node") == F.col("i_node"), "left")
    done = first.where("i_node is not null").drop("i_node")
    rest = first.where("i_node is null").select(*rows.columns)
    return empty.unionByName(done).unionByName(rest.join(cold, F.col("node") == F.col("i_node"), "left").drop("i_node"))


#: Ids that are null come after all others.
NO_ID = 2**63 - 1


def grouped(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, keep_id, keep_key, alone for each row of docs (doc_id, text): the id and
    text hash of the row that stays for its component, and whether the component has no other row."""
    with small_batches(docs.sparkSession):
        sketched = stash(sketches(docs, k), "sketches", rows=docs.count(), a_file=TEXTS_A_TASK)
    total = sketched.count()
    apart = clashes(sketched.where("node is not null"))
    if apart is not None:
        sketched = stash(_apart(sketched, apart), "sketches", rows=total, a_file=TEXTS_A_TASK)
    own = sketched.where("node is not null")
    best = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("order"), "text_key", "doc_id"))
    nodes = own.groupBy("node").agg(best.alias("best"), F.count(F.lit(1)).alias("rows")).select("node", "best", "best.doc_id", "best.text_key", "rows")
    nodes = stash(nodes, "nodes", rows=total)
    labels = link_nodes(docs, own, nodes, k)
    if labels is None:
        labelled = nodes.withColumn("label", F.col("node"))
    else:
        to = labels.select(F.col("node").alias("l_node"), F.col("label"))
        to = F.broadcast(to) if labels.count() <= BROADCAST_ROWS else to
        labelled = nodes.join(to, F.col("node") == F.col("l_node"), "left").withColumn("label", F.coalesce("label", "node")).drop("l_node")
    labelled = stash(labelled.select("node", "best", "rows", "label"), "components", rows=total)
    whole = labelled.groupBy(F.col("label").alias("w_label")).agg(F.min("best").alias("least"), F.sum("rows").alias("size")).where("size > 1")
    several = skew_join(labelled, "label", "node", whole, "w_label").select(F.col("node").alias("i_node"), "rows", F.col("least.doc_id").alias("keep_id"), F.col("least.text_key").alias("keep_key"), F.lit(False).alias("alone"))
    rows = answers(sketched.select("doc_id", "text_key", "n_shingles", "node"), stash(several, "several", rows=total), total)
    single = F.col("alone").isNull()
    return rows.select(
        "doc_id", "text_key", "n_shingles", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("component_id"),
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_key", "text_key").alias("keep_key"), single.alias("alone"),
    )


def kept_rows(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row of each group of near-duplicates, all columns kept: of the smallest id, of its texts that with the smallest
    hash, and of rows that repeat both any one."""
    total = docs.count()
    g = stash(grouped(docs.select("doc_id", "text"), k).where("not alone").select("doc_id", "text_key", "keep_id", "keep_key"), "in-groups", rows=total)
    stays: Column = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))
    gone = stash(g.where(~stays).select("doc_id", "text_key").distinct(), "gone", rows=total)
    again = stash(g.where(stays).groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated", rows=total)
    marked = docs.withColumn("__bl_text_key", F.xxhash64("text"))
    on = (["doc_id", "text_key"], ["doc_id", "__bl_text_key"], F.col("text_key"), F.col("__bl_text_key"))
    left = drop_listed(marked, gone, *on)
    return (left if again.isEmpty() else one_of_listed(left, again, *on)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(documents(spark, sf_dir).select("doc_id", "text"), 4)
    return g.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All pairs that share a shingle are counted, so nothing of signatures, buckets or hubs decides the rows.
ORACLE_OP9 = """
WITH RECURSIVE t AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT d, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT d, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM t WHERE len(w) > 0)),
sizes AS (SELECT d, count(*) AS n FROM shingles GROUP BY d),
sets AS (SELECT d, n, list(s ORDER BY s) AS own FROM shingles JOIN sizes USING (d) GROUP BY d, n),
kinds AS (SELECT min(d) AS k, n, own FROM sets GROUP BY n, own),
node AS (SELECT d, k FROM sets JOIN kinds USING (n, own)),
rare AS (SELECT k, n, s FROM kinds JOIN shingles ON k = d),
pairs AS (SELECT a.k AS x, b.k AS y FROM rare a JOIN rare b ON a.s = b.s AND a.k < b.k AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
walk(k, r) AS (SELECT k, k FROM kinds UNION SELECT e.y, walk.r FROM walk JOIN edges e ON e.x = walk.k WHERE walk.r < e.y),
root AS (SELECT k, min(r) AS r FROM walk GROUP BY k),
least AS (SELECT r, min(doc_id) AS component_id FROM node JOIN root USING (k) JOIN t USING (d) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id, doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS kept
FROM t LEFT JOIN sizes USING (d) LEFT JOIN node USING (d) LEFT JOIN root USING (k) LEFT JOIN least USING (r)
"""
