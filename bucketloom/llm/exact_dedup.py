"""Exact dedup: a log-structured merge index of text digests.

The index is a set of sorted runs (digest, smallest id, largest id, rows), each dealt by digest prefix into files that are sorted by
digest, each with a filter over its digests. Rows come in slices, memtables: a slice is aggregated (map tasks first),
and its digests probe the filters of the runs that are there; those that may be held look the digest up in the runs, so
a slice knows which of its digests are new to the index and which are hits. Then it is flushed as a run of its own, at
level 0. When a level has FANOUT runs, compaction merges them into one run of the next level, keeping the smallest
and the largest id of a digest, so a corpus of n slices has FANOUT * log n runs at most and a digest is rewritten once a level. At the end
all runs are merged.

Digests that were hits or had several rows in a slice are verified by bytes: their texts, and no others, are read a
second time and grouped on (digest, text). Equal copies collapse in the map tasks, and a digest shared by different texts
splits into its texts.

Digests with more than one row in HOT_SHARE are at most HOT_SHARE many; they are broadcast, so no task gathers a hot
group. Everything else joins by digest. A filter has the size that its run's count asks for; a run over the bound of
what is broadcast is probed by joining.

The slices are SLICES parts of the rows by a hash of id and text, as if they had come one after the other; `Index.add`
takes further rows at any time.

Defined results: null text counts as empty; texts are equal when identical after lower-casing A-Z only; texts of any
length are hashed whole; a null id never stays unless all ids of its group are null; the query gives rows repeated with
the same id and text the same answer, while `kept_rows` leaves one row of a group, whatever repeats; an empty table
gives no rows; extra columns are kept by `kept_rows` and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketloom.llm.common import BROADCAST_ROWS, TEXTS_A_TASK, bitmap_of, documents, drop_listed, filter_bits, filtered, lower_ascii, may_hold, one_of_listed, stash

SLICES = 4
#: Runs of a level that are merged into one of the next.
FANOUT = 4
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(F.encode(norm, "UTF-8"), 256))


def prefix(digest: Column) -> Column:
    """The first 60 bits as a number."""
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Run:
    """Sorted files of (digest, low, high, n), how many digests they hold, and the filter over them (None: too many for one)."""

    rows: DataFrame
    digests: int
    bits: int | None
    blocks: DataFrame | None


def written(table: DataFrame, name: str) -> Run:
    rows = stash(table.sortWithinPartitions("digest"), name)
    n = rows.count()
    bits = filter_bits(n)
    blocks = None if bits is None else stash(bitmap_of(rows, prefix(F.col("digest")), bits), f"{name}-filter")
    return Run(rows, n, bits, blocks)


def merged(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


@dataclass
class Index:
    levels: list[list[Run]] = field(default_factory=list)
    #: Tables of digests that were seen before, one for each slice that had any.
    hits: list[DataFrame] = field(default_factory=list)

    def probe(self, table: DataFrame) -> DataFrame | None:
        """The digests of table that some run holds: by its filter, then in its rows."""
        found = []
        for run in (r for level in self.levels for r in level):
            asked = table.select("digest")
            likely = asked if run.blocks is None else may_hold(asked, prefix(F.col("digest")), run.blocks, run.bits)
            found.append(likely.join(run.rows.select(F.col("digest").alias("r_digest")), F.col("digest") == F.col("r_digest"), "left_semi"))
        if not found:
            return None
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        return every

    def add(self, rows: DataFrame) -> None:
        """Take rows (doc_id, digest): probe the runs, flush, and compact the levels that are full."""
        memtable = rows.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
        run = written(memtable, "run")
        if not run.digests:
            return
        again = run.rows.where("n > 1").select("digest")
        seen = self.probe(run.rows)
        self.hits.append(stash((again if seen is None else again.unionByName(seen)).distinct(), "hits"))
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FANOUT:
                return
            run = written(merged([r.rows for r in self.levels[level]]), f"level{level + 1}")
            self.levels[level] = []
            level += 1

    def whole(self, like: DataFrame) -> DataFrame:
        """(digest, low, high, n) over all runs."""
        runs = [r.rows for level in self.levels for r in level]
        if len(runs) == 1:
            return runs[0]
        return stash(merged(runs), "merged") if runs else merged([like.select("digest", F.col("doc_id").alias("low"), F.col("doc_id").alias("high"), F.lit(1).alias("n"))])

    def listed(self) -> DataFrame | None:
        """The digests that were seen more than once."""
        if not self.hits:
            return None
        every = self.hits[0]
        for h in self.hits[1:]:
            every = every.unionByName(h)
        return stash(every.distinct(), "hits")


def split_name(norm: Column) -> Column:
    return F.sha2(F.encode(F.concat(F.lit("part:"), norm), "UTF-8"), 256)


def groups(rows: DataFrame, keep: str = "max", digest=sha256, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """(members, index): members (doc_id, digest, part) has one row a document, index (digest, part, keep_id,
    group_size) one a text. rows need doc_id and text; part tells texts with one digest apart (null: all equal)."""
    norm = normalised(F.col("text"))
    slice_ = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int")
    total = rows.count()
    narrow = stash(rows.select("doc_id", digest(norm).alias("digest"), slice_.alias("slice")), "digests", ("slice",), rows=total, a_file=TEXTS_A_TASK)
    index = Index()
    for k in range(slices):
        index.add(narrow.where(F.col("slice") == k).drop("slice"))
    kept = F.col("high" if keep == "max" else "low")
    level = index.whole(narrow).select("digest", kept.alias("keep_id"), F.col("n").alias("group_size"))
    nothing = F.lit(None).cast("string")
    narrow = narrow.select("doc_id", "digest")
    hits = index.listed()
    n_hits = 0 if hits is None else hits.count()
    if not n_hits:
        return narrow.withColumn("part", nothing), level.withColumn("part", nothing)

    pick = F.max if keep == "max" else F.min
    texts = rows.select("doc_id", digest(norm).alias("digest"), norm.alias("norm"))
    if n_hits <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(hits.select(F.col("digest").alias("h_digest"))), F.col("digest") == F.col("h_digest")).drop("h_digest")
    else:
        texts = filtered(texts, prefix(F.col("digest")), hits, prefix(F.col("digest")), n_hits)
    verified = texts.groupBy("digest", "norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    verified = stash(verified.withColumn("part", split_name(F.col("norm"))).drop("norm"), "verified", rows=total)
    split = stash(verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "split", rows=total)
    if split.isEmpty():
        return narrow.withColumn("part", nothing), level.withColumn("part", nothing)
    mixed = rows.select("doc_id", digest(norm).alias("digest"), norm.alias("norm")).join(split, "digest")
    members = narrow.join(split, "digest", "left_anti").select("doc_id", "digest", nothing.alias("part")).unionByName(mixed.select("doc_id", "digest", split_name(F.col("norm")).alias("part")))
    whole = level.join(split, "digest", "left_anti").withColumn("part", nothing).unionByName(verified.join(split, "digest", "left_semi"))
    return stash(members, "members", rows=total, a_file=TEXTS_A_TASK), stash(whole, "index", rows=total)


def decisions(rows: DataFrame, keep: str = "max", digest=sha256, slices: int = SLICES) -> DataFrame:
    """(doc_id, digest, part, keep_id, group_size): one row for each of rows."""
    members, index = groups(rows, keep, digest, slices)
    total = members.count()
    hot = index.where(F.col("group_size") * HOT_SHARE > total)  # HOT_SHARE rows at most
    h = F.broadcast(hot.select(F.col("digest").alias("h_digest"), F.col("part").alias("h_part"), F.col("keep_id").alias("h_keep"), F.col("group_size").alias("h_size")))
    marked = members.join(h, (F.col("digest") == F.col("h_digest")) & F.col("part").eqNullSafe(F.col("h_part")), "left")
    out = ["doc_id", "digest", "part", "keep_id", "group_size"]
    in_hot = marked.where("h_size is not null").select("doc_id", "digest", "part", F.col("h_keep").alias("keep_id"), F.col("h_size").alias("group_size"))
    rest = marked.where("h_size is null").select("doc_id", "digest", "part")
    # a digest of one row is its own answer, so only the others meet the index again
    cold = index.where((F.col("group_size") * HOT_SHARE <= total) & (F.col("group_size") > 1)).select(F.col("digest").alias("c_digest"), F.col("part").alias("c_part"), "keep_id", "group_size")
    n_cold = cold.count()
    cold = F.broadcast(cold) if n_cold <= BROADCAST_ROWS else cold
    joined = rest.join(cold, (F.col("digest") == F.col("c_digest")) & F.col("part").eqNullSafe(F.col("c_part")), "left")
    alone = F.col("group_size").isNull()
    joined = joined.select("doc_id", "digest", "part", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"))
    return in_hot.select(*out).unionByName(joined.select(*out))


def kept_rows(rows: DataFrame, keep: str = "max") -> DataFrame:
    """One row of each group of copies, all columns kept; of rows that repeat id and text, any one."""
    total = rows.count()
    d = stash(decisions(rows.select("doc_id", "text"), keep).where("group_size > 1"), "in-groups", rows=total)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = stash(d.where(~stays).select("doc_id", "digest").distinct(), "gone", rows=total)
    again = stash(d.where(stays).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated", rows=total)
    marked = rows.withColumn("__bl_digest", sha256(normalised(F.col("text"))))
    on = (["doc_id", "digest"], ["doc_id", "__bl_digest"], prefix(F.col("digest")), prefix(F.col("__bl_digest")))
    left = drop_listed(marked, gone, *on)
    return (left if again.isEmpty() else one_of_listed(left, again, *on)).select(*[F.col(f"`{c}`") for c in rows.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_OP7 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
