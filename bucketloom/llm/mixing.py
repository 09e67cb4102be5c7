"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks in a reproducible order. Weights are exact fractions W / T of whole numbers. From
its start, block j of a source is released at floor(j * T / W) and due at ceil((j + 1) * T / W); earliest deadline first
among the released places one block a slot, so after any number of slots each source is less than one block away from its
target. When a source runs out, a phase ends: the others start anew from that slot, their weights divided by what is
left, so nothing is dropped or repeated and the mix holds over the sources that still have rows.

Targets are given as a table source -> weight, or are the rows of a source to the power TEMPERATURE. They are rounded to
whole numbers of about 2**WEIGHT_BITS together, and `target_weight` states the rounded ones, which the schedule keeps.

Blocks have BLOCK_ROWS rows, or as many more as keep the number of blocks at MOST_BLOCKS: the driver schedules that many
blocks and one more a source at most, whatever the rows. Rows find their slot in the table of blocks. Ranks inside a
source are dealt over buckets, so a source with most rows is numbered by many tasks. Texts move once: only keys are
ranked and joined, then whole rows go to their place.

Defined results: a null source is a source of its own, named "" (as an empty name is); null ids and repeated rows are
placed like any others (equal rows share their places in any order); null texts and texts of any length are rows like any
other; an empty table gives no rows; extra columns are kept by `mixed_rows`, whatever their names.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketloom.llm.common import BROADCAST_ROWS, TEXTS_A_TASK, checked_broadcast, documents, group_ranks, out_of_the_way, skew_join, stash

BLOCK_ROWS = 32
MOST_BLOCKS = 1 << 19
WEIGHT_BITS = 30
#: Default targets: shares in proportion to the rows of a source to this power.
TEMPERATURE = 0.5
OUT = ["mix_source", "block", "place", "slot", "release", "deadline", "phase", "target_weight"]
#: Rows of a file of the mix: a few files for each core, within these bounds.
LEAST_FILE_ROWS, MOST_FILE_ROWS = 4096, 200_000


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in proportion to the weights, 1 or more each."""
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights are positive numbers")
    total = math.fsum(weights.values()) or 1.0
    return {s: max(1, round(w / total * (1 << WEIGHT_BITS))) for s, w in weights.items()}


def phase(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) until the first source runs out, by earliest deadline; ties go to the
    source that sorts first."""
    total = sum(weights.values())
    waiting = [(0, -(-total // w), s, 0) for s, w in weights.items()]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out, slot = [], 0
    while True:
        while waiting and waiting[0][0] <= slot:
            release, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j, release))
        due, s, j, release = heapq.heappop(ready)  # weights fill every slot, so some block is released
        out.append((s, j, slot, release, due))
        slot += 1
        j += 1
        if j == blocks[s]:
            return out
        w = weights[s]
        heapq.heappush(waiting, (j * total // w, -(-(j + 1) * total // w), s, j))


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, int, int, int, int, int]]:
    """(source, block, slot, release, deadline, phase) of all blocks, slots from 0 without a gap."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    out: list[tuple[str, int, int, int, int, int]] = []
    number = 0
    while left:
        base = len(out)
        if len(left) == 1:  # every slot is its own
            ((s, n),) = left.items()
            out += [(s, done[s] + j, base + j, base + j, base + j + 1, number) for j in range(n)]
            break
        made = phase(left, {s: weights[s] for s in left})
        out += [(s, done[s] + j, base + slot, base + release, base + due, number) for s, j, slot, release, due in made]
        for s, *_ in made:
            done[s] += 1
            left[s] -= 1
        left = {s: n for s, n in left.items() if n}
        number += 1
    return out


def rows_a_block(total: int) -> int:
    return max(BLOCK_ROWS, -(-total // MOST_BLOCKS))


def planned(keys: DataFrame, weights: dict[str, float] | None, block_rows: int | None) -> tuple[DataFrame, int, int]:
    """(blocks, rows a block, rows): the slot of each block of each source of keys."""
    counts = {r["s"]: r["n"] for r in keys.groupBy(F.col("mix_source").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    block_rows = block_rows or rows_a_block(total)
    if weights is not None and set(counts) - set(weights):
        raise ValueError(f"no target weight for {sorted(set(counts) - set(weights))[:5]}")
    whole = whole_weights({s: n**TEMPERATURE if weights is None else weights[s] for s, n in counts.items()})
    plan = schedule({s: -(-n // block_rows) for s, n in counts.items()}, whole)
    all_weights = sum(whole.values())
    columns = list(zip(*plan, strict=True)) or [()] * 6
    table = pa.table({
        "p_source": pa.array(columns[0], "string"), "p_block": pa.array(columns[1], "int64"), "slot": pa.array(columns[2], "int64"), "release": pa.array(columns[3], "int64"),
        "deadline": pa.array(columns[4], "int64"), "phase": pa.array(columns[5], "int32"), "target_weight": pa.array([whole[s] / all_weights for s in columns[0]], "float64"),
    })
    blocks, _ = checked_broadcast(stash(keys.sparkSession.createDataFrame(table), "blocks", rows=len(plan)), BROADCAST_ROWS)
    return blocks, block_rows, total


def source_name(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(""))


def at_slots(t: DataFrame, rank: str, blocks: DataFrame, block_rows: int) -> DataFrame:
    """t (mix_source and a rank in it) with block, place and the columns of blocks."""
    t = t.withColumn("block", F.floor(F.col(rank) / block_rows).cast("long")).withColumn("place", (F.col(rank) % block_rows).cast("int"))
    return t.join(blocks, (F.col("mix_source") == F.col("p_source")) & (F.col("block") == F.col("p_block"))).drop("p_source", "p_block", rank)


def mix(keys: DataFrame, order: list[str], weights: dict[str, float] | None = None, block_rows: int | None = None) -> DataFrame:
    """keys (source and the columns of order) with mix_source, block, place, slot, release, deadline, phase and target_weight;
    columns of keys with these names come back as input_<name>."""
    moved = out_of_the_way(keys, OUT)
    order = [moved.columns[keys.columns.index(c)] for c in order]
    named = moved.withColumn("mix_source", source_name("source"))
    blocks, block_rows, total = planned(named, weights, block_rows)
    return at_slots(group_ranks(named, "mix_source", order, "__bl_in_source", total), "__bl_in_source", blocks, block_rows)


def mixed_rows(docs: DataFrame, weights: dict[str, float] | None = None, file_rows: int | None = None) -> DataFrame:
    """docs in the order of the mix, same columns: files and the rows in them follow the slots, and `packing` packs
    documents in that order.

    Only keys are ranked; a row takes its rank by its keys. Rows that repeat all keys have ranks in a row, over which they
    are dealt about evenly, so a block with such rows can hold a few more or less than others. A row's slot tells a row its file, so the rows are sorted without being sampled first."""
    text_key = F.xxhash64("text")
    keys = stash(docs.select("doc_id", text_key.alias("text_key"), source_name("source").alias("mix_source")), "keys", rows=docs.count(), a_file=TEXTS_A_TASK)
    blocks, block_rows, total = planned(keys, weights, None)
    ranked = group_ranks(keys, "mix_source", ["doc_id", "text_key"], "__bl_in_source", total)
    first = ranked.groupBy("doc_id", "text_key", "mix_source").agg(F.min("__bl_in_source").alias("p_rank"), F.count(F.lit(1)).alias("p_n"))
    first = stash(first.select(F.col("doc_id").alias("p_id"), F.col("text_key").alias("p_key"), F.col("mix_source").alias("mix_source"), "p_rank", "p_n", F.xxhash64("doc_id", "text_key", "mix_source").alias("p_hash")), "ranks", rows=total)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__bl_row")
    held = docs.select(row, F.col("doc_id").alias("k_id"), text_key.alias("k_key"), source_name("source").alias("k_source"))
    held = held.withColumn("k_hash", F.xxhash64("k_id", "k_key", "k_source")).withColumn("k_turn", F.monotonically_increasing_id())
    same = F.col("k_id").eqNullSafe(F.col("p_id")) & (F.col("k_key") == F.col("p_key")) & (F.col("k_source") == F.col("mix_source"))
    if total <= BROADCAST_ROWS:
        met = held.join(F.broadcast(first), (F.col("k_hash") == F.col("p_hash")) & same)
    else:
        met = skew_join(held, "k_hash", "k_turn", first, "p_hash").where(same)
    met = met.select("__bl_row", "mix_source", (F.col("p_rank") + F.pmod("k_turn", "p_n")).alias("__bl_in_source"))
    t = at_slots(met, "__bl_in_source", blocks, block_rows)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    file_rows = file_rows or min(MOST_FILE_ROWS, max(LEAST_FILE_ROWS, total // (4 * cores)))
    a_file = max(1, file_rows // block_rows)  # slots
    slots = max(1, blocks.count())
    files = -(-slots // a_file)
    t = t.withColumn("__bl_file", F.floor(F.col("slot") / a_file).cast("int"))
    return t.repartitionById(files, "__bl_file").sortWithinPartitions("slot", "place").select("__bl_row.*")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = documents(spark, sf_dir).select("doc_id", "source", F.xxhash64("text").alias("text_key"))
    out = mix(stash(narrow, "sources"), ["doc_id", "text_key"])
    return out.select("doc_id", "source", "block", "place", "slot", "release", "deadline", "phase", "target_weight")
