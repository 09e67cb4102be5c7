"""Line dedup: exact repeats of every line, and a segment-partition edit join for lines within THRESHOLD edits of each other.

Lines are trimmed; blank ones are left alone. They are first made distinct by a hash; a second hash finds lines that
share the first, which then get hashes of their own. Lines shorter than MIN_CHARS, of which one edit changes much, have no
neighbours but their exact repeats. A longer line of length n is split into THRESHOLD + 1 = 2 segments; one edit leaves one of
them whole, so the index holds both segments of each length, and a line probes the index of its own length and of the
next shorter one with its substrings that align from the start or the end. Lines that share no entry are done, without
their text having been moved.

Lines that do share one are split finer, into FINE segments of which all but one must be whole (the same argument), by
the keys of a line without one segment. In the buckets of these keys lines differ inside one short window only. Small
buckets are taken pair by pair. Buckets over SMALL lines go down to single characters: lines alike but for one place share
a key, and each is paired with the first of them; a line with one character less is found by its own hash. So no
bucket is expanded into all its pairs, and no pair within one edit is lost. Every pair, from either way, becomes a link
only by a banded bit-parallel edit distance: an automaton whose states are bits around the diagonal.

THRESHOLD is 1 for all lengths: the splits, the single-character keys and the automaton are made for one edit.

Classes are connected components. The first line of a class (smallest doc_id, then line number) stays, all others are
dropped; with null ids last.

Each table but the first has a file for each core, or more where its rows (which are counted or bounded first) are many,
however many partitions shuffles have: a small table cut into hundreds of files costs more than its rows do.

Defined results: null text has no lines; lines of any length are taken whole; repeated rows with the same id and
text are one document and get the same answer; an empty table gives no rows; extra columns are ignored by the query and
kept by `deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketloom.llm.common import components, documents, filtered, skew_join, stash

THRESHOLD = 1
MIN_CHARS = 20
FINE = 16
SMALL = 64
NO_ID = 2**63 - 1
#: Rows with a text, or pairs whose texts are compared, that one task takes.
TEXTS_A_FILE = 20_000


def lines_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, text_key, line_no, line."""
    key = F.xxhash64("text").alias("text_key")
    each = docs.select("doc_id", key, F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select("doc_id", "text_key", "line_no", F.trim("raw").alias("line"))
    return each.where(F.col("line") != "")


def line_hash(line: Column) -> Column:
    return F.xxhash64(line, F.lit("line"))


def second_hash(line: Column) -> Column:
    return F.xxhash64(F.lit("again"), line)


def apart(t: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """t (h, again) where lines that share a hash have hashes of their own."""
    if clashes is None:
        return t
    t = t.join(F.broadcast(clashes), F.col("h") == F.col("x_h"), "left")
    return t.withColumn("h", F.when(F.col("x_h").isNotNull(), F.xxhash64("h", "again")).otherwise(F.col("h"))).drop("x_h")


def segment_keys(line: Column, n: Column) -> Column:
    """Entries of the two segments in the index of length n, and probes of length n - 1: from the start, from the end."""
    def at(length: Column) -> list[Column]:
        half = F.floor(length / 2).cast("int")
        return [
            F.xxhash64(F.lit(1), length, F.substring(line, F.lit(1), half)),
            F.xxhash64(F.lit(2), length, F.substring(line, n - (length - half) + 1, length - half)),
        ]

    return F.array(*at(n), *at(n - 1))


def fine_keys(line: Column, n: Column) -> Column:
    """The line without the s-th of FINE segments, in the index of its length and as a probe of the next shorter one."""
    def at(length: Column, s: Column) -> Column:
        begin, end = F.floor(length * s / FINE).cast("int"), F.floor(length * (s + 1) / FINE).cast("int")
        return F.xxhash64(F.lit(3), length, s, F.substring(line, F.lit(1), begin), F.substring(line, n - (length - end) + 1, length - end))

    steps = F.sequence(F.lit(0), F.lit(FINE - 1))
    return F.concat(F.transform(steps, lambda s: at(n, s)), F.transform(steps, lambda s: at(n - 1, s)))


def within_one(a: Column, b: Column) -> Column:
    """Whether two lines are within THRESHOLD edits, by bits around the diagonal.

    Bit o of `r0` or `r1` says that with 0 or 1 edits the first j characters of a can have become the first
    j + o - 1 of b. A character keeps the bits whose next characters are equal; an edit moves a bit to its place or
    beside it.
    """
    begin = F.struct(F.lit(2).alias("r0"), F.lit(6).alias("r1"))

    def reached(p: Column) -> Column:
        x, y = p["x"], p["y"]

        def step(acc: Column, c: Column) -> Column:
            same = [F.when(F.when(c["j"] + o >= 0, F.get(y, c["j"] + o)) == c["ch"], F.lit(1 << (o + 1))).otherwise(F.lit(0)) for o in (-1, 0, 1)]
            match = same[0].bitwiseOR(same[1]).bitwiseOR(same[2])
            r0 = acc["r0"].bitwiseAND(match)
            r1 = acc["r1"].bitwiseAND(match).bitwiseOR(acc["r0"]).bitwiseOR(F.shiftright(acc["r0"], 1)).bitwiseOR(F.shiftleft(r0, 1)).bitwiseAND(F.lit(7))
            return F.struct(r0.alias("r0"), r1.alias("r1"))

        end = F.get(F.lit([1, 2, 4]), F.size(y) - F.size(x) + 1)
        chars = F.transform(x, lambda ch, j: F.struct(ch.alias("ch"), j.alias("j")))
        reach = F.aggregate(chars, begin, step, lambda acc: acc["r0"].bitwiseOR(acc["r1"]).bitwiseAND(end) != 0)
        return F.when(F.abs(F.size(y) - F.size(x)) <= THRESHOLD, reach).otherwise(F.lit(False))

    # an array of one pair: the lambda binds the split lines, which would else be split again for every character
    pair = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    return F.get(F.transform(pair, reached), F.lit(0))


def shared_keys(keyed: DataFrame) -> DataFrame:
    """Keys that lines with different hashes have: (key, n)."""
    return keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select(F.col("key").alias("k_key"), "low", "n")


def checked(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) of line hashes whose lines are within THRESHOLD edits; found has (t_h, line)."""
    one = skew_join(pairs, "a", "b", found, "t_h").select("a", "b", F.col("line").alias("line_a"))
    two = skew_join(one, "b", "a", found, "t_h", sized=pairs).select("a", "b", "line_a", F.col("line").alias("line_b"))
    return two.where(within_one(F.col("line_a"), F.col("line_b"))).select("a", "b")


def links(distinct: DataFrame, docs: DataFrame, clashes: DataFrame | None = None) -> DataFrame:
    """(a, b): links between line hashes that connect all lines within one edit of each other."""
    n_lines = distinct.count()
    keyed = distinct.select("h", F.explode("keys").alias("key"))
    shared = stash(shared_keys(keyed), "segments", rows=2 * n_lines)  # four keys a line, two lines a key
    some = stash(skew_join(keyed, "key", "h", shared.select("k_key"), "k_key").select("h").distinct(), "probed", rows=n_lines)
    n_some = some.count()

    lines = apart(lines_of(docs).select(line_hash(F.col("line")).alias("h"), second_hash(F.col("line")).alias("again"), "line"), clashes)
    wanted = filtered(lines, F.col("h"), some, F.col("h"), n_some)
    # copies meet in a task before they are shuffled, so a line that many documents share is nobody's burden
    texts = wanted.groupBy("h", "line").agg(F.count(F.lit(1)).alias("n")).select("h", "line").join(some.select(F.col("h").alias("s_h")), F.col("h") == F.col("s_h"), "left_semi")
    texts = stash(texts, "lines", rows=n_some, a_file=TEXTS_A_FILE)
    n = F.char_length("line")
    fine = texts.select("h", F.explode(F.array_distinct(fine_keys(F.col("line"), n))).alias("key"))
    buckets = stash(shared_keys(fine), "windows", rows=FINE * n_some)
    members = stash(skew_join(fine, "key", "h", buckets.select("k_key", "n"), "k_key").select("h", "key", "n"), "members", rows=2 * FINE * n_some)
    found = texts.select(F.col("h").alias("t_h"), "line")

    small = members.where(F.col("n") <= SMALL)
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.h") < F.col("y.h"))).select(F.col("x.h").alias("a"), F.col("y.h").alias("b")).distinct()
    most = buckets.where(F.col("n") <= SMALL).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).first()[0]
    pairs = stash(pairs, "pairs", rows=most)
    verified = stash(checked(pairs, found), "verified", rows=pairs.count(), a_file=TEXTS_A_FILE)

    large = stash(members.where(F.col("n") > SMALL).select("h").distinct(), "crowded", rows=n_some)
    if large.isEmpty():
        return verified
    crowded = large.join(found, F.col("h") == F.col("t_h")).select("h", "line")
    whole = F.char_length("line")
    cut = lambda i: F.concat(F.substring("line", F.lit(1), i), F.substring("line", i + 2, whole))
    n_chars = crowded.agg(F.sum(whole)).first()[0]
    places = F.sequence(F.lit(0), whole - 1)
    swaps = crowded.select("h", F.explode(F.transform(places, lambda i: F.xxhash64(F.lit(4), i, cut(i)))).alias("key"))
    alike = stash(swaps.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select(F.col("key").alias("k_key"), "low"), "alike", rows=n_chars)
    starred = skew_join(swaps, "key", "h", alike, "k_key").where("h <> low").select(F.col("low").alias("a"), F.col("h").alias("b"))
    shorter = crowded.select("h", F.explode(F.array_distinct(F.transform(places, lambda i: line_hash(cut(i))))).alias("key"))
    grown = skew_join(shorter, "key", "h", large.select(F.col("h").alias("o_h")), "o_h").select(F.col("o_h").alias("a"), F.col("h").alias("b"))
    crowd = stash(starred.unionByName(grown).distinct(), "crowded-pairs", rows=2 * n_chars)
    crowded_links = checked(crowd, crowded.select(F.col("h").alias("t_h"), "line"))
    return verified.unionByName(stash(crowded_links, "crowded-links", rows=crowd.count(), a_file=TEXTS_A_FILE))


def decisions(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, text_key, n_lines, dropped: the numbers of the lines to drop, rising."""
    line = F.col("line")
    n = F.char_length(line)
    keys = F.when(n >= MIN_CHARS, segment_keys(line, n)).otherwise(F.array().cast("array<bigint>"))
    places = lines_of(docs).select("doc_id", "text_key", "line_no", line_hash(line).alias("h"), second_hash(line).alias("again"), keys.alias("keys"))
    places = stash(places, "places")
    n_places = places.count()
    owner = F.coalesce("doc_id", F.lit(NO_ID))
    count = lambda t: stash(t.groupBy("h").agg(F.min(owner).alias("first_doc"), F.count(F.lit(1)).alias("n"), F.min("again").alias("low"), F.max("again").alias("high")), "counted", rows=n_places)
    counted = count(places)
    clashes = counted.where("low <> high").select(F.col("h").alias("x_h"))
    if clashes.isEmpty():  # as in nearly every corpus
        clashes = None
    else:
        clashes = stash(clashes, "clashes", rows=n_places)
        places = stash(apart(places, clashes), "places")
        counted = count(places)
    linked = links(places.select("h", "keys"), docs, clashes)
    n_links = linked.count()
    roots = components(linked, n_links).select(F.col("node").alias("r_node"), "root")
    classed = stash(counted.join(roots, F.col("h") == F.col("r_node"), "left").select("h", F.coalesce("root", "h").alias("class"), "first_doc", "n"), "classed", rows=n_places)
    whole = classed.groupBy(F.col("class").alias("w_class")).agg(F.min("first_doc").alias("keep_doc"), F.sum("n").alias("size")).where("size > 1")
    several = stash(classed.join(whole, F.col("class") == F.col("w_class")).select(F.col("h").alias("c_h"), "class", "keep_doc"), "several", rows=n_places)
    seen = stash(skew_join(places.select("doc_id", "text_key", "line_no", "h"), "h", "line_no", several, "c_h").select("doc_id", "text_key", "line_no", "class", "keep_doc"), "seen", rows=n_places).distinct()
    away = seen.where(owner != F.col("keep_doc")).select("doc_id", "text_key", "line_no")
    home = seen.where(owner == F.col("keep_doc"))
    # rows that share the id of the first one are told apart by their text; the smallest stays
    firsts = home.groupBy(F.col("class").alias("f_class"), F.col("keep_doc").alias("f_doc")).agg(F.min("text_key").alias("f_key"))
    at_home = home.join(firsts, (F.col("class") == F.col("f_class")) & (F.col("keep_doc") == F.col("f_doc")))
    lowest = at_home.where("text_key = f_key").groupBy(F.col("class").alias("l_class")).agg(F.min("line_no").alias("l_no"))
    later = at_home.join(lowest, F.col("class") == F.col("l_class")).where("text_key <> f_key or line_no <> l_no").select("doc_id", "text_key", "line_no")
    lists = away.unionByName(later).groupBy(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key")).agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    none = F.array().cast("array<int>")
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")
    return joined.select("doc_id", "text_key", "n_lines", F.coalesce("dropped", none).alias("dropped"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the dropped lines taken out of text; all columns kept."""
    d = decisions(docs.select("doc_id", "text")).where(F.size("dropped") > 0).select(F.col("doc_id").alias("d_id"), F.col("text_key").alias("d_key"), F.col("dropped").alias("d_dropped")).distinct()
    t = docs.withColumn("__bl_key", F.xxhash64("text"))
    t = t.join(d, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("__bl_key") == F.col("d_key")), "left")
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    left = F.transform(F.filter(numbered, lambda s: ~F.array_contains(F.col("d_dropped"), s["i"])), lambda s: s["x"])
    return t.withColumn("text", F.when(F.col("d_dropped").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decisions(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped_lines"))


#: Candidates share a half as well, but links are made by the first place where two lines differ, and rows are told apart by
#: the lines themselves. Ids are taken to be unique, as those of the test tables are.
ORACLE_OP5 = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS d, doc_id, string_split(text, chr(10)) AS ls FROM documents),
places AS (SELECT * FROM (SELECT d, doc_id, i - 1 AS no, trim(ls[i], ' ') AS line FROM (SELECT d, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)) WHERE line <> ''),
kinds AS (SELECT line, length(line) AS n FROM (SELECT DISTINCT line FROM places)),
parts AS (SELECT line, n, l FROM kinds, (SELECT unnest([0, 1]) AS less), LATERAL (SELECT n - less AS l) WHERE n >= {MIN_CHARS}),
entries AS (SELECT line, n, l, 1 AS side, left(line, l // 2) AS part FROM parts UNION ALL SELECT line, n, l, 2, right(line, l - l // 2) FROM parts),
pairs AS (SELECT DISTINCT CASE WHEN a.n <= b.n THEN a.line ELSE b.line END AS s, CASE WHEN a.n <= b.n THEN b.line ELSE a.line END AS g, least(a.n, b.n) AS n, abs(a.n - b.n) AS more
  FROM entries a JOIN entries b ON a.l = b.l AND a.side = b.side AND a.part = b.part AND a.line < b.line WHERE abs(a.n - b.n) <= 1),
first AS (SELECT s, g, more, coalesce(list_position([x[1] <> x[2] FOR x IN list_zip(string_split(s, ''), string_split(g, '')[1 : n])], true), n + 1) AS m FROM pairs),
links AS (SELECT s, g FROM first WHERE substr(s, m + 1 - more) = substr(g, m + 1)),
edges AS (SELECT s AS x, g AS y FROM links UNION SELECT g, s FROM links),
walk(k, r) AS (SELECT DISTINCT x, x FROM edges UNION SELECT e.y, walk.r FROM walk JOIN edges e ON e.x = walk.k WHERE walk.r < e.y),
root AS (SELECT k, min(r) AS r FROM walk GROUP BY k),
ranked AS (SELECT d, no, row_number() OVER (PARTITION BY coalesce(r, line) ORDER BY doc_id NULLS LAST, no) AS place FROM places LEFT JOIN root ON k = line),
gone AS (SELECT d, count(*) AS n, string_agg(no, ',' ORDER BY no) AS dropped FROM ranked WHERE place > 1 GROUP BY d)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_dropped, coalesce(dropped, '') AS dropped_lines FROM t LEFT JOIN gone USING (d)
"""
