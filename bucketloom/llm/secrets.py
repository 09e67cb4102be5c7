"""Secret scans with corpus-wide ownership frequency.

Candidates are found in each text by patterns (`spans`). Their values are hashed and counted over the whole corpus: in how
many distinct repositories (texts of an owner, copies once) and by how many owners (sources) does a value appear? A value
is a copied example if WIDE_OWNERS owners or more have it, or WIDE_REPOSITORIES repositories or more, or if it has a
placeholder's shape (PLACEHOLDER, or hardly any different characters); any other is owner-specific and looks live. Each
span gets its verdict.

Matches are placed without offsets from the engine: splitting a text by a pattern gives the pieces between its
leftmost non-overlapping matches, so running sums of piece and match lengths are the places, in code points. The sums are
made in chunks of matches, so a text with many takes time in proportion to them.

Counts by value go through (value, owner, repository) with partial sums, so a value that a third of the corpus repeats
shrinks in each map task; values of more than one in HOT_SHARE candidates are joined by broadcast (HOT_SHARE at most).

Defined results: null text is empty: no spans, the hash of an empty string; null ids and repeated rows give a row each
and count as one repository; null sources are one owner; texts of any length are scanned whole; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketloom.llm.common import documents, stash

#: The base patterns. `assign` must match as it stands (its short matches use up text and are dropped
#: after); runs of the other two are maximal, so their least length can be part of the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Patterns that the method adds.
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
GITHUB = r"gh[pousr]_[A-Za-z0-9]{30,}"
SLACK = r"xox[abprs]-[A-Za-z0-9-]{10,}"

#: kind, pattern, group of the value, least length of the value, base or not; in the order of the list.
KINDS = [
    ("assign", ASSIGN, 2, 12, True),
    ("access", ACCESS, 0, 18, True),
    ("hex", HEX, 0, 16, True),
    ("pem", PEM, 0, 1, False),
    ("jwt", JWT, 0, 1, False),
    ("github", GITHUB, 0, 1, False),
    ("slack", SLACK, 0, 1, False),
]
#: Something that each pattern needs, cheap to look for.
NEEDS = {"access": "AKIA", "pem": "PRIVATE KEY-----", "jwt": "eyJ", "slack": "xox"}
#: What a placeholder says of itself, runs that nobody draws at random, and one character many times over.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change_?me|your[_-]|x{4}|0123456|1234567|abcdefg|(.)\1{7}"
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 20
HOT_SHARE = 1000
#: Matches whose places are summed up at a time.
CHUNK = 256
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """All matches of one kind in their order; null where there is none."""
    found = F.contains(text, F.lit(NEEDS[kind])) & F.rlike(text, F.lit(pattern)) if kind in NEEDS else F.rlike(text, F.lit(pattern))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.zip_with(whole, value, lambda w, v: F.struct(F.char_length(w).cast("long").alias("n"), v.alias("v"))), F.slice(between, 1, F.size(whole)), lambda m, b: F.struct(m["n"].alias("n"), m["v"].alias("v"), F.char_length(b).cast("long").alias("gap")))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + m["n"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), m["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.char_length(m["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(SPAN).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        """The places of one chunk, which begins where the one before it ends."""
        begin = F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out"))
        made = F.aggregate(part, begin, step)
        return F.get(F.transform(F.array(made), lambda m: F.struct(m["at"].alias("at"), F.concat(acc["chunks"], F.array(m["out"])).cast(f"array<{SPAN}>").alias("chunks"))), F.lit(0))

    def placed(all_steps: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_steps, k * CHUNK + 1, CHUNK))
        return F.aggregate(chunks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("chunks")), chunk, lambda acc: F.flatten(acc["chunks"]))

    return F.when(found, F.get(F.transform(F.array(steps), placed), F.lit(0)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, owner, text) to one row each: counts, digests and the spans with hashed values."""
    text = F.coalesce("text", F.lit(""))
    t = docs.select("doc_id", "owner", text.alias("text"))
    t = t.select("doc_id", "owner", F.xxhash64("text").alias("text_key"), *[spans_of(F.col("text"), *k[:4], rank).alias(k[0]) for rank, k in enumerate(KINDS)])
    empty = F.array().cast(SPAN)
    own = [F.coalesce(F.col(k[0]), empty) for k in KINDS]
    base = F.array_sort(F.concat(*[c for c, k in zip(own, KINDS, strict=True) if k[4]]))
    count = lambda c, name: F.size(c).cast("long").alias(name)
    every = F.array_sort(F.concat(*own))
    t = t.select("doc_id", "owner", "text_key", count(own[0], "n_assign"), count(own[1], "n_access"), count(own[2], "n_hex"), base.alias("base"), every.alias("every"))
    value = lambda s: F.xxhash64(s["value"], F.lit("value"))
    shaped = lambda s: F.rlike(s["value"], F.lit(PLACEHOLDER)) | (F.size(F.array_distinct(F.split(s["value"], ""))) <= 4)
    marks = F.transform("every", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), value(s).alias("value"), shaped(s).alias("shaped")))
    return t.select("doc_id", "owner", "text_key", "n_assign", "n_access", "n_hex", F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"), marks.alias("marks"))


def ownership(each: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners, rows) over the whole corpus, for each value that is a candidate anywhere."""
    repos = each.groupBy("value", "owner", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    owners = repos.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("rows").alias("rows"))
    return owners.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("rows").alias("rows"))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, owner, text) with spans, the verdict on each, and how many look live or like copied examples."""
    found = stash(find(docs), "spans")
    key = ["doc_id", "owner", "text_key"]
    some = found.where(F.size("marks") > 0)
    each = some.select(*key, F.explode("marks").alias("mark")).select(*key, "mark.*").distinct()  # rows that repeat a document count once
    freq = stash(ownership(each), "ownership")
    total = freq.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    wide = (F.col("n_owners") >= WIDE_OWNERS) | (F.col("n_repos") >= WIDE_REPOSITORIES)
    verdict = freq.select("value", "rows", wide.alias("wide"))
    hot = verdict.where(F.col("rows") * HOT_SHARE > total).select(F.col("value").alias("h_value"), F.col("wide").alias("h_wide"))
    cold = verdict.where(F.col("rows") * HOT_SHARE <= total).select(F.col("value").alias("c_value"), F.col("wide").alias("c_wide"))
    place = ["start", "rank", "end", "kind", "shaped"]
    marked = each.join(F.broadcast(hot), F.col("value") == F.col("h_value"), "left")
    seen = marked.where("h_wide is not null").select(*key, *place, F.col("h_wide").alias("wide"))
    seen = seen.unionByName(marked.where("h_wide is null").join(cold, F.col("value") == F.col("c_value")).select(*key, *place, F.col("c_wide").alias("wide")))
    example = F.col("wide") | F.col("shaped")
    told = F.sort_array(F.collect_list(F.struct("start", "rank", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"), F.when(example, "example").otherwise("live")).alias("text"))))
    per = seen.groupBy(*key).agg(F.sum(example.cast("long")).alias("n_examples"), F.sum((~example).cast("long")).alias("n_live"), F.array_join(F.transform(told, lambda x: x["text"]), ",").alias("verdicts"))
    per = per.select(*[F.col(k).alias(f"p_{k}") for k in key], "n_examples", "n_live", "verdicts")
    joined = some.join(per, F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & F.col("owner").eqNullSafe(F.col("p_owner")) & (F.col("text_key") == F.col("p_text_key")))
    out = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    none = F.lit(0).cast("long")
    return joined.select(*out, "n_examples", "n_live", "verdicts").unionByName(found.where(F.size("marks") == 0).select(*out, none.alias("n_examples"), none.alias("n_live"), F.lit("").alias("verdicts")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", F.col("source").alias("owner"), "text"))


def sql_spans(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    """The spans of one kind: (doc, start, rank, end, kind, value), placed by the pieces between the matches."""
    return f"""SELECT d, start, {rank} AS rank, start + n AS e, '{kind}' AS kind, v FROM (
  SELECT d, v, length(w) AS n, sum(length(b) + CASE WHEN i = 1 THEN 0 ELSE p END) OVER (PARTITION BY d ORDER BY i) AS start FROM (
    SELECT d, i, w[i] AS w, v[i] AS v, b[i] AS b, CASE WHEN i > 1 THEN length(w[i - 1]) ELSE 0 END AS p FROM (
      SELECT d, unnest(range(1, len(w) + 1)) AS i, w, v, b FROM (
        SELECT d, regexp_extract_all(text, {pattern}) AS w, regexp_extract_all(text, {pattern}, {group}) AS v, regexp_split_to_array(text, {pattern}) AS b FROM t)))) WHERE length(v) >= {least}"""


#: Fixed value: the first pattern with the letters of its names in either case, which some engines fold further.
SQL_ASSIGN = "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
SQL_SHAPES = r"example|sample|dummy|placeholder|change_?me|your[_-]|x{4}|0123456|1234567|abcdefg"


def oracle() -> str:
    kinds = " UNION ALL ".join(sql_spans(kind, f"'{SQL_ASSIGN if kind == 'assign' else pattern}'", group, least, rank) for rank, (kind, pattern, group, least, _) in enumerate(KINDS))
    return f"""WITH t AS (SELECT row_number() OVER () AS d, doc_id, coalesce(source, chr(0)) AS owner, coalesce(text, '') AS text FROM documents),
every AS ({kinds}),
run AS (SELECT v, max(n) AS longest FROM (SELECT v, count(*) AS n FROM (SELECT v, i - row_number() OVER (PARTITION BY v, c ORDER BY i) AS island, c FROM (SELECT v, i, lower(v[i]) AS c FROM (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM (SELECT DISTINCT v FROM every)))) GROUP BY v, c, island) GROUP BY v),
freq AS (SELECT v, count(DISTINCT owner) AS owners, sum(repos) AS repos FROM (SELECT v, owner, count(DISTINCT text) AS repos FROM every JOIN t USING (d) GROUP BY 1, 2) GROUP BY 1),
told AS (SELECT d, start, rank, e, kind, (owners >= {WIDE_OWNERS} OR repos >= {WIDE_REPOSITORIES} OR regexp_matches(v, '{SQL_SHAPES}', 'i') OR longest >= 8 OR len(list_distinct(string_split(v, ''))) <= 4) AS example FROM every JOIN freq USING (v) JOIN run USING (v)),
per AS (SELECT d, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || e, ',' ORDER BY start, rank) FILTER (rank <= 2) AS base, string_agg(kind || ':' || start || ':' || e, ',' ORDER BY start, rank) AS spans,
  count(*) FILTER (example) AS n_examples, count(*) FILTER (NOT example) AS n_live, string_agg(kind || ':' || start || ':' || e || ':' || CASE WHEN example THEN 'example' ELSE 'live' END, ',' ORDER BY start, rank) AS verdicts FROM told GROUP BY d)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_examples, 0) AS n_examples, coalesce(n_live, 0) AS n_live, coalesce(verdicts, '') AS verdicts FROM t LEFT JOIN per USING (d)"""


ORACLE_OP8 = oracle()
