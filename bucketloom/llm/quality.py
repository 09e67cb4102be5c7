"""Quality rules: fixed counts and the perplexity of a modified Kneser-Ney character model.

Each map task counts the packed 4-grams of its texts (16 bits a character; the planes beyond the first share the codes
that no character has) for each language; Spark sums them over all documents and derives the lower-order continuation
counts, the three discounts of each order, the context sums and the interpolated probabilities with grouped aggregates
and joins. The model is two sorted arrays, hashes of (half, language, gram) in 64 bits and log-probabilities, one entry a
gram. While it has MODEL_ROWS entries or fewer, which is counted, it is broadcast and looked up by binary search. A larger
one stays a table: documents then send each of their grams once, with its count, and meet it in a join. Both ways give the
same sums.

No text is scored by its own counts: texts are dealt over two halves by hash, so that equal texts are in one, each half
has a model of its own, and a text is scored by that of the other half, which backs off for grams it does not hold.

A text's score is its negative log-likelihood, all characters counted, by letter: over the characters in words that are
not of SYMBOLS. So what stands between the letters must pay for itself. The bands come from the quartiles of all documents of
a language: a score above the median by more than UPPER_BAND upper spreads (upper quartile less median), or below it
by more than LOWER_BAND lower spreads, rejects a document. A spread is at least LEAST_SPREAD, and more for short texts,
whose mean varies more.

Defined results: null text has no words and fails the base rule; a null language is a language of its own; repeated
rows count each time; null ids give a row each; texts of any length are scored whole; an empty table gives no rows; extra
columns are ignored by the query and kept by `kept_rows`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bucketloom.llm.common import TEXTS_A_TASK, checked_broadcast, documents, drop_listed, release_memory, small_batches, stash

ORDER = 4
#: Entries of a model that is broadcast: 12 bytes each.
MODEL_ROWS = 4_000_000
#: Fixed value: the odd multiplier of Fibonacci hashing, 2**64 / golden ratio.
MIX = 0x9E3779B97F4A7C15
START = 2
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Chosen on the labels of even doc_id at sf0.1; the README has recall and loss, on odd doc_id too.
UPPER_BAND, LOWER_BAND = 9.0, 10.0
LEAST_SPREAD = 0.005
#: Variance of one character's log-probability, which a text of n letters divides by n.
CHAR_VARIANCE = 0.3
#: Grams that a counting task holds before it passes them on.
HELD = 1_000_000
RUN_BYTES = 4_000_000
#: The codes of 16 bits that no character of the first plane has (surrogates and private use).
FREE, N_FREE = 0xD800, 0xF900 - 0xD800


HALVES = (0, 1)
#: What a null language is called.
NO_LANGUAGE = " null"


def half_of(text: Column) -> Column:
    """The half of the texts that a text is in; equal texts are in one."""
    return F.pmod(F.xxhash64(text, F.lit("half")), F.lit(2)).cast("int")


def language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(NO_LANGUAGE))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams, one for each character, and the number of characters of each text."""
    pad = chr(START) * (ORDER - 1)
    n = np.fromiter((len(x or "") for x in texts), "int64", len(texts))
    points = np.frombuffer((pad + pad.join(x or "" for x in texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(points > 0xFFFF, FREE + points % N_FREE, points).astype("uint64")
    packed = code[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        packed |= code[ORDER - 1 - back : len(code) - back] << np.uint64(16 * back)
    text_of = np.repeat(np.arange(len(n)), n)
    return packed[np.arange(len(text_of)) + text_of * (ORDER - 1)], n


def text_runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of about RUN_BYTES of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + RUN_BYTES)))
        yield batch.slice(begin, end - begin)
        begin = end


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n0, n1) over all of docs (lang, text): the counts of the texts of each half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for (lang, half), parts in held.items():
                gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype("int64")
                columns = [pa.array([lang] * len(gram), "string"), pa.array([half] * len(gram), "int32"), pa.array(gram.view("int64")), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "half", "gram", "n"])

        for b in batches:
            for part in text_runs(b):
                langs, halves = np.array(part["lang"].to_pylist(), dtype=object), part["half"].to_numpy()
                texts = part["text"].to_pylist()
                for lang, half in dict.fromkeys(zip(langs, halves.tolist(), strict=True)):
                    packed, _ = grams([texts[k] for k in np.flatnonzero((langs == lang) & (halves == half))])
                    found = pc.value_counts(pa.array(packed))
                    held.setdefault((lang, half), []).append((found.field(0).to_numpy(), found.field(1).to_numpy()))
                    size += len(found)
                if size > HELD:
                    yield from merged()
                    held, size = {}, 0
        yield from merged()
        release_memory()

    each = docs.select(language(F.col("lang")).alias("lang"), half_of(F.col("text")).alias("half"), "text").mapInArrow(run, "lang string, half int, gram bigint, n bigint")
    return each.groupBy("lang", "gram").agg(*[F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in HALVES])


def _low(gram: Column, chars: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (16 * chars)) - 1)) if chars < 4 else gram


def kneser_ney(counts: DataFrame, max_langs: int = 10_000) -> DataFrame:
    """(lang, gram, n0, n1, logp0, logp1) for the grams of counts, interpolated modified Kneser-Ney. logp0 is by the
    model of the counts n0 alone and logp1 by that of n1 alone; each backs off for what its half does not hold.
    counts is read many times, so it should be a table."""
    levels, n_grams = {ORDER: counts}, counts.count()
    for k in range(ORDER - 1, 0, -1):  # how many characters stand before each shorter gram
        before = [F.sum((F.col(f"n{h}") > 0).cast("long")).alias(f"n{h}") for h in HALVES]
        levels[k] = stash(levels[k + 1].groupBy("lang", _low(F.col("gram"), k).alias("gram")).agg(*before), f"grams{k}", rows=n_grams)

    lower = None
    for k in range(1, ORDER + 1):
        with_n = [F.sum((F.col(f"n{h}") == i).cast("double")).alias(f"n{h}_{i}") for h in HALVES for i in (1, 2, 3, 4)]
        seen = levels[k].groupBy(F.col("lang").alias("d_lang")).agg(*with_n, F.count(F.lit(1)).cast("double").alias("kinds"))

        def bounded(h: int, i: int) -> Column:
            one, two = F.col(f"n{h}_1"), F.col(f"n{h}_2")
            y = F.when(one > 0, one / (one + 2 * two)).otherwise(F.lit(0.5))
            return F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{h}_{i + 1}"), F.col(f"n{h}_{i}")), F.lit(0.5 * i))))

        seen = seen.select("d_lang", "kinds", *[bounded(h, i).alias(f"d{h}_{i}") for h in HALVES for i in (1, 2, 3)])
        seen, _ = checked_broadcast(stash(seen, f"discounts{k}", rows=max_langs), max_langs)
        t = levels[k].join(seen, F.col("lang") == F.col("d_lang")).withColumn("context", F.shiftrightunsigned("gram", 16))
        context = Window.partitionBy("lang", "context")
        for h in HALVES:
            n = F.col(f"n{h}")
            t = t.withColumn(f"discount{h}", F.when(n == 0, 0.0).when(n == 1, F.col(f"d{h}_1")).when(n == 2, F.col(f"d{h}_2")).otherwise(F.col(f"d{h}_3")))
            total = F.sum(n).over(context)
            t = t.withColumn(f"own{h}", F.coalesce(F.try_divide(n - F.col(f"discount{h}"), total), F.lit(0.0)))
            t = t.withColumn(f"back{h}", F.coalesce(F.try_divide(F.sum(f"discount{h}").over(context), total), F.lit(1.0)))
        if lower is None:
            below = {h: 1 / F.col("kinds") for h in HALVES}
        else:
            shorter = lower.select(F.col("lang").alias("b_lang"), F.col("gram").alias("b_gram"), *[F.col(f"p{h}").alias(f"b_p{h}") for h in HALVES])
            t = t.join(shorter, (F.col("lang") == F.col("b_lang")) & (_low(F.col("gram"), k - 1) == F.col("b_gram")))
            below = {h: F.col(f"b_p{h}") for h in HALVES}
        lower = t.select("lang", "gram", *[f"n{h}" for h in HALVES], *[(F.col(f"own{h}") + F.col(f"back{h}") * below[h]).alias(f"p{h}") for h in HALVES])
        if 1 < k < ORDER:
            lower = stash(lower, f"p{k}", rows=n_grams)
    return lower.select("lang", "gram", *[f"n{h}" for h in HALVES], *[F.log(f"p{h}").alias(f"logp{h}") for h in HALVES])


def hashed(half: int, lang: str, packed: np.ndarray) -> np.ndarray:
    """64-bit hashes of a language's grams, for the texts of one half."""
    salt = np.uint64(xxhash.xxh64_intdigest(f"{half}{lang}".encode("utf-8", "surrogatepass")))
    with np.errstate(over="ignore"):
        x = (packed ^ salt) * np.uint64(MIX)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
        return x ^ (x >> np.uint64(32))


def train(docs: DataFrame) -> DataFrame:
    """(key, logp): the entries of the models of both halves, for the texts that each is asked about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, packed = np.array(b["lang"].to_pylist(), dtype=object), b["gram"].to_numpy().view("uint64")
            for half in HALVES:  # a half's texts are scored by the model of the other one
                key = np.empty(len(packed), "uint64")
                for lang in dict.fromkeys(langs):
                    at = langs == lang
                    key[at] = hashed(half, lang, packed[at])
                own = pa.RecordBatch.from_arrays([pa.array(key.view("int64")), b[f"n{half}"], b[f"logp{1 - half}"].cast("float32")], ["key", "n", "logp"])
                yield own.filter(pc.greater(own["n"], 0)).select(["key", "logp"])

    counts = stash(gram_counts(docs), "grams")
    return stash(kneser_ney(counts).mapInArrow(run, "key bigint, logp float"), "model", rows=len(HALVES) * counts.count())


def arrays(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A model of MODEL_ROWS entries or fewer as sorted hashes and their log-probabilities."""
    table = model.toArrow()
    key, logp = table["key"].to_numpy().view("uint64"), table["logp"].to_numpy()
    order = np.argsort(key)
    return key[order], logp[order]


def log_likelihoods(half: int, lang: str, texts: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The sum of log-probabilities of each text."""
    packed, n = grams(texts)
    if not len(packed):
        return np.zeros(len(n))
    coded = pa.array(packed).dictionary_encode()
    key = hashed(half, lang, coded.dictionary.to_numpy())
    at = np.minimum(np.searchsorted(model[0], key), len(model[0]) - 1)
    logp = np.where(model[0][at] == key, model[1][at], np.float32(-20))
    sums = np.append(0, np.cumsum(logp[coded.indices.to_numpy()], dtype="float64"))
    ends = np.cumsum(n)
    return sums[ends] - sums[ends - n]


def joined_log_likelihoods(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(l_lang, l_key, log_likelihood) of each distinct text of docs (doc_id, lang, text_key, half, text): its grams, counted
    in the text, meet the model in a join; a text sends a gram once, so no key has more rows than there are texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_runs(b):
                langs, halves, keys = part["lang"].to_pylist(), part["half"].to_pylist(), part["text_key"].to_pylist()
                for lang, half, name, text in zip(langs, halves, keys, part["text"].to_pylist(), strict=True):
                    packed, _ = grams([text])
                    found = pc.value_counts(pa.array(packed))
                    key = hashed(half, lang, found.field(0).to_numpy())
                    n = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, "string"), pa.array([name] * n, "int64"), pa.array(key.view("int64")), found.field(1)], ["l_lang", "l_key", "key", "n"])

    each = docs.mapInArrow(run, "l_lang string, l_key bigint, key bigint, n bigint")
    copies = docs.groupBy(F.col("lang").alias("c_lang"), F.col("text_key").alias("c_key")).agg(F.count(F.lit(1)).alias("copies"))
    met = each.join(model.select(F.col("key").alias("m_key"), "logp"), F.col("key") == F.col("m_key"), "left")
    sums = met.groupBy("l_lang", "l_key").agg(F.sum(F.col("n") * F.coalesce(F.col("logp").cast("double"), F.lit(-20.0))).alias("total"))
    return sums.join(copies, (F.col("l_lang") == F.col("c_lang")) & (F.col("l_key") == F.col("c_key"))).select("l_lang", "l_key", (F.col("total") / F.col("copies")).alias("log_likelihood"))


def rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) < len(triples):
        often, end = Counter(triples), 0
        for k, t in enumerate(triples):
            if often[t] > 1:
                repeated += k + 3 - max(k, end)
                end = k + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


NAMES = ["doc_id", "lang", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_likelihood"]


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text) to doc_id, lang, text_key, n_words, the four counts, log_likelihood."""
    held = model.limit(MODEL_ROWS + 1).count() <= MODEL_ROWS
    shared = docs.sparkSession.sparkContext.broadcast(arrays(model)) if held else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_runs(b):
                texts, langs, halves = part["text"].to_pylist(), np.array(part["lang"].to_pylist(), dtype=object), part["half"].to_numpy()
                likely = np.zeros(len(texts))
                if shared is not None:
                    for lang, half in dict.fromkeys(zip(langs, halves.tolist(), strict=True)):
                        at = np.flatnonzero((langs == lang) & (halves == half))
                        likely[at] = log_likelihoods(half, lang, [texts[k] for k in at], shared.value)
                counted = np.array([rules(x) for x in texts], dtype="int64").reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["lang"], part["text_key"], *(pa.array(counted[:, k]) for k in range(5)), pa.array(likely)], NAMES)
        release_memory()

    schema = "doc_id bigint, lang string, text_key bigint, " + ", ".join(f"{c} bigint" for c in NAMES[3:8]) + ", log_likelihood double"
    told = docs.select(F.col("doc_id").cast("bigint"), language(F.col("lang")).alias("lang"), F.xxhash64("text").alias("text_key"), half_of(F.col("text")).alias("half"), "text")
    scored = told.mapInArrow(run, schema)
    if held:
        return scored
    likely = joined_log_likelihoods(told, model)
    scored = scored.drop("log_likelihood").join(likely, (F.col("lang") == F.col("l_lang")) & (F.col("text_key") == F.col("l_key")), "left")
    return scored.withColumn("log_likelihood", F.coalesce("log_likelihood", F.lit(0.0))).select(*NAMES)


def verdicts(docs: DataFrame) -> DataFrame:
    """What `score` gives with log_ppl, base_failed and kept."""
    total = docs.count()
    with small_batches(docs.sparkSession):
        scored = stash(score(docs, train(docs)), "scores", rows=total, a_file=TEXTS_A_TASK)
    letters = F.greatest(F.col("word_chars") - F.col("n_symbols"), F.lit(1))
    t = scored.withColumn("log_ppl", -F.col("log_likelihood") / letters).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    q = F.percentile_approx("log_ppl", F.lit([0.25, 0.5, 0.75]), 10_000)
    bands = t.where("not base_failed").groupBy(F.col("lang").alias("q_lang")).agg(q.alias("q"))
    between = lambda a, b: F.greatest(F.lit(LEAST_SPREAD), F.get("q", F.lit(b)) - F.get("q", F.lit(a)))
    bands = bands.select("q_lang", F.get("q", F.lit(1)).alias("middle"), between(0, 1).alias("lower"), between(1, 2).alias("upper"))
    bands, _ = checked_broadcast(stash(bands, "bands", rows=10_000), 10_000)
    t = t.join(bands, F.col("lang") == F.col("q_lang"), "left")
    off = F.col("log_ppl") - F.col("middle")
    spread, band = F.when(off > 0, F.col("upper")).otherwise(F.col("lower")), F.when(off > 0, F.lit(UPPER_BAND)).otherwise(F.lit(LOWER_BAND))
    far = F.abs(off) > band * F.sqrt(spread * spread + CHAR_VARIANCE / letters / (UPPER_BAND * UPPER_BAND))
    return t.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).drop("q_lang")


def kept_rows(docs: DataFrame) -> DataFrame:
    """docs without the rejected rows, all columns kept."""
    gone = stash(verdicts(docs).where("not kept").select("doc_id", "text_key").distinct(), "rejected", rows=docs.count())
    marked = docs.withColumn("__bl_text_key", F.xxhash64("text"))
    return drop_listed(marked, gone, ["doc_id", "text_key"], ["doc_id", "__bl_text_key"], F.col("text_key"), F.col("__bl_text_key")).drop("__bl_text_key")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl"]
    return verdicts(documents(spark, sf_dir)).select(*out)
