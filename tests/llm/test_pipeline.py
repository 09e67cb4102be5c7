"""The pipeline against a plain version of each stage on its own input, and the entry module without its parts."""

import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("bucketloom.llm")

import corpus_pipeline  # noqa: E402
from bucketloom.llm import mixing, packing, quality  # noqa: E402
from bucketloom.llm.common import documents, stash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, phase long, label string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def corpus():
    r = random.Random(12)
    words = [f"w{i}" for i in range(600)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [prose(r.randint(55, 160)) for _ in range(60)]
    near = prose(100).split()
    texts += [" ".join(near[:k] + ["other"] + near[k + 1 :]) for k in range(5, 95, 15)]
    texts += [texts[0], texts[0].upper(), texts[1], prose(20), "a b c " * 60, None, "", " ".join("".join(r.choice("bcdfgqx#%&") for _ in range(9)) for _ in range(80)), prose(1500)]
    rows = [(k if k % 13 else None, t, "en" if k % 9 else None, f"s{min(k % 7, 2)}" if k % 5 else None, len(t or ""), "clash", 7, "x") for k, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[13]]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of each stage and its output, as rows in the order of their files."""
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    docs, out = documents(spark, d), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stash(stage(spark, docs, d), name.replace(" ", "-"))
        out.append((before, docs))
    return d, out


def test_documents_keep_their_columns(stages):
    _, out = stages
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mixing", "packing"]
    assert all(after.columns == before.columns for before, after in out[:-1])


def test_quality_stage(stages):
    before, after = stages[1][0]
    verdict = {(r.doc_id, r.text_key): r.kept for r in quality.verdicts(before).collect()}
    from pyspark.sql import functions as F

    marked = before.withColumn("k", F.xxhash64("text")).collect()
    want = Counter((r.doc_id, r.text) for r in marked if verdict[(r.doc_id, r.k)])
    assert Counter((r.doc_id, r.text) for r in after.collect()) == want
    texts = [t for _, t in want]
    assert all(t and len(t.split()) >= 50 for t in texts) and "a b c " * 60 not in texts and not any("#" in t for t in texts) and len(texts) > 60


def test_exact_stage(stages):
    before, after = stages[1][1]
    want, rows = Counter(lower(r.text) for r in before.collect()), after.collect()
    assert Counter(lower(r.text) for r in rows) == Counter(set(want))
    most = {}
    for r in before.collect():
        most[lower(r.text)] = max(most.get(lower(r.text), -1), -1 if r.doc_id is None else r.doc_id)
    assert all((-1 if r.doc_id is None else r.doc_id) == most[lower(r.text)] for r in rows)


def test_near_stage(stages):
    before, after = stages[1][2]
    rows = before.collect()
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (lower(r.text).split() for r in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    best = {}
    for k, r in enumerate(rows):
        best[root[k]] = min(best.get(root[k], 1 << 70), 1 << 69 if r.doc_id is None else r.doc_id)
    got = after.collect()
    assert len(got) == len(best) < len(rows) and Counter(1 << 69 if r.doc_id is None else r.doc_id for r in got) == Counter(best.values())


def test_mixing_stage(stages):
    before, after = stages[1][3]
    rows = after.collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, before.collect()))
    n = Counter(r.source or "" for r in rows)
    weights = mixing.whole_weights({s: c**mixing.TEMPERATURE for s, c in n.items()})
    plan = mixing.schedule({s: -(-c // mixing.BLOCK_ROWS) for s, c in n.items()}, weights)
    want = [s for s, j, *_ in plan for _ in range(min(mixing.BLOCK_ROWS, n[s] - j * mixing.BLOCK_ROWS))]
    assert [r.source or "" for r in rows] == want


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    before, after = stages[1][4]
    tokenizer, want, places = Tokenizer.from_file(packing.tokenizer_file()), Counter(), []
    for place, r in enumerate(before.collect()):
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(len(ids), 1024)
        for k, (a, b) in enumerate([(0, first)] + [(s, s + 1024) for s in range(first, len(ids), 1024)]):
            want[(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
            places.append((b - a, place * packing.PIECES + k))
    rows = after.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for g in by.values():
        g.sort(key=lambda r: r.offset)
        assert [r.offset for r in g] == list(np.cumsum([r.length for r in g]) - [r.length for r in g]) and sum(r.length for r in g) <= 1024
    assert len(by) <= -(-sum(r.length for r in rows) // 1024) + 2
    short = sorted(((n, at) for n, at in places if n < 1024), key=lambda x: x[1])
    sequence, *_ = packing.placed(np.array([n for n, _ in short]), np.array([at for _, at in short]))
    assert set(by) == set(sequence.tolist()) | {at for n, at in places if n == 1024}


def test_mixing_takes_effect(spark, stages):
    """Without the mix the sequences are others."""
    _, out = stages
    sequences = lambda df: Counter(frozenset((r.doc_id, r.piece, r.ids_crc32) for r in g) for g in grouped(df).values())

    def grouped(df):
        by = {}
        for r in df.collect():
            by.setdefault(r.sequence_id, []).append(r)
        return by

    order = lambda df: [r.doc_id for r in sorted(df.where("piece = 0 and offset = 0").collect(), key=lambda r: r.sequence_id)]
    mixed, plain = out[4][1], packing.packed(out[3][0])
    assert (sequences(mixed), order(mixed)) != (sequences(plain), order(plain))


def test_run(spark, stages):
    d, out = stages
    key = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, d)) == key(out[-1][1])


def test_empty_run(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("gone, n", [(["corpus_pipeline"], 10), (["bucketloom.llm", "corpus_pipeline"], 0)])
def test_entry_without_parts(gone, n):
    root = Path(corpus_pipeline.__file__).resolve().parent
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {gone!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = list(e.queries())
assert "flagship" in names and "pipeline" not in names and sum(x.startswith("op") for x in names) == {n}, names
assert all(x in names for x in e.oracle_sql())
"""
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_tables_are_few_files_without_checksum_files(spark, tmp_path, monkeypatch):
    """Hadoop starts a process for each local file, each checksum file and each task's folder that it makes."""
    from pyspark.sql import functions as F

    from bucketloom.llm import common, exact_dedup, near_dedup

    made = []

    def noted(df, name, partition_by=(), stash=common.stash, **more):
        out = stash(df, name, partition_by, **more)
        made.append((name, [Path(x.removeprefix("file:")) for x in out.inputFiles()]))
        return out

    cores = spark.sparkContext.defaultParallelism
    spark.createDataFrame(corpus() * 4, SCHEMA).repartition(5 * cores, F.rand(3)).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for at in (common, quality, exact_dedup, near_dedup, mixing, packing):
        monkeypatch.setattr(at, "stash", noted)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a split for each file
        docs = documents(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() > 4 * cores
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    many = {"scores": 1, "rejected": 1, "digests": exact_dedup.SLICES, "in-groups": 1, "sketches": 1, "sets": 1, "keys": 1, "pieces": 1}
    assert many.keys() <= {name for name, _ in made}
    assert [(name, len(files)) for name, files in made if len(files) > cores * many.get(name, len(files))] == []
    assert [x for _, files in made for f in files for x in f.parent.glob(".*.crc")] == []
