"""Best-fit packing with Martello-Toth dominance reduction.

Texts are tokenised in place; a document's ids end with END. Documents over the capacity are cut into full pieces with
the shorter one first, so a full piece is a sequence by itself and only the first pieces have to be packed.

Documents have places in a stream: the order of their table's files and of the rows in them, which is the order that
source mixing wrote. A window is WINDOW documents in a row; each is packed by itself, in one task that holds its narrow
rows, so what is packed together was mixed together. Lengths are below the capacity, so a window is a histogram:

1. reduction: for each length a, longest first, and again until nothing changes: if no piece fits beside a, {a}; if the
   longest b that fits fills the sequence, or no two pieces fit beside a, or those that fit are no longer than b
   together, {a, b}; if two at most fit and the best two are b and a shorter y such that no two pieces over y fit,
   {a, b, y}. Such a set dominates every other one with a: whatever stands beside a there fits into the places of b and
   y. So as many of these sets as there are get fixed, and some optimal packing has them;
2. best fit, longest first, for what is left.

A solution is a list of patterns (lengths in a sequence, how often); pieces of one length are alike and fill the patterns
in the order of the stream. A sequence is named by the first place in the stream that it holds, so names rise with it.

Defined results: null and empty texts are one END token; null ids and repeated rows are packed like any other; an empty
table gives no rows; extra columns are ignored; texts of any length are tokenised whole.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bucketloom.llm.common import BROADCAST_ROWS, TEXTS_A_TASK, checked_broadcast, documents, release_memory, small_batches, stash

CAPACITY = 1024
END = 2
END_BYTES = struct.pack("<I", END)
#: Fixed value: the word pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker keeps the ids of so many words, and of none longer than this.
CACHED_WORDS, CACHED_CHARS = 200_000, 48
#: Texts are taken in runs of about so many bytes.
RUN_BYTES = 4_000_000
#: Documents that are packed together. A window costs one sequence more at most than a larger one would.
WINDOW = 8192
#: White space in any script, and where it makes the cut at spaces and line ends tokenise in another way than the text.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNSAFE = rf"^{SPACE}|{SPACE}{SPACE}{SPACE}|{SPACE}{SPACE}\z|\t"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 bytes stand for themselves,
    the others, in turn, are the letters from 256 on."""
    plain = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Words(dict):
    """Ids, as little-endian bytes, of what stands after a space, or from a line end, up to the next of either.

    `tokenizers` defines the ids. Where ids rise in the order of the merges, rank-driven merging by `tiktoken` over the
    same vocabulary gives the same ids several times faster, so words go there; else they go through `tokenizers` too.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.path, self.slow = path, None
        self.special = [x["content"] for x in whole["added_tokens"]]
        vocabulary, letters, before = whole["model"]["vocab"], byte_letters(), whole["pre_tokenizer"] or {}
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in whole["model"]["merges"]]
        self.fast = None
        if made == sorted(set(made)) and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not whole["normalizer"]:
            import tiktoken

            ranks = {bytes(letters[c] for c in w): i for w, i in vocabulary.items() if w not in self.special}
            self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lead = len(self.ids(" ") + self.ids("\n"))

    def whole_ids(self, text: str) -> list[int]:
        """By `tokenizers` itself, which is loaded only if some text needs it."""
        if self.slow is None:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def has_special(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        for x in self.special:
            out |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        return out

    def ids(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.special):
            ids = self.whole_ids(text)
        else:
            ids = self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: list[str]) -> None:
        """Ids of new words in one call: tabs part them, which the word pattern keeps alone before a space or line end."""
        if len(self) + len(words) > CACHED_WORDS:
            self.clear()
        joined = "".join("\t" + (w if w[:1] == "\n" else " " + w) for w in words)
        if self.fast is None or any(x in joined for x in self.special):
            self.update((w, self.ids(w if w[:1] == "\n" else " " + w)) for w in words)
            return
        ids = np.asarray(self.fast.encode_ordinary(joined), dtype="<u4")
        (tab,) = self.fast.encode_ordinary("\t")
        at = np.append(np.flatnonzero(ids == tab) * 4, len(ids) * 4).tolist()
        raw = ids.tobytes()
        self.update(zip(words, [raw[a + 4 : b] for a, b in zip(at, at[1:])], strict=True))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text without END.

        The vocabulary's word pattern takes one space into the word after it, makes a single line end a word and never
        crosses from anything else into white space, so a text is the ids of its parts in turn: each distinct part is
        looked up once a run. Texts with longer white space, and texts with a special token, which parts the text before
        the word pattern sees it, go through whole. A line end before the text gives its first word a part of its own kind; that one id is dropped.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False) | self.has_special(texts)
        blank = pa.scalar("", texts.type)
        lined = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", texts.type), pc.if_else(pa.array(odd), blank, texts), blank), "\n", " \n")
        parts = pc.split_pattern(lined, " ")  # each text's first part is empty
        values = parts.flatten().dictionary_encode()
        distinct = values.dictionary.to_numpy(zero_copy_only=False).tolist()
        long = {w: self.ids(w if w[:1] == "\n" else " " + w) for w in distinct if len(w) > CACHED_CHARS}
        new = [w for w in distinct if w not in self and w not in long]
        if len(self) + len(new) > CACHED_WORDS:
            self.clear()
            new = [w for w in distinct if w not in long]
        if new:
            self.learn(new)
        get = self.__getitem__ if not long else lambda w: long[w] if w in long else self[w]
        each = list(map(get, distinct))
        size, word = np.fromiter(map(len, each), "int64", len(each)), values.indices.to_numpy()
        raw, ends = b"".join(map(each.__getitem__, word.tolist())), np.cumsum(size[word])
        at = np.append(0, ends)[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            # the empty first part stands for one space: its ids are left out with the line end's
            yield self.ids(texts[k].as_py()) if odd[k] else raw[a + self.lead : b]


#: One for each tokenizer in a Python worker; Spark keeps its workers, so later tasks find the words of earlier ones.
_WORDS: dict[str, Words] = {}


def words_of(tokenizer_path: str) -> Words:
    if tokenizer_path not in _WORDS:
        _WORDS[tokenizer_path] = Words(tokenizer_path)
    return _WORDS[tokenizer_path]


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than the capacity."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def in_stream(docs: DataFrame) -> DataFrame:
    """doc_id, text, file, row: where a row of docs stands. Rows that are not read from Parquet files are written to some first."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    own = [F.col("doc_id").cast("bigint").alias("doc_id"), "text"]
    try:
        return docs.select(*own, *where)
    except AnalysisException:
        return stash(docs.select(*own), "texts").select("doc_id", "text", *where)


def pieces(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) to one row a piece: doc_id, piece, start, length, ids_crc32, file, row, and ids if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bucketloom.llm.packing import words_of

        words = words_of(tokenizer_path)
        for b in batches:
            for part in runs(b):
                at, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": []}
                kept = []
                for row, ids in enumerate(words.encode(part["text"])):
                    ids += END_BYTES
                    for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                        piece = ids[4 * start : 4 * (start + n)]
                        at.append(row)
                        for c, v in zip(out, (k, start, n, zlib.crc32(piece)), strict=True):
                            out[c].append(v)
                        if with_ids:
                            kept.append(np.frombuffer(piece, "<u4").astype("int64"))
                rows = pa.array(at, "int64")
                columns = [part["doc_id"].take(rows), pa.array(out["piece"], "int32"), *(pa.array(out[c], "int64") for c in ("start", "length", "ids_crc32")), part["file"].take(rows), part["row"].take(rows)]
                names = ["doc_id", *out, "file", "row"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        release_memory()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, file string, row bigint" + (", ids array<bigint>" if with_ids else "")
    return in_stream(docs).mapInArrow(run, schema)


def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of about RUN_BYTES of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        done = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + RUN_BYTES)))
        yield batch.slice(begin, end - begin)
        begin = end


def dominating(a: int, sizes: list[int], left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """The lengths beside a in a set that dominates every other set with a, if the rules of the module find one."""
    free = capacity - a
    rest = lambda s: left[s] - (s == a)  # noqa: E731  how many of a length there are beside this one
    small: list[int] = []
    for s in sizes:
        small += [s] * min(3 - len(small), rest(s))
        if len(small) == 3 or s > free:
            break
    if not small or small[0] > free:
        return ()
    k = bisect_right(sizes, free) - 1
    b = sizes[k] if rest(sizes[k]) else sizes[k - 1]
    if b == free or len(small) < 2 or small[0] + small[1] > free:
        return (b,)
    if len(small) == 3 and sum(small) <= free:
        return None
    best, x, y = 0, 0, 0  # the two that fill most, with the longest of them
    low, high = 0, k
    while low <= high:
        s, t = sizes[low], sizes[high]
        if s + t > free or not rest(t) or (s == t and rest(s) < 2):
            high -= 1
        else:
            if rest(s) and s + t > best:
                best, x, y = s + t, t, s
            low += 1
    if b >= best:
        return (b,)
    if b != x:
        return None
    over: list[int] = []
    for s in sizes[bisect_right(sizes, y) :]:
        over += [s] * min(2 - len(over), rest(s))
        if len(over) == 2:
            break
    return (x, y) if len(over) < 2 or sum(over) > free else None


def reduce_exactly(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes the sets out of left that some optimal packing holds, and returns them: (lengths, times)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes, changed = sorted(left), True
    while changed:
        changed = False
        for a in reversed(list(sizes)):
            while left.get(a) and (beside := dominating(a, sizes, left, capacity)) is not None:
                lengths = (a, *beside)
                times = min(left[s] // lengths.count(s) for s in lengths)
                fixed.append((lengths, times))
                for s in set(lengths):
                    left[s] -= lengths.count(s) * times
                    if not left[s]:
                        del left[s]
                        sizes.remove(s)
                changed = True
    return fixed


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence that it fits, on groups of equal sequences: (lengths, times)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(space: int, lengths: tuple[int, ...], times: int) -> None:
        if times:
            if space not in open_:
                insort(spaces, space)
            open_.setdefault(space, []).append((lengths, times))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            k = bisect_left(spaces, s)
            if k == len(spaces):
                each = min(n, capacity // s)
                put(capacity - each * s, (s,) * each, n // each)
                n %= each
                continue
            space = spaces[k]
            lengths, times = open_[space].pop()
            if not open_[space]:
                del open_[space]
                spaces.pop(k)
            each = min(n, space // s)
            used = min(times, n // each)
            put(space, lengths, times - used)
            put(space - each * s, lengths + (s,) * each, used)
            n -= used * each
    return [p for ps in open_.values() for p in ps]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], list[tuple[tuple[int, ...], int]]]:
    """(fixed by the reduction, packed by best fit): patterns (lengths, times) that use each length as often as counts says."""
    left = {s: n for s, n in counts.items() if n}
    return reduce_exactly(left, capacity), best_fit(left, capacity)


def placed(length: np.ndarray, name: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence_id, offset, reduced) of pieces with rising names: the name of a sequence is the least in it."""
    order = np.argsort(length, kind="stable")
    ends = dict(zip(*np.unique(length, return_index=False, return_counts=True), strict=True))
    counts = {int(s): int(n) for s, n in ends.items()}
    next_ = {}
    at = 0
    for s in sorted(counts):
        next_[s] = at
        at += counts[s]
    fixed, rest = solve(counts, capacity)
    sequence, offset, reduced = np.zeros(len(length), "int64"), np.zeros(len(length), "int64"), np.zeros(len(length), bool)
    for patterns, by_rule in ((fixed, True), (rest, False)):
        for lengths, times in patterns:
            for _ in range(times):
                held, used = [], 0
                for s in lengths:
                    i = order[next_[s]]
                    next_[s] += 1
                    held.append(i)
                    offset[i] = used
                    used += s
                sequence[held] = name[held].min()
                reduced[held] = by_rule
    return sequence, offset, reduced


#: Pieces of one document are named by its place times this, plus their number.
PIECES = 1 << 24


def pack(cut: DataFrame, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """cut (as of `pieces`) with sequence_id, offset and reduced: whether the reduction fixed the sequence."""
    sizes = cut.groupBy(F.col("file").alias("f_file")).agg((F.max("row") + 1).alias("n"))
    before = Window.orderBy(F.length("f_file"), "f_file").rowsBetween(Window.unboundedPreceding, -1)
    starts, _ = checked_broadcast(stash(sizes.select("f_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("f_start")), "starts"), BROADCAST_ROWS)
    own = [f for f in cut.schema.fields if f.name not in ("file", "row")]
    place = F.col("f_start") + F.col("row")
    named = cut.join(starts, F.col("file") == F.col("f_file")).select(*[f.name for f in own], (place * PIECES + F.col("piece")).alias("name"), F.floor(place / window).cast("bigint").alias("window"))
    full = named.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("name"), "offset": F.lit(0).cast("bigint"), "reduced": F.lit(True)})

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("name")
        sequence, offset, reduced = placed(t["length"].to_numpy(), t["name"].to_numpy(), capacity)
        for c, v in (("sequence_id", sequence), ("offset", offset), ("reduced", reduced)):
            t = t.append_column(c, pa.array(v))
        return t.drop_columns(["name", "window"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own)
    short = named.where(F.col("length") < capacity).groupBy("window").applyInArrow(run, f"{fields}, sequence_id bigint, offset bigint, reduced boolean")
    return full.select(*short.columns).unionByName(short)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    with small_batches(docs.sparkSession):
        cut = stash(pieces(docs, tokenizer_path or tokenizer_file()), "pieces", rows=docs.count(), a_file=TEXTS_A_TASK)
    return pack(cut)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
