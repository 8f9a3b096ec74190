"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Documents are cut into full windows from their start; what remains of each (1 to window - 1 tokens) is packed best-fit
decreasing over the whole corpus. Windows with the same remaining capacity are interchangeable, so the state of
best-fit decreasing is a count of open windows for each remaining capacity: a segment tree over capacities finds the
tightest one that still fits, and a whole class of equally long pieces is placed in one step. What the driver holds is
bounded by the window length, not by the corpus: a histogram of piece lengths goes in, a list of placements comes out,
and the pieces find their places on the executors by their rank among pieces of the same length.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailgraph.llm.common import ship, stored

#: Words in each of the two generations that a Python worker remembers, also from task to task. When the young one is full, the
#: old one goes and words that are met again move on. Only speed depends on it.
REMEMBERED_WORDS = 60_000

#: Texts whose words are looked up together.
TEXTS_AT_ONCE = 2048

#: Pieces of one length that a single sort ranks, about; more are dealt over several.
RANKED_TOGETHER = 1024


class CapacityTree:
    """A segment tree over remaining capacities that finds the smallest non-empty one from a given capacity up."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = bytearray(2 * self.leaves)

    def set(self, remaining: int, filled: bool) -> None:
        at = remaining + self.leaves
        self.filled[at] = filled
        while at > 1:
            at >>= 1
            self.filled[at] = self.filled[2 * at] or self.filled[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if self.filled[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.filled[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.filled[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for counts[length] pieces of each length.

    Rows (length, rank from, rank to, pieces in a window, first window, offset): the piece of that rank among those of its
    length goes to window first + (rank - from) // pieces, at offset + (rank - from) % pieces * length.
    """
    tree, open_windows, plan, new = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], [], 0

    def put(remaining: int, first: int, end: int) -> None:
        if remaining and first < end:
            open_windows[remaining].append((first, end))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                first, new = new, new - (-left // (capacity // length))
                end = new
            else:
                first, end = open_windows[remaining].popleft()
            each = remaining // length
            used = min(end - first, -(-left // each))
            pieces = min(left, used * each)
            if first + used < end:
                open_windows[remaining].appendleft((first + used, end))
            if not open_windows[remaining]:
                tree.set(remaining, False)
            plan.append((length, rank, rank + pieces, each, first, capacity - remaining))
            full, rest = divmod(pieces, each)
            put(remaining - each * length, first, first + full)
            if rest:
                put(remaining - rest * length, first + full, first + full + 1)
            rank, left = rank + pieces, left - pieces
    return plan


class WordCodes:
    """Ids of words as little-endian bytes, by a tokenizer that lowers case, drops white space and ends its tokens there.

    A word in lower case without its last full stop or comma is encoded once; those of letters only are encoded together,
    since each ends with the only id of a word's end.
    """

    def __init__(self, tokenizer_json: str, remembered: int = REMEMBERED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_str(tokenizer_json), remembered
        bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        at_blanks = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytes_only]}
        #: The same merges for words that need neither normalising nor splitting.
        self.plain = Tokenizer.from_str(json.dumps(json.loads(tokenizer_json) | {"normalizer": None, "pre_tokenizer": at_blanks}))
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        #: Ids of nothing, a full stop and a comma, one after the other.
        self.tails = [np.frombuffer(x, "<u4") for x in self.encode(["", ".", ","])]
        for probe in ("a b\nc", "Ab.", "x, y", "Été Straße", " ", "\n"):
            if encoded(pa.array([probe]), self)[0].tobytes() != self.encode([probe])[0]:
                raise ValueError("the tokenizer must lower case, drop white space and end its tokens there")

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, met: set[str]) -> None:
        """Remembers words that the young generation lacks."""
        again = met & self.old.keys()
        self.words.update((w, self.old[w]) for w in again)
        met = met - again
        plain = [x for x in met if x.isalpha() and (x.isascii() or x == x.lower() and unicodedata.is_normalized("NFC", x))]
        for at in range(0, len(plain), 256):
            some = plain[at : at + 256]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            after = (np.flatnonzero(self.ends[ids]) + 1) * 4
            code = ids.tobytes()
            found = self.encode(some) if len(after) != len(some) else [code[a:b] for a, b in zip([0, *after[:-1].tolist()], after.tolist(), strict=True)]
            self.words.update(zip(some, found, strict=True))
        others = list(met.difference(plain))
        self.words.update(zip(others, self.encode(others), strict=True))

    def codes(self, words: list[str]) -> list[bytes]:
        """The codes of different words, which hold no space or line end."""
        if len(self.words) > self.remembered:
            self.old, self.words = self.words, {}
        out = list(map(self.words.get, words))
        holes = [i for i, c in enumerate(out) if c is None]
        self.learn({words[i] for i in holes})
        for i in holes:
            out[i] = self.words[words[i]]
        return out


@cache
def word_codes(tokenizer_json: str) -> WordCodes:
    return WordCodes(tokenizer_json)


def gathered(values: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From runs of values that lie one after the other: the runs `at`, one after the other, and their edges."""
    each = length[at]
    edges = np.concatenate([[0], np.cumsum(each)])
    shift = (np.cumsum(length) - length)[at] - edges[:-1]
    return values[np.repeat(shift, each) + np.arange(edges[-1])], edges


def encoded(texts: pa.Array, known: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and where each text's begin and end. What several words share is looked up once."""
    lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    words = lists.flatten().dictionary_encode()
    raw = words.dictionary
    low = pc.utf8_lower(raw)
    # What may lower otherwise elsewhere, or not be normal, is left to the tokenizer: all beyond Latin, and dotted capital I.
    odd = pc.match_substring_regex(raw, r"[^\x{0000}-\x{024F}]|\x{0130}")
    marked = pc.and_not(pc.match_substring_regex(low, "\\p{L}[.,]$"), odd)
    cores = pc.if_else(odd, raw, pc.if_else(marked, pc.utf8_slice_codeunits(low, 0, -1), low)).dictionary_encode()
    codes = known.codes(cores.dictionary.to_pylist())
    ids, length = np.frombuffer(b"".join(codes), "<u4"), np.fromiter(map(len, codes), np.int64, len(codes)) // 4
    # A core and its mark are two runs, each word of the texts a run of both.
    mark = np.where(marked.to_numpy(zero_copy_only=False), np.where(pc.ends_with(low, ".").to_numpy(zero_copy_only=False), 1, 2), 0)
    ids = np.concatenate([ids, *known.tails])
    length = np.concatenate([length, [len(t) for t in known.tails]])
    both = np.stack([cores.indices.to_numpy(), len(codes) + mark], axis=1).ravel()
    ids, edges = gathered(ids, length, both)
    ids, edges = gathered(ids, np.diff(edges[::2]), words.indices.to_numpy())
    offsets = lists.offsets.to_numpy()
    return ids, edges[offsets - offsets[0]]


def _pieces(tokenizer_json: Broadcast[str], end_id: int, window: int, with_ids: bool):
    """The function that turns Arrow batches (doc_id, text) into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from trailgraph.llm import packing  # the worker's own module, so that its memory of words lasts

        known = packing.word_codes(tokenizer_json.value)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                ids, edges = packing.encoded(part.column("text"), known)
                out = []
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    code = ids[a:b].tobytes() + last
                    for start in range(0, len(code), 4 * window):
                        piece = code[start : start + 4 * window]
                        out.append((i, start // 4, len(piece) // 4, zlib.crc32(piece), len(code) // 4, piece))
                if out:
                    row, *columns, pieces = zip(*out, strict=True)
                    arrays = [part.column("doc_id").take(pa.array(row, pa.int64()))] + [pa.array(c, pa.int64()) for c in columns]
                    if with_ids:
                        arrays.append(pa.array([np.frombuffer(p, "<i4") for p in pieces], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return run


def pack(docs: DataFrame, tokenizer_json: str, window: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Packs documents (doc_id, text) into windows of at most `window` tokens.

    Each document is its tokens and end_id. Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (if
    with_ids), sequence_id, offset. Null and empty texts are the end id alone; repeated rows and ids are documents of their
    own; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    word_codes(tokenizer_json)  # refuses vocabularies that can't be encoded word by word
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    run = _pieces(spark.sparkContext.broadcast(tokenizer_json), end_id, window, with_ids)
    pieces = stored(docs.select("doc_id", "text").mapInArrow(run, schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    plan = best_fit_plan(counts, window)
    plan.sort()
    columns = spark.sparkContext.broadcast(np.array(plan, dtype=np.int64).reshape(-1, 6))  # bounded by the window length

    # The rank among the pieces of a length: those before in lower buckets, and the place in the own bucket.
    parts = spark.createDataFrame([(n, -(-k // RANKED_TOGETHER)) for n, k in counts.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "buckets"))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.join(before, ["length", "bucket"])
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(order) - 1)

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = columns.value
        # Lengths and ranks rise together in the plan, so one search finds the step.
        keys = p[:, 0].astype(np.float64)
        first, n = np.searchsorted(keys, length, "left"), np.searchsorted(keys, length, "right")
        at, end = first.copy(), n
        while True:  # halving between the first and the last step of the length
            wide = end - at > 1
            if not wide.any():
                break
            middle = (at + end) // 2
            right = wide & (p[np.minimum(middle, len(p) - 1), 1] <= rank.to_numpy())
            at, end = np.where(right, middle, at), np.where(wide & ~right, middle, end)
        step = p[at]
        k = rank.to_numpy() - step[:, 1]
        return pd.DataFrame({"sequence_id": step[:, 4] + k // step[:, 3], "offset": step[:, 5] + k % step[:, 3] * length.to_numpy()})

    placed = ranked.withColumn("place", place("length", "rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    return placed.select(*names, "place.sequence_id", "place.offset")
