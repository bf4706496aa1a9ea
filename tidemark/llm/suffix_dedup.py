"""Passages that repeat, found with a sparse suffix array.

A full suffix array keeps a suffix for every word.  Here a suffix is kept only
where a minimiser stands: in every window of ``min_words // 2 + 1`` neighbouring
word groups the one of least hash is chosen by content alone, so equal passages
keep equal positions, and every passage of ``min_words`` words keeps one in its
first half.  So its suffix agrees in a half of the passage at least.

1. Suffixes whose first half stands nowhere else are dropped (by a hash, a filter).
2. The others are sorted by their words: range-partitioned on them, ties by text and
   place, so that a passage that stands in a third of all texts is cut over tasks.
3. Neighbours in that order are compared word by word, to the right and to the left;
   those that agree in ``min_words`` words are a match.
4. Neighbours have the longest match to the right, but another suffix of the same
   first half may agree further to the left.  Where the longest matches to the left
   and to the right leave room for that, and where suffixes of the same first half lie
   on both sides of a cut, the suffixes of all words in question are kept as well and
   compared by their first ``min_words`` words.
5. A match is extended as far as it is seen, half a passage to the left and a whole one
   to the right; longer passages are the union of those of their minimisers.

So exactly those words are reported that lie in a passage of ``min_words`` words
with another occurrence.

Defined results: words are lower-cased runs of letters and digits; texts with
fewer than ``min_words`` words, null and empty ones have no passages; a text that
stands in several rows (repeated rows too) repeats as a whole; passages may repeat
within one text and may overlap; ``first_id`` is the least id among the texts that
were matched with parts of the passage, through others too, null if none has an id;
null ids get their rows; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefiltered, ship
from .near_dedup import text_node
from .words import mix, pieces, powers, word_hashes, words_of

ship(__name__)

MIN_WORDS = 50
#: Words in the groups whose hashes compete.
GROUP = 8
_SPAN, _WINDOW = 0, 1
#: Rows a task gathers before it hands them on.
_ROWS = 20_000


class Windows:
    """Hashes of all windows of a flat array of words, in constant time each."""

    def __init__(self, words: np.ndarray):
        up, self.undo = powers(len(words))
        self.sums = np.r_[np.uint64(0), np.cumsum(mix(words) * up, dtype=np.uint64)]

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        return mix((self.sums[starts + width] - self.sums[starts]) * self.undo[starts])


def minimisers(words: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash of the suffix's first half) of the suffixes to keep; ``offsets`` bound the texts."""
    half = min_words // 2
    width, need = half + 1, half + GROUP
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(words) < min_words:
        return none
    hashes = Windows(words)
    groups = hashes.at(np.arange(len(words) - GROUP + 1), GROUP)
    ends = np.repeat(offsets[1:], np.diff(offsets)) - offsets[0]
    starts = np.flatnonzero(np.arange(len(words)) + need <= ends)
    starts = starts[starts + width <= len(groups)]
    if not len(starts):
        return none
    best = np.lib.stride_tricks.sliding_window_view(groups, width)
    # In parts, for numpy copies what it picks.
    chosen = np.concatenate([p + best[p].argmin(axis=1) for p in np.array_split(starts, max(1, len(starts) // 50_000))])
    chosen = np.unique(chosen)
    chosen = chosen[chosen + half <= ends[chosen]]
    return chosen, hashes.at(chosen, half)


def _keeper(min_words: int):
    def keep(batches):
        for batch in batches:
            texts = batch.column("t")
            for a, b in pieces(texts):
                words, own = word_hashes(texts.slice(a, b - a))
                at, head = minimisers(words, own, min_words)
                bounds = np.searchsorted(at, own)
                place = at - np.repeat(own[:-1], np.diff(bounds))
                bounds32 = pa.array(bounds.astype(np.int32))
                whole = pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(a, b - a), pa.array(np.diff(own), pa.int64()),
                     pa.ListArray.from_arrays(bounds32, pa.array(place.astype(np.int32))),
                     pa.ListArray.from_arrays(bounds32, pa.array(head.view(np.int64)))],
                    names=["node", "n_words", "places", "heads"])
                yield whole.filter(pa.array(np.diff(own) >= min_words))

    return keep


def _around(min_words: int):
    """The words on both sides of the kept suffixes: each after a space to the left, before a space to the right."""
    half = min_words // 2

    def look(batches):
        for batch in batches:
            for k, words in enumerate(words_of(batch.column("t"))):
                places = batch.column("places")[k].as_py()
                one = pa.array(np.zeros(len(places), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(k, 1).take(one), batch.column("id").slice(k, 1).take(one), pa.array(places, pa.int32()),
                     pa.array([b"".join(b" " + w for w in words[max(p - half, 0) : p]) for p in places], pa.binary()),
                     pa.array([b"".join(w + b" " for w in words[p : p + min_words]) for p in places], pa.binary())],
                    names=["node", "id", "place", "before", "after"])

    return look


def common_words(a: bytes, b: bytes, order: str = "big") -> int:
    """Whole words that two strings share at their start, or at their end ("little")."""
    n = min(len(a), len(b))
    a, b = (a[:n], b[:n]) if order == "big" else (a[len(a) - n :], b[len(b) - n :])
    same = n - ((int.from_bytes(a, order) ^ int.from_bytes(b, order)).bit_length() + 7) // 8
    return a.count(b" ", 0, same) if order == "big" else a.count(b" ", n - same)


def neighbours(run: list[tuple], min_words: int, cut: bool):
    """Matches of the sorted suffixes (node, id, place, before, after) of one first half: (kind, node, start, end, first, window).

    ``cut``: others of the same first half may lie in another task.
    """
    half, n = min_words // 2, len(run)
    right = [common_words(x[4], y[4]) for x, y in zip(run, run[1:])]
    left = [common_words(x[3], y[3], "little") for x, y in zip(run, run[1:])]
    chain = []
    for i, x in enumerate(run):
        if i and left[i - 1] + right[i - 1] >= min_words:
            chain.append(i)
        else:
            yield from _chained(run, chain, left, right)
            chain = [i]
    yield from _chained(run, chain, left, right)
    # How far left any two suffixes agree: neighbours in the order of what is before them.
    if cut:
        most, longest = [half] * n, [min_words] * n
    elif n > 2:
        order = sorted(range(n), key=lambda i: run[i][3][::-1])
        most, longest = [0] * n, [max(right[max(i - 1, 0) : i + 1]) for i in range(n)]
        for i, j in zip(order, order[1:]):
            same = common_words(run[i][3], run[j][3], "little")
            most[i], most[j] = max(most[i], same), max(most[j], same)
    else:
        return
    starts = [range(max(min_words - min(longest[i], run[i][4].count(b" ")), 0), min(most[i], run[i][3].count(b" "), run[i][2]) + 1) for i in range(n)]
    if cut or any(not any(d <= left[k] and min_words - d <= right[k] for k in (i - 1, i) if 0 <= k < n - 1) for i in range(n) for d in starts[i]):
        for x, own in zip(run, starts):
            before, after = x[3].split(), x[4].split()
            for d in own:
                words = b" ".join(before[len(before) - d :] + after[: min_words - d])
                yield _WINDOW, x[0], x[2] - d, x[2] - d + min_words, x[1], hashlib.md5(words).digest()


def _chained(run, chain, left, right):
    """The spans of suffixes that match from neighbour to neighbour."""
    if len(chain) > 1:
        first = min((run[i][1] for i in chain if run[i][1] is not None), default=None)
        for i, j in zip(chain, chain[1:]):
            for k in (i, j):
                yield _SPAN, run[k][0], run[k][2] - left[i], run[k][2] + right[i], first, None


_FOUND = "kind int, node binary, start_word long, end_word long, first long, window binary"


def _comparer(min_words: int):
    names, kinds = [x.split()[0] for x in _FOUND.split(", ")], [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def compare(batches):
        out, run, head, inner = [], [], None, False

        def rows():
            done = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(done, names=names)

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("node", "id", "place", "before", "after"))):
                own = x[4].split(b" ", min_words // 2)[: min_words // 2]
                if own != head:
                    out += dict.fromkeys(neighbours(run, min_words, not inner))
                    inner, run, head = head is not None, [], own
                    if len(out) > _ROWS:
                        yield rows()
                run.append(x)
            if out:
                yield rows()
        out += dict.fromkeys(neighbours(run, min_words, True))
        if out:
            yield rows()

    return compare


def _merge(batches):
    for batch in batches:
        node, starts, ends, firsts = [], [], [], []
        for k, found in enumerate(batch.column("found").to_pylist()):
            for x in sorted(found, key=lambda x: x["start_word"]):
                if node and node[-1] == k and x["start_word"] <= ends[-1]:
                    ends[-1] = max(ends[-1], x["end_word"])
                    firsts[-1] = min((y for y in (firsts[-1], x["first"]) if y is not None), default=None)
                else:
                    node.append(k)
                    starts.append(x["start_word"])
                    ends.append(x["end_word"])
                    firsts.append(x["first"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").take(pa.array(node, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, ends, firsts))],
            names=["node", "start_word", "end_word", "first_id"])


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, start_word, end_word, n_words, first_id) of every repeated passage of every row; ``key`` is a whole number."""
    own = docs.select(F.col(key), text_node(F.col(text)), F.col(text).alias("t"))
    texts = materialize(own.groupBy("node").agg(F.min(key).cast("long").alias("id"), F.count("*").alias("copies")), "texts")
    sparse = materialize(own.select("node", "t").mapInArrow(_keeper(min_words), "node binary, n_words long, places array<int>, heads array<long>")
                         .dropDuplicates(["node"]), "suffixes")
    suffixes = sparse.select("node", F.explode(F.arrays_zip("places", "heads")).alias("s")).select(
        "node", F.col("s.places").alias("place"), F.col("s.heads").alias("head"))
    spot = F.xxhash64("node", "place")
    heads = materialize(suffixes.groupBy("head").agg(F.min(spot).alias("_lo"), F.max(spot).alias("_hi")).where("_lo <> _hi"), "heads")
    with prefiltered(heads):
        alike = suffixes.join(heads.where("_lo <> _hi").select("head"), "head")
        kept = materialize(alike.groupBy("node").agg(F.sort_array(F.collect_list("place")).alias("places")), "kept")
    # The least row of a text stands for all its copies.
    places = materialize(kept.join(texts, "node").withColumnRenamed("node", "_n"), "places")
    with prefiltered(places):
        near = own.join(places.where("copies > 0"), (F.col("node") == F.col("_n")) & F.col(key).eqNullSafe(F.col("id")))
        around = materialize(near.select("node", "id", "places", "t").mapInArrow(
            _around(min_words), "node binary, id long, place int, before binary, after binary").distinct(), "around")
    ordered = around.repartitionByRange("after", "node", "place").sortWithinPartitions("after", "node", "place")
    found = materialize(ordered.mapInArrow(_comparer(min_words), _FOUND), "found")
    windows = found.where(F.col("kind") == _WINDOW)
    at = F.struct("node", "start_word")
    again = materialize(windows.groupBy("window").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.min("first").alias("least"))
                        .where("_lo <> _hi").select("window", "least"), "again")
    spans = (found.where(F.col("kind") == _SPAN).select("node", "start_word", "end_word", "first")
             .union(windows.join(again, "window").select("node", "start_word", "end_word", F.col("least").alias("first"))))
    merged = spans.groupBy("node").agg(F.collect_set(F.struct("start_word", "end_word", "first")).alias("found")).mapInArrow(
        _merge, "node binary, start_word long, end_word long, first_id long")
    # A text with copies repeats as a whole.
    copies = texts.where("copies > 1").select("node", "id")
    whole = sparse.join(copies, "node").select("node", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"),
                                               F.col("id").alias("first_id"))
    passages = materialize(merged.join(copies, "node", "left_anti").union(whole), "spans")
    return (own.select(key, "node").join(passages, "node")
            .select(key, "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_id"))
