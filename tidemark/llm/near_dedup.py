"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Texts are weighted sets of five-word shingles (a shorter text is one shingle);
the weight is the count.  ProbMinHash lets every shingle arrive at the slots of a
signature by a Poisson process whose rate is its weight and whose randomness
depends on the shingle alone.  A slot keeps the shingle that arrives first, so
two texts agree in a slot with the probability Jaccard similarity.  A shingle
stops as soon as its next arrival is later than all first arrivals.

Equal texts are one node (their MD5).  Nodes that agree in a band of the
signature are candidates: all pairs of a bucket with up to ``SMALL`` nodes, and in
a larger bucket every node with the pivot, the node that meets the most others.
Candidates are verified by the weighted Jaccard similarity of the whole texts.
So groups of near copies of any size take a number of pairs that grows with their
size, not its square.  Afterwards every node that is still outside the class of its
pivot is joined exactly with all nodes of other classes that met this pivot or one of
its class: by the shingles that the pivot lacks, with prefix and length filters.  So a
copy of a copy is found however far it is from the pivot, and all nodes that share a
bucket and are similar enough are in one class.

``near_duplicates`` gives each row its class: the least id of the rows that are
linked to it directly or through others.  Defined results: null texts count as
empty; texts without words are duplicates only of equal texts; null ids are
members of classes, whose id is the least one that is not null (null if there is
none); repeated rows are duplicates; empty tables give no rows; extra columns are
untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, prefiltered, ship, unboxed
from .components import connected_components
from .words import mix, pieces, word_hashes

ship(__name__)

SHINGLE = 5
BANDS, ROWS = 20, 4
SMALL = 32
#: Lengths of a bin differ by this factor.
_BIN = 1.05


def shingles(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = SHINGLE):
    """(text, shingle, count) for texts that are slices of a flat array of word hashes."""
    n = ends - starts
    text = np.repeat(np.arange(len(n)), n)
    left = np.repeat(ends, n) - (np.arange(len(text)) + np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n))
    flat = words[starts[0] : ends[-1]] if len(n) else words[:0]
    h = np.zeros(len(flat), np.uint64)
    for k in range(width):
        # Beyond the end of a short text nothing is added.
        ahead = np.zeros(len(flat), np.uint64)
        ahead[: max(len(flat) - k, 0)] = flat[k:]
        h = h * np.uint64(0x9FB21C651E98DF25) + np.where(left > k, ahead, np.uint64(0))
    h = mix(h)
    whole = np.repeat(np.minimum(n, width), n)
    ok = left >= whole
    text, h = text[ok], h[ok]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return text[at], h[at], np.diff(np.r_[at, len(h)]).astype(float)


def prob_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """Signatures (texts x slots): the element that arrives first in each slot."""
    first = np.full(texts * slots, np.inf)
    signature = np.zeros(texts * slots, np.uint64)
    time = np.zeros(len(element))
    r = 0
    while len(element):
        random = mix(element + np.uint64((2 * r + 1) * 0x9E3779B97F4A7C15 % 2**64))
        gap = -np.log(((random >> np.uint64(11)).astype(float) + 0.5) / 2.0**53)
        slot = (mix(random ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(slots)).astype(np.int64)
        time = time + gap / weight
        place = text * slots + slot
        np.minimum.at(first, place, time)
        won = time == first[place]
        signature[place[won]] = element[won]
        last = first.reshape(texts, slots).max(axis=1)
        on = time < last[text]
        text, element, weight, time = text[on], element[on], weight[on], time[on]
        r += 1
    return signature.reshape(texts, slots)


def _signer(bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            texts = batch.column("t")
            for a, b in pieces(texts):
                words, bounds = word_hashes(texts.slice(a, b - a))
                text, element, weight = shingles(words, bounds[:-1], bounds[1:])
                total = np.bincount(text, weight, b - a).astype(np.int64)
                signature = prob_minhash(text, element, weight, b - a, bands * rows).reshape(b - a, bands, rows)
                key = np.zeros((b - a, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for k in range(rows):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + signature[:, :, k])
                keep = np.flatnonzero(total > 0)
                flat = pa.array(key[keep].view(np.int64).ravel(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(a, b - a).take(pa.array(keep)), pa.array(total[keep], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), flat)],
                    names=["node", "n", "bands"])

    return sign


def text_node(text: Column) -> Column:
    """The identity of a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("node")


def signatures(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, n, bands): one row per different text with words."""
    own = docs.select(text_node(F.col(text)), F.col(text).alias("t"))
    signed = own.mapInArrow(_signer(bands, rows), "node binary, n long, bands array<long>")
    return signed.dropDuplicates(["node"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of the five-word shingle counts of two texts."""
    both = np.concatenate([a, b])
    starts, ends = np.array([0, len(a)]), np.array([len(a), len(both)])
    text, h, n = shingles(both.view(np.uint64), starts, ends)
    order = np.lexsort((text, h))
    text, h, n = text[order], h[order], n[order]
    twin = np.flatnonzero(h[1:] == h[:-1])
    shared = np.minimum(n[twin], n[twin + 1]).sum()
    return float(shared / (n.sum() - shared)) if len(n) else 0.0


def _sides(batch):
    """The word hashes of both texts of every row."""
    a, b = (word_hashes(batch.column(x)) for x in ("ta", "tb"))
    for i in range(batch.num_rows):
        yield a[0][a[1][i] : a[1][i + 1]], b[0][b[1][i] : b[1][i + 1]]


def _verifier(threshold: float):
    def verify(batches):
        for whole in batches:
            for a, b in pieces(whole.column("ta")):
                batch = whole.slice(a, b - a)
                sims = np.array([similarity(x, y) for x, y in _sides(batch)])
                keep = pa.array(np.flatnonzero(sims >= threshold - 1e-12))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(keep), batch.column("b").take(keep), pa.array(sims, pa.float64()).take(keep)],
                    names=["a", "b", "similarity"])

    return verify


def _candidates(rows: DataFrame, threshold: float, small: int) -> DataFrame:
    """(a, b) of a round.  ``rows``: bucket, node, n, size, pivot, pivot_n, of buckets with two nodes or more."""
    near = lambda x, y: F.least(x, y) >= F.lit(threshold - 1e-12) * F.greatest(x, y)
    few = rows.where(F.col("size") <= small).select("bucket", "node", "n")
    l, r = few.alias("l"), few.alias("r")
    pairs = (l.join(r, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.node") < F.col("r.node")))
             .where(near(F.col("l.n"), F.col("r.n"))).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))
    many = (rows.where((F.col("size") > small) & (F.col("node") != F.col("pivot"))).where(near(F.col("n"), F.col("pivot_n")))
            .select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")))
    return pairs.union(many).distinct()


def _bucketed(rows: DataFrame, small: int) -> DataFrame:
    """Add size and, to large buckets, a pivot to (bucket, node, n); buckets of one node go.

    The pivot is the node that shares large buckets with the most others: the text a
    group of copies was made from, if there is one, rather than any of its copies.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    held = materialize(rows.join(sizes, "bucket"), "held")
    many = held.where(F.col("size") > small)
    rank = many.groupBy("node").agg((-F.sum("size")).alias("rank"))
    # Written, so that a bucket with much of the table can be dealt to many tasks when its nodes meet the pivot.
    ranked = materialize(many.join(rank, "node"), "ranked")
    pivots = materialize(ranked.groupBy("bucket").agg(F.min(F.struct("rank", "node", "n")).alias("p"))
                         .select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "pivots")
    return materialize(held.join(pivots, "bucket", "left"), "buckets")


def outside(own: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The shingles of a text that its pivot lacks (an element for each repetition), the number both share, and that of all."""
    both = np.concatenate([own, pivot])
    text, h, n = shingles(both.view(np.uint64), np.array([0, len(own)]), np.array([len(own), len(both)]))
    mine, theirs = text == 0, text == 1
    ha, na, hb, nb = h[mine], n[mine].astype(np.int64), h[theirs], n[theirs].astype(np.int64)
    at = np.searchsorted(hb, ha)
    hit = at < len(hb)
    hit[hit] = hb[at[hit]] == ha[hit]
    held = np.zeros(len(ha), np.int64)
    held[hit] = nb[at[hit]]
    extra = np.maximum(na - held, 0)
    k = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + np.repeat(held, extra)
    return mix(np.repeat(ha, extra) + (k + 1).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), int(na.sum() - extra.sum()), int(na.sum())


def _beside(batches):
    for whole in batches:
        for a, b in pieces(whole.column("ta")):
            batch = whole.slice(a, b - a)
            found = [outside(x, y) for x, y in _sides(batch)]
            rest = pa.array([x.view(np.int64) for x, _, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("pivot", "node", "class", "open")), pa.array([n for _, _, n in found], pa.int64()),
                 pa.array([o for _, o, _ in found], pa.int64()), rest], names=["pivot", "node", "class", "open", "n", "shared", "rest"])


def _prefixes(threshold: float, asking: bool):
    """(row, bin, token) to join on: of open texts in the bins of their pivot that may match (``asking``), of every text in the bin of its length.

    Two texts of n and m shingles are similar if they share need = threshold / (1 + threshold) * (n + m).  At most the
    lesser number they share with the pivot are shingles of the pivot; the others, if any are needed, must be among
    those the pivot lacks, so one of them is in the prefixes of both.  If none are needed, the token is 0.  Shingles that
    no text of another class has come first in the order and meet nothing, so ``common`` has the others only.
    """
    part = threshold / (1 + threshold)

    def run(batches):
        for batch in batches:
            n, shared = (batch.column(x).to_pylist() for x in ("n", "shared"))
            common, present = batch.column("common").to_pylist(), batch.column("bins").to_pylist()
            row, bins, tokens = [], [], []
            for i in range(batch.num_rows):
                low, high = threshold * n[i], n[i] / threshold
                for b in present[i] if asking else [length_bin(n[i])]:
                    if asking and (_BIN ** (b + 1) < low * (1 - 1e-9) or _BIN**b > high * (1 + 1e-9)):
                        continue
                    need = part * (n[i] + max(low, _BIN**b * (1 - 1e-9))) - shared[i] if asking else low - shared[i]
                    own = common[i][: max(len(common[i]) - max(1, math.ceil(need - 1e-9)) + 1, 0)]
                    own = [*own, 0] if need <= 1e-9 else own
                    row += [i] * len(own)
                    bins += [b] * len(own)
                    tokens += own
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(x).take(at) for x in ("pivot", "node", "class", "n", "shared")),
                                              pa.array(bins, pa.int32()), pa.array(tokens, pa.int64())],
                                             names=["pivot", "node", "class", "n", "shared", "bin", "token"])

    return run


def length_bin(n: int) -> int:
    return int(math.log(n) / math.log(_BIN))


_PREFIX = "pivot binary, node binary, class binary, n long, shared long, bin int, token long"


def _left_over(met: DataFrame, roots: DataFrame, a: DataFrame, b: DataFrame, threshold: float) -> DataFrame | None:
    """(a, b): nodes of different classes with one pivot that may be similar; ``met``: pivot, node of the large buckets."""
    own, theirs = roots.select("node", F.col("root").alias("class")), roots.select(F.col("node").alias("pivot"), F.col("root").alias("_theirs"))
    # One pivot stands for all of its class: any text serves to compare others with.
    used = materialize(met.groupBy("pivot").count().join(theirs, "pivot", "left").withColumn("_theirs", F.coalesce("_theirs", "pivot")), "used")
    chief = used.groupBy("_theirs").agg(F.max(F.struct("count", "pivot"))["pivot"].alias("_chief"))
    named = materialize(used.join(chief, "_theirs").select("pivot", "_theirs", "_chief"), "chiefs")
    classed = (met.join(named, "pivot").select(F.col("_chief").alias("pivot"), "node", "_theirs").distinct().where(F.col("node") != F.col("pivot"))
               .join(own, "node", "left").withColumn("class", F.coalesce("class", "node")))
    classed = materialize(classed.select("pivot", "node", "class", (F.col("class") != F.col("_theirs")).alias("open")), "outside")
    if classed.where("open").isEmpty():
        return None
    rows = classed.join(classed.where("open").select("pivot").distinct(), "pivot", "left_semi")
    texts = (rows.join(a.withColumnRenamed("a", "node"), "node").join(b.withColumnRenamed("b", "pivot"), "pivot")
             .select("pivot", "node", "class", "open", "ta", "tb"))
    # Dealt anew, for the texts of one pivot may lie in few tasks.
    beside = materialize(texts.mapInArrow(
        _beside, "pivot binary, node binary, class binary, open boolean, n long, shared long, rest array<long>").repartition("pivot", "node"), "beside")
    # The shingles that an open text and one of another class have, rare ones first.
    single = beside.select("pivot", "node", "class", "open", F.explode("rest").alias("token"))
    mixed = (single.groupBy("pivot", "token").agg(F.min("class").alias("_l"), F.max("class").alias("_g"), F.max("open").alias("_open"), F.count("*").alias("_k"))
             .where("_open AND _l <> _g").select("pivot", "token", "_k"))
    common = (single.join(mixed, ["pivot", "token"]).groupBy("pivot", "node")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "token"))), lambda x: x["token"]).alias("common")))
    bins = (beside.groupBy("pivot", F.floor(F.log("n") / math.log(_BIN)).cast("int").alias("bin")).count()
            .groupBy("pivot").agg(F.collect_list("bin").alias("_bins")))
    # Rounding may put a length into the bin beside its own.
    around = F.array_distinct(F.flatten(F.transform("_bins", lambda x: F.array(x - 1, x, x + 1))))
    ready = materialize(beside.join(common, ["pivot", "node"], "left").join(bins, "pivot").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
                        .select("pivot", "node", "class", "open", "n", "shared", "common", around.alias("bins")), "ready")
    asking = materialize(ready.where("open").mapInArrow(_prefixes(threshold, True), _PREFIX), "asking")
    held = materialize(ready.mapInArrow(_prefixes(threshold, False), _PREFIX), "prefixes")
    keys = ["pivot", "bin", "token"]
    l = asking.select(*keys, *(F.col(x).alias(f"_{x}") for x in ("node", "class", "n", "shared")))
    need = F.lit(threshold / (1 + threshold)) * (F.col("_n") + F.col("n"))
    able = (F.col("token") != 0) | (need <= F.least("_shared", "shared") + 1e-9)
    near = F.least("_n", "n") >= F.lit(threshold - 1e-12) * F.greatest("_n", "n")
    return (l.join(held, keys).where((F.col("_class") != F.col("class")) & near & able)
            .select(F.least("_node", "node").alias("a"), F.greatest("_node", "node").alias("b")).distinct())


def links(docs: DataFrame, *, text: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS,
          small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) that make the classes, and the roots (node, root) of the texts linked."""
    signed = materialize(signatures(docs, text, bands, rows), "signatures")
    open_rows = _bucketed(signed.select("node", "n", F.explode("bands").alias("bucket")), small)
    # The texts of all nodes that meet another in some band, read once.
    met = materialize(open_rows.select("node", "n").distinct(), "nodes")
    own = docs.select(text_node(F.col(text)), F.col(text).alias("t"))
    with prefiltered(met):
        # One row a text before the shuffle, so that a text with many copies does not meet the join in one task.
        texts = own.dropDuplicates(["node"]).join(met.where("n > 0").select("node"), "node", "left_semi")
        words = materialize(texts.select("node", "t"), "texts")
    a, b = (words.select(F.col("node").alias(x), F.col("t").alias(f"t{x}")) for x in "ab")
    shared = open_rows.where(F.col("size") > small).select("pivot", "node")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
        return materialize(both.mapInArrow(_verifier(threshold), "a binary, b binary, similarity double"), "links")

    tried = materialize(_candidates(open_rows, threshold, small), "pairs")
    found = verified(tried)
    roots = connected_components(found.select("a", "b"))
    pairs = _left_over(shared, roots, a, b, threshold)
    if pairs is not None:
        found = found.union(verified(materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")))
        roots = connected_components(found.select("a", "b"))
    return found, roots


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """(key, class_id, class_size, first) per row; ``first``: the row that stands for its class."""
    _, roots = links(docs, text=text, threshold=threshold, bands=bands, rows=rows)
    return _classes(docs.select(F.col(key), text_node(F.col(text))), roots, key).drop("node", "root")


def _classes(keyed: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    own = F.struct(F.col(key).isNull(), F.col(key), F.col("node"))
    named = materialize(keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    # Written, so that the rows of a class that holds much of the table can be dealt to many tasks when they meet it.
    classes = materialize(named.groupBy("root").agg(F.min(key).alias("class_id"), F.count("*").alias("class_size"), F.min(own).alias("_first"))
                          .where("class_size > 1"), "classes")
    joined = named.join(classes, "root", "left")
    alone = F.col("class_size").isNull()
    return joined.withColumns({"class_id": F.when(alone, F.col(key)).otherwise(F.col("class_id")),
                               "class_size": F.coalesce("class_size", F.lit(1)).cast("long"),
                               "first": alone | own.eqNullSafe(F.col("_first"))}).drop("_first")


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The documents that stand for their classes, one for each, with their own columns."""
    _, roots = links(docs, text=text, threshold=threshold)
    first = _classes(docs.select(F.col(key), text_node(F.col(text))), roots, key).where("first")
    kept = materialize(first.groupBy(key, "node").agg(F.count("*").alias("_copies")), "kept")
    rows = boxed(docs, _key=F.col(key), _node=text_node(F.col(text)))
    mine = rows.join(kept.withColumnsRenamed({key: "_k", "node": "_n"}), (F.col("_node") == F.col("_n")) & F.col("_key").eqNullSafe(F.col("_k")))
    # Rows repeated with their id and text are rare: one of each is kept.
    once, again = mine.where("_copies = 1"), mine.where("_copies > 1").dropDuplicates(["_key", "_node"])
    return unboxed(once.union(again), docs.columns)
