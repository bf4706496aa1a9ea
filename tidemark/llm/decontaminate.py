"""Benchmark decontamination: MinHash containment search, verified exactly.

A short test item inside a long document has a tiny Jaccard similarity, so the
search is for containment: which documents hold at least ``threshold`` of an
item's five-word shingles?  An item of fewer words is one shingle of its own width.
Items are partitioned by size (powers of two of the shingle count).  In a partition
of items with at most ``u`` shingles the signature of an item is its
``floor((1 - threshold) * u) + 1`` least shingles - a min-wise sample just large
enough that a document with the required containment cannot miss all of it.  So
candidates are complete, not likely: documents holding a signature shingle that have
shingles enough for the least item of the partition.  They are verified on the
shingles themselves.  Shingles are ordered by the number of items that have them,
then by hash, so that a phrase common to many items stands in few signatures.

Documents are never paired with each other or with items they share nothing
with; the signatures grow with the benchmark alone and are broadcast by the
optimizer only while they are small (their written size decides).

Defined results: items and texts without words, null or empty texts
and null item ids match nothing; a repeated (id, text) row counts once; equal
items each get their rows; null document ids are kept; empty tables give no
rows; extra columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

SHINGLE = 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _windows(w: Column, make, width: int) -> Column:
    starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: make(x, *(F.get(w, i + k) for k in range(1, width))))


def _shingles(w: Column, make, widths) -> Column:
    """The windows of all the given widths."""
    return F.flatten(F.array(*(_windows(w, make, k) for k in widths)))


def shingle_hashes(w: Column, widths) -> Column:
    return _shingles(w, F.xxhash64, widths)


def shingle_texts(w: Column, widths) -> Column:
    return F.array_distinct(_shingles(w, lambda *x: F.concat_ws(" ", *x), widths))


def _own_width(w: Column, make, width: int) -> Column:
    """The shingles of an item: of ``width`` words, or one of all its words if it has fewer."""
    found = _windows(w, make, width)
    for k in range(1, width):
        found = F.when(F.size(w) == k, _windows(w, make, k)).otherwise(found)
    return found


def signatures(items: DataFrame, *, threshold: float = 0.8, item: str = "item_id", text: str = "text",
               width: int = SHINGLE) -> DataFrame:
    """(_item, _width, _least, _h): the min-wise sample of each item, as long as its size partition needs.

    ``_width``: words in its shingles; ``_least``: shingles of it that a document of the partition must have.
    """
    w = items.select(F.col(item).alias("_item"), words(F.col(text)).alias("_w")).where(F.col("_item").isNotNull()).distinct()
    sized = (w.select("_item", F.least(F.size("_w"), F.lit(width)).alias("_width"), F.xxhash64("_w").alias("_text"),
                      F.array_distinct(_own_width(F.col("_w"), F.xxhash64, width)).alias("_all")).where(F.size("_all") > 0))
    each = sized.select("_item", "_width", "_text", F.size("_all").alias("_n"), F.explode("_all").alias("_h"))
    common = each.groupBy("_h").agg(F.count("*").alias("_items"))
    ordered = each.join(common, "_h").groupBy("_item", "_width", "_text", "_n").agg(F.array_sort(F.collect_list(F.struct("_items", "_h"))).alias("_all"))
    bits = F.floor(F.log2(F.size("_all"))).cast("int")
    most = F.pow(F.lit(2.0), bits + 1) - 1
    length = F.least(F.size("_all"), (F.floor(F.lit(1 - threshold) * most + 1e-9) + 1).cast("int"))
    least = F.ceil(F.lit(threshold) * F.pow(F.lit(2.0), bits) - 1e-9)
    return (ordered.select("_item", "_width", least.alias("_least"), F.explode(F.slice("_all", F.lit(1), length)).alias("_s"))
            .select("_item", "_width", "_least", F.col("_s._h").alias("_h")))


def search(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, key: str = "doc_id", item: str = "item_id",
           text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(key, item, n_shingles, n_shared, containment) for each pair at or above the threshold."""
    return _search(docs, items, threshold, key, item, text, width).drop("_id", "_hash")


def _search(docs: DataFrame, items: DataFrame, threshold: float, key: str, item: str, text: str, width: int = SHINGLE) -> DataFrame:
    """The pairs of ``search``, with what identifies the row of a document: _id and _hash."""
    signed = materialize(signatures(items, threshold=threshold, item=item, text=text, width=width).distinct(), "signatures")
    # At most ``width`` of them; shorter windows of the documents are made only for items that have them.
    widths = sorted(r["_width"] for r in signed.select("_width").distinct().collect()) or [width]
    keyed = docs.select(F.col(key), F.coalesce(F.col(key).cast("string"), F.lit("\u0000")).alias("_id"),
                        F.xxhash64(text).alias("_hash"), words(F.col(text)).alias("_w"))
    probes = keyed.select("_id", "_hash", F.size("_w").alias("_words"), F.explode(shingle_hashes(F.col("_w"), widths)).alias("_h"))
    enough = F.col("_words") - F.col("_width") + 1 >= F.col("_least")
    candidates = materialize(probes.join(signed, "_h").where(enough).select("_id", "_hash", "_item").distinct(), "candidates")
    # The whole of an item and of a candidate document are compared as words.
    whole = materialize(items.select(F.col(item).alias("_item"), F.array_distinct(_own_width(
        words(F.col(text)), lambda *x: F.concat_ws(" ", *x), width)).alias("_own")).where(F.col("_item").isNotNull() & (F.size("_own") > 0)).distinct(), "items")
    texts = keyed.join(candidates.select("_id", "_hash").distinct(), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    pairs = (texts.select(key, "_id", "_hash", shingle_texts(F.col("_w"), widths).alias("_doc"))
             .join(candidates, ["_id", "_hash"]).join(whole, "_item"))
    shared = F.size(F.array_intersect("_own", "_doc"))
    found = pairs.select("_id", "_hash", key, F.col("_item").alias(item), F.size("_own").cast("long").alias("n_shingles"),
                         shared.cast("long").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_shingles")
    return found.withColumn("containment", share).where(F.col("containment") >= threshold)


def decontaminate(docs: DataFrame, items: DataFrame, *, threshold: float = 0.8, key: str = "doc_id", item: str = "item_id",
                  text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    found = _search(docs, items, threshold, key, item, text)
    leaks = materialize(found.select(F.col("_id").alias("_leak"), F.col("_hash").alias("_leak_hash")).distinct(), "leaks")
    own = F.coalesce(docs[key].cast("string"), F.lit("\u0000"))
    # Ids may be null or repeated: only the rows that hold an item go.
    return docs.join(leaks, (own == leaks["_leak"]) & (F.xxhash64(docs[text]) == leaks["_leak_hash"]), "left_anti")
