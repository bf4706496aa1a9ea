"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by their membership pattern, the set of sources they count
for; a text that stands in several sources counts for all of them.  Token capacity is
then routed from patterns to source quotas in a small flow network: pattern -> source
-> quota.  The r-th use of a pattern's different texts costs r, so repetition is spread
before it is stacked (a convex cost; from ``most`` uses on it rises no more), and a
text of several sources is not taken for each of them while others wait.  A source
uses a pattern ``most`` times what it holds of it at most.

The flow of a cell (a pattern, and the source whose rows they are) becomes whole passes
over its rows and a rest, which is filled in the order of a seeded hash of the text,
turned so that the sources of a pattern begin at different texts; rows of one text go
in the order of a hash of their id.

Quotas, ranks and sources without shared texts are worked out as tables of one row a
source.  To the driver go the cells of the sources that share texts, of the
``MAX_PATTERNS`` patterns of most words; texts of the others count for their row's own
source alone, which meets the quotas as well.  The cut of a cell is found by running
totals over slices of the hash, then inside the one slice where it ends, so no cell is
ever ordered as a whole.

Defined results: a null text has size 0 and counts as empty; a null source is a source
of its own and comes last; sources of size 0 have target 0; rows of equal id and text
share one outcome, or a share of them is taken if they are more than ``_ALIKE``; an empty table gives no rows; extra
columns pass through, those of the added names are replaced.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKEN, boxed, materialize, unboxed

MAX_PATTERNS = 20_000
_BITS, _SLICE_BITS = 60, 12
_ALIKE = 100


def min_cost_flow(capacity: dict, members: dict, quota: dict, repeats: int, limit: dict | None = None) -> dict:
    """Tokens of each pattern for each of its sources, by successive shortest augmenting paths.

    ``capacity``: pattern -> tokens of a use; ``members``: pattern -> its sources;
    ``quota``: source -> tokens wanted.  Pattern layer r (1..repeats) gives up to
    ``capacity`` tokens at cost r.  The costs stand on the pattern's own arcs and
    rise, so filling layer after layer, each to its maximum flow with re-routing
    of earlier tokens between sources, is a shortest-path order.  With ``limit``,
    (pattern, source) -> most tokens, one more layer gives what the limits allow.
    """
    flow = {p: dict.fromkeys(members[p], 0) for p in capacity}
    of_source: dict = {}
    for p, own in members.items():
        for s in own:
            of_source.setdefault(s, []).append(p)
    left = dict(quota)
    free = lambda p, s: limit is None or flow[p][s] < limit[p, s]
    # What a search without an end has seen stays without one: no later path gets out of it.
    dead: set = set()
    for layer in range(1, repeats + 1 + (limit is not None)):
        for start in sorted(capacity):
            uses = layer * capacity[start] if layer <= repeats else sum(limit[start, s] for s in members[start])
            room = uses - sum(flow[start].values())
            while room > 0 and start not in dead:
                # Breadth first from the pattern to a source with quota left,
                # going back along tokens that other patterns could place elsewhere.
                seen, back, queue, end = {start}, {}, deque([start]), None
                while queue and end is None:
                    p = queue.popleft()
                    for s in members[p]:
                        if ("s", s) in seen or ("s", s) in dead or not free(p, s):
                            continue
                        seen.add(("s", s))
                        back["s", s] = p
                        if left[s] > 0:
                            end = s
                            break
                        for other in of_source[s]:
                            if other not in seen and other not in dead and flow[other][s] > 0:
                                seen.add(other)
                                back[other] = s
                                queue.append(other)
                if end is None:
                    dead |= seen
                    break
                path, amount, s = [], min(room, left[end]), end
                while True:
                    p = back["s", s]
                    path.append((p, s, 1))
                    amount = amount if limit is None else min(amount, limit[p, s] - flow[p][s])
                    if p == start:
                        break
                    s = back[p]
                    path.append((p, s, -1))
                    amount = min(amount, flow[p][s])
                for p, s, sign in path:
                    flow[p][s] += sign * amount
                left[end] -= amount
                room -= amount
    return flow


def _name(source: Column) -> Column:
    """A source as text that is never null: its name after "=", the null source as "~"."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def _ranked(names: DataFrame, *order: Column) -> DataFrame:
    """Add ``_rank``, 0 and up in this order: by ranges, and the number of rows in the ranges before."""
    local = F.monotonically_increasing_id()
    written = materialize(names.repartitionByRange(*order).sortWithinPartitions(*order)
                          .select("*", F.shiftright(local, 33).alias("_range"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("_local")), "mix-ranks")
    sizes = {r["_range"]: r["count"] for r in written.groupBy("_range").count().collect()}  # one row a task
    before, at = [], 0
    for k in sorted(sizes):
        before.append((k, at))
        at += sizes[k]
    starts = names.sparkSession.createDataFrame(before, "_range long, _before long")
    return written.join(starts, "_range").withColumn("_rank", F.col("_local") + F.col("_before")).drop("_range", "_local", "_before")


def _targets(sources: DataFrame, total: int, weights: dict | None, most: int) -> DataFrame:
    """(source, source_size, target): ``total`` shared by weight; a source stops at ``most`` times its
    size and the excess is shared again among the others until none is above."""
    ranked = _ranked(sources, F.col("source") == "~", F.col("source"))
    weight = F.col("_rank") % 3 + 1
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == f"={name}", F.lit(w)).otherwise(weight)
    held = materialize(ranked.select("source", "source_size", weight.cast("decimal(20,6)").alias("_w")), "mix-sources")
    open_ = F.lit(True)
    while True:
        # In whole numbers, so that the order of rows cannot show; every turn stops a source at least.
        t = held.agg(F.sum(F.when(open_, F.col("_w"))).alias("w"), F.sum(F.when(~open_, F.col("source_size").cast("decimal(38,0)"))).alias("stopped"),
                     F.count(F.when(open_, True)).alias("n")).first()
        if not t["n"]:
            return held.select("source", "source_size", (F.lit(float(most)) * F.col("source_size")).alias("target"))
        share = (total - most * int(t["stopped"] or 0)) / float(t["w"])
        level = F.col("_w").cast("double") * F.lit(share)
        still = level <= F.lit(float(most)) * F.col("source_size")
        if held.where(still).count() == t["n"]:
            return held.select("source", "source_size", F.when(still, level).otherwise(F.lit(float(most)) * F.col("source_size")).alias("target"))
        open_ = still


def _hash(*parts: Column) -> Column:
    """A hash below 2^60."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _BITS // 4), 16, 10).cast("long")


def _cut(rows: DataFrame, need: DataFrame, value: str) -> DataFrame:
    """(_cell, cut, left): below ``cut`` the rows of a cell have less than ``need`` words, and ``left`` are open for those at it."""
    sliced = rows.join(need, "_cell").withColumn("_slice", F.shiftright(value, _BITS - _SLICE_BITS).cast("int"))
    run = lambda c: F.sum("words").over(Window.partitionBy("_cell").orderBy(c))
    slices = sliced.groupBy("_cell", "need", "_slice").agg(F.sum("size").alias("words")).withColumn("_until", run("_slice"))
    ends = materialize(slices.where(F.col("_until") > F.col("need")).groupBy("_cell").agg(
        F.min(F.struct("_slice", (F.col("need") - F.col("_until") + F.col("words")).alias("open"))).alias("e")).select("_cell", "e._slice", "e.open"), "mix-ends")
    inside = (sliced.join(ends, ["_cell", "_slice"]).groupBy("_cell", "open", value).agg(F.sum("size").alias("words")).withColumn("_until", run(value)))
    return materialize(inside.where(F.col("_until") > F.col("open")).groupBy("_cell").agg(
        F.min(F.struct(F.col(value).alias("cut"), (F.col("open") - F.col("_until") + F.col("words")).alias("left"))).alias("e")).select("_cell", "e.cut", "e.left"), "mix-cuts")


def _mixed(docs: DataFrame, sized: DataFrame, own: bool, weights: dict | None, most: int) -> DataFrame:
    """``sized``: _row, size, _members (names), _text, _tie.  Adds the passes of every row.

    ``own``: rows count for the one source they name, and share their text with others; else for all they name.
    """
    spark, listed = docs.sparkSession, F.to_json("_members")
    narrow = sized.select("size", "_text", "_tie", "_members", F.col("_members")[0].alias("_source"))
    narrow = materialize(narrow, "mix-sizes")
    if own:
        # The sources of texts that stand in several.
        shared = (narrow.groupBy("_text").agg(F.min("_source").alias("_l"), F.max("_source").alias("_g"), F.sort_array(F.collect_set("_source")).alias("_m"),
                                              F.max("size").alias("size")).where("_l <> _g").select("_text", F.to_json("_m").alias("_pattern"), "size"))
    else:
        shared = narrow.where("size(_members) > 1").select("_text", listed.alias("_pattern"), "size")
    shared = materialize(shared, "mix-shared")
    # Beyond the patterns of most words a text counts for one source.
    patterns = shared.groupBy("_pattern").agg(F.sum("size").alias("words")).orderBy(F.desc("words"), "_pattern").limit(MAX_PATTERNS)
    patterns = materialize(patterns.select("_pattern"), "mix-patterns")
    if own:
        known = materialize(shared.join(patterns, "_pattern").select("_text", "_pattern"), "mix-texts")
        put = lambda rows: rows.join(known, "_text", "left")
    else:
        put = lambda rows: rows.withColumn("_pattern", listed).join(
            patterns.withColumnRenamed("_pattern", "_known"), F.col("_pattern") == F.col("_known"), "left").withColumn("_pattern", F.col("_known")).drop("_known")
    cell = lambda rows: put(rows).withColumn("_cell", F.to_json(F.struct(
        "_pattern", (F.col("_source") if own else F.when(F.col("_pattern").isNull(), F.col("_source"))).alias("_source"))))
    celled = materialize(cell(narrow), "mix-cells")
    total = int(celled.agg(F.sum("size")).first()[0] or 0)
    counts = celled.select(F.explode(F.when(F.lit(own) | F.col("_pattern").isNull(), F.array("_source")).otherwise(F.col("_members"))).alias("source"), "size")
    targets = materialize(_targets(counts.groupBy("source").agg(F.sum("size").alias("source_size")), total, weights, most), "mix-targets")
    cells = celled.groupBy("_cell").agg(F.first("_pattern").alias("_pattern"), F.first("_source").alias("_source"), F.sum("size").alias("words"))
    # The words of the different texts of a pattern.
    once = celled.where("_pattern IS NOT NULL").select("_pattern", "_text", "size")
    once = (once.dropDuplicates(["_pattern", "_text"]) if own else once).groupBy("_pattern").agg(F.sum("size").alias("_once"))
    cells = materialize(cells.join(once, "_pattern", "left"), "mix-totals")
    names = patterns.select(F.explode(F.from_json("_pattern", "array<string>")).alias("source")).distinct()
    alone = cells.where("_pattern IS NULL")
    near = cells.where("_pattern IS NOT NULL").unionByName(alone.join(names, F.col("_source") == F.col("source"), "left_semi"))
    limit, capacity, members, at = {}, {}, {}, {}
    for r in near.collect():  # the cells of at most MAX_PATTERNS patterns, and one a source of theirs
        p = r["_pattern"] or r["_cell"]
        capacity[p] = r["_once"] if r["_pattern"] else r["words"]
        for s in [r["_source"]] if own or not r["_pattern"] else json.loads(r["_pattern"]):
            members.setdefault(p, []).append(s)
            limit[p, s], at[p, s] = most * r["words"], (r["_cell"], r["words"])
    quota = {r["source"]: round(r["target"]) for r in targets.join(names, "source").collect()}
    members = {p: sorted(m) for p, m in sorted(members.items())}  # the order decides between equal flows
    flow, rows = min_cost_flow(capacity, members, quota, most, limit), {}
    for p, routed in sorted(flow.items()):
        begin = 0
        for s, words in routed.items():
            c, held = at[p, s]
            got = rows.setdefault(c, [c, 0, held, int(begin * 2**_BITS / max(capacity[p], 1)) % 2**_BITS])
            got[1] += words
            begin += words
    linked = spark.createDataFrame(list(rows.values()), "_cell string, flow long, words long, _turn long")
    if not own:
        route = _route(celled, linked.unionByName(_rest(alone, targets, names, most)), most)
        return _with_passes(cell(sized.withColumn("_source", F.col("_members")[0])), route, most), targets
    # Cells end between two texts, so a source's own texts take what its shared ones left of its quota.
    shared_cells = _route(celled, linked.join(alone.select("_cell"), "_cell", "left_anti"), most)
    done = _with_passes(celled.where("_pattern IS NOT NULL"), shared_cells, most).groupBy("_source").agg(F.sum(F.col("size") * F.col("n_passes")).alias("done"))
    open_ = targets.join(done.withColumnRenamed("_source", "source"), "source", "left").withColumn("target", F.col("target") - F.coalesce("done", F.lit(0)))
    single = _route(celled, _rest(alone, open_, None, most), most)
    route = materialize(shared_cells.unionByName(single), "mix-route")
    return _with_passes(cell(sized.withColumn("_source", F.col("_members")[0])), route, most), targets


def _rest(alone: DataFrame, targets: DataFrame, linked: DataFrame | None, most: int) -> DataFrame:
    """The flow of cells without a pattern: what their source wants, as far as they go."""
    cells = alone if linked is None else alone.join(linked, F.col("_source") == F.col("source"), "left_anti")
    wanted = F.greatest(F.round("target").cast("long"), F.lit(0))
    return (cells.join(targets, F.col("_source") == F.col("source"))
            .select("_cell", F.least(wanted, most * F.col("words")).alias("flow"), "words", F.lit(0).cast("long").alias("_turn")))


def _route(celled: DataFrame, flows: DataFrame, most: int) -> DataFrame:
    """For each cell its whole passes and, if there is a rest, where it ends."""
    passes = F.when(F.col("words") > 0, F.least(F.floor(F.col("flow") / F.col("words")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    plan = materialize(flows.withColumn("n_passes", passes).withColumn("need", F.col("flow") - F.col("n_passes") * F.col("words"))
                       .select("_cell", "n_passes", "need", "_turn"), "mix-plan")
    wanted = plan.where(F.col("need") > 0)
    placed = celled.join(wanted.select("_cell", "_turn"), "_cell").select("_cell", "size", "_tie", order_of(F.col("_text"), F.col("_turn")).alias("_order"))
    first = _cut(placed, wanted.select("_cell", "need"), "_order").withColumnsRenamed({"cut": "_cut", "left": "_left"})
    ties = placed.join(first, "_cell").where(F.col("_order") == F.col("_cut")).select("_cell", "size", "_tie")
    second = _cut(ties, first.select("_cell", F.col("_left").alias("need")), "_tie").withColumnsRenamed({"cut": "_cut2", "left": "_left2"})
    # Rows that are equal in both go together, if half of them fit; of a great many any such share will do.
    share = F.when(F.col("rows") > _ALIKE, F.col("_left2") / F.col("words")).otherwise((F.col("words") <= 2 * F.col("_left2")).cast("double"))
    last = (ties.join(second, "_cell").where(F.col("_tie") == F.col("_cut2")).groupBy("_cell", "_cut2", "_left2")
            .agg(F.sum("size").alias("words"), F.count("*").alias("rows")).select("_cell", "_cut2", share.alias("_share")))
    return materialize(plan.join(first.drop("_left"), "_cell", "left").join(last, "_cell", "left"), "mix-route")


def _with_passes(rows: DataFrame, route: DataFrame, most: int) -> DataFrame:
    at_cut = (F.col("_tie") < F.col("_cut2")) | ((F.col("_tie") == F.col("_cut2")) & (F.rand(0) < F.col("_share")))
    here = order_of(F.col("_text"), F.col("_turn"))
    extra = (F.col("need") > 0) & (F.col("_cut").isNull() | (here < F.col("_cut")) | ((here == F.col("_cut")) & at_cut))
    return rows.join(route, "_cell", "left").withColumn(
        "n_passes", F.least(F.col("n_passes") + F.coalesce(extra, F.lit(False)).cast("long"), F.lit(most).cast("long")))


def order_of(text: Column, turn: Column) -> Column:
    """The place of a text in the order of its cell: its hash, turned."""
    return F.pmod(text - turn, F.lit(1 << _BITS))


def _sized(docs: DataFrame, members: Column, key: str, text: str, seed: int) -> DataFrame:
    t, tie = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(key).cast("string"), F.lit("|"))
    return boxed(docs, size=F.size(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))).cast("long"), _members=members,
                 _text=_hash(F.lit(str(seed)), F.md5(t)), _tie=_hash(F.lit(str(seed)), tie))


def mix(docs: DataFrame, *, sources: Column, key: str = "doc_id", text: str = "text", weights: dict | None = None,
        most: int = 3, seed: int = 0) -> DataFrame:
    """Add size, n_passes and taken to documents that count for several sources each.

    ``sources`` is an array of names: all sources a document counts for (an empty one is the null source).
    ``weights`` defaults to 1, 2, 3, repeating by code point order, null last.
    """
    names = F.array_sort(F.array_distinct(F.transform(sources, _name)))
    named = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("~")))
    mixed, _ = _mixed(docs, _sized(docs, named, key, text, seed), False, weights, most)
    return unboxed(mixed, docs.columns, size=F.col("size"), n_passes=F.col("n_passes"), taken=F.col("size") * F.col("n_passes"))


def mix_by_source(docs: DataFrame, *, source: str = "source", key: str = "doc_id", text: str = "text", most: int = 3,
                  seed: int = 0) -> DataFrame:
    """Add size, n_passes, taken, source_size and target to documents with one source each; equal texts overlap."""
    mixed, targets = _mixed(docs, _sized(docs, F.array(_name(F.col(source))), key, text, seed), True, None, most)
    joined = mixed.join(targets.withColumnsRenamed({"source": "_s", "source_size": "_size"}), F.col("_source") == F.col("_s"), "left")
    return unboxed(joined, docs.columns, size=F.col("size"), n_passes=F.col("n_passes"), taken=F.col("size") * F.col("n_passes"),
                   source_size=F.col("_size"), target=F.col("target"))
