"""Operators 2, 5, 7, 8 and the pipeline."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import html_text, mixing, quality_classifier, quote_links
from tidemark.llm.common import materialize

from ..conftest import DATA
from .test_copies import similarity

# --- 2: quotations

THREAD = [
    (1, 0, "Hello there.\nSecond line.\n\nA new paragraph here."),
    (1, 1, "> hello  THERE.\n> Second line.\nMy answer."),
    (1, 2, "On Monday, X wrote:\n>> Second line.\n> My answer.\nThanks!"),
    (1, 3, "Other topic"),
    (1, 4, "> Thanks!\nok"), (1, 4, "> Thanks!\nok"),
    (2, 0, "> A new paragraph here.\nquoted from elsewhere"), (2, 1, None), (2, 2, ""), (2, 3, "> nobody said this\nhm"),
    (None, 0, "> ok\nx"), (3, None, "> ok"), (4, 0, "> later\nfirst"), (4, 1, "later"), (5, 0, "w " * 50000 + "\n> ok"),
    (6, 1, "Try this:\n>>> import os\n>>> os.getcwd()"), (6, 2, "On Friday, Y wrote:\n> not to be found\nfine"),
]


def test_quotes(spark):
    table = spark.createDataFrame([(c, t, x, 1, "z", "y") for c, t, x in THREAD],
                                  "conv_id long, turn long, text string, depth int, _id string, links string")
    got = quote_links.link_quotes(table)
    found = {(r.conv_id, r.turn): r for r in got.collect()}
    assert got.count() == len(THREAD) and got.columns[:6] == table.columns
    assert found[1, 1].text == "My answer." and found[1, 1].parent_turn == 0 and found[1, 1].depth == 1
    assert found[1, 2].text == "Thanks!" and found[1, 2].n_quotes == found[1, 2].n_linked == 2
    assert [(x.level, x.turn) for x in found[1, 2].links] == [(1, 1), (2, 0)]
    assert [found[1, i].thread_turn for i in range(5)] == [0, 0, 0, 3, 0] and found[1, 4].depth == 3
    assert found[2, 0].links[0].conv_id == 1 and found[2, 0].parent_turn is None
    assert found[2, 1].text is None and found[2, 2].text == "" and found[2, 3].n_linked == 0
    assert found[2, 3].text == "> nobody said this\nhm"  # what is no quote of a message stays
    assert found[None, 0].n_linked == 0 and found[3, None].text == "> ok"  # a word or two of another conversation is no link
    assert found[4, 0].n_linked == 0  # a quote does not come from a later message
    assert found[5, 0].n_linked == 0 and found[5, 0].text == "w " * 50000 + "\n> ok"
    assert found[6, 1].text == "Try this:\n>>> import os\n>>> os.getcwd()" and found[6, 1].n_linked == 0
    assert found[6, 2].text == "On Friday, Y wrote:\n> not to be found\nfine"
    order = [(r.conv_id, r.turn) for r in quote_links.reply_ordered(got).collect() if r.conv_id == 1]
    assert order == [(1, 0), (1, 1), (1, 2), (1, 4), (1, 4), (1, 3)]
    assert quote_links.link_quotes(table.limit(0)).count() == 0


def test_quotes_of_a_long_chain(spark):
    n = 40
    rows = [(7, 0, "m0")] + [(7, i, f"> m{i - 1}\nm{i}") for i in range(1, n)] + [(8, i, "> same line\nsame line") for i in range(n)]
    got = {(r.conv_id, r.turn): r for r in quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert all(got[7, i].depth == i and got[7, i].thread_turn == 0 for i in range(n))
    assert all(got[8, i].parent_turn == 0 for i in range(1, n)) and got[8, 0].parent_turn is None


def test_quotes_of_text_repeated_later(spark):
    """The least original is a later turn of the quoting conversation; that of another one counts."""
    same, first = "Same words as in the other one.", "first here of all the places"
    rows = [(5, 0, f"> {same}\nhm"), (5, 4, same.lower()), (9, 2, same), (9, 1, "other"), (6, 0, "> hm\nx"), (9, 7, same.replace(" ", "  ")),
            (None, 0, f"> {first}\ny"), (None, 3, first), (2, 5, first)]
    got = {(r.conv_id, r.turn): r for r in quote_links.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert [(x.conv_id, x.turn) for x in got[5, 0].links] == [(9, 2)] and got[5, 0].parent_turn is None
    assert [(x.conv_id, x.turn) for x in got[None, 0].links] == [(2, 5)] and len(got) == len(rows)


# --- 5: quality classifier


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 2 = 0")
    got = quality_classifier.classify(docs, known, host=F.col("source"), path=F.col("lang"))
    held = got.join(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "y"), "doc_id").select("y", "kept").collect()
    good, bad = [r.kept for r in held if r.y], [r.kept for r in held if not r.y]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_posteriors_match_brute_force(spark, docs):
    r = random.Random(1)
    texts = [(i, " ".join(f"w{r.randrange(99)}" + "%%%" * (i % 7 == 0) for _ in range(60))) for i in range(140)] + [(None, None), (3, "")]
    table = docs(texts).withColumn("source", F.concat(F.lit("h"), F.col("doc_id") % 9)).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(100)] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    args = {"host": F.col("source"), "path": F.col("lang")}
    model, narrow = quality_classifier.train(table, labels, **args)
    p = quality_classifier.probability(model.weights, {n: F.col(n) for n in quality_classifier.NAMES})
    rows = narrow.select("_key", "_host", "_path", p.alias("p")).collect()
    known = {i: max(y for j, y in [(i, int(i % 7 > 0)) for i in range(100)] + [(1, 0)] if j == i) for i in range(100)}
    evidence = lambda x: known.get(x["_key"], x.p / 1e9)
    paths, hosts = defaultdict(list), defaultdict(list)
    for x in rows:
        paths[x["_host"], x["_path"]].append(evidence(x))
        hosts[x["_host"]].append(evidence(x))
    mean = sum(map(sum, hosts.values())) / len(rows)
    assert model.mean == pytest.approx(mean, abs=1e-9)

    def strength(sites, around):
        big = [(s, around(k)) for k, s in sites.items() if len(s) > 1]
        spread = np.mean([(np.mean(s) - m) ** 2 for s, m in big]) - np.mean([m * (1 - m) / len(s) for s, m in big])
        return min(max(mean * (1 - mean) / max(spread, 1e-6) - 1, 2.0), 1e4)

    of_hosts = strength(hosts, lambda h: mean)
    posterior = {h: (sum(s) + of_hosts * mean) / (len(s) + of_hosts) for h, s in hosts.items()}
    of_paths = strength(paths, lambda k: posterior[k[0]])
    assert model.host_strength == pytest.approx(of_hosts, rel=1e-4) and model.path_strength == pytest.approx(of_paths, rel=1e-4)
    logit = lambda x: np.log(x / (1 - x))
    scored = quality_classifier.classify(table, labels, **args).collect()
    assert len(scored) == len(texts)
    site = {(x["_key"], x.p): x for x in rows}
    for x in scored:
        own = site[x.doc_id, round(x.classifier * 1e9)]
        h, q, e = own["_host"], own["_path"], evidence(own)
        host = (sum(hosts[h]) - e + of_hosts * mean) / (len(hosts[h]) - 1 + of_hosts)
        path = (sum(paths[h, q]) - e + of_paths * host) / (len(paths[h, q]) - 1 + of_paths)
        assert x.host_posterior == pytest.approx(host, abs=1e-5) and x.path_posterior == pytest.approx(path, abs=1e-5)
        assert logit(x.quality) == pytest.approx(logit(x.classifier) + logit(path) - logit(model.mean), abs=1e-2)
    kept = quality_classifier.keep(table, labels, **args)
    assert kept.columns == table.columns and kept.count() == sum(x.kept for x in scored)
    assert {x.quality for x in kept.collect()} == {"q"}  # a column of the same name stays
    assert quality_classifier.keep(table, labels.limit(0), **args).count() == len(texts)
    assert quality_classifier.keep(docs([]), labels, **args).count() == 0


def test_whole_texts_are_kept_without_a_shuffle(spark, docs):
    """Labels too many to be broadcast meet the statistics, and only those that decide something the texts."""
    r = random.Random(2)
    texts = [(i, " ".join(f"w{r.randrange(99)}" + "%%%" * (r.random() < i % 11 / 10) for _ in range(r.randrange(20)))) for i in range(6000)]
    texts += [(None, None), (3, ""), (5, texts[4][1])]
    # Sites of two documents, whose labels count, and sites of many.
    small = F.when(F.col("doc_id") < 60, F.floor(F.col("doc_id") / 2)).otherwise(F.col("doc_id") % 3 + 100)
    table = docs(texts).withColumn("source", F.concat(F.lit("h"), small)).withColumn("lang", F.col("source"))
    labels = spark.createDataFrame([(i, int(r.random() > i % 11 / 10)) for i in range(5000)] + [(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    args = {"host": F.col("source"), "path": F.col("lang")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        scored = quality_classifier.classify(table, labels, **args)
        want = scored.where("kept").groupBy("doc_id").count().collect()
        kept = quality_classifier.keep(table, labels, **args)
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, kept.groupBy("doc_id").count().collect())) == sorted(map(str, want))
        model, narrow = quality_classifier.train(table, labels, **args)
        p = quality_classifier.probability(model.weights, {n: F.col(n) for n in quality_classifier.NAMES})
        assert 0 < model.deciding(narrow, p, quality_classifier.THRESHOLD).count() < 60
        assert 1000 < sum(x["count"] for x in want) < len(texts) - 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- 7: mixing


def best_cost(capacity, members, quota, repeats):
    """Least cost of the greatest flow, by trying all whole flows."""
    arcs = [(p, s) for p in capacity for s in members[p]]
    best = (0, 0)
    for flows in itertools.product(*(range(min(repeats * capacity[p], quota[s]) + 1) for p, s in arcs)):
        used = {p: sum(f for (q, _), f in zip(arcs, flows) if q == p) for p in capacity}
        met = {s: sum(f for (_, t), f in zip(arcs, flows) if t == s) for s in quota}
        if all(used[p] <= repeats * capacity[p] for p in capacity) and all(met[s] <= quota[s] for s in quota):
            cost = sum(sum(min(capacity[p], max(0, used[p] - k * capacity[p])) * (k + 1) for k in range(repeats)) for p in capacity)
            best = max(best, (sum(flows), -cost))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_cheapest(seed):
    r = random.Random(seed)
    capacity = {p: r.randint(0, 3) for p in "abc"}
    members = {p: r.sample("xyz", r.randint(1, 2)) for p in capacity}
    quota = {s: r.randint(0, 4) for s in "xyz"}
    flow = mixing.min_cost_flow(capacity, members, quota, 2)
    got = {p: sum(f.values()) for p, f in flow.items()}
    assert all(sum(f.get(s, 0) for f in flow.values()) <= quota[s] for s in quota)
    cost = sum(sum(min(capacity[p], max(0, got[p] - k * capacity[p])) * (k + 1) for k in range(2)) for p in capacity)
    assert (sum(got.values()), -cost) == best_cost(capacity, members, quota, 2)


def test_mix(spark, docs):
    r = random.Random(2)
    rows = [(i, f"d{i} " + "w " * r.randint(0, 59)) for i in range(600)] + [(None, "a b"), (600, None), (3, "x y z"), (3, "x y z"), (601, "w " * 5000)]
    src = F.when(F.col("doc_id") % 3 == 0, "b").when(F.col("doc_id") % 3 == 1, "é").when(F.col("doc_id") < 300, "a")
    table = docs(rows).withColumn("source", src)
    got = mixing.mix_by_source(table, seed=1).collect()
    again = mixing.mix_by_source(table.repartition(7), seed=1).collect()
    key = lambda x: (x.doc_id if x.doc_id is not None else -1, x.size, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    total = sum(x.size for x in got)
    size, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for x in got:
        size[x.source] += x.size
        taken[x.source] += x.taken
        longest[x.source] = max(longest[x.source], x.size)
        assert target.setdefault(x.source, x.target) == x.target and x.taken <= 3 * x.size and x.taken == x.n_passes * x.size
    for s in size:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1
        assert all(x.source_size == size[s] for x in got if x.source == s)
    assert sum(target.values()) == pytest.approx(total)
    open_ = {s for s in target if target[s] < 3 * size[s] - 1e-6}
    weight = {"a": 1, "b": 2, "é": 3, None: 1}  # by code point, null last
    assert len({round(target[s] / weight[s], 6) for s in open_}) <= 1
    assert mixing.mix_by_source(docs([])).count() == 0


def test_targets_are_met_on_null_and_repeated_ids(spark, docs):
    r = random.Random(3)
    for ids, same in ((None, ""), (7, ""), (None, "always the same text")):
        rows = [(ids, same or f"t{i % 400} " + "w " * r.randint(5, 30)) for i in range(900)]
        source = (F.monotonically_increasing_id() % 3).cast("string") if same else (F.length("text") % 3).cast("string")
        table = docs(rows).coalesce(1).withColumn("source", F.concat(F.lit("s"), source))
        taken, target = defaultdict(int), {}
        for x in mixing.mix_by_source(table, seed=1).collect():
            taken[x.source] += x.taken
            target[x.source] = x.target
        assert all(abs(taken[s] - target[s]) <= (0.15 * target[s] if same else 62) for s in target) and len(target) == 3


def test_shared_texts_are_not_taken_for_each_source(spark):
    """200 texts stand in a and b; the quotas are met with every text once, which takes each shared text for one of them."""
    text = lambda i: f"t{i} " + "w " * 9
    rows = [(i, text(i), "a") for i in range(400)] + [(1000 + i, text(i), "b") for i in range(200)] + [(2000 + i, text(5000 + i), "b") for i in range(400)]
    got = mixing.mix_by_source(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=2).collect()
    of = lambda s: sum(x.taken for x in got if x.source == s)
    target = {x.source: x.target for x in got}
    assert target["a"] == pytest.approx(10000 / 3) and abs(of("a") - target["a"]) <= 10 and abs(of("b") - target["b"]) <= 10
    uses = defaultdict(int)
    for x in got:
        uses[x.text] += x.n_passes
        assert x.n_passes <= 3
    # 800 different texts of 10 words for 10000 words: once or twice each, but for a few where the sources of a pattern meet.
    assert sum(uses.values()) == pytest.approx(1000, abs=2) and sum(not 1 <= n <= 2 for n in uses.values()) <= 40


def test_many_patterns_need_no_driver(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    rows = [(i, f"t{i % 300} w w w", f"s{i % 7}") for i in range(900)]
    got = mixing.mix_by_source(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=2).collect()
    taken, target = defaultdict(int), {}
    for x in got:
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert all(abs(taken[s] - target[s]) <= 4 for s in target) and sum(target.values()) == pytest.approx(3600)


def test_mix_of_overlapping_sources(spark, docs):
    table = docs([(i, "w " * 10) for i in range(300)])
    both = F.when(F.col("doc_id") < 100, F.array(F.lit("x"))).when(F.col("doc_id") < 200, F.array(F.lit("y"), F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y")))
    got = mixing.mix(table, sources=both, weights={"x": 1, "y": 1}, seed=3).collect()
    assert all(x.n_passes == 1 for x in got)  # 3000 words for two quotas of 1500 need no repetition


# --- 8: pages


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    import html

    got = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1]))
        want = "\n\n".join(x for x in (" ".join(html.unescape(y).split()) for y in re.split(r"</?(?:p|h1)>", inner)) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><a href=/>home</a></header><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="sidebar"><p>Side text that is long enough to matter for density so that it would be found.</p></div>
<div class="post"><h2>Title &amp; more</h2><p>First <a href="x">link</a> paragraph with <!-- no --> many words in it, so that density is high.<p>Second   one
has&nbsp;a break<br>and goes on.</p><ul><li>one item<li>two items</ul><div class="ad-box">Buy now</div></div>
<section id="comments"><article class="comment"><p>I disagree with all of this, and here is a long reader comment which is dense.</p></article></section></div>
<form><p>Subscribe</p></form><footer>x</footer></body></html>"""


@pytest.mark.parametrize("page,want", [
    (PAGE, "Title & more\n\nFirst link paragraph with many words in it, so that density is high.\n\nSecond one has a break and goes on.\n\none item\n\ntwo items"),
    ("", ""), (None, ""), ("plain", "plain"), ("<p>x</p>" * 3, "x\n\nx\n\nx"), ("a < b and c > d", "a < b and c > d"), ("<div><p>a</div>tail", "a\n\ntail"),
    ("<script>var a='<p>no</p>';</script><p>yes", "yes"), ("<nav>menu</nav>", ""), ("<p>" + "w " * 50000, ("w " * 50000).strip()),
    ("<div>" * 3000 + "deep", "deep"), ("<p>&lt;b&gt; &#233; &eacute; &am", "<b> é é &am"),
])
def test_extract(page, want):
    assert html_text.extract(page) == want


def test_sections_are_kept_together():
    part = lambda n: "<section>" + "".join(f"<p>{'word ' * 30}{n}{i}</p>" for i in range(n)) + "</section>"
    page = f"<body><div><a href=x>one</a> <a href=y>two</a></div><div id=main>{part(3)}{part(8)}</div><div><a href=z>three</a></div></body>"
    assert len(html_text.extract(page).split("\n\n")) == 11


@pytest.mark.parametrize("outer", ["main", "article", "div"])
def test_short_sections_stay_beside_a_dense_one(outer):
    dense = "<section>" + "".join(f"<p>{'word ' * 60}{i}</p>" for i in range(5)) + "</section>"
    short = "<section><h2>List</h2><ul>" + "".join(f"<li>a rather short item of {i}</li>" for i in range(10)) + "</ul></section>"
    cells = "<table>" + "".join(f"<tr><td>cell {i}</td><td>{i}</td></tr>" for i in range(4)) + "</table>"
    links = "<div><a href=x>one</a> <a href=y>two</a></div>"
    got = html_text.extract(f"<body>{links}<{outer}>{dense}{short}{cells}</{outer}>{links}</body>")
    assert all(f"item of {i}" in got for i in range(10)) and all(f"cell {i}" in got for i in range(4)) and "one" not in got and len(got.split("\n\n")) == 24


@pytest.mark.parametrize("start,end", [("<div class='content has-sidebar'>", "</div>"), ("<div id=with-nav>", "</div>"), ("<form action=x>", "</form>"),
                                       ("<div class=no-related><form>", "</form></div>"), ("<div class=has-comments><h1>T</h1>", "</div>")])
def test_wrappers_around_the_page_stay(start, end):
    text = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(5))
    side = "<div class=sidebar><p>Side text that is quite dense and would be found.</p></div><form><p>Subscribe</p></form>"
    got = html_text.extract(f"<body><div><a href=x>home</a></div>{start}<div>{text}</div>{side}{end}</body>")
    assert got.count("word") == 200 and "Side" not in got and "Subscribe" not in got
    comments = "<section id=comments><article class=comment><p>" + "I disagree at length. " * 90 + "</p></article></section>"
    got = html_text.extract(f"<body><article>{text}</article>{comments}</body>")
    assert got.count("word") == 200 and "disagree" not in got


@pytest.mark.parametrize("start,end", [("<form id=aspnetForm><div>", "</div></form>"), ('<div class="layout with-sidebar">', "</div>"),
                                       ('<div class="content share-enabled">', "</div>"), ('<div class="article-promo">', "</div>")])
def test_words_alone_do_not_take_out_an_article(start, end):
    text = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(5))
    side = '<div class="cookie-notice"><p>We use cookies on this page.</p></div><div class="sidebar"><ul><li><a href=x>More of this</a></ul></div>'
    got = html_text.extract(f"<body><nav><a href=x>home</a></nav>{start}{text}{side}{end}<footer>foot</footer></body>")
    assert got.count("word") == 200 and not re.search("cookies|More|home|foot", got)


@pytest.mark.parametrize("name", ["related-work", "discussion"])
def test_sections_named_like_boilerplate_stay(name):
    part = lambda k: "".join(f"<p>{'word ' * 40}{k}{i}</p>" for i in range(5))
    comments = "<div id=comments><div class=comment><p>" + "I disagree with it. " * 60 + "</p></div></div>"
    got = html_text.extract(f"<body><article><section id=intro>{part(1)}</section><section id={name}>{part(2)}</section></article>{comments}</body>")
    assert got.count("word") == 400 and "disagree" not in got


def test_pages_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = html_text.extract_pages(df)
    assert sorted(r.text for r in got.collect()) == ["", "a", "a"] and got.columns == ["page_id", "url", "text", "n_chars"]
    assert html_text.extract_pages(df.limit(0)).count() == 0


# --- the pipeline


def test_pipeline_stage_by_stage(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), "test")
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count() > 0.5 * len(before)
        if name == "near-duplicates":
            ids = sorted(after)
            assert all(similarity(after[a].text, after[b].text) < 0.8 for i, a in enumerate(ids) for b in ids[:i])
            for i in set(before) - set(after):
                assert any(similarity(before[i].text, x.text) >= 0.8 for x in before.values() if x.doc_id != i)
        if name == "pii":
            assert not any("555-" in x.text and re.search(r"\+1 \(\d{3}\) 555-\d{4}", x.text) for x in after.values())
        if name != "mixing":
            assert out.columns == names
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


@pytest.mark.parametrize("name", ["cookie-banner", "cookieBanner", "ad-box", "ad-slot-300x250", "sidebar", "newsletter-signup", "notice", "promo-unit first"])
def test_long_notices_and_adverts_go(name):
    """A part of the page that is named by a whole name goes, though it has a third of the text."""
    para = lambda k: f"<p>{' '.join(f'w{k}x{i}' for i in range(40))}.</p>"
    article = para(1) + para(2)
    for at in ("id", "class"):
        page = f'<body><div {at}="{name}">{para(3)}</div><div class="wrapper"><div class="content">{article}</div></div></body>'
        assert html_text.extract(page) == article.replace("</p><p>", "\n\n")[3:-4]
        # The same word as a part of another name tells of the layout.
        other = f'<body><div class="with-{name.split()[0]}"><div>{article}</div></div></body>'
        assert html_text.extract(other) == article.replace("</p><p>", "\n\n")[3:-4]
