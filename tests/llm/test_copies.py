"""Operators 3 and 10 against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import near_dedup, suffix_dedup
from tidemark.llm.components import connected_components

W = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.lower())


def similarity(a, b):
    sh = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()
    a, b = sh(W(a or "")), sh(W(b or ""))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def classes(texts, threshold=0.8):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or similarity(texts[i], texts[j]) >= threshold:
                parent[find(i)] = find(j)
    groups = defaultdict(set)
    for i in range(len(texts)):
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def corpus(r):
    word = lambda: f"w{r.randrange(500)}"
    texts = [None, "", "", "a b", "A b!", "one", "x " * 400, "x " * 390, "x " * 100, "long " + " ".join(word() for _ in range(20000))]
    for _ in range(12):
        base = [word() for _ in range(r.randint(30, 300))]
        texts += [" ".join(edited(r, base, e)) for e in (0, 0, 1, 2, 5, 20, 60)]
    boiler = " ".join(word() for _ in range(60))
    texts += [boiler + " " + " ".join(word() for _ in range(60)) for _ in range(20)]
    return texts


def test_classes_match_brute_force(docs):
    texts = corpus(random.Random(5))
    table = docs([(i, t) for i, t in enumerate(texts)])
    got = defaultdict(set)
    found = near_dedup.near_duplicates(table).collect()
    for r in found:
        got[r.class_id].add(r.doc_id)
    assert {frozenset(g) for g in got.values()} == classes(texts)
    assert all(k == min(g) for k, g in got.items()) and all(r.class_size == len(got[r.class_id]) and r.first == (r.doc_id == r.class_id) for r in found)
    kept = near_dedup.deduplicate(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(got)


def test_large_buckets_lose_no_link(docs):
    """A group far above the bucket limit, and texts that only share a long passage with it."""
    r = random.Random(6)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    texts = [" ".join(edited(r, base, 1)) for _ in range(90)]
    texts += [" ".join(base[:100] + [f"z{r.randrange(10**6)}" for _ in range(90)]) for _ in range(50)]
    pair = base[:100] + [f"y{r.randrange(10**6)}" for _ in range(90)]
    texts += [" ".join(edited(r, pair, 1)) for _ in range(6)]
    found, roots = near_dedup.links(docs(list(enumerate(texts))), small=8)
    assert Counter(map(len, classes(texts))) == {90: 1, 1: 50, 6: 1}
    sizes = Counter(Counter(x["root"] for x in roots.collect()).values())
    assert sizes == {90: 1, 6: 1}


def test_pairs_within_shared_boilerplate(docs):
    """Texts that share most of their words with all others, and enough with one of them only."""
    word, texts = lambda kind, k: f"{kind}{k}", []
    common = [word("c", k) for k in range(400)]
    for p in range(200):
        pair = [word("p", f"{p}x{k}") for k in range(14)]
        texts += [" ".join(common + pair + [word("o", f"{p}x{q}x{k}") for k in range(42)]) for q in range(2)]
    assert similarity(texts[0], texts[1]) >= 0.8 > similarity(texts[0], texts[2])
    got = near_dedup.near_duplicates(docs(list(enumerate(texts)))).collect()
    assert all(r.class_id == r.doc_id // 2 * 2 and r.class_size == 2 for r in got) and len(got) == 400


def test_copies_are_linked_through_their_original(docs):
    """Copies that are close to one text and not to each other, beside some that are too far from it."""
    r = random.Random(10)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    near, far = ([edited(r, base, n) for _ in range(70)] for n in (2, 5))
    texts = [" ".join(t) for t in [*near, base, *far]]
    found, roots = near_dedup.links(docs(list(enumerate(texts))), small=8)
    assert max(map(len, classes(texts))) >= 71
    assert sorted(Counter(x["root"] for x in roots.collect()).values()) == sorted(n for n in map(len, classes(texts)) if n > 1)


def test_copies_of_copies_stay_with_a_large_group(docs):
    """Texts too far from the pivot of a group of over 1000, and near one of its other members alone."""
    r = random.Random(11)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    copies = [edited(r, base, r.randint(1, 2)) for _ in range(1100)]
    # A member that is shorter than the pivot, and one shorter still: neither has a shingle the pivot lacks.
    again = [(x, edited(r, x, 2)) for x in copies[:200]] + [(base[:100], base[:82])]
    texts = [" ".join(x) for x in [base, *copies, base[:100], *(y for _, y in again)]]
    joined = [similarity(" ".join(x), " ".join(y)) >= 0.8 for x, y in again]
    assert sum(similarity(texts[0], " ".join(y)) < 0.8 for (_, y), ok in zip(again, joined) if ok) > 50
    table = docs(list(enumerate(texts)))
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(table).collect()}
    at = len(texts) - len(again)
    lost = [at + i for i, ok in enumerate(joined) if ok and got[at + i] != 0]
    assert not lost and all(got[i] == 0 for i in range(at))


def test_repeated_rows_nulls_and_empty(spark, docs):
    table = docs([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "z"), (4, "y")])
    got = near_dedup.near_duplicates(table).collect()
    assert sorted((r.class_id, r.class_size) for r in got if r.class_id is not None) == [(3, 3), (3, 3), (3, 3), (4, 1)]
    assert near_dedup.deduplicate(table).count() == 3
    assert near_dedup.near_duplicates(docs([])).count() == 0 and near_dedup.deduplicate(docs([])).count() == 0


def test_signature_estimates_probability_jaccard():
    r = np.random.default_rng(7)
    a = {int(x): float(w) for x, w in zip(r.integers(1, 2**62, 60), r.integers(1, 5, 60))}
    b = dict(list(a.items())[:40]) | {int(x): 1.0 for x in r.integers(1, 2**62, 20)}
    jp = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in set(x) | set(y)) for x, y in
             [({k: a.get(k, 0.0) for k in set(a) | set(b)}, {k: b.get(k, 0.0) for k in set(a) | set(b)})] for d in set(a) & set(b))
    text = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    sig = near_dedup.prob_minhash(text, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, 4096)
    assert (sig[0] == sig[1]).mean() == pytest.approx(jp, abs=0.035) and (sig > 0).all()


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs(spark):
    """Hubs in the middle of their neighbours, joined to each other by a chain, one of them apart."""
    edges = [(1000, k) for k in range(100, 1000)] + [(1000, k) for k in range(1001, 1900)] + [(1899, 5000), (5000, 5001)]
    edges += [(5001, k) for k in range(5002, 5400)] + [(9000, k) for k in range(9001, 9400)] + [(20000, 20001)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 100 for e in edges[:2199] for k in e} | {k: 9000 for k in range(9000, 9400)} | {20000: 20000, 20001: 20000}
    assert got == want


def covered(texts, least):
    places = defaultdict(list)
    for i, t in enumerate(texts):
        w = W(t or "")
        for p in range(len(w) - least + 1):
            places[tuple(w[p : p + least])].append((i, p))
    out = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                out[i].update(range(p, p + least))
    return out


@pytest.mark.parametrize("least", [50, 20])
def test_passages_match_brute_force(docs, least):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (least - 1, least, least + 1, 80, 200)]
    texts = []
    for _ in range(60):
        t = [word() for _ in range(r.randrange(120))]
        for _ in range(r.randrange(3)):
            t += r.choice(passages) + [word() for _ in range(r.randrange(30))]
        texts.append(" ".join(t))
    texts += [None, "", texts[0], texts[0], "s " * 3000, " ".join(word() for _ in range(20000)), " ".join(passages[3] + passages[3])]
    got = defaultdict(set)
    for x in suffix_dedup.repeated_passages(docs(list(enumerate(texts))), min_words=least).collect():
        assert x.n_words >= least and x.first_id <= x.doc_id
        got[x.doc_id].update(range(x.start_word, x.end_word))
    assert {k: v for k, v in got.items() if v} == dict(covered(texts, least))


def test_passages_of_repeated_rows(docs):
    t = " ".join(f"w{i}" for i in range(60))
    got = suffix_dedup.repeated_passages(docs([(None, t), (2, t), (2, t), (3, "short"), (None, None)])).collect()
    assert sorted(((x.doc_id or 0), x.start_word, x.end_word, x.first_id) for x in got) == [(0, 0, 60, 2), (2, 0, 60, 2), (2, 0, 60, 2)]
    assert suffix_dedup.repeated_passages(docs([])).count() == 0
