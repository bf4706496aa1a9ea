"""Operators 1, 4, 6 and 9 on small tables."""

import hashlib
import random
import re
import textwrap
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, license_scan, pii, quality_rules

W = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.lower())


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- 1: licenses


def test_licenses(docs):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
    table = docs([(1, "MIT License. x mit  license\nCC-BY"), (2, None), (3, ""), (4, "the mit licenses"), (None, "Apache License"),
                  (5, gpl), (5, gpl), (6, "Apache License,\nApache LICENSE gnu general public license " + "w " * 20000),
                  (7, "Licensed under the Apache License; Version 2.0!"), (8, "licensed under the version 2")])
    got = license_scan.scan(table)
    found = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 3)) for r in got.collect()}
    assert found == {
        (1, 7, 3, 0, 5, "cc-by,mit", "cc-by,mit", 1.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
        (4, 3, 0, None, None, "", "", 0.0), (None, 2, 1, 0, 0, "apache", "apache", 1.0),
        (5, 22, 1, 18, 18, "gpl", "gpl,gpl-notice", 1.0),
        (6, 20008, 3, 0, 4, "apache,gpl", "apache,gpl", 1.0), (7, 8, 1, 3, 3, "apache", "apache,apache-2.0", 1.0),
        (8, 5, 0, None, None, "", "", 0.0)}
    assert got.count() == 10 and license_scan.scan(docs([])).count() == 0


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
@pytest.mark.parametrize("width", [30, 75])
def test_wrapped_notices(docs, mark, width):
    notices = [(label, notice) for label, notice in license_scan.TEMPLATES]
    wrap = lambda x: "".join(f"{mark}{y}\n" for y in textwrap.wrap(x, width))
    texts = [f"/*\n{mark}Some file.\n{mark}\n{wrap(x)}{mark}\n{mark}The end.\n" for _, x in notices]
    got = {r.doc_id: r for r in license_scan.scan(docs(list(enumerate(texts)))).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score >= 0.8 and got[i].n_blocks >= 1 for i, (label, _) in enumerate(notices))
    # Halves of a notice that a blank line parts are two blocks; two notices of one paragraph on lines of their own are two.
    bsd = next(x for label, x in notices if label == "bsd")
    half = bsd.split(",")
    rows = [(1, half[0] + "\n\n" + ",".join(half[1:])), (2, "\n".join([bsd, "x", bsd]))]
    got = {r.doc_id: (r.labels, r.n_blocks) for r in license_scan.scan(docs(rows)).collect()}
    assert got == {1: ("", 0), 2: ("bsd", 2)}


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_license_join_is_exact(spark, threshold):
    r = random.Random(1)
    vocabulary = sorted({w for _, t in license_scan.template_words() for w in t})
    lines = []
    for _ in range(300):
        own = list(r.choice(license_scan.template_words())[1])
        r.shuffle(own)
        lines.append(" ".join(own[: r.randint(1, len(own))] + r.choices(vocabulary + ["zzz"], k=r.randint(0, 4))))
    df = spark.createDataFrame([(str(i), 0, x) for i, x in enumerate(lines)], "_id string, _hash long, text string")
    got = rows(license_scan.template_matches(df, threshold=threshold), "_id", "_template")
    want = [(str(i), k) for i, x in enumerate(lines) for k, (_, t) in enumerate(license_scan.template_words())
            if len(set(t) & set(x.split())) >= threshold * len(t) - 1e-9]
    assert got == sorted(want, key=repr) and want


# --- 4: decontamination


def test_decontamination_is_exact(spark, docs):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.randint(3, 40)))) for i in range(30)] + [(40, "W1, w2"), (41, "w3"), (30, None), (31, ""), (None, "a b c d e f"), (32, "a b c d e f")]
    texts = []
    for i in range(60):
        base = W(r.choice(items[:30])[1])
        cut = base[r.randint(0, 3):]
        texts.append((i, " ".join(r.choices(words, k=r.randint(0, 300)) + cut + r.choices(words, k=50))))
    texts += [(100, None), (101, ""), (None, "X. a B c d e f"), (102, texts[0][1]), (0, texts[0][1]), (103, "v " * 30000 + items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("_h", F.lit(1))
    sh = lambda t, n=5: {tuple(w[k : k + n]) for w in [W(t or "")] for k in range(len(w) - n + 1)}
    want = set()
    for i, t in items:
        n = min(len(W(t or "")), 5)
        for d, x in texts if i is not None and n else ():
            if len(sh(t, n) & sh(x, n)) >= 0.8 * len(sh(t, n)):
                want.add((d, i, len(sh(t, n)), len(sh(t, n) & sh(x, n))))
    want = sorted(want, key=repr)
    assert any(len(W(t or "")) < 5 for d, i, *_ in want for j, t in items if i == j)
    table = docs(texts)
    assert rows(decontaminate.search(table, bench), "doc_id", "item_id", "n_shingles", "n_shared") == want and len(want) > 20
    left = decontaminate.decontaminate(table, bench)
    bad = {d for d, *_ in want}
    assert left.columns == table.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in texts if d not in bad and d is not None)
    assert decontaminate.search(docs([]), bench).count() == 0 and decontaminate.search(table, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(table, bench.limit(0)).count() == len(texts)


def test_items_with_a_common_phrase(spark, docs):
    """A phrase of all items makes no candidates of the documents that hold it alone."""
    phrase = "which of the following statements about it is true"
    bench = spark.createDataFrame([(i, f"{phrase} " + " ".join(f"q{i}x{k}" for k in range(12))) for i in range(50)], "item_id long, text string")
    signed = decontaminate.signatures(bench)
    assert signed.groupBy("_h").count().where("count > 1").count() == 0
    got = decontaminate.search(docs([(1, phrase), (2, "what is pi, then"), (3, bench.first().text)]), bench.union(spark.createDataFrame([(99, "What is pi?")], bench.schema)))
    assert rows(got, "doc_id", "item_id") == [(2, 99), (3, 0)]


def test_only_rows_with_an_item_go(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    table = docs([(None, "x a b c d e f"), (None, "clean text"), (None, None), (7, "a b c d e f y"), (7, "other clean text"), (8, "clean text")])
    left = decontaminate.decontaminate(table, bench)
    assert rows(left, "doc_id", "text") == sorted([(None, "clean text"), (None, None), (7, "other clean text"), (8, "clean text")], key=repr)


# --- 6: quality rules


def brute_statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if n[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_statistics(docs):
    r = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b", "a a a a", "a b c a b c", "x y \U0001f600 é", "#|<>\n#|<>\n\nx\n \nx", "b " * 30000]
    texts += ["".join(r.choices(["a", "b", "cc", " ", " ", "\n", "\x0b", "|"], k=r.randint(0, 200))) for _ in range(60)]
    got = quality_rules.text_statistics(docs(list(enumerate(texts))).select("doc_id", "text"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert rows(got, *names) == sorted(((i, *brute_statistics(t)) for i, t in enumerate(texts)), key=repr)


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 10), (10, 10), (40, 2000), (0, 1), (7, 500), (0, 0)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.03).alias("p"))
    for k, n, p in df.collect():
        assert p == pytest.approx(sum(comb(n, j) * 0.03**j * 0.97 ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_risk_is_controlled(spark, docs):
    r = random.Random(4)
    good = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(60))
    bad = lambda: " ".join(f"w{r.randint(0, 10**6)}%%%" for _ in range(60))
    n = 900
    table = docs([(i, bad() if i % 10 == 0 else good()) for i in range(n)] + [(n, "short"), (n + 1, None), (None, good())])
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1, 0) for i in range(n)] + [(1, 0, None), (None, 1, 0), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(table, labels).collect()}
    assert all(got[i] == bool(i % 10) for i in range(n)) and not got[n] and not got[n + 1] and got[None]
    # Too few labels to certify anything: only the base rule rejects.
    few = {r.doc_id: r.kept for r in quality_rules.apply_rules(table, labels.where("doc_id < 100")).collect()}
    assert all(few[i] for i in range(n))
    assert quality_rules.apply_rules(table, labels.limit(0)).count() == n + 3
    assert quality_rules.apply_rules(docs([]), labels).count() == 0


# --- 9: pseudonyms


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(docs):
    private = ["4845168114407329", "4845 1681 1440 7329", "und.34@mail7.example.com", "+1 (017) 555-7713", "97.51.17.173", "2001-02-28",
               "12/31/1999", "31/12/1999", "05.06.1987", "123-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "020-555-1234"]
    public = ["9807915762804490", "999.1.1.1", "2001-02-30", "1.2.3", "12345", "000-12-3456", "a@b", "1850-01-01", "v1.2.3.4.5", ""]
    texts = [(i, f"é {x}, x") for i, x in enumerate(private)] + [(50 + i, f"é {x}, x") for i, x in enumerate(public)]
    texts += [(90, None), (91, " ".join(private)), (91, " ".join(private)), (None, private[0]), (92, "y " * 20000 + private[4])]
    table = docs(texts)
    got = pii.pseudonymize(table, key="k")
    new = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(texts) and [c for c in got.columns if c in table.columns] == table.columns
    for i, x in enumerate(private):
        y = new[i].text[2:-3]
        assert x not in new[i].text and new[i].n_private == 1, x
        if not re.match(r"\d+\.\d+\.\d+\.\d+$", x):
            shape = lambda s: re.sub(r"[0-9]" if "token" not in s else r"[0-9a-f]{40}", "9", s)
            assert re.sub(r"[a-z]+", "a", shape(y)) == re.sub(r"[a-z]+", "a", shape(x))
        assert y in new[91].text  # equal values stay linked
    assert luhn(new[0].text) and luhn(new[1].text) and new[None].text == new[0].text[2:-3]
    assert all(new[50 + i].text == f"é {x}, x" and new[50 + i].n_private == 0 for i, x in enumerate(public))
    assert new[90].text is None and new[90].n_private == 0 and new[91].n_private == len(private) and new[92].n_ip == 1
    other = {r.doc_id: r.text for r in pii.pseudonymize(table, key="other").collect()}
    assert other[0] != new[0].text
    plain = pii.pseudonymize(table, key="k", counts=False, length="n_chars")
    assert plain.columns == table.columns and all(r.n_chars == len(r.text or "") for r in plain.where("doc_id is not null").collect())
    assert pii.pseudonymize(docs([]), key="k").count() == 0


def feistel(x, key, kind):
    """The permutation of a string, letter by letter in plain Python."""
    l, r = x[: len(x) // 2], x[len(x) // 2 :]
    for i in range(8):
        digest = bytes.fromhex(hashlib.sha512(f"{key}|{kind}|{i}|{r}".encode()).hexdigest())
        new = ""
        for k, c in enumerate(l):
            for base, size in (("0", 10), ("a", 26), ("A", 26)):
                if 0 <= ord(c) - ord(base) < size and c.isascii():
                    c = chr((ord(c) - ord(base) + digest[k % 64]) % size + ord(base))
                    break
            new += c
        l, r = r, new
    return l + r


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_spellings_of_a_value_stay_linked(docs):
    spelled = {"card": ["4845168114407329", "4845 1681 1440 7329", "4845-1681-1440-7329"],
               "phone": ["+1 (663) 555-6869", "663-555-6869", "(663) 555-6869", "663.555.6869"],
               "abroad": ["+49 30 1234567", "+49-30-1234567", "+49301234567", "+49 (30) 1234567"],
               "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"], "gb": ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"],
               "ipv6": ["2001:db8:85a3::8a2e:370:7334", "2001:0DB8:85a3:0000:0000:8a2e:0370:7334"]}
    flat = [(k, x) for k, own in spelled.items() for x in own]
    plain = ["DE88370400440532013000", "12:34:56", "std::string::npos", "a::b", "+12 34", "GB82 WEST 1234 5698 7654 33"]
    got = {r.doc_id: r for r in pii.pseudonymize(docs([(i, f"x {x} y") for i, (_, x) in enumerate(flat)] + [(100 + i, f"x {x} y") for i, x in enumerate(plain)]), key="k").collect()}
    made = defaultdict(list)
    for i, (k, x) in enumerate(flat):
        y = got[i].text[2:-2]
        assert got[i].n_private == 1 and y != x
        if k != "ipv6":
            assert re.sub("[0-9]", "0", re.sub("[A-Z]", "A", y)) == re.sub("[0-9]", "0", re.sub("[A-Z]", "A", x))
        made[k].append(re.sub(r"[^0-9A-Za-z]", "", y)[-10:] if k == "phone" else re.sub(r"[^0-9A-Za-z]", "", y))
    assert all(len(set(x)) == 1 for x in made.values())
    assert made["card"][0][:-1] == feistel("484516811440732", "k", "card") and luhn(made["card"][0])
    assert made["phone"][0] == feistel("6635556869", "k", "phone") and made["abroad"][0] == "49" + feistel("301234567", "k", "phone")
    assert made["iban"][0][4:] == feistel("370400440532013000", "k", "iban") and all(mod97(made[k][0]) == 1 for k in ("iban", "gb"))
    assert all(got[100 + i].text == f"x {x} y" for i, x in enumerate(plain))


def test_single_letters_do_not_stay(docs):
    import string

    for key in ("k", "tidemark"):
        got = pii.pseudonymize(docs([(i, f"{c}@x.com") for i, c in enumerate(string.ascii_lowercase)]), key=key).collect()
        new = {r.doc_id: r.text[0] for r in got}
        assert len(set(new.values())) == 26 and all(string.ascii_lowercase[i] != c for i, c in new.items())
        assert len({(ord(c) - 97 - i) % 26 for i, c in new.items()}) > 3


@pytest.mark.parametrize("before", ["_", "-", "+", ".", "%", "é", "é.", "für.", "a@b.com-", "a@b.com,", "(", ""])
def test_addresses_after_any_character(docs, before):
    got = pii.pseudonymize(docs([(1, f"x {before}joe12@mail7.example.com_ y"), (2, before + "joe12@x.com")]), key="k").collect()
    for r in got:
        assert r.n_email == 1 + before.count("@") and "joe12" not in r.text and not re.search(r"\bfür", r.text)
        assert len(r.text) == len(before) + {1: 28, 2: 11}[r.doc_id]


def test_permutations(spark):
    days = spark.range(72_900).select(pii._pair_permutation(F.col("id"), 270, "k", "date").alias("x"))
    assert days.distinct().count() == 72_900 and days.agg(F.min("x"), F.max("x")).first() == (0, 72_899)
    codes = spark.range(10_000).select(pii._text_permutation(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "text").alias("x"))
    assert codes.distinct().count() == 10_000 and codes.where("length(x) <> 4").count() == 0
