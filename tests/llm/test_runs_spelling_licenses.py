"""Periodic runs, spelling variants and licence scans against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmeld.llm import licenses, periodic, queries, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, repeats=3):
    """Every maximal run by trying each period in full."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > start and end - start + q >= max(least, repeats * q):
                found.setdefault((start, end - start + q), q)
            start = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def sequences(r):
    """Sequences with runs of all sorts: nested, overlapping, barely long enough, of grams that come twice in a period."""
    for _ in range(60):
        letters = r.choice([1, 2, 3, 30])
        out = [r.randrange(letters) for _ in range(r.randrange(120))]
        for _ in range(r.randrange(4)):
            q = r.choice([r.randrange(1, 9), r.randrange(9, 40), r.randrange(40, 200)])
            unit = [r.randrange(r.choice([2, 50])) for _ in range(q)]
            if r.random() < 0.3:
                x = [r.randrange(9) for _ in range(r.randrange(5, 40))]
                unit = [*x, 100, *x, 100, *x, 101, *x, 101]
            n = max(1, 3 * len(unit) + r.choice([-1, 0, 1, 2, len(unit), 5 * len(unit)]))
            at = r.randrange(len(out) + 1)
            out[at:at] = (unit * 9)[:n]
        yield out
    word = [0]
    for _ in range(11):  # a Thue-Morse word and its opposite, three times over
        word = word + [1 - x for x in word]
    yield (word[:700] + [2]) * 4
    fib = ([0], [0, 1])
    for _ in range(12):
        fib = (fib[1], fib[1] + fib[0])
    yield fib[1]
    yield [0] * 5000


def test_runs_equal_those_of_all_periods_tried():
    for x in sequences(random.Random(5)):
        assert periodic.runs_of(np.array(x, dtype=np.int64), len(x)) == plain_runs(x), x


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 6), st.lists(st.integers(0, 2), max_size=30))
def test_runs_of_any_unit(before, unit, times, after):
    x = before + unit * times + unit[: len(unit) // 2] + after
    assert periodic.runs_of(np.array(x, dtype=np.int64), len(x)) == plain_runs(x)


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_find_runs_on_rows_of_all_sorts(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t", "a", "x " * 23, "x " * 24, "x y " * 30, "é z\n" * 40, " ".join(map(str, (list(range(300)) * 4)[:1000])), " ".join(str(r.randrange(10**6)) for _ in range(60_000)) + " and on" * 30, "word " * 200_000]
    texts += [" ".join(map(str, x)) for x in list(sequences(r))[:40]]
    rows = [(i, t, [7], "own") for i, t in enumerate(texts)] + [(None, "b c " * 20, None, None), (5, texts[5], [1], "twice")]
    docs = spark.createDataFrame(rows, "id long, text string, runs array<long>, collapsed string").withColumn("start", F.lit(1)).repartition(3)
    began = time.time()
    found = periodic.find_runs(docs).collect()
    assert time.time() - began < 60 and len(found) == len(rows)
    for row in found:
        words = WORD.findall(row["text"] or "")
        if len(words) < 20_000:
            want = plain_runs(words)
            assert [tuple(x) for x in row["runs"]] == want
            assert row["collapsed"] == " ".join(collapsed(words, want)) and row["start"] == 1
    assert [tuple(x) for x in next(x for x in found if x["id"] == 10)["runs"]] == [(0, 200_000, 1)]
    assert [x["period"] for x in next(x for x in found if x["id"] == 9)["runs"]] == [2]
    assert periodic.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, min_repeats=2)


def contract_text(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op11_contract(spark, tmp_path):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["a", "b", "é", "d"]) + str(r.randrange(5)) for _ in range(r.randrange(200)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (None, "a " * 50), (7, docs[7][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in docs:
        words = contract_text(i, text)
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((i, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(collapsed(words, runs)))))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert [x[1] for x in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and sum(w[1] for w in want) > 10


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, factor=2):
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = [v for v in counts if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def some_words(r, n, letters="abé", longest=9):
    head = "".join(r.choice("xy") for _ in range(6))
    return {(head if r.random() < 0.4 else "") + "".join(r.choice(letters) for _ in range(r.randrange(1, longest))) for _ in range(n)}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(alphabet="abÿ\U0001f600", min_size=1, max_size=7), min_size=1, max_size=40))
def test_the_sorted_list_gives_all_words_within_an_edit(words):
    words = sorted(words)
    ordered, ends = spelling.Sorted(words), sorted(w[::-1] for w in words)
    back = spelling.Sorted(ends)
    for w in words:
        for anchor in range(len(w) + 1):
            assert [words[i] for i in ordered.near(w, anchor)] == [v for v in words if v.startswith(w[:anchor]) and one_edit(w, v)]
        half = len(w) // 2
        found = {words[i] for i in ordered.near(w, half)} | {ends[i][::-1] for i in back.near(w[::-1], len(w) - half)}
        assert found == {v for v in words if one_edit(w, v)}
        assert all(spelling.prefix_within(v[:k], w) for v in found for k in range(len(v) + 1))


def test_variants_over_many_pieces_equal_the_plain_version(spark, monkeypatch):
    r = random.Random(4)
    counts = {w: r.choice([3, 4, 6, 8, 16, 40]) for w in some_words(r, 700)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", F.lit("own")).repartition(4)
    for piece, asked in ((20_000, 50_000), (40, 30)):
        monkeypatch.setattr(spelling, "PIECE", piece)
        monkeypatch.setattr(spelling, "QUERIES", asked)
        got = spelling.spelling_variants(vocab).collect()
        assert len(got) == len(counts) and set(map(tuple, got)) == plain_variants(counts)


def test_variants_of_odd_vocabularies(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.spelling_variants(empty).count() == 0
    long = "w" * 30_000
    rows = [(None, 9), ("", 50), ("a", 9), ("ab", 3), (long, 3), (long + "x", 6), (long[:-1] + "y", 12)]
    got = {x["word"]: x for x in spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert len(got) == 7 and got[None]["n_near"] == 0 and got[""]["n_near"] == 0
    assert got["ab"]["form"] == "a" and got[long]["form"] == long[:-1] + "y" and got[long]["n_near"] == 2
    with pytest.raises(ValueError):
        spelling.spelling_variants(empty, factor=1)


def test_op12_contract(spark, tmp_path):
    r = random.Random(8)
    pool = sorted(w for w in some_words(r, 250, "abcÀÿ", 8) if len(w) > 3)
    docs = [(i, " ".join(r.choice(pool[: r.choice([20, 250])]).upper() if r.random() < 0.2 else r.choice(pool) for _ in range(60)) + "Straße's x9y") for i in range(90)]
    docs += [(500, None), (501, ""), (None, " ".join(pool)), (4, docs[4][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = plain_variants({w: n for w, n in counts.items() if n >= 3 and len(w) >= 5})
    got = queries.op12_spelling_variants(spark, str(tmp_path))
    assert set(map(tuple, got.collect())) == want and any(x[1] for x in want)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_places(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = LICENCE_WORD.findall(lower)
    out = []
    for kind, listed in (("base", licenses.BASE), ("notice", licenses.NOTICES)):
        for phrase, label in listed.items():
            p = phrase.split()
            out += [(i, i + len(p), label, kind) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return words, sorted(out)


def test_phrases_against_plain_search(spark):
    r = random.Random(6)
    pool = sorted({w for p in (*licenses.BASE, *licenses.NOTICES) for w in p.split()}) + ["permit", "licenses", "é", "mité"]
    texts = ["", None, "MIT License mit-license, MIT LICENSE", "emit license", "the gnu general public\nlicense", "mit—license", "mit license", "mit license " * 30_000]
    for _ in range(300):
        words = [r.choice(pool) for _ in range(r.randrange(30))]
        words[3:3] = r.choice([*licenses.BASE, *licenses.NOTICES]).split()
        texts.append(r.choice([" ", "\n", ", "]).join(w.upper() if r.random() < 0.1 else w for w in words))
    rows = [(i, t, "own", 5) for i, t in enumerate(texts)] + [(0, "mit license", None, None), (None, "mit license", None, None)]
    docs = spark.createDataFrame(rows, "id long, text string, licenses string, score int").repartition(3)
    found = licenses.scan_licenses(docs).collect()
    assert len(found) == len(rows)
    for row in found:
        words, want = plain_places(row["text"])
        assert row["n_words"] == len(words) and [tuple(x) for x in row["licenses"]] == want
        assert (row["score"] > 0) == bool(want) and 0 <= row["score"] <= 1
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def read(text):
    labels, rank, tokens, whole = licenses.read_expression(text)
    return labels, licenses.OBLIGATIONS[rank], " ".join(tokens), whole


def test_licence_expressions():
    assert read("mit") == (["mit"], "permissive", "mit", True)
    assert read("mit or gpl-3.0-only") == (["mit", "gpl"], "permissive", "mit or gpl-3.0-only", True)
    assert read("mit and gpl-2.0+ or bsd-3-clause")[1] == "permissive" and read("mit and (gpl-2.0 or lgpl-2.1-or-later)")[1] == "weak"
    assert read("gpl-2.0-only with classpath-exception-2.0 and mit")[1] == "weak" and read("gpl-2.0-only with odd-exception")[1] == "strong"
    assert read("(mit)")[2] == "(mit)" or read("(mit)")[2] == "( mit )"
    assert read("mit or or gpl-2.0") == (["mit"], "permissive", "mit", False)
    assert read("apache-2.0. see the file") == (["apache"], "permissive", "apache-2.0", True)
    assert read("(mit or gpl-2.0")[2:] == ("", False) and read("nothing here")[2] == "" and read("") == ([], "unknown", "", True)
    assert read("licenseref-own and mit")[:2] == (["licenseref", "mit"], "unknown")
    assert read("mit) or gpl-2.0")[2] == "mit" and read("(mit or isc) with classpath-exception-2.0")[2] == "( mit or isc )"
    began = time.time()
    read("(" * 200_000)
    read("mit or " * 100_000)
    assert time.time() - began < 5


def value(x):
    return x if isinstance(x, int) else min(map(value, x[1:])) if x[0] == "or" else max(map(value, x[1:]))


def test_expressions_against_their_trees():
    r = random.Random(9)
    ids = {"mit": 0, "mpl-2.0": 1, "gpl-2.0-only": 2, "licenseref-a": 3}

    def tree(depth):
        if not depth or r.random() < 0.3:
            name = r.choice(sorted(ids))
            return name, ids[name], 3
        op = r.choice(["and", "or"])
        binds = 2 if op == "and" else 1
        (a, x, m), (b, y, n) = tree(depth - 1), tree(depth - 1)
        a, b = (f"({a})" if m < binds or r.random() < 0.2 else a), (f"( {b} )" if n <= binds and n != 3 or r.random() < 0.2 else b)
        return f"{a} {op} {b}", (op, x, y), binds

    for _ in range(300):
        text, want, _ = tree(4)
        _, rank, _, whole = licenses.read_expression(text)
        assert (rank, whole) == (value(want), True), text


def test_tags_add_places_and_op13_contract(spark, tmp_path):
    docs = [(1, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\ncode"), (2, "Released under the MIT License. Licensed under the Apache License, Version 2.0. mit license"), (3, None), (4, "spdx-license-identifier: unheard-of"), (None, "gnu general public license"), (2, "again"), (5, "@license GPL-2.0-only WITH Classpath-exception-2.0\nSPDX-License-Identifier: MIT é ")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x["doc_id"], x["n_words"]): x for x in queries.op13_license_scans(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    one = got[1, 13]
    assert (one["n_base"], one["first_word"], one["base_labels"], one["labels"]) == (0, None, "", "apache,bsd,mit") and one["expressions"].endswith("-> permissive")
    two = got[2, 15]
    assert (two["n_base"], two["first_word"], two["last_word"], two["base_labels"]) == (3, 3, 13, "apache,mit")
    assert got[3, 0]["score"] == 0 and got[4, 5]["labels"] == "" and got[None, 4]["base_labels"] == "gpl"
    assert got[5, 15]["labels"] == "gpl,mit" and "-> weak; mit -> permissive" in got[5, 15]["expressions"]
    for (i, n), x in got.items():
        words, places = plain_places(next(t for d, t in docs if d == i and len(plain_places(t)[0]) == n))
        base = [p for p in places if p[3] == "base"]
        assert (x["n_base"], x["first_word"], x["last_word"]) == (len(base), min((p[0] for p in base), default=None), max((p[0] for p in base), default=None))
    empty = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(empty / "documents.parquet"))
    for q in (queries.op11_periodic_runs, queries.op12_spelling_variants, queries.op13_license_scans):
        assert q(spark, str(empty)).count() == 0
