"""Each operator against a plain version on texts with every awkward case."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmeld.llm import langid, mixing, pii, quality
from gridmeld.llm.decontaminate import contaminated
from gridmeld.llm.lines import line_dedup
from gridmeld.llm.mixing import mix, mix_plan
from gridmeld.llm.neardup import near_duplicates

SCHEMA = "doc_id long, text string, source string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéüß") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [sentence(12).capitalize() for _ in range(3)]
    rows = []
    for i in range(40):
        text = "\n".join([sentence(r.randrange(3, 40)), *r.sample(shared, r.randrange(0, 3)), "  " + shared[0].upper() + "\t"] if i % 3 else [sentence(50)])
        rows.append((i, text, "ab"[i % 2], 1))
    base = sentence(80)
    for i in range(40, 60):
        words = base.split()
        for k in range(i % 5):
            words[(i * 7 + k * 13) % 80] = "edit"
        rows.append((i, " ".join(words), "c", 1))
    rows += [(60, None, "a", 1), (61, "", None, 1), (62, " \t\n", "zero", 1), (63, "one two", "a", 1), (64, "ONE\ttwo", "b", 1), (65, sentence(30_000), "b", 1), (None, base, "c", 1), (66, rows[5][1], None, 1), (66, rows[5][1], None, 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def clash(df):
    """Extra columns with the names that operators use."""
    return df.withColumns({c: F.lit("x") for c in ("pos", "key", "size", "label", "copy", "score", "pii", "n_lines", "lang_pred", "predicted", "rep", "h")})


@pytest.mark.parametrize("hot_keys", [1, 1000])
def test_line_dedup(spark, docs, monkeypatch, hot_keys):
    monkeypatch.setattr("gridmeld.llm.lines.HOT_KEYS", hot_keys)
    rows, holders = corpus(), {}
    keys = lambda t: [x.strip("\t\n\x0b\x0c\r ").translate(LOW) for x in (t or "").split("\n")]
    for d, t, *_ in rows:
        for k in keys(t):
            if len(k) >= 40 and d is not None:
                holders.setdefault(k, set()).add(d)
    want = []
    for d, t, *_ in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if not (len(holders.get(k, ())) >= 5 and d != max(holders[k]))]
        want.append((d, len(keys(t)), len(keys(t)) - len(kept), "\n".join(kept)))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup(clash(docs)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(got, key=key) == sorted(want, key=key) and sum(w[2] for w in want) > 10
    assert line_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, docs, words):
    sets = []
    for d, t, *_ in corpus():
        w = WORD.findall((t or "").translate(LOW))
        sets.append((d, {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    least = {i: i for i in range(len(sets))}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                least[p] = q
    groups = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(d)
    want = sorted(((d, len(x), min(groups[find(i)]) if d is not None else None) for i, (d, x) in enumerate(sets)), key=str)
    found = near_duplicates(clash(docs), words=words).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == want
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in found)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_of_one_text_in_large_numbers(spark):
    """Every pair of a large group differs; all must meet in one component, and strangers stay apart."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in r.sample(range(200), 2):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{i}_{k}" if k > 120 else base[k] for k in range(200))) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 1000} == {0}
    assert all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] >= 1000)


def test_mixing(spark, docs):
    rows = corpus()
    plan = mix_plan(clash(docs)).collect()
    assert sorted(p["size"] for p in plan) == sorted(len(WORD.findall(t or "")) for _, t, *_ in rows)
    total, sizes = sum(p["size"] for p in plan), {p["source"]: p["source_size"] for p in plan}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # the excess is shared again until none is above
        rest = 1.5 * total - sum(target.values())
        over = {s for s in open_ if rest * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    for s in order:
        mine = [p for p in plan if p["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s])
        assert abs(sum(p["copies"] * p["size"] for p in mine) - target[s]) <= 2 * max(p["size"] for p in mine)
    assert max(p["copies"] for p in plan) <= 2
    mixed = mix(clash(docs))
    assert mixed.count() == sum(p["copies"] for p in plan) == mix(clash(docs)).count()
    assert mix_plan(docs.limit(0)).count() == mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("portion", [10_000, 7])
def test_mixing_of_repeated_rows(spark, monkeypatch, portion):
    """Rows that agree in id, source and text share their copies evenly, whether they agree in other columns or not."""
    monkeypatch.setattr(mixing, "PORTION", portion)
    rows = [(i, f"{'word ' * (i % 7 + 1)}{i}", "ab"[i % 2], "x") for i in range(120)]
    rows += [(None, "same words again", "c", "x")] * 90 + [(7, "other words", "a", v) for v in "xxyyz"] * 6 + [(8, None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string").withColumn("Lang", F.col("copy"))
    plan, got = mix_plan(docs).collect(), mix(docs).collect()
    assert mix(docs).columns == ["doc_id", "text", "source", "Lang", "copy"]
    key = lambda r: (r["id"], r["size"], r["source"])
    size = lambda r: (r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"])
    want = Counter()
    for r in plan:
        want[key(r)] += r["copies"]
    assert +want == Counter(map(size, got))
    held, taken = Counter((d, t, s, v) for d, t, s, v in rows), Counter((r["doc_id"], r["text"], r["source"], r["Lang"]) for r in got)
    shared, all_taken = Counter(), Counter()
    for (d, t, s, v), n in held.items():
        shared[d, t, s] += n
        all_taken[d, t, s] += taken[d, t, s, v]
    for (d, t, s, v), n in held.items():
        low, more = divmod(all_taken[d, t, s], shared[d, t, s])
        assert low * n <= taken[d, t, s, v] <= low * n + min(n, more)
        steps = Counter(r["copy"] for r in got if (r["doc_id"], r["text"], r["source"], r["Lang"]) == (d, t, s, v))
        assert all(steps[c] == n for c in range(1, low + 1)) and sum(steps.values()) - low * n == steps[low + 1]


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii_base_spans_stay(spark):
    r = random.Random(8)
    bits = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1", "010.0.00.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (706) 555-3138", "+49 30 1234", "😀", "é", "12", "+", "@", "tel ", "card: ", "\x01", "\n", "(706) 555-3138", "me [at] here [dot] org"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", "x", ", "]) for _ in range(r.randrange(1, 30))) for _ in range(150)] + [None, "", "a@b.co " * 3000, "5" * 5000, "a" * 50_000]
    df = clash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = pii.fit(df)
    found = {x["doc_id"]: x["pii"] for x in pii.find_pii(df, model).collect()}
    for i, t in enumerate(texts):
        assert [(p["start"], p["rank"], p["end"], p["kind"]) for p in found[i] if p["base"]] == base_spans(t or ""), t
        kept = [(p["start"], p["end"]) for p in found[i] if p["base"]]
        assert all(not any(a < p["end"] and p["start"] < b for a, b in kept) for p in found[i] if not p["base"])
    clean = pii.redact(df.drop("pii").withColumn("_own_text", F.lit(1)).where("doc_id < 150"), model).select("text").collect()
    assert not any(re.search(r"[a-z]@[a-z]+\.[a-z]", x["text"]) for x in clean)
    assert pii.find_pii(df.limit(0)).count() == 0


def test_decontamination(spark):
    item = "If Maria buys 12 apples for 30 dollars and sells 12 pears, how many apples does Maria keep at the end of the day?"
    plain = "the quick brown fox jumps over the lazy dog while seven wizards boil their oxen in the deep green valley"
    rows = [
        (1, f"Before. {item} After."), (2, item.upper()), (3, item.replace("Maria", "Peter").replace("12", "7").replace("30", "1,000")),
        (4, item.replace("Maria buys", "Peter buys").replace("sells 12", "sells 8").replace("does Maria", "does Anna")), (5, "nothing of the kind"), (6, None), (7, ""),
        (8, "x " * 20_000 + re.sub(r" ", "\n ", plain).replace("fox", "Fox,")), (9, " ".join(plain.split()[:8])), (None, plain), (10, "1 2 3 4 5 6 7 8 9 10 11 12"),
    ]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    items = clash(spark.createDataFrame([(10, item), (11, plain), (12, None), (13, ""), (14, "1 2 3 4 5 6")], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in contaminated(docs, items).collect()}
    assert got.pop((None, 11)) == "verbatim"
    assert got == {(1, 10): "verbatim", (2, 10): "verbatim", (3, 10): "reparameterised", (8, 11): "verbatim"}
    assert contaminated(docs.limit(0), items).count() == contaminated(docs, items.limit(0)).count() == 0


def test_pii_candidates_inside_longer_numbers(spark):
    cards = ["7536784127813050", "4845168114407329"]
    spots = [(" ".join(cards), [(0, 16), (17, 33)]), ("2024 4111 1111 1111 1111", [(5, 24)]), ("4111-1111-1111-1111 4111-1111-1111-1111 7", [(0, 19), (20, 39)]), ("ids 12 706-555-3138 10.1.2.3 4", [(7, 19), (20, 28)])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(spots)], "doc_id long, text string")
    for r in df.select("doc_id", pii.numbers(F.col("text")).alias("c")).collect():
        text = spots[r["doc_id"]][0]
        assert set(spots[r["doc_id"]][1]) <= {(c["s"], c["e"]) for c in r["c"]}
        assert all(c["m"] == text[c["s"] : c["e"]] and text[: c["s"]].endswith(c["b"]) and text[c["e"] :].startswith(c["a"]) for c in r["c"])


@pytest.fixture(scope="module")
def pii_model(spark):
    """Trained where base spans stand among words and numbers of other sorts."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    valid = lambda n: next(d for d in (digits(n) for _ in range(1000)) if luhn(d))
    kinds = [lambda: f"{word()}{r.choice(['', '.', '7'])}{word()}@{word()}.com", lambda: ".".join(str(r.randrange(10, 256)) for _ in range(4)), lambda: valid(16), lambda: f"+1 ({digits(3)}) 555-{digits(4)}"]
    rows = [(i, f"{word()} {word()} {r.choice(['', 'order ', 'call '])}{kinds[i % 5]() if i % 5 < 4 else digits(r.randrange(8, 13))} {word()}") for i in range(900)]
    return pii.fit(spark.createDataFrame(rows, "doc_id long, text string")), word, digits, valid


def test_pii_finds_disguised_spans_and_no_order_numbers(spark, pii_model):
    model, word, digits, valid = pii_model
    r = random.Random(7)
    forms = {
        "phone": lambda: f"({digits(3)}) 555-{digits(4)}", "card": lambda: ".".join(re.findall("....", valid(16))), "ip": lambda: "[.]".join(str(r.randrange(10, 256)) for _ in range(4)), "email": lambda: f"{word()} [at] {word()} [dot] com",
        None: lambda: r.choice([digits(9), digits(11), f"2024-0{digits(1)}-1{digits(1)} 1{digits(1)} {digits(2)}", f"{word()} at www.{word()}.com"]),
    }
    rows, want = [], {}
    for i in range(400):
        kind = list(forms)[i % 5]
        form = forms[kind]()
        rows.append((i, f"{word()} {word()} {form} {word()}"))
        want[i] = (kind, rows[-1][1].index(form), rows[-1][1].index(form) + len(form))
    found = {x["doc_id"]: x["pii"] for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert not any(p["base"] for ps in found.values() for p in ps)
    for kind in ("phone", "card", "ip", "email"):
        mine = [i for i, w in want.items() if w[0] == kind]
        assert sum(any((p["kind"], p["start"], p["end"]) == want[i] for p in found[i]) for i in mine) >= 0.8 * len(mine), kind
        assert model.held[kind][0] >= 0.95 and model.held[kind][1] >= 0.6 and model.held[kind][2] > 50
    assert sum(bool(found[i]) for i, w in want.items() if w[0] is None) <= 4
    assert all(a["end"] <= b["start"] for ps in found.values() for a, b in zip(ps, ps[1:]))


def test_pii_time_grows_with_the_text(spark, pii_model):
    import time

    def took(n):
        text = "".join(f"a.b{i}@c-d.com 706-555-{i % 10000:04d} x " for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        found = pii.find_pii(df, pii_model[0]).first()["pii"]
        assert sum(p["base"] for p in found) == n and sum(p["kind"] == "phone" for p in found) == n
        return time.time() - start

    took(10)
    assert took(8000) < 4 * took(4000)


def leaks(spark, texts, item):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["kind"] for r in contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}


def test_decontamination_of_copies_with_an_edited_value(spark):
    item = "If Maria buys 12 apples for 30 dollars and sells 12 pears, how many apples does Maria keep at the end of the day?"
    mixed = item.replace("buys 12", "buys 5").replace("sells 12", "sells 8").replace("If Maria", "If Anna").replace("does Maria", "does Peter")
    assert leaks(spark, [item.replace("sells 12", "sells 8"), item.replace("does Maria", "does Anna"), mixed], item) == {0: "verbatim", 1: "verbatim"}


def test_decontamination_of_numeric_and_short_items(spark):
    item = "What is 12 + 7 * 3 - 5?"
    assert leaks(spark, [item, f"So: {item} Answer: 28.", "What is 13 + 7 * 4 - 5?", "12 7 3 5"], item) == {0: "verbatim", 1: "verbatim"}
    assert leaks(spark, ["First: who wrote Hamlet? Then more.", "who wrote", "Hamlet wrote who", None], "Who wrote Hamlet?") == {0: "verbatim"}
    assert leaks(spark, ["so 12 + 7 is", "what 12 + 8"], "12 + 7 is") == {0: "verbatim"}
    assert leaks(spark, ["1, 2, 3, 4 km", "1 2 3 4 km 5", "0 1 2 3 4 km"], "1 2 3 4 km") == {0: "verbatim"}


def test_decontamination_of_other_names_and_joined_units(spark):
    item = "Tom has 5 apples. Tom eats 2. Tom buys 3. How many are left?"
    texts = [item.replace("Tom", "Sue"), item.replace("Tom", "Sue").replace("5", "9").replace("buys 3", "buys 4"), item.replace("Tom", "Ольга"), "Tom has 5 pears. Sue sold 2. Ann lost 3. How few were eaten?"]
    assert leaks(spark, texts, item) == {0: "reparameterised", 1: "reparameterised", 2: "reparameterised"}
    item = "the train runs 30km in the first hour and then it slows to 2.5km for each hour"
    assert leaks(spark, [item.replace("30km", "45km").replace("2.5km", "3km"), item.replace("km", " km"), item.replace("km", "abc")], item) == {0: "reparameterised", 1: "verbatim"}
    item = "in the end did Łukasz give each ball to Иван or did Łukasz keep them"
    assert leaks(spark, [item.replace("Łukasz", "Żaneta").replace("Иван", "Ольга"), item.upper() + " İ"], item) == {0: "reparameterised", 1: "verbatim"}


def test_decontamination_equals_brute_force_on_literal_words(spark):
    r = random.Random(2)
    w = lambda n: [f"v{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(n)]
    items = [(i, w(r.randrange(8, 30))) for i in range(20)]
    docs = []
    for d in range(120):
        words = w(40)
        if d % 2:
            words[r.randrange(40) :] = r.choice(items)[1][: r.randrange(4, 30)] + w(5)
        docs.append((d, words))
    want = set()
    for d, x in docs:
        have = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
        for i, y in items:
            mine = [tuple(y[k : k + 5]) for k in range(len(y) - 4)]
            run = {tuple(x[k : k + 13]) for k in range(len(x) - 12)} & {tuple(y[k : k + 13]) for k in range(len(y) - 12)}
            if sum(g in have for g in mine) >= 0.5 * len(mine) or run:
                want.add((d, i))
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(x)) for i, x in rows], f"{name} long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()} == want


def labelled_texts(n):
    r = random.Random(3)
    kinds = {"en": ["the", "and", "ing", "tion", "was", "of"], "de": ["der", "und", "ung", "keit", "sch", "ü"], "fr": ["le", "que", "ment", "eau", "é", "les"]}
    rows = []
    for i in range(n):
        lang = sorted(kinds)[i % 3]
        rows.append((i, " ".join("".join(r.choice(kinds[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 60))), lang))
    return rows


def test_language_id(spark):
    rows = labelled_texts(240)
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 !! 34", "fr"), (1003, "zzqx " * 300, None), (1004, "der und keit " * 20_000, "de"), (1004, "der und keit " * 20_000, "de")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 != 2"))
    got = [r.asDict() for r in langid.identify(clash(df), model).collect()]
    held = [r for r in got if r["doc_id"] < 1000 and r["doc_id"] % 4 == 2]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held) and not any(r["lang_rejected"] for r in held)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["lang_rejected"] and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003]["lang_rejected"] and by[1004]["lang_pred"] == "de" and len(got) == 246
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.fit(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df.limit(3), none).collect()} == {"und"}


def test_limits_of_rejection_are_calibrated():
    """Foreign texts set the limit where they lie apart; where they don't, the share of own texts that may go does."""
    rng = np.random.default_rng(4)
    own = rng.exponential(0.1, 400)
    apart, mixed = rng.normal(2.0, 0.2, 300), rng.normal(0.1, 0.1, 300)
    fresh = rng.exponential(0.1, 200_000)
    limit = langid.reject_limit(own, apart, 1e-3)
    assert limit == pytest.approx(np.quantile(apart, 0.05)) and (apart < limit).mean() == pytest.approx(0.05, abs=0.01)
    assert 1e-4 < (fresh > langid.reject_limit(own, mixed, 1e-3)).mean() < 5e-3
    assert langid.reject_limit(own, mixed, 1e-4) > langid.reject_limit(own, mixed, 1e-2)
    assert langid.reject_limit(own[:4], apart, 1e-3) == np.inf


def test_kneser_ney_sums_to_one(spark):
    """The probabilities after a known context, add up to 1 but for what unseen characters get."""
    import numpy as np

    df = spark.createDataFrame([(i, t, "x") for i, t, _ in labelled_texts(20)], "doc_id long, text string, lang string")
    model = langid.fit(df, order=3)
    text = "the"
    codes = sorted({ord(c) for _, t, _ in labelled_texts(20) for c in t})
    total = 0.0
    for c in codes:
        data = np.frombuffer((text + chr(c)).encode(), np.uint8)
        h, _ = model.cross_entropy(data, np.array([0, len(data)]))
        g, _ = model.cross_entropy(np.frombuffer(text.encode(), np.uint8), np.array([0, 3]))
        total += float(np.exp(-(h[0, 0] * 4 - g[0, 0] * 3)))
    assert total == pytest.approx(1, abs=0.02)


def test_quality(spark):
    r = random.Random(9)
    good = [(i, " ".join(r.choice(["calm", "river", "stone", "light", "field", "and", "the"]) for _ in range(r.randrange(5, 80))).capitalize() + ".", 1) for i in range(150)]
    bad = [(500 + i, " ".join(r.choice(["BUY", "NOW", "FREE", "WIN"]) + "!!" for _ in range(r.randrange(5, 80))), 0) for i in range(80)]
    rows = good + bad + [(900, None, 1), (901, "", 0), (902, "calm river " * 30_000, 1)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4 != 2] + [(77777, 1)], "doc_id long, quality int")
    model = quality.fit(df.where("doc_id % 4 != 2"), labels)
    got = {x["doc_id"]: x for x in quality.score_quality(clash(df), model).collect()}
    held = [(i, y) for i, _, y in rows if i % 4 == 2 and i < 900]
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got.values())
    assert quality.score_quality(df.limit(0), model).count() == 0
    assert quality.fit(df, labels.limit(0)) is None and quality.score_quality(df.limit(2), None).first()["score"] == 0.5


def test_hashes_are_those_of_the_contract(spark, docs):
    got = line_dedup(docs.where("doc_id = 60")).select(F.sha2("text", 256).alias("s"), "n_lines").first()
    assert (got["s"], got["n_lines"]) == (hashlib.sha256(b"").hexdigest(), 1)
