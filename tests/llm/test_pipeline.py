"""The pipeline stage by stage against plain versions, and the contracts of the queries."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridmeld.llm import langid, queries
from gridmeld.llm.common import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = "if a train leaves the old station at noon with forty crates of apples how long does it take to reach the harbour"


def rows():
    r = random.Random(11)
    kinds = {"en": ["the", "and", "ing", "tion", "was", "of"], "de": ["der", "und", "ung", "keit", "sch", "ü"]}
    word = lambda k: "".join(r.choice(kinds[k]) for _ in range(r.randrange(1, 4)))
    line = "this very same line of text stands in many of the documents here"
    out = []
    for i in range(160):
        k = "en" if i % 2 else "de"
        text = " ".join(word(k) for _ in range(60))
        if i % 8 == 1:
            text = f"{text}\n{line}\nend {i} {word(k)}"
        if i in (31, 33):
            text = f"{text} {ITEM} {word(k)}"
        out.append((i, text, k, "ab"[i % 3 == 0], len(text)))
    base = out[5][1].split()
    out += [(200, " ".join(base), "en", "a", 1), (201, " ".join([*base[:-1], "changed"]), "en", "b", 1), (202, None, "en", "a", 0), (203, "12 34", "en", None, 5), (204, "zzqx qxz " * 200, "en", "a", 1800), (None, "the tion was of the and ing " * 9, "en", "a", 1)]
    out += [(33, "the and was of a clean row with the id of another that was not of the " * 3, "en", "a", 1), out[7], out[7]]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "no such words in any document of this table at all today")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, sf):
    """With columns of the names that stages use themselves."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(("_own_", "_own_row", "__row", "copy", "lang_pred", "score", "n_lines", "kept", "rank", "size"))}).cache()


def keyed(rs):
    return sorted(((r["doc_id"], r["text"]) for r in rs), key=str)


def stage(spark, docs, sf, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert out.columns == docs.columns or name == "mix"
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), sf).count() == 0
    return out.collect()


def test_language_stage(spark, docs, sf):
    got = keyed(stage(spark, docs, sf, "language_id"))
    gone = [x for x in keyed(docs.collect()) if x not in got]
    assert {x[0] for x in gone} == {202, 203, 204}


def test_line_stage(spark, docs, sf):
    line = "this very same line of text stands in many of the documents here"
    holders = [d for d, t, *_ in rows() if line in (t or "")]
    want = [(d, (t or "") if d == max(holders) else "\n".join(x for x in (t or "").split("\n") if x != line)) for d, t, *_ in rows()]
    found = stage(spark, docs, sf, "line_dedup")
    assert keyed(found) == sorted(want, key=str) and all(r["n_chars"] == len(r["text"]) for r in found)


def test_near_duplicate_stage(spark, docs, sf):
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [WORD.findall((t or "").lower())] for k in range(max(1, len(w) - 4))} - {()}
    kept, want = [], []
    for d, t, *_ in sorted((x for x in rows() if x[0] is not None), key=lambda x: x[0]):
        s = shingles(t)
        if (d, t) not in want and not (s and any(100 * len(s & o) >= 80 * len(s | o) for o in kept)):
            want.append((d, t))
            kept.append(s)
    assert keyed(stage(spark, docs, sf, "near_dedup")) == sorted([*want, *((d, t) for d, t, *_ in rows() if d is None)], key=str)


def test_decontamination_stage(spark, docs, sf):
    """Of the rows that share an id only the one with the item goes."""
    assert keyed(stage(spark, docs, sf, "decontaminate")) == sorted(((d, t) for d, t, *_ in rows() if ITEM not in (t or "")), key=str)


def test_mixing_stage(spark, docs, sf):
    found = collections.Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, sf, "mix"))
    sizes = collections.Counter()
    for d, t, _, s, _ in rows():
        sizes[s] += len(WORD.findall(t or ""))
    taken = sum(n * len(WORD.findall(t or "")) for (_, t), n in found.items())
    assert abs(taken - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values()) and set(found) <= {(d, t) for d, t, *_ in rows()}


def test_whole_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copy"}
    ids = {r["doc_id"] for r in out.collect()}
    assert not ids & {31, 200, 201, 202, 203, 204} and len(ids) > 100


def test_contracts_of_the_queries(spark, sf):
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    for name, columns in (("op5_quality", ["doc_id", "held_out", "score", "predicted"]), ("op7_language_id", ["doc_id", "held_out", "lang_pred", "score"])):
        out = queries.QUERIES[name](spark, sf)
        got = out.collect()
        assert out.columns[: len(columns)] == columns and len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["held_out"] == held(r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (202, 203)} == {202: "und", 203: "und"}
    out = queries.op1_pii(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone", "spans")}, "base_sha256": "string", "spans": "string"} and out.count() == len(rows())
    out = queries.op6_mixing(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"} and all(r["taken"] <= 2 * r["size"] for r in out.collect())
    assert {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, sf).collect()} == {(31, 1), (33, 1)}


def test_a_long_literal_run_is_reported_whatever_its_share(spark):
    from gridmeld.llm.decontaminate import contaminated

    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = [" ".join(["so", *words[20:33], "it"]), " ".join(["so", *words[20:32], "it"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in contaminated(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()] == [0]


def test_cross_entropy_equals_plain_kneser_ney(spark):
    """Counts, continuation counts and back-off with dictionaries, over the same sample."""
    data = [(i, t, k) for i, t, k, *_ in rows() if i is not None and i < 60]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    order, d, model = 3, 0.75, langid.fit(df, order=3)
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}
    clean = lambda t: " " + re.sub(r"^ ", "", re.sub(r"[^a-zü]+", " ", t.lower()))
    tests = [clean(t) for _, t, _ in data[:6]] + [" zq the und"]
    for l, lang in enumerate(model.languages):
        mine = sorted((hashes[i, t] % (1 << 20), hashes[i, t], t) for i, t, k in data if k == lang)
        texts = [clean(t) for n, (_, _, t) in enumerate(mine, 1) if n % 4]
        count = {n: collections.Counter(t[i - n + 1 : i + 1] for t in texts for i in range(max(1, n - 1), len(t))) for n in range(1, order + 1)}
        use = {order: count[order]}
        for n in range(order - 1, 0, -1):
            kinds = collections.Counter(g[1:] for g in count[n + 1])
            use[n] = {g: max(1, kinds[g]) for g in count[n]}
        mass, kinds = collections.Counter(), collections.Counter()
        for n in range(2, order + 1):
            for g, c in use[n].items():
                mass[g[:-1]] += c
                kinds[g[:-1]] += 1
        total = sum(use[1].values())
        base = d * len(use[1]) / total / (len(use[1]) + 1)

        def p(g):
            if len(g) == 1:
                return max(use[1].get(g, 0) - d, 0) / total + base
            if not mass[g[:-1]]:
                return p(g[1:])
            return max(use[len(g)].get(g, 0) - d, 0) / mass[g[:-1]] + d * kinds[g[:-1]] / mass[g[:-1]] * p(g[1:])

        for t in tests:
            want = -sum(math.log(p(t[max(0, i - order + 1) : i + 1])) for i in range(1, len(t))) / (len(t) - 1)
            import numpy as np

            raw = np.frombuffer(t.encode(), np.uint8)
            assert model.cross_entropy(raw, np.array([0, len(raw)]))[0][0, l] == pytest.approx(want, rel=1e-3), (lang, t[:20])


def test_held_out_is_the_fold_of_the_contract(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}
