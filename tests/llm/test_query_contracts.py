"""The registered queries op2, op3, op8, op9 and op10 on whole small tables, against plain versions of their contracts."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from gridmeld.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = "\t\n\x0b\x0c\r "
STORY = "The harbour was quiet when the first boats came back from the long night on the water, and the crews began to unload what they had caught."


def texts():
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdeéüK") for _ in range(r.randrange(2, 7))) for _ in range(200)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    common = [sentence(15), "short line", " " + sentence(14) + " "]
    out = [(i, "\n".join([sentence(r.randrange(2, 40)), *(f" {x.upper() if i % 2 else x}\t" for x in common[: i % 4])])) for i in range(40)]
    base = sentence(60).split()
    for i in range(40, 60):
        copy = list(base)
        for _ in range(i % 5):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        out.append((i, " ".join(copy)))
    return [*out, (60, None), (61, ""), (62, " \n\t"), (63, "one two"), (64, "ONE  two"), (65, "\n\n"), (66, sentence(4000)), (67, common[0]), (68, out[0][1])]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("contracts"))
    spark.createDataFrame([(i, t, "en", None, 0) for i, t in texts()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[300:304] = x[50]
    spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(600)] + [(650, None), (700, [0.0] * 8)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    page = lambda i: f"<html><head><title>t</title></head><body><nav><a href='/'>Home</a> <a href='/n'>News</a></nav><article><h1>Story &amp; {i}</h1><p>{STORY}\n {STORY}</p></article><footer>Copyright</footer></body></html>"
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate([None, "", "short", "short", "x" * 999, "x" * 999, "x" * 1000, "x" * 1000, "x" * 1000, "é" * 500, "é" * 500, page(1), page(1), page(2)])]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{d}/pages.parquet")
    return d


def test_op2(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    best = {}
    for i, p in pages.items():
        best[p] = max(best.get(p, i), i)
    want = []
    for i, p in pages.items():
        first = best[p] if len(p) >= 1000 else i
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    out = queries.QUERIES["op2_warc"](spark, sf)
    assert out.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and dict(out.dtypes)["payload_bytes"] == "bigint"
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(want)


def test_op3(spark, sf):
    out = queries.QUERIES["op3_html_extraction"](spark, sf)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["n_chars"] == "bigint"
    got = {r["page_id"]: r for r in out.collect()}
    assert sorted(got) == list(range(14)) and all(r["n_chars"] == len(r["text"]) and r["url"] == f"http://h/{i}" for i, r in got.items())
    assert got[0]["text"] == got[1]["text"] == ""
    assert [got[i]["text"] for i in (11, 12, 13)] == [f"Story & {k} {STORY} {STORY}" for k in (1, 1, 2)]


def test_op8(spark, sf):
    out = queries.QUERIES["op8_nearest_neighbours"](spark, sf)
    assert out.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 600").collect()}
    found, hits = defaultdict(list), 0
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 600, 50))
    cosine = lambda a, b: float(x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]))
    for q, mine in found.items():
        assert [k for k, *_ in mine] == [1, 2, 3, 4, 5] and all(s == pytest.approx(cosine(q, v), abs=1e-12) for _, v, s in mine)
        best = sorted((v for v in x if v != q), key=lambda v: (-round(cosine(q, v), 12), v))[:5]
        hits += len(set(best) & {v for _, v, _ in mine})
    assert hits >= 0.9 * 60 and [v for _, v, _ in found[50]][:4] == [300, 301, 302, 303]


def test_op9(spark, sf):
    sets = {}
    for i, t in texts():
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} - {()}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    out = queries.QUERIES["op9_near_duplicates"](spark, sf)
    assert out.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(i, len(sets[i]), find(i), find(i) == i) for i in sorted(sets)]
    assert len({find(i) for i in sets}) < len(sets) - 5


def test_op10(spark, sf):
    key = lambda line: line.strip(SPACES).translate(LOW)
    holders = defaultdict(set)
    for i, t in texts():
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    want = []
    for i, t in texts():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i)]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    out = queries.QUERIES["op10_line_dedup"](spark, sf)
    assert out.columns[:4] == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(tuple(r)[:4] for r in out.collect()) == want and sum(w[2] for w in want) > 20
