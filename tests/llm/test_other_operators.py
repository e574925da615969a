"""Archives, pages, vectors and the parts that they share."""

import hashlib
import io
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmeld.llm import boosting, components, extract, neighbours, textbytes, warc
from gridmeld.llm.components import connected_components
from gridmeld.llm.neighbours import blocks_of, centroids_for, nearest, visits, walk


@pytest.mark.parametrize("hot", [1000, 1])
def test_warc_round_trip(spark, tmp_path, monkeypatch, hot):
    """With all revisits from the list of frequent payloads, and with all but one's by a join."""
    monkeypatch.setattr(warc, "HOT", hot)
    r = random.Random(1)
    big = "<p>" + "long " * 400
    rows = [(i, f"http://h/{i}", r.choice([f"<p>{i}", big, "é" * 600, f"{big}{i}"])) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x/\r\nWARC-Type: warcinfo", "\x1f\x8b\x08 WARC/1.0\r\n\r\n" * 9), (103, "u", "z" * 3_000_000), (104, "u", "z" * 3_000_000), (None, "u", "n" * 2000), (105, "u", "n" * 2000)]
    pages = spark.createDataFrame([(*x, "extra") for x in rows], "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.archive_pages(pages, str(tmp_path / "w")).cache()
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    want = {}
    for page, _, html in rows:
        b = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None] if len(b) >= 1000 else [page]
        first = max(same) if len(b) >= 1000 and len([1 for _, _, h in rows if h == html]) > 1 else page
        want[page] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if page != first else "response", first if page != first else None)
    for split in (1 << 24, 700):
        found = warc.read_warc(manifest, split_bytes=split).collect()
        assert len(found) == len(rows)
        assert {x["page_id"]: (x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in found} == want
    assert {x["page_id"]: bytes(x["payload"]).decode() for x in found if x["record_type"] == "response"} == {p: h or "" for p, _, h in rows if want[p][2] == "response"}
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 30).alias("html")).repartition(1)
    manifest = warc.archive_pages(pages, str(tmp_path / "w")).cache()
    found = warc.read_warc(manifest, split_bytes=1000).withColumn("task", F.spark_partition_id())
    assert found.count() == 40 and found.select("task").distinct().count() > 4


def test_warc_reader_skips_what_is_no_record():
    good = warc._member(warc._record("response", "1", "http://x", "d", b"body", 4, None))
    other = warc._member(b"not a record")
    data = b"junk\x1f\x8b\x08junk" + good + other + good[:30] + good
    whole = list(warc.records_in(io.BytesIO(data), 0, len(data)))
    assert len(whole) == 2
    for cut in range(0, len(data), 17):
        assert len(list(warc.records_in(io.BytesIO(data), 0, cut))) + len(list(warc.records_in(io.BytesIO(data), cut, len(data)))) == 2


def test_a_large_record_is_read_in_linear_time():
    """No bytes of the record are copied again for each piece that follows."""
    payload = random.Random(2).randbytes(48_000_000)
    data = warc._member(warc._record("response", "1", "u", "d", payload, len(payload), None))
    window = warc._Window(io.BytesIO(data), 0, step=1 << 14)  # thousands of pieces
    start = time.time()
    record, end = warc._decode(window, 0)
    assert end == len(data) and payload in record and time.time() - start < 20


@pytest.fixture(scope="module")
def trees():
    return extract.train()


def test_extraction_of_unseen_templates(trees):
    rng, right = np.random.default_rng(123), 0
    for _ in range(80):
        page, marks = extract.template_page(rng)
        right += set(re.findall(r"q\d+z", extract.main_text([page], trees)[0])) == marks
    assert right >= 72


def test_extraction_without_telling_names(trees):
    """On unseen pages whose names are in no list, nine in ten are exactly right."""
    rng, right, n = np.random.default_rng(77), 0, 0
    while n < 80:
        page, marks = extract.template_page(rng)
        words = {w for tokens in re.findall(r"""(?:class|id)=["']?([^"'>]*)""", page) for w in extract.TOKEN.findall(tokens)}
        if words & (extract.GOOD | extract.BAD) or "class" not in page:
            continue
        n += 1
        right += set(re.findall(r"q\d+z", extract.main_text([page], trees)[0])) == marks
    assert right >= 72


@pytest.mark.parametrize("names", [("ad", "cookie", "comments"), ("werbung", "hinweis", "kommentare"), ("css1ab", "css2cd", "css3ef")])
def test_one_page_under_three_sets_of_names(trees, names):
    line = "The river rose again in the spring and the town behind the old wall had to wait for the water to fall, as it did each year. "
    paragraphs = [(line * k).strip() for k in (1, 2, 3, 1)]
    readers = [("Anna 3.4.2021", "I liked this one very much, thanks for writing."), ("Ben 4.4.2021", "Not sure that this is right, the wall is quite new."), ("Carl 5.4.2021", "Me too.")]
    page = f"""<html><body><div class=b2><h1>A long river in the spring</h1>{"".join(f"<p>{p}</p>" for p in paragraphs)}</div><div class={names[0]}>Buy two pairs of shoes and get one for free, only this week.</div>
        <div class={names[1]}><p>We use small files to make this site better for you.</p><button>Fine</button></div><div class={names[2]}>{"".join(f"<div><p>{a}</p><p>{b}</p></div>" for a, b in readers)}</div></body></html>"""
    assert extract.main_text([page], trees) == [" ".join(["A long river in the spring", *paragraphs])]


def test_extraction_rules(spark, trees):
    text = "A first paragraph of the story, with words enough to count as one. " * 3
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a="</p><p>bad";</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/>Menu</a></li></ul></nav>
        <!-- <p>gone</p> --><div class="ad">Buy this.</div><article><h1>Fish &amp; chips</h1><p>{text}<b>bo</b>ld&nbsp;end<br>line<p>{text}</article><div class="comments"><p>I like it, said someone.</p></div><footer>&copy; all</footer></body></html>"""
    rows = [(1, page), (2, None), (3, ""), (4, "plain text without any markup, " * 5), (5, "<div" * 50), (6, "<p>" + "w " * 200_000), (6, "<p>" + "w " * 200_000), (7, '<p a="unclosed>' + "x" * 5000)]
    df = spark.createDataFrame([(i, "u", h, "t", "n") for i, h in rows], "page_id long, url string, html string, text string, n_chars string")
    got = extract.extract(df, trees)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = {r["page_id"]: r for r in got.collect()}
    clean = re.sub(r"\s+", " ", text).strip()
    assert by[1]["text"] == f"Fish & chips {clean} bold end line {clean}"
    assert by[2]["text"] == by[3]["text"] == "" and got.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in by.values())
    assert extract.extract(df.limit(0), trees).count() == 0


@pytest.mark.parametrize("page", ["<div" * 20_000, '<p a="' * 20_001 + ">", "<p a='>x" * 20_001, "<div>" * 20_000 + "<li>x" * 5_000 + "</p>" * 20_000, "<svg>" * 20_000, "<div " + "a" * 300_000 + "=>", "<svg></svg" * 20_000])
def test_broken_markup_takes_time_in_proportion(trees, page):
    start = time.time()
    extract.main_text([page], trees)
    assert time.time() - start < 2


def test_decoding_equals_all_choices(trees):
    """The decoder's value is the best of all choices in which no kept part lies in a dropped whole."""
    rng = np.random.default_rng(2)
    nodes = extract.nodes_of(extract.parse("<div>aa aaa<p>one two three</p><ul><li>x y</li><li>zzz zz</li></ul></div><p>four</p>"))
    at = {id(x): i for i, x in enumerate(nodes)}
    weight = np.log1p([x.own for x in nodes])

    def best(i, score):
        """Value and kept nodes of the best choice for a subtree."""
        below = [best(at[id(c)], score) for c in nodes[i].children]
        inside = [i, *(j for b in below for j in b[2])]
        whole = sum(score[j] for j in inside)
        apart = abs(score[i]) + sum(b[0] for b in below) - 0.5
        if abs(whole) >= apart:
            return abs(whole), set(inside) if whole > 0 else set(), inside
        return apart, {i for _ in [0] if score[i] > 0}.union(*(b[1] for b in below)), inside

    for _ in range(200):
        logits = rng.normal(0, 2, len(nodes))
        got = extract.decode(nodes, logits)
        assert set(np.flatnonzero(got)) == best(0, np.clip(logits, -6, 6) * weight)[1]


def test_decoding_never_keeps_a_part_of_a_dropped_whole(trees):
    nodes = extract.nodes_of(extract.parse("<div><p>one two three</p><p>four</p></div>"))
    assert list(extract.decode(nodes, np.array([-5.0, -5.0, 0.2, -4.0]))) == [False] * 4
    assert list(extract.decode(nodes, np.array([-5.0, -5.0, 5.0, -4.0]))) == [False, False, True, False]


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) * np.repeat([1, 3], [1500, 1500])[:, None]
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in x[i].astype(np.float32)]) for i in range(3000)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None] * 8), (5200, [1.0] * 3), (None, rows[0][1]), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int")
    got = nearest(df, df.where("vec_id % 50 == 0"), k=5).collect()
    y = np.array([v for _, v in rows], dtype=np.float64)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(3000), -s))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in [r["vec_id"] for r in mine]
        assert all(r["score"] == pytest.approx(float(unit[q] @ unit[r["vec_id"]])) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(best.tolist()))
        if 100 <= q < 400:
            assert [r["vec_id"] for r in mine] == [i for i in range(100, 106) if i != q][:5]
    assert hits >= 0.9 * 300 and len(got) == 300
    few = df.where("vec_id < 3")
    assert nearest(few, few.where("vec_id = 0")).count() == 2
    assert nearest(df.limit(0), df.limit(0)).count() == nearest(df, df.limit(0)).count() == 0


def test_neighbours_of_clustered_and_double_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(4000)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.where("vec_id % 50 == 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = sum(len(got[q] & set(np.argsort(-np.where(np.arange(4000) == q, -9, unit @ unit[q]))[:5].tolist())) for q in range(0, 4000, 50))
    assert hits >= 0.95 * 400


def test_centroids_follow_the_entries():
    assert [centroids_for(n) for n in (0, 6400, 640_000, 10**9)] == [4, 10, 100, 512]


def test_a_query_meets_only_blocks_with_its_cells():
    """However many blocks a row has; a full cell lies in blocks of its own."""
    rng = np.random.default_rng(3)
    for scale in (1, 10, 100):
        sizes = rng.integers(0, 9, 64) * scale
        sizes[5], sizes[40] = 1000 * scale, 0
        first, parts = blocks_of(sizes, 16, block=100 * scale)
        held = {}
        for c, n in enumerate(sizes):
            for p in range(parts[c]):
                held.setdefault((c // 16, first[c] + p), []).append(-(-n // parts[c]))
        assert all(sum(ns) <= 100 * scale for ns in held.values()) and parts[5] == 10 and parts.sum() == 73
        asked = [0, 1, 17, 40, 63]
        met = visits(asked, 16, first, parts)
        assert len(met) <= len(asked) and sorted(r * 16 + c for (r, _), cs in met.items() for c in cs) == asked
        assert len(visits([5], 16, first, parts)) == 10


@pytest.mark.parametrize("block", [8192, 40])
def test_neighbours_do_not_depend_on_the_blocks(spark, monkeypatch, block):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(900)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours.blocks_of, "__defaults__", (block,))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest(df, df.where("vec_id % 50 == 0"), recall=1.0, centroids=3).collect()}
    want = {(q, k + 1): int(v) for q in range(0, 900, 50) for k, v in enumerate(np.argsort(-np.where(np.arange(900) == q, -9, unit @ unit[q]))[:5])}
    assert got == want


def test_cells_are_walked_in_order():
    a, b = np.array([3.0, 1.0, 2.0]), np.array([0.5, 4.0])
    cells = list(walk(a, b))
    sums = [a[c // 2] + b[c % 2] for c in cells]
    assert sorted(cells) == list(range(6)) and sums == sorted(sums)


@pytest.mark.parametrize("hub", [components.HUB_EDGES, 20, 1])
def test_components(spark, monkeypatch, hub):
    """With no hubs, with a few, and with every node dealt to parts."""
    monkeypatch.setattr(components, "HUB_EDGES", hub)
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 400)] + [(r.randrange(500, 540), r.randrange(500, 540)) for _ in range(25)]
    least = {}
    find = lambda i: i if least.setdefault(i, i) == i else find(least[i])
    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        least[q] = p
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_and_gram_hashes_follow_the_texts():
    texts = ["a b", "", None, " A\tb  c d\n", "ab", "b", "é é", "x" * 3_000_00]
    seen = {}
    for a, b, data, offsets in textbytes.chunks(pa.array(texts), 64):
        hashes, rows = textbytes.word_hashes(data, offsets, textbytes.Powers())
        words = [(i, w) for i in range(a, b) for w in re.findall(r"[^\x20\x09-\x0D]+", (texts[i] or "").lower())]
        assert [a + r for r in rows] == [i for i, _ in words]
        for (_, w), h in zip(words, hashes.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    h, r = textbytes.grams(np.arange(1, 8, dtype=np.uint64), np.array([0, 0, 1, 1, 1, 1, 3]), 3)
    assert r.tolist() == [0, 1, 1, 3] and len(set(h.tolist())) == 4


def test_trees_in_sql_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    model = boosting.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=8, depth=3)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    got = [r[0] for r in df.select(model.column([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert np.allclose(got, model.logits(x))
    assert ((model.logits(x) > 0) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9
    assert boosting.threshold(np.array([3.0, 2.0, 1.0]), np.array([1.0, 1.0, 0.0])) == 2.0
