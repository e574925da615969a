"""Benchmark items of numbers and of one word; letters beyond the first planes."""

import numpy as np

import corpus_pipeline
from gridmeld.llm import langid
from gridmeld.llm.decontaminate import contaminated

ITEMS = [(1, "12 + 7 * 3 - 5 = 28"), (2, "Paris"), (3, "1 2 3 4 5 6 7 8"), (4, "42"), (5, "12, 99"), (6, "3.5 4.1 9.7 2.2 8.8 6.1")]
DOCS = [
    (1, "The teacher wrote 12 + 7 * 3 - 5 = 28 on the board and went on."),
    (2, "They moved to Paris in the spring."),
    (3, "Count with me: 1 2 3 4 5 6 7 8 and then stop."),
    (4, "12 + 7 * 3 - 5 = 28"),
    (5, "The answer is 42, or 12, 99 at times."),
    (6, "42"),
    (7, "1 2 3 4 5 6 7 8"),
    (8, "12 + 8 * 3 - 5 = 31, which is another sum."),
    (9, "Readings: 3.5 4.1 9.7 2.2 8.8 7.0 and so on."),
    (10, None),
]


def test_numbers_in_a_text_and_items_of_one_word(spark):
    """Sums are found inside a text, enumerations and short numbers only as a whole text; one word is told apart."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in contaminated(docs, items).collect()}
    assert got == {(1, 1): "verbatim", (2, 2): "word", (4, 1): "verbatim", (6, 4): "verbatim", (7, 3): "verbatim", (9, 6): "verbatim"}


def test_the_pipeline_keeps_documents_with_an_item_of_one_word(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    name = next(n for n in stage if "decontam" in n)
    kept = sorted(r["doc_id"] for r in stage[name](spark, docs, str(tmp_path)).collect())
    assert kept == [2, 3, 5, 8, 10]


def test_letters_of_all_planes_are_letters():
    text = "ab \U00030000\U00030001 \U000e0041 \U0010ffff".encode()
    chars, rows = langid.letters(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [c for c in chars.tolist() if c != 32] == [ord("a"), ord("b"), 0x30000, 0x30001]
