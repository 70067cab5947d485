"""Documents that are a benchmark item without some of its words."""

import pytest

from matloom.llm import decontaminate

ITEM = [f"item{i}" for i in range(60)]
CUTS = {1: ITEM[:-1], 2: ITEM[1:], 3: ITEM[1:-1], 4: ITEM[:52], 5: ITEM[:49], 6: ITEM[:48], 7: ITEM[:20], 8: ITEM, 9: ITEM[:4]}


def test_truncated_item_as_a_whole_document(spark):
    bench = spark.createDataFrame([(1, " ".join(ITEM)), (2, "five other words of text")], "item_id long, text string")
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in CUTS.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {d: (len(w) - 4) / 56 for d, w in CUTS.items() if (len(w) - 4) / 56 >= 0.8}
    assert {d: r["similarity"] for d, r in got.items()} == pytest.approx(want) and 1 in want
    assert all(r["start_word"] == 0 and r["n_words"] == len(CUTS[d]) for d, r in got.items())
    assert {r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()} == set(CUTS) - set(want)


def test_part_of_a_text_is_no_document():
    bench = decontaminate.Benchmark([(1, " ".join(ITEM))])
    tokens = [w.encode() for w in ITEM[:-1]]
    assert [(at, n) for _, at, n, *_ in bench.search(tokens)] == [(0, 59)]
    assert not list(bench.search(tokens, whole=False))
