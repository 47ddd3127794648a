"""What a Python worker holds between tasks and within one."""

import gc
import tracemalloc

from swathe.llm import common, langid, packing
from swathe.llm.queries import vocabulary


def test_models_go_with_their_job(spark):
    """A worker serves one stage after another; the words that one has met don't stay for the next."""
    docs = spark.createDataFrame([(k, f"plain words of text {k}", "en") for k in range(20)], "doc_id long, text string, lang string").coalesce(1)
    learned = langid.train(docs, vocabulary("piece_bpe_32k.model"))
    kinds = {"Forward", "WordCache"}

    def held(rows):
        list(rows)
        gc.collect()
        yield (sum(type(x).__name__ in kinds for x in gc.get_objects()),)

    before = langid.identify(docs, learned, ["doc_id"]).collect(), packing.pieces(docs, vocabulary("word_bpe_49k.json"), 1, 64).collect()
    assert list(map(len, before)) == [20, 20]
    assert [r["n"] for r in common.map_rows(docs, ["doc_id"], held, "n long").collect()] == [0]


def test_packing_holds_blocks_not_texts():
    """Ids of a block are looked up at once, so a block bounds what a task holds."""
    cache = packing.WordCache(vocabulary("word_bpe_49k.json"))
    cache.ids(["some words " * 10])
    rows = ((k, "some words of a long text " * 4000) for k in range(160))
    tracemalloc.start()
    n = sum(len(ids) for held in packing.blocks(rows) for ids in cache.ids([r[1] for r in held]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 160 * 24_000 and peak < 60e6
