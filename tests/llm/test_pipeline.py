"""The corpus pipeline, stage by stage, against a brute-force version of each."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathe.llm import langid, pii, queries
from swathe.llm.common import materialize

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    """The smallest documents, and with them null, empty and long texts, repeated rows, near copies, and columns whose names clash with those that stages make."""
    rng, docs = random.Random(2), queries.documents(spark, DATA)
    rows = [r.asDict() for r in docs.collect()]
    long = max((r["text"] or "" for r in rows), key=len)
    base = [r for r in rows if r["text"] and 60 < len(r["text"].split()) < 400][:6]
    extra = [(10_001, None), (10_002, ""), (10_003, " \n "), (10_004, long + " " + " ".join(sorted(long.split()))), (10_005, "漢字 ...")]
    for k, r in enumerate(base):
        words = r["text"].split(" ")
        cut = [w for j, w in enumerate(words) if j not in range(7 * k, 7 * k + 4)]
        extra += [(10_010 + k, " ".join(cut)), (10_020 + k, " ".join(rng.sample(words, len(words))) + f" Call +1 (736) 555-26{10 + k} or pay 4041894974608795 by 2024-02-1{k}.")]
    rows += [{**rows[0], "doc_id": i, "text": t, "lang": rng.choice([None, "en"])} for i, t in extra] + [dict(rows[7]), dict(rows[7])]
    whole = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    return whole.withColumns({"found": F.lit(1), "kept": F.lit("z"), "score": F.lit(0.5), "lang_pred": F.lit("x"), "kinds": F.array(F.lit("y")), "own": F.col("doc_id"), "packed": F.lit(2)})


@pytest.fixture(scope="module")
def stages(spark, given):
    """Name of each stage: the rows that it got and those that it gave."""
    import corpus_pipeline

    out, docs = {}, given
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialize(stage(spark, docs, DATA), f"test{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()])
        docs = after
    return out


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_language_by_summing_each_word(spark, stages, given):
    """Every word's probability by a sum over its prefixes, in Python's own numbers."""
    import corpus_pipeline

    before, after = stages["language ID"]
    model = langid.train(given.where(~F.coalesce(langid.held_out(), F.lit(False))), queries.vocabulary("piece_bpe_32k.model"))
    longest = max(map(len, model["pieces"]))
    known: dict = {}

    def logs(word):
        if word not in known:
            sums = [np.ones(len(model["langs"]))]
            for j in range(1, len(word) + 1):
                now = np.zeros(len(model["langs"]))
                for i in range(max(0, j - longest), j):
                    p = model["pieces"].get(word[i:j])
                    if p or i == j - 1:
                        now = now + sums[i] * (np.array(p) if p else langid.UNKNOWN)
                sums.append(now)
            known[word] = np.log(np.maximum(sums[-1], 1e-300))
        return known[word]

    want, langs = Counter(), {}
    for r in before:
        text = r["text"] or ""
        if any(map(str.isalpha, text)):
            total = sum(logs("▁" + w) for w in text.split())
            share = np.exp(total - total.max())
            if 1 / share.sum() >= corpus_pipeline.LEAST_SCORE:
                want[r["doc_id"]] += 1
                langs[r["doc_id"]] = r["lang"] or model["langs"][int(total.argmax())]
    assert ids(after) == want and {r["doc_id"]: r["lang"] for r in after} == langs and len(after) < len(before)


def test_near_copies_by_all_pairs(stages):
    before, after = stages["n-gram Jaccard join"]

    def shingles(text):
        w = text.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [shingles(r["text"]) for r in before]
    root = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if root[i] != root[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    least = {c: min(before[k]["doc_id"] for k in range(len(before)) if root[k] == c) for c in set(root)}
    assert ids(after) == Counter(r["doc_id"] for k, r in enumerate(before) if r["doc_id"] == least[root[k]]) and len(after) < len(before)


def test_passages_by_all_windows(stages):
    before, after = stages["suffix-array dedup"]
    texts = [r["text"].encode() for r in before]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = Counter()
    for r, t in zip(before, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        if not gone.count(1) or gone.count(1) < len(t):
            left = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
            want[r["doc_id"], left, len(left)] += 1
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in after) == want and len(after) < len(before)


def test_personal_data_row_by_row(stages):
    before, after = stages["PII"]
    own = pii.Pseudonyms(queries.TEST_KEY)
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in after) == Counter((r["doc_id"], t, len(t)) for r in before for t in [own.text(r["text"])[0]])
    assert sum("4041894974608795" in r["text"] for r in before) and not any("4041894974608795" in r["text"] for r in after)


def test_packing_by_the_library_and_one_by_one(stages):
    from tokenizers import Tokenizer

    before, after = stages["best-fit packing"]
    tk, want, lengths = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")), Counter(), []
    for r in before:
        found = np.array([*tk.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(found), 4096):
            part = found[at : at + 4096]
            want[r["doc_id"], at // 4096, at, len(part), zlib.crc32(part.tobytes())] += 1
            lengths.append(len(part))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want
    rooms: list = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(4096 - n)
    used: dict = {}
    for r in sorted(after, key=lambda r: r["offset"]):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(4096 - n for n in used.values()) == sorted(rooms)


def test_empty_table(spark, given):
    import corpus_pipeline

    docs = given.where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, DATA), f"empty{k}")
        assert docs.count() == 0
