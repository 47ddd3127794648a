"""Cases that a text operator once left out, by brute force."""

import random
import re

import pytest

from swathe.llm import jaccard, pii


def shingles(text, k=5):
    words = re.findall(r"\w+", text.lower())
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def likeness(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [1500, 8])
def test_near_stage_by_brute_force(spark, monkeypatch, block):
    """Pairs whose five-word likeness is 0.7 to 0.95, edited in one block or word by word: one of each component stays."""
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rng, texts = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    for k in range(60):
        base = [word() for _ in range(200)]
        texts.append(base)
        if k % 3 == 0:
            texts.append(base + [word() for _ in range(rng.randint(10, 60))])
        elif k % 3 == 1:
            texts.append(base[: rng.randint(150, 190)])
        else:
            places = set(rng.sample(range(200), rng.randint(1, 8)))
            texts.append([word() if i in places else w for i, w in enumerate(base)])
    texts = [" ".join(t) for t in texts]
    sets = [shingles(t) for t in texts]
    alike = [likeness(sets[i], sets[i + 1]) for i in range(0, len(sets), 2)]
    assert sum(0.8 <= x < 0.9 for x in alike) >= 10 and sum(x < 0.8 for x in alike) >= 5
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and likeness(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.ngram_jaccard(spark, docs, "").collect()}
    assert kept == set(root)


def test_linked_sets_are_of_neighbouring_steps():
    for percent in (60, 80, 90, 100):
        steps = jaccard.size_steps(percent).tolist()
        place = lambda n: sum(s <= n for s in steps)
        assert all(place(100 * n // percent) - place(n) <= 1 for n in range(1, 2000))


def test_pseudonyms_of_values_in_a_row():
    own, card = pii.Pseudonyms(b"k"), "4041894974608795"
    mapped = own.text(card)[0]
    for n in (3, 4, 9):
        for mark in (" ", "-"):
            assert own.text(mark.join([card] * n)) == (mark.join([mapped] * n), ["card"] * n)
    iban = "BE68 5390 0754 7034"
    as_one = own.text(iban)[0]
    assert as_one != iban and pii.iban_holds(as_one)
    for after in (" IS", " 2021", " PAID 2021", " AB", f" {card}", f" {iban} IS"):
        got, kinds = own.text(f"to {iban}{after}.")
        assert got == f"to {as_one}{after.replace(iban, as_one).replace(card, mapped)}." and kinds[0] == "iban"
    assert own.text(f"AB12 {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}")[1] == ["card"]


@pytest.mark.parametrize("block", [1500, 6])
def test_number_of_links_by_brute_force(spark, monkeypatch, block):
    """Groups of many linked texts, equal rows and rows without words."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rng, texts = random.Random(7), ["", " "]
    for _ in range(4):
        base = [f"w{rng.randrange(500)}" for _ in range(80)]
        for _ in range(10):
            copy = base + [f"v{rng.randrange(500)}" for _ in range(rng.randint(0, 12))]
            texts += [" ".join(copy)] * rng.choice([1, 1, 2])
    sets = [shingles(t, 3) if t.strip() else set() for t in texts]
    linked = lambda i, j: i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])
    want = {i: sum(bool(linked(i, j)) for j in range(len(sets))) for i in range(len(sets))}
    got = jaccard.linked_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), links=True).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and len(got) == len(texts) and max(want.values()) >= 3


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_linked_sets_share_a_signature(percent):
    """Random sets that are linked, in an order of random levels: some signature is the same, whatever the sizes."""
    import numpy as np

    rng, steps = np.random.default_rng(percent), jaccard.size_steps(percent, jaccard.WIDE)
    order, met = jaccard.Order(rng.integers(0, 5, 1 << 16).astype(np.uint8)), 0
    for _ in range(3000):
        both = rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64) * np.uint64(2)
        spare = int(len(both) * (100 - percent) / percent)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, spare // 2 + 1)).astype(np.uint64)])) for _ in range(2))
        if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            met += 1
            assert len(np.intersect1d(*(jaccard.signatures(order.sorted(x), percent, steps) for x in (a, b))))
    assert met > 500


def test_shared_passages_do_not_connect_documents_that_are_not_alike(spark):
    """The sketch tells n-grams of a few texts from those of one, so passages that five texts share give no signature."""
    rng = random.Random(5)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(40)) for _ in range(400)]
    texts = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) + " " + passages[k % 400]) for k in range(2000)]
    rows = jaccard.id_and_text(spark.createDataFrame(texts, "doc_id long, text string"))
    order = jaccard.learn_order(rows, 3)
    names, met = {}, 0
    for r in jaccard._read(rows, 3, 90, order).collect():
        met += len(r.others) + sum(names.setdefault(s, r.name) != r.name for s in r.signatures)
    assert met == 0


def exchanged_rows(df):
    """Rows that exchanges of a table's plan wrote when it was collected."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0
        children = plan.children()
        return own + sum(walk(children.apply(k)) for k in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_documents_that_stay_are_not_exchanged(spark):
    """One in twenty is a copy, among them a row without an id: only copies and rows that share a mark with one are exchanged with their text."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(k, words(k - 1 if k % 20 == 19 else k), "x") for k in range(2000)] + [(None, words(0), "x"), (None, words(5000), "y"), (40, words(39), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `mark_row` string")
    out = jaccard.one_of_each(docs, 5, 80)
    got = sorted((r.doc_id is None, r.doc_id, r.mark_row) for r in out.collect())
    assert got == sorted((False, k, m) for k, _, m in rows if k is not None and k % 20 != 19) + [(True, None, "x"), (True, None, "y")]
    # the hundred copies' ids twice (marks and anti-join), their rows, and the few that share a mark
    assert exchanged_rows(out) < 500
