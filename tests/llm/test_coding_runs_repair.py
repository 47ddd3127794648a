"""Byte pairs against their library, runs against all periods, repairs against all edits; the queries against their SQL."""

import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import pytest

from swathe.llm import bytepairs, queries, repair, runs

DATA = "/root/testdata/sf0.001"
PATH = queries.vocabulary("byte_bpe_50k.json")
ODD = ["a", "aa", "ab", "the", " ", "  ", "\n", "\t", "é", "T̈", "漢", "1", "２", "²", "Ⅷ", "!", "--", "'s", "'ll", "'", "_", "<|endoftext|>", "<|endof", "՘", "\U00010d40", "\x1c", "\x85", "😀", "ing", "==", "xx", "\r\n"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def codec():
    return bytepairs.BytePairCodec(PATH)


def texts_of(seed):
    rng = random.Random(seed)
    yield from ("".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(1500))
    yield from ("".join(rng.choices("ab", k=rng.randint(1, 40))) for _ in range(500))
    yield from ("".join(rng.choices("aeiountshr", k=rng.randint(1, 50))) for _ in range(3000))
    yield from ("".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(1500))
    yield from (c * k for c in ("a", " ", "-", "=~", "\n") for k in range(100))
    yield from ("x" * 300_000, "ab " * 200_000, "".join(rng.choices("aeiou", k=100_000)), "a b" * 100_000 + "  ")


def test_byte_pairs_equal_the_library(codec, library):
    texts = list(texts_of(1))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for x in codec.encode_all(texts)]
    assert got == want
    assert codec.n_merged > 1000  # words whose proposal failed
    for ids in want:
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_letter_and_number_is_the_librarys(codec, library):
    points = [c for c in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000)))]
    texts = ["".join(f"a{c}a1{c}1!{c}! {c}{c} " for c in points[k : k + 4096]) for k in range(0, len(points), 4096)]
    for k in range(0, len(texts), 32):
        assert [x.tolist() for x in codec.encode_all(texts[k : k + 32])] == [e.ids for e in library.encode_batch(texts[k : k + 32], add_special_tokens=False)]


def test_decoding_odd_ids(codec, library):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.randrange(50_400) for _ in range(8)]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_boundaries_against_merging(codec):
    rng = random.Random(3)
    pairs = [(rng.randrange(2000), rng.randrange(2000)) for _ in range(20_000)]
    left, right = np.array(pairs).T
    got = codec.compatible(left, right).tolist()
    for (a, b), ok in zip(pairs, got, strict=True):
        assert ok == (codec.merged(codec.raw[a] + codec.raw[b]) == [a, b])


def test_side_by_side_merging_equals_the_heap(codec):
    rng = random.Random(4)
    words = [bytes(rng.choices(b"aeiontsrh", k=rng.randint(1, 32))) for _ in range(3000)] + [b"a" * k for k in range(1, 33)]
    assert codec.merged_all(words) == [codec.merged(w) for w in words]


def test_byte_pair_tables(spark, library):
    texts = [None, "", "Two words", "Two words", "  ", "é" * 70_000, "<|endoftext|> ok"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = bytepairs.encode(docs, PATH)
    got = {r.doc_id: list(r.ids) for r in coded.collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in bytepairs.decode(coded, PATH).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bytepairs.round_trip(docs.limit(0), PATH).count() == 0
    digests = {r.doc_id: r for r in bytepairs.digest(bytepairs.round_trip(docs, PATH)).collect()}
    for i, t in enumerate(texts):
        ids = got[i]
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bytepairs.BytePairCodec(queries.vocabulary("word_bpe_49k.json"))


# --- runs ------------------------------------------------------------------------------------------------------------


def all_runs(words, least, times):
    n, out = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - s
            part = words[s : s + length]
            if length >= max(least, times * p) and all(any(part[k] != part[k + q] for k in range(length - q)) for q in range(1, p)):
                out.add((s, length, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(5)
    for _ in range(1500):
        n, kinds = rng.randint(0, 50), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        for least, times in ((6, 4), (2, 2), (5, 3)):
            assert runs.runs_of(np.array(words, np.int32), least, times) == all_runs(words, least, times)


def test_lyndon_arrays_under_both_orders():
    from swathe.llm.suffixes import lyndon_groups

    rng = random.Random(6)
    for _ in range(300):
        text = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        for own in (text, [-x for x in text]):
            _, width, of, _ = lyndon_groups(own)
            for i in range(len(own)):
                lyndon = [k for k in range(1, len(own) - i + 1) if all(own[i : i + k] < own[i + j : i + k] for j in range(1, k))]
                assert width[of[i]] == max(lyndon)


def test_long_runs_take_linear_time():
    import time

    for words in (np.zeros(300_000, np.int32), np.arange(300_000, dtype=np.int32) % 1000, np.arange(300_000, dtype=np.int32)):
        began = time.time()
        assert len(runs.runs_of(words)) == int(words.max() < 1000)
        assert time.time() - began < 20


def test_run_tables(spark):
    texts = [None, "", " \n\t", "a b c", "x " * 40, "x " * 40, "  " * 9, "u v w " * 7 + "u z", "p q " * 60_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, runs int")
    rows = {r.doc_id: r for r in runs.find_runs(docs).collect()}
    got = {i: [tuple(x) for x in r.runs] for i, r in rows.items()}
    assert got == {0: [], 1: [], 2: [], 3: [], 4: [(0, 40, 1)], 5: [(0, 40, 1)], 6: [(0, 9, 1)], 7: [(0, 22, 3)], 8: [(0, 120_000, 2)]}
    assert rows[7].collapsed == "u v w z" and rows[8].collapsed == "p q" and rows[0].collapsed == "" and rows[3].collapsed == "a b c"
    assert runs.digest(runs.find_runs(docs.limit(0))).count() == 0
    best = {r.doc_id: r for r in runs.digest(runs.find_runs(docs)).collect()}
    assert (best[7].start, best[7].length, best[7].period, best[7].exponent_milli) == (0, 22, 3, 7333)
    assert best[0].start is None and best[0].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert best[4].runs_sha256 == hashlib.sha256(b"0,40,1\n").hexdigest()


# --- repair ----------------------------------------------------------------------------------------------------------


def all_edits(turns, limit):
    """The least (cost, audit) over every sequence of edits up to a cost."""
    out = []

    def go(i, cost, audit, roles):
        if cost > limit:
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            out.append((cost, audit))
        for r in "ua":
            go(i, cost + 2, audit + "I", roles + r)
        if i < len(turns):
            role, fault = turns[i]
            go(i + 1, cost + 3, audit + "D", roles)
            if fault not in "bd":
                cut = fault == "t"
                go(i + 1, cost + cut, audit + "K", roles + role)
                for r in "ua":
                    go(i + 1, cost + 2 + cut, audit + "R", roles + r)

    go(0, 0, "", "")
    return min(out)


def some_turns(rng, n):
    return [(rng.choice("suuaa-"), rng.choice("----tbd")) for _ in range(n)]


def test_search_against_all_edits():
    rng = random.Random(7)
    for _ in range(300):
        turns = some_turns(rng, rng.randint(0, 4))
        got = repair.search(turns)
        assert got == all_edits(turns, got[0])
        assert "".join(x for x in got[1] if x != "I").__len__() == len(turns)


def test_search_proves_its_answer_without_bounds_too():
    rng = random.Random(8)
    for _ in range(1500):
        turns = some_turns(rng, rng.randint(0, 9))
        assert repair.search(turns, [(0,) * 4] * (len(turns) + 1)) == repair.search(turns)


def test_a_long_conversation_takes_linear_time():
    import time

    turns = some_turns(random.Random(9), 100_000)
    began = time.time()
    cost, audit = repair.search(turns)
    assert time.time() - began < 20 and len(audit) >= 100_000
    roles = [(r or "x")[0] if n is None or r else turns[n - 1][0] for n, r in repair.written_turns(turns, audit)]
    assert re.fullmatch("(s?(ua)+)?", "".join(roles))


def by_hand(rows):
    """Report of one conversation's rows (turn, role, text) in order."""
    seen, turns, faults = set(), [], []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
        seen.add((role, text))
        faults.append(fault)
        turns.append((role[:1] if role[:1] in ("s", "u", "a") else "-", fault))
    cost, audit = repair.search(turns)
    out, n, q = [], 0, ""
    for x in audit:
        n += x != "I"
        if x == "D":
            continue
        _, role, text = rows[n - 1] if x != "I" else (None, None, "")
        if x != "K":
            role = "assistant" if q == "u" else "user"
        q = role[0]
        out.append(f"{role}:{text}")
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repair_tables(spark):
    long = "word " * 50_000 + "end."
    cases = {
        1: [(None, "system", "Be kind."), (0, "user", "Hi?"), (1, "assistant", "Yes.")],
        2: [(0, "user", "Hi?"), (0, "user", "Hi?"), (5, "assistant", " \n"), (7, "assistant", "cut off ")],
        3: [(0, "tool", long), (1, "assistant", long), (2, "assistant", long)],
        4: [(None, None, None), (None, None, "What?")],
        5: [(3, "system", "a."), (4, "system", "b."), (5, "", "c.")],
        None: [(0, "user", "One. \t"), (1, "assistant", "Two!")],
    }
    rows = [(c, t, r, x, "y") for c, held in cases.items() for t, r, x in held]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    every = spark.createDataFrame([(c,) for c in [*cases, 99]], "conv_id long")
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(table, every).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert set(got) == {*cases, 99}
    for c, held in cases.items():
        plain = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in held]
        assert got[c] == by_hand(plain), c
    assert got[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.report(table.limit(0), every.limit(0)).count() == 0
    turns = repair.repair(table)[1]
    assert [(r.role, r.text) for r in turns.where("conv_id = 1").orderBy("at").collect()] == [("system", "Be kind."), ("user", "Hi?"), ("assistant", "Yes.")]


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_of_turns_change_nothing(spark, monkeypatch, block):
    rng = random.Random(10)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "C?", " "])) for c in range(6) for t in range(rng.randint(1, 12))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(repair, "BLOCK_TURNS", block)
    got = {r.conv_id: r for r in repair.report(table, table).collect()}
    for c in range(6):
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == by_hand([x[1:] for x in rows if x[0] == c])


@pytest.mark.parametrize("name", ["op12_runs", "op13_repair"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    rel = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r) for r in rel.select(*columns).fetchall()), key=str)


def test_byte_pair_query_equals_the_library(spark, library):
    table = duckdb.sql(f"select doc_id, coalesce(text, '') from '{os.path.join(DATA, 'documents.parquet')}'").fetchall()
    want = {}
    for (doc_id, text), e in zip(table, library.encode_batch([t for _, t in table], add_special_tokens=False), strict=True):
        decoded = library.decode(e.ids, skip_special_tokens=False)
        want[doc_id] = (len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_byte_pairs(spark, DATA).collect()} == want
