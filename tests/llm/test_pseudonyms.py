"""Pseudonyms of values of any length, one to one in every written form; texts of any kind in time."""

import datetime
import itertools
import random
import re
import string
import time
import unicodedata

import pytest

from swathe.llm import packing, pii, queries, suffixes

OWN = pii.Pseudonyms(b"a key of this test")


@pytest.mark.parametrize("n", [6, 10, 64, 65, 200, 1000, 5000, 1_000_000])
def test_secrets_and_names_of_any_length(n):
    rng = random.Random(n)
    value = "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    for before, text in (("token=", f"token={value}"), ("", f"{value.lower()}@example.com")):
        out, kinds = OWN.text(text)
        assert len(kinds) == 1 and len(out) == len(text)
        part = out[len(before) : len(before) + n]
        shown = text[len(before) : len(before) + n]
        same = sum(a == b for a, b in zip(part, shown, strict=True))
        # by chance one of 26 letters, and of 10 digits, stays
        assert same <= 6 + n * 0.07
        assert all(a.isdigit() == b.isdigit() and a.islower() == b.islower() for a, b in zip(part, shown, strict=True))


def test_a_block_hangs_on_those_before_it():
    rest = "".join(random.Random(1).choices(string.ascii_lowercase, k=300))
    a, b = (OWN.text("secret=" + x + rest)[0][8:] for x in "pq")
    assert sum(x == y for x, y in zip(a, b, strict=True)) < 40


def one_to_one(values, valid=lambda v: True):
    images = [OWN.text(v)[0] for v in values]
    assert len(set(images)) == len(values) and all(map(valid, images))
    assert sum(a == b for a, b in zip(images, values, strict=True)) <= max(3, len(values) // 50)
    return set(images)


def test_every_day_and_small_forms_are_permuted():
    first = datetime.date(1900, 1, 1)
    days = [(first + datetime.timedelta(k)) for k in range((datetime.date(2099, 12, 31) - first).days + 1)]
    for form in ("%Y-%m-%d", "%Y/%m/%d"):
        every = [d.strftime(form) for d in days]
        assert one_to_one(every) == set(every)
    written = [d.strftime("%d/%m/%Y") for d in days if d.day > 12]
    assert one_to_one(written) == set(written)
    octets = [f"{a}.{b}.{c}.{d}" for a, b, c, d in itertools.product(range(1, 10), range(10), range(10), range(10))]
    assert one_to_one(octets) == set(octets)
    names = [f"{a}@{b}.org" for a, b in itertools.product(string.ascii_lowercase, repeat=2)]
    assert one_to_one(names) == set(names)


def test_telephones_of_both_kinds_stay_apart():
    rng = random.Random(2)
    numbers = list({f"{rng.randrange(1000):03}-{rng.randrange(1000):03}-{rng.randrange(10_000):04}" for _ in range(6000)})
    images = one_to_one(numbers)
    assert len(images) == len(numbers)
    for n in numbers[:500]:
        assert pii.telephone_holds(OWN.text(n)[0]) == pii.telephone_holds(n)


def test_cards_accounts_and_the_rest_stay_valid():
    rng = random.Random(3)
    cards = set()
    while len(cards) < 1500:
        d = "4" + "".join(rng.choices(string.digits, k=14))
        cards.add(next(d + c for c in string.digits if pii.luhn(d + c)))
    one_to_one(sorted(cards), pii.luhn)
    ibans = set()
    while len(ibans) < 300:
        body = "".join(rng.choices(string.digits, k=18))
        ibans.add(next(v for k in range(98) if pii.iban_holds(v := f"DE{k:02}{body}")))
    one_to_one(sorted(ibans), pii.iban_holds)
    one_to_one(sorted({f"{rng.randrange(1, 660):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10_000):04}" for _ in range(2000)}))
    one_to_one(sorted({"AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)) for _ in range(500)}), re.compile("AKIA[A-Z0-9]{16}").fullmatch)
    one_to_one(sorted({"".join(rng.choices("0123456789abcdef", k=40)) for _ in range(500)}), re.compile("[0-9a-f]{40}").fullmatch)
    one_to_one(sorted({f"+44 {rng.randrange(10**10):010}" for _ in range(1000)}), re.compile(r"\+44 \d{10}").fullmatch)


def cards_by_hand(text):
    out = []
    for m in re.finditer(r"(?<![\w])[1-9]", text):
        if re.search(r"[0-9]$", text[: m.start()]):
            continue
        best = None
        for e in range(m.start() + 13, min(len(text), m.start() + 40) + 1):
            part = text[m.start() : e]
            if re.fullmatch(r"[0-9]+(?:[ -][0-9]+)*", part) and not re.match(r"\w", text[e : e + 1]) and 13 <= sum(c.isdigit() for c in part) <= 19 and pii.luhn(re.sub("[^0-9]", "", part)):
                best = e
        if best:
            out.append((m.start(), best))
    return out


def test_cards_in_runs_of_digits_by_hand():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choices(["4111", "1111", "12", "7", "0", " ", " ", "-", "  ", "a", "4242424242424242", "."], k=rng.randint(1, 40)))
        assert list(pii._cards(text)) == cards_by_hand(text), text


def test_only_ascii_digits_are_dates_and_numbers():
    for text in ("٢٠٠١-٠٩-٠٥", "１２３-４５６-７８９０"):
        assert OWN.text(text) == (text, [])


def test_times_and_other_countries():
    for text, kind in (("2001-09-05T10:00:00Z", "iso"), ("2001/09/05", "iso"), ("+44 20 7946 0958", "phone"), ("+49 30 901820", "phone")):
        out, kinds = OWN.text(f"x {text}.")
        assert kinds == [kind] and out != f"x {text}." and re.sub("[0-9]", "", out) == re.sub("[0-9]", "", f"x {text}.")
    assert OWN.text("+12 345 678 and 5 September 2001") == ("+12 345 678 and 5 September 2001", [])


@pytest.mark.parametrize("part", ["1 ", "12 ", "AB12 CD34 ", "4111 1111 1111 1111 ", "a@b ", "2001-09-05 ", "+44 20 ", "7", "token=", "x", "1.1.1.1 "])
def test_a_megabyte_of_anything_takes_seconds(part):
    began = time.time()
    OWN.text(part * (1_000_000 // len(part)))
    assert time.time() - began < 12


# --- what other operators say of odd texts and tables ------------------------------------------------------------------


def test_packing_ids_of_letters_with_marks():
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(5)
    letters = string.ascii_letters + "ÀÉØßıİΣς"
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = [f"{a}{m}" for a in letters for m in marks]
    texts += ["".join(rng.choices([*letters, *marks, " ", "1", "'S", "<|"], k=rng.randint(1, 12))) for _ in range(30_000)]
    texts += [unicodedata.normalize("NFD", t) for t in texts[-3000:]]
    got = packing.WordCache(path).ids(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rewrite_keeps_columns_of_any_name_and_kind(spark):
    long = "word " * 60
    rows = [(1, long + "a", {"a b": 1}, [("k", 2)]), (2, long + "b", None, None), (3, "short", {"a b": 3}, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `meta.url` struct<`a b`:int>, `x``y` array<struct<`p q`:string,r:int>>")
    got = {r["doc_id"]: r for r in suffixes.rewrite(docs).collect()}
    assert got[1]["meta.url"]["a b"] == 1 and got[2]["meta.url"] is None and got[1]["x`y"][0]["p q"] == "k" and got[3]["text"] == "short"
    assert len(got[1]["text"]) < 5


def test_pipeline_takes_a_key(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "token=abcdefgh12 of a person")], "doc_id long, text string")
    texts = {corpus_pipeline.pseudonyms(spark, docs, "", key).first()["text"] for key in (b"one", b"two")}
    assert len(texts) == 2 and corpus_pipeline.pseudonyms(spark, docs, "").first()["text"] == pii.Pseudonyms(queries.TEST_KEY).text("token=abcdefgh12 of a person")[0]
