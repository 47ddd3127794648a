"""Format-preserving pseudonyms for personal data and secrets.

A value that passes its validation (card numbers by check digit, account numbers by remainder, dates by the calendar,
addresses by range) is a number in the mixed radix of its format.  A keyed Feistel network permutes that range, walking on
until the image is valid too.  The map is a bijection of the values of one written form (for dates: separator, digits of day
and month, and which order they can be read in), so equal values stay equal, and different ones of a form different, across
documents.  Values of different forms are not linked, even if they mean the same.  Long names and secrets go in blocks, each tied
to those before it, so no character stays as it was but by chance.

Not covered: dates with written months, numbers abroad without a country code, and digits of other scripts, which stay.

Defined cases: a null text stays null; an empty text stays empty; digits that fail validation stay, as do dates before 1900
or after 2099; a day and month that can be read in both orders are read as day, month; a very long text takes time in
proportion to its length; repeated rows are treated alike; other columns are kept, and one named like ``kinds_col`` gives way to it.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import functools
import hashlib
import math
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from .common import column, free_name, map_texts

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
HEX = DIGITS + "abcdef"
YEARS = range(1900, 2100)
FIRST_DAY, LAST_DAY = datetime.date(YEARS[0], 1, 1).toordinal(), datetime.date(YEARS[-1], 12, 31).toordinal()
ROUNDS = 8

#: Characters of a value that are permuted as one number; a longer value is cut into blocks, each tied to those before it.
BLOCK = 64

FOUND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<key>\bAKIA[A-Z0-9]{16}\b)"
    r"|(?P<secret>(?i:password|passwd|secret|token|api[_-]?key)\s*+[=:]\s*+[\"']?[A-Za-z0-9_\-+/]{6,})"
    r"|(?P<hex>\b[0-9a-f]{32,64}\b)"
    r"|(?P<iso>(?<![\w/-])[0-9]{4}(?P<dash>[-/])[0-9]{2}(?P=dash)[0-9]{2}(?:(?=T[0-9]{2}:[0-9]{2})|(?![\w/-])))"
    r"|(?P<dmy>(?<![\w/.])[0-9]{1,2}(?P<mark>[/.])[0-9]{1,2}(?P=mark)[0-9]{4}(?![\w/]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w))"
    r"|(?P<abroad>(?<![\w+])\+[2-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,12})){1,6}(?!\w))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
)
#: Digits that may hold card numbers, a group of them with the mark before it, and what a value that fails is passed over by.
RUN, GROUP, WORD = re.compile(r"[0-9](?<!\w[0-9])(?:[ -]?[0-9]){12,}+"), re.compile(r"[ -]?([0-9]+)"), re.compile(r"\w+|.", re.S)
#: A text without any of these holds nothing to look for.
HINT = re.compile(r"[0-9]|@|passw|secret|token|key", re.I)
#: Digits of a number with a country code.
ABROAD = range(10, 16)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_holds(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def telephone_holds(value: str) -> bool:
    """Whether area and exchange of ten digits begin with 2 to 9."""
    digits = [c for c in value if c in DIGITS]
    return digits[0] > "1" and digits[3] > "1"


def order_of(p: int, q: int) -> str:
    """How the first two numbers of a date can be read: as day and month, as month and day, or both ways."""
    return "either" if p <= 12 and q <= 12 else "day first" if q <= 12 else "month first"


@functools.lru_cache(16)
def days_of(first_digits: int, second_digits: int, order: str) -> list[tuple[int, int, int]]:
    """(year, first, second) of every day that is written with so many digits and can be read in that order, ascending."""
    fits = lambda n, digits: digits == 2 or n < 10
    return [
        (year, p, q)
        for year in YEARS for p in range(1, 32) for q in range(1, 32)
        if order_of(p, q) == order and fits(p, first_digits) and fits(q, second_digits)
        and (q <= 12 and p <= calendar.monthrange(year, q)[1] if order != "month first" else p <= 12 and q <= calendar.monthrange(year, p)[1])
    ]


class Pseudonyms:
    def __init__(self, key: bytes):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
        self.replace = functools.lru_cache(100_000)(self._replace)

    def permute(self, x: int, size: int, tweak: str) -> int:
        """A keyed bijection of 0..size-1: an alternating Feistel network over two halves, walked until it is back in range."""
        a = max(1, int(size**0.5) if size < 1 << 100 else 1 << size.bit_length() // 2)
        b = -(-size // a)
        while True:
            left, right = divmod(x, b)
            for k in range(ROUNDS):
                if k % 2:
                    left = (left + self._mix(f"{tweak}|{size}|{k}|{right}")) % a
                else:
                    right = (right + self._mix(f"{tweak}|{size}|{k}|{left}")) % b
            x = left * b + right
            if x < size:
                return x

    def _mix(self, what: str) -> int:
        return int.from_bytes(hashlib.blake2b(what.encode(), key=self.key, digest_size=32).digest(), "big")

    def spell(self, text: str, tweak: str, alphabet: Callable[[str], str | None], valid: Callable[[str], bool] | None = None) -> str:
        """Permute the characters that have an alphabet, as one number; the others keep their places.

        With more than ``BLOCK`` of them and no validity to keep, they go in blocks of even size.  A block's tweak has its number,
        how many there are, and a digest of what stands before it.
        """
        places = [(k, a) for k, c in enumerate(text) if (a := alphabet(c))]
        blocks = 1 if valid else max(1, -(-len(places) // BLOCK))
        out, before = list(text), hashlib.blake2b(key=self.key, digest_size=16)
        for number in range(blocks):
            own = places[len(places) * number // blocks : len(places) * (number + 1) // blocks]
            size, x = 1, 0
            for k, a in own:
                x = x * len(a) + a.index(text[k])
                size *= len(a)
            if size == 1:
                continue
            tied = f"{tweak}|{number}|{blocks}|{before.hexdigest()}" if blocks > 1 else tweak
            while True:
                x = y = self.permute(x, size, tied)
                for k, a in reversed(own):
                    y, d = divmod(y, len(a))
                    out[k] = a[d]
                if not valid or valid("".join(out)):
                    break
            before.update("".join(text[k] for k, _ in own).encode())
        return "".join(out)

    @staticmethod
    def kinds(c: str) -> str | None:
        return next((a for a in (DIGITS, LOWER, UPPER) if c in a), None)

    def _replace(self, kind: str, value: str) -> str | None:
        """The image of a value, or none if it fails its validation."""
        digit = lambda c: DIGITS if c in DIGITS else None
        if kind == "email":
            name, _, host = value.partition("@")
            label, dot, rest = host.partition(".")
            got = self.spell(f"{name}@{label}", "email", self.kinds)
            return got + dot + rest
        if kind == "iso":
            mark = value[4]
            try:
                day = datetime.date.fromisoformat(value.replace(mark, "-")).toordinal()
            except ValueError:
                return None
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            return datetime.date.fromordinal(FIRST_DAY + self.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date" if mark == "-" else f"date{mark}")).isoformat().replace("-", mark)
        if kind == "dmy":
            return self._written_day(value)
        if kind == "ip":
            octets = value.split(".")
            if max(map(int, octets)) > 255 or not 1 <= int(octets[0]) <= 223:
                return None
            # of each octet, what is written with as many digits
            ranges = [range(10 ** (len(x) - 1) if x[0] != "0" else 0, min(10 ** len(x) if x[0] != "0" else 10 ** (len(x) - 1), 256)) if len(x) > 1 else range(10) for x in octets]
            ranges[0] = range(max(ranges[0].start, 1), min(ranges[0].stop, 224))
            x = 0
            for own, r in zip(octets, ranges, strict=True):
                x = x * len(r) + int(own) - r.start
            x = self.permute(x, math.prod(map(len, ranges)), f"ip{[*map(len, octets)]}")
            out = []
            for own, r in reversed([*zip(octets, ranges, strict=True)]):
                x, k = divmod(x, len(r))
                out.append(f"{r.start + k:0{len(own)}}")
            return ".".join(reversed(out))
        if kind == "phone":
            at = [k for k, c in enumerate(value) if c in DIGITS][-10]
            # a bijection of the valid ones, and one of the others
            own = telephone_holds(value[at:])
            return value[:at] + self.spell(value[at:], "phone", digit, lambda s: telephone_holds(s) == own)
        if kind == "abroad":
            if sum(c in DIGITS for c in value) not in ABROAD:
                return None
            country = re.match(r"\+[0-9]{1,3}(?![0-9])|\+[0-9]{2}", value)[0]
            return country + self.spell(value[len(country) :], f"abroad{country}", digit)
        if kind == "ssn":
            ok = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
            return self.spell(value, "ssn", digit, ok) if ok(value) else None
        if kind == "iban":
            return value[:2] + self.spell(value[2:], "iban" + value[:2], self.kinds, lambda s: iban_holds(value[:2] + s)) if iban_holds(value) else None
        if kind == "card":
            return value[0] + self.spell(value[1:], f"card{value[0]}", digit, lambda s: luhn(re.sub("[^0-9]", "", value[0] + s)))
        if kind == "key":
            return value[:4] + self.spell(value[4:], "key", self.kinds)
        if kind == "secret":
            name = re.match(r"[\w-]+\s*[=:]\s*[\"']?", value)[0]
            return name + self.spell(value[len(name) :], "secret", self.kinds)
        return self.spell(value, "hex", lambda c: HEX)

    def _written_day(self, value: str) -> str:
        mark = re.search(r"[/.]", value)[0]
        p, q, year = value.split(mark)
        form = (len(p), len(q), order_of(int(p), int(q)))
        days = days_of(*form)
        at = bisect.bisect_left(days, own := (int(year), int(p), int(q)))
        if at == len(days) or days[at] != own:
            return None
        year, a, b = days[self.permute(at, len(days), f"date{mark}{form}")]
        return f"{a:0{form[0]}}{mark}{b:0{form[1]}}{mark}{year}"

    def text(self, text: str | None) -> tuple[str | None, list[str]]:
        if not text or not HINT.search(text):
            return text, []
        kinds: list[str] = []
        out, done = [], 0
        cards = _cards(text)
        card = next(cards, None)
        m = FOUND.search(text)
        while m or card:
            if card and card[0] < done:  # begins in what was replaced
                card = next(cards, None)
                continue
            if m and m.start() < done:
                m = FOUND.search(text, done)
                continue
            if m and (not card or m.start() <= card[0]):
                kind, start = m.lastgroup, m.start()
                value = _iban_in(m[0]) if kind == "iban" else m[0]
                got = self.replace(kind, value) if value else None
                if got is None:  # only the word at its start is done with: what follows may begin another value
                    m = FOUND.search(text, WORD.match(text, start).end())
                    continue
            else:
                kind, start, value = "card", card[0], text[card[0] : card[1]]
                got = self.replace(kind, value)
            kinds.append("phone" if kind == "abroad" else kind)
            out += text[done:start], got
            done = start + len(value)
        return "".join(out) + text[done:], kinds


def _cards(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of card numbers: from every group of digits on, the longest run of whole groups with 13 to 19 digits and a right check digit.

    Running sums of a run's digits, with those at even or those at odd places doubled, give every check at once.
    """
    for m in RUN.finditer(text):
        starts, ends, counts, sums = [], [], [0], ([0], [0])
        for g in GROUP.finditer(text, m.start(), m.end()):
            starts.append(g.start(1))
            ends.append(g.end())
            for k, d in enumerate(map(int, g[1]), counts[-1]):
                twice = 2 * d - 9 * (d > 4)
                sums[k % 2].append(sums[k % 2][-1] + twice)
                sums[1 - k % 2].append(sums[1 - k % 2][-1] + d)
            counts.append(counts[-1] + len(g[1]))
        after = text[m.end() : m.end() + 1]
        whole = len(counts) - (after.isalnum() or after == "_")  # a group that goes on as a word ends no number
        for k, start in enumerate(starts):
            first = counts[k]
            if text[start] != "0":
                j = bisect.bisect_left(counts, first + 13)
                found = 0
                while j < whole and counts[j] <= first + 19:
                    own = sums[counts[j] % 2]
                    if (own[counts[j]] - own[first]) % 10 == 0:
                        found = j
                    j += 1
                if found:
                    yield start, ends[found - 1]


def _iban_in(value: str) -> str:
    """The longest part from the start that ends where a run ends and holds, all of it or 15 characters at least; an empty one if none does."""
    head = int("".join(str(int(c, 36)) for c in value[:4]))
    found, rest, n, size = "", 0, 4, len(value)
    for k in range(4, size):
        c = value[k]
        if c != " ":
            d = int(c, 36)
            rest, n = (rest * (100 if d > 9 else 10) + d) % 97, n + 1
        if k + 1 == size or value[k + 1] == " ":
            if (n >= 15 or k + 1 == size) and (rest * 10**6 + head) % 97 == 1:
                found = value[: k + 1]
    return found


def key_from_environment(name: str = "SWATHE_PSEUDONYM_KEY") -> bytes:
    """The deployment's key; there is no default, as a known key undoes every pseudonym."""
    if not (key := os.environ.get(name)):
        raise ValueError(f"{name} must hold the key of the pseudonyms")
    return key.encode()


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """All rows and columns with ``text_col`` rewritten; ``kinds_col`` adds the kinds of what was replaced, in order."""
    Pseudonyms(key)

    def start() -> Callable[[list], list]:
        own = Pseudonyms(key)
        return lambda texts: [{"text": text, "kinds": kinds} for text, kinds in map(own.text, texts)]

    found = free_name(docs, "found")
    rows = docs.withColumn(found, map_texts(column(text_col).cast("string"), start, "text string, kinds array<string>"))
    kept = [column(f"{found}").getField("text").alias(c) if c == text_col else column(c) for c in docs.columns if not kinds_col or c.lower() != kinds_col.lower()]
    return rows.select(*kept, *([column(found).getField("kinds").alias(kinds_col)] if kinds_col else []))
