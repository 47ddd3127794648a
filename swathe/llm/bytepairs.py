"""Byte-pair encoding and decoding: speculate, verify, merge only what fails.

A text is cut into words as the vocabulary's file says.  Of every word that wasn't met before, greedy longest match proposes
tokens.  A sequence of tokens is what merging gives exactly when merging each token's own bytes gives that token and no two
neighbours would have merged across their boundary, so all pairs of neighbours in all proposals are checked at once, as arrays:
each step looks up whether the two parts at a boundary merge while both are there, and undoes the later merge of the two.  Words
with a failing pair are merged pair by pair, many of them side by side; no other word is.

What letters, numbers and spaces are is the installed tokenizers library's reading of them, asked of it for every code point on
which Unicode tables of different age may differ.  An added token's string in a text is that token, as in the library.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows give repeated rows; a very long text
is read in parts that end where a word ends, so beside the text and its ids a bounded number of words is held; a very long word
is merged in time n log n; equal ranks merge from the left; ids outside of the vocabulary decode to nothing and bytes that are no
UTF-8 to the replacement character; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import array
import functools
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_model, id_and_text, map_rows

#: Words that a worker keeps, and their characters; it forgets all when there are more.  A longer word is not kept.
CACHE_WORDS, CACHE_CHARS, WORD_CHARS = 600_000, 8_000_000, 64
#: A text is read in parts of so many characters and up to the next white space after a word.
PART_CHARS = 1 << 18
#: Characters of texts whose new words are verified together, and rows that come together.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 256
#: The rule by which such vocabularies cut texts; classes are filled in by ``word_finder``.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: Words of so many bytes at most are merged side by side, longer ones each from a heap.
LANES = 32
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the file stands for: printable ones stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranges(points: Iterable[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in sorted(points):
        out[-1:] = [(out[-1][0], p)] if out and out[-1][1] == p - 1 else [*out[-1:], (p, p)]
    return out


def char_class(points: Iterable[str]) -> str:
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges(map(ord, points)))


@functools.cache
def word_finder() -> Callable[[str, int, int], list[str]]:
    """Finds the words of a stretch of text, with letters and numbers that the installed library knows as such.

    The standard library's expressions are faster; they serve for a stretch in which both mean the same by every character.
    """
    from unicodedata import category

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    exact, plain, odd = "(?V1)" + WORDS, WORDS, set(regex.findall(r"\s", every)) ^ set(re.findall(r"\s", every))
    for name, example, near in (("L", "a", r"[^\W\d_]"), ("N", "1", r"\d")):
        own = set(regex.findall(rf"\p{{{name}}}", every))
        asked = sorted(c for c in own if category(c)[0] != name)
        # of a string like a?a!a?a!, one of a kind with its neighbours leaves no cut beside it
        ends = {e for _, (s, e) in cut("".join(f"{example}{c}{example}!" for c in asked))}
        unknown = [c for k, c in enumerate(asked) if 4 * k + 1 in ends or 4 * k + 2 in ends]
        odd |= own.difference(unknown) ^ set(re.findall(near, every))
        exact = exact.replace(f"{{{name}}}", f"[\\p{{{name}}}--[{char_class(unknown)}]]" if unknown else f"\\p{{{name}}}")
        plain = plain.replace(f"{{{name}}}", near)
    # inside of a negated class the standard library takes no class
    fast, slow = re.compile(plain.replace(r"[^\s[^\W\d_]\d]", r"(?:[^\s\w]|_)")), regex.compile(exact)
    return lambda text, at, end: (fast if odd.isdisjoint(text[at:end]) else slow).findall(text, at, end)


class BytePairCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, before = held["model"], held.get("pre_tokenizer") or {}
        added = held.get("added_tokens") or []
        if (
            model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or held.get("normalizer")
            or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        ):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        self.raw: dict[int, bytes] = {i: bytes(letters[c] for c in word) for word, i in model["vocab"].items()}
        self.raw |= {t["id"]: t["content"].encode() for t in added}
        self.special = {t["content"]: t["id"] for t in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        size = self.size = max(vocab.values()) + 1
        self.made = np.full(size, -1, np.int64)  # rank of the merge that makes a token
        self.halves = np.full((2, size), -1, np.int64)
        for rank, (a, b) in enumerate(pairs):
            whole, a, b = vocab[a + b], vocab[a], vocab[b]
            if self.made[whole] >= 0 or max(self.made[a], self.made[b]) >= rank:
                raise ValueError("a token has two merges, or is merged before it is made")
            self.made[whole] = rank
            self.halves[:, whole] = a, b
        self.byte = [vocab[c] for c, b in sorted(letters.items(), key=lambda x: x[1])]
        merged = np.flatnonzero(self.made >= 0)
        keys = self.halves[0, merged] * size + self.halves[1, merged]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], self.made[merged][order]
        self.by_rank = np.zeros(len(pairs), np.int64)
        self.by_rank[self.made[merged]] = merged
        self.merge = dict(zip(zip(*self.halves[:, merged].tolist(), strict=True), zip(self.made[merged].tolist(), merged.tolist(), strict=True), strict=True))
        self.whole = self._whole(merged)
        self.ids = {self.raw[i]: i for i in vocab.values() if self.whole[i]}
        self.reach: dict[bytes, int] = {}  # the longest token that begins with these four bytes
        for word in self.ids:
            self.reach[word[:4]] = max(self.reach.get(word[:4], 3), len(word))
        self.known: dict[str, bytes] = {}
        self.known_chars = 0
        self.n_merged = 0

    def _whole(self, merged: np.ndarray) -> np.ndarray:
        """Which tokens are what merging their own bytes gives: their halves are, and nothing merges across before they do."""
        own = np.zeros(self.size, bool)
        own[self.byte] = True
        alone = np.ones(self.size, bool)
        alone[merged] = self.compatible(*self.halves[:, merged], self.made[merged])
        for t in merged[np.argsort(self.made[merged])].tolist():
            a, b = self.halves[:, t]
            own[t] = alone[t] and own[a] and own[b]
        return own

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two tokens; an id below 0 merges with nothing."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether merging the joint bytes of each two tokens leaves their boundary alone, up to the merge of rank ``until``."""
        ok = np.ones(len(left), bool)
        live = np.arange(len(left))
        a, b = np.array(left), np.array(right)
        until_a = np.broadcast_to(np.asarray(until, np.int64), len(a)).copy()  # the rank at which the part at the boundary is used up
        until_b = until_a - (until_a != NEVER)
        while len(live):
            rank = self.rank(a, b)
            # of equal ranks the left one merges first
            bad = (rank < until_a) & (rank <= until_b) & (rank != NEVER)
            ok[live[bad]] = False
            go = ~bad & ((self.made[a] >= 0) | (self.made[b] >= 0))
            live, a, b, until_a, until_b = live[go], a[go], b[go], until_a[go], until_b[go]
            back = self.made[a] > self.made[b]
            until_a = np.where(back, self.made[a], until_a)
            until_b = np.where(back, until_b, self.made[b])
            a, b = np.where(back, self.halves[1, a], a), np.where(back, b, self.halves[0, b])
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Tokens of greedy longest match."""
        ids, reach, out, at, n = self.ids, self.reach, [], 0, len(word)
        while at < n:
            end = min(n, at + reach.get(word[at : at + 4], 3))
            while (i := ids.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words: the best-ranked neighbours first, the leftmost of equals; a step merges a pair of each word."""
        out: list[list[int]] = [[]] * len(words)
        for k, w in enumerate(words):
            if len(w) > LANES:
                out[k] = self.merged(w)
        rows = [k for k, w in enumerate(words) if len(w) <= LANES]
        if not rows:
            return out
        byte = np.append(np.array(self.byte, np.int64), -1)
        lengths = np.array([len(words[k]) for k in rows])
        wide = int(lengths.max())
        grid = np.frombuffer(b"".join(words[k].ljust(wide, b"\0") for k in rows), np.uint8).reshape(len(rows), wide)
        ids = np.where(np.arange(wide) < lengths[:, None], byte[grid], -1)
        ranks = np.full((len(rows), wide), NEVER)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(rows))
        places = np.arange(wide)
        while len(live):
            best = ranks.argmin(1)
            every = np.arange(len(live))
            go = ranks[every, best] != NEVER
            if not go.all():
                for k, row in zip(live[~go].tolist(), ids[~go].tolist(), strict=True):
                    out[rows[k]] = [i for i in row if i >= 0]
                live, ids, ranks, best, every = live[go], ids[go], ranks[go], best[go], every[: go.sum()]
                if not len(live):
                    break
            made = self.by_rank[ranks[every, best]]
            # what stands after the merged pair moves up by one place
            shift = np.minimum(places + (places > best[:, None]), wide - 1)
            last = ids[:, -1].copy()
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = np.where(best < wide - 1, -1, last)
            ids[every, best] = made
            ranks = np.take_along_axis(ranks, shift, 1)
            ranks[:, -1] = NEVER
            for at in (best, best - 1):
                there = (at >= 0) & (at < wide - 1)
                r, c = every[there], at[there]
                ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word of any length, from a heap of ranks."""
        ids = [self.byte[b] for b in word]
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        get = self.merge.get
        heap = [(found[0], k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (found := get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            n = after[k]
            if ids[k] != a or n < 0 or ids[n] != b:
                continue
            ids[k], ids[n] = get((a, b))[1], -1
            after[k] = m = after[n]
            if m >= 0:
                before[m] = k
                if found := get((ids[k], ids[m])):
                    heapq.heappush(heap, (found[0], k, ids[k], ids[m]))
            if (p := before[k]) >= 0 and (found := get((ids[p], ids[k]))):
                heapq.heappush(heap, (found[0], p, ids[p], ids[k]))
        return [i for i in ids if i >= 0]

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """32-bit ids of words, each met once."""
        raws = [w.encode() for w in words]
        proposed = [self.propose(r) for r in raws]
        flat = np.array([i for p in proposed for i in p], np.int64)
        ends = np.cumsum([len(p) for p in proposed])
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        left = np.flatnonzero(inner)
        pairs, where = np.unique(flat[left] * self.size + flat[left + 1], return_inverse=True)
        fails = ~self.compatible(pairs // self.size, pairs % self.size)[where]
        failing = np.zeros(len(raws), bool)
        failing[np.searchsorted(ends, left[fails], "right")] = True
        fail = np.flatnonzero(failing).tolist()
        for k, ids in zip(fail, self.merged_all([raws[k] for k in fail]), strict=True):
            proposed[k] = ids
        self.n_merged += len(fail)
        return {w: array.array("i", p).tobytes() for w, p in zip(words, proposed, strict=True)}

    def _parts(self, text: str) -> Iterator[tuple[int, int | list[str]]]:
        """Characters, and an added token's id or words: of a whole text, a part at a time."""
        words, ends = word_finder(), re.compile(r"\S(?=\s)")
        for piece in self.split.split(text) if self.split else (text,):
            if (special := self.special.get(piece)) is not None:
                yield 1, special
                continue
            at = 0
            while at < len(piece):
                cut = ends.search(piece, at + PART_CHARS)
                end = cut.end() if cut else len(piece)
                yield end - at, words(piece, at, end)
                at = end

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """32-bit ids of whole texts; the new words of many are verified together."""
        out = [bytearray() for _ in texts]
        waiting: list[tuple[int, int | list[str]]] = []
        chars = 0

        def flush() -> None:
            known = self.known
            if len(known) >= CACHE_WORDS or self.known_chars >= CACHE_CHARS:
                known.clear()
                self.known_chars = 0
            met: set[str] = set()
            for _, part in waiting:
                if not isinstance(part, int):
                    met.update(part)
            fresh = [w for w in met if w not in known]
            got = self.learn(fresh) if fresh else {}
            brief = {w: i for w, i in got.items() if len(w) <= WORD_CHARS}
            known.update(brief)
            self.known_chars += sum(map(len, brief))
            lengthy = {w: i for w, i in got.items() if w not in brief}
            for k, part in waiting:
                if isinstance(part, int):
                    out[k] += array.array("i", [part]).tobytes()
                elif lengthy:
                    out[k] += b"".join([known.get(w) or lengthy[w] for w in part])
                else:
                    out[k] += b"".join(map(known.__getitem__, part))
            waiting.clear()

        for k, text in enumerate(texts):
            for size, part in self._parts(text or ""):
                waiting.append((k, part))
                chars += size
                if chars >= BATCH_CHARS:
                    flush()
                    chars = 0
        flush()
        return [np.frombuffer(x, np.int32) for x in out]

    def decode(self, ids: Iterable[int]) -> str:
        raw = self.raw
        return b"".join([raw.get(i, b"") for i in ids]).decode("utf-8", "replace")


def codec_of(path: str) -> BytePairCodec:
    return held_model(("pairs", path), lambda: BytePairCodec(path))


def _encoded(rows: Iterator[tuple], codec: BytePairCodec) -> Iterator[tuple]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[1])
        if chars >= BATCH_CHARS or len(held) >= BATCH_ROWS:
            yield from zip((r[0] for r in held), codec.encode_all([r[1] for r in held]), strict=True)
            held, chars = [], 0
    yield from zip((r[0] for r in held), codec.encode_all([r[1] for r in held]), strict=True)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``ids`` of every whole text."""
    return map_rows(id_and_text(docs), ["doc_id", "text"], lambda rows: _encoded(rows, codec_of(path)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``text`` of every row of ids."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        codec = codec_of(path)
        for doc_id, ids in rows:
            yield doc_id, codec.decode(i for i in ids or () if i is not None)

    return map_rows(encoded, ["doc_id", "ids"], run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, the ``ids`` of every whole text and the ``text`` that they decode to, in one pass."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        codec = codec_of(path)
        for doc_id, ids in _encoded(rows, codec):
            yield doc_id, ids, codec.decode(ids.tolist())

    return map_rows(id_and_text(docs), ["doc_id", "text"], run, "doc_id long, ids array<int>, text string")


def digest(coded: DataFrame) -> DataFrame:
    """Number of ids, and digests of the decimal ids and of the decoded text."""
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
