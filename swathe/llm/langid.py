"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary.  A forward pass sums the probability of every
segmentation of a text into pieces, so the score does not hang on one tokenisation.  The sum factorises wherever no piece
spans two characters: between words always, as no piece holds a word mark after another character, and inside a word of
characters that the vocabulary lacks.  Between such places the pass keeps the sums of as many boundaries as the longest piece
has characters and rescales them as it goes, so a stretch may have any length.  Each task keeps the sums of words it has met.

Defined cases: a null text or one without a letter is ``und`` with score 0; characters outside the vocabulary have one
small probability in every language; a very long text or word is read whole; repeated rows are predicted alike; ties go to
the first language by name; with nothing to learn from, all is ``und``; columns of a table that are named like a result
give way to it.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, free_name, held_model, map_rows, map_texts

MARK = "▁"
#: Words that a task keeps, and their characters.
CACHE_WORDS, CACHE_CHARS = 200_000, 4_000_000
UNKNOWN = 1e-7
#: Odd factor of the polynomial hash of a piece's characters.
STEP = 0x9E3779B97F4A7C15
#: Steps of the forward pass between two looks at the scale; so many unknown characters stay within a double's range.
RESCALE = 16


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def train(labelled: DataFrame, model_path: str, docs_per_lang: int = 1000, smoothing: float = 0.05) -> dict:
    """Piece probabilities by language from columns ``text`` and ``lang``.

    The classifier is fitted on a bounded sample: about ``docs_per_lang`` texts of each language, chosen by a hash of the text.
    A text counts once, so copies of a chosen text don't swell the sample.
    What reaches the driver is at most one count for each language and piece.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {"langs": [], "pieces": {}}
    share = F.create_map(*(x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))))
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).distinct()

    def count(part: Iterator[tuple]) -> Iterator[tuple]:
        from sentencepiece import SentencePieceProcessor

        sp, seen = SentencePieceProcessor(model_file=model_path), {}
        for lang, text in part:
            seen.setdefault(lang, Counter()).update(sp.encode(text))
        for lang, counts in seen.items():
            for piece, n in counts.items():
                yield lang, piece, n

    counts = map_rows(sample, ["lang", "text"], count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_path)
    langs = sorted(sizes)
    place = {k: i for i, k in enumerate(langs)}
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    table = {i: [smoothing] * len(langs) for i in usable}
    for r in counts:
        if r["piece"] in table:
            table[r["piece"]][place[r["lang"]]] += r["n"]
    total = [sum(v[k] for v in table.values()) for k in range(len(langs))]
    return {"langs": langs, "pieces": {sp.id_to_piece(i): tuple(x / t for x, t in zip(v, total, strict=True)) for i, v in table.items()}}


class Forward:
    """Log probabilities of words in each language, all segmentations summed, for many words at a time."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        names = list(model["pieces"])
        self.p = np.array([model["pieces"][x] for x in names]).reshape(len(names), len(self.langs))
        self.longest = max(map(len, names), default=1)
        #: For each length, hashes of the pieces in order and their places.
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            own = [k for k, x in enumerate(names) if len(x) == n]
            h = self.hashes([names[k] for k in own])
            order = np.argsort(h)
            self.by_length.append((h[order], np.array(own, np.int64)[order]))
        self.known: dict[str, int] = {}
        self.chars = 0
        self.scores = np.zeros((CACHE_WORDS, len(self.langs)))

    @staticmethod
    def hashes(strings: list[str]) -> np.ndarray:
        h = np.zeros(len(strings), np.uint64)
        for k, s in enumerate(strings):
            x = 0
            for c in s:
                x = (x * STEP + ord(c)) & (2**64 - 1)
            h[k] = x
        return h

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Log of the summed probability of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size) - size
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        left = np.repeat(first + size, size) - np.arange(len(codes))
        piece = np.full((self.longest, len(codes)), -1, np.int32)  # by length and first character
        spans = np.zeros(len(codes) + 1, np.int64)  # how many pieces go over each boundary, as differences
        h = np.zeros(len(codes), np.uint64)
        at = np.arange(len(codes))
        for n in range(1, self.longest + 1):
            at = at[left[at] >= n]
            h[at] = h[at] * np.uint64(STEP) + codes[at + n - 1]
            known, place = self.by_length[n - 1]
            if len(known) and len(at):
                k = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
                hit = known[k] == h[at]
                piece[n - 1, at[hit]] = place[k[hit]]
                if n > 1:
                    spans += np.bincount(at[hit] + 1, minlength=len(spans)) - np.bincount(at[hit] + n, minlength=len(spans))
        limits = np.cumsum(spans)[:-1] == 0  # no piece goes over the boundary before this character
        limits[first] = True
        begin = np.flatnonzero(limits)
        length = np.diff(np.append(begin, len(codes)))
        logs = np.zeros((len(words), len(self.langs)))
        owner = np.searchsorted(first, begin, side="right") - 1
        order = np.argsort(-length, kind="stable")
        for low in range(0, len(order), 8192):
            some = order[low : low + 8192]
            np.add.at(logs, owner[some], self._forward(begin[some], length[some], piece))
        return logs

    def _forward(self, begin: np.ndarray, length: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Logs for stretches in descending order of length: each boundary's sum gathers those of the boundaries a piece before it."""
        kept = self.longest + 1
        sums = np.zeros((kept, len(begin), len(self.langs)))  # of the last boundaries, in a ring
        sums[0] = 1.0
        scale, out = np.zeros(sums.shape[1:]), np.zeros(sums.shape[1:])
        lengths = [n for n in range(2, self.longest + 1) if (piece[n - 1] >= 0).any()]
        n_rows = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), side="right")
        for j, rows in enumerate(n_rows.tolist(), 1):
            got = piece[0, begin[:rows] + j - 1]
            now = sums[(j - 1) % kept, :rows] * np.where(got[:, None] >= 0, self.p[got], UNKNOWN)
            for n in lengths:
                if n > j:
                    break
                got = piece[n - 1, begin[:rows] + j - n]
                hit = np.flatnonzero(got >= 0)
                if len(hit):
                    now[hit] += sums[(j - n) % kept, hit] * self.p[got[hit]]
            sums[j % kept, :rows] = now
            if j % RESCALE == 0:
                top = np.maximum(sums[:, :rows].max(0), 1e-300)
                sums[:, :rows] /= top
                scale[:rows] += np.log(top)
            ended = slice(n_rows[j] if j < len(n_rows) else 0, rows)
            out[ended] = np.log(np.maximum(sums[j % kept, ended], 1e-300)) + scale[ended]
        return out

    def learn(self, words: set[str]) -> None:
        """Score the words that are not known yet."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        chars = sum(map(len, new))
        if len(self.known) + len(new) > CACHE_WORDS or self.chars + chars > CACHE_CHARS:
            self.known, self.chars, new = {}, 0, list(words)
            chars = sum(map(len, new))
            if len(new) > len(self.scores):
                self.scores = np.zeros((len(new), len(self.langs)))
        new.sort(key=len)
        low = 0
        while low < len(new):
            high, size = low, 0
            while high < len(new) and (high == low or size + len(new[high]) < 50_000):
                size += len(new[high]) + 1
                high += 1
            base = len(self.known)
            self.scores[base : base + high - low] = self.word_logs([MARK + w for w in new[low:high]])
            self.known.update(zip(new[low:high], range(base, base + high - low), strict=True))
            low = high
        self.chars += chars

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [t.split() if t and self.langs and any(map(str.isalpha, t)) else [] for t in texts]
        self.learn({w for ws in split for w in ws})
        out = []
        for ws in split:
            if not ws:
                out.append(("und", 0.0))
                continue
            total = self.scores[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
        return out


def language(model: dict, text: Column) -> Column:
    """``lang_pred`` and ``score`` of a text, as one struct."""
    name = uuid.uuid4().hex

    def start() -> Callable[[list], list]:
        held = held_model(("languages", name), lambda: Forward(model))
        return lambda texts: [{"lang_pred": lang, "score": score} for lang, score in held.predict(texts)]

    return map_texts(text, start, "lang_pred string, score double")


def identify(docs: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """``columns`` of every row with ``lang_pred`` and ``score``, from column ``text`` alone."""
    found = free_name(docs, "found")
    rows = docs.withColumn(found, language(model, column("text").cast("string")))
    return rows.select(*(column(c) for c in columns if c.lower() not in ("lang_pred", "score")), f"{found}.lang_pred", f"{found}.score")
