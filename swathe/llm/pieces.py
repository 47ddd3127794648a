"""SentencePiece encoding and decoding with a streaming Viterbi pass.

The public vocabulary here is a byte-fallback BPE model, whose scores are merge ranks, so the best path is not the one with
the largest sum: it is the one in which every two neighbouring pieces are what merging their joint text gives.  A prefix of
a text has exactly one such path, so the pass keeps one backpointer a boundary, like any Viterbi pass, and its result is the
id sequence of the model's own merges.  Only boundaries within the longest piece of the front can still be extended; once
the backpointer paths of all of them meet in one boundary, the ids before it are final, are handed out and are forgotten.

No piece holds a word mark after another character, nor a letter beside anything but letters and marks before them, so all
paths meet there (the constructor checks it); the ids of such a stretch are kept for its next occurrence (a bounded memory).

Defined cases: a null or empty text has no ids; repeated rows give repeated rows; a very long text is read in parts that end
where all paths meet, a very long stretch character by character, so beside the text and its ids only a window is held; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import held_model, id_and_text, map_rows

MARK = "▁"
#: Stretches that a worker keeps, and their characters; it forgets all when there are more.
CACHE_STRETCHES, CACHE_CHARS = 600_000, 12_000_000
CACHE_PAIRS = 500_000
#: A text is read in parts of so many characters and up to the next place in which all paths meet.
PART_CHARS = 1 << 16
#: Numbers that are no digits, which a regular expression counts among the letters, as far as pieces hold them.
NUMERIC = "²³¹"
LETTER, OTHER = rf"[^\W\d_{NUMERIC}]", rf"[\W\d_{NUMERIC}]"
#: A stretch of letters or of other characters, with the word marks before it; texts are read stretch by stretch.
CUT = re.compile(f"[^{MARK}]{MARK}")
STRETCH = re.compile(rf"\n|{MARK}*{LETTER}+|{MARK}*(?:(?![{MARK}\n]){OTHER})+|{MARK}+")


class PieceCodec:
    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.raw: list[bytes | None] = []
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(None)
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                self.ids[piece], self.rank[piece] = i, -sp.get_score(i)
        self.longest = max(map(len, self.ids))
        if any(STRETCH.findall(p) != [p] for p in self.ids):
            raise ValueError("the vocabulary has a piece that spans two stretches")
        #: What ends a piece, and whether it is one.
        self.suffixes = {x: x in self.ids for p in self.ids for k in range(len(p)) if (x := p[k:])}
        self.nested: dict[str, dict[str, bool]] = {}
        self.halves: dict[str, tuple] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.wholes: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_chars = 0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-ranked neighbours, the leftmost of equals first."""
        parts = list(text)
        while self.merge_once(parts):
            pass
        return parts

    def merge_once(self, parts: list[str]) -> bool:
        best = min(((self.rank[c], k) for k in range(len(parts) - 1) if (c := parts[k] + parts[k + 1]) in self.rank), default=None)
        if best is not None:
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return best is not None

    def spine(self, piece: str, right: bool) -> list[tuple[str, float, float]]:
        """The parts at one end of a piece as it is merged: (part, rank at which it is there, rank at which it is used up)."""
        if (got := self.spines[right].get(piece)) is None:
            got, used = [], float("inf")
            while True:
                there = self.rank[piece] if len(piece) > 1 else -1.0
                got.append((piece, there, used))
                if len(piece) == 1:
                    break
                if (two := self.halves.get(piece)) is None:
                    parts = list(piece)
                    while len(parts) > 2:
                        self.merge_once(parts)
                    two = self.halves[piece] = tuple(parts)
                piece, used = two[right], there
            self.spines[right][got[0][0]] = got
        return got

    def follows(self, left: str, right: str) -> bool:
        """Whether merging the joint text of two pieces gives those two pieces.

        It does unless some part at the end of ``left`` and some part at the start of ``right`` are there together and merge.
        Runs of word marks have pieces of equal rank; those are merged outright.
        """
        if (got := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            if not left or MARK * 2 in left or MARK in right or not (self.whole(left) and self.whole(right)):
                got = self.merged(left + right) == ([left, right] if left else [right])
            else:
                rank, got = self.rank, True
                for a, a_there, a_used in self.spine(left, True):
                    for b, b_there, b_used in self.spine(right, False):
                        r = rank.get(a + b)
                        if r is not None and a_there < r < a_used and b_there < r <= b_used:
                            got = False
            self.pairs[left, right] = got
        return got

    def whole(self, piece: str) -> bool:
        """Whether merging the characters of a piece gives the piece."""
        if len(piece) == 1:
            return True
        if (got := self.wholes.get(piece)) is None:
            got = self.wholes[piece] = self.merged(piece) == [piece]
        return got

    def stream(self, chars: Iterable[str]) -> Iterator[str]:
        """Pieces of the characters, each as soon as it is final.

        ``back`` has the last piece of the path to every boundary from the last committed one on, ``window`` the characters of
        the longest piece before the front.
        """
        suffixes, pairs, keep = self.suffixes, self.nested, self.longest
        back: dict[int, str] = {0: ""}
        window, done, front, until = "", 0, 0, 2 * keep
        for piece in chars:
            window = window[1 - keep :] + piece
            front += 1
            at = size = len(window)
            at -= 1
            least = max(0, size - (front - done))
            ends = [piece]
            while at > least:
                at -= 1
                if (kind := suffixes.get(longer := window[at:])) is None:
                    break
                if kind:
                    ends.append(longer)
            while ends:
                piece = ends.pop()
                left = back[front - len(piece)]
                if (known := pairs.get(left)) is None:
                    known = pairs[left] = {}
                if (ok := known.get(piece)) is None:
                    ok = known[piece] = self.follows(left, piece)
                if ok:
                    break
            else:
                raise AssertionError("a prefix has no path")
            back[front] = piece
            if front >= until:
                if (at := self._meeting(back, done, front)) > done:
                    yield from self._path(back, done, at)
                    for k in range(done, at):
                        del back[k]
                    done = at
                until = front + keep
        yield from self._path(back, done, front)

    def _meeting(self, back: dict[int, str], done: int, front: int) -> int:
        """The boundary in which the paths from all boundaries that can still be extended meet."""
        ends = set(range(max(done, front - self.longest + 1), front + 1))
        while len(ends) > 1:
            last = max(ends)
            ends.discard(last)
            ends.add(last - len(back[last]) if last > done else done)
        return max(ends.pop(), done)

    @staticmethod
    def _path(back: dict[int, str], done: int, at: int) -> list[str]:
        out = []
        while at > done:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1]

    def stretch(self, text: str) -> bytes:
        if len(self.pairs) >= CACHE_PAIRS:
            self.nested.clear()
        out = array.array("i")
        for piece in self.stream(text):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            else:
                out.extend([self.byte_id[b] for b in piece.encode()])
        got = out.tobytes()
        if len(self.known) >= CACHE_STRETCHES or self.known_chars >= CACHE_CHARS:
            self.known.clear()
            self.known_chars = 0
        self.known[text] = got
        self.known_chars += len(text)
        return got

    def encode(self, text: str | None) -> np.ndarray:
        """32-bit ids of a whole text."""
        known, stretch, ids, at = self.known, self.stretch, bytearray(), 0
        marked = MARK + text.replace(" ", MARK) if text else ""
        while at < len(marked):
            cut = CUT.search(marked, at + PART_CHARS)
            end = cut.end() - 1 if cut else len(marked)
            ids += b"".join([known.get(x) or stretch(x) for x in STRETCH.findall(marked, at, end)])
            at = end
        return np.frombuffer(ids, np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; control ids have none and bytes that are no UTF-8 become the replacement character."""
        text = b"".join([self.raw[i] or b"" for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def codec_of(model_path: str) -> PieceCodec:
    return held_model(("pieces", model_path), lambda: PieceCodec(model_path))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id`` and the ``ids`` of every whole text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        codec = codec_of(model_path)
        for doc_id, text in rows:
            yield doc_id, codec.encode(text)

    return map_rows(id_and_text(docs), ["doc_id", "text"], run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id`` and the ``text`` of every row of ids."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        codec = codec_of(model_path)
        for doc_id, ids in rows:
            yield doc_id, codec.decode(ids or [])

    return map_rows(encoded, ["doc_id", "ids"], run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids of every whole text and whether decoding them gives the text back."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        codec = codec_of(model_path)
        for doc_id, text in rows:
            ids = codec.encode(text)
            # a word mark that stands in the text itself decodes to a space
            yield doc_id, len(ids), ids, codec.decode(ids.tolist()) == text.replace(MARK, " ")

    return map_rows(id_and_text(docs), ["doc_id", "text"], run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")
