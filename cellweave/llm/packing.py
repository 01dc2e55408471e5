"""Best-fit packing into fixed-length sequences by bin completion.

How pieces are packed depends only on how many there are of each length, and lengths are whole numbers
up to the sequence length: so the search runs on that histogram, which has the same bound at any size
of the corpus, and its plan is a table of fillings, each used so many times.  The pieces then find
their places by their number among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import gapless, materialize, small_table
from cellweave.llm.token_counts import byte_letters

#: Words whose ids a Python worker keeps; beyond that the older half goes.
WORDS_KEPT = 700_000
#: Words of these characters alone are split and lower-cased here as the library would; they need no
#: normalisation, and all of them beyond ASCII are letters.
PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: The pieces of the tokenizer, over those characters in lower case.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u017f]+|[0-9]|[^a-z0-9\u00c0-\u017f]+")
_ENCODERS: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of texts, word by word: no piece of this kind of tokenizer reaches over ASCII blanks, which it drops.

    A word new to the worker goes to the library's model by its pieces, whose ids are kept too; words
    with other characters, or with a special string in them, go through the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.ids: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            found = self.library.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))
            ids = self.pieces[piece] = array("I", [t.id for t in found]).tobytes()
        return ids

    def _learn(self, words: list[bytes]) -> None:
        other = []
        for word in words:
            text = word.decode("utf-8", "surrogatepass")
            if PLAIN.fullmatch(text) and not ("<|" in text and any(s in text for s in self.special)):
                self.ids[word] = b"".join([self._piece(x) for x in PIECES.findall(text.lower())])
            else:
                other.append((word, text))
        for at in range(0, len(other), 20_000):
            part = other[at:at + 20_000]
            got = self.library.encode_batch_fast([text for _, text in part], add_special_tokens=False)
            self.ids.update((word, array("I", e.ids).tobytes()) for (word, _), e in zip(part, got, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(self.ids) > WORDS_KEPT:
            self.ids = dict(islice(self.ids.items(), len(self.ids) // 2, None))
        if len(self.pieces) > WORDS_KEPT // 2:
            self.pieces = {}
        self._learn(list(set().union(*words).difference(self.ids)))
        find = self.ids.__getitem__
        return [b"".join(map(find, w)) for w in words]


def pieces(docs: DataFrame, vocabulary: str, length: int = 2048, doc_id: str = "doc_id", text: str = "text", room: int = 4_000_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an id 0, cut only if longer than ``length``.

    Null texts count as empty: one piece with the id 0 alone.  A task works on about ``room``
    characters at a time besides its Arrow batch.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, WordIds(vocabulary))
        for frame in frames:
            texts, group, begin = frame["text"].tolist(), np.cumsum(frame["text"].str.len().to_numpy(np.int64)) // room, 0
            out = {"at": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]:
                for i, ids in enumerate(coder.encode(texts[begin:end]), begin):
                    ids += b"\0\0\0\0"
                    for n, s in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[s:s + 4 * length]
                        out["at"].append(i)
                        out["piece"].append(n)
                        out["start"].append(s // 4)
                        out["length"].append(len(part) // 4)
                        out["ids_crc32"].append(zlib.crc32(part))
                begin = end
            found = pd.DataFrame(out)
            found.insert(0, "doc_id", frame["doc_id"].take(found.pop("at").to_numpy(np.int64)).array)
            yield found

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the plan
def _fillings(counts: np.ndarray, largest: int, room: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` beside ``largest``, best fit first.

    Depth first over lengths in falling order and how often each is taken, most often first: the first
    filling found is the best-fit one, and no branch is deeper than there are different lengths in a
    bin.  Later fillings must waste less (the waste bound), and one without waste ends the search.  When
    the budget ends no new branch is begun, but the one at hand is completed with best fits.
    """
    lengths = np.flatnonzero(counts)
    used: dict[int, int] = {}
    best, found = room + 1, []

    def unbeaten(waste: int) -> bool:
        # dominated: a length that is left still fits, or some chosen length could give way to a larger one that does
        for x in (0, *used):
            above = lengths[np.searchsorted(lengths, x, side="right"):np.searchsorted(lengths, x + waste, side="right")]
            if any(counts[y] > used.get(int(y), 0) for y in above):
                return False
        return True

    def deeper(top: int, left: int) -> bool:
        nonlocal best
        budget[0] -= 1
        fits = False
        for i in range(min(top, int(np.searchsorted(lengths, left, side="right"))) - 1, -1, -1):
            x = int(lengths[i])
            for times in range(min(int(counts[x]), left // x), 0, -1):
                if fits and budget[0] <= 0:
                    return False
                fits = True
                used[x] = times
                done = deeper(i, left - x * times)
                del used[x]
                if done:
                    return True
        if not fits and left < best and unbeaten(left):
            best = left
            found.append(tuple(x for x, times in used.items() for _ in range(times)))
        return best == 0

    deeper(len(lengths), room)
    yield from reversed(found)


def plan(histogram: dict[int, int], length: int, nodes: int = 200_000, each: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths in falling order) and how often each is used, for counts by length.

    Bin completion: the largest length that is left is completed by an undominated filling, which is
    used as long as the counts allow.  Where a branch already wastes more than the best plan can afford
    it is cut, and the next filling is tried; the first plan, all best fits, is the incumbent.  The
    search ends when the incumbent reaches the lower bound, or after ``nodes`` steps (``each`` for the
    fillings of one bin): a bound on the search, not on the pieces, all of which are placed.
    """
    total = sum(k * n for k, n in histogram.items())
    least = -(-total // length)
    start = np.zeros(length + 1, np.int64)
    for k, n in histogram.items():
        start[k] = n
    best: list[tuple[tuple[int, ...], int]] = []
    fewest, steps = None, nodes
    stack = [(start, (), 0)]
    while stack:
        counts, made, bins = stack.pop()
        while (left := np.flatnonzero(counts)).size:
            waste = bins * length - (total - int((counts[left] * left).sum()))
            if fewest is not None and total + waste > (fewest - 1) * length:
                break
            top = int(left[-1])
            counts = counts.copy()
            counts[top] -= 1
            budget = [each]
            options = list(_fillings(counts, top, length - top, budget))
            steps -= each - budget[0] + 1
            counts[top] += 1
            if fewest is None or steps > 0:
                for other in reversed(options[1:2]):
                    stack.append(_use(counts, (top, *other), made, bins))
            counts, made, bins = _use(counts, (top, *options[0]), made, bins)
        else:
            if fewest is None or bins < fewest:
                fewest, out = bins, []
                while made:
                    made, filling, times = made
                    out.append((filling, times))
                best = out[::-1]
        if fewest == least or steps <= 0:
            break
    return best


def _use(counts: np.ndarray, filling: tuple[int, ...], made: tuple, bins: int) -> tuple[np.ndarray, tuple, int]:
    need = np.bincount(filling, minlength=len(counts))
    times = int((counts[need > 0] // need[need > 0]).min())
    return counts - need * times, (made, filling, times), bins + times


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    Sequences hold at most ``length`` ids and are gapless from 0.  Repeated rows are documents of their
    own.  An empty table gives an empty result; columns other than the two named ones are ignored.  The
    driver sees the histogram of lengths, at most ``length`` rows; the plan has at most one filling
    for each length that it uses up, and is joined by length.
    """
    rows = materialize(pieces(docs, vocabulary, length, doc_id, text).withColumn("at", F.concat_ws(":", "doc_id", "piece")))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, base, slots = dict.fromkeys(histogram, 0), 0, []
    for filling, times in plan(histogram, length):
        offset = 0
        for k in dict.fromkeys(filling):
            c = filling.count(k)
            slots.append((k, taken[k], taken[k] + c * times, c, base, offset))
            taken[k] += c * times
            offset += c * k
        base += times
    places = small_table(docs.sparkSession, slots, "of_length long, low long, high long, each long, base long, at_offset long")
    places = F.broadcast(places)  # at most a few rows for each of the ``length`` lengths
    ranked = materialize(gapless(rows, ["length"], "at", "rank"))
    placed = ranked.join(places, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
                         (F.col("at_offset") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))
