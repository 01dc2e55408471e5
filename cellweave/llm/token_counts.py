"""Token counts by a compiled finite-state transducer.

Byte-pair tokens of a text are decided piece by piece (letters, digits, marks, blanks), and within a
piece from left to right: the last token of every prefix is the one token that ends there and is a
valid neighbour of the last token of what stands before it.  So a state needs only the piece's end
that can still grow into a token, with the last token and the relative count at each place in it, and
each transition is annotated with the change of the number of tokens.  States are compiled when they
are first met and shared by all later texts.

Texts run as chunks, all in step with numpy.  A chunk begins at a blank that follows a non-blank: a
piece always ends there, so the chunk's state map is constant, the same end state and count whatever
came before.  Composing such maps is a prefix sum of their counts.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LETTER, NUMBER, MARK, BLANK = range(4)
#: What a piece is so far; FRESH: none yet; TICK: an apostrophe that may begin a contraction; TICK_R,
#: TICK_V, TICK_L: with one more letter; CLOSED: a whole contraction; BLANKS: blanks, the last held back.
FRESH, LETTERS, NUMBERS, MARKS, BLANKS, TICK, TICK_R, TICK_V, TICK_L, CLOSED = range(10)
#: Packed transitions: next state over 8 bits of the change of the count, plus this bias.
BIAS, EMPTY = 128, -1
#: In place of a last token: where the piece begins; where no token can begin any more.
START, DEAD = -1, -2


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable Latin-1, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transducer:
    """Counts tokens as the tokenizer file at ``path`` does; grows to ``max_states`` states, then starts anew.

    Transitions lie in a hash table with linear probing, keyed by state and character.
    """

    def __init__(self, path: str, max_states: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        config = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in config["added_tokens"]]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.letters = [letters[b] for b in range(256)]
        self.tokens = {bytes(back[c] for c in t): i for t, i in config["model"]["vocab"].items() if t not in self.special}
        self.spelled = {i: t for t, i in self.tokens.items()}
        self.growing = {t[:n] for t in self.tokens for n in range(len(t))}  # what a longer token begins with
        self.classes = np.full(0x110000, 255, np.uint8)
        self.max_states = max_states
        self._clear()

    def _clear(self) -> None:
        self.neighbours: dict[int, bool] = {}
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.ends: list[int] = []
        self.cells = np.full(1 << 16, EMPTY, np.int64)
        self.found = np.zeros(1 << 16, np.int32)
        self.filled = 0
        self.piece_known: dict[bytes, int] = {}
        self.pieces: list[bytes] = []
        self._piece(b"", [START], [0])
        self._state((FRESH, 0, ""))

    # -- inside a piece: the end that can still grow, the last token at each place of it, the counts relative to the last
    def _piece(self, end: bytes, lasts: list[int], counts: list[int]) -> int:
        key = bytes((len(end),)) + end + array("i", [*lasts, *counts]).tobytes()
        if (i := self.piece_known.get(key)) is None:
            i = self.piece_known[key] = len(self.pieces)
            self.pieces.append(key)
        return i

    def _valid(self, a: int, b: int) -> bool:
        if (ok := self.neighbours.get(a << 32 | b)) is None:
            got = self.library.model.tokenize("".join([self.letters[x] for x in self.spelled[a] + self.spelled[b]]))
            ok = self.neighbours[a << 32 | b] = len(got) == 2 and got[0].id == a
        return ok

    def _byte(self, piece: int, byte: int) -> tuple[int, int]:
        key = self.pieces[piece]
        n = key[0]
        end, places = key[1:n + 1], array("i", key[n + 1:]).tolist()
        lasts, counts = places[:n + 1], places[n + 1:]
        grown = end + bytes((byte,))
        for at in range(len(grown)):
            token = self.tokens.get(grown[at:])
            if token is not None and lasts[at] != DEAD and (lasts[at] == START or self._valid(lasts[at], token)):
                break
        else:
            raise ValueError("no token ends here: the vocabulary lacks a byte")
        change = counts[at] + 1
        lasts.append(token)
        counts.append(change)
        live = [grown[i:] in self.growing for i in range(len(lasts))]  # the empty end always is
        cut = live.index(True)
        lasts = [x if ok else DEAD for x, ok in zip(lasts[cut:], live[cut:], strict=True)]
        counts = [c - change if ok else 0 for c, ok in zip(counts[cut:], live[cut:], strict=True)]
        return self._piece(grown[cut:], lasts, counts), change

    def _append(self, piece: int, text: str) -> tuple[int, int]:
        total = 0
        for byte in text.encode("utf-8", "surrogatepass"):
            piece, change = self._byte(piece, byte)
            total += change
        return piece, total

    # -- across pieces: (kind, piece, blank held back)
    def _state(self, key: tuple) -> int:
        if (i := self.known.get(key)) is None:
            i = self.known[key] = len(self.states)
            self.states.append(key)
            self.ends.append(self._append(key[1], key[2])[1] if key[0] == BLANKS else 0)
        return i

    def _begin(self, char: str, kind: int, lead: str = "") -> tuple[tuple, int]:
        if kind == BLANK:
            return (BLANKS, 0, char), 0
        piece, n = self._append(0, lead + char)
        return (TICK if char == "'" and not lead else (LETTERS, NUMBERS, MARKS)[kind], piece, ""), n

    def _next(self, state: tuple, char: str, kind: int) -> tuple[tuple, int]:
        mode, piece, held = state
        if mode == BLANKS:
            if kind == BLANK:
                piece, n = self._append(piece, held)
                return (BLANKS, piece, char), n
            if held == " ":
                return self._begin(char, kind, held)
            after, n = self._begin(char, kind)
            return after, n + self._append(0, held)[1]
        if mode == TICK and kind == LETTER:
            if char in "stmd":
                after, n = self._append(piece, char)
                return (CLOSED, 0, ""), n
            after, n = self._begin(char, kind)
            return ({"r": TICK_R, "v": TICK_V, "l": TICK_L}.get(char, LETTERS), after[1], ""), n
        if mode in (TICK_R, TICK_V, TICK_L) and kind == LETTER:
            first = {TICK_R: "r", TICK_V: "v", TICK_L: "l"}[mode]
            if char == ("l" if first == "l" else "e"):
                return (CLOSED, 0, ""), self._append(0, "'" + first + char)[1] - self._append(0, "'")[1] - self._append(0, first)[1]
        same = {LETTERS: LETTER, TICK_R: LETTER, TICK_V: LETTER, TICK_L: LETTER, NUMBERS: NUMBER, MARKS: MARK, TICK: MARK}.get(mode)
        if same == kind:
            piece, n = self._append(piece, char)
            return ((LETTERS, NUMBERS, MARKS)[kind], piece, ""), n
        return self._begin(char, kind)

    def _classify(self, codes: np.ndarray) -> None:
        """Ask the library's own splitter which kind each new character is."""
        for code in codes.tolist():
            char = chr(code)
            joins = lambda a: len(self.library.pre_tokenizer.pre_tokenize_str(a + char)) == 1  # noqa: E731, B023
            self.classes[code] = LETTER if joins("a") else NUMBER if joins("1") else MARK if joins("!") else BLANK

    def _slots(self, cells: np.ndarray) -> np.ndarray:
        """Where each cell lies in the table, or the empty slot where its search ends."""
        size = len(self.cells)
        slots = (cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).astype(np.int64)
        there = self.cells[slots]
        off = np.flatnonzero((there != cells) & (there != EMPTY))
        while len(off):
            slots[off] = (slots[off] + 1) & (size - 1)
            there = self.cells[slots[off]]
            off = off[(there != cells[off]) & (there != EMPTY)]
        return slots

    def _insert(self, cells: np.ndarray, values: np.ndarray) -> None:
        while len(cells):
            slots = self._slots(cells)
            _, first = np.unique(slots, return_index=True)  # one for each empty slot; the others look again
            self.cells[slots[first]], self.found[slots[first]] = cells[first], values[first]
            rest = np.ones(len(cells), bool)
            rest[first] = False
            cells, values = cells[rest], values[rest]

    def _compile(self, cells: np.ndarray) -> None:
        cells = np.unique(cells)
        values = []
        for cell in cells.tolist():
            code = cell & 0x1FFFFF
            after, change = self._next(self.states[cell >> 21], chr(code), int(self.classes[code]))
            if not -BIAS <= change < BIAS:
                raise ValueError("a transition changes the count by more than the table holds")
            values.append(self._state(after) << 8 | change + BIAS)
        self.filled += len(cells)
        if 2 * self.filled > len(self.cells):
            there = self.cells != EMPTY
            old, found, size = self.cells[there], self.found[there], len(self.cells)
            while 2 * self.filled > size:
                size *= 2
            self.cells, self.found = np.full(size, EMPTY, np.int64), np.zeros(size, np.int32)
            self._insert(old, found)
        self._insert(cells, np.array(values, np.int32))

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each chunk ``codes[start:end]``, all begun in the first state."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        at, length = starts[order], length[order]
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for j, n in enumerate(active.tolist()):
            cells = state[:n] << 21 | codes[at[:n] + j]
            slots = self._slots(cells)
            if (new := self.cells[slots] == EMPTY).any():
                self._compile(cells[new])
                slots = self._slots(cells)
            got = self.found[slots]
            total[:n] += (got & 255) - BIAS
            state[:n] = got >> 8
        total += np.asarray(self.ends, np.int64)[state]
        out = np.empty_like(total)
        out[order] = total
        return out

    def count(self, texts: list[str], chunk: int = 256, room: int = 2_000_000) -> np.ndarray:
        """Tokens of each text; about ``room`` characters are in work at once (at least one text)."""
        out = np.zeros(len(texts), np.int64)
        begin = 0
        while begin < len(texts):
            size, end = 0, begin
            while end < len(texts) and (end == begin or size + len(texts[end]) <= room):
                size += len(texts[end])
                end += 1
            self._count_into(out, texts[begin:end], begin, chunk)
            begin = end
        return out

    def _count_into(self, out: np.ndarray, texts: list[str], begin: int, chunk: int) -> None:
        parts, owner = [], []
        for i, text in enumerate(texts, begin):
            if any(s in text for s in self.special):
                out[i] += sum(text.count(s) for s in self.special)
                for s in self.special[1:]:
                    text = text.replace(s, self.special[0])
                own = [p for p in text.split(self.special[0]) if p]
            else:
                own = [text] if text else []
            parts += own
            owner += [i] * len(own)
        if not parts:
            return
        if len(self.states) > self.max_states:
            self._clear()
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        kinds = self.classes[codes]
        if (new := kinds == 255).any():
            self._classify(np.unique(codes[new]))
            kinds = self.classes[codes]
        firsts = np.cumsum(lengths) - lengths
        blank = kinds == BLANK
        sure = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        cuts = sure[np.minimum(np.searchsorted(sure, np.arange(chunk, len(codes), chunk)), len(sure) - 1)] if len(sure) else sure
        starts = np.unique(np.concatenate([firsts, cuts]))
        tokens = self.run(codes, starts, np.append(starts[1:], len(codes)))
        which = np.searchsorted(firsts, starts, side="right") - 1
        np.add.at(out, np.asarray(owner)[which], tokens)


_COMPILED: dict[str, Transducer] = {}


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE tokenizer file that every executor can read.  Null
    texts count as empty: 0 bytes, 0 tokens.  Special strings inside a text are one token each, as is
    the library's default.  No shuffle; a task holds about 2 million characters at a time besides its
    Arrow batch, and a transducer of bounded size.  Repeated rows and null ids are kept as they are,
    other columns are ignored.
    """
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _COMPILED.get(vocabulary) or _COMPILED.setdefault(vocabulary, Transducer(vocabulary))
        for frame in frames:
            frame["n_tokens"] = machine.count(frame.pop("text").tolist())
            yield frame

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInPandas(batches, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
