"""Repair of conversation structure: cheapest edits by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, what the repaired turns end with); edges keep, rerole or delete the
next row or insert an empty turn.  A forward heap from the beginning and a reverse heap from the ends
meet in the middle; all crossings of the least cost are finished, and of the edit strings that they join
the least one is taken.

Two edit strings that reach a node at one cost never are each other's beginning (what follows would be
insertions, which cost), so the least string to a node stays the least whatever follows, and parts of a
long conversation can be solved by themselves and joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize

#: What the repaired turns end with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
INFINITE = float("inf")


def _after(state: int, initial: str) -> int | None:
    """The state after a turn with this initial, None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _next_role(state: int) -> str:
    return "assistant" if state == USER else "user"


def _forward(rows: Sequence[tuple[str, int]], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges out of a node: (rows read, state, cost, edit)."""
    following = _after(state, _next_role(state)[0])
    yield i, following, INSERT, "I"
    if i < len(rows):
        initial, fault = rows[i]
        yield i + 1, state, DELETE, "D"
        if fault not in (BLANK, DUPLICATE):
            cut = CUT if fault == TRUNCATED else 0
            yield i + 1, following, REROLE + cut, "R"
            if (kept := _after(state, initial)) is not None:
                yield i + 1, kept, cut, "K"


def _reverse(rows: Sequence[tuple[str, int]], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges into a node: (rows read, state, cost, edit)."""
    befores = {NOTHING: (), SYSTEM: (), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}[state]
    for before in befores:
        yield i, before, INSERT, "I"
    if i > 0:
        initial, fault = rows[i - 1]
        yield i - 1, state, DELETE, "D"
        if fault not in (BLANK, DUPLICATE):
            cut = CUT if fault == TRUNCATED else 0
            for before in befores:
                yield i - 1, before, REROLE + cut, "R"
            for before in range(4):
                if _after(before, initial) == state:
                    yield i - 1, before, cut, "K"


class _Side:
    """One heap with its labels; nodes are settled by cost, and at one cost in the direction of travel."""

    def __init__(self, rows: Sequence[tuple[str, int]], nodes: list[tuple[int, int]], reverse: bool):
        self.rows, self.reverse = rows, reverse
        self.label = {node: (0, "") for node in nodes}
        self.settled: set[tuple[int, int]] = set()
        self.heap: list[tuple] = []
        for node in nodes:
            heappush(self.heap, (0, -node[0] if reverse else node[0], node))

    def top(self) -> float:
        while self.heap and self.heap[0][2] in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else INFINITE

    def settle(self) -> list[tuple[int, int]]:
        """Settle the top node and return the nodes whose labels it made better."""
        cost, _, node = heappop(self.heap)
        self.settled.add(node)
        edits = self.label[node][1]
        better = [node]
        for i, state, more, edit in (_reverse if self.reverse else _forward)(self.rows, *node):
            new = (cost + more, edit + edits if self.reverse else edits + edit)
            old = self.label.get((i, state))
            if old is None or new < old:
                self.label[i, state] = new
                if old is None or new[0] < old[0]:
                    heappush(self.heap, (new[0], -i if self.reverse else i, (i, state)))
                better.append((i, state))
        return better


def cheapest(rows: Sequence[tuple[str, int]], start: int = NOTHING, ends: Sequence[int] = ENDS) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest repair of rows (role initial, fault); of equal costs the least string.

    ``start`` is what stands before the rows, ``ends`` what may stand after them; None if no edits do it.
    """
    n = len(rows)
    forth = _Side(rows, [(0, start)], reverse=False)
    back = _Side(rows, [(n, end) for end in ends], reverse=True)
    least = INFINITE
    while (a := forth.top()) + (b := back.top()) <= least and min(a, b) < INFINITE:
        side, other = (forth, back) if a <= b else (back, forth)
        for node in side.settle():
            if node in other.label:
                least = min(least, side.label[node][0] + other.label[node][0])
    if least == INFINITE:
        return None
    # every cheapest path leaves what the forward heap settled over an edge into what the reverse heap settled
    found = []
    for node in forth.settled:
        cost, edits = forth.label[node]
        if node[0] == n and node[1] in ends and cost == least:
            found.append(edits)
        for i, state, more, edit in _forward(rows, *node):
            if (i, state) in back.settled and cost + more + back.label[i, state][0] == least:
                found.append(edits + edit + back.label[i, state][1])
    return int(least), min(found)


def edited(rows: Sequence[tuple[str, str]], edits: str, state: int = NOTHING) -> Iterator[tuple[str, str | None, str | None, int]]:
    """(edit, role, text, number of the row or -1) of each edit; deleted rows keep what they hold."""
    at = 0
    for edit in edits:
        if edit == "I":
            role = _next_role(state)
            yield edit, role, "", -1
        else:
            role, text = rows[at]
            if edit == "R":
                role = _next_role(state)
            yield edit, role, text, at
            at += 1
        if edit != "D":
            state = _after(state, role[:1])


# ---------------------------------------------------------------- on tables
def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by crc32(conv_id:turn) % 20; nulls read as one space.

    0 drops a row, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it the user's.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(name(conv_id), F.lit(":"), name(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), name(role).alias("role"), name(text).alias("text"), how.alias("_how")).filter("_how <> 0")
    changed = F.when(F.col("_how") == 1, F.lit("")).when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_how") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"), twice.alias("_again")).drop("_again")


def _key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _text_fault(text: str) -> int:
    rest = text.rstrip(BLANKS)
    return BLANK if not rest else FINE if rest[-1] in ".!?" else TRUNCATED


def _runs(frames: Iterator[pd.DataFrame], key: str = "_key") -> Iterator[tuple[str, pd.DataFrame]]:
    """Whole groups of rows that are sorted by ``key``; holds one group at a time."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        keys = frame[key].to_numpy()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[0][key].iloc[0] != keys[a]:
                yield held[0][key].iloc[0], pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(frame.iloc[a:b])
    if held:
        yield held[0][key].iloc[0], pd.concat(held) if len(held) > 1 else held[0]


EDITS = "_key string, place long, edit string, role string, text string, fault int, illegal boolean"


def _edit_rows(key: str, roles: list[str], texts: list[str], faults: list[int], edits: str, state: int = NOTHING, place: int = 0, before: str | None = None) -> pd.DataFrame:
    out = []
    for edit, role, text, at in edited(list(zip(roles, texts)), edits, state):
        clash = False
        if at >= 0:
            last = roles[at - 1][:1] if at else before
            clash = last is not None and last + roles[at][:1] not in ("su", "ua", "au")
        out.append((key, place + len(out), edit, role, text, faults[at] if at >= 0 else FINE, clash))
    return pd.DataFrame(out, columns=["_key", "place", "edit", "role", "text", "fault", "illegal"])


def _repair_short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edits of conversations that fit into one segment, a few thousand rows at a time."""
    ready, size = [], 0
    for key, rows in _runs(frames):
        roles, texts, seen, faults = rows["role"].tolist(), rows["text"].tolist(), set(), []
        for both in zip(roles, texts):
            fault = _text_fault(both[1])
            faults.append(DUPLICATE if fault != BLANK and both in seen else fault)
            seen.add(both)
        _, edits = cheapest([(r[:1], f) for r, f in zip(roles, faults)])
        ready.append(_edit_rows(key, roles, texts, faults, edits))
        size += len(edits)
        if size >= 4096:
            yield pd.concat(ready)
            ready, size = [], 0
    if ready:
        yield pd.concat(ready)


def _faults(rows: pd.DataFrame) -> list[int]:
    return [f if f == BLANK or first else DUPLICATE for f, first in zip(map(_text_fault, rows["text"]), rows["_first"])]


def _solve_segment(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: the cheapest edits from each state before the segment to each state after it."""
    rows = rows.sort_values("_pos")
    turns = [(r[:1], f) for r, f in zip(rows["role"], _faults(rows))]
    paths = [(s, t, *got) for s in range(4) for t in range(4) if (got := cheapest(turns, s, (t,)))]
    at = {c: [p[i] for p in paths] for i, c in enumerate(("starts", "ends", "costs", "edits"))}
    return pd.DataFrame([{"_key": rows["_key"].iloc[0], "_seg": rows["_seg"].iloc[0], **at, "last": turns[-1][0]}])


def _choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The path through all segments of each conversation, joined from left to right; strings are not copied."""
    def strings(path):
        out = []
        while path:
            out.append(path[1])
            path = path[0]
        return out[::-1]

    for key, rows in _runs(frames):
        best = {NOTHING: (0, None)}
        for r in rows.itertuples():
            step: dict[int, tuple] = {}
            for s, t, cost, edits in zip(r.starts, r.ends, r.costs, r.edits):
                if s in best:
                    total, path = best[s][0] + cost, (best[s][1], edits, s)
                    old = step.get(t)
                    if old is None or total < old[0] or total == old[0] and "".join(strings(path)) < "".join(strings(old[1])):
                        step[t] = (total, path)
            best = step
        cost = min(best[t][0] for t in ENDS if t in best)
        path = min((best[t][1] for t in ENDS if t in best and best[t][0] == cost), key=lambda p: "".join(strings(p)))
        chosen = []
        while path:
            chosen.append((path[1], path[2]))
            path = path[0]
        out, place, before = [], 0, None
        for seg, last, (edits, start) in zip(rows["_seg"], rows["last"], chosen[::-1], strict=True):
            out.append((key, seg, edits, start, place, before))
            place, before = place + len(edits), last
        yield pd.DataFrame(out, columns=["_key", "_seg", "edits", "start", "place", "before"])


def _edit_segment(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    rows, path = rows.sort_values("_pos"), chosen.iloc[0]
    return _edit_rows(path["_key"], rows["role"].tolist(), rows["text"].tolist(), _faults(rows), path["edits"], int(path["start"]), int(path["place"]), path["before"])


def _repair_long(rows: DataFrame, segment: int) -> DataFrame:
    order = ["_key", F.asc_nulls_first("turn"), "role", "text"]
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()))
    inside = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    firsts = placed.groupBy("_key", "role", F.md5(F.col("text").cast("binary")).alias("_md5")).agg(F.min("_pos").alias("_at"))
    # joined by place, which is unique: a text repeated a billion times is no hot key
    marked = placed.join(firsts.select("_at"), F.col("_pos") == F.col("_at"), "left")
    parts = materialize(marked.select("_key", "_pos", "role", "text", F.col("_at").isNotNull().alias("_first"), (F.col("_pos") - inside % segment).alias("_seg")))
    solved = parts.groupBy("_key", "_seg").applyInPandas(_solve_segment, "_key string, _seg long, starts array<int>, ends array<int>, costs array<long>, edits array<string>, last string")
    chosen = solved.repartition("_key").sortWithinPartitions("_key", "_seg").mapInPandas(_choose, "_key string, _seg long, edits string, start int, place long, before string")
    return parts.groupBy("_key", "_seg").cogroup(chosen.groupBy("_key", "_seg")).applyInPandas(_edit_segment, EDITS)


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = 2048) -> DataFrame:
    """(conv_id, place, edit, role, text, fault, illegal): all edits of each conversation, in their order.

    Rows are read by turn (nulls first), then role and text; null roles and texts read as one space, and
    null ids are one conversation.  ``edit`` is K, R, D or I; rows that are not deleted are the repaired
    conversation.  ``fault`` is the first of blank (1), duplicate (2) and truncated (3) of an own row,
    ``illegal`` marks an own row whose role cannot follow the row before.  Columns beyond the four named
    ones are ignored; an empty table gives an empty result.

    Conversations of at most ``segment`` rows are solved whole.  Longer ones are dealt out by ranges of
    their order and solved in segments, from every state to every state; one task then joins the
    segments' strings, and holds nothing else of the conversation.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(_key(F.col(conv_id)).alias("_key"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"))
    long = materialize(rows.groupBy("_key").count().filter(F.col("count") > segment).select("_key"))
    n_long = long.count()
    short = rows
    if n_long:
        named = F.broadcast(long) if n_long <= 100_000 else long  # one row for each long conversation
        short = rows.join(named, "_key", "left_anti")
    sorted_rows = short.repartition("_key").sortWithinPartitions("_key", F.asc_nulls_first("turn"), "role", "text").select("_key", "role", "text")
    edits = sorted_rows.mapInPandas(_repair_short, EDITS)
    if n_long:
        edits = edits.unionByName(_repair_long(rows.join(named, "_key", "left_semi"), segment))
    own = F.when(F.col("_key") != "", F.expr("substr(_key, 2)").cast(turns.schema[conv_id].dataType)).alias("conv_id")
    return edits.select(own, "place", "edit", "role", "text", "fault", "illegal")


def digest(edits: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of repaired conversations.

    A hash reads its conversation in order, so each conversation is one sorted stream through one task,
    which holds the hash and the string of edits.
    """
    kind = edits.schema["conv_id"].dataType

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        price = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
        key, state = None, None
        names = ["_key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

        def closed() -> list[tuple]:
            return [] if key is None else [(key, *state["n"], "".join(state["audit"]), state["hash"].hexdigest())]

        for frame in frames:
            out = []
            for k, edit, role, text, fault, illegal in zip(*(frame[c].tolist() for c in ("_key", "edit", "role", "text", "fault", "illegal"))):
                if k != key:
                    out += closed()
                    key, state = k, {"n": [0] * 5, "audit": [], "hash": hashlib.sha256(), "empty": True}
                n = state["n"]
                if fault:
                    n[fault - 1] += 1
                n[3] += bool(illegal)
                n[4] += price[edit] + (CUT if fault == TRUNCATED and edit in "KR" else 0)
                state["audit"].append(edit)
                if edit != "D":
                    state["hash"].update(("" if state["empty"] else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    state["empty"] = False
            if state and len(state["audit"]) > 1 << 16:
                state["audit"] = ["".join(state["audit"])]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(closed(), columns=names)

    rows = edits.select(_key(F.col("conv_id")).alias("_key"), "place", "edit", "role", "text", "fault", "illegal")
    rows = rows.repartition("_key").sortWithinPartitions("_key", "place")
    found = rows.mapInPandas(read, "_key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return found.withColumn("conv_id", F.when(F.col("_key") != "", F.expr("substr(_key, 2)").cast(kind))).drop("_key")


def report(original: DataFrame, turns: DataFrame, segment: int = 2048) -> DataFrame:
    """One row for each conversation of ``original``, from the repair of ``turns`` (conv_id, turn, role, text).

    ``gaps`` counts the whole numbers missing between the first and the last turn (null where that
    passes 64 bits).  Conversations that have no rows left have zeros, an empty audit and the hash of
    the empty string.
    """
    every = original.select(_key(F.col("conv_id")).alias("_key"), "conv_id").groupBy("_key").agg(F.first("conv_id").alias("conv_id"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    counted = turns.filter("turn IS NOT NULL").groupBy(_key(F.col("conv_id")).alias("_key"), "turn").count().groupBy("_key").agg(
        F.min("turn").alias("_low"), F.max("turn").alias("_high"), F.count(F.lit(1)).alias("_n"))
    gaps = counted.select("_key", (wide("_high") - wide("_low") + 1 - F.col("_n")).try_cast("long").alias("gaps"), F.lit(True).alias("_has"))
    found = digest(repair(turns, segment=segment))
    found = found.select(_key(F.col("conv_id")).alias("_key"), *[c for c in found.columns if c != "conv_id"])
    joined = every.join(gaps, "_key", "left").join(found, "_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "conv_id", F.when(F.col("_has"), F.col("gaps")).otherwise(F.lit(0)).cast("long").alias("gaps"), *[zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
