"""Quality by votes of the nearest labelled documents in a latent semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Three-character shapes and whole three-byte strings are hashed into so many terms each.
SHAPES, STRINGS = 1024, 1024
#: Terms for how much of a text lies in word pairs that occur again.
REPEATS = 8
#: Bytes of text worked on at a time; longer texts are read in slices of this size.
SLICE = 250_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _byte_kinds() -> np.ndarray:
    """Letters by case, digits, other scripts; every mark and blank is a kind of its own."""
    kinds = np.arange(256)
    kinds[ord("a"):ord("z") + 1], kinds[ord("A"):ord("Z") + 1], kinds[ord("0"):ord("9") + 1], kinds[128:] = ord("a"), ord("A"), ord("0"), 128
    return kinds.astype(np.uint32)


KINDS = _byte_kinds()


def _spread(share: np.ndarray) -> np.ndarray:
    """Shares of repeats as square roots of weights of the two nearest marks."""
    return np.sqrt(np.maximum(0, 1 - np.abs(share[:, None] * (REPEATS - 1) - np.arange(REPEATS))))


def _long_terms(raw: bytes) -> np.ndarray:
    """:func:`terms` of one long text: counts add up over its slices, a word cut in two goes on in the next one."""
    shapes, strings, words = np.zeros(SHAPES, np.int64), np.zeros(STRINGS, np.int64), []
    open_sum, open_length = np.uint64(0), 0
    for at in range(0, len(raw), SLICE):
        data = np.frombuffer(raw, np.uint8, min(SLICE + 2, len(raw) - at), at).astype(np.uint32)
        for codes, total in ((KINDS[data], shapes), (data, strings)):
            code = codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]
            total += np.bincount((code * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(len(total)), minlength=len(total))
        data = data[:SLICE]
        blank = (data == 32) | (data >= 9) & (data <= 13)
        begins = np.flatnonzero(~blank & np.append(True, blank[:-1]))
        place = np.arange(len(data)) - (begins[np.maximum(np.searchsorted(begins, np.arange(len(data)), side="right") - 1, 0)] if len(begins) else 0)
        going_on = open_length > 0 and not blank[0]
        if going_on:
            end = int(np.argmax(blank)) if blank.any() else len(data)
            place[:end] += open_length
        mixed = np.where(blank, np.uint64(0), (data.astype(np.uint64) + 1) * (MIX * (2 * place.astype(np.uint64) + 1)))
        found = np.add.reduceat(mixed, begins) if len(begins) else np.empty(0, np.uint64)
        if going_on:
            found[:1] += open_sum
        elif open_length:
            words.append(np.array([open_sum]))
        open_sum, open_length = np.uint64(0), 0
        if len(begins) and not blank[-1]:
            open_sum, open_length, found = found[-1], int(place[-1]) + 1, found[:-1]
        words.append(found)
    word = np.concatenate([*words, [open_sum] if open_length else []]).astype(np.uint64)
    out = np.zeros(SHAPES + STRINGS + REPEATS, np.float32)
    if len(word):
        _, n = np.unique(word[:-1] * np.uint64(31) + word[1:], return_counts=True)
        out[:SHAPES], out[SHAPES:SHAPES + STRINGS] = np.sqrt(shapes / max(shapes.sum(), 1)), np.sqrt(strings / max(strings.sum(), 1))
        out[SHAPES + STRINGS:] = _spread(np.array([n[n > 2].sum() / max(len(word) - 1, 1)]))[0]
    return out


def terms(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of each term family, one row for each text; a text without words is all zero."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    if sum(map(len, raw)) > SLICE and len(raw) == 1:
        return _long_terms(raw[0])[None]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.zeros((len(raw), SHAPES + STRINGS + REPEATS), np.float32)
    if not lengths.sum():
        return out
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), lengths)
    inside = owner[2:] == owner[:-2]
    for codes, first, width in ((KINDS[data], 0, SHAPES), (data, SHAPES, STRINGS)):
        code = codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]
        term = (code * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(width)
        counts = np.bincount(owner[:-2][inside] * width + term[inside], minlength=len(raw) * width).reshape(len(raw), width)
        out[:, first:first + width] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    # words: a hash of each from its bytes and their places in it
    blank = (data == 32) | (data >= 9) & (data <= 13)
    begins = np.flatnonzero(~blank & np.append(True, blank[:-1] | (owner[1:] != owner[:-1])))
    if len(begins):
        place = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data)))) if begins[0] == 0 else np.arange(len(data)) - begins[np.maximum(np.searchsorted(begins, np.arange(len(data)), side="right") - 1, 0)]
        mixed = np.where(blank, 0, (data.astype(np.uint64) + 1) * (MIX * (2 * place.astype(np.uint64) + 1)))
        word = np.add.reduceat(mixed, begins)
        of = owner[begins]
        pair = word[:-1] * np.uint64(31) + word[1:] ^ of[:-1].astype(np.uint64) << np.uint64(40)
        pair, of = pair[of[:-1] == of[1:]], of[:-1][of[:-1] == of[1:]]
        _, where, n = np.unique(pair, return_inverse=True, return_counts=True)
        share = np.bincount(of, n[where] > 2, len(raw)) / np.maximum(np.bincount(of, minlength=len(raw)), 1)
        has = np.bincount(owner[begins], minlength=len(raw)) > 0
        out[:, SHAPES + STRINGS:] = np.where(has[:, None], _spread(share), 0)
        out[~has] = 0
    return out


@dataclass
class Voters:
    """The latent space and the labelled documents in it: all that is broadcast, bounded by ``fit``'s parameters."""

    mean: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int
    power: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        v = (rows - self.mean) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str], block: int = 512, room: int = SLICE // 2) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and end - begin < block and (end == begin or size + len(texts[end]) <= room):
                size += len(texts[end])
                end += 1
            rows = terms(texts[begin:end])
            some = rows.any(1)
            if some.any() and len(self.labels):
                near = self.latent(rows[some]) @ self.vectors.T
                k = min(self.k, len(self.labels))
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** self.power
                votes = (weight * self.labels[top]).sum(1) + 1e-6 * self.prior
                out[begin:end][some] = votes / (weight.sum(1) + 1e-6)
            begin = end
        return out


def held_out(doc_id: Column) -> Column:
    """Rows whose id leaves 1 are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 2048, dims: int = 48, k: int = 15, power: float = 4.0) -> Voters:
    """Voters from at most ``sample`` labelled documents, those whose ids have the smallest hashes.

    Held-out ids, null ids and labels other than 0 and 1 are left out.  The basis holds the ``dims``
    leading singular directions of the sample's weighted terms.
    """
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).filter(F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = chosen.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["_label"].astype("int32"), "row": [terms([t or ""])[0].astype(np.float32).tobytes() for t in frame["_text"]]})

    # a repeated id gives one row, the same one in every run: the bound holds for what is collected
    once = texts.groupBy("_id").agg(F.max("_label").alias("_label"), F.min("_text").alias("_text"))
    got = once.select("_label", "_text").mapInPandas(featured, "label int, row binary").toPandas()
    width = SHAPES + STRINGS + REPEATS
    rows = np.frombuffer(b"".join(got.pop("row")), np.float32).reshape(len(got), width) if len(got) else np.zeros((0, width), np.float32)
    answers = got["label"].to_numpy(float) if len(got) else np.zeros(0)
    keep = rows.any(1)
    rows, answers = rows[keep], answers[keep]
    prior = float(answers.mean()) if len(answers) else 1.0
    if len(rows) < 2:
        return Voters(np.zeros(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior, k, power)
    order = sorted(range(len(rows)), key=lambda i: (answers[i], rows[i].tobytes()))  # the same rows in any order give the same model
    rows, answers = rows[order], answers[order]
    mean = rows.mean(0)
    rows -= mean
    # leading right singular vectors by subspace iteration: nothing larger than the sample itself
    basis = np.linalg.qr(rows[np.linspace(0, len(rows) - 1, min(2 * dims, len(rows))).astype(int)].T)[0]
    for _ in range(12):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, turn = np.linalg.eigh((rows @ basis).T @ (rows @ basis))
    basis = (basis @ turn[:, ::-1][:, :dims]).astype(np.float32)
    rows += mean
    voters = Voters(mean, basis, np.zeros((0, 1)), answers, prior, k, power)
    voters.vectors = voters.latent(rows).astype(np.float32)
    return voters


def scored(docs: DataFrame, voters: Voters, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the vote in column ``out``; any column of that name is replaced.

    Every whole text is compared with all labelled vectors, in blocks.  Texts without words (and null
    texts) get the labelled share of label 1, as does everything if there are no labels (then 1).
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.pandas_udf("double")
    def vote(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    return docs.withColumn(out, vote(F.coalesce(F.col(text), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``; null ids count as held out.

    Repeated rows are rows of their own, columns beyond the named ones are ignored, and an empty table
    gives an empty result.
    """
    voters = fit(docs, labels, doc_id, text, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return scored(rows, voters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, voters: Voters, text: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted to be of label 1, with all their columns, whatever these are called."""
    whole = docs.select(F.struct("*").alias("_row"))  # carried once: the text is read out of the row
    return scored(whole, voters, f"_row.{text}", "_score").filter("_score >= 0.5").select("_row.*")
