"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The index holds a bounded sample of labelled documents, sorted by their heaviest term and cut into
blocks.  Beside the postings of a term stands its largest weight in each block: the sum over a text's
terms bounds all cosines of a block, so blocks are read in falling order of their bounds until none can
hold a nearer example.  The nearest ones vote by their cosine; votes become probabilities by isotonic
regression over the sample, each example judged by the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize

LETTERS = re.compile(r"[^\W\d_]+")
#: A word gives itself and its beginnings of these lengths, so that endings don't hide a stem.
STEMS = range(4, 9)
#: Longer words are told apart by their first characters only.
LONGEST = 64
#: Words (of a short text: characters) counted at a time.
AT_ONCE = 100_000


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text (letters, lower-cased, at most ``LONGEST`` of each), a bounded number at a time."""
    if len(text) <= AT_ONCE:
        yield LETTERS.findall(text.lower())
    else:
        found = (m.group()[:LONGEST].lower() for m in LETTERS.finditer(text))
        while part := list(islice(found, AT_ONCE)):
            yield part


def terms_of(word: str) -> list[str]:
    """The word itself, marked by its end, and its beginnings."""
    word = word[:LONGEST]
    return [word + "$", *(word[:n] for n in STEMS if n <= len(word))]


class Weigher:
    """Vectors over a fixed vocabulary: (1 + ln tf) times idf, of length 1."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray):
        self.vocabulary, self.idf = vocabulary, idf
        # how words that give a term begin: nearly all others are passed over by this
        self.openings = {t[:STEMS[0]].rstrip("$") for t in vocabulary}

    def counts(self, text: str) -> dict[int, int]:
        openings, width, out = self.openings, STEMS[0], {}
        for words in words_of(text):
            for word, n in Counter([w for w in words if w[:width] in openings]).items():
                for term in terms_of(word):
                    i = self.vocabulary.get(term)
                    if i is not None:
                        out[i] = out.get(i, 0) + n
        return out

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts(text)
        ids = np.array(sorted(counts), np.int64)
        weights = np.array([1 + math.log(counts[i]) for i in ids.tolist()]) * self.idf[ids] if len(ids) else np.empty(0)
        return ids, weights / np.linalg.norm(weights) if len(ids) else weights


@dataclass
class BlockMaxIndex:
    """Postings by term, cut at the borders of blocks of examples, with each term's largest weight in each block."""

    n_terms: int
    vectors: list[tuple[np.ndarray, np.ndarray]]
    block: int = 32
    visited: int = 0

    def __post_init__(self):
        n = len(self.vectors)
        owner = np.repeat(np.arange(n), [len(ids) for ids, _ in self.vectors]) if n else np.empty(0, np.int64)
        term = np.concatenate([ids for ids, _ in self.vectors]) if n else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in self.vectors]) if n else np.empty(0)
        order = np.lexsort((owner, term))
        self.owner, self.weight, term = owner[order], weight[order], term[order]
        self.blocks = -(-n // self.block)
        place = term * self.blocks + self.owner // self.block
        # postings of (term, block) stand between two neighbouring entries
        self.start = np.searchsorted(place, np.arange(self.n_terms * self.blocks + 1))
        self.highest = np.zeros(self.n_terms * self.blocks)
        np.maximum.at(self.highest, place, self.weight)
        self.highest = self.highest.reshape(self.n_terms, self.blocks).astype(np.float32)

    def scores(self, ids: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines with all examples of some blocks that share a term."""
        at = (ids[:, None] * self.blocks + blocks).ravel()
        first, n = self.start[at], self.start[at + 1] - self.start[at]
        where = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        who, inverse = np.unique(self.owner[where], return_inverse=True)
        return who, np.bincount(inverse, self.weight[where] * np.repeat(np.repeat(weights, len(blocks)), n), len(who))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0, of equal ones those that stand first."""
        bounds = (weights[:, None] * self.highest[ids]).sum(0) * (1 + 1e-6)  # 32-bit maxima may be rounded down
        order = np.argsort(-bounds, kind="stable")
        order = order[:int((bounds > 0).sum())]
        who, cosine, least = np.empty(0, np.int64), np.empty(0), 0.0
        for at in range(0, len(order), step):
            if len(who) >= k and bounds[order[at]] < least:
                break
            part = order[at:at + step]
            self.visited += len(part)
            more, found = self.scores(ids, weights, part)
            who, cosine = np.concatenate([who, more]), np.concatenate([cosine, found])
            best = np.lexsort((who, -np.round(cosine, 12)))[:k]
            who, cosine = who[best], cosine[best]
            least = cosine[-1] - 1e-9 if len(who) else 0.0
        return who, cosine


@dataclass
class Examples:
    """All that is sent to the tasks; its size is bounded by the parameters of :func:`fit`."""

    weigher: Weigher
    index: BlockMaxIndex
    ids: list
    labels: np.ndarray
    silent: float
    k: int
    power: float
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def near(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids, weights = self.weigher.vector(text)
        return self.index.nearest(ids, weights, self.k) if len(ids) and len(self.labels) else (np.empty(0, np.int64), np.empty(0))

    def vote(self, who: np.ndarray, cosine: np.ndarray) -> float:
        weight = cosine**self.power
        return float((weight * self.labels[who]).sum() / weight.sum())

    def score(self, who: np.ndarray, cosine: np.ndarray) -> float:
        """The calibrated vote; texts that share nothing with an example get the share among such examples."""
        return float(np.interp(self.vote(who, cosine), *self.knots)) if len(who) else self.silent


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to the labels; each step gets half a row of either label."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, sum of votes
    for v, y in zip(votes[order], labels[order]):
        pools.append([y, 1.0, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y, n, v = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + n, pools[-1][2] + v]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return np.array([v / n for _, n, v in pools]), np.maximum.accumulate([(y + 0.5) / (n + 1) for y, n, _ in pools])


def held_out(doc_id: Column) -> Column:
    """Rows whose id leaves 0 are never learned from; rows without an id neither."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _document_frequencies(texts: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all texts each term of the vocabulary occurs; tasks send one number for each term."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weigher, seen, n = Weigher(shared.value, np.empty(0)), np.zeros(len(shared.value) + 1, np.int64), 0
        for frame in frames:
            n += len(frame)
            for text in frame["text"]:
                seen[list(weigher.counts(text))] += 1
        seen[-1] = n
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"term": at, "n": seen[at]})

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in texts.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 8192, vocabulary: int = 20_000,
        least_chi2: float = 30.0, least_docs: int = 4, k: int = 25, power: float = 4.0) -> Examples:
    """Examples from at most ``sample`` labelled documents, those whose ids have the smallest hashes.

    Terms are the at most ``vocabulary`` ones of the sample that go with the label most (chi-squared of
    ``least_chi2`` or more, which chance reaches for one of 20 million terms, in ``least_docs`` documents or more); their idf comes from all of ``docs``.
    Held-out ids, null ids and labels other than 0 and 1 are left out.  Of repeated ids any one row is an
    example, the same one in every run; without examples the score is 0 for every text.
    """
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = chosen.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # at most ``sample`` rows are sent
    found = materialize(found.groupBy("_id").agg(F.max("_label").alias("label"), F.min("text").alias("text")))

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"]):
                terms = list({t for word in {w for part in words_of(text) for w in part} for t in terms_of(word)})
                yield pd.DataFrame({"term": terms, "label": label})

    total = found.agg(F.count(F.lit(1)), F.sum("label")).first()
    n, ones = total[0], total[1] or 0
    x, y = F.col("ones").cast("double"), F.col("docs").cast("double")
    chi2 = F.lit(float(n)) * F.pow(x * (n - y - ones + x) - (y - x) * (ones - x), F.lit(2.0)) / (y * (n - y) * ones * (n - ones))
    terms = found.mapInPandas(listed, "term string, label int").groupBy("term").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("docs"))
    terms = terms.filter((F.col("docs") >= least_docs) & (F.col("docs") < n)).withColumn("chi2", chi2) if 0 < ones < n else terms.filter("false").withColumn("chi2", F.lit(0.0))
    names = [r["term"] for r in terms.filter(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "term").limit(vocabulary).collect()]
    ids = {t: i for i, t in enumerate(names)}
    df, everything = _document_frequencies(texts, ids)
    weigher = Weigher(ids, np.log((everything + 1) / (df + 1)) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(weigher)

    def weighed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [shared.value.vector(t) for t in frame["text"]]
            yield pd.DataFrame({"label": frame["label"], "id": frame["id"], "ids": [i.tolist() for i, _ in vectors], "weights": [w.tolist() for _, w in vectors]})

    rows = found.select("label", F.col("_id").cast("string").alias("id"), "text").mapInPandas(weighed, "label int, id string, ids array<int>, weights array<double>").collect()
    answers = np.array([r["label"] for r in rows if not r["ids"]], float)
    silent = float((answers.sum() + 0.5) / (len(answers) + 1)) if len(answers) else 0.0
    some = [(np.array(r["ids"], np.int64), np.array(r["weights"]), r["label"], r["id"]) for r in rows if r["ids"]]
    some.sort(key=lambda r: (int(r[0][np.argmax(r[1])]), r[3]))  # blocks of one main term have maxima of few terms
    index = BlockMaxIndex(len(names), [(i, w) for i, w, _, _ in some])
    examples = Examples(weigher, index, [r[3] for r in some], np.array([r[2] for r in some], float), silent, k, power)
    votes = np.full(len(some), np.nan)
    for me, (i, w, _, _) in enumerate(some):
        who, cosine = index.nearest(i, w, k + 1)
        others = who != me
        if others.any():
            votes[me] = examples.vote(who[others][:k], cosine[others][:k])
    judged = ~np.isnan(votes)
    examples.knots = isotonic(votes[judged], examples.labels[judged])
    return examples


def scored(docs: DataFrame, examples: Examples, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with ``out``, a struct of score and evidence: the nearest examples with cosine and label, nearest first.

    Whole texts are read.  Null and empty texts and others that share no term with an example have no
    evidence and the score of such examples.  A column called ``out`` is replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(examples)

    @F.pandas_udf("score double, example array<string>, cosine array<double>, label array<int>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        known, rows = shared.value, []
        for t in texts:
            who, cosine = known.near(t)
            rows.append((known.score(who, cosine), [known.ids[i] for i in who], cosine.tolist(), known.labels[who].astype(int).tolist()))
        return pd.DataFrame(rows, columns=["score", "example", "cosine", "label"])

    judged = docs.withColumn(out, judge(F.coalesce(F.col(text), F.lit(""))))
    return judged.withColumn(out, F.struct(F.col(f"{out}.score").alias("score"), F.arrays_zip(*[F.col(f"{out}.{c}").alias(c) for c in ("example", "cosine", "label")]).alias("evidence")))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), one row for each row of ``docs``; null ids count as held out.

    Repeated rows are rows of their own; columns beyond the named ones are ignored; an empty table gives
    an empty result.
    """
    examples = fit(docs, labels, doc_id, text, **options)
    rows = scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), examples)
    score = F.col("toxicity.score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxicity.evidence").alias("evidence"))
