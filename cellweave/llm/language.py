"""Language of pages by fusing evidence: text, declared markup language, address and host.

Text likelihoods come from letter triples of labelled documents.  How far a declared language or an
address suffix can be trusted, and how languages are spread over hosts, is counted over all pages by
grouped aggregation.  Counts of a host are smoothed towards those of its domain, these towards those
of all pages, and a page's own count is taken out before its host speaks about it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize
from cellweave.llm.url_filter import host_and_path

TERMS = 8192


#: Characters worked on at a time.
ROOM = 500_000


def _terms(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each character but the first and last: whether it is a letter, and the term of the triple around it."""
    letter = (codes > 127) | (codes >= 97) & (codes <= 122)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    term = ((codes[:-2] * np.uint64(1_000_003) + codes[1:-1]) * np.uint64(1_000_003) + codes[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(51)
    return letter[1:-1], term.astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _triples(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, term) of all letter triples, about ``ROOM`` characters at a time: lower case, everything else one blank."""
    lowered, lengths = [], []

    def block(first: int) -> tuple[np.ndarray, np.ndarray]:
        some, term = _terms(_codes(" ".join(["", *lowered, ""])))
        owner = np.repeat(np.arange(first, first + len(lowered)), np.array(lengths) + 1)[:len(term)]
        return owner[some], term[some]

    for i, text in enumerate(texts):
        text = text.lower()
        if lowered and sum(lengths) + len(text) > ROOM:
            yield block(i - len(lowered))
            lowered, lengths = [], []
        if len(text) <= ROOM:
            lowered.append(text)
            lengths.append(len(text))
            continue
        for at in range(0, len(text), ROOM):  # with the characters on both sides of the slice
            piece = (text[at - 1] if at else " ") + text[at:at + ROOM] + (text[at + ROOM:at + ROOM + 1] or " ")
            some, term = _terms(_codes(piece))
            yield np.full(int(some.sum()), i), term[some]
    if lowered:
        yield block(len(texts) - len(lowered))


@dataclass
class LanguageModel:
    languages: list[str]
    log_share: np.ndarray  # language x term

    def likelihoods(self, texts: list[str], temper: float = 0.2) -> np.ndarray:
        """Log likelihood of each text, tempered, since neighbouring triples aren't independent."""
        out = np.zeros((len(texts), len(self.languages)))
        if texts:
            for owner, term in _triples(texts):
                for j in range(len(self.languages)):
                    out[:, j] += temper * np.bincount(owner, self.log_share[j, term], len(texts))
        return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000) -> LanguageModel:
    """A model from at most ``sample`` labelled documents, those whose ids have the smallest hashes."""
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang")).filter("_lang is not null and _id is not null").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = chosen.select("_id").distinct()
    texts = docs.filter(F.col(lang).isNotNull()).select(F.col(doc_id).alias("_doc"), F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # ``sample`` ids at most

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for name, part in frame.groupby("_lang"):
                for _, term in _triples(part["_text"].tolist()):
                    sums[name] = sums.get(name, np.zeros(TERMS, np.int64)) + np.bincount(term, minlength=TERMS)
        for name, n in sums.items():
            yield pd.DataFrame({"lang": name, "term": np.flatnonzero(n), "n": n[n > 0]})

    got = texts.select("_lang", "_text").mapInPandas(counted, "lang string, term long, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(got["lang"]))
    shares = np.full((len(names), TERMS), 0.5)
    for j, name in enumerate(names):
        own = got[got["lang"] == name]
        shares[j, own["term"].to_numpy(int)] += own["n"].to_numpy(float)
    return LanguageModel(names, np.log(shares / shares.sum(1, keepdims=True)))


def visible_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "), r"(?s)<[^>]*>|&#?\w+;", " ")


def declared_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))


def _soft(scores: str) -> Column:
    """exp(scores - max), scaled to sum 1."""
    grown = f"transform({scores}, x -> exp(x - array_max({scores})))"
    return F.expr(f"transform({grown}, x -> x / aggregate({grown}, 0D, (a, b) -> a + b))")


def _sums(width: int, value: str) -> Column:
    return F.array(*[F.sum(F.col(value)[j]) for j in range(width)])


def identify(pages: DataFrame, model: LanguageModel, page_id: str = "page_id", url: str = "url", html: str = "html",
             strength: float = 8.0, trust: float = 1.0) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, suffix, host), one row for each row of ``pages``.

    The evidence of a page: the text's likelihood; P(declared | language) and P(suffix | language) with
    ``trust`` pseudo-counts, where the suffix is a two-letter first step of the path, or else the last
    label of the host; and the prior of its host, smoothed by ``strength`` pages of its domain, itself
    smoothed by ``strength`` pages of all.  All counts weigh pages by their text's probabilities.  Null
    or empty html has no text and declares nothing ('' is a declaration like any other); a null url has
    an empty host.  Without any labelled language ``lang`` is null.  Repeated rows are rows of their
    own; other columns are ignored.
    """
    names, width = model.languages, len(model.languages)
    host, path = host_and_path(F.col(url))
    step = F.lower(F.regexp_extract(path, r"^/([A-Za-z]{2})(?:/|$)", 1))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), declared_language(F.col(html)).alias("declared"), visible_text(F.col(html)).alias("text"),
                        F.when(step != "", step).otherwise(F.substring_index(host, ".", -1)).alias("suffix"))
    if not width:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host")
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def likelihoods(texts: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.likelihoods(texts.tolist())))

    rows = rows.withColumn("ll", likelihoods("text")).drop("text")
    rows = materialize(rows.withColumn("p", _soft("ll")).withColumn("domain", F.substring_index("host", ".", -2)))
    by_host = rows.groupBy("domain", "host").agg(_sums(width, "p").alias("of_host"))
    by_domain = by_host.groupBy("domain").agg(_sums(width, "of_host").alias("of_domain"))
    everywhere = by_domain.agg(_sums(width, "of_domain").alias("of_all"))
    declared = rows.groupBy("declared").agg(_sums(width, "p").alias("of_declared"))
    suffix = rows.groupBy("suffix").agg(_sums(width, "p").alias("of_suffix"))
    kinds = declared.agg(F.count(F.lit(1)).alias("n_declared")).join(suffix.agg(F.count(F.lit(1)).alias("n_suffix"))).join(everywhere)  # three tables of one row
    hosts = by_host.join(by_domain, "domain").drop("domain")
    known = rows.join(hosts, "host").join(declared, "declared").join(suffix, "suffix").join(kinds)  # one row on the right
    every = f"sequence(0, {width - 1})"
    total = lambda c: f"aggregate({c}, 0D, (a, b) -> a + b)"
    known = known.withColumn("base", F.expr(f"transform({every}, j -> (of_all[j] - p[j] + 1) / ({total('of_all')} - 1 + {width}))"))
    known = known.withColumn("parent", F.expr(f"transform({every}, j -> (of_domain[j] - p[j] + {strength} * base[j]) / ({total('of_domain')} - 1 + {strength}))"))
    known = known.withColumn("prior", F.expr(f"transform({every}, j -> (of_host[j] - p[j] + {strength} * parent[j]) / ({total('of_host')} - 1 + {strength}))"))
    fused = F.expr(
        f"transform({every}, j -> ll[j] + ln(greatest(prior[j], 1e-12)) + ln((of_declared[j] - p[j] + {trust}) / (of_all[j] - p[j] + {trust} * n_declared))"
        f" + ln((of_suffix[j] - p[j] + {trust}) / (of_all[j] - p[j] + {trust} * n_suffix)))")
    known = known.withColumn("fused", fused).withColumn("posterior", _soft("fused"))
    label = F.array(*[F.lit(x) for x in names])
    at = lambda c: F.element_at(label, F.array_position(c, F.array_max(c)).cast("int"))
    return known.select("page_id", at("posterior").alias("lang"), F.array_max("posterior").alias("probability"), at("p").alias("text_lang"), "declared", "suffix", "host")
