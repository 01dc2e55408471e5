"""Toxicity, conversation repair and collocations against brute force, and odd inputs."""

import hashlib
import itertools
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.llm import conversation, language, phrases, toxicity

TURNS = "conv_id long, turn long, role string, text string, edit string, place int"


# ---------------------------------------------------------------- 12 conversations
def allowed(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def brute_repair(rows):
    """All edit strings, by cost and then by letters: rows of (initial, fault)."""
    best = (10**9, "")
    per_row = [["D"] + (["K", "R"] if f in (0, 3) else []) for _, f in rows]
    slots = [["", "I", "II"]] * (len(rows) + 1)
    for edits in itertools.product(*per_row):
        for gaps in itertools.product(*slots):
            string = "".join(g + e for g, e in itertools.zip_longest(gaps, edits, fillvalue=""))
            cost = 3 * sum(map(len, gaps)) + sum({"K": 0, "R": 3, "D": 4}[e] + (3 if e != "D" and f == 3 else 0) for e, (_, f) in zip(edits, rows))
            if (cost, string) >= best:
                continue
            free = [x for g, e, (i, _) in zip(gaps, edits, rows) for x in ["?"] * len(g) + ([i] if e == "K" else ["?"] if e == "R" else [])] + ["?"] * len(gaps[-1])
            head = "s" if free and free[0] == "s" else ""
            fits = head + "ua" * ((len(free) - len(head)) // 2)
            if len(fits) == len(free) and allowed(fits) and all(a in ("?", b) for a, b in zip(free, fits)):
                best = (cost, string)
    return best


def test_cheapest_edits_match_all_edit_strings():
    rng = np.random.default_rng(8)
    for _ in range(150):
        rows = [(str(rng.choice(list("suaux "))), int(rng.choice([0, 0, 0, 1, 2, 3]))) for _ in range(int(rng.integers(0, 5)))]
        assert conversation.cheapest(rows) == brute_repair(rows), rows


def forward_only(rows):
    """The same lattice, read in order: the cheapest, least string to each state."""
    best = {0: (0, "")}
    for i in range(len(rows) + 1):
        for _ in range(2):
            for s, (cost, edits) in list(best.items()):
                t = 3 if s == 2 else 2
                best[t] = min(best.get(t, (10**9, "")), (cost + 3, edits + "I"))
        if i == len(rows):
            break
        step = {}
        for s, (cost, edits) in best.items():
            for j, t, more, edit in conversation._forward(rows, i, s):
                if j == i + 1:
                    step[t] = min(step.get(t, (10**9, "")), (cost + more, edits + edit))
        best = step
    return min(best[s] for s in (0, 3) if s in best)


def test_long_conversations_in_segments(spark):
    rng = np.random.default_rng(1)
    words = ["Yes.", "No", "", "What?", "Well.", "So.", "Fine.", " "]
    rows = []
    for c in range(12):
        for turn in range(int(rng.integers(1, 90))):
            role = str(rng.choice(["user", "assistant", "system", "tool"], p=[0.45, 0.45, 0.05, 0.05]))
            rows.append((c if c else None, turn if turn % 7 else None, role, f"{c} {turn if rng.uniform() < 0.8 else 0} {rng.choice(words)}"))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r["conv_id"]: r for r in conversation.report(table, table).collect()}
    parts = {r["conv_id"]: r for r in conversation.report(table, table, segment=5).collect()}
    assert whole == parts and len(whole) == 12
    for c, r in whole.items():
        own = sorted((t is not None, t or 0, role, text) for k, t, role, text in rows if k == c)
        seen, faults = set(), []
        for _, _, role, text in own:
            fault = conversation._text_fault(text)
            faults.append(2 if fault != 1 and (role, text) in seen else fault)
            seen.add((role, text))
        cost, edits = forward_only([(o[2][0], f) for o, f in zip(own, faults)])
        assert (r["cost"], r["audit"]) == (cost, edits)
        turns = conversation.edited([(o[2], o[3]) for o in own], edits)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for e, a, b, _ in turns if e != "D").encode()).hexdigest()
        assert [r["blank"], r["duplicate"], r["truncated"]] == [faults.count(f) for f in (1, 2, 3)]
        assert r["illegal"] == sum(a[2][0] + b[2][0] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        some = [o[1] for o in own if o[0]]
        assert r["gaps"] == (max(some) - min(some) + 1 - len(set(some)) if some else 0)


def test_conversations_of_odd_rows(spark):
    rows = [(1, None, None, None, "x", 1), (1, None, "user", "Hi.", None, None), (1, -(2**63), "assistant", "", "x", 1), (1, 2**63 - 1, "", "long " * 30_000, "x", 1),
            (None, 3, "user", "A?", "x", 1), (None, 3, "user", "A?", "x", 1), (2, 1, "assistant", "Only.", "x", 1)]
    table = spark.createDataFrame(rows, TURNS)
    got = {r["conv_id"]: r for r in conversation.report(table, table).collect()}
    assert got[1]["gaps"] is None and got[1]["blank"] == 2 and got[1]["truncated"] == 1
    assert (got[None]["duplicate"], got[None]["audit"], got[None]["cost"]) == (1, "DD", 8) or got[None]["audit"] == "KDI"
    assert got[2]["audit"] == min([(3, "IK"), (4, "D")])[1]
    edits = conversation.repair(table)
    assert edits.columns == ["conv_id", "place", "edit", "role", "text", "fault", "illegal"]
    assert conversation.repair(table.filter("false")).count() == 0 and conversation.report(table.filter("false"), table.filter("false")).count() == 0
    gone = conversation.report(table, table.filter("false")).collect()
    assert len(gone) == 3 and all((r["gaps"], r["cost"], r["audit"], r["repaired_sha256"]) == (0, 0, "", hashlib.sha256().hexdigest()) for r in gone)


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(20) for t in range(10)] + [(None, None, None, None)]
    got = conversation.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = [(r["role"], r["text"]) for r in got if (r["conv_id"], r["turn"]) == (c, t)]
        role, text = role or " ", text or " "
        want = {0: [], 1: [(role, "")], 2: [(role, "".join(x for x in text if x not in ".!?"))], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert mine == want.get(how, [(role, text)])


# ---------------------------------------------------------------- 11 toxicity
@pytest.mark.parametrize("block", [1, 3, 32])
def test_block_max_search_is_exact(block):
    rng = np.random.default_rng(3)
    def vector():
        ids = np.sort(rng.choice(40, int(rng.integers(1, 8)), replace=False))
        w = rng.uniform(0.1, 1, len(ids))
        return ids, w / np.linalg.norm(w)

    stored = [vector() for _ in range(200)]
    stored[50:60] = stored[40:50]  # ties
    index = toxicity.BlockMaxIndex(40, stored, block)
    dense = np.zeros((200, 40))
    for row, (ids, w) in zip(dense, stored):
        row[ids] = w
    for _ in range(60):
        ids, w = vector()
        cosine = dense[:, ids] @ w
        want = np.lexsort((np.arange(200), -np.round(cosine, 12)))[:9]
        want = want[cosine[want] > 0]
        who, found = index.nearest(ids, w, 9)
        assert who.tolist() == want.tolist() and np.allclose(found, cosine[want])
    assert block > 3 or index.visited < 60 * index.blocks  # some blocks are never read
    assert len(toxicity.BlockMaxIndex(40, [], block).nearest(*vector(), 9)[0]) == 0


def test_isotonic_knots_rise_and_average():
    rng = np.random.default_rng(0)
    votes = rng.uniform(size=500)
    labels = (rng.uniform(size=500) < votes).astype(float)
    x, y = toxicity.isotonic(votes, labels)
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and np.abs(np.interp([0.2, 0.5, 0.8], x, y) - [0.2, 0.5, 0.8]).max() < 0.15


def test_toxic_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(rows) > 50 and (rows["predicted"] == rows["toxic"]).mean() > 0.9
    assert rows[rows["toxic"] == 1]["score"].mean() - rows[rows["toxic"] == 0]["score"].mean() > 0.4
    near = next(e for e in rows["evidence"] if len(e) > 1)
    assert all(a["cosine"] >= b["cosine"] - 1e-9 for a, b in zip(near, near[1:]))
    # labels of held-out rows change nothing
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.classify(docs, other).select("doc_id", F.col("score").alias("again"))
    assert toxicity.classify(docs, labels).join(again, "doc_id").filter("abs(score - again) > 1e-12").count() == 0


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 200)] + [(1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = [(i, ("you idiot " if i % 3 == 0 else "good morning ") + f"w{i % 17} words", "en", 0.5, "x") for i in range(1, 200)]
    rows += [(300, None, None, None, None), (301, "", "en", None, None), (302, "IDIOT " * 60_000, "en", 1.0, "y"), (None, "idiot", None, None, None), (1, "good morning again", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, toxicity string")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    of = {r["doc_id"]: r for r in got}
    assert of[302]["predicted"] == 1 and of[None]["held_out"] and of[None]["predicted"] == 1 and of[301]["score"] == of[300]["score"]
    assert toxicity.classify(docs.filter("false"), labels).count() == 0
    assert toxicity.classify(docs, labels.filter("false")).filter("score = 0").count() == len(rows)
    kept = toxicity.scored(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns  # the column of that name is replaced


# ---------------------------------------------------------------- 13 collocations
def test_double_arrays_hold_their_phrases_and_no_others():
    rng = np.random.default_rng(6)
    for length in (1, 2, 3):
        for n in (1, 7, 400):
            some = np.unique(rng.integers(1, 60, (n, length)).astype(np.int32) ** 2, axis=0)
            trie = phrases.DoubleArray.build(some)
            text = rng.integers(0, 60, 5000).astype(np.int32) ** 2
            place = {tuple(p): i for i, p in enumerate(some.tolist())}
            want = [place.get(tuple(text[i:i + length].tolist()), -1) for i in range(len(text))]
            assert trie.walk(text).tolist() == want


def brute_phrases(rows, least):
    import re
    from collections import Counter

    f, n = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if a >= least}
    out = []
    for (lang, p), a in often.items():
        if len(p) == 1 or any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for (other, q), b in often.items() if other == lang):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"shard": 5, "at_once": 2, "max_bits": 16}])
def test_collocations_match_brute_force(spark, options):
    rng = np.random.default_rng(9)
    vocabulary = ["The", "old", "é", "x y", "dog", "\x1c", "ran", "a", "Ä"]
    rows = [(" ".join(rng.choice(vocabulary, int(rng.integers(0, 40)), p=rng.dirichlet(np.ones(9)))) + str(rng.choice([".", "\n old dog ran", "\t", ""])), str(rng.choice(["en", "de"]))) for _ in range(60)]
    rows += [(None, "en"), ("", None), ("the old dog " * 12, None), ("the old dog " * 12, None), ("word " * 20_000, "fr")]
    table = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "text string, lang string, n int, score int, phrase string")
    got = phrases.collocations(table, least=4, **options)
    assert sorted((r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect()) == brute_phrases(rows, 4)


def test_collocations_of_huge_vocabularies_and_empty_tables(spark, monkeypatch):
    rows = [("red green blue, red green", "en"), ("red green red", "de"), ("blue red green", "en")] * 10
    table = spark.createDataFrame(rows, "text string, lang string")
    want = sorted(map(str, phrases.collocations(table).collect()))
    assert want
    plain = phrases.number_texts
    assert phrases.collocations(table.limit(3)).count() == 0  # nothing is frequent
    words = spark.createDataFrame([("a", "en"), ("b", "en")] * 10, "text string, lang string")
    assert phrases.collocations(words).count() == 0  # words are, pairs are not
    monkeypatch.setattr(phrases, "number_texts", lambda texts, words: plain(texts, words, dictionary=2))
    assert sorted(map(str, phrases.collocations(table).collect())) == want
    assert phrases.collocations(table.filter("false")).count() == 0


def test_tries_share_out_first_words(spark, monkeypatch):
    rows = [(1, w) for w in range(1, 400)] + [(w, 1 + v) for w in range(2, 300) for v in range(4)]
    table = spark.createDataFrame(rows, "w1 int, w2 int")
    tries = [phrases._load(r.asDict(), 2) for r in phrases.build_tries(table, 2, 200).collect()]
    assert sorted(map(tuple, np.concatenate([codes for _, codes in tries]).tolist())) == sorted(rows)
    owners = [{w for w, _ in codes.tolist()} - {1} for _, codes in tries]
    assert len(tries) > 4 and sum(map(len, owners)) == 298  # all but the one with most phrases
    assert max(trie.size for trie, _ in tries) < 400
    text = np.random.default_rng(2).integers(0, 320, 4000).astype(np.int32)
    for direct in (phrases.DIRECT, 0):
        monkeypatch.setattr(phrases, "DIRECT", direct)
        found = [(trie.walk(text), codes) for trie, codes in tries]
        got = {(i, *codes[w[i]].tolist()) for w, codes in found for i in np.flatnonzero(w >= 0)}
        assert got == {(i, a, b) for i, (a, b) in enumerate(itertools.pairwise(text.tolist())) if (a, b) in set(rows)}


def test_counts_of_slots_are_packed_and_triples_need_no_second_copy_of_the_texts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    slots = np.concatenate([rng.integers(0, 1 << 18, 5000), np.full(300, 70_000), [0, 65_535, 65_536, (1 << 18) - 1] * 3])
    bitmap = phrases._bitmap(spark.createDataFrame(pd.concat([phrases._packed([part], 3) for part in np.split(slots, [1000, 1001, 4000])])), 3, 18)
    assert np.flatnonzero(np.unpackbits(bitmap, bitorder="little")).tolist() == np.flatnonzero(np.bincount(slots, minlength=1 << 18) >= 3).tolist()
    written, plain = [], phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, *a: written.append(df.columns) or plain(df, *a))
    table = spark.createDataFrame([("red green blue, red green", "en"), ("red green red", "de"), ("blue red green", "en")] * 10, "text string, lang string")
    assert phrases.collocations(table, shard=1).filter("length = 3").count() == 3
    assert written == [["lang", "word", "n"], ["numbers"]]


# ---------------------------------------------------------------- 6 language
def brute_triples(text):
    from collections import Counter

    letters = "".join(c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text.lower())
    out = Counter()
    for i, c in enumerate(letters):
        if c != " ":
            a, b, d = (ord(x) for x in ((letters[i - 1:i] or " "), c, (letters[i + 1:i + 2] or " ")))
            out[(((a * 1_000_003 + b) * 1_000_003 + d) * 0x9E3779B97F4A7C15 % 2**64) >> 51] += 1
    return out


@pytest.mark.parametrize("room", [5, 40, 500_000])
def test_letter_triples_match_brute_force(monkeypatch, room):
    monkeypatch.setattr(language, "ROOM", room)
    texts = ["", "a", "Größe über 12 Äpfel!", "x" * 17, "  two  words ", "", "Ünï, cödé " * 9, "end"]
    found = [{} for _ in texts]
    for owner, term in language._triples(texts):
        for i, k in zip(owner.tolist(), term.tolist()):
            found[i][k] = found[i].get(k, 0) + 1
    assert found == [dict(brute_triples(t)) for t in texts]


def test_evidence_is_fused_as_stated(spark):
    model = language.LanguageModel(["de", "en"], np.log(np.random.default_rng(0).dirichlet(np.ones(language.TERMS), 2)))
    hosts = ["a.x.com", "a.x.com", "b.x.com", "c.de", "c.de"]
    rows = [(i, f"http://{h}/{'de' if i % 2 else 'en'}/p", f'<html lang="{"de" if i < 2 else "en"}"><body>Wörter number {i} hier</body></html>') for i, h in enumerate(hosts)]
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    texts = [r[0] for r in spark.createDataFrame(rows, "page_id long, url string, html string").orderBy("page_id").select(language.visible_text(F.col("html"))).collect()]
    ll = 0.2 * np.array([[sum(n * model.log_share[j, k] for k, n in brute_triples(t).items()) for j in range(2)] for t in texts])
    soft = lambda x: np.exp(x - x.max(-1, keepdims=True)) / np.exp(x - x.max(-1, keepdims=True)).sum(-1, keepdims=True)
    p, n = soft(ll), len(rows)
    declared, suffix = [got[i]["declared"] for i in range(n)], [got[i]["suffix"] for i in range(n)]
    domain = [".".join(h.split(".")[-2:]) for h in hosts]
    for i in range(n):
        others = lambda same: sum((p[k] for k in range(n) if k != i and same[k] == same[i]), np.zeros(2))
        everyone = p.sum(0) - p[i]
        base = (everyone + 1) / (n - 1 + 2)
        parent = (others(domain) + 8 * base) / (sum(d == domain[i] for d in domain) - 1 + 8)
        prior = (others(hosts) + 8 * parent) / (sum(h == hosts[i] for h in hosts) - 1 + 8)
        fused = ll[i] + np.log(prior) + np.log((others(declared) + 1) / (everyone + len(set(declared)))) + np.log((others(suffix) + 1) / (everyone + len(set(suffix))))
        assert got[i]["probability"] == pytest.approx(soft(fused).max(), abs=1e-9) and got[i]["lang"] == ["de", "en"][int(soft(fused).argmax())]
