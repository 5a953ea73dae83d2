"""Phrases, toxicity and ranked search against brute force, with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewatch.llm import common, phrases, search, toxicity
from tidewatch.llm.oracle import ORACLE
from tidewatch.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeäß", k=rng.randint(1, 4))) for _ in range(40)]
    rare = lambda: "".join(rng.choices("uvwxyz", k=6))
    fixed = ["one two three", "Four FIVE six", "two three", "é ü\tz"]
    texts = []
    for _ in range(n):
        parts = [rng.choice([*words, *fixed, rare()]) for _ in range(rng.randint(0, 50))]
        texts.append("".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!"]) for p in parts))
    texts += [None, "", " \t\n", "...", "one two three " * 400, "x", texts[3], texts[3], "ZZZ" * 3000, "long " + " ".join(rng.choice(words) for _ in range(20_000))]
    return [(k, t, rng.choice(["en", "de", None, "und"]), None, len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def collocated(rows, least, within, k):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", fold(text)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for size in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(2)) for q, b in found.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (own[p[:c]] * own[p[c:]]), c, own[p[:c]], own[p[c:]]) for c in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("least", "within", "k", "group"), [(10, 50, 2000, None), (3, 50, 2000, 40), (2, 90, 7, 5)])
def test_phrases_equal_brute_force(docs, rows, monkeypatch, least, within, k, group):
    """Also with groups of few suffixes, words extended to the full depth and tasks that send on all the time."""
    if group:
        monkeypatch.setattr(phrases, "GROUP", group)
        monkeypatch.setattr(phrases, "HOT", 30)
        monkeypatch.setattr(phrases, "GATHERED", 500)
    got = phrases.collocations(docs, least, within, k).collect()
    assert sorted(map(tuple, got)) == collocated(rows, least, within, k)
    assert got


def test_phrases_of_nothing_and_repeated_rows(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(none.unionByName(spark.createDataFrame([(1, None, None, None, 0), (2, " .", "en", None, 2)], SCHEMA))).count() == 0
    twice = spark.createDataFrame(rows[:40] * 2, SCHEMA).withColumn("key", F.lit("a")).withColumn("part", F.lit(1))
    assert sorted(map(tuple, phrases.collocations(twice, 4).collect())) == collocated(rows[:40] * 2, 4, 50, 2000)


def test_phrase_keys_are_dealt_again(spark, rows, monkeypatch):
    """A seed under which two words share a key isn't used."""
    keys, seeds = phrases._keys, []

    def poor(raw, at, langs, seed):
        out = list(keys(raw, at, langs, seed))
        if seed == 0:
            out[3] = out[3] % np.uint64(5) + np.uint64(1)
        return out

    monkeypatch.setattr(phrases, "_keys", poor)
    monkeypatch.setattr(phrases, "_filter", lambda *a, f=phrases._filter: seeds.append(a[1]) or f(*a))
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows[:60], SCHEMA), 3).collect())) == collocated(rows[:60], 3, 50, 2000)
    assert seeds == [1]


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", fold(text))


def ranked(docs, items, k):
    import math

    counts = [(d, Counter(terms(t))) for d, t, *_ in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= set(terms(text))
    out = []
    for item, ts in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in ts}
        scored = []
        for d, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "block", "cells", "asked"), [(50, 48, 16_000_000, 4096), (5, 3, 1000, 4096), (3, 4, 64, 20), (1, 1, 16_000_000, 1)])
def test_search_equals_brute_force(spark, docs, rows, monkeypatch, k, block, cells, asked):
    """Also in small shards and blocks, and for items in several blocks of terms."""
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "CELLS", cells)
    rng = random.Random(1)
    items = [(i, " ".join(rng.sample((rows[i * 7][1] or "x").split() or ["y"], k=min(6, len((rows[i * 7][1] or "x").split() or ["y"]))))) for i in range(15)]
    items += [(100, None), (101, ""), (102, "..."), (103, "nowhere unseen"), (104, "ONE one two"), (104, "three"), (None, "six"), (105, rows[155][1])]
    got = search.search(docs, spark.createDataFrame(items, "item_id long, text string"), k, asked).collect()
    assert sorted(map(tuple, got), key=str) == ranked(rows, items, k)


def test_search_of_nothing_ties_and_repeated_rows(spark):
    none, item = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert search.search(none, item).count() == 0 and search.search(none, item).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(item.withColumnRenamed("item_id", "doc_id"), item.where("false")).count() == 0
    rows = [(k % 40, "a x y" if k % 2 else "b x", None, None, 0) for k in range(120)] + [(None, "a x y", None, None, 0), (7, "q r s t", None, None, 0)]
    own = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("s")).withColumn("rank", F.lit(0)).repartition(6)
    got = search.search(own, item.withColumn("doc_id", F.lit(1)), 9).collect()
    assert sorted(map(tuple, got), key=str) == ranked(rows, [(1, "a b c")], 9)


def test_bounds_skip_blocks_and_lose_nothing():
    """Blocks are skipped, whatever the score needed at first, and the best stay the best."""
    rng = np.random.default_rng(2)
    matrix = np.where(rng.random((400, 30)) < 0.2, rng.integers(1, 10**6, (400, 30)), 0).astype(np.float32)
    weights, ids = rng.integers(1, 9000, 30).astype(float), rng.permutation(400)
    asked = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(40)]
    with_ = [np.unique(np.concatenate([a for a in asked if t in a] or [np.zeros(0, np.int64)])) for t in range(30)]
    shard = search.Shard(ids, matrix, with_)
    looked = []
    of = shard.of
    shard.of = lambda t: looked.append(t) or of(t)
    for terms_ in asked:
        full = (matrix[:, terms_].astype(float) @ weights[terms_]).astype(np.int64)
        best = sorted(zip(-full, ids, strict=True))[:10]
        for need in (0, int(-best[-1][0])):
            found, scores, _ = shard.search(terms_, weights[terms_], 10, need, np.zeros(0, np.int64), np.zeros(0, np.int64))
            assert sorted(zip(-scores, found, strict=True)) == best
    assert len(looked) < 2 * 40 * 8


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    bad = ["grubble", "snarkish", "zonkhead"]
    rows, labels = [], []
    for k in range(900):
        ws = rng.choices(plain, k=rng.randint(5, 120))
        toxic = int(k % 6 == 0)
        for _ in range(toxic * rng.randint(1, 4)):
            ws.insert(rng.randrange(len(ws) + 1), rng.choice(bad) + rng.choice(["", ",", "."]))
        rows.append((k, " ".join(ws), None, None, 0))
        labels.append((k, 1, toxic))
    rows += [(9001, None, None, None, 0), (9002, "", None, None, 0), (9003, "x" * 50_000, None, None, 0), (9004, rows[0][1], None, None, 0), (None, rows[0][1], None, None, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6), spark.createDataFrame([*labels, (None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int"), rows, labels


def test_toxicity_is_learnt_from_text(labelled, spark):
    docs, labels, rows, known = labelled
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs.withColumn("score", F.lit("old")), model).select("doc_id", "text", "score", toxicity.held_out().alias("held")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    score = {r.doc_id: r.score for r in out}
    held = [(score[k], t) for k, _, t in known if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 150 and all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([(s >= 0.3) == (t == 1) for s, t in held]) > 0.97
    assert score[9001] == score[9002] < 0.3 and score[9003] < 0.3
    by_text = defaultdict(set)
    for r in out:
        by_text[r.text or ""].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert len(model.dictionaries.toxic) + len(model.dictionaries.ordinary) < 1 << 16
    # labels of held-out rows and other columns change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    again = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("lang", F.lit("en")), toxicity.train(docs.withColumn("lang", F.lit("en")), flipped)).collect()}
    assert again == score


def test_toxicity_scores_are_those_of_single_windows(labelled):
    """Features from windows compressed one by one."""
    docs, labels, rows, _ = labelled
    model = toxicity.train(docs, labels)
    d = model.dictionaries
    one = [zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for x in (d.ordinary, d.toxic)]
    for text in [rows[k][1] for k in (0, 6, 7, 12)] + ["", "a", "Grubble\nX " * 40, "y" * 9000]:
        raw = b" " + re.sub(rb"[ \t-\r]", b" ", fold(text).encode())
        starts, last = [0], 0
        for m in re.finditer(rb"(?<= )[^ ]+", raw):
            at = m.start() - 1
            if at // toxicity.WINDOW != last // toxicity.WINDOW:
                starts.append(at)
            last = at
            starts += range(m.start() + toxicity.LONG, m.end(), toxicity.LONG)
        starts = sorted(set(starts))
        saved = sorted((max(0, len(one[0].compress(w)) - len(one[1].compress(w))) for w in (raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True))), reverse=True)
        body = np.frombuffer(text.encode(), np.uint8)
        got = toxicity.features(d, body, np.array([0, len(body)]))[0]
        assert got[:3].tolist() == [*saved[:3], 0, 0, 0][:3] and got[3] == pytest.approx(np.log(len(starts)))


def test_toxicity_without_labels(labelled, spark):
    docs, labels, *_ = labelled
    assert toxicity.train(docs, labels.where("false")) == 0.0
    assert toxicity.train(docs.where("false"), labels) == pytest.approx(150 / 900, abs=0.05)
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    none = toxicity.score(docs.where("false"), toxicity.train(docs, labels))
    assert none.count() == 0 and none.columns[-1] == "score"


def test_words_of_any_length_in_bounded_steps(monkeypatch):
    """Words and hashes are the same wherever a step ends."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        texts = [bytes(rng.choice(list(b"abA  \n."), rng.integers(0, 30)).astype(np.uint8)) for _ in range(rng.integers(0, 6))]
        raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        seen = []
        for step in (1 << 18, 8, 9, 64):
            monkeypatch.setattr(common, "STEP", step)
            starts, ends, of, hashes = common.word_hashes(raw, at, fold=True, lanes=2)
            seen.append([starts.tolist(), ends.tolist(), of.tolist(), *(h.tolist() for h in hashes), *(common.rolling(hashes[0], w).tolist() for w in (1, 3))])
        assert all(s == seen[0] for s in seen)
        words = [w for t in texts for w in t.split()]
        assert [bytes(raw[a:b]) for a, b in zip(seen[0][0], seen[0][1], strict=True)] == words
        by_word = defaultdict(set)
        for w, h in zip(words, seen[0][3], strict=True):
            by_word[w.lower()].add(h)
        assert all(len(h) == 1 for h in by_word.values())


@pytest.mark.parametrize("name", ["op11_phrases", "op13_search"])
def test_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    own, sql = QUERIES[name](spark, sf_dir), con.sql(ORACLE[name])
    assert sorted(map(tuple, own.select(sql.columns).collect())) == sorted(sql.fetchall())


def test_toxicity_query_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    got = QUERIES["op12_toxicity"](spark, path).join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.predicted == r.toxic for r in held]) > 0.88
