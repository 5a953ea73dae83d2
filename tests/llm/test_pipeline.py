"""Each stage of the pipeline by itself against brute force, on small tables with nulls, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_corpus import SCHEMA, corpus, shingles
from tidewatch.llm import mixing, quality
from tidewatch.llm.queries import DOMAIN, WEIGHTS, vocabulary_text

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    own = corpus(3)
    own += [(900, "a line of words\n\nshared one\nshared two\n", "en", "src7", 0), (901, "shared one\nshared two\nnot shared\n\n", "de", None, 0), (902, "shared two\n", None, "src7", 0)]
    return own


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """A folder with the labels that the quality stage reads."""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame([(k, k % 3 % 2, 0) for k, *_ in rows if k < 60] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables_stay_empty(spark, docs, folder, name):
    out = STAGES[name](spark, docs.where("false"), folder)
    assert out.count() == 0 and (name == "bpe" or out.columns == corpus_pipeline.COLUMNS)


@pytest.mark.parametrize("name", list(STAGES))
def test_other_columns_change_nothing(spark, rows, folder, name):
    few = spark.createDataFrame(rows[:40], SCHEMA)
    more = few.selectExpr("*", "'x' as score", "7 as epoch", "1 as n_removed", "'y' as ids", "true as kept")
    assert sorted(map(str, STAGES[name](spark, more, folder).collect())) == sorted(map(str, STAGES[name](spark, few, folder).collect()))


def test_quality_keeps_what_votes_for_it(spark, docs, rows, folder):
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = []
    for k, t, *_ in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        own = model.latent(quality.counts(raw, np.array([0, len(raw)])))[0]
        cosine = np.array([float(np.dot(own.astype(float), v)) for v in model.vectors.astype(float)])
        near = np.argsort(-cosine, kind="stable")[:9]
        weight = np.maximum(cosine[near], 0) ** 4
        score = float((weight * model.labels[near]).sum() / weight.sum()) if weight.sum() > 1e-9 else model.prior
        if abs(score - 0.3) > 1e-3:
            want.append((k, score >= 0.3))
    got = {r.doc_id for r in STAGES["quality"](spark, docs, folder).collect()}
    assert len(want) > 50 and all((k in got) == kept for k, kept in want)


def test_line_dedup_deletes_later_copies(spark, docs, rows, folder):
    seen, want = set(), {}
    for k, t, lang, source, n in sorted(rows):
        if t is None:
            continue
        own, gone = t.split("\n"), set()
        for size in (1, 2):
            for i in range(len(own) - size + 1):
                run = tuple(own[i : i + size])
                if size == 1 and not re.search(r"[^\x20\x09-\x0D]", own[i]):
                    continue
                if run in seen:
                    gone |= set(range(i, i + size))
                seen.add(run)
        kept = [x for i, x in enumerate(own) if i not in gone]
        if kept:
            text = "\n".join(kept)
            want[k] = (text, lang, source, len(text) if gone else n)
    got = {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in STAGES["line_dedup"](spark, docs, folder).collect()}
    assert got == want


def test_near_duplicates_leaves_one_of_each_group(spark, docs, rows, folder):
    sets = {k: shingles(t, 5) for k, t, *_ in rows}
    parent = {k: k for k in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    nameless = spark.createDataFrame([(None, rows[0][1], "en", "src0", 1)] * 2, SCHEMA)
    got = STAGES["near_duplicates"](spark, docs.unionByName(docs.where("doc_id = 3")).unionByName(nameless), folder).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted([str(k) for k in sets if root(k) == k] + ["None", "None"])
    assert {r.doc_id: r.text for r in got if r.doc_id is not None} == {k: t for k, t, *_ in rows if root(k) == k}


def test_mixing_takes_each_leaf_by_its_weight(spark, docs, rows, folder):
    size = lambda t: len((t or "").encode().split())
    domain = {r.doc_id: r.d for r in docs.selectExpr("doc_id", f"{DOMAIN} as d").collect()}
    leaf = {k: (domain[k], lang or "", source or "") for k, _, lang, source, _ in rows}
    held = Counter()
    for k, t, *_ in rows:
        held[leaf[k]] += size(t)
    plan = mixing.budgets(dict(held), WEIGHTS, 0.9 * sum(held.values()), 1)
    want = []
    for path, left in plan.items():
        for _, k, n in sorted((hashlib.md5(f"3|0|{k}".encode()).hexdigest(), k, size(t)) for k, t, *_ in rows if leaf[k] == path):
            if n > left:
                break
            left -= n
            want.append(k)
    assert sorted(r.doc_id for r in STAGES["mixing"](spark, docs, folder).collect()) == sorted(want)


def test_bpe_equals_the_library(spark, docs, rows, folder):
    library = Tokenizer.from_str(vocabulary_text())
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.exact) for r in STAGES["bpe"](spark, docs, folder).collect()}
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k] == (ids, len(ids), True)


def test_stages_follow_each_other(spark, sf_dir):
    """run() is its stages one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), out.schema)
    key = lambda r: (r.doc_id, r.n_tokens, bytes(r.ids))
    mine, theirs = sorted(map(key, docs.collect())), sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect()))
    assert mine and mine == theirs
