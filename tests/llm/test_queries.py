"""The registered queries and the pipeline over the smallest tables, against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quantloom.llm import langid, pii, quality, queries
from tests.llm import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def test_pii_query(spark, texts):
    for r in queries.op1_pii(spark, DIR).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii(texts[r.doc_id])[:5]


def test_revealing_terms_of_a_table(spark, texts):
    docs = queries.table(spark, DIR, "documents")
    found = pii.revealing_terms(docs, pii.Disclosure(), "text")
    assert {r.term for r in found[0].collect()} == {*brute.revealing(texts.values())}


def test_language_query(spark, texts):
    t = pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "lang"]).to_pydict()
    lang = dict(zip(t["doc_id"], t["lang"], strict=True))
    rows = queries.op2_language(spark, DIR).collect()
    assert len(rows) == len(lang) and all(r.held_out == brute.held_out(r.doc_id) for r in rows)
    own = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(own) >= 0.95 * len(own)
    # every prediction is the language with the shortest code, text by text
    docs = queries.table(spark, DIR, "documents")
    model = langid.fit_language_model(docs.where(~queries.held_out()))
    for r in rows:
        data = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
        bits = model.bits(data, np.array([0, len(data)]))[0]
        known = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.lang_pred == (model.languages[int(bits.argmin())] if known else "und")
        assert r.score == pytest.approx(1 / sum(2.0 ** max(bits.min() - b, -1000) for b in bits) if known else 0, rel=1e-6)


def test_quality_query(spark, texts):
    t = pq.read_table(f"{DIR}/labels.parquet").to_pydict()
    label = dict(zip(t["doc_id"], t["quality"], strict=True))
    rows = queries.op6_quality(spark, DIR).collect()
    held = [r.predicted == label[r.doc_id] for r in rows if r.doc_id in label and r.held_out]
    assert held and sum(held) >= 0.9 * len(held)
    docs, labels = queries.table(spark, DIR, "documents"), queries.table(spark, DIR, "labels")
    assert all(r.held_out == brute.held_out(r.doc_id) for r in rows) and len(rows) == len(texts)
    # every score, from plain statistics and the model's rules one by one
    model = quality.fit_quality(docs, labels.where(~queries.held_out()))
    for r in rows:
        values = brute.statistics(texts[r.doc_id])
        total = model.bias + sum(w for rule, w in model.rules if all((values[f] > cut) == above for f, above, cut in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9) and r.predicted == int(r.score >= 0.3)


def test_mixing_query(spark, texts):
    rows = queries.op7_mixing(spark, DIR).collect()
    sizes, longest, taken, shortest = {}, {}, {}, {}
    for r in rows:
        assert r.size == len(brute.WORD.findall(texts[r.doc_id] or "")) and r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        shortest[r.source] = min(shortest.get(r.source, 10**9), r.size or 10**9)
    want = brute.targets(sizes)
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) for r in rows)
    # within 1 % or the source's shortest document, where one of its documents is not most of what it has
    assert all(abs(taken[s] - want[s]) <= max(0.01 * want[s], shortest[s]) for s in sizes if 2 * longest[s] < sizes[s]), {s: (taken[s], want[s]) for s in sizes}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op7_mixing(spark, DIR).collect()))


def test_html_query(spark):
    t = pq.read_table(f"{DIR}/pages.parquet").to_pydict()
    want = {i: (u, brute.main_text(h)) for i, u, h in zip(t["page_id"], t["url"], t["html"], strict=True)}
    assert {r.page_id: (r.url, r.text) for r in queries.op4_html(spark, DIR).collect()} == want


def test_url_query(spark):
    t = pq.read_table(f"{DIR}/pages.parquet").to_pydict()
    want = {}
    for i, u in zip(t["page_id"], t["url"], strict=True):
        host, path, best = brute.url(u, queries.URL_RULES)
        want[i] = host, path, best and best[0], best[1] if best else "allow"
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op3_urls(spark, DIR).collect()} == want


def test_join_query(spark, texts):
    want, _ = brute.components(list(texts.items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_jaccard(spark, DIR).collect()} == want


def test_decontamination_query(spark, texts):
    t = pq.read_table(f"{DIR}/benchmark.parquet").to_pydict()
    want = brute.contaminated(texts, [*zip(t["item_id"], t["text"], strict=True)])
    assert {r.doc_id: (r.item_id, r.coverage) for r in queries.op5_decontaminate(spark, DIR).collect()} == {i: (x, pytest.approx(c)) for i, (x, c) in want.items()}


def test_pipeline(spark, texts, tmp_path, monkeypatch):
    docs = queries.table(spark, DIR, "documents")
    columns = docs.columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    label = {r.doc_id: r.quality for r in queries.table(spark, DIR, "labels").collect()}
    items = pq.read_table(f"{DIR}/benchmark.parquet").to_pydict()
    items = [*zip(items["item_id"], items["text"], strict=True)]
    written = {}

    def keep(frame, name):
        frame.write.parquet(str(tmp_path / name))
        written[name] = spark.read.parquet(str(tmp_path / name))
        return written[name]

    monkeypatch.setattr(corpus_pipeline, "materialise", keep)
    assert corpus_pipeline.run(spark, DIR).count() > 0
    monkeypatch.undo()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [x for x in written if x in names] == names
    for name, _ in corpus_pipeline.STAGES:
        before, docs = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, written[name]
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert {*after} <= {*before} <= kept and docs.count() == len(after)
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality":
            assert sum(label[i] == 1 for i in after if i in label) >= 0.95 * sum(label[i] == 1 for i in before if i in label)
            assert all(after[i] == before[i] for i in after)
        elif name == "near_duplicates":
            want, _ = brute.components(list(before.items()))
            assert {*after} == {i for i, (n, c) in want.items() if c == i}
        elif name == "decontaminate":
            assert {*before} - {*after} == {*brute.contaminated(before, items)}
        elif name == "personal_data":
            assert {*after} == {*before}
            # a form can only be left where a check failed
            assert not any(brute.base_spans(t) for t in after.values())
        elif name == "mixing":
            assert all(r.copies >= 1 and r.taken == r.copies * r.size for r in docs.collect())


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a", 0), (None, "", None, None, 0), (2, "w " * 30000, "en", "a", 60000)]])
def test_pipeline_of_odd_tables(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _score int, score int, pii_email int")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, DIR), name)
    assert docs.count() <= len(rows)
