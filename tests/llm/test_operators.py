"""Every operator against its plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import chat, decontaminate, htmlextract, jaccard, kernels, langid, mixing, pii, quality, queries, repetition, urlfilter
from quantloom.llm.components import connected_components
from tests.llm import brute

DOC = "doc_id long, text string, id long, n long, token string, fp long, source string, lang string"


def frame(spark, texts, sources=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i, t, 7, 7, "x", 7, sources[i] if sources else "s", "xx") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# kernels


def test_words_match_plain_split():
    import pyarrow as pa

    texts = ["a b  c", None, "", " \t\n", "é\u00a0x y\x0bz\r\n q", "word " * 5000]
    seen = []
    for rows, t in kernels.chunks(pa.array(texts), 40):
        w = t.words("space")
        for d in range(len(t)):
            seen.append([bytes(t.data[a:b]).decode() for a, b in zip(w.starts[w.bounds[d] : w.bounds[d + 1]], w.ends[w.bounds[d] : w.bounds[d + 1]], strict=True)])
    assert seen == [brute.WORD.findall(t or "") for t in texts]


def test_sliced_arrow_columns():
    import pyarrow as pa

    column = pa.array(["no", "a b", None, "c"]).slice(1)
    assert [int(c) for _, t in kernels.chunks(column) for c in t.words().counts] == [2, 0, 1]


# 1 personal data

PII_TEXTS = [
    "mail bob.x@a-b.example.org, or a@b c@d.e_f@g.h now", None, "", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.4", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "5500000000000004 340000000000009 1234",
    "call +49 (30) 1234567, +1 2 or +123456789012345678", "é😀 x@y.z +44 20 7946 0958 é 10.0.0.1", "@" * 50 + "a." * 3000 + "x@" + "b." * 3000 + "c", "1-" * 3000 + "7", "a@b.c" * 40,
]


def test_base_spans(spark):
    rows = pii.span_digest(pii.find_personal_data(frame(spark, PII_TEXTS))).orderBy("doc_id").collect()
    for r, text in zip(rows, PII_TEXTS, strict=True):
        want = brute.pii(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[:5], text


def test_many_spans_in_one_text(spark):
    text = " é ".join(f"u{i}@h{i}.org" for i in range(1500))
    row = pii.span_digest(pii.find_personal_data(frame(spark, [text]))).first()
    assert row.base_sha256 == brute.pii(text)[4]


def test_revealing_terms_are_found_and_removed(spark):
    rng = random.Random(1)
    texts = [f"{words(rng, 6)} Zorblatt {rng.randrange(10**6)} ann@corp.example {words(rng, 6)}" for _ in range(6)]
    texts += [words(rng, 40) for _ in range(60)] + ["today Zorblatt came alone"]
    found = pii.find_personal_data(frame(spark, texts))
    rows = {r.doc_id: r for r in found.collect()}
    last = len(texts) - 1
    assert [s.value for s in rows[last].pii_term] == ["Zorblatt"]
    assert all(not rows[i].pii_term for i in range(6, last))
    assert rows[last].pii_term[0].start == 6
    clean = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert clean[last] == "today  came alone"
    assert "[EMAIL]" in clean[0] and "ann@" not in clean[0] and "Zorblatt" not in clean[0]


def test_terms_of_rare_entities(spark):
    rng = random.Random(4)
    # each email occurs once: one name stands far from several of them, another beside its only one, a third in copies of one text
    texts = [f"{words(rng, 30)} Zorblatt {words(rng, 30)} u{i}@h{i}.example {words(rng, 9)}" for i in range(6)]
    texts += [f"{words(rng, 9)} Quibbly solo@only.example {words(rng, 9)}"]
    texts += [f"Farspoken {words(rng, 40)} copy@only.example"] * 5
    texts += [words(rng, 40) for _ in range(300)] + ["today Zorblatt came alone"]
    terms = pii.revealing_terms(frame(spark, texts), pii.Disclosure(), "text")[0]
    assert {r.term for r in terms.collect()} == {"zorblatt", "quibbly"}
    found = {r.doc_id: [s.value for s in r.pii_term] for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert {i for i, v in found.items() if v == ["Zorblatt"]} == {*range(6), len(texts) - 1} and found[6] == ["Quibbly"]


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_disclosure_matches_brute_force(spark, threshold):
    rng = random.Random(22)
    people = [(f"name{i}", f"u{i}@h{i}.example") for i in range(8)]
    texts = []
    for _ in range(160):
        name, mail = rng.choice(people) if rng.random() < 0.4 else ("", "")
        parts = [words(rng, rng.randrange(1, 14), 60), rng.choice([name, name.upper()]), mail, rng.choice(["10.0.0.%d" % rng.randrange(300), f"key {rng.getrandbits(120):x}", "", "", "4111 1111 1111 1111 then +49 30 1234567"]), words(rng, rng.randrange(14), 60), rng.choice(["", name])]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += texts[:20] + [None, "", "Ünïcode name1 u1@h1.example ÉTÉ"]
    found = pii.revealing_terms(frame(spark, texts), pii.Disclosure(threshold=threshold), "text")[0]
    want = brute.revealing(texts, threshold)
    assert {r.term: r.disclosure for r in found.collect()} == pytest.approx(want, abs=1e-9) and len(want) > 5


def test_secrets_are_found_by_their_information(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'say token = "{key}"$$$ de', "a" * 30 + "1", "1234567890" * 4, "x-" * 30, f"{key}@mail.example.com", "plain words of a clean text", f"é😀 {key[:20]}, {key[:19]}"]
    found = {r.doc_id: [(s.value, s.start) for s in r.pii_secret] for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert found == {0: [(key, 13)], 1: [], 2: [], 3: [], 4: [], 5: [], 6: [(key[:20], 3)]}
    clean = {r.doc_id: r.text for r in pii.redact(pii.find_personal_data(frame(spark, texts))).collect()}
    assert clean[0] == 'say token = "[SECRET]"$$$ de' and clean[5] == texts[5]


def test_personal_data_of_odd_tables(spark):
    docs = frame(spark, ["mail a@b.example now", "word " * 60000 + "a@b.example"]).withColumns({"pii_email": F.lit("clash"), "n_email": F.lit(9), "spans": F.lit("x"), "value": F.lit(1)})
    rows = pii.span_digest(pii.find_personal_data(docs)).collect()
    assert [r.n_email for r in rows] == [1, 1]
    assert pii.find_personal_data(docs.where("false")).count() == 0
    assert pii.redact(pii.find_personal_data(docs)).columns == [c for c in docs.columns if c != "pii_email"]


def test_redaction_of_overlapping_spans(spark):
    texts = ["x +49 10.0.0.1 55 y", None, "n"]
    out = [r.text for r in pii.redact(pii.find_personal_data(frame(spark, texts))).orderBy("doc_id").collect()]
    assert out[1:] == [None, "n"] and "10.0" not in out[0] and out[0].startswith("x [PHONE]")


# 2 languages


def test_language_model(spark):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    texts = [make("abcde") if i % 2 else make("vwxyzé") for i in range(60)]
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "one").otherwise("two"))
    model = langid.fit_language_model(docs)
    new = frame(spark, [make("abcde"), make("vwxyzé"), None, "", "123 456", "É" * 30, "a"])
    out = langid.identify_language(new, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out][:5] == ["one", "two", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in out) and out[2].score == 0
    none = langid.fit_language_model(docs.where("false"))
    assert {r.lang_pred for r in langid.identify_language(new, none).collect()} == {"und"}


def test_code_lengths_match_the_definition():
    rng = random.Random(12)
    # 90 symbols, so that no small alphabet is enough
    texts = {lang: ["".join(chr(rng.choice(range(33, 65)) if rng.random() < 0.3 else 97 + rng.randrange(4 + i)) for _ in range(120)) for _ in range(3)] for i, lang in enumerate("xy")}
    texts["y"].append("".join(map(chr, [*range(33, 65), *range(91, 127)])))
    fold = lambda t: langid.FOLD[np.frombuffer(t.encode(), np.uint8)]
    model = langid.train([(lang, fold(t)) for lang, many in texts.items() for t in many], order=2)
    known = sorted({x for many in texts.values() for t in many for x in fold(t)})
    asked = ["abab!ab~z\x7fé", "", "a", texts["x"][0][:50], "zzzz"]
    data, offsets = np.concatenate([fold(t) for t in asked]), np.cumsum([0] + [len(fold(t)) for t in asked])
    bits = model.bits(data, offsets)
    symbol = lambda t: [x if x in known else "new" for x in fold(t)]
    for i, lang in enumerate("xy"):
        for t, got in zip(asked, bits[:, i], strict=True):
            want = brute.context_bits(([symbol(x) for x in texts[lang]], [*known, "new"]), symbol(t), 2)
            assert got == pytest.approx(sum(want), rel=1e-4, abs=1e-4), (lang, t)


def test_long_texts_are_coded_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 105, 3000).astype(np.uint8)
    model = langid.train([("x", data), ("y", data[::-1][:500])])
    offsets = np.array([0, 0, 700, 701, 701, 2600, 3000])
    whole = model.bits(data, offsets)
    monkeypatch.setattr(langid, "PART", 64)
    assert np.allclose(whole, model.bits(data, offsets), rtol=1e-5) and not whole[0].any()
    monkeypatch.setattr(langid, "DIRECT", 1)
    model.direct.clear()
    assert np.allclose(whole, model.bits(data, offsets), rtol=1e-5)


def test_language_of_odd_tables(spark):
    docs = frame(spark, ["abc " * 60000, "xyz"] + ["abc"] * 3).withColumn("lang", F.lit("one"))
    model = langid.fit_language_model(docs)
    assert langid.identify_language(docs.where("false"), model).count() == 0
    assert {r.lang_pred for r in langid.identify_language(docs, model).collect()} == {"one"}


# 3 urls

URLS = ["HTTP://WWW.Example.COM/en/7x?q", "https://example.com/en/8", "https://a.example.net/de/8/1#t", "http://b.net/de/", "http://xnet/de/1", "ftp://h.org/es/#", "http://h.org", None, "", "no-scheme", "://only/en/", "http://a://b/c", "http://x.com?en/1"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, rule string, fit string")
    for r, u in zip(urlfilter.judge_urls(pages, queries.URL_RULES).orderBy("page_id").collect(), URLS, strict=True):
        host, path, best = brute.url(u, queries.URL_RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0], best[1] if best else "allow"), u


def test_columns_of_pages_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/", "x", "mine", "too", 5)], "page_id long, url string, html string, fit string, by_link string, host int")
    out = urlfilter.judge_urls(pages, queries.URL_RULES)
    assert out.select("fit", "by_link", "host", "verdict").first() == ("mine", "too", "a.com", "block")
    assert urlfilter.judge_urls(pages.where("false"), queries.URL_RULES).count() == 0


def test_distrust_goes_against_links(spark):
    link = lambda *hosts: "".join(f'<a class=x href="http://{h}/p">t</a>' for h in hosts)
    rows = [(0, "http://bad.com/en/1", ""), (1, "http://farm.org/x", link("bad.com", "bad.com")), (2, "http://hub.org/y", link("good.net")), (3, "http://good.net/de/1", link("friend.org")), (4, "http://friend.org/z", link("good.net"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.host: r.verdict for r in urlfilter.judge_urls(pages, queries.URL_RULES).collect()}
    assert out == {"bad.com": "block", "farm.org": "block", "hub.org": "allow", "good.net": "allow", "friend.org": "allow"}


def test_ranks_match_their_sql(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(19)
    hosts = [f"h{i}.com" for i in range(12)] + [f"h{i}.org" for i in range(12)] + [f"h{i}.net" for i in range(6)]
    rows = []
    for i in range(150):
        host = rng.choice(hosts)
        links = "".join(f'<A class=x HREF={rng.choice(["", chr(39)])}{rng.choice(["http://", "//", "https://"])}{rng.choice(hosts).upper()}/p>t</a>' for _ in range(rng.randrange(4)))
        rows.append((i, rng.choice([f"http://{host}/{rng.choice(['en', 'de', 'es', 'fr'])}/1", None, "none"]) if i % 5 == 0 else f"http://{host}/{rng.choice(['en', 'de', 'es', 'fr'])}/{i}", links or None))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    base = duckdb.connect()
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841
    base.execute("CREATE TABLE pages AS SELECT page_id, url, html FROM pages")
    want = {r[0]: r[1:] for r in base.execute(queries.ORACLE_SQL["op3_urls"]).fetchall()}
    assert got == want
    by_link = [v for _, _, rule, v in got.values() if rule is None]
    assert by_link.count("block") > 3 and by_link.count("allow") > 3


# 4 html


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<nav>menu</nav><article><h1>T &amp;\n t</h1><p>One <b>two</b><br>three<p>four</article><footer>f</footer>", "T & t\n\nOne two three\n\nfour"),
        ("<div class='sidebar'>side</div><div id=content><p>Long text of the main part here.</p><p>More of the same text.</p></div><div class='comments'><p>Nice one, a long comment it is.</p></div>", "Long text of the main part here.\n\nMore of the same text."),
        ("<article><p>abc &eacute;&#8364; d</p><form>x<input>y</form><script>var a='</p>';</script><style>p{}</style><p>end</p></art", "abc é€ d\n\nend"),
        ("<div><h1 class=header>Title</h1><div class='post'><p>Some long text stands here.</p><p>And more of it.</p></div></div><div class='related-posts'>Other</div>", "Title\n\nSome long text stands here.\n\nAnd more of it."),
        ("<header>site</header><main><header><h1>Head</h1></header><p>body text</p></main>", "Head\n\nbody text"),
    ],
)
def test_extraction(html, text):
    assert htmlextract.extract(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><div><section><p>Sixty parts of the text stand in here.</p></section><section><p>And forty parts of it here.</p></section></div></body>", "Sixty parts of the text stand in here.\n\nAnd forty parts of it here."),
        ("<body><div id=a>" + "".join(f"<div class=row><div class=col><p>Paragraph {i} of the text stands here.</p></div></div>" for i in "123") + "</div></body>", "\n\n".join(f"Paragraph {i} of the text stands here." for i in "123")),
        ("<article><p>The first article of the page.</p></article><article><p>The second article of it.</p></article>", "The first article of the page.\n\nThe second article of it."),
        ("<html><head><meta charset=x><title>t</title><body><p>Text of the body.</p></body></html>", "Text of the body."),
        ("<head><title>t</title><p>Text without a body tag.</p>", "Text without a body tag."),
    ],
)
def test_all_content_lines_stay(html, text):
    assert htmlextract.extract(html) == text


ARTICLE = "<h1>Title of it</h1><p>Some long text of the article stands here.</p><p>And more of the same text follows.</p>"


@pytest.mark.parametrize("name", ["layout no-sidebar", "page with-header", "post share-enabled", "sidebar-left", "has-menu search", "content"])
def test_names_of_wrappers_do_not_count(name):
    want = "Title of it\n\nSome long text of the article stands here.\n\nAnd more of the same text follows."
    for html in (f"<body><div class='{name}'>{ARTICLE}</div></body>", f"<body><div id='{name}'><div class=x>{ARTICLE}</div><div class='post-comments'><p>{'A long comment of a reader. ' * 30}</p></div></div></body>"):
        assert htmlextract.extract(html) == want


@pytest.mark.parametrize(
    "noise",
    [
        "<div class='site-header'>Name of the site</div>", "<div id=cookieNotice><p>We use cookies on this page, and this notice is long. " + "Text of it. " * 30 + "</p></div>", "<ul class='main-menu'><li>one<li>two</ul>",
        "<section id=comments><article class=comment><p>" + "What a reader says here. " * 20 + "</p></article></section>", "<aside>side</aside>", "<div role=navigation>go</div>", "<div class='ad-banner'>buy</div>",
    ],
)
def test_noise_goes(noise):
    want = "Title of it\n\nSome long text of the article stands here.\n\nAnd more of the same text follows."
    assert htmlextract.extract(f"<body>{noise}<div class=post>{ARTICLE}</div></body>") == want
    assert htmlextract.extract(f"<body><article>{ARTICLE}</article>{noise}</body>") == want


def test_deep_and_long_pages_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        assert htmlextract.extract("<div>" * n + "text of the page" + "</div>" * n) == "text of the page"
        assert htmlextract.extract("<b>" * n + "<p>x</p></i>" * n).count("x") == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def test_extraction_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a  b</p>"), (1, "u", "<p>a  b</p>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert [tuple(r) for r in htmlextract.extract_main_text(pages, keep=("url",)).orderBy("page_id").collect()] == [(1, "u", "a b"), (1, "u", "a b"), (2, None, "")]
    assert htmlextract.extract_main_text(pages.where("false")).count() == 0


# 5 decontamination


def test_tiles_catch_reordered_passages(spark):
    rng = random.Random(3)
    first, second, other = words(rng, 20, 10**6), words(rng, 20, 10**6), words(rng, 40, 10**6)
    bench = spark.createDataFrame([(1, f"{first}. {second}!"), (2, "only four words here"), (3, None), (4, ""), (5, other)], "item_id long, text string")
    texts = [f"x {second.upper()} y, {first} z", f"{first} {words(rng, 30)}", "so Only FOUR words, here it is", None, "", words(rng, 300), " ".join(other.split()[:12]), other]
    found = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert set(found) == {(0, 1), (1, 1), (2, 2), (7, 5)} and found[0, 1] == 1.0 and found[1, 1] == 0.5
    kept = decontaminate.without_contaminated(frame(spark, texts), bench)
    assert kept.columns == frame(spark, texts).columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(frame(spark, texts), bench.where("false")).count() == 0


def test_blocks_of_passages_give_the_same(spark):
    rng = random.Random(4)
    items = [words(rng, 25, 10**6) for _ in range(12)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    docs = frame(spark, [f"{words(rng, 20)} {t}" for t in items])
    one = decontaminate.contaminated(docs, bench).collect()
    many = decontaminate.contaminated(docs, bench, decontaminate.Tiling(block_bytes=600)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 12


def test_tokens_of_all_scripts(spark):
    quoted, russian, chinese = "he said the quick brown fox is here again", "съешь ещё этих мягких французских булок да выпей чаю", "天地玄黄宇宙洪荒日月盈昃"
    bench = spark.createDataFrame([(1, quoted), (2, russian), (3, chinese), (3, chinese), (4, "café résumé naïve façade élan")], "item_id int, text string").withColumn("coverage", F.lit("clash"))
    texts = ["“He said—the ‘quick’ brown\u00a0fox is here again”…", russian.upper(), f"在{chinese}中", "Cafe\u0301 RE\u0301SUME\u0301 nai\u0308ve fac\u0327ade e\u0301lan", "nothing of it"]
    found = {(r.doc_id, r.item_id, r.coverage) for r in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert found == {(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)}


@pytest.mark.parametrize("common", [0, 3, 64])
def test_whole_operator_matches_brute_force(spark, common):
    rng = random.Random(common)
    opening, licence = words(rng, 6, 10**6), words(rng, 30, 10**6)
    items = [f"{opening} {words(rng, rng.randrange(1, 12), 10**6)}" for _ in range(12)] + [f"{licence} {words(rng, rng.randrange(40), 10**6)}" for _ in range(12)] + [words(rng, 30, 6) for _ in range(4)]
    items += [items[0], "two words", "", None]
    texts = [rng.choice([opening, licence, " ".join(licence.split()[:18]), rng.choice([x for x in items if x]), words(rng, 20, 6)]) + " " + words(rng, rng.randrange(30), 10**6) + " " + rng.choice(items[:26]) [: rng.randrange(90)] for _ in range(60)]
    texts += [None, "", "so two words"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute.contaminated(dict(enumerate(texts)), list(enumerate(items)))
    got = {r.doc_id: (r.item_id, r.coverage) for r in decontaminate.contaminated(frame(spark, texts), bench, decontaminate.Tiling(common=common)).collect()}
    # where common parts alone are met the passage is another one that is covered as much
    assert {i: c for i, (_, c) in got.items()} == pytest.approx({i: c for i, (_, c) in want.items()}) and len(want) > 20
    assert all(brute.tiled(brute.tokens(texts[i]), p := brute.tokens(items[x]), min(5, len(p))) / len(p) == pytest.approx(c) for i, (x, c) in got.items())
    small = decontaminate.Tiling(common=common, block_bytes=600)
    assert {r.doc_id: r.coverage for r in decontaminate.contaminated(frame(spark, texts), bench, small).collect()} == pytest.approx({i: c for i, (_, c) in want.items()})
    kept = decontaminate.without_contaminated(frame(spark, texts), bench, small)
    assert {r.doc_id for r in kept.collect()} == {*range(len(texts))} - {*want} and kept.columns == frame(spark, texts).columns


def test_common_openings_are_not_expanded(spark):
    import time

    rng = random.Random(5)
    opening = words(rng, 5, 10**6)
    bench = spark.createDataFrame([(i, f"{opening} {words(rng, 4, 10**6)}") for i in range(3000)], "item_id long, text string")
    docs = frame(spark, [f"{opening} " * 200, "a b c"])
    began = time.perf_counter()
    assert [r.doc_id for r in decontaminate.contaminated(docs, bench).collect()] == [0]
    assert time.perf_counter() - began < 20


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six"), (None, "un deux trois quatre cinq six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "un deux trois quatre cinq six"), (2, "word " * 60000)], "doc_id long, text string")
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 1, 1.0), (None, None, 1.0)}
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


def test_greedy_tiling_matches_brute_force():
    rng = np.random.default_rng(5)

    def brute_tiles(text, passage, k):
        used_t, used_p = np.zeros(len(text), bool), np.zeros(len(passage), bool)
        while True:
            best = (k - 1, 0, 0)
            for p in range(len(passage)):
                for t in range(len(text)):
                    n = 0
                    while p + n < len(passage) and t + n < len(text) and passage[p + n] == text[t + n] and not used_p[p + n] and not used_t[t + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, p, t)
            if best[0] < k:
                return int(used_p.sum())
            n, p, t = best
            used_p[p : p + n] = used_t[t : t + n] = True

    for _ in range(40):
        text, passage, k = rng.integers(0, 4, 40), rng.integers(0, 4, 20), 3
        seeds = np.array([(t, p) for t in range(len(text) - k + 1) for p in range(len(passage) - k + 1) if (text[t : t + k] == passage[p : p + k]).all()]).reshape(-1, 2)
        if len(seeds):
            assert decontaminate.tile(text, passage, seeds, k) == brute_tiles(text, passage, k)


# 6 quality


def test_rules_learn_and_compile(spark):
    rng = random.Random(6)
    texts = [words(rng, 60) + "." if i % 3 else " | ".join(f"t{rng.randrange(99)}" for _ in range(60)) for i in range(150)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 150, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    out = quality.score_quality(docs, model, keep=["doc_id"]).collect()
    assert all((r.score >= 0.3) == bool(r.doc_id % 3) for r in out)
    assert 0 < len(model.rules) < 60
    odd = quality.score_quality(frame(spark, [None, "", "a " * 50000]), model)
    assert all(0 <= r.score <= 1 for r in odd.collect()) and odd.columns[:-1] == docs.columns
    empty = quality.fit_quality(docs, labels.where("false"))
    assert quality.score_quality(docs, empty).first().score == pytest.approx(0.5)
    again = docs.where("doc_id = 0").crossJoin(spark.range(500).select(F.lit(1))).select(docs.columns)
    assert quality.fit_quality(docs.unionByName(again), labels) == model
    one = quality.fit_quality(docs, labels.where("quality = 1"))
    assert quality.score_quality(docs, one).first().score > 0.99


def test_statistics_match_plain_ones():
    import pyarrow as pa

    rng = random.Random(16)
    texts = [None, "", "a", "One two two | THREE!\n\none two two | THREE!\nx, y; z", "é ü\u00a0#9 $", "same\n" * 40, "long " * 30000, *(words(rng, rng.randrange(1, 80), 20).replace(" ", rng.choice([" ", "\n", "  "])) for _ in range(30))]
    got = np.concatenate([quality.statistics(t) for _, t in kernels.chunks(pa.array(texts), 200)])
    assert np.allclose(got, [brute.statistics(t) for t in texts])


def test_scores_match_the_rules(spark):
    rng = random.Random(17)
    texts = [words(rng, rng.randrange(5, 90), 300) + rng.choice(["", "!", " | |", "."]) for _ in range(200)] + [None, ""]
    docs = frame(spark, texts)
    model = quality.fit_quality(docs, spark.createDataFrame([(i, int(len((texts[i] or "").split()) > 40)) for i in range(150)], "doc_id long, quality int"))
    for r in quality.score_quality(docs, model, keep=["doc_id"]).collect():
        values = brute.statistics(texts[r.doc_id])
        total = model.bias + sum(w for rule, w in model.rules if all((values[f] > cut) == above for f, above, cut in rule))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-9)


def test_weights_minimise_the_penalised_loss():
    rng = np.random.default_rng(18)
    x = rng.normal(size=(300, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=300) > 0).astype(float)
    how = quality.RuleFit(trees=5, steps=3000)
    model = quality.fit_rules(x, y, how)
    held = np.array([quality._holds(x, r) for r, _ in model.rules]).T.astype(float)
    weights, scale = np.array([w for _, w in model.rules]), np.sqrt(np.maximum(held.mean(0) * (1 - held.mean(0)), 1e-3))
    gap = 1 / (1 + np.exp(-(held @ weights + model.bias))) - y
    # at the minimum each kept rule's gradient balances the penalty and the bias has none
    assert gap.mean() == pytest.approx(0, abs=1e-4)
    assert np.allclose(held.T @ gap / len(y) / scale, -how.penalty * np.sign(weights), atol=2e-4)


def test_quality_of_clashing_columns(spark):
    docs = frame(spark, ["a b c", None]).withColumns({"_stat_n_words": F.lit("mine"), "score": F.lit("x"), "_score": F.lit(1)})
    model = quality.RuleModel(0.0, [(((0, True, 2.0),), 1.0)])
    kept = quality.accepted(docs, model, 0.6)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.select("doc_id", "_stat_n_words", "score").collect()] == [(0, "mine", "x")]
    assert quality.accepted(docs.where("false"), model, 0.6).count() == 0


# 7 mixing


def test_targets_follow_weights_and_caps():
    sizes = {"b": 1000, "a": 10, None: 400, "c": 0}
    out = mixing.targets(sizes, mixing.Mixture())
    want = brute.targets(sizes)
    assert out == pytest.approx(want) and out["a"] == 30 and sum(out.values()) == pytest.approx(1410)
    assert mixing.targets({}, mixing.Mixture()) == {}


@pytest.mark.parametrize("rows", [20_000, 15])
def test_mix_meets_targets(spark, rows):
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(1, 60)) if i % 9 else [None, "", " "][i % 3] for i in range(400)]
    docs = frame(spark, texts, [[None, "a", "b", "c"][min(3, i % 7)] for i in range(400)])
    how = mixing.Mixture(bucket_rows=rows, fan_in=3)
    out = mixing.allocate(docs, how).toPandas().sort_values("doc_id")
    again = mixing.allocate(docs.repartition(3), how).toPandas().sort_values("doc_id")
    assert out.taken.tolist() == again.taken.tolist() and len(out) == 400
    assert out["size"].tolist() == [len(brute.WORD.findall(t or "")) for t in texts]
    assert (out.taken <= 3 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
    sums = out.groupby(out.source.fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), longest=("size", "max"))
    assert ((sums.target - sums.taken).abs() <= sums.longest).all()
    mixed = mixing.mix(docs, how)
    assert mixed.agg(F.sum("taken")).first()[0] == out.taken.sum()
    assert mixing.allocate(docs.where("false")).count() == 0


def test_long_documents_are_settled_first(spark):
    rng = random.Random(13)
    texts = [words(rng, n) for n in [5184, 900, *([40] * 60)]] + [words(rng, rng.randrange(1, 80)) for _ in range(150)] + [words(rng, 3000), words(rng, 7)]
    docs = frame(spark, texts, ["a"] * 62 + ["b"] * 150 + ["c"] * 2)
    out = mixing.allocate(docs, mixing.Mixture(bucket_rows=40)).toPandas()
    sums = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    # c has a document of 3000 words and one of 7, so that 3000 is as near to its target as it can come
    assert (abs(sums.target - sums.taken)[["a", "b"]] <= 0.01 * sums.target[["a", "b"]]).all() and sums.taken["c"] == 3000, sums
    assert (out.taken <= 3 * out["size"]).all()


def test_settling_keeps_chances():
    rng = random.Random(14)
    drawn = [mixing.settle([50, 30], 400.0, 1000, 3, rng) for _ in range(4000)]
    for i in range(2):
        assert np.mean([c[i] for c, _ in drawn]) == pytest.approx(400 / 1080, abs=0.03)
    assert all(50 * a + 30 * b + left == pytest.approx(400) and 0 <= left <= 3000 for (a, b), left in drawn)
    # the shorter ones can't give words back, so the longer one is left out
    assert {c[0] for c, _ in (mixing.settle([50], 44.0, 60, 3, rng) for _ in range(50))} == {0}


def test_mixing_takes_what_was_drawn(spark):
    docs = spark.createDataFrame([(None, "a b c", "s", 5)] * 5 + [(1, "a b c", "s", 6)] * 4 + [(2, "x y", None, 7), (3, "z " * 40000, "t", 8), (4, None, "t", 9)], "doc_id long, text string, source string, target int").withColumns({"size": F.lit("clash"), "_size": F.lit(1), "i": F.lit(2)})
    drawn = mixing.allocate(docs)
    mixed = mixing.mix(docs)
    assert mixed.agg(F.sum("taken")).first()[0] == drawn.agg(F.sum("taken")).first()[0]
    assert all(r.copies >= 1 and r.taken == r.size * r.copies for r in mixed.collect())
    assert mixing.mix(docs.where("false")).count() == 0


def test_pivotal_keeps_sums_and_chances():
    rng = random.Random(8)
    hits = np.zeros(6)
    for _ in range(4000):
        p, size = [0.3] * 6, [5, 9, 2, 7, 7, 1]
        out, held, rest = mixing.pivotal(list(p), size, rng)
        if held is not None:
            left = sum(s for s, x in zip(size, out, strict=True) if x) - (size[held] if out[held] else 0) + rest * size[held]
            assert left == pytest.approx(0.3 * sum(size))
            out[held] = int(rng.random() < rest)
        hits += out
    assert np.abs(hits / 4000 - 0.3).max() < 0.04


# 8 repetition

REPEATS = [None, "", "one two", "a b c d e f g h i j k", "x y z w v " * 20, "line one here\nline one here\n\n\nother\nline one here", "#*$ %&|<> ok " * 3, "é ü ö " * 30, "same\n" * 300, "w " * 20000]


def test_repetition(spark):
    for r, t in zip(repetition.repetition_rules(frame(spark, REPEATS)).orderBy("doc_id").collect(), REPEATS, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.repetition(t), t
        assert not (r.base_failed and r.kept)


def test_short_phrases_that_come_back(spark):
    rng = random.Random(15)
    phrase = ["buy", "this", "now"]
    spam = " ".join(" ".join([*phrase, f"x{rng.randrange(10**6)}"]) for _ in range(12))
    texts = [spam, words(rng, 200, 10**6), " ".join([*phrase, words(rng, 20, 10**6)] * 1), None, "a b a b a b", "é ü " + words(rng, 9, 5)]
    out = repetition.repetition_rules(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        assert r.top_coverage == pytest.approx([brute.top_ngram(t, n) for n in (2, 3, 4)]), t
    assert not out[0].base_failed and not out[0].kept and out[1].kept and out[2].kept
    assert repetition.repetition_rules(frame(spark, texts).where("false")).count() == 0


def test_line_coverage(spark):
    line = "alpha beta gamma"
    rng = random.Random(9)
    text = "\n".join([line] * 5 + [words(rng, 14, 10**6)] * 1)
    r = repetition.repetition_rules(frame(spark, [text])).first()
    repeated, other = 5 * len(line.replace(" ", "")), len(text.split("\n")[-1].replace(" ", ""))
    assert r.line_coverage == pytest.approx(repeated / (repeated + other))


# 9 similarity join


def near_copies(rng, text, edits):
    out = text.split(" ")
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_components_match_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [words(rng, rng.choice([30, 80, 150]), 10**6) for _ in range(6)]
    texts = [near_copies(rng, rng.choice(base), rng.randrange(5)) for _ in range(120)] + base * 2
    common = words(rng, 60, 10**6)
    texts += [f"{common} {words(rng, rng.randrange(1, 30), 10**6)}" for _ in range(40)]
    texts += [None, "", "a b", "A b", "a b c", " \n"]
    rng.shuffle(texts)
    want, links = brute.components(list(enumerate(texts)))
    how = jaccard.JaccardJoin(frequent_shingles=rng.choice([0, 50, 10**5]), list_rows=rng.choice([5, 10**6]))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, texts), how).collect()}
    assert out == want and links > 20


def test_join_of_odd_rows(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (9, text), (9, "other words stand in this row here"), (1, "other words stand in this row here"), (4, None), (None, "")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)
    # the two texts of row 9 tie both groups together
    assert out == sorted([(3, 3, 1), (3, 3, 1), (None, 3, 1), (9, 3, 1), (9, 3, 1), (1, 3, 1), (4, 0, 4), (None, 0, None)], key=str)
    assert jaccard.jaccard_components(docs.where("false")).count() == 0


def test_join_of_long_and_clashing_rows(spark):
    rng = random.Random(20)
    long_one = words(rng, 60000, 10**6)
    docs = frame(spark, [long_one, long_one + " end", "x " * 50000, "x " * 9, "other"]).withColumns({"rep": F.lit(1), "component_id": F.lit("mine"), "kind": F.lit(2)})
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert out == brute.components([(r.doc_id, r.text) for r in docs.collect()])[0] and out[1][1] == 0 and out[3][1] == 2
    kept = jaccard.one_of_each(docs, jaccard.jaccard_components(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]


def test_long_lists_are_met_in_parts(spark):
    rng = random.Random(21)
    common = words(rng, 12, 10**6)
    texts = [f"{common} {words(rng, rng.choice([0, 1, 2]), 10**6)}".strip() for _ in range(60)]
    for rows in (3, 10**6):
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, texts), jaccard.JaccardJoin(list_rows=rows, frequent_shingles=5)).collect()}
        assert out == brute.components(list(enumerate(texts)))[0]


def test_frequent_shingles_are_bounded(spark):
    rows = [(1, None, times, token) for token, times in ((5, 3), (6, 3), (7, 9), (8, 2), (9, 20_000), (10, 20_001))] + [(0, 1, 4, 4)]
    profile = spark.createDataFrame(rows, "kind tinyint, id long, n long, fp long")
    for most, want in ((0, []), (1, []), (2, [9, 10]), (3, [7, 9, 10]), (4, [7, 9, 10]), (5, [5, 6, 7, 9, 10]), (99, [5, 6, 7, 8, 9, 10])):
        tokens, times = jaccard._frequent(profile, most)
        assert tokens.tolist() == want and times.tolist() == [dict(((5, 3), (6, 3), (7, 9), (8, 2), (9, 20_000), (10, 20_001)))[t] for t in want]


def test_one_of_each_stays(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", None, "x y z"])
    kept = jaccard.one_of_each(docs, jaccard.jaccard_components(docs))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and {*kept.columns} == {*docs.columns}


def test_one_of_repeated_rows_stays(spark):
    text, other, third = "one two three four five six seven", "other words stand in this row here", "a third text that no id has"
    rows = [(3, text)] * 4 + [(7, text), (None, text), (9, other), (9, other), (9, ""), (None, third), (None, third.upper()), (4, None), (4, None), (None, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int").withColumns({"_fp": F.lit("mine"), "_n": F.lit(1), "row": F.lit(2)})
    kept = jaccard.one_of_each(docs, jaccard.jaccard_components(docs))
    out = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=str)
    assert out == sorted([(3, text), (9, other), (None, third), (4, ""), (None, "")], key=str) and kept.columns == docs.columns


def test_connected_components(spark):
    rng = random.Random(10)
    edges = [(i, i + 1) for i in range(60, 90)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(100, x) for x in range(200, 240)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    out = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {x: find(x) for x in parent}


# 10 chat


def test_round_trip_and_digests(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<<SYS>>\\[INST]", "<", "a\\<s>", "", None, "é😀", "<<ROLE>>x<<TEXT>>y<</TEXT>>"]
    rng = random.Random(11)
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "tool", "<<ROLE>>", None]), rng.choice(said), "clash", 1))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, seq long")
    by = {}
    for c, _, role, text, *_ in sorted(rows, key=lambda r: r[:2]):
        by.setdefault(c, []).append((role, text))
    out = chat.conversation_digests(turns).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == {c: brute.conversation(t) for c, t in by.items()}
    formatter = chat.Formatter(chat.Template())
    segments = {}
    for r in chat.format_conversations(turns).orderBy("conv_id", "seq").collect():
        segments.setdefault(r.conv_id, []).append((r.segment, r.loss))
    for c, t in by.items():
        whole = "".join(s for s, _ in segments[c])
        assert [(r, x) for r, x, _ in formatter.turns(whole)] == [(r or "", x or "") for r, x in t]
        assert "".join(formatter.unescape(s) for s, loss in segments[c] if loss) == "".join(x or "" for r, x in t if r == "assistant")
        assert len(whole) == next(r.formatted_chars for r in out if r.conv_id == c)


def test_long_and_odd_conversations(spark):
    rows = [(1, 0, "user", "é[INST]" * 20000), (1, 1, "assistant", "x"), *[(2, t, "user", "same") for t in (0, 0, 0)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("clash"), "n_turns": F.lit(1)})
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(turns).collect()}
    assert out == {c: brute.conversation([(r[2], r[3]) for r in rows if r[0] == c]) for c in (1, 2)}
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_turn_order(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, "system", "s"), (4, 0, "user", "a"), (4, 1, "user", "b"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.valid for r in chat.conversation_digests(turns).collect()} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert chat.conversation_digests(turns.where("false")).count() == 0
