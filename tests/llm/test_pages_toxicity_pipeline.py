import random

import pytest

from clickstrata.llm import html_text, toxicity

from .helpers import SCHEMA, corpus, frame, sorted_rows


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain  words &amp; more", "plain words & more"),
        ("<article><h1>T</h1><p>a<br>b <i>c</i></p><p>d</article>", "T\n\na b c\n\nd"),
        ("<nav>menu</nav><article><p>x</p><aside>no</aside></article><footer>f</footer>", "x"),
        ("<article><script>var t='</p>';</script><style>p{}</style><p>x<!-- c <p>no</p> --></p></article>", "x"),
        ("<article><p>x</p><div class='comments'><p>reader</p></div><section id=related><p>more</p></section></article>", "x"),
        ("<main><header><h1>head</h1></header><p>x</p></main><header>site</header>", "head\n\nx"),
        ("<article><p>x<form><p>no</p></form><p>y<div hidden>no</div><p style='display: none'>no</p></article>", "x\n\ny"),
        ("<article>&lt;b&gt; 5 < 6 &#233;&eacute;&nbsp;z</article>", "<b> 5 < 6 éé z"),
        ("<article><p>one<p>two<ul><li>three<li>four</ul></article>", "one\n\ntwo\n\nthree\n\nfour"),
        ("<article><p>open <b>never closed", "open never closed"),
        ("<div class='site-header'>logo</div><div id='content'><div class='post-header'>title</div><p>x</p></div><div>after</div>", "title\n\nx"),
        ("<article><p>a <span class='ad'>buy <span>now</span> here</span> b</p><p>c</p></article>", "a b\n\nc"),
        ("<article><p>a</p><p title='x > y'>b</p><!-- --><p>c <!----> d</p></article>", "a\n\nb\n\nc d"),
        ("<article><p>a</p><a href=\"x>text", "a"),
        ("<article><p>a</p></ p><?php x ?><p>b<p class=''>c", "a\n\nb\n\nc"),
        ("<div class=\"post-body\">x</div><article class='comment'>reader</article><div class='cookie-notice'>we</div>", "x"),
    ],
)
def test_blocks(html, text):
    found = html_text.blocks(html or "")
    main = [x for x, m in found if m == html_text.MAIN_LINE] or [x for x, m in found if m == html_text.OTHER]
    assert "\n\n".join(main) == text


@pytest.mark.parametrize("piece", ["<a href=\"", "<a href='", "<", "<!--", "</", "<p", "<p =", "<div>", "</div>", "<div></p>", "<span class=ad>", "<script>", "&", "\"'>", "<a b "])
def test_broken_markup_takes_linear_time(piece):
    import time

    began = time.process_time()
    html_text.blocks("<article><p>x</p>" + piece * 100_000)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("most", [0, 50_000])
def test_lines_of_the_site_go_from_articles_and_quotations_stay(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "BROADCAST_PAGES", most)
    quoted = "As the old saying goes."
    page = lambda k: f"<nav>menu {k % 3}</nav><article><p>own {k} first</p><p>Read our terms before you go on.</p><p>own {k} last</p>{f'<p>{quoted}</p>' if k in (3, 4, 5) else ''}</article><div class=ad>buy {k}</div><footer>site</footer>"
    rows = [(k, f"http://h.org/a/{k:02d}", page(k)) for k in range(12)]
    out = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(12):
        assert out[k].text == f"own {k} first\n\nown {k} last" + (f"\n\n{quoted}" if k in (3, 4, 5) else "")
        assert out[k].n_chars == len(out[k].text)


def test_differencing_acts_on_pages_of_the_tables(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    table = html_text.parsed(pages, "page_id", "url", "html")
    found = html_text.differenced(table).join(table, "row").collect()
    assert len(found) == pages.count() and sum(bool(r.gone) for r in found) > 0
    for r in found:
        assert all(r.kinds[k] == html_text.MAIN_LINE for k in r.doubtful) and set(r.doubtful) <= set(r.gone)


def test_differencing_alone_finds_the_frame_of_whole_tables(spark):
    """Pages of the table, their tags taken away, in frames of their hosts' own: what is left are the lines that no neighbour has."""
    import os
    import re

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no tables")
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    rows, own = [], {}
    for p in pages:
        host = re.search("//([^/?#]*)", p.url)[1].removeprefix("www.")
        lines = [x for x, kind in html_text.blocks(p.html) if kind == html_text.MAIN_LINE]
        own[p.page_id] = lines
        frame = [f"{host} menu {k}" for k in range(4)], [f"{host} foot {k}" for k in range(3)]
        rows.append((p.page_id, p.url, "".join(f"<div>{x.replace('&', '&amp;').replace('<', '&lt;')}</div>" for x in [*frame[0], *lines, *frame[1]])))
    out = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    framed = sum(" menu " in r.text or " foot " in r.text for r in out)
    exact = sum(r.text == "\n\n".join(own[r.page_id]) for r in out)
    assert framed <= 0.1 * len(out) and exact >= 0.8 * len(out), (framed, exact, len(out))


def test_common_lines_is_longest():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        held = html_text.common_lines(a, b)
        rest = iter(b)
        assert len(held) == table[-1][-1] and all(a[i] in rest for i in held)


def test_pages_are_differenced_with_the_nearest(spark):
    site = lambda own: f"<div>Welcome</div><p>{own} one</p><p>{own} two</p><div>Contact us</div>"
    rows = [
        (1, "http://h.org/a/1", site("first")),
        (2, "http://h.org/a/2", site("second")),
        (3, "http://h.org/a/2#top", site("second")),
        (4, "http://other.org/a/1", site("alone")),
        (5, "http://k.org/x", "<article><p>kept</p></article><p>Contact us</p>"),
        (6, None, None),
        (6, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS row", "'y' AS text", "1 AS lines")
    out = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert out[1] == "first one\n\nfirst two"
    assert out[4] == "Welcome\n\nalone one\n\nalone two\n\nContact us" and out[5] == "kept" and out[6] == ""
    assert out[2] in ("second one\n\nsecond two", "Welcome\n\nsecond one\n\nsecond two\n\nContact us")
    assert html_text.main_text(pages).count() == len(rows) and html_text.main_text(pages.limit(0)).count() == 0


def test_copies_and_large_frames_are_differenced(spark):
    menu = [f"<div>menu {k}</div>" for k in range(25)]
    large = lambda name: "".join([*menu, *[f"<p>{name} {k}</p>" for k in range(5)]])
    site = lambda own: f"<div>Welcome</div><p>{own} one</p><p>{own} two</p><div>Contact us</div>"
    rows = [(k, f"http://big.org/a/{k}", large(f"own{k}")) for k in range(3)]
    rows += [(10, "http://h.org/a/1", site("first")), (11, "http://h.org/a/2", site("second")), (12, "http://h.org/a/2#top", site("second")), (13, "http://www.h.org/a/2?x=1", site("second")), (14, "http://h.org/a/2", site("second"))]
    rows += [(20, "http://only.org/a", site("alone")), (21, "http://only.org/a?y", site("alone"))]
    edited = lambda date: site("text") + "".join(f"<p>line {k}</p>" for k in range(20)) + f"<p>{date}</p>"
    rows += [(30, "http://e.org/a/1", site("before")), (31, "http://e.org/b/1", edited("Monday")), (32, "http://e.org/b/2", edited("Tuesday")), (33, "http://e.org/c/1", site("after"))]
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(3):
        assert out[k] == "\n\n".join(f"own{k} {n}" for n in range(5))
    assert out[10] == "first one\n\nfirst two" and {out[k] for k in (11, 12, 13, 14)} == {"second one\n\nsecond two"}
    assert {out[20], out[21]} == {"Welcome\n\nalone one\n\nalone two\n\nContact us"}
    assert all(f"line {k}" in out[p] for p in (31, 32) for k in range(20)) and "Welcome" not in out[31] + out[32]


def test_unlike_neighbours(spark):
    from pyspark.sql import functions as F

    from clickstrata.llm.common import unlike_neighbours

    rng = random.Random(2)
    for most in (1, 2, 40):
        kinds = [k for _ in range(30) for k in [rng.randint(0, 3)] * rng.randint(1, most)]
        df = spark.createDataFrame(list(enumerate(kinds)), "n int, kind int")
        out = {r.n: (r.ahead, r.behind) for r in unlike_neighbours(df, [F.asc("n")], "n", "kind").collect()}
        assert out == {n: (next((m for m in range(n, len(kinds)) if kinds[m] != k), None), next((m for m in range(n, -1, -1) if kinds[m] != k), None)) for n, k in enumerate(kinds)}


def _toxic_corpus(n=600):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("tor", "len", "mip", "gras", "sun") for b in ("a", "ing", "os", "ker")]
    rows, labels = [], []
    for i in range(n):
        held = [rng.choice(words) for _ in range(80)]
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(["grimbo", "snurf", "vorka" + rng.choice("xyz"), "vorka" + rng.choice("uvw")], 3):
                held.insert(rng.randrange(80), w)
        rows.append((i, " ".join(held) + ".", "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_holds_out(spark):
    import zlib

    rows, labels = _toxic_corpus()
    rows += [(10_000, None, None, None, None), (10_001, "", "en", "s", 0), rows[0]]
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    assert {"grimbo", "snurf"} <= set(model.insults) and any(k.startswith("vork") for k in model.insults)
    out = toxicity.toxicity(docs, marks).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert toxicity.without_toxic(docs, model).where("doc_id = 10000").count() == 1


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(frame(spark), none).collect()} == {0.0}
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


def test_grammar_paths():
    run = toxicity.grammar().run
    assert run(list("oIo")) == list("oIo")
    assert run(list("NoI"))[-1] == "i" and run(list("NNI"))[-1] == "I"
    assert run(list("RooI"))[-1] == "q"
    assert run(list("YoI"))[-1] == "J"
    assert run(list("ToY"))[-1] == "K" and run(list("oY"))[-1] == "o"


def test_arcs_carry_weights_that_multiply_and_add():
    weights = {"I": 2.0, "J": 3.0, "i": 0.5, "q": 0.25, "K": 1.5}
    machine = toxicity.grammar(weights)
    assert list(machine.weighed(list("oIYoINoI"))) == [("o", 0.0), ("I", 2.0), ("o", 0.0), ("o", 0.0), ("J", 3.0), ("o", 0.0), ("o", 0.0), ("i", 0.5)]
    assert list(machine.weighed(list("ToY"))) == [("o", 0.0), ("o", 0.0), ("K", 1.5)]
    one = toxicity.Transducer({(0, "a"): (1, "b", 2.0)})
    two = toxicity.Transducer({(0, "b"): (0, "c", 5.0)})
    assert list(toxicity.compose(one, two, "a").weighed(["a", "a"])) == [("c", 10.0), ("a", 1.0)]
    matcher = toxicity.Matcher({"grimbo": 2.0, "snur*": 4.0}, weights)
    assert matcher.matched("A grimbo here. You are a snurfle! He said grimbo.") == 2 * 2.0 + 4 * 3.0 + 2 * 0.25


def test_isolated_words_match_nothing():
    matcher = toxicity.Matcher({"grimbo": 2.0})
    assert matcher.matched("grimbo") == matcher.matched("A line.\ngrimbo\n...grimbo!") == 0
    assert matcher.paths("the grimbo")["I"] == 2.0


def test_long_clauses_are_read_whole():
    held = toxicity.Matcher({"grimbo": 2.0}).paths("he said " + "word " * 1000 + "grimbo")
    assert held["q"] > 0 and held["I"] == 0
    held = toxicity.Matcher({"grimbo": 2.0}).paths("he said so. " + "word " * 1000 + "grimbo")
    assert held["I"] > 0 and held["q"] == 0


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows, labels = _toxic_corpus(80)
    rows += [(3, "a greater text than any other", "en", "s", 1), (3, "zz the greatest", "en", "s", 1)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    texts, toxic = toxicity.sample(docs, marks)
    assert (texts, toxic) == toxicity.sample(docs.repartition(7), marks) and "zz the greatest" in texts
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 5000)
    few, _ = toxicity.sample(docs, marks)
    assert 0 < len(few) < len(texts) and sum(len(t.encode()) for t in few) <= 5000


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rows, labels = _toxic_corpus(200)
    folder = str(tmp_path)
    spark.createDataFrame(rows + [(i + 5000, *r[1:]) if r[0] is not None else r for i, r in enumerate(corpus())], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    assert 0 < docs.count() < 300
    assert sorted_rows(corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32")) == sorted_rows(corpus_pipeline.packed(spark, docs, folder).select("doc_id", "piece", "length", "ids_crc32"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_line_query_equals_sql(spark):
    import duckdb

    from clickstrata.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    for name, sql in ORACLE_SQL.items():
        mine = QUERIES[name](spark, "/root/testdata/sf0.001")
        columns = sorted(mine.columns)
        assert sorted_rows(mine.select(*columns)) == sorted(c.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)
