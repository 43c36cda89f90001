"""Line labelling, the additive model and URL rules."""

import re
import zlib

import duckdb
import numpy as np
import pytest

from cohortlens.llm import gam, line_crf, url_filter
from cohortlens.llm.textstats import repeated_words, split

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


CASES = ["", " \n\t ", "a b c d e a b c d e", "x\n x\nx\n\nx", "é b c|d <>&%$*#", "one two three four five six " * 3, "w " * 30, "a\x0bb\x0cc\x1cd", "n\n" * 5]


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(CASES)] + [(None, None, "c")], "doc_id bigint, text string, kept string")
    got = {r["doc_id"]: r for r in line_crf.judge(df, line_crf.LineCRF.plain()).collect()}
    for i, text in enumerate(CASES):
        r, want = got[i], plain_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r["base_failed"] or not r["kept"])
    assert got[None]["base_failed"] and line_crf.judge(df.limit(0), line_crf.LineCRF.plain()).count() == 0


def test_long_texts_count_windows_alike(monkeypatch):
    import cohortlens.llm.textstats as t

    rng = np.random.default_rng(0)
    words = [str(v).encode() for v in rng.integers(0, 4, 800)]
    want = repeated_words(words)
    monkeypatch.setattr(t, "MANY_WORDS", 10)
    assert repeated_words(words) == want > 0


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        crf = line_crf.LineCRF(rng.normal(size=(2, len(line_crf.FEATURES))), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, len(line_crf.FEATURES)))

        def value(seq, crf=crf, x=x):
            return sum(crf.emit[s] @ v for s, v in zip(seq, x, strict=True)) + sum(crf.move[a, b] for a, b in zip(seq, seq[1:], strict=False))

        best = max(value([b >> i & 1 for i in range(n)]) for b in range(1 << n))
        assert value(crf.decode(x)) == pytest.approx(best)


def test_marginals_sum_to_one_and_match_enumeration():
    rng = np.random.default_rng(5)
    scores, move, real = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2)), np.ones((1, 4), bool)
    m, pairs = line_crf._marginals(scores, move, real)
    total, want, links = 0.0, np.zeros((4, 2)), np.zeros((2, 2))
    for b in range(16):
        seq = [b >> i & 1 for i in range(4)]
        w = np.exp(sum(scores[0, i, s] for i, s in enumerate(seq)) + sum(move[a, c] for a, c in zip(seq, seq[1:], strict=False)))
        total += w
        for i, s in enumerate(seq):
            want[i, s] += w
        for a, c in zip(seq, seq[1:], strict=False):
            links[a, c] += w
    assert np.allclose(m[0], want / total) and np.allclose(pairs[0], links / total)


@pytest.fixture(scope="module")
def labelled():
    return duckdb.sql("select doc_id, quality, text from '/root/testdata/sf0.01/documents.parquet' join '/root/testdata/sf0.01/labels.parquet' using (doc_id) order by doc_id").fetchall()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def field(labelled):
    return line_crf.LineCRF.fit([(*line_crf.line_features(split(t)[2]), q) for i, q, t in labelled if not held(i)])


def marks(field, text):
    return "".join("bc"[x] for x in field.decode(line_crf.line_features(split(text)[2])[0]))


def test_crf_held_out(labelled, field):
    hits, mixed = [], 0
    for i, q, t in labelled:
        x, sizes = line_crf.line_features(split(t)[2])
        labels = np.array(field.decode(x), bool)
        mixed += 0 < labels.sum() < len(labels)
        if held(i):
            hits.append((sizes[labels].sum() / max(1, sizes.sum()) >= 0.5) == (q == 1))
    assert np.mean(hits) > 0.95 and mixed >= 10, (np.mean(hits), mixed)


def test_boilerplate_within_content_is_marked_alone(labelled, field):
    good = [x for i, q, t in labelled if q == 1 and held(i) for x in t.split("\n") if len(x.split()) > 15][:8]
    bad = [x for i, q, t in labelled if q == 0 and held(i) for x in t.split("\n") if "!!" in x][:4]
    assert len(good) == 8 and len(bad) == 4
    assert marks(field, "\n".join(good)) == "c" * 8 and marks(field, "\n".join(bad)) == "b" * 4
    assert marks(field, "\n".join(good[:4] + bad + good[4:])) == "ccccbbbbcccc"
    assert marks(field, "\n".join(bad[:2] + good[:4] + bad[2:])) == "bbccccbb"


def test_fit_reads_every_line_and_one_text_of_an_id(spark, labelled):
    """The only bad lines stand far beyond the first of a long document."""
    good = [t for _, q, t in labelled if q == 1]
    bad = [x for _, q, t in labelled if q == 0 for x in t.split("\n") if "!!" in x]
    clean = [x for t in good[40:] for x in t.split("\n") if len(x.split()) > 5]
    # No line stands twice in a text, else that it does would tell bad texts.
    text = lambda i: good[i] if i < 20 else "\n".join([*dict.fromkeys(clean[30 * i : 30 * i + 70]), *dict.fromkeys(bad[2 * i : 2 * i + 60])])
    rows = [(i, text(i)) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id bigint, quality int")
    crf = line_crf.fit_line_crf(spark.createDataFrame([*rows, rows[3], (5, "x !!"), (21, None)], "doc_id bigint, text string"), labels)
    again = line_crf.fit_line_crf(spark.createDataFrame([(21, None), (5, "x !!"), *rows[::-1]], "doc_id bigint, text string").repartition(3), labels)
    assert (crf.emit == again.emit).all() and (crf.move == again.move).all()
    assert marks(crf, "\n".join(good[0].split("\n")[:1] + bad[:3])).endswith("bbb")


def test_a_document_of_too_many_lines_is_passed_over_in_the_fit(spark):
    """Its lines never reach the driver, and the rest is fitted as without it."""
    line = lambda i, k: f"good words stand in line {i} {k} of this text." if i % 2 else f"!!! {k} $$$ BUY {i} !!!"
    rows = [(i, "\n".join(line(i, k) for k in range(12))) for i in range(40)]
    long = (1001, "\n".join(f"odd {k % 7} ?" for k in range(5000)))
    df = lambda r: spark.createDataFrame(r, "doc_id bigint, text string")
    labels = lambda r: spark.createDataFrame([(i, i % 2) for i, _ in r], "doc_id bigint, quality int")
    with_it = line_crf.fit_line_crf(df([*rows, long]), labels([*rows, long]), max_lines=1000)
    without = line_crf.fit_line_crf(df(rows), labels(rows))
    assert (with_it.emit == without.emit).all() and (with_it.move == without.move).all() and without.emit.any()
    none = line_crf.fit_line_crf(df(rows), labels(rows), max_lines=5)
    assert (none.emit == line_crf.LineCRF.plain().emit).all()


def test_gam_held_out(labelled):
    x, y = np.array([gam.features(t) for _, _, t in labelled]), np.array([q for _, q, _ in labelled])
    h = np.array([held(i) for i, _, _ in labelled])
    model = gam.GAM.fit(x[~h], y[~h].astype(float))
    score = model.score(x[h])
    assert ((score >= 0.3) == (y[h] == 1)).mean() > 0.97 and ((score >= 0) & (score <= 1)).all()
    total = np.full(h.sum(), model.base)
    for i, row in enumerate(x[h]):
        for f, v in enumerate(row):
            total[i] += model.tables[f][sum(v >= e for e in model.edges[f])]
        for a, b, ea, eb, table in model.pairs:
            total[i] += table[sum(row[a] >= e for e in ea), sum(row[b] >= e for e in eb)]
    assert np.allclose(score, 1 / (1 + np.exp(-total)))


def test_gam_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5), (2, None, 0.1), (None, "", 0.2), (1, "a b", 0.5)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = gam.fit_gam(docs, none)
    assert [r["score"] for r in gam.score(docs, model).collect()] == [0.5] * 4 and gam.score(docs.limit(0), model).count() == 0
    one = gam.fit_gam(docs, spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 1), (3, None)], "doc_id bigint, quality int"))
    assert gam.keep_good(docs, one).columns == docs.columns
    assert line_crf.fit_line_crf(docs, none).decode(np.zeros((2, len(line_crf.FEATURES)))) == [1, 1]


PAGES = [
    (1, "https://a.example.com/en/1", None), (2, "http://b.example.com/en/70", None), (3, "https://c.example.net/de/80", None), (4, "https://c.example.net/de/9", None), (5, "https://x.org/es/", None),
    (6, None, "<a>"), (7, "no scheme", "x"), (8, "HTTPS://WWW.Site.IO/Page.html?utm_source=q#f", None), (9, "http://site.io/Page/", '<link rel="canonical" href="https://evil.com/en/x">'),
    (10, "https://other.io/p", '<meta http-equiv="refresh" content="0; url=http://site.io/Page">'), (11, "https://fine.io/p?b=1&a=2", "<link rel=canonical href=/q>"), (12, "https://fine.io/q", None),
    (13, "https://mixed.io/1", "<LINK href='//evil.com/en/y' REL='canonical'>"), (14, "https://mixed.io/1", "<link rel='canonical' href='https://example.com/en/7a'>"), (14, "https://mixed.io/1", None), (15, "://", None), (16, "http://ex ample.com?x/en/", ""),
    (None, "https://evil.com/en/q", None), (17, "https://com/en/é", None), (18, "https://notcom/en/", None), (19, "https://evil.com/EN/", None),
]


def test_urls_equal_sql_and_plan(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'c' as host", "1 as node")
    got = sorted(map(str, url_filter.judge(df).collect()))
    pages = df.select("page_id", "url", "html").toPandas().astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.sql(url_filter.SQL).fetchall()
    assert got == sorted(f"Row(page_id={a!r}, host={b!r}, path={c!r}, rule={d!r}, verdict={e!r})" for a, b, c, d, e in want)
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judge(df).collect()}
    assert [verdict[k] for k in (1, 2, 3, 4, 5)] == ["block", "allow", "block", "allow", "block"]
    assert [verdict[k] for k in (8, 9, 10)] == ["block"] * 3 and [verdict[k] for k in (11, 12, 13, 14)] == ["allow"] * 4
    assert verdict[18] == verdict[19] == "allow" and url_filter.judge(df.limit(0)).count() == 0


LINKS = [
    ("http://a.io/d/p.html?z", '<link rel="canonical" href="q.html">', ["http://a.io/d/q.html"]), ("http://a.io/d/p", '<LINK REL=canonical HREF=../q?a=1&amp;b=2>', ["http://a.io/q?a=1&b=2"]),
    ("http://a.io/d/p", "<link rel='canonical' href='?p=2'>", ["http://a.io/d/p?p=2"]), ("https://a.io/", '<link rel="canonical" href="//b.io/x">', ["https://b.io/x"]),
    ("http://a.io/", '<link rel="canonical" href=""><link rel="nofollow canonical" href="/one"><link rel="canonical" href="/two">', ["http://a.io/one", "http://a.io/two"]),
    ("http://a.io/", '<meta http-equiv="refresh" content="0; url=http://b.io/x;s=1?a=1&amp;b=2">', ["http://b.io/x;s=1?a=1&b=2"]), ("http://a.io/", "<meta content='5;URL=\"/q\"' http-equiv=refresh>", ["http://a.io/q"]),
    ("http://a.io/", "<meta http-equiv=refresh content=5>", []), ("http://a.io/", '<!-- <link rel="canonical" href="/no"> --><script>"<link rel=canonical href=/no>"</script>', []),
    ("http://a.io/x/y", '<base href="/z/"><link rel="canonical" href="w&#47;v&#x2e;html">', ["http://a.io/z/w/v.html"]), ("http://[bad", '<link rel="canonical" href="q">', []), ("http://a.io/", '<link rel="canonical" href="/a>b" title="x">', ["http://a.io/a>b"]),
    ("http://a.io/", '<a href="/q">canonical</a><link rel="icon" href="/i">', []),
]


@pytest.mark.parametrize("url,html,want", LINKS)
def test_links_of_a_page(url, html, want):
    assert url_filter.links_of(url, html) == want


def test_no_link_is_lost(spark):
    """Verdicts of pages whose only way to a blocked or allowed URL is a link of that kind."""
    block, allow = "http://sub.x.org/es/q?a=1&b=2", "http://example.com/en/7"
    rows, want = [], {}

    def page(i, url, html, verdict):
        rows.append((i, url, html))
        want[i] = verdict

    page(1, "http://one.io/a", '<meta http-equiv="refresh" content="0;url=http://two.io/x?a=1&amp;b=2">', "block")
    page(2, "http://two.io/x?a=1&b=2", f'<link rel=canonical href="{block.replace("&", "&#38;")}">', "block")
    page(3, "http://two.io/x?a=1", None, "allow")
    page(4, "http://three.io/d/p", '<link rel="canonical" href="../e/q.html">', "block")
    page(5, "http://three.io/e/q", f'<link rel="canonical" href=""><link rel="canonical" href="{block}">', "block")
    page(6, "http://four.io/d/p", '<link rel="canonical" href="?p=2">', "allow")
    page(7, "http://four.io/d/p?p=2", f'<link rel="canonical" href="{block}"><meta http-equiv=refresh content="0;{allow}">', "allow")
    for k in range(20):
        page(100 + k, f"http://chain{k}.io/", f'<link rel="canonical" href="http://chain{k + 1}.io/">' if k < 19 else f'<link rel="canonical" href="{block}">', "allow")
    # All that name the blocked URL are one component, which page 7 joins to an allowed one.
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: "allow" for k in want}
    without = [r for r in rows if r[0] not in (6, 7)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(without, "page_id bigint, url string, html string")).collect()}
    assert got == {r[0]: "allow" if r[0] == 3 else "block" for r in without}


def test_planted_links_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    got = sorted(str(tuple(r)) for r in url_filter.redirects_planted(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == sorted(str(r) for r in con.sql(url_filter.PLANTED_SQL).fetchall()) and len({r.rsplit(",", 1)[1] for r in got}) == 2


READ_AS_A_BROWSER = [
    ("app://free2.io/d/1", '<link rel=canonical href="2">', ["app://free2.io/d/2"]), ("http://a.io/", '<link rel="can&#111;nical" href="/x">', ["http://a.io/x"]), ("http://a.io/", "<link rel=canonical data-x=it's href=/y>", ["http://a.io/y"]),
    ("http://a.io/", "<link rel=canonical href=/y/>", ["http://a.io/y/"]), ("http://a.io", "<a title='<link rel=canonical href=/no>'>t</a><link rel=canonical href=q/../../r/.>", ["http://a.io/r/"]),
    ("http://a.io/x", "<link rel=canonical href=http:z><link / rel = canonical / href = 'b' ><link rel=canonical href=c href=d>", ["http://a.io/z", "http://a.io/b", "http://a.io/c"]),
    ("http://a.io/", "<!--><link rel=canonical href=/a><!-- > --!><link rel=canonical href=/b><title><link rel=canonical href=/no></title ><link rel=canonical href=/c", ["http://a.io/a", "http://a.io/b"]),
    ("http://a.io/", "< link rel=canonical href=/no></link rel=canonical href=/no><?x <link rel=canonical href=/no2>?><LINK REL='x CANONICAL' HREF=/d>", ["http://a.io/d"]), ("no scheme", "<link rel=canonical href=/a><link rel=canonical href=ftp://b/c>", ["ftp://b/c"]),
]


@pytest.mark.parametrize("url,html,want", READ_AS_A_BROWSER)
def test_links_are_read_as_a_browser_reads_them(url, html, want):
    assert url_filter.links_of(url, html) == want


@pytest.mark.parametrize("piece", ["<link ", "<link x='", "<link x='' y=", "<!--", "<!", "<script>", "</", "<a b=c ", "<link rel=canonical href=a>", "<link>", "\"'<=>"])
def test_a_very_long_page_takes_time_in_proportion(piece):
    import time

    times = []
    for size in (100_000, 1_000_000):
        page = piece * (size // len(piece))
        start = time.process_time()
        url_filter.links_of("http://a.io/", page)
        times.append(time.process_time() - start)
    assert times[1] < 5 and times[1] < 30 * max(times[0], 0.02)


def test_links_in_any_form_decide(spark):
    rows = [(1, "app://free2.io/d/1", '<link rel="canonical" href="2">'), (2, "app://free2.io/d/2", '<link rel="can&#111;nical" href="http://evil.com/en/x">'), (3, "http://free3.io/", "<link data-x=it's rel=canonical href=//evil.com/en/y>"), (4, "http://free4.io/", "<link " * 20_000)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_chains_hubs_and_cycles_equal_sql(spark, sf):
    sf = sf.replace("0.001", "0.01")  # several blocks of each kind
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    got = sorted(str(tuple(r)) for r in url_filter.redirects_chained(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == sorted(str(r) for r in con.sql(url_filter.CHAINED_SQL).fetchall()) and len({r.rsplit(",", 1)[1] for r in got}) == 2
