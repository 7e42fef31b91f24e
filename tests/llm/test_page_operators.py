"""Operators on pages, against brute force and on odd input."""

import gzip
import hashlib
import html
import random
import re
import time

import pytest

from maskloom.llm import arc_convert, tag_paths, url_rules

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, host string, text string, rule string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = "<article><p>" + "long, text. " * 20_000 + "</p></article>"
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "plain & text"), (4, "http://A.Example.NET/en/x?y#z", long),
            (5, "x://net", long), (6, "x://net/", long), (None, None, long), (6, "x://net/", long),
            (7, "http://e.com/ü a\n?q", "<p>ü</p>"), (8, "http://example.net/en/http://net/", "<p")]
    return spark.createDataFrame([(*r, "h", "t", "r") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- main text -----------------------------------------------------------------


def test_articles_of_pages(pages):
    for r in tag_paths.query(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.DOTALL)[1]
        bare = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)
        assert r["text"] == " ".join(html.unescape(bare).split()) and r["n_chars"] == len(r["text"])


BODY = "<h2>Head</h2><p>Long enough text, with marks. And more of it, as ever, so that it counts.</p><p>Ti.</p>"
WANT = "Head Long enough text, with marks. And more of it, as ever, so that it counts. Ti."
APART = [
    "<nav><ul><li><a href=x>Home</a></li><li>Here, there, all over.</li></ul></nav>",
    "<header>Site name, motto. And so on, for long.</header>", "<footer>&copy; us, them. All rights.</footer>",
    "<aside><p>Read this, too. It is as long as a text, surely.</p></aside>",
    "<div class='cookie-notice'>We use cookies, many of them. Accept them, please.</div>",
    "<div id=sidebar><p>Other, texts. With marks, and more marks.</p></div>", "<form><p>Your name, please.</p><input></form>",
    "<script>var t = '</p>, a. b, c.';</script>", "<style>p { a: b, c. }</style>", "<!-- a, b. <p>c, d.</p> -->",
    "<section class='comments'><article class=comment><p>Nice one, thanks. I liked it, a lot.</p></article></section>",
    "<div class='ad'>Buy now, cheap. Really, really cheap.</div>", "<noscript>Turn it on, please.</noscript>",
]


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div id=c><div>{}</div></div>"])
def test_other_parts_are_left_out(frame):
    rng = random.Random(6)
    for _ in range(20):
        before, after = rng.sample(APART, 4), rng.sample(APART, 4)
        page = f"<html><head><title>T, t.</title></head><body>{''.join(before)}{frame.format(BODY)}{''.join(after)}</body></html>"
        assert tag_paths.main_text(page) == WANT, page
    inside = "".join(rng.sample(APART, 5))
    assert tag_paths.main_text(f"<body>{frame.format(inside + BODY)}</body>") == WANT


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain &amp; <i>te</i>xt", "plain & text"), ("<p>a<p>b<", "a b<"), ("<p>a</div></p></b>b", "a b"),
    ("<p>a&nbsp;&#98;&lt;i&gt;<br>c", "a b<i> c"), ("<p>x</p><!-- y", "x"), ("<p>x<script>y", "x"), ("<p>a < b", "a < b"),
    ("<article></article>", ""), ("<ul><li>a<li>b</ul>c", "a b c"),
])
def test_untidy_markup(page, want):
    assert tag_paths.main_text(page) == want


SIDE = "<div id=sidebar><p>Other, texts. With marks.</p></div>"


@pytest.mark.parametrize("frame", [
    "<div class='site right-sidebar'><div>{}</div>" + SIDE + "</div>", "<div class=has-sidebar>{}" + SIDE + "</div>",
    "<article class='post category-legal'>{}</article>", "<article class='post tag-search'>{}</article>" + SIDE,
    "<article class=related-science>{}</article>", "<div class=no-footer><article class=legal>{}</article></div>" + SIDE,
    "<div class=comments-open>{}<div class=comments>" + "<div class=comment>Nice one, thanks. I liked it.</div>" * 9 + "</div></div>",
    "<div title='the hidden cost' data-x=\"a class='ad'\">{}</div>" + SIDE, "<article>{}</article><p class=ad hidden>Buy, now.</p>",
    "<div id=c>{}</div><div class=comments>" + "<div class=comment>Nice one, thanks. I liked it, a lot.</div>" * 30 + "</div>",
])
def test_a_word_in_a_class_does_not_drop_the_main_text(frame):
    page = f"<html><body><nav>Home</nav>{frame.format(BODY)}<footer>Us, them.</footer></body></html>"
    assert tag_paths.main_text(page) == WANT


@pytest.mark.parametrize("page, want", [
    ("<p>a<svg class='i'/>b</p><p>c</p>", "a b c"), ("<p>a</p><math/><p>b</p><svg/><p>c</p><svg><text>x</text></svg>", "a b c"),
    ("<p>E=<math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math>.</p>", "E=mc2."),
    ("<p><math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math>, y</p>", "x, y"),
    ("<p><math><semantics><mi>x</mi><annotation>\\x</semantics></math>, y</p>", "x, y"),
    ("<div><noscript>No.</div><p>a</p>", "a"), ("<div><select><option>No</div><p>a</p>", "a"), ("<td><template>No</td><p>a", "a"),
    ("<body><noscript><img src=x><p>a</p></body><p>b", "a b"), ("<template><p>a", "a"), ("<select><option>No<p>a</p>", "a"),
    ("<div><svg><path d=x /><p>a</p></div>b", "a b"), ("<p>a<noscript><p>No</p></noscript>b</p>", "a b"),
    ("<svg><title>No</title><g><text>No</text></g><svg><text>No</text></svg><text>No</text></svg>a", "a"),
    ("<svg><foreignObject><div>No</div></foreignObject></svg>a", "a"), ("<select><option>No<option>No</select>a", "a"),
    ("<noscript><p>No</p></noscript>a<noscript>" * 2 + "b", "a a b"),
])
def test_parts_without_text_end_where_they_should(page, want):
    assert tag_paths.main_text(page) == want


LONG = "<p>Much longer than the text, really. It goes on, and on, with marks; and more of them.</p>" * 12


@pytest.mark.parametrize("part", [
    "<div class=comments>{}</div>", "<div class='comment-list'><article class=comment>{}</article></div>", "<ol class=commentlist><li>{}</ol>",
    "<div class=sidebar>{}</div>", "<div class=cookie-notice>{}</div>", "<section id=newsletter-box>{}</section>", "<div class='right-sidebar'>{}</div>",
    "<div class=sponsored-links>{}</div>", "<aside>{}</aside>", "<footer>{}</footer>",
])
@pytest.mark.parametrize("frame", ["<div id=c>{}</div>", "<article>{}</article>", "<div class=no-sidebar><main>{}</main></div>"])
def test_other_parts_go_whatever_their_share(part, frame):
    for page in (frame.format(BODY) + part.format(LONG), part.format(LONG) + frame.format(BODY)):
        assert tag_paths.main_text(f"<html><body>{page}</body></html>") == WANT


LINKS = "<div>" + "".join(f"<a href=/{i}>Link {i}</a><br>" for i in range(8)) + "</div>"
TWO = "<div class=a><p>First text, long enough. It says, what it says.</p></div><div class=b><p>Second text, as long. It says more, too.</p></div>"
TWO_WANT = "First text, long enough. It says, what it says. Second text, as long. It says more, too."


@pytest.mark.parametrize("page, want", [
    (LINKS + TWO + "<div>Imprint</div>", TWO_WANT), (TWO + LINKS, TWO_WANT), (TWO.replace("</div><div", f"</div>{LINKS}<div"), TWO_WANT),
    (TWO.replace("</p></div>", "</p></div><p>Ti.</p>", 1), TWO_WANT.replace("Second", "Ti. Second")),
    (f"<div>Motto</div><h2>Head</h2>{TWO}<p><a href=/x>Read more</a></p>", f"Head {TWO_WANT}"),
    (f"<article class=teaser><a href=/y><b>Other</b></a></article><article>{TWO}<a href=/x>Read more</a></article>", TWO_WANT),
    (f"<article><header><h1>Head</h1><p>By me, today.</p></header>{TWO}</article>", TWO_WANT),
    (f"<article><p>Teaser, short.</p></article><div>{LONG}</div>", " ".join(re.sub("<.*?>", " ", LONG).split())),
    ("<a href=/1>One</a> <a href=/2>Two</a>", "One Two"), ("<div class=sidebar><p>All, there is.</p></div>", "All, there is."),
    ("<div class=comments><p>Nice one, thanks.</p></div>", ""),
])
def test_scores_select_the_blocks(page, want):
    assert tag_paths.main_text(f"<html><body>{page}</body></html>") == want


def test_the_scores_decide(monkeypatch):
    pages = [f"<body>{LINKS}{TWO}<div>Imprint</div></body>", f"<body><div>Motto</div><ul><li>x</ul>{TWO}</body>"]
    assert all(tag_paths.main_text(p) == TWO_WANT for p in pages)
    monkeypatch.setattr(tag_paths, "path_scores", lambda nodes: {e.path: 1.0 for e, _ in nodes})
    assert all(tag_paths.main_text(p) != TWO_WANT for p in pages)


def test_scores_equal_brute_force():
    """Ratios, smoothing and fusion in loops."""
    rng = random.Random(9)
    for _ in range(30):
        page = "".join(rng.choice(["<p>", "<div>", "</div>", "<a>", "</a>", "<nav>", "</nav>", "<li class=x-side>", "a, b. ", "word ", "x" * 40, "<b>", "</b>"]) for _ in range(60))
        nodes = [(e, t) for e, t, _ in tag_paths.text_nodes(page) if t.strip()]
        if not nodes:
            continue
        fused = [1.0] * len(nodes)
        for measure in (lambda t: len(t.strip()), lambda t: sum(c in ".,;:!?" for c in t)):
            plus = 0 if measure("ab") else 1
            per_path = {}
            for e, t in nodes:
                per_path.setdefault(e.path, []).append((0 if e.link or e.apart else measure(t)) + plus)
            ratio = [sum(per_path[e.path]) / len(per_path[e.path]) for e, _ in nodes]
            smooth, last = [], len(nodes) - 1
            for i, (e, _) in enumerate(nodes):
                near = [(w, min(max(i + d, 0), last)) for d, w in zip(range(-2, 3), (0.1, 0.2, 0.4, 0.2, 0.1))]
                near = [(w * (1 if nodes[j][0].path == e.path else 0.2), ratio[j]) for w, j in near]
                smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
            fused = [f * x / max(max(smooth), 1e-9) for f, x in zip(fused, smooth)]
        want = {}
        for (e, _), f in zip(nodes, fused):
            weight = 0 if e.apart or e.link else 0.05 if e.marked else 1
            want.setdefault(e.path, []).append(f ** 0.5 * weight)
        got = tag_paths.path_scores(nodes)
        assert got.keys() == want.keys() and all(abs(got[k] - sum(v) / len(v)) < 1e-9 for k, v in want.items())


@pytest.mark.parametrize("unit", ["<a ", "<a '", '<a "', "<!x", "<!--x", "</p ", "<p a=<", "<svg>", "<div class=ad>", "<div class=x-ad><article>"])
def test_hostile_pages_take_linear_time(unit):
    def seconds(n):
        page = "<p>Text, here.</p>" + unit * n + ">"
        begun = time.perf_counter()
        tag_paths.main_text(page)
        return time.perf_counter() - begun

    seconds(500)
    assert seconds(16_000) < 10 * seconds(4_000) + 0.5


def test_one_of_several_articles_is_not_lost_for_its_topic():
    page = f"<article class=post>{BODY}</article><article class='post category-legal'>{BODY}</article>"
    assert tag_paths.main_text(page) == f"{WANT} {WANT}"


def test_very_deep_and_very_long_pages():
    page = "<div>" * 20_000 + "abc, d." + "</p>" * 500 + "</div>" * 20_000 + "<p>x" * 10_000 + "<b>y" * 10_000
    assert len(tag_paths.main_text(page)) == 7 + 20_000 + 10_000


def test_odd_pages(odd, none):
    got = tag_paths.query(odd).collect()
    assert len(got) == 10
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == "" and text[3] == "plain & text" and len(text[4]) == 12 * 20_000 - 1 == len(text[None])
    assert tag_paths.query(none).count() == 0


# --- urls ----------------------------------------------------------------------


def _host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host):])[0]


def _judged(url, rules):
    host, path = _host_path(url)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def _check_urls(spark, df, rules):
    from collections import Counter

    table = url_rules.rule_table(spark, rules)
    got = Counter(tuple(r) for r in url_rules.match(df, table).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == Counter((r["page_id"], *_judged(r["url"], rules)) for r in df.select("page_id", "url").collect())


def test_urls_of_pages_and_odd_urls(spark, pages, odd, none):
    for df in (pages, odd, none):
        _check_urls(spark, df, url_rules.RULES)
        _check_urls(spark, df, [])


def test_nested_rules_over_many_runs(spark):
    rng = random.Random(8)
    hosts = ["net", "a.net", "b.a.net", "c.b.a.net", "org", "a.org", "é.org"]
    paths = ["/", "/a", "/a/", "/a/b", "/a/b/c", "/ab", "/é/"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.6]
    urls = [(i, f"http://{rng.choice(['', 'www.', 'x.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '/y?z'])}")
            for i in range(700)]
    urls += [(i, "http://c.b.a.net/a/b/c") for i in range(700, 1100)]  # one url with a third of all rows
    _check_urls(spark, spark.createDataFrame(urls, "page_id long, url string").repartition(5), rules)


def test_block_wins_over_allow_for_the_same_rule(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = url_rules.rule_table(spark, [("a.b", "/", "allow"), ("A.b", "/", "block")])
    assert url_rules.match(df, rules).first()["verdict"] == "block"


def test_no_python_in_the_url_plan(pages):
    plan = url_rules.query(pages)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- archives ------------------------------------------------------------------


def _records(rows):
    best, count = {}, {}
    for i, h in rows:
        p = (h or "").encode()
        if len(p) >= 1000:
            count[p] = count.get(p, 0) + 1
            best[p] = max((x for x in (best.get(p), i) if x is not None), default=None)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        to = best.get(p)
        again = to is not None and i != to
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_archives_of_pages_and_odd_pages(pages, odd, none):
    for df in (pages.unionByName(pages.selectExpr("page_id + 1000 AS page_id", "url", "html")), odd, none):
        rows = [(r["page_id"], r["html"]) for r in df.select("page_id", "html").collect()]
        assert sorted((tuple(r) for r in arc_convert.query(df).collect()), key=str) == _records(rows)


def test_files_roll_by_bytes_and_are_of_both_versions(spark, pages, tmp_path):
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    long = spark.createDataFrame([(-1, None, "x" * 100_000)], "page_id long, url string, html string")
    pages = pages.unionByName(long)
    limit, longest = 30_000, pages.selectExpr("max(length(html))").first()[0]
    arc_convert.write_arc(pages.coalesce(1), arc, file_bytes=limit)
    arc_convert.convert(spark, arc, warc, file_bytes=limit)
    versions, sizes = {}, []
    for f in (tmp_path / "arc").glob("*.gz"):
        content = gzip.decompress(f.read_bytes())
        versions[content.split(b"\n")[1][:1]] = content
        sizes.append(len(content))
        assert list(arc_convert.parse_arc(content)) == list(arc_convert.parse_arc(f.read_bytes()))
    assert set(versions) == {b"1", b"2"}
    assert len(sizes) > 3 and max(sizes) < limit + longest + 1000
    # The offsets that version 2 states are where its records begin.
    second = versions[b"2"]
    for record in arc_convert.parse_arc(second):
        at = second.index(record.block)
        line = second[:at].rstrip(b"\n").rsplit(b"\n", 1)[-1]
        assert second.index(line) == int(line.split(b" ")[-3])
    for f in (tmp_path / "warc").glob("*.gz"):
        (first, _), *rest = arc_convert.parse_warc(f.read_bytes())
        assert first["warc-type"] == "warcinfo"
        for fields, block in rest:
            assert fields["warc-date"] == "2024-01-01T00:00:00Z"
            assert fields["warc-block-digest"] == arc_convert._sha1(block)
    records = arc_convert.read_warc(spark, warc)
    assert records.count() == pages.count()
    # What revisits refer to by identifier and by key is one record, a response.
    ids = {r["key"]: (r["record_id"], r["record_type"]) for r in records.collect()}
    for r in records.where("record_type = 'revisit'").collect():
        assert ids[r["refers_to"]] == (r["refers_to_id"], "response")


def test_archives_with_keys_of_text(spark):
    html = "<p>" + "word " * 300
    rows = [("a", html), ("b", html), ("z %41\r\n\u00e9", html), ("", "short"), (None, html)]
    pages = spark.createDataFrame([(k, "http://a/", h) for k, h in rows], "page_id string, url string, html string")
    assert sorted((tuple(r) for r in arc_convert.query(pages).collect()), key=str) == _records(rows)


def test_foreign_and_broken_arc_files():
    body = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n\xff\xfe not text\n\nhttp://not.a/header 1 2 3 4\n"
    one = (b"filedesc://a.arc 1.2.3.4 19960101000000 text/plain 69\n1 0 Some Archive\n"
           b"URL IP-address Archive-date Content-type Archive-length\n\n")
    assert len(one.split(b"\n", 1)[1]) >= 69
    size = one.index(b"\n") + 1
    block = one[size:]
    head = f"filedesc://a.arc 1.2.3.4 19960101000000 text/plain {len(block)}\n".encode()
    file = head + block + b"\nhttp://a/ 1.2.3.4 19960102030405 text/html %d\n" % len(body) + body + b"\n"
    (record,) = arc_convert.parse_arc(file)
    assert record.block == body and record.date == "19960102030405"
    ((fields, got),) = arc_convert.parse_warc(arc_convert.warc_record(record) + b"\r\n\r\n")
    assert got == body and fields["warc-date"] == "1996-01-02T03:04:05Z" and fields["warc-target-uri"] == "http://a/"
    with pytest.raises(ValueError):
        list(arc_convert.parse_arc(file[:-20]))
    with pytest.raises(ValueError):
        list(arc_convert.parse_arc(file.replace(b"text/html ", b"text/html x ")))
