"""Chats, packing, fingerprints, page texts."""

import hashlib
import itertools
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexigauge.llm import html_extract, packing, prefix_hash, quotation


def test_chat(spark):
    rows = [
        (1, 0, "user", "First line here.\nSecond  line"), (1, 1, "assistant", "An answer\n\nwith two parts"), (1, 2, "user", "> first line   HERE.\n> second line\nAbout the first."), (1, 3, "assistant", ">> First line here.\n>> Second line\n> About the first.\nDeep"),
        (1, 4, "user", "> with two parts\nabout parts\n> not said by anyone"), (1, 4, "user", "> with two parts\nabout parts\n> not said by anyone"), (1, 5, "user", "Unlinked"), (2, 0, None, None), (2, None, "user", "no turn"), (None, 1, "user", "x\n> y"), (None, 2, "user", "> x\nz"), (3, 0, "user", "> only a quote"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, c string")
    got = {(r["conv_id"], r["turn"], r["role"]): r for r in quotation.thread_messages(df).collect()}
    assert got[1, 2, "user"]["reply_to"] == 0 and got[1, 2, "user"]["body"] == "About the first." and got[1, 2, "user"]["n_quotes"] == 1
    assert got[1, 3, "assistant"]["reply_to"] == 2 and got[1, 3, "assistant"]["root"] == 0 and got[1, 3, "assistant"]["n_linked"] == 2
    assert got[1, 4, "user"]["reply_to"] == 1 and got[1, 4, "user"]["root"] == 1 and got[1, 5, "user"]["reply_to"] is None
    assert got[None, 2, "user"]["reply_to"] == 1
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    columns = ["conv_id", "part", "n_messages", "n_quotes", "n_linked", "chat"]
    expected = sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({quotation.SQL})").fetchall()))
    chats = quotation.format_chats(df)
    assert sorted(str(tuple(r[c] for c in columns)) for r in chats.collect()) == expected
    first = next(r["chat"] for r in chats.collect() if r["conv_id"] == 1)
    assert [first.index(x) for x in ("First line", "About the first", "Deep", "An answer", "about parts", "Unlinked")] == sorted(first.index(x) for x in ("First line", "About the first", "Deep", "An answer", "about parts", "Unlinked"))
    assert ">" not in first.replace("|>", "")
    assert quotation.format_chats(df.limit(0)).count() == 0


def test_chat_by_lines(spark):
    """Two lines out of a longer paragraph link to the message that has them; lines of two messages do not."""
    rows = [(1, 0, "a", "one\ntwo\nthree\nfour"), (1, 1, "b", "two\nfive"), (1, 2, "a", "> two\n> three\nyes"), (1, 3, "b", "> five\n> four\nno"), (1, 4, "b", "> TWO\n> five \nagain")]
    got = {r["turn"]: r["reply_to"] for r in quotation.thread_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: None, 4: 1}  # "three" was last said by the first message, which has "two" as well
    rows[1] = (1, 1, "b", "five")
    got = {r["turn"]: r["reply_to"] for r in quotation.thread_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: None, 4: None}


@pytest.mark.parametrize("segment", [2, 3, 7, 512])
def test_chat_order_in_parts(spark, segment):
    """The parts of a conversation one after the other are the conversation, whatever their size: threads, ties and null turns included."""
    g = random.Random(3)
    said = [f"message {k} {g.random()}" for k in range(60)]
    rows = [(7, k, g.choice(["user", "assistant"]), (f"> {said[g.randrange(k)]}\n" if k and g.random() < 0.6 else "") + said[k]) for k in range(60)]
    rows += [(7, 11, "user", f"tie {n}") for n in range(9)] + [(7, None, "user", f"no turn {n}") for n in range(9)] + [(8, 0, "x", "y"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r["conv_id"]: r["chat"] for r in quotation.format_chats(df, 10_000).collect()}
    parts = {}
    for r in quotation.format_chats(df, segment).orderBy("part").collect():
        parts.setdefault(r["conv_id"], []).append(r)
    assert {c: "\n".join(r["chat"] for r in p if r["chat"]) for c, p in parts.items()} == whole
    assert all(r["part"] == k and (r["n_messages"] == segment or k == len(p) - 1) for p in parts.values() for k, r in enumerate(p))
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert sorted(con.execute(f"SELECT conv_id, chat FROM ({quotation.SQL})").fetchall(), key=str) == sorted(whole.items(), key=str)


def test_chat_of_very_long_texts(spark):
    """Lines of very many marks and messages of very many lines."""
    rows = [(1, 0, "a", ">" * 100_000 + " deep"), (1, 1, "b", "\n".join(f"{'> ' if k % 2 else ''}line {k}" for k in range(200_000))), (1, 2, "a", "> line 0\nyes")]
    got = {r["turn"]: r for r in quotation.thread_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[0]["n_quotes"] == 1 and got[0]["body"] == "" and got[1]["n_quotes"] == 100_000 and got[2]["reply_to"] == 1


def test_replies_made_of_given_conversations(spark):
    rows = [(c, k, "u", f"Line {c} {k} a\nline {k} b\nline c") for c in range(5) for k in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    columns = "conv_id, part, n_messages, n_quotes, n_linked, chat"
    made = quotation.format_chats(quotation.with_quotes(df))
    got = sorted(tuple(r[c] for c in columns.split(", ")) for r in made.collect())
    assert got == sorted(con.execute(f"SELECT {columns} FROM ({quotation.QUOTED_SQL})").fetchall()) and sum(r[4] for r in got) == 20


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = quotation.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def least_padding(counts, buckets):
    lengths = sorted(counts)
    return min(packing.padding(counts, sorted({*some, lengths[-1]})) for k in range(buckets) for some in itertools.combinations(lengths[:-1], k))


def test_boundaries():
    g = random.Random(5)
    for _ in range(60):
        counts = {g.randrange(1, 60): g.randrange(1, 30) for _ in range(g.randrange(1, 9))}
        buckets = g.randrange(1, 5)
        ends = packing.boundaries(counts, buckets)
        assert len(ends) <= buckets and ends == sorted(ends) and ends[-1] == max(counts)
        assert packing.padding(counts, ends) == least_padding(counts, buckets)
    assert packing.boundaries({}) == []


def test_pack(spark):
    rows = [(i, " ".join(["w"] * (i % 50))) for i in range(300)] + [(1000, "long " * 5000), (None, None), (1001, ""), (5, "w w"), (5, "w w")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, batch_id string")
    got = packing.pack(df, max_tokens=512, buckets=4, budget=1024, shard=20).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) for _, t in rows)
    assert len(got) == len(rows) + 5000 // 512 and max(r["bucket_len"] for r in got) == 512
    batches = {}
    for r in got:
        batches.setdefault(r["batch_id"], []).append(r)
        assert 0 <= r["padding"] == r["bucket_len"] - r["n_tokens"]
    for name, b in batches.items():
        assert sorted(r["slot"] for r in b) == list(range(len(b))) and len({r["bucket_len"] for r in b}) == 1
        assert b[0]["bucket_len"] * len(b) <= 1024
    sizes = {}
    for name, b in batches.items():
        sizes.setdefault(b[0]["bucket_len"], []).append(len(b))
    assert all(sorted(s)[1:] == [max(s)] * (len(s) - 1) for s in sizes.values())  # all batches of a bucket but one are full
    counts = {}
    for r in got:
        counts[r["n_tokens"]] = counts.get(r["n_tokens"], 0) + 1
    assert sum(r["padding"] for r in got) == packing.padding(counts, packing.boundaries(counts, 4))
    texts = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        assert len(r["text"]) == r["end"] - r["begin"] and len(r["text"].split()) == r["n_tokens"]
        if r["doc_id"] in (999, 1000):
            texts[r["doc_id"]] = texts.get(r["doc_id"], "") + r["text"]
    assert texts == {1000: "long " * 5000}
    again = packing.pack(df.repartition(7), max_tokens=512, buckets=4, budget=1024, shard=20).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))  # the same batches however the rows are spread
    assert packing.pack(df.limit(0)).count() == 0


def test_equal_rows_are_spread(spark):
    """A third of all rows alike, without an id: they fill batches of every shard."""
    df = spark.createDataFrame([(None, "a b c")] * 300 + [(i, f"a b c{i}") for i in range(600)], "doc_id long, text string")
    got = packing.pack(df, budget=30, shard=100).collect()
    assert len(got) == 900 and sum(r["doc_id"] is None for r in got) == 300
    assert len({r["batch_id"] for r in got if r["doc_id"] is None}) > 60


def test_sequences():
    g = random.Random(6)
    for _ in range(300):
        t = "".join(g.choice("ab \t\né\u00a0\u3000🙂") for _ in range(g.randrange(60)))
        made = packing.sequences(t, 3)
        assert "".join(t[a:b] for _, a, b in made) == t and [n for n, _, _ in made] == [len(t[a:b].encode().split()) for _, a, b in made]
        assert all(n == 3 for n, _, _ in made[:-1]) and (made[-1][0] > 0 or len(made) == 1)
        assert packing.sequences(t, 3, packing.white_space_tokens) == made
    assert packing.sequences("abcd", 2, lambda t: range(len(t))) == [(2, 0, 2), (2, 2, 4)]


def test_prefix_hashes():
    g = random.Random(8)
    a = "".join(g.choice("abé漢🙂") for _ in range(400))
    b = "x" * 37 + a[100:300] + "y" * 5
    p, q = prefix_hash.Prefixes(a), prefix_hash.Prefixes(b)
    for _ in range(400):
        i, j, n = g.randrange(400), g.randrange(len(b)), g.randrange(60)
        assert p.equal(i, q, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
    assert p.common(100, q, 37) == next(n for n in range(200, 260) if a[100 : 101 + n] != b[37 : 38 + n])
    assert p.common(0, p, 0) == 400
    assert prefix_hash.fingerprint(a)[0] == prefix_hash.fingerprint(a)[0] != prefix_hash.fingerprint(b)[0]
    like = lambda s, t: prefix_hash.likeness(prefix_hash.fingerprint(s)[0], prefix_hash.fingerprint(t)[0])
    assert like(a, a) == 1 and like("", "") == 1 and like("", a) == 0 and like(a, a[:300] + "z" * 100) > 0.5 > 0.05 > like(a, "".join(g.choice("mnopq") for _ in range(400)))


def spans_by_hand(text):
    """The fingerprint's bag of spans, read off the text."""
    n = next(span for least, span in prefix_hash.SPANS if len(text) >= least)
    return Counter(text[i : i + n] for i in range(max(1, len(text) - n + 1))) if text else Counter()


def likeness_by_hand(a, b):
    x, y = spans_by_hand(a), spans_by_hand(b)
    return 1.0 if a == b else sum((x & y).values()) / max(1, sum((x | y).values()))


def test_span_hashes():
    """Equal spans have equal hashes wherever they are, in texts of any length; others differ."""
    g = random.Random(2)
    texts = ["".join(g.choice("ab🙂") for _ in range(g.randrange(20, 300))) for _ in range(12)]
    for n in (2, 4, 16):
        seen = {}
        for t in texts:
            for i, h in enumerate(prefix_hash.Prefixes(t).spans(n).tolist()):
                assert seen.setdefault(h, t[i : i + n]) == t[i : i + n]
        assert len(seen) == len({t[i : i + n] for t in texts for i in range(len(t) - n + 1)})


@pytest.mark.parametrize("per_range", [2000, 3])
def test_edits(spark, per_range):
    """All columns against values by hand; likeness against the bags of spans that the sketch estimates."""
    g = random.Random(8)
    text = lambda n: "".join(g.choice("abc défg") for _ in range(n))
    rows = [(i * 3, text(g.randrange(600))) for i in range(30)] + [(12, "tie"), (12, "tie"), (None, "no id"), (None, None), (5, "x" * 20000), (6, "")]
    rows += [(40, text(50)) for _ in range(40)] + [(None, text(g.randrange(90))) for _ in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, range string")
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""]), reverse=True)
    expected, near = [], {}
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        m = len(t) // 3
        e = t[: len(t) - m] + following[:m]
        begin = len(os.path.commonprefix([t, e]))
        end = min(len(os.path.commonprefix([t[::-1], e[::-1]])), len(t) - begin) if begin < len(t) else 0
        key = (str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), prefix_hash.fingerprint(t)[0], prefix_hash.fingerprint(e)[0], True, begin, end)
        expected.append(key)
        near[key] = likeness_by_hand(t, e), likeness_by_hand(t, following)
    got = {(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["same_before"], r["same_at_begin"], r["same_at_end"]): (r["near_edited"], r["near_next"]) for r in prefix_hash.edits(df, per_range=per_range).collect()}
    assert sorted(got) == sorted(set(expected))
    for key, (to_edited, to_next) in got.items():
        assert to_edited == pytest.approx(near[key][0], abs=0.25) and to_next == pytest.approx(near[key][1], abs=0.25)
    assert np.mean([abs(got[k][0] - near[k][0]) for k in got]) < 0.05
    assert prefix_hash.edits(df, per_range=per_range).count() == len(rows) and prefix_hash.edits(df.limit(0)).count() == 0
    one = prefix_hash.edits(df.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_edited"] == 1.0 and one[0]["same_at_begin"] == 20000
    assert sorted(r["fingerprint"] for r in prefix_hash.fingerprints(df).collect()) == sorted(prefix_hash.fingerprint(t or "")[0] for _, t in rows)


PAGES = [
    ("<html><head><title>T</title></head><body><nav>Menu</nav><article><h1>Head &amp; line</h1><p>One\n  two<br>three<p>Four</article><footer>F</footer></body></html>", "Head & line\n\nOne two three\n\nFour"),
    ("<body><div class='sidebar'>S</div><main><p>Text</p><aside>A</aside><form>f</form><script>var a='<p>x</p>';</script></main>", "Text"),
    ("<body><p>Open <b>bold <i>it</b> end<ul><li>a<li>b</ul>", "Open bold it end\n\na\n\nb"),
    ("<article><p>Body</p><section id='comments'><p>me too</p></section><div class=\"ad-banner\">Buy</div></article>", "Body"),
    ("<article><p>cut off &amp here</p><p clas", "cut off & here"),
    ("<body><!-- <p>no</p> --><p>&lt;b&gt; &#x41;&eacute;</p><style>p{}</style>", "<b> Aé"),
    ("<div class=header-text>kept</div><div class='cookieNotice'>gone</div>", "kept"),
    ("", ""), (None, ""), ("plain   text", "plain text"), ("<p>" * 5000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"),
    ('<body><div class="content no-sidebar"><p>Real story</p></div>', "Real story"), ("<body id='has-banner'><div id=has-banner>Text</div>", "Text"), ("<body><p>Story here</p><ul class=commentlist><li>Me too, and much longer than the story</ul>", "Story here"),
    ("<div class='notice-board widget'><p>All the text of the page</p></div><p>x</p>", "All the text of the page\n\nx"), ("</b></i><p>a</p></p></div>b", "a\n\nb"), ("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table><td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"),
    ("<article><header><h1>Title</h1></header><p>x</p></article><article class=comment><p>c</p></article>", "Title\n\nx"),
]


@pytest.mark.parametrize("source, expected", PAGES)
def test_main_text(source, expected):
    assert html_extract.main_text(source or "") == expected


def test_templates(spark):
    """What recurs across a host's pages goes, whatever it is called; what is in an article stays; other hosts do not matter."""
    page = lambda k: f"<body><div><p>Welcome to our site</p><p>Visit us daily</p></div><div><p>Story {k} is about {k * k}.</p></div><div>All rights kept</div></body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(20)] + [(100, "http://b.example/1", page(7)), (101, None, None), (102, "http://a.example/1", page(1))]
    rows += [(200 + k, f"http://c.example/{k}", f"<article><p>Own {k}</p><p>Same quote</p><p>More {k}</p></article>") for k in range(20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[3] == "Story 3 is about 9." and got[102] == got[1] == "Story 1 is about 1."
    assert got[100].startswith("Welcome") and got[101] == "" and got[205] == "Own 5\n\nSame quote\n\nMore 5"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_templates_inside_articles(spark):
    """What recurs at the edges of a host's articles goes; a quotation between a page's own words stays, and so does what few pages have."""
    page = lambda k: f"<article><div><p>Read on our phones</p><p>Every day</p></div><h1>Story {k}</h1><p>Quoted by all</p><p>Words {k}.</p>{'<p>Part of a series.</p>' if k < 4 else ''}<p>Thanks for reading</p></article>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(20)] + [(50, "http://b.example/", page(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[9] == "Story 9\n\nQuoted by all\n\nWords 9." and got[3] == "Story 3\n\nQuoted by all\n\nWords 3.\n\nPart of a series."
    assert got[50].startswith("Read on") and got[50].endswith("Thanks for reading")
    bare = sum(html_extract.main_text(h) != got[k] for k, _, h in rows)
    assert bare == 20  # so many of the 21 texts are what they are through the template


def test_pages_without_articles(spark):
    """Sites of three makes without a single <article> or telling name: menus, headings of the site, notices and footers go by counting; own texts stay whole."""
    words = "river stone light paper winter garden music silver market bridge".split()
    own = lambda g: [" ".join(g.choice(words) for _ in range(g.randrange(6, 40))) + f" {g.randrange(10**6)}." for _ in range(g.randrange(2, 6))]
    makes = (
        lambda k, t: f"<body><table><tr><td><a href=/>Home</a><br><a href=/n>News of the day</a><td>{''.join(f'<p>{x}' for x in t)}<tr><td colspan=2>Written by the staff of the valley paper</table>",
        lambda k, t: f"<div><div>The Evening Post</div><div>Today is day {k}</div>{''.join(f'<div>{x}</div>' for x in t)}<div><ul><li>Imprint and contact</li><li>Terms of this site</li></ul></div></div>",
        lambda k, t: f"<body><center><b>Welcome, dear visitor, to my page</b></center><hr>{'<br><br>'.join(f'<p>{x}</p>' for x in t)}<p>Section {k % 3}: all stories in one place</p><hr><i>Best seen with open eyes</i></body>",
    )
    g = random.Random(12)
    texts, rows = {}, []
    for h, make in enumerate(makes):
        for k in range(30):
            texts[100 * h + k] = own(g)
            rows.append((100 * h + k, f"https://site{h}.example/{k}", make(k, texts[100 * h + k])))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, t in texts.items():
        expected = "\n\n".join([*([f"Today is day {k - 100}"] if 100 <= k < 200 else []), *t])
        assert got[k] == expected


def test_names_of_parts(spark):
    """A name goes where it recurs on its host, whatever it says there; once on a large host it stays."""
    page = lambda k: f"<body><p>Story {k} of the day, told at length and in full.</p><div class='promo-{k}'>Buy {k}</div>{'<div class=toolbar>My toolbar is a wrench</div>' if k == 7 else ''}</body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(12)] + [(90, "http://b.example/", page(7))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story = lambda k: f"Story {k} of the day, told at length and in full."
    assert got[3] == story(3) and got[7] == story(7) + "\n\nMy toolbar is a wrench" and got[90] == story(7)


def test_unmatched_tags_take_time_in_proportion():
    """200,000 open elements and end tags without a start."""
    source = "<span>x</p></b>" * 100_000 + "<p>" * 50_000 + "end"
    assert html_extract.main_text(source).endswith("x\n\nend")
    assert html_extract.main_text("<ul>" + "<li>" * 100_000 + "a</table></td></tr>" * 50_000).count("a") == 50_000


def test_copied_articles_inside_wrappers(spark):
    """An article that many pages of a host carry stays, whatever is around it; a comment's wrapper goes."""
    whole = lambda k: f"<body><p>Menu {k}</p><main><div id=content><article><p>The same story.</p></article></div></main><p>Advert {k}</p></body>"
    noted = lambda k: f"<body><div><p>Hello all</p><article class=comment><p>Me too</p></article></div><p>Own {k}</p></body>"
    rows = [(k, f"http://a.example/{k}", whole(k)) for k in range(20)] + [(100 + k, f"http://b.example/{k}", noted(k)) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "The same story." and got[100 + k] == f"Own {k}" for k in range(20))


def test_templates_of_a_large_host(spark):
    """One of ten notices and a section's menu go from a host of 400 pages as from a small one; short cells and what few pages have stay."""
    page = lambda k: f"<body><ul><li>Section {k % 8} front</li><li>Section {k % 8} archive</li></ul><p>Notice {k % 10}: our shop has moved.</p><table><tr><td>{k % 40}</td><td>Row {k}</td></tr></table><p>Story {k}.</p><p>Quoted by {k % 80} and four others.</p></body>"
    df = spark.createDataFrame([(k, f"http://a.example/{k}", page(k)) for k in range(400)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert len(got) == 400 and all(got[k] == f"{k % 40}\n\nRow {k}\n\nStory {k}.\n\nQuoted by {k % 80} and four others." for k in got)
