"""WARC archives read back, and main text of pages."""

import hashlib
import io

import pytest

from shardfit.llm import templates, warc

LONG = "<p>" + "é text of some length " * 80 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h.example/{i}?q=a b", f"<html><body><nav>menu</nav><article><p>Page {i} {'word ' * (i % 37)}</p></article></body></html>", 1)
            for i in range(300)]
    rows += [(1000 + i, "http://x.example/é", LONG, 1) for i in range(5)] + [(1004, None, LONG, 1), (None, None, LONG, 1)]
    rows += [(2000, None, None, 1), (2001, "", "", 1), (2002, None, "short", 1), (2003, None, "short", 1), (2004, None, "x" * 3_000_000, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)


def test_round_trip(spark, pages):
    table = warc.decisions(pages, "page_id", "html")
    written = warc.write(table)
    archives = written.collect()
    back = warc.read(spark, written).collect()
    rows = pages.collect()
    assert sum(a["records"] for a in archives) == len(back) == len(rows)
    text = sorted((str(r["page_id"]), hashlib.sha1((r["html"] or "").encode()).hexdigest(), len((r["html"] or "").encode())) for r in rows)
    assert sorted((str(r["key"]), r["payload_digest"], r["payload_bytes"]) for r in back) == text
    kinds = sorted((str(r["key"]), r["record_type"], r["refers_to"]) for r in back if r["record_type"] == "revisit")
    assert kinds == [(str(1000 + i), "revisit", 1004) for i in range(4)] + [("None", "revisit", 1004)]
    assert all(r["payload"] is None for r in back if r["record_type"] == "revisit")
    assert [bytes(r["payload"]) for r in back if r["key"] == 2004] == [b"x" * 3_000_000]
    path = archives[0]["path"].removeprefix("file://")
    with open(path, "rb") as f:
        raw = f.read()
    assert raw[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") and int.from_bytes(raw[4:8], "little") > 0
    fields, body = warc.parsed(next(warc.frames(io.BytesIO(raw))))
    assert fields["WARC-Type"] == "response" and hashlib.sha1(body).hexdigest() == fields["WARC-Payload-Digest"][5:]


def test_archive_edges(spark, pages):
    assert warc.archive(pages.limit(0)).count() == 0
    few = warc.archive(pages.where("page_id = 2002")).collect()  # too few records for a dictionary
    assert [(r["page_id"], bytes(r["payload"])) for r in few] == [(2002, b"short")]
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"not an archive")))


CASES = {
    "<article><h1>T &amp; t</h1><p>One<br>two  <b>x</b>y</p><p>Three</article><footer>f</footer>": "T & t\n\nOne two xy\n\nThree",
    "<nav>m</nav><div class='ad box'>buy</div><main><p>Text</p><aside>s</aside><form>q</form></main>": "Text",
    "<article><p>A<script>var x='<p>';</script>b</p><div class=comments><p>reader</p></div></article>": "Ab",
    "<div id=cookie-notice>c</div><header>h</header><article><header><h2>In</h2></header>x<!-- <p>no</p> -->y</article>": "In\n\nxy",
    "<nav>open<article><p>kept &lt;b&gt;</p></article>": "kept <b>",
    "<body><div class=menu>m</div><div class=body><p>long text of the page</p><p>more</p></div></body>": "long text of the page\n\nmore",
    "plain text": "plain text", "": "", "<<>><a": "<<>>", "<p title='a>b'>q": "q",
    "<article>caf&eacute; &#233; &amp</article>": "café é &",
    # asides stay asides, and no word of a class takes an article away
    "<section id=\"comments\"><article><p>Reader says hi": "",
    "<aside><article><p>Sidebar story": "",
    "<article><p>Own</p></article><section id=comments><article><p>Reader says hi</p></article></section>": "Own",
    "<article class=\"share-story\"><p>Told</p></article>": "Told",
    "<article><p>a</p><div class=\"market-share-analysis\"><p>b</p></div><div class=\"share-links\">c</div></article>": "a\n\nb",
    "<body class='login sidebar-left'><article class=comment>x</article><main class=search><p>y</p></main>": "y",
    "<nav><ul><li>m</ul></nav><div class='site-header'>h</div><div class=story><header>in</header><p>p</p></div>": "p",
}


def test_main_text():
    for page, want in CASES.items():
        assert templates.main_text(page, {}) == want, page


def test_templates(spark):
    def page(i, article):
        return (f"<html><body><nav><a>Home {i}</a></nav><div class=wrap><p>Read it aloud</p><div class=story>{article}</div>"
                f"<div class=other><p>tail {i}</p></div></div></body></html>")

    texts = {i: [f"Paragraph {i} {j} " + "word " * (5 + (i * j) % 9) for j in range(1 + i % 4)] for i in range(40)}
    rows = [(i, "https://www.h.example/a" if i % 2 else "http://h.example:80/b", page(i, "".join(f"<p>{t}</p>" for t in ts)), "z")
            for i, ts in texts.items()]
    rows += [(100, None, None, "z"), (101, "nonsense", "", "z"), (None, "http://one.example", "<article>single</article>", "z"), (5, *rows[5][1:])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    deduced = {r["host"]: r["tokens"] for r in templates.deduce(table).collect()}
    assert set(deduced) == {"h.example"}
    path = None
    for name, attrs in (("html", ""), ("body", ""), ("div", "class=wrap"), ("p", "")):
        path = templates.Element(name, attrs, path)
    assert templates.token("text", path.path, "Read it aloud") in {t["token"] for t in deduced["h.example"] if t["root"]}
    got = templates.extract(table).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert all(by[i] == "\n\n".join(" ".join(t.split()) for t in ts) for i, ts in texts.items())
    assert by[100] == by[101] == "" and by[None] == "single"
    assert templates.extract(table.limit(0)).count() == 0


def stories(n, box, inside=True):
    """Pages of one host with a story each; every other one has a box in it."""
    out = []
    for i in range(n):
        name = "article" if inside else "div class=story"
        parts = [f"<p>Story {i} begins</p>", box if i % 2 else "", f"<p>and {i} ends {'so ' * (20 + i)}</p>"]
        out.append(f"<html><body><div class=top><a>Home</a></div><{name}>{''.join(parts)}</{name.split()[0]}>"
                   f"<div class=low><p>{i} seen</p></div></body></html>")
    return out


def extracted(spark, pages):
    table = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in templates.extract(table).collect()}


def story(i):
    return f"Story {i} begins\n\nand {i} ends {'so ' * (20 + i)}".strip()


def test_optional_block_goes(spark):
    box = "<div class=x1><p>Read our other stories</p><b>now</b></div>"
    for inside in (True, False):
        got = extracted(spark, stories(12, box, inside))
        assert got == {i: story(i) for i in range(12)}


def test_copied_pages_keep_their_text(spark):
    pages = stories(12, "")
    copies = ["<html><body><article id=a7><p>Once written, often copied</p></article></body></html>"] * 6
    got = extracted(spark, pages + copies)
    assert all(got[i] == "Once written, often copied" for i in range(12, 18))


def test_odd_pages_leave_the_template(spark):
    notice = "<p>" + "This notice stands on each page, however long it may be. " * 4 + "</p>"
    pages = [p.replace("<div class=low>", notice + "<div class=low>").replace("</p><p>and", f"</p>{notice}<p>and")
             for p in stories(20, "", False)]
    odd = ["", None, "<html><body><div class=top><a>Home</a></div><div class=st", "<html><body><h1>Not found</h1></body></html>"]
    got = extracted(spark, pages + odd)
    assert {i: got[i] for i in range(20)} == {i: story(i) for i in range(20)}
    assert got[20] == got[21] == ""


def test_long_page():
    deep = "<div>" * 3000 + "<article><p>" + "word " * 100_000 + "</article>"
    assert len(templates.main_text(deep, {})) == 499_999


def test_very_deep_pages_are_linear():
    import tracemalloc

    page = '<div class="a">' * 30_000 + "<p>" + "text " * 10 + "</span>" * 30_000
    tracemalloc.start()
    assert templates.main_text(page, {}) == "text " * 9 + "text" and len(templates.occurrences(page)) > 30_000
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def by_vectors(pages):
    """Root and further classes of one host, with the occurrence vectors of all tokens built out."""
    counts = [dict((t, (n, place, tag)) for t, n, place, tag in templates.occurrences(p or "")) for p in pages]
    known = [i for i, c in enumerate(counts) if c]
    if len(known) < templates.LEAST_PAGES or len({pages[i] for i in known}) < 2:
        return None
    tokens = {t for c in counts for t in c}
    vector = {t: tuple(c[t][0] if t in c else 0 for c in counts) for t in tokens}
    on = {t: [i for i in known if t in counts[i]] for t in tokens}
    mean = {t: sum(counts[i][t][1] for i in on[t]) / len(on[t]) for t in tokens}
    tag = {t: any(counts[i][t][2] for i in on[t]) for t in tokens}
    root = {t for t in tokens if t and vector[t] == vector[0]}
    edges = [mean[t] for t in root if tag[t]]
    classes = {}
    for t in tokens - root - {0}:
        enough = len(on[t]) >= max(templates.SUPPORT * len(known), templates.LEAST_PAGES)
        if len(on[t]) > 1 and enough and len({pages[i] for i in on[t]}) > 1:
            classes.setdefault(vector[t], []).append(t)
    nested = set()
    for v, members in classes.items():
        slots = {sum(e <= mean[t] for e in edges) for t in members}
        once = all(n <= 1 for n in v)
        tags, share = sum(tag[t] for t in members), sum(n > 0 for n in v) / len(known)
        if tags and (once or len(slots) == 1) and (tags < len(members) or (once and share >= templates.LAYOUT)):
            nested |= set(members)
    return root, nested


def test_classes_equal_those_of_built_vectors(spark):
    import random

    rng = random.Random(11)
    hosts = {}
    for h in range(6):
        parts = [f"<div class=c{k}><p>part {k}</p><b>{'x' * k}</b></div>" for k in range(6)]
        odds = [rng.choice([0.1, 0.5, 1.0]) for _ in parts]
        made = []
        for i in range(rng.choice([3, 9, 25])):
            own = "".join(f"<p>own {rng.randrange(30)}</p>" for _ in range(rng.randrange(4)))
            body = "".join(p * rng.choice([1, 1, 2]) for p, o in zip(parts, odds) if rng.random() < o)
            made.append(f"<html><body><h1>Site</h1>{body}<div class=story>{own}</div></body></html>")
        made += [made[0]] * 2 + ["", None]
        hosts[f"h{h}.example"] = made
    rows = [(i, f"http://{h}/{i}", p) for h, ps in hosts.items() for i, p in enumerate(ps)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["host"]: ({t["token"] for t in r["tokens"] if t["root"]}, {t["token"] for t in r["tokens"] if not t["root"]})
           for r in templates.deduce(table).collect()}
    want = {h: v for h, ps in hosts.items() if (v := by_vectors(ps)) and (v[0] or v[1])}
    assert got == want and any(v[1] for v in want.values())
