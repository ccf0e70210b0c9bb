import base64
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from leafmill.llm import warc
from leafmill.llm.pages import extract_pages, host_rules
from leafmill.llm.wrappers import ASIDE_TAGS, blocks, expression, main_text, merge, parse, rules_of, wrapper_of

SHELL = (
    '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
    '<header>Head</header><nav><ul><li><a href="/a">A</a></li>{li}</ul></nav><!-- x --><div class="ad">Buy</div>'
    "{body}<aside>Side</aside><div id='comments'><p>Reader</p></div><footer>&copy; F</footer></body></html>"
)


def page(body, items=1):
    return SHELL.format(body=body, li='<li><a href="/b?x=1&amp;y=2">B</a></li>' * items)


def sums_of(root):
    """Characters and links below each path of a page."""
    sums = {}
    for path, text, links in blocks(root):
        keys = path.split("/")
        if not any(k.partition(".")[0] in ASIDE_TAGS for k in keys):
            for up in {"/".join(keys[:n]) for n in range(len(keys) + 1)}:
                t, k = sums.get(up, (0, 0))
                sums[up] = (t + len(text), k + links)
    return sums


def alone(source):
    """The text of a page that is its host's only one."""
    root = parse(source)
    starts, drop = rules_of(wrapper_of(root), sums_of(root))
    return main_text(root, frozenset(starts), frozenset(drop))


def test_wrapper_of_pages_is_union_free():
    a = wrapper_of(parse("<ul><li>1<li>2<li>3</ul><p>x"))
    b = wrapper_of(parse("<ul><li>1</ul><h1>t</h1><p>x<p>y"))
    assert expression(merge(a, b)) == expression(merge(b, a)) == "<ul>(<li>#</>)+</> (<h1>#</>)? (<p>#</>)+"
    dl = wrapper_of(parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert expression(dl) == "<dl>((<dt>#</> <dd>#</>))+</>"


def test_main_without_article_is_the_element_with_most_text():
    assert alone('<div class="top">short</div><div id="content"><p>' + "long text " * 20 + "<p>more</div><footer>f</footer>") == ("long text " * 20).strip() + "\n\nmore"


def pattern(node):
    """The wrapper as a Python pattern over a page's tokens."""
    inner = "".join(map(pattern, node[3]))
    text = "(?:#)" if node[0] == "#" else f"(?:{inner})" if node[0][:1] == "(" else f"(?:{re.escape('<' + node[0] + '>')}{inner}</>)"
    return text + (("*" if node[1] else "+") if node[2] else "?" if node[1] else "")


def tokens(element):
    out = []
    for child in element.children:
        if isinstance(child, tuple):
            if child[0].strip() and out[-1:] != ["#"]:
                out.append("#")
        else:
            out.append(tokens(child))
    return f"<{element.key}>{''.join(out)}</>"


def test_wrappers_match_all_pages_they_are_made_of():
    rng = random.Random(8)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1)}</{t}>" if depth and rng.random() < 0.6 else rng.choice(["x", "<br>y", ""]) for t in rng.choices(["div", "ul", "li", "section"], k=rng.randint(0, 4)))

    for _ in range(150):
        trees = [parse(some(3)) for _ in range(rng.randint(2, 5))]
        whole = wrapper_of(trees[0])
        for t in trees[1:]:
            whole = merge(whole, wrapper_of(t))
        for t in trees:
            assert re.fullmatch(pattern(whole), tokens(t)), (expression(whole), tokens(t))


def test_slots_tell_template_from_article(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("ka lo mi ter un ves ra so".split()) + str(rng.randrange(99)) for _ in range(n))
    rows, expected = [], {}
    for i in range(8):
        story = [words(40), words(30)]
        links = "".join(f"<li><a href=/{k}>{words(2)}</a>" for k in range(5))
        rows.append((i, f"http://h.example/{i}", f"<body><div class=x1>Welcome to this site, read on</div><div class=box><div class='sidebar'><p>{story[0]}<p>Sign the guest book<p>{story[1]}<ul>{links}</ul></div></div><div class=x2>{words(3)}</div>"))
        expected[i] = "\n\n".join(story)
    rows += [(100 + k, *rows[0][1:]) for k in range(30)]  # copies of a page make no template
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [{r.page_id: r.text for r in extract_pages(df.repartition(n)).collect()} for n in (1, 5)]
    assert got[0] == got[1]
    assert {i: got[0][i] for i in range(8)} == expected and {got[0][100 + k] for k in range(30)} == {expected[0]}


def test_deep_broken_and_many_formed_pages(spark):
    began = time.process_time()
    for piece in ("<a ", "<div ", '<a "', "<a '", "<!--", "<script>", "<div>", "<p class='", "</div", "<"):
        alone(piece * (300_000 // len(piece)) + "text")
    assert time.process_time() - began < 60
    deep = "<article>" + "<div>" * 10_000 + "<p>inner text here" + "</div>" * 10_000 + "<p>after"
    assert alone(deep) == "inner text here\n\nafter"
    assert alone("<article><p>if a<b then c <em>d</em></article>") == "if a<b then c d"
    rows = [(i, "http://h.example/", f"<div class=h{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x><b>t</b></div>" * 3 + f"<article><p>Text {i}</article>") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in extract_pages(df).collect()} == {i: f"Text {i}" for i in range(900)}


def test_extracts_articles(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"http://{'h1' if i % 3 else 'H2'}.example/{i}", page(f"<article><h1>Title {i}</h1><p>One &amp; two\n  three<br>four <b>bold<p>Next&#33; <i>x</i>y</article>", i), "clash"))
    rows.append((100, "http://h3.example/", page("<div class='story'><p>" + "alpha " * 30 + "</p><p>beta</p></div>"), ""))
    rows.append((101, "http://h1.example/none", page("<div><p>No article here</p></div>"), None))
    rows += [(102, None, None, ""), (103, "::bad url::", "", ""), (104, "http://h4.example/", "plain &lt;text&gt;", ""), (105, "http://h5.example/", "<nav>only</nav>", ""), (None, "http://h1.example/z", "<article><p>" + "long " * 5000 + "</article>", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in extract_pages(df).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i].text == f"Title {i}\n\nOne & two three four bold\n\nNext! xy"
        assert got[i].n_chars == len(got[i].text) and got[i].url.endswith(f"/{i}")
    assert got[100].text == ("alpha " * 30).strip() + "\n\nbeta"
    assert got[101].text == "No article here"
    assert [got[i].text for i in (102, 103, 104, 105)] == ["", "", "plain <text>", ""]
    assert got[None].text == ("long " * 5000).strip()
    assert extract_pages(df.limit(0)).count() == 0


def test_derivatives_link_back_and_hold_their_digests(spark):
    rows = [(1, "http://h.example/x/", page("<article><p>Text é</article>", 2)), (2, None, None), (3, "http://h.example/y", "plain"), (3, "http://h.example/y", "plain")]
    responses = warc.responses_of_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    sources = {}
    for r in responses.collect():
        headers, block = warc.parse_record(bytes(r.record))
        assert headers["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        sources[headers["warc-record-id"]] = (headers, block)
    found = warc.derivatives(responses).collect()
    assert len(found) == 8 and len({r.record_id for r in found}) == 6
    for r in found:
        headers, block = warc.parse_record(bytes(r.record))
        source, http = sources[r.refers_to]
        assert headers["warc-type"] == r.warc_type in ("metadata", "conversion")
        assert headers["warc-refers-to"] == source["warc-record-id"]
        assert headers.get("warc-target-uri") == source.get("warc-target-uri") and headers["warc-date"] == source["warc-date"]
        assert headers["warc-payload-digest"] == source["warc-payload-digest"] == warc.digest(http.partition(b"\r\n\r\n")[2])
        assert headers["warc-block-digest"] == warc.digest(block) == r.block_digest and len(block) == r.content_length
        assert block.decode() == r.block
    texts = {r.refers_to: r.block for r in found if r.warc_type == "conversion"}
    assert "Head\nA\nB\nB\nBuy\nText é\nSide\nReader\n© F" in texts.values() and "" in texts.values()
    fields = next(r.block for r in found if r.page_id == 1 and r.warc_type == "metadata")
    assert "title: T\r\n" in fields and "language: en\r\n" in fields and "outlink: http://h.example/b?x=1&y=2\r\n" in fields
    assert fields.count("outlink:") == 2


def test_hostile_payloads_cost_their_length():
    began = time.process_time()
    for piece in ("<a ", "<a href=\"", "<title>", "<script ", "<!--", "<div ", "</p", "<html lang ", "&#", "<a href=x "):
        source = piece * (1_000_000 // len(piece))
        warc.page_fields(source, "http://h.example/")
        warc.page_text(source)
    assert time.process_time() - began < 40


def test_derived_rows_equal_a_plain_reading(spark):
    body = "<html LANG=uk><head><title> A &amp; B </title></head><body><a href=/x>1 < 2</a><A HREF='y#z'>y</A><script><a href=no></script><p>One<p>Two" + " word" * 200_000
    records = warc.responses_of_pages(spark.createDataFrame([(7, "http://h.example/d/", body)], "page_id long, url string, html string"))
    clashing = records.withColumn("block", F.lit("own")).withColumn("warc_type", F.lit(3)).withColumn("extra", F.lit("kept"))
    rows = {r.warc_type: r for r in warc.derivatives(clashing).collect()}
    source = hashlib.sha1(body.encode()).digest()
    digest = "sha1:" + base64.b32encode(source).decode()
    fields = rows["metadata"].block.split("\r\n")
    assert fields[0] == "http-status: HTTP/1.1 200 OK" and fields[2] == f"source-payload-digest: {digest}" and fields[3] == f"source-length: {len(body)}"
    assert fields[4:8] == ["title: A & B", "language: uk", "outlink: http://h.example/x", "outlink: http://h.example/d/y#z"]
    assert rows["conversion"].block == "1 < 2y\nOne\nTwo" + " word" * 200_000
    for kind, r in rows.items():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        block = r.block.encode()
        assert rest == block + b"\r\n\r\n" and r.extra == "kept"
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and f"WARC-Type: {kind}" in lines and f"WARC-Refers-To: {r.refers_to}" in lines and f"Content-Length: {len(block)}" in lines
        assert "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() in lines and f"WARC-Payload-Digest: {digest}" in lines
    assert warc.derivatives(clashing.limit(0)).count() == 0


def test_records_of_other_types_and_broken_ones(spark):
    data = [(b"WARC/1.1\r\nWARC-Type: request\r\n\r\n",), (b"",), (None,), (b"\xff\xfe",)]
    assert warc.derivatives(spark.createDataFrame(data, "record binary")).count() == 0


def test_marks_of_the_page_and_parts_of_names_are_no_asides():
    for page in ("<body class='right-sidebar'><main><p>Text</main>", "<body class='sidebar has-header'><div><p>Text</div>", "<main class='with-sidebar'><p>Text</main>", "<article class='post comments-open'><p>Text</article>", "<div class='no-sidebar'><p>Text</div>", "<body class='no-sidebar'><article><p>Text</article>", "<div class='content ad-free'><p>Text</div>", "<div class='post-header'><h1>Text</h1></div>"):
        assert alone(f"<html>{page}<div class='related-posts'>More</div><div id='comments_2'>Reader</div><div class='ad'>Buy</div></html>") == "Text", page


def words(rng, n):
    return " ".join(rng.choice("ka lo mi ter un ves ra so".split()) + str(rng.randrange(999)) for _ in range(n))


def extracted(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    return {r.page_id: r.text for r in extract_pages(df).collect()}


def test_the_host_decides_what_an_article_holds(spark):
    """What all articles of a host share goes; alone, no page can tell."""
    rng = random.Random(5)
    rows, expected = [], {}
    for i in range(20):
        story = [words(rng, 4), words(rng, 40), words(rng, 30)]
        sources = "".join(f"<li><a href=/s{k}>{words(rng, 3)}</a>" for k in range(4)) if i % 4 == 0 else ""
        related = "".join(f"<li><a href=/r{k}>{words(rng, 3)}</a>" for k in range(5))
        body = f"<article><header><h1>{story[0]}</h1></header><p>{story[1]}<p>Get our letter by mail, it is free<p>{story[2]}" + (f"<ol>{sources}</ol>" if sources else "") + f"<ul>{related}</ul></article>"
        rows.append((i, f"http://h.example/{i}", f"<header>Site {words(rng, 1)}</header>" + body))
        links = re.findall(r"<li><a href=/s\d>([^<]*)", sources)
        expected[i] = "\n\n".join([*story, *links])
    got = extracted(spark, rows)
    assert got == expected
    assert "Get our letter by mail" in alone(rows[0][2]) and all(alone(html) != expected[i] for i, _, html in rows)


def test_a_page_within_a_form_keeps_its_text(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for i in range(6):
        story = [words(rng, 50), words(rng, 40)]
        rows.append((i, "http://f.example/", f"<body><form id=server><div class=menu>Menu</div><div class=c><p>{story[0]}<p>{story[1]}</div><form class=search>Find <input></form></form></body>"))
        expected[i] = "\n\n".join(story)
    rows.append((50, "http://alone.example/", "<form><p>" + "only text " * 20 + "</form>"))
    got = extracted(spark, rows)
    assert {i: got[i] for i in range(6)} == expected and got[50] == ("only text " * 20).strip()


def test_pages_of_one_article_keep_it(spark):
    """Copies of an article under other adverts are no template, however many a host has."""
    rng = random.Random(7)
    rows = [(i, "http://c.example/", f"<body><div class=ad>{words(rng, 5)}</div><article><h1>Title</h1><p>The same text on all pages of the host</article></body>") for i in range(30)]
    assert set(extracted(spark, rows).values()) == {"Title\n\nThe same text on all pages of the host"}


def test_sites_of_known_text(spark):
    """Sites made by rule, each with its own frame: what is extracted is what was put in, for every page."""
    rng = random.Random(9)
    rows, expected = [], {}
    for site in range(6):
        main, kind = [("article", ""), ("main", ""), ("div", " class=story"), ("div", " id=c"), ("section", ""), ("article", " class=post")][site]
        frame = [f"<div class=x{chr(97 + k)}>{words(rng, 6)}</div>" for k in range(rng.randint(1, 3))]
        foot = f"<div class=legal><p>{words(rng, 12)}</div><footer>{words(rng, 3)}</footer>"
        for i in range(12):
            story = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
            menu = "".join(f"<li><a href=/{k}>{words(rng, 2)}</a>" for k in range(rng.randint(2, 6)))
            advert = f"<div class=ad><p>{words(rng, 9)}</div>" if rng.random() < 0.5 else ""
            rows.append((len(rows), f"http://s{site}.example/{i}", f"<body>{''.join(frame)}<nav><ul>{menu}</ul></nav>{advert}<div class=wrap><{main}{kind}>{''.join(f'<p>{p}' for p in story)}</{main}><ul>{menu}</ul></div>{foot}</body>"))
            expected[rows[-1][0]] = "\n\n".join(story)
    got = [extracted(spark, rows, n) for n in (1, 4)]
    assert got[0] == got[1] == expected


def test_many_names_of_classes_leave_a_bounded_row(spark):
    rng = random.Random(10)
    rows = [(i, "http://n.example/", "<body>" + "".join(f"<div class=q{words(rng, 1)}><p>{words(rng, 1)}</p></div>" for _ in range(30)) + f"<article><p>{words(rng, 2000)}</article>") for i in range(60)]
    read = host_rules(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert read.count() == 1
    assert extracted(spark, rows) == {i: html.rpartition("<p>")[2].removesuffix("</article>") for i, _, html in rows}
