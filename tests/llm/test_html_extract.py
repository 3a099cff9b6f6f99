import random
import re

from taxolyte.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header class="site"><a href=/>Logo</a></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="ad">Buy {n}</div>{extra}
<article><h1>Title &amp; {n}</h1><p><b>Lead   text {n}<br>next&nbsp;line<p>Body &lt;x&gt; {n}</p><ul><li>one {n}<li>two</ul>{inner}</article>
<aside>Side {n}</aside><form><label>Mail</label><input></form><section class="comments"><article class="comment"><p>Comment {n}</p></article></section><footer>&copy; host</footer>"""


def want(n, inner=""):
    return "\n".join(x for x in (f"Title & {n}", f"Lead text {n} next line", f"Body <x> {n}", f"one {n}", "two", inner) if x)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(spark, rows):
    return {r["page_id"]: r for r in hx.main_text(spark, pages(spark, rows)).collect()}


def test_article(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(n=i, extra="<div class='cookie-notice'>C</div>" * (i % 3 == 0), inner="<blockquote>Quote</blockquote>" * (i % 4 == 1))) for i in range(12)]
    got = texts(spark, rows)
    assert {i: r["text"] for i, r in got.items()} == {i: want(i, "Quote" * (i % 4 == 1)) for i in range(12)}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_wrapper_has_optional_and_repeated_groups(spark):
    rows = [(i, "https://h.example/", f"<body><ul>{'<li>x' * (i + 1)}</ul>{'<p>t</p>' * (i % 2)}<dl>{'<dt>a<dd>b' * i}</dl></body>") for i in range(4)]
    w = hx.infer_wrappers(pages(spark, rows)).first()
    assert w["wrapper"] == "<body><ul>(<li>#PCDATA</>)+</> (<p>#PCDATA</>)? (<dl>(<dt>#PCDATA</> <dd>#PCDATA</>)+</>)?</>"
    assert w["pages"] == 4


def test_pages_without_article(spark):
    page = "<body><div class='menu'><a href=x>Home</a></div><div><p>Always the same</p><p class=v>Text {}</p></div><p><a href=y>only a link here</a></p></body>"
    rows = [(i, "http://h/", page.format(f"number {i} of many")) for i in range(4)]
    assert {i: r["text"] for i, r in texts(spark, rows).items()} == {i: f"Text number {i} of many" for i in range(4)}


def test_copies_are_not_constant_text(spark):
    rows = [(i, "http://h/", "<body><p>Same text</p></body>") for i in range(5)]
    assert {r["text"] for r in texts(spark, rows).values()} == {"Same text"}


def test_broken_and_odd_pages(spark):
    rows = [
        (1, "http://h/1", None),
        (2, None, ""),
        (3, "no url", "<article><p>a &am b &amp c < d <p>e</i></div></article"),
        (4, "http://h/4", "<article><script>x < y</article><p>never closed"),
        (5, "http://h/5", "<div>" * 3000 + "deep" + "</div>" * 10),
        (5, "http://h/5", "<!-- <article>no</article> --><main><p>yes</p></main>"),
        (None, "http://h/6", "<article><p>" + "long " * 50000 + "</p></article>"),
    ]
    out = [(r["page_id"], r["text"]) for r in hx.main_text(spark, pages(spark, rows)).collect()]
    assert sorted(str(k) for k, _ in out) == sorted(str(r[0]) for r in rows)
    got = {k: t for k, t in out if k not in (5, None)}
    assert got[1] == got[2] == "" and got[3] == "a &am b & c < d\ne"
    assert {t for k, t in out if k == 5} == {"deep", "yes"}
    assert next(t for k, t in out if k is None) == ("long " * 50000).strip()


def test_many_partials(spark, monkeypatch):
    monkeypatch.setattr(hx, "HELD_HOSTS", 2)
    rows = [(i, f"http://h{i % 5}/", PAGE.format(n=i, extra="", inner="")) for i in range(40)]
    got = hx.main_text(spark, pages(spark, rows).repartition(7)).collect()
    assert all(r["text"] == want(r["page_id"]) for r in got) and len(got) == 40


def test_empty(spark):
    assert hx.main_text(spark, pages(spark, [])).count() == 0


def one(text):
    return hx.Rules(hx.decide(hx.build(text), False)).extract(text)


def test_odd_quotes_leak_no_markup():
    assert one('<body><p title="5" inch">Hello</p>') == "Hello"
    assert one('<p>a</p><a href="x>y') == "a\ny" or one('<p>a</p><a href="x>y') == "a"
    assert one("<p title='it's' x=\"a>b\" y>He said \"no\"</p>") == 'He said "no"'
    assert one("<p a=1 b='x>y'>z</p ><p =\"q>\">w</p>") == "z\nw"


#: Pages whose names say nothing: the site's own text is known by its staying the same, and the article by its place.
PLAIN = "<html><body><div><div>Site name</div><div>Today's {n} offers</div></div><div>{title}</div><div>{body}</div>{extra}<div>All rights kept</div></body></html>"


def plain_pages(n):
    rows, want = [], {}
    for i in range(n):
        body = [f"Paragraph {j} of text {i} says something of its own at some length." for j in range(1 + i % 5)]
        page = PLAIN.format(n=i, title=f"Title {i}", body="".join(f"<div>{b}</div>" for b in body), extra="<div>Rate this</div>" * (i % 3 == 0))
        rows.append((i, "http://plain.example/x", page))
        want[i] = "\n".join(body)
    return rows, want


def test_wrapper_decides_where_names_say_nothing(spark):
    rows, want = plain_pages(15)
    assert {i: r["text"] for i, r in texts(spark, rows).items()} == want


def test_alignment_matters(spark, monkeypatch):
    rows, want = plain_pages(9)
    wrapper = None
    for _, _, page in rows:
        wrapper = hx.build(page) if wrapper is None else hx.merge(wrapper, hx.build(page))
    rules = hx.Rules(hx.decide(wrapper, True))
    assert [rules.extract(p) for _, _, p in rows] == [want[i] for i, _, _ in rows]
    monkeypatch.setattr(hx, "align", lambda a, b: [*a, *b])
    wrapper = None
    for _, _, page in rows:
        wrapper = hx.build(page) if wrapper is None else hx.merge(wrapper, hx.build(page))
    rules = hx.Rules(hx.decide(wrapper, True))
    assert [rules.extract(p) for _, _, p in rows] != [want[i] for i, _, _ in rows]


def random_list(rng, names, depth):
    out = []
    for _ in range(rng.randrange(5)):
        name = rng.choice(names)
        out += [(name, random_list(rng, names, depth - 1) if depth else [])] * rng.choice([1, 1, 3])
    return out


def page_of(nodes, counter):
    out = ""
    for name, inner in nodes:
        counter[0] += 1
        out += f"<{name}>t{counter[0]} {page_of(inner, counter)}</{name}>"
    return out


def accepts(pattern, names):
    """By brute force: whether a list of children fits the wrapper's list."""
    spelled = "".join(f"{n};" for n in names)
    piece = lambda n: "(?:" + ("".join(map(piece, n[3])) if n[0] == "()" else f"{n[0]};") + ")" + ("*" if n[1] and n[2] else "?" if n[1] else "+" if n[2] else "")
    return re.fullmatch("".join(map(piece, pattern)), spelled) is not None


def test_wrappers_accept_their_pages_by_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        pages_ = [page_of(random_list(rng, ["div", "p.a", "section", "ul"], 1), [0]) for _ in range(4)]
        built = [hx.build(p) for p in pages_]
        names = [[c[0] for c in b[3]] for b in built]
        wrapper = built[0]
        for b in built[1:]:
            wrapper = hx.merge(wrapper, b)
        assert all(accepts(wrapper[3], n) for n in names), (names, hx.render(wrapper))
        rules = hx.decide(wrapper, True)
        for n in names:
            found = hx._matched(rules[2], [[x, False, False, []] for x in n])
            assert [f and f[0] for f in found] == n, (n, hx.render(wrapper))


def test_long_lists_of_unlike_elements():
    rng = random.Random(6)
    make = lambda: "".join(f"<{rng.choice('abcdefgh')}x>t</div>" for _ in range(3000))
    wrapper = hx.merge(hx.build(make()), hx.build(make()))
    assert hx.Rules(hx.decide(wrapper, True)).extract(make()) is not None


def test_odd_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(n=i, extra="", inner="")) for i in range(6)]
    more = pages(spark, rows).withColumns({c: F.lit(1) for c in ("host", "rules", "salt", "text", "wrapper", "n_chars")})
    got = {r["page_id"]: r["text"] for r in hx.main_text(spark, more).collect()}
    assert got == {i: want(i) for i in range(6)}


def test_many_wrappers_are_joined_with_salt(spark, monkeypatch):
    rows, want_ = plain_pages(12)
    monkeypatch.setattr(hx, "FEW_HOSTS", 0)
    assert {i: r["text"] for i, r in texts(spark, rows).items()} == want_
