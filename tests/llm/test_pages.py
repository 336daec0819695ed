"""Wrapper induction: alignment against brute force, and generated hosts whose templates carry no telling names."""

import random
import time

from tidemark.llm import pages


def tree(rng, depth=0):
    out = [(depth, rng.choice("abc"))]
    if depth < 4:
        for _ in range(rng.randrange(0, 4)):
            out += tree(rng, depth + 1)
    return out


def nested(t):
    path, root = [], None
    for depth, sig in t:
        node = (sig, [])
        del path[depth:]
        if path:
            path[-1][1].append(node)
        path.append(node)
        root = root or node
    return root


def match(a, b):
    """Simple tree matching as published: a table over the children of two equal nodes."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            w = match(x, y)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
    return 1 + best[-1][-1]


def test_alignment_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = tree(rng), tree(rng)
        a[0] = b[0] = (0, "root")
        weight = match(nested(a), nested(b))
        assert pages.tree_match(a, b) == weight
        keys = pages.align(a, b)
        partners = [(i, k) for i, k in enumerate(keys) if k >= 0]
        assert len(partners) == weight == len({k for _, k in partners})
        assert all(a[i] == b[k] for i, k in partners)
        assert [k for _, k in partners] == sorted(k for _, k in partners)  # page order holds


def test_very_long_and_very_deep_pages():
    began = time.time()
    deep = "<div>" * 30000 + "<p>deep text" + "</div>" * 10 + "</p>" * 30000
    a = pages.tree_of(pages.parse(deep)[0])
    assert sum(k >= 0 for k in pages.align(a, a[:-1])) == len(a) - 1
    assert pages.unpack(pages.pack(a)) == a
    long = "<div>" + "".join(f"<h3>t{i}</h3><p>x{i}</p>" for i in range(6000)) + "</div>"
    a, b = pages.tree_of(pages.parse(long)[0]), pages.tree_of(pages.parse(long.replace("<h3>t7</h3>", "").replace("<p>x3000</p>", ""))[0])
    assert sum(k >= 0 for k in pages.align(b, a)) == len(b)
    assert time.time() - began < 60


def site(rng, host, n):
    """(url, html, own text) of a host's pages: nested divs only, no roles, no article, nothing but its own text to tell."""
    words = lambda k: " ".join(rng.choice("lorem ipsum dolor sit amet magna aliqua erat sed diam vero eos".split()) + str(rng.randrange(10000)) for _ in range(k))
    top, tagline, legal, box = words(6), words(12), words(25), [words(14) for _ in range(3)]
    extra = words(9)
    for i in range(n):
        title, paragraphs = words(5), [words(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 7))]
        body = f"<div><h2>{title}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>"
        promo = f"<div><div>{extra}</div></div>" if rng.random() < 0.4 else ""
        html = f"<html><body><div><div>{top}</div><div><b>{tagline}</b></div></div>{promo}<div>{body}<div><span>{rng.choice(box)}</span></div></div><div><p>{legal}</p></div></body></html>"
        yield f"https://{host}/{i}", html, [title, *paragraphs]


def scores(got, wanted):
    right = sum(len(set(g) & set(w)) for g, w in zip(got, wanted))
    return right / max(1, sum(map(len, got))), right / sum(map(len, wanted))


def test_templates_without_telling_names(spark, monkeypatch):
    rng = random.Random(4)
    rows = [r for h in range(8) for r in site(rng, f"h{h}.example", rng.randrange(12, 60))] + list(site(rng, "hot.example", 300))
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    wanted = [w for _, _, w in rows]
    take = lambda d: [r["text"].split("\n\n") for r in sorted(pages.main_text(d).collect(), key=lambda r: r["page_id"])]
    got = take(df.repartition(7))
    precision, recall = scores(got, wanted)
    assert precision > 0.99 and recall > 0.99, (precision, recall)
    assert take(df.orderBy("url").coalesce(1)) == got  # neither order nor grouping matters
    monkeypatch.setattr(pages, "PAGES", 10**9)  # without wrappers
    bare = take(df)
    assert bare != got and scores(bare, wanted)[0] < 0.6 and scores(bare, wanted)[1] == 1


def test_hosts_too_large_to_broadcast(spark, monkeypatch):
    from tidemark.llm import common

    rng = random.Random(6)
    rows = [r for h in range(3) for r in site(rng, f"h{h}.example", 30)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    take = lambda: sorted(tuple(r) for r in pages.main_text(df).collect())
    want = take()
    monkeypatch.setattr(pages, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "SPREAD", 4)
    assert take() == want


def test_small_hosts_and_repeats(spark):
    one = "<body><div>site name</div><article><p>the text</p></article><div>more</div></body>"
    same = "<body><div>top</div><p>a page that was stored many times</p></body>"
    rows = [(1, "http://small.example/a", one), (2, "http://small.example/b", one.replace("the text", "other text"))] + [(10 + i, "http://again.example/", same) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("page_id", "_host")
    got = {r["_host"]: r["text"] for r in pages.main_text(df).collect()}
    assert got[1] == "the text" and got[2] == "other text"
    assert {got[10 + i] for i in range(20)} == {"top\n\na page that was stored many times"}  # one page, nothing to compare
