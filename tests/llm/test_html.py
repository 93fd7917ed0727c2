"""Wrappers: what they accept, and what they decide."""

import random
import re
from collections import Counter

from newslens.llm import html_text as H

PAGES = "page_id long, url string, html string, wrapper string, n long, host string, page string"


def extracted(spark, pages):
    d = spark.createDataFrame([(i, u, h, f"w{i}", 7, "mine", "own") for i, (u, h) in enumerate(pages)], PAGES)
    got = sorted(H.extract_text(d).collect(), key=lambda r: r["page_id"])
    assert all((r["url"], r["html"], r["wrapper"], r["n"], r["host"], r["page"]) == (*pages[i], f"w{i}", 7, "mine", "own") for i, r in enumerate(got))
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == len(pages)
    return [r["text"] for r in got]


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_menus_notices_and_headings_by_their_slots(spark):
    r = random.Random(2)
    pages, want = [], []
    for i in range(12):
        body = [words(r, 12) for _ in range(r.randint(1, 4))]
        notice = "<div><b>Read this</b> first</div>" if i % 3 == 0 else ""
        quote = f"<blockquote>{words(r, 5)}</blockquote>" if i == 7 else ""
        menu = "<ul><li>Home</li><li>About us</li><li>Contact</li></ul>"
        pages.append((f"http://x.org/{i}", f"<body><div>{menu}</div>{notice}<div>{''.join(f'<p>{b}</p>' for b in body)}{quote}</div><div>All rights</div></body>"))
        want.append("\n".join(body + re.findall("<blockquote>(.*?)<", quote)))
    got = extracted(spark, pages)
    assert got == want


def test_the_expression_decides(spark):
    """Without optional and repeated parts and groups the same pages give other texts."""
    r = random.Random(3)
    pages = [H.tree(f"<body>{'<div>Notice</div>' if i % 4 == 0 else ''}<p>{words(r, 9)}</p><ul><li>A</li><li>B</li></ul></body>") for i in range(12)]
    w = H.Wrapper()
    for p in pages:
        w.add_page(p)

    def texts(root, nodes):
        numbers, held = {id(n): k for k, n in enumerate(nodes)}, {}
        for p in pages:
            marks, longest, _ = H.evidence(p, root, numbers)
            for k, m in marks.items():
                held.setdefault(k, []).append((m, longest))
        shared = {k: len(v) for k, v in held.items() if len({m for m, _ in v}) == 1 and len({x for _, x in v}) >= H.SHARED_PAGES}
        return [H.page_text(p, root, H.constant_slots(root, nodes, len(pages), shared)) for p in pages]

    root, nodes = H.load(H.dump(w.root))
    right = texts(root, nodes)
    assert not any("Notice" in t or "A" in t for t in right)
    root, nodes = H.load(H.dump(w.root))
    for n in nodes:
        n.optional = n.repeated = False
    assert texts(root, nodes) != right


def test_copies_are_no_evidence(spark):
    page = "<body><div>one text</div><p>and another</p></body>"
    assert extracted(spark, [("http://c.org/a", page)] * 5) == ["one text\nand another"] * 5


def test_classes_of_paragraphs_and_articles(spark):
    html = '<article><p>Text</p><p class="ad-banner">Buy</p><p class="comment">Hm</p><p class="has-comments">More</p><article class="comment">No</article></article>'
    assert extracted(spark, [("http://c.org/a", html)]) == ["Text\nMore"]


def test_deep_pages(spark):
    deep = "<div>" * 3000 + "<nav>MENU</nav><article>in" + "<span>" * 3000 + " the deep" + "</span>" * 3000 + "</article><p>after" + "</div>" * 3000
    flat = "<body>" + "".join(f"<p>{i}</p><div>x{i}</div><h2>y</h2><pre>z</pre>" * 1 for i in range(3000)) + "</body>"
    got = extracted(spark, [("http://d.org/", deep), (None, flat), ("http://d.org/2", deep.replace("deep", "sea"))])
    assert got[0] == "in the deep" and got[2] == "in the sea" and got[1].count("\n") == 4 * 3000 - 1


def regex(node):
    """An expression as a regular expression over tags, for Python's own engine."""
    inner = "".join(regex(p) + ("?" if node.key == "*" else "") for p in node.parts)
    one = "#" if node.key == "#" else inner if node.key in ("()", "*") else f"<{re.escape(node.key)}>{inner}</>"
    return f"(?:{one})" + ("*" if node.repeated and node.optional or node.key == "*" else "+" if node.repeated else "?" if node.optional else "")


def tokens(element):
    return f"<{H.symbol(element)}>" + "".join("#" if isinstance(c, str) else tokens(c) for c in element[1]) + "</>"


def random_page(r, depth=0):
    out, kinds = "", ["h2", "p", "pre", "div", "i"][: r.randint(2, 5)]
    for _ in range(r.randint(1, 5)):
        k = r.choice(kinds)
        out += f"<{k}>{'t' if depth > 1 or r.random() < 0.5 or k in ('p', 'i') else random_page(r, depth + 1)}</{k}>"
    return out


def test_every_page_is_in_its_wrappers_language():
    r, found = random.Random(4), []
    for _ in range(60):
        pages = [H.tree(random_page(r)) for _ in range(r.randint(2, 7))]
        halves = []
        for part in (pages[::2], pages[1::2]):
            w = H.Wrapper()
            for p in part:
                w.add_page(p)
            halves.append(H.load(H.dump(w.root))[0])
        whole = H.Wrapper()
        for h in halves:
            whole.add(h)
        root, _ = H.load(H.dump(whole.root))
        for p in pages:
            assert re.fullmatch(regex(root), tokens(p)), (str(root), tokens(p))
            H.walk(p, root, lambda what, slot, role: found.append(slot))
    # where like elements stand at several places of an expression, an element is taken for the first of them
    assert all(s is None or s.key == "#" for s in found) and found.count(None) < 0.05 * len(found)


def test_the_alignment_is_longest():
    def brute(x, y):
        return max((n for n in range(min(len(x), len(y)) + 1) if subsequences(x, n) & subsequences(y, n)), default=0)

    def subsequences(x, n):
        if n == 0:
            return {()}
        return {(x[i], *rest) for i in range(len(x)) for rest in subsequences(x[i + 1 :], n - 1)}

    r = random.Random(5)
    for _ in range(80):
        x, y = (tuple(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(2))
        pairs = H._alignment(x, y)
        assert Counter(i for i, _ in pairs if i >= 0) == Counter(range(len(x))) and Counter(j for _, j in pairs if j >= 0) == Counter(range(len(y)))
        assert sum(i >= 0 and j >= 0 for i, j in pairs) == brute(x, y) and all(x[i] == y[j] for i, j in pairs if i >= 0 and j >= 0)
