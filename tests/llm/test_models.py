"""Parts that need no session, against brute force."""

import random

import numpy as np
import pytest

from newslens.llm import boosting, bpe, html_text, jaccard, mixing, pii, token_counts, topk


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(bpe.default_path())


def test_bpe_equals_the_library(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    r = random.Random(1)
    texts = ["", "<|endoftext|>a <|endoftext|>", "  \n\n  x", "it's we'll I'd 'S", " 　 x\x85y", "a" * 3000, "ab" * 2000 + "é" * 99, "한국어 😀😀", "\x1c\x1d x", " a", "x ", "\n \n"]
    texts += ["".join(r.choice(" aeinrsth\n'-=01é😀한 ") for _ in range(r.randint(0, 120))) for _ in range(400)]
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        ids = vocabulary.encode(x)
        assert list(memoryview(ids).cast("I")) == want
        assert vocabulary.decode(ids) == t.decode(want, skip_special_tokens=False) == x


def test_longest_match_equals_greedy():
    def greedy(w, starts, parts):
        i, n, known = 0, 0, starts
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in known), None)
            if j is None:
                return -1
            i, n, known = j, n + 1, parts
        return n

    r = random.Random(2)
    some = lambda k: {bytes(r.choice(b"abc") for _ in range(r.randint(1, 4))) for _ in range(k)}
    for _ in range(500):
        starts, parts = some(r.randint(1, 6)), some(r.randint(1, 6))
        m = token_counts.LongestMatch(starts, parts)
        w = bytes(r.choice(b"abc") for _ in range(r.randint(1, 12)))
        assert m.count(w) == greedy(w, starts, parts)


def test_subsets_meet_exactly_the_linked_small_sets():
    for n in range(1, 13):
        for m in range(n, 16):
            need = next(o for o in range(m + 1) if 100 * o >= 80 * (n + m - o))
            assert jaccard.overlap(n, m) == need
            if m <= 12 and 5 * n >= 4 * m and not (n == m == need):
                assert need in jaccard.subset_sizes(n, 12) and need in jaccard.subset_sizes(m, 12)
            assert jaccard.prefix_size(m) >= m - need + 1 or 5 * n < 4 * m


def test_sketch_never_overstates():
    r = np.random.default_rng(3)
    for _ in range(100):
        s, t = (np.unique(r.integers(0, 400, 120).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = jaccard.parity_sketch(s, jaccard.SKETCH), jaccard.parity_sketch(t, jaccard.SKETCH)
        bits = sum(bin(int(a) & (2**64 - 1)).count("1") for a in (x ^ y))
        assert bits <= len(np.setxor1d(s, t))


def test_gaps_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2**32, 5000).astype(np.uint32))
    assert (jaccard._ungap(jaccard._gaps(x)) == x).all() and len(jaccard._ungap(jaccard._gaps(x[:0]))) == 0


def test_targets_share_the_whole():
    assert mixing.targets([100, 100, 100]) == [50, 100, 150]
    assert mixing.targets([10, 1000, 1000]) == [30, (2010 - 30) * 2 / 5, (2010 - 30) * 3 / 5]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    t = mixing.targets([5, 0, 7, 100, 3])
    assert sum(t) == pytest.approx(115) and all(x <= 3 * s + 1e-9 for x, s in zip(t, [5, 0, 7, 100, 3], strict=True))


def test_pivot_search_equals_brute_force():
    r = np.random.default_rng(5)
    x = np.floor(r.normal(size=(400, 12)) * 1024)
    x[10] = x[11] = x[12]
    ids = np.arange(400) * 3
    square = float((x * x).sum(axis=1).max())
    lifted = topk._lifted(x, square)
    pivots = topk.choose_pivots(lifted, 8)
    rows = topk._table(lifted, pivots)
    for j in (0, 10, 399):
        got, _ = topk.search_shard(np.arange(len(ids)), ids, x, rows, square, j, x[j], rows[j], 10, False)
        scores = (x @ x[j]).astype(int)
        want = sorted([(-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != ids[j]])[:10]
        assert got == [(-s, i) for s, i in want]
    big = np.array([[2.0**40, 1.0], [2.0**40, -1.0]])
    assert topk._products(big, big[0], True)[0] == 2**80 + 1


def _text(pages, i):
    w = html_text.Wrapper()
    for p in pages:
        w.add_page(html_text.tree(p))
    root, nodes = html_text.load(html_text.dump(w.root))
    numbers, held = {id(n): k for k, n in enumerate(nodes)}, {}
    for p in pages:
        marks, longest, _ = html_text.evidence(html_text.tree(p), root, numbers)
        for k, m in marks.items():
            held.setdefault(k, []).append((m, longest))
    shared = {k: len(v) for k, v in held.items() if len({m for m, _ in v}) == 1 and len({x for _, x in v}) >= html_text.SHARED_PAGES}
    return html_text.page_text(html_text.tree(pages[i]), root, html_text.constant_slots(root, nodes, len(pages), shared))


def test_wrappers():
    soup = ['<html><body><div>Site</div><div class="menu"><a>Home</a></div><div class="content"><p>Story %d about <i>things</i><br>and &amp; &eacute;</p><p>Same<p>Para %d</div>'
            '<div class="comments"><p>nice</p></div><div>Copyright</div><form><p>Search</p></form></body>' % (i, i) for i in range(4)]
    assert _text(soup, 1) == "Story 1 about things and & é\nSame\nPara 1"
    page = '<nav>x</nav><!-- <p>no --><article><h1>T</h1><p><b>A  b<br><p>c&nbsp;d<aside>no</aside><script>"</p>"</script><section id="comments">no</section></article><footer>f</footer>'
    assert _text([page], 0) == "T\nA b\nc d"
    for odd in ("", "<", "<p", "<!-- x", "<script>x", "</p>", "<" * 3000, "<div>" * 3000 + "x", "<p a='b>c"):
        assert isinstance(_text([odd], 0), str)
    a = html_text.Wrapper()
    for p in ("<ul><li>a<li>b</ul>", "<ul><li>a</ul><p>x"):
        a.add_page(html_text.tree(p))
    assert str(a.root) == "<><ul>(<li>#)+ (<p>#)?"


def test_text_of_one_page_or_of_copies_is_no_furniture():
    pages = [f"<div>Site</div><p>Story {i}</p><div>End</div>" for i in range(4)]
    quoted = "<div>Site</div><p>Story 9</p><blockquote>Only here</blockquote><div>End</div>"
    assert _text([*pages, quoted], 4) == "Story 9\nOnly here"
    assert _text([pages[0]] * 5, 0) == "Site\nStory 0\nEnd"  # nothing tells the story from the frame
    assert _text([pages[0]] * 3 + [pages[1]] * 3, 0) == "Site\nStory 0\nEnd"
    long = "<p>" + "A long story. " * 30 + "</p>"
    assert "long story" in _text([f"{long}<div>{i} views</div>" for i in range(4)], 0)


def test_deep_elements_end_where_they_end():
    deep = "<div>" * 200 + "in<nav>menu<div>more</div></nav><p>deep</p>" + "</div>" * 200
    assert _text([f"<div><article>before{deep}after</article></div><div>no</div>"], 0) == "before\nin\ndeep\nafter"
    assert _text(["<article><p>" + "<b>" * 200 + "x</p><p>y</article>no"], 0) == "x\ny"
    assert _text(["no" + "<div>" * 200 + "<article>yes<aside>no</aside></article>" + "</div>" * 200 + "no"], 0) == "yes"
    assert _text(["<div>" * 130 + "<nav>a<nav>b</nav>c</nav>d" + "</div>" * 130 + "e"], 0) == "d\ne"


def test_constants_and_classes_inside_articles():
    pages = [f'<article class="post has-comments"><h1 class="header">T{i}</h1><p>Story {i} <b>bold</b></p><div class="box-7"><p>Get the paper</p></div></article>'
             '<article class="comment"><p>reader</p></article>' for i in range(4)]
    assert _text(pages, 1) == "T1\nStory 1 bold"
    assert _text(pages[:2], 1) == "T1\nStory 1 bold\nGet the paper"  # two pages don't tell
    assert _text([f'<body class="nav-open"><main><p>a{i}</p><p class="advert">b</p><p id="comment-12">c</p></main>' for i in range(4)], 0) == "a0"


def test_trees_and_calibration():
    trees, threshold = pii.model()
    r = random.Random(99)
    rows = [pii._example(r) for _ in range(400)]
    x, y = np.array([pii._features(*q[:4]) for q in rows]), np.array([q[4] for q in rows])
    chosen = boosting.scores(trees, x) >= threshold
    assert y[chosen].mean() > 0.95 and chosen[y == 1].mean() > 0.5
    assert boosting.calibrate(np.array([1.0, 0.0]), np.array([0, 0]), 0.9) == float("inf")
