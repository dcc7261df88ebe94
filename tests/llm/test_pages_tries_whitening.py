"""HTML extraction, conversation tries and whitening against brute force and by hand, with odd rows."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import html_text, lattice, prefix_trie, queries, whitening

LONG = "The cat that we had seen was on the roof of the house and it did not want to come down, so we went to look for a ladder in the shed and they were not there. " * 2


def plain_article(page):
    """The text of a page of the given tables, by its one article element."""
    found = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    body = found[1] if found[2] else re.sub(r"<[^>]*\Z", "", re.sub(r"<footer>.*", "", found[1], flags=re.S))
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in blocks if b)


def test_op11(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op11_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        want = plain_article(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("just words", "just words"),
        (f"<div><ul><li><a href='/'>Home</a><li><a href='/b'>News of the day</a></ul></div><h1>Title</h1><p>{LONG}<p>Short end.<div>© 2020 Name</div>", f"Title\n\n{LONG.strip()}\n\nShort end."),
        (f"<form id=all><header><h1>Site</h1></header><article><header><h1>Head</h1><span>by me</span></header><p>{LONG}</p><aside>Aside of it</aside><section class='comments'><p>{LONG}</p></section></article></form>", f"Head\n\n{LONG.strip()}"),
        (f"<main><h1>Head</h1><article><p>On.<p class=ad>Buy it<p>{LONG}</article><div class='sidebar'><p>{LONG}</p></div></main>", f"Head\n\nOn.\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><h2>12 Comments</h2><p>{LONG}</p></article>", LONG.strip()),
        (f"<article class='post has-comments'><p>{LONG}</p></article><article class=comment><p>{LONG}</p></article>", LONG.strip()),
        ("<article><p>a &lt;b&gt; &amp;amp; &#x41;&#128;&nbsp;&nbsp;c &am", "a <b> &amp; A€ c &am"),
        ("<article><p>x<script>if (a </b) '</p>'</script>y<SCRIPT>never ends <p>z", "xy"),
        ("<article><p title=\"a>b\">x<br>y</p><p data='open>z</p>", "x y\n\nz"),
        ("<article><p>x < y and y > z</p><!-- never", "x < y and y > z"),
        (f"<article><p>see <a href=x>the one</a> of us<p><a href=x>{LONG}</a></article>", "see the one of us"),
        (f"<div style='display: none'><p>{LONG}</p></div><div role=alert>{LONG}</div><p>{LONG}</p>", LONG.strip()),
        ("<article><ul><li>one<li>two<ul><li>three</ul></ul><table><tr><td>a<td>b</table></article>", "one\n\ntwo\n\nthree\n\na\n\nb"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_blocks_without_hints():
    """No container says anything: density, length and links decide, short blocks follow their neighbours."""
    menu = "".join(f"<div><a href='/{k}'>Section number {k}</a></div>" for k in range(5))
    page = f"<body>{menu}<div>Title of it</div><div>{LONG}</div><div>He said no.</div><div>{LONG}</div>{menu}<div>We use cookies, accept them.</div>"
    assert html_text.main_text(page).split("\n\n") == ["Title of it", LONG.strip(), "He said no.", LONG.strip()] or html_text.main_text(page).split("\n\n") == [LONG.strip(), "He said no.", LONG.strip()]


def test_extract_odd_tables(spark, table_of):
    rows = [(None, None, None, 1), (1, "u", f"<p>{LONG * 2000}</p>", 2), (1, "u", f"<p>{LONG * 2000}</p>", 2)]
    got = html_text.extract(table_of(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(LONG) * 2000 - 1), (1, len(LONG) * 2000 - 1)]
    assert html_text.extract(table_of(rows, "page_id long, url string, html string, text int").limit(0)).collect() == []


def slow_trie(rows):
    """Tuples of op12's columns, by walking every conversation."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    by = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in by.items()}
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c in sorted(by):
        h = zlib.crc32(str(c).encode()) % 6
        own = by.get(c - c % 100 if c >= 0 else c + (-c) % 100, [])[:h] + by[c][h:]
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
            if d:
                kids[tuple(own[: d - 1])].add(tuple(own[:d]))
        ends[tuple(own)].append(c)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    hexed = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hexed(p)) for p, m in members.items())


ODD_TURNS = [(c, t, r, x) for c in (0, 1, 2, 7, 100, 101, 150, 199, 300, -5, -100) for t, r, x in ((None, "user", "a"), (1, None, "b"), (1, "user", None), (2, "assistant", "ü😀"), (2, "assistant", "ü😀"), (5, "x", ""))]
ODD_TURNS += [(None, 1, "user", "lost"), (205, 1, "user", "alone"), (3, 1, "user", "one"), (400, 0, "user", "u"), (450, 0, "user", "v")] + [(500 + c, t, "user", f"{t % 3}") for c in (0, 1) for t in range(90)]


@pytest.mark.parametrize("heads", [0, 5])
def test_op12_odd_rows(table_of, spark, tmp_path, heads):
    rows = ODD_TURNS[heads:]
    table_of([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, node int, piece string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect()), key=lambda r: (r[0], r[1]))
    assert got == slow_trie(rows)


def test_op12_given_and_empty(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert sorted(tuple(r) for r in queries.op12_prefix_trie(spark, sf).collect()) == slow_trie(rows.select("conv_id", "turn", "role", "text").collect())
    rows.limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_prefix_trie(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("shape", ["chain", "hub", "random", "caterpillar"])
def test_subtree_sums(table_of, shape):
    dice = random.Random(shape)
    parent = {0: None}
    for k in range(1, 120):
        parent[k] = {"chain": k - 1, "hub": 0, "random": dice.randrange(k), "caterpillar": k - 1 if k % 2 else max(0, k - 3)}[shape]
    depth = {0: 0}
    for k in range(1, 120):
        depth[k] = depth[parent[k]] + 1
    value = {k: dice.randrange(1000) for k in parent}
    want = dict(value)
    for k in range(119, 0, -1):
        want[parent[k]] += want[k]
    name = lambda k: None if k is None else {"c": k, "d": depth[k]}
    tree = table_of([(name(k), name(p), value[k]) for k, p in parent.items()], "node struct<c:long,d:long>, parent struct<c:long,d:long>, value long")
    assert {r.node.c: r.value for r in prefix_trie.subtree_sums(tree, ["value"]).collect()} == want


def test_joined_digest_in_pieces(table_of):
    rows = [("a", k) for k in range(3000)] + [("b", -1), ("b", 5), ("b", 5)]
    got = {r.g: r.digest for r in prefix_trie.joined_digest(table_of(rows, "g string, v long"), "g", "v", size=50).collect()}
    assert got == {g: hashlib.sha256(",".join(str(v) for n, v in rows if n == g).encode()).hexdigest() for g in "ab"}


def whitened_by_hand(vectors):
    """n, deviations, |whitened|, explained of the integer vectors, in plain numpy and Python's integers."""
    x = np.array([np.floor(64 * np.array(v, float)) for v in vectors]).astype(np.int64) + 1_000_000
    own = np.unique(x, axis=0)
    n, s = len(own), own.sum(0)
    y = (n * own - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = ((n * x - s) / n) @ u[:, :16] / np.sqrt(np.maximum(e[:16], 0))
    return n, [sum(int(v) ** 2 for v in r) for r in n * x - s], np.abs(w), e[:16] / e.sum()


def test_op13(spark, sf, tmp_path):
    given = spark.read.parquet(f"{sf}/embeddings.parquet")
    good = [(r.vec_id, r.embedding) for r in given.collect()]
    dup = [(10_000_000 + k, good[0][1]) for k in range(50)]
    bad = [(20_000_000, None), (20_000_001, [None] * 64), (20_000_002, [float("nan")] + [0.0] * 63), (20_000_003, [float("inf")] * 64), (20_000_004, []), (20_000_005, [1.0]), (20_000_006, [1e30] * 64)]
    spark.createDataFrame([(k, v, 1, "x") for k, v in good + dup + bad], "vec_id long, embedding array<float>, label int, x string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = defaultdict(dict)
    for r in queries.op13_whitening(spark, str(tmp_path)).collect():
        got[r.vec_id][r.component] = r
    assert set(got) == {k for k, _ in good + dup}
    n, deviations, w, share = whitened_by_hand([v for _, v in good + dup])
    for k, (vec, _) in enumerate(good + dup):
        for c in range(16):
            r = got[vec][c + 1]
            assert (r.n, r.deviation) == (n, deviations[k])
            assert abs(r.whitened) == pytest.approx(w[k, c], abs=1e-7)
            assert r.explained == pytest.approx(share[c], rel=1e-9)
            assert r.identity_error < 1e-9


def test_whitening_without_variance(table_of):
    rows = [(k, [1.0, 2.0, float(k % 2)]) for k in range(6)]
    got = whitening.whiten(table_of(rows, "vec_id long, embedding array<double>"))
    assert {(r.component, r.n, r.whitened and abs(r.whitened), r.explained) for r in got.collect()} == {(1, 2, 1.0, 1.0), (2, 2, None, 0.0), (3, 2, None, 0.0)}
    one = whitening.whiten(table_of(rows[:1], "vec_id long, embedding array<double>")).collect()
    assert {(r.whitened, r.deviation, r.explained, r.identity_error) for r in one} == {(None, 0, 0.0, 0.0)}
    assert whitening.whiten(table_of(rows, "vec_id long, embedding array<double>").limit(0)).collect() == []


@pytest.mark.parametrize("most", [10, 1 << 35, 1 << 59, 1 << 70])
def test_exact_sums(most):
    dice = random.Random(most)
    rows = [[dice.randint(-most, most) for _ in range(3)] for _ in range(50)] + [[most, -most, 0]] * 20
    z = np.array(rows, object if most >= 1 << 62 else np.int64)
    assert whitening.square_sums(z, most) == [sum(r[k] ** 2 for r in rows) for k in range(3)]
    for v in (0, -1, most, -most, most**3, -(most**3)):
        assert whitening.number(whitening.digits(v)) == v


def test_polarised_products_are_exact(table_of):
    dice = random.Random(1)
    rows = [[dice.randint(-(1 << 40), 1 << 40) for _ in range(4)] for _ in range(30)]
    n, s = len(rows), [sum(c) for c in zip(*rows, strict=True)]
    most = max(abs(n * v - t) for r in rows for v, t in zip(r, s, strict=True))
    want = [[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in rows) for j in range(4)] for i in range(4)]
    assert whitening.polarised(table_of([(r,) for r in rows], "x array<long>"), n, s, most) == want


def test_lattice_meets_by_whole_keys():
    """Two equal vectors, other cells in table 0 whose keys agree in the low half, one cell in table 1: they meet in table 1."""
    unit = np.array([[1.0, 0.0], [1.0, 0.0]])
    own = lambda a, b: np.array([[[5 + (a << 32)], [77 << 40]], [[5 + (b << 32)], [77 << 40]]], np.int64)
    both = np.arange(2)
    met = lambda key, table: [len(x) for x in lattice.pairs(unit, key[:, : table + 1], 0.98, int(key[0, table, 0]), table, both, both)]
    assert met(own(1, 2), 1) == [1, 1]
    assert met(own(1, 1), 1) == [0, 0] and met(own(1, 1), 0) == [1, 1]
