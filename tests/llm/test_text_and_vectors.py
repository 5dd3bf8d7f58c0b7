"""Fill-in-middle, whitening and minimum-cut extraction on small tables and by brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from pricetide.llm import fill_in_middle, minimum_cut, whitening

DOCS = "doc_id long, text string, form string, n long, output string, `a.b` string, h1 long, __row_key string"
VECTORS = "vec_id long, embedding array<float>, component int, `a.b` string, x string, salt int, count long, weight long"
PAGES = "page_id long, url string, html string, text string, `a.b` string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "f", 0, "o", "p", 1, "k") for i, t in rows], DOCS)


# --- fill-in-middle


def parts_of(i, text, unit=r"[A-Za-z]+|[^A-Za-z]"):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(unit, text, re.S)
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return len(units), "plain", None, None, text
    if d % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    draw = random.Random(4)
    signs = ["a", "Bc", " ", "é", "漢", "😀", "\n", "<", ">", "<S", "P>", "1", "\x85", "ß", "\U0010ffff"]
    rows = [(i, "".join(draw.choice(signs) for _ in range(draw.randrange(30)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "a <P> b"), (None, "null id, with text é"), (503, "word é " * 40_000), (503, "word é " * 40_000), (504, "x" * 300_000), (505, "é" * 100_000)]
    return rows


@pytest.mark.parametrize("unit", ["token", "character"])
def test_parts_equal_plain_python(spark, unit):
    rows = odd_texts()
    pattern = r"[A-Za-z]+|[^A-Za-z]" if unit == "token" else r"."
    got = sorted(tuple(r) for r in fill_in_middle.report(docs_of(spark, rows), unit=unit).select(*"doc_id n form prefix_chars middle_chars output_sha256 restored_sha256".split()).na.fill(-1).collect())
    want = []
    for i, text in rows:
        n, form, p, m, out = parts_of(i, text, pattern)
        want.append((-1 if i is None else i, n, form, -1 if p is None else p, -1 if m is None else m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_other_markers_and_empty_table(spark):
    settings = fill_in_middle.Settings("[pre]", "[suf]", "[mid]", 100, 50, "seed")
    rows = docs_of(spark, [(i, f"some tëxt [pre number {i}] [suf") for i in range(50)])
    made = fill_in_middle.transform(rows, settings).withColumn("back", fill_in_middle.restored(fill_in_middle.F.col("output"), fill_in_middle.F.col("form"), settings)).collect()
    assert {r["back"] for r in made} == {f"some tëxt [pre number {i}] [suf" for i in range(50)} and {r["form"] for r in made} == {"psm", "spm"}
    assert fill_in_middle.report(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.Settings("<P>", "<P>", "<M>")


def test_index_of_multibyte_characters():
    draw = random.Random(5)
    for _ in range(200):
        text = "".join(draw.choice("ab é漢😀") for _ in range(draw.randrange(60)))
        index = fill_in_middle.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
        bytes_at = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
        assert (index.to_bytes(np.arange(len(text) + 1)) == bytes_at).all() and (index.to_characters(bytes_at) == np.arange(len(text) + 1)).all()


# --- whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "p", "x", 0, 1, 1) for i, v in rows], VECTORS)


def check_whitened(got, rows, components, weights="count"):
    """Against plain numpy: every kept row once per component, exact deviations, coordinates up to one sign a component."""
    x = np.floor(1024 * np.array([np.array(v, np.float32) for _, v in rows], np.float64)).astype(np.int64) + 100_000
    fit = x if weights == "count" else np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    covariance = (fit - sums / n).T @ (fit - sums / n) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    want = (x - sums / n) @ vectors / np.sqrt(values)
    by_row: dict = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / covariance.trace()) <= 1e-9 and r["identity_error"] < 1e-9
    assert len(got) == components * len(rows)
    signs = None
    for k, (i, _) in enumerate(rows):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums, strict=True))
        found = np.array([by_row[i, deviation][c][0] for c in range(1, components + 1)])
        if signs is None and np.abs(want[k]).min() > 1e-6:
            signs = np.sign(found * want[k])
        if signs is not None:
            assert np.abs(found - want[k] * signs).max() < 1e-8


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_equals_numpy(spark, weights):
    draw = np.random.default_rng(3)
    scales = np.arange(1, 13) / 8
    rows = [(i, (draw.normal(size=12) * scales).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # one vector with a large share
    rows += [(5, rows[5][1]), (None, rows[7][1])]
    odd = [(2000, None), (2001, []), (2002, [None] * 12), (2003, [float("nan")] + [0.0] * 11), (2004, [float("inf")] * 12), (2005, [1.0] * 5)]
    check_whitened(whitening.whiten(vectors_of(spark, rows + odd), weights=weights).collect(), rows, 8, weights)


def test_whitening_of_few_or_flat_vectors(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == whitening.whiten(vectors_of(spark, [(1, None)])).count() == 0
    got = whitening.whiten(vectors_of(spark, [(i, [0.5, 2.0, float(i % 3)]) for i in range(9)])).collect()
    assert len(got) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    assert abs(sum(r["whitened"] ** 2 for r in got if r["component"] == 1) / 9 - 1) < 1e-9
    one = whitening.whiten(vectors_of(spark, [(1, [3.0, 4.0])] * 3)).collect()
    assert len(one) == 6 and {r["whitened"] for r in one} == {None} and {r["deviation"] for r in one} == {0} and {r["identity_error"] for r in one} == {0.0}
    large = whitening.whiten(vectors_of(spark, [(i, [1e30 * (i % 2), -1e9 + i * 64, float(i)]) for i in range(40)])).collect()
    x = np.array([[100_000 + min(int(np.floor(1024 * float(np.float32(c)))), 2**52) for c in (1e30 * (i % 2), -1e9 + i * 64, float(i))] for i in range(40)], dtype=object)
    want = {i: str(sum((40 * int(a) - int(s)) ** 2 for a, s in zip(x[i], x.sum(axis=0), strict=True))) for i in range(40)}
    assert {r["vec_id"]: r["deviation_exact"] for r in large} == want and {r["deviation"] for r in large} == {None}


def test_packed_vectors_come_back():
    draw = np.random.default_rng(1)
    x = draw.integers(-(2**52), 2**52, (60, 5))
    x[::3] = draw.integers(70_000, 130_000, (20, 5))
    x[1::3] = draw.integers(-(2**30), 2**30, (20, 5))
    packed = whitening.pack(x, 100_000)
    assert (whitening.unpack(packed, 100_000, 5) == x).all() and len(set(map(len, packed))) == 3


# --- minimum cut


def test_cut_is_least_and_keeps_most():
    draw = random.Random(1)
    for _ in range(1500):
        n = draw.randrange(1, 9)
        terminal = [draw.randrange(-6, 7) for _ in range(n)]
        edges = [(draw.randrange(n), draw.randrange(n), draw.randrange(5)) for _ in range(draw.randrange(12))]
        cost = lambda label: sum(abs(t) for t, k in zip(terminal, label) if (t > 0) != bool(k)) + sum(c for i, j, c in edges if label[i] != label[j])  # noqa: B023, E731
        every = [(cost(label), -sum(label)) for label in itertools.product((0, 1), repeat=n)]
        got = minimum_cut.minimum_cut(terminal, edges)
        assert (cost(got), -sum(got)) == min(every)


P = "The report says, again, that several things happened on Monday in the old town."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1><a href="/">Home</a></header>
<nav><ul><li><a href="/a">A</a></li><li>B</li></ul></nav><!-- ad --><div class="layout sidebar-left"><main><article><header><h1>Title &amp; more</h1></header><p><b>{P}<br><p>Short.</p><div class="ad-slot">Buy this great thing now, only today.</div>
<p>x &lt;y&gt;
 z&nbsp;w</p><ul><li>first point</li></ul><aside>Related, dear reader.</aside></article></main><div class="sidebar"><p>{P}</p></div></div>
<section id="comments"><article><p>{P} I agree.</p></article></section><div class="cookie-notice"><p>{P}</p></div><form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024</footer></body></html>"""


def test_pages(spark):
    want = f"Title & more\n{P}\nShort.\nx <y> z w\nfirst point"
    cases = {
        PAGE: want, "Hello world": "Hello world", "": "", f"<p>{P}<p>{P}": f"{P}\n{P}", f"<article><p>{P}</p><p cla": P, f"<article><p>{P}<!-- open": P, f"<article><p>{P}</p><script>x": P,
        f'<div id="nav"><a>One</a> | <a>Two</a></div><div id="content"><h1>Title</h1><p>{P}</p><p>Short.</p></div><div class="related-posts"><p>{P}</p></div>': f"Title\n{P}\nShort.",
        f'<form id="all"><div class="menu"><a>x</a></div><div class="content"><h1>Title</h1><p>{P} <button>Buy</button></p></div></form>': f"Title\n{P}", f"<article><div hidden>no</div><h2>{P}</h2><pre>a\n  b</pre></article>": f"{P}\na b"}
    rows = [(i, f"u{i}", html, "t", "p", 0) for i, html in enumerate(cases)] + [(900, None, None, "t", "p", 0), (None, "u0", PAGE, "t", "p", 0), (0, "u0", PAGE, "t", "p", 0)]
    got = minimum_cut.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r["page_id"] or -1, r["url"] or "", r["text"]) for r in got) == sorted((r[0] or -1, r[1] or "", cases[r[2] or ""]) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) and r["n_kept"] <= r["n_blocks"] for r in got)
    assert minimum_cut.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_smoothness_decides_what_costs_leave_open():
    blocks = lambda html: minimum_cut.label_page(html, minimum_cut.COSTS | {"base": -30})
    assert [keep for _, keep in blocks(f"<div><p>{P}</p><p>Ab</p><p>{P}</p></div>")] == [True, True, True]  # between two that are content
    assert [keep for _, keep in blocks("<div><p>Ab</p></div>")] == [False]


def test_long_and_deep_pages_stay_linear():
    assert minimum_cut.main_text("<article>" + "<div>" * 50_000 + P + "</div>" * 50_000 + f"<p>{P}</p></article>") == f"{P}\n{P}"
    text = minimum_cut.main_text("<article>" + f"<p>{P}</p><p>Ab</p>" * 20_000)
    assert text.count("\n") == 39_999


def test_tables_of_the_repository(spark, folder):
    """Whole pages of the given table: everything inside the article element and nothing else."""
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in minimum_cut.op12_minimum_cut(spark, folder).collect()}
    import html

    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1].replace("<br>", " ")
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)
