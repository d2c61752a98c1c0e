"""Page extraction, vector search and the pipeline on small fixtures."""

import random
import re
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from ledgerloom.llm import hilbert_search, html_article  # noqa: E402
from ledgerloom.llm.boosted_trees import fit_trees  # noqa: E402


def page(rng, body_class=None):
    text = lambda n: " ".join("".join(rng.choices("abcdeilnorst", k=rng.randint(2, 8))) for _ in range(n)) + "."
    title, paragraphs = text(5), [text(rng.randint(8, 60)) for _ in range(rng.randint(2, 6))]
    menu = "".join(f"<li><a href='/{i}'>{text(1)}</a></li>" for i in range(5))
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{p.replace('.', '.&amp;', 1)}</p>" for p in paragraphs)
    article = f"<article>{inner}</article>" if body_class is None else f'<div class="{body_class}">{inner}</div>'
    page = f"<html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>'</script></head><body><nav><ul>{menu}</ul></nav><div class='ad'>{text(8)}</div>{article}<footer>&copy; {text(6)}</footer>"
    return page, "\n".join([title, *(p.replace(".", ".&", 1) for p in paragraphs)])


def test_extraction(spark):
    rng = random.Random(5)
    made = [page(rng) for _ in range(120)]
    other = [page(rng, "post-content") for _ in range(30)]
    rows = [(i, f"u{i}", p, "n") for i, (p, _) in enumerate(made + other)] + [(900, None, None, "n"), (901, "u", "", "n"), (902, "u", "<nav><a>x</a></nav>", "n"), (None, "u", "plain < words &amp; no tags", "n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    model = html_article.train(pages)
    found = {r.page_id: r for r in html_article.extract(pages, model).collect()}
    assert len(found) == len(rows) and found[0].url == "u0"
    assert sum(found[i].text == t for i, (_, t) in enumerate(made)) >= 114
    assert sum(found[i].text == t for i, (_, t) in enumerate(made + other) if i >= 120) >= 26
    assert found[900].text == "" and found[901].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert html_article.train(pages.limit(0)) is None
    assert html_article.extract(pages, None).count() == len(rows)


def test_nothing_is_kept_below_a_dropped_node():
    rng = np.random.default_rng(2)
    nodes = html_article.parse("<div><p>a<b>b</b></p><ul><li>c<li>d</ul></div><p>e<p>f" * 3)
    for _ in range(50):
        p = rng.uniform(size=len(nodes))
        kept = html_article.decode(nodes, p)
        assert all(kept[n.parent] or not kept[i] for i, n in enumerate(nodes) if i)


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "math", "noscript", "template", "iframe"])
def test_an_unclosed_element_does_not_end_the_page(tag):
    text = lambda page: " ".join(n.text for n in html_article.parse(page) if n.tag == "#text")
    assert text(f"<article><p>a</p><{tag}><p>b</p></article>") == "a b"
    closed = text(f"<p>a <{tag}>x</{tag}> b</p>").split()
    assert closed == (["a", "b"] if tag in html_article.RAW else ["a", "x", "b"])
    assert text("<p>a</p><script><p>b</p>") == "a"


@pytest.mark.parametrize("page", [
    "<a " * 100_000, "<a" * 100_000, "<a \"" * 60_000, "<a \"'<a \"" * 40_000 + ">", "<span>" * 60_000 + "</b>" * 60_000, "<div>" * 60_000, "<head>" * 60_000,
    "<p><b>" * 40_000, "<span><div>" + "<b>" * 60_000 + "</span>" * 60_000, "<!x" * 60_000, "<" + "a" * 500_000, "</script " * 50_000, "<li>" * 60_000 + "<td>" * 60_000,
])
def test_malformed_pages_take_linear_time(page):
    start = time.process_time()
    nodes = html_article.parse(page)
    html_article.block_text(nodes, np.ones(len(nodes), bool))
    assert time.process_time() - start < 10  # walks of the stack or to the page's end at every < take minutes


def test_tags_are_found_as_by_a_plain_reading():
    """Against a reading that looks for the end of every tag by itself, with quotes and without any memory."""

    def plain(page):
        found, at = [], 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            end, name = None, re.match(r"</?([a-zA-Z][^\s/<>\"']*)", page[at:])
            if name:
                k, quote = at + name.end(), ""
                while k < len(page) and (quote or page[k] != ">"):
                    quote = ("" if page[k] == quote else quote) if quote else (page[k] if page[k] in "\"'" else "")
                    k += 1
                if k < len(page):
                    end = k + 1
                    found.append((at, end, name[1].lower(), page[at + 1] == "/", page[at + name.end() : k]))
            elif page[at + 1 : at + 2] in ("!", "?") and page.find(">", at) >= 0:
                end = page.find(">", at) + 1
            at = end or at + 1
        return found

    rng = random.Random(8)
    parts = ["<a ", "<p>", "</p>", "<b x='1'>", '<i y="<q>">', "text", " ", '"', "'", ">", "<", "<!-- c -->", "<!--", "<!x", "<?", "</", "<b", "<br/>", "/"]
    for _ in range(5000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        tokens, found, at = html_article.Tokens(page), [], 0
        while at < len(page):
            start, at, tag, closes, attributes = tokens.next(at)
            if tag is not None:
                found.append((start, at, tag, closes, attributes))
        assert found == plain(page), page


def test_decoding_is_the_most_likely_labelling():
    nodes = html_article.parse("<div><p>a</p><b>b</b></div>c")
    rng = np.random.default_rng(4)
    for _ in range(20):
        p = rng.uniform(0.05, 0.95, size=len(nodes))
        best, value = None, -np.inf
        for mask in range(1 << (len(nodes) - 1)):
            kept = [True] + [bool(mask >> i & 1) for i in range(len(nodes) - 1)]
            if all(kept[n.parent] or not kept[i] for i, n in enumerate(nodes) if i):
                total = sum(np.log(p[i] if k else 1 - p[i]) for i, k in enumerate(kept) if i)
                if total > value:
                    best, value = kept, total
        assert html_article.decode(nodes, p).tolist() == best


def test_trees_fit_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    model = fit_trees(x[:3000], y[:3000], np.ones(3000))
    assert ((model.predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_hilbert_numbers_are_a_path_through_all_cells():
    for n, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), -1).reshape(-1, n).astype(np.uint64)
        number = hilbert_search.hilbert(cells, bits)
        assert sorted(number.tolist()) == list(range(side**n))
        walk = cells[np.argsort(number)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_nearest_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 16)).astype(np.float32)
    vectors[50:90] = vectors[0]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0, None] + [0.0] * 14, 1), (1003, [float("nan")] * 16, 1), (1004, [1.0], 1), (None, [1.0] * 16, 1), (1100, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    found = hilbert_search.nearest(df, F.col("vec_id") % 10 == 0, curves=6, window=60, range_rows=64).collect()
    assert {r.query_id for r in found} == set(range(0, 300, 10))
    exact = vectors.astype(float)
    hits = 0
    for q in range(0, 300, 10):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r["rank"] for r in own] == list(range(1, 11)) and [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(300), d)).tolist() if i != q][:10]
        hits += len(set(order) & {r.vec_id for r in own})
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in own)
    assert hits >= 0.9 * 300
    copies = sorted((r for r in found if r.query_id == 60), key=lambda r: r.rank)
    assert [r.vec_id for r in copies] == [0, *range(50, 59)]
    few = hilbert_search.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3
    assert hilbert_search.nearest(df.limit(0), F.lit(True)).count() == 0


def recall(found, vectors, queries):
    exact, hits = vectors.astype(float), 0
    for q in queries:
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {r.vec_id for r in found if r.query_id == q})
    return hits / (10 * len(queries))


def test_nearest_in_a_crowd_of_near_copies(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(6000, 24))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[::3] = vectors[0] + 1e-4 * rng.normal(size=(2000, 24))  # a third of the rows, distinct
    vectors[1:600:15] = vectors[1] + 1e-5 * rng.normal(size=(40, 24))
    vectors = vectors.astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    found = hilbert_search.nearest(df, F.col("vec_id") % 25 == 0, window=60, range_rows=256).collect()
    asked = list(range(0, 6000, 25))
    assert recall(found, vectors, [q for q in asked if q % 3 == 0]) >= 0.9
    assert recall(found, vectors, [q for q in asked if q % 3]) >= 0.9


def test_ranges_do_not_grow_with_the_window(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(4000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    cuts, fit = [], hilbert_search.fit_curves

    def seen(*args, **named):
        cuts.append(fit(*args, **named))
        return cuts[-1]

    monkeypatch.setattr(hilbert_search, "fit_curves", seen)
    found = hilbert_search.nearest(df, F.col("vec_id") % 40 == 0, window=500, range_rows=128).collect()
    for curve in range(32):
        size = np.bincount(np.searchsorted(cuts[0].splits[curve], cuts[0].keys(vectors.astype(float), curve), side="right"))
        assert size.max() <= 2 * 128
    assert recall(found, vectors, range(0, 4000, 40)) >= 0.95


SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.is_dir(), reason="needs the driver's tables")
def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near duplicates", "benchmark", "tokens"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(SF))
        assert sorted(after.columns) == sorted(columns)
        after = corpus_pipeline.landed(after, "test-stage")
        assert after.join(before, columns, "left_anti").count() == 0
        kept, had = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        if name == "language":
            assert len(had - kept) <= 0.02 * len(had)
        elif name == "toxicity":
            assert sum(labels.get(i) == 0 for i in had - kept) <= 2
        elif name == "benchmark":
            norm = lambda s: " ".join("".join(re.findall(r"[^\W\d_]+", w.lower())) for w in s.split())
            items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            texts = {r.doc_id: norm(r.text) for r in before.collect()}
            assert {i for i, t in texts.items() if any(f" {x} " in f" {t} " for x in items)} <= had - kept
        before = after
    final = corpus_pipeline.STAGES[-1][1](spark, before, str(SF))
    assert final.count() == before.count()
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), str(SF)).count() == 0
