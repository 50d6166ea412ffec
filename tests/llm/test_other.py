"""Pages, neighbours, SQL, and the pipeline."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import connect, rows  # noqa: E402

from ultraframe.llm import forest, pages  # noqa: E402
from ultraframe.llm.components import components  # noqa: E402
from ultraframe.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_cut_is_the_cheapest_labelling():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 9)
        lean = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.5]

        def cost(keep):
            return sum(-x if k else x for x, k in zip(lean, keep)) / 2 + sum(w for i, j, w in edges if keep[i] != keep[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(pages.minimum_cut(lean, edges)) == pytest.approx(best)


PAGES = [
    (1, "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>One &amp; two<br>three <b>bo</b>ld</p><script>var x='<p>no</p>'</script></article><footer>F</footer></body></html>"),
    (2, None), (3, ""), (4, "<p>" * 500 + "deep text that goes on and on for a good many words until it is long enough to stay"),
    (5, "<article><p>unclosed <!-- never ends"), (6, "<div class='comments'><p>I say something rather long here about what I have read above</p></div>"),
]


def test_pages(spark):
    table = spark.createDataFrame([(i, "u", h, "own") for i, h in PAGES], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in pages.extract(table).collect()}
    assert got[1] == "Head One & two three bold" and got[2] == got[3] == got[6] == "" and got[5] == "unclosed" and got[4].startswith("deep text")
    assert pages.extract(table.limit(0)).count() == 0


NAV = "<div><ul><li><a href=/>Home</a></li><li><a href=/a>All the articles of this long and very busy year in one place.</a></li><li><a href=/b>About</a></li></ul></div>"
LONG = "The river rose for three days, and on the fourth the people of the lower town carried what they had up to the church on the hill."
SHORT = ["A short one.", "Nine words are what this small paragraph has here.", "What came next"]
# Main texts of pages without article and main, of different shapes.
UNMARKED = [
    (f"<html><body>{NAV}<div><h2>{SHORT[2]}</h2><p>{LONG}</p><p>{SHORT[0]}</p><p>{LONG} {LONG}</p><p>{SHORT[1]}</p><p>{LONG}</p></div><footer><p>{LONG}</p></footer></body></html>", f"{SHORT[2]} {LONG} {SHORT[0]} {LONG} {LONG} {SHORT[1]} {LONG}"),
    (f"<body><header><p>{LONG}</p></header><div id=content><h1>Head</h1><p>{LONG} <button>Share</button><select><option>One</select> goes on</p><p>{LONG}</p></div><div class='comment-list'><p>{LONG}</p></div>{NAV}", f"Head {LONG} goes on {LONG}"),
    (f"<body><div class='page has-sidebar'><article><p>{SHORT[0]}</p><aside>{LONG}</aside><p>{LONG}</p></article><div class=sidebar><p>{LONG}</p></div></div>", f"{SHORT[0]} {LONG}"),
    (f"<body><article><h1>T</h1><p>{LONG}</p><form><p>{LONG}</p></form></article><section class=related><article><p>{LONG}</p></article></section>", f"T {LONG}"),
]


def test_cut_beats_the_costs_alone():
    for source, want in UNMARKED:
        assert pages.main_text(source)[0] == want
    blocks = pages.blocks_of(UNMARKED[0][0])
    alone = " ".join(b.text for b, x in zip(blocks, pages.leanings(blocks, pages.PRIOR)) if x > 0)
    assert alone != UNMARKED[0][1] and pages.main_text(UNMARKED[0][0])[3] > 0


def test_fitted_costs_give_marked_pages_and_unmarked_ones(spark):
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice(["one", "two", "three", "four"]) for _ in range(n)).capitalize() + "."
    rows, want = [], {}
    for i in range(60):
        body = [prose(r.choice([3, 9, 30, 80])) for _ in range(r.randint(1, 9))]
        want[i] = " ".join([f"Head {i}", *body])
        inner = f"<h1>Head {i}</h1>" + "".join(f"<p>{x}</p>" for x in body)
        rows.append((i, "u", f"<body><nav><a>{prose(3)}</a></nav><div class=ad>{prose(20)}</div><article>{inner}</article><footer>{prose(30)}</footer>"))
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    weights = pages.fit(table)
    assert weights != pages.PRIOR and {x.page_id: x.text for x in pages.extract(table, weights).collect()} == want
    assert all(pages.main_text(source, weights)[0] == text for source, text in UNMARKED)
    assert pages.fit(table.limit(0)) == pytest.approx(pages.PRIOR)


def test_cut_of_a_long_page_ends():
    lean = [(-1.0) ** (i // 7) * (1 + i % 3) for i in range(40_000)]
    edges = [(i - 1, i, 1.0 + i % 2) for i in range(1, len(lean))] + [(i - 9, i, 0.5) for i in range(9, len(lean))]
    assert len(pages.minimum_cut(lean, edges)) == len(lean)


def brute(vectors, k):
    good = [(i, np.array(v, float)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {q: sorted(((-float(x @ v), i) for i, v in good if i != q))[:k] for q, x in good if q % 20 == 0}


def test_neighbours(spark):
    r = np.random.default_rng(3)
    data = [(i, r.standard_normal(8).tolist()) for i in range(300)]
    data += [(300 + i, data[0][1]) for i in range(61)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (404, [float("inf")] + [1.0] * 7), (420, [1.0, 2.0])]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    found = forest.search(table, table.where("vec_id % 20 = 0"), 20).collect()
    want = brute([(i, None if v is None or len(v) != 8 else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data], 20)
    for q, near in want.items():
        got = sorted((x.rank, x.vec_id, x.score) for x in found if x.query_id == q)
        assert [g[1] for g in got] == [i for _, i in near] and np.allclose([g[2] for g in got], [-s for s, _ in near])
    assert {x.query_id for x in found} == set(want)
    assert forest.search(table.limit(0), table.limit(0)).count() == 0


def test_neighbours_of_unequal_norms_and_small_leaves(spark):
    r = np.random.default_rng(4)
    data = [(i, (r.standard_normal(6) * r.uniform(0.2, 2)).tolist()) for i in range(2000)]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    found = forest.search(table, table.where("vec_id % 20 = 0"), 20, trees=24, leaf=400).collect()
    want = brute([(i, [float(np.float32(x)) for x in v]) for i, v in data], 20)
    hits = sum(len({i for _, i in near} & {x.vec_id for x in found if x.query_id == q}) for q, near in want.items())
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("spread", ["one large norm", "wide", "clusters"])
def test_neighbours_ascend_to_enough_candidates(spark, spread):
    r = np.random.default_rng(5)
    x = r.standard_normal((3000, 12))
    if spread == "one large norm":
        x[1] *= 1000
    elif spread == "wide":
        x *= np.exp(r.standard_normal((3000, 1)) * 2)
    else:
        x = np.repeat(x[:300], 10, axis=0) + 0.05 * r.standard_normal((3000, 12))
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = forest.search(table, table.where("vec_id % 20 = 0"), 20, leaf=128).collect()
    near = {}
    for f in found:
        near.setdefault(f.query_id, set()).add(f.vec_id)
    hits = 0
    for q in range(0, 3000, 20):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        assert len(near.get(q, ())) == 20
        hits += len(near[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * 150


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).execute(ORACLES[name]).df())


def test_pipeline(spark):
    import corpus_pipeline

    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        assert 0 < out.count() <= docs.count(), name
        docs = out
    assert corpus_pipeline.run(spark, SF).columns == [*names, "copy"]


def test_stages_of_odd_rows_and_no_rows(spark, tmp_path):
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten eleven twelve " * 4
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "some words here", "en", None, 3), (4, text + "\n" + text, "en", "b", 9), (5, "x" * 50_000, "de", "b", 50_000)]
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, own in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(own, shape).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (4, None, 0), (None, 0, 1)] if own else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "benchmark words"), (None, None)] if own else [], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert out.columns[:5] == [f.split()[0] for f in shape.split(", ")], stage
            got = [r.doc_id for r in out.collect()]
            assert set(got) <= {1, 2, 3, 4, 5, None} and (own or not got), stage
            if stage in ("toxicity", "benchmark decontamination"):
                assert len(got) == len(own), stage
