"""Operators on texts: 1, 2, 3, 4, 6, 7, 9 and 10 on small hand-made tables."""

import random
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from ultraframe.llm import decontaminate, jaccard, lengths, lines, mixing, pages, pii, substrings, toxicity  # noqa: E402
from ultraframe.llm.lines import dedup_lines  # noqa: E402

SHAPE = "doc_id bigint, text string"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def corpus():
    base = [prose(80, i) for i in range(12)]
    near = [b.replace(" ", "\t", 3) + " end" for b in base[:4]]
    cut = [prose(9, 90 + i) + " " + " ".join(base[i].split()[20:50]) + " " + prose(9, 95 + i) for i in range(4)]
    odd = [None, "", " \n ", "one", "one two three", "É x Y", base[0], base[0], base[0].upper(), "w " * 3000, prose(5000, 77)]
    return list(enumerate([*base, *near, *cut, *odd]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SHAPE).repartition(3)


def empty(spark, shape=SHAPE):
    return spark.createDataFrame([], shape)


def test_substrings_equal_brute_force(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs).collect()}
    assert got == brute.kept_words(corpus())


def test_substrings_repeated_rows_null_ids_and_no_rows(spark):
    text = prose(30, 1)
    got = substrings.remove_repeats(spark.createDataFrame([(1, text), (1, text), (None, text), (5, None)], SHAPE)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 30), (1, 0), (1, 0), (5, 0)]
    assert substrings.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("small, cluster", [(32, 2_000_000), (2, 300), (2, 1000)])
def test_near_duplicates_equal_brute_force(spark, docs, monkeypatch, small, cluster):
    monkeypatch.setattr(jaccard, "CLUSTER", cluster)
    r = random.Random(3)
    copies = []
    for i in range(14):  # a group in which few are within reach of all
        words = prose(60, 500).split()
        for j in r.sample(range(60), i // 3):
            words[j] = f"x{i}{j}"
        copies.append((100 + i, " ".join(words)))
    more = docs.union(spark.createDataFrame(copies, SHAPE))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(more, small=small, cluster=cluster).collect()}
    assert got == brute.groups(corpus() + copies)


def test_near_duplicates_edges(spark):
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    text = prose(30, 1)
    rows = spark.createDataFrame([(7, text), (7, text), (None, text), (None, "alone here now"), (3, None), (4, None)], SHAPE)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.near_duplicates(rows).collect())
    assert got == [(-1, -1), (-1, 7), (3, 3), (4, 4), (7, 7), (7, 7)]
    kept = jaccard.one_of_each(rows.withColumn("component_id", F.lit("x"))).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in kept) == [(-1, "x"), (-1, "x"), (3, "x"), (4, "x"), (7, "x")]


def test_pipeline_stage_links_five_words_at_80_percent(spark, monkeypatch):
    import corpus_pipeline

    rows = []
    for i in range(8):
        words = prose(60, 700 + i).split()
        for edits in (0, 2, 12):  # two edits side by side are near by 5 words and 80, not by 4 and 85
            rows.append((len(rows), " ".join([*words[:30], *[f"x{i}{j}" for j in range(edits)], *words[30 + edits :]])))
    thin = brute.groups(rows)
    monkeypatch.setattr(brute, "shingles", lambda text, own=brute.shingles: own(text, 5))
    want = brute.groups(rows, 80)
    assert {i for i in want if want[i][1] == i} < {i for i in thin if thin[i][1] == i}
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SHAPE), "").collect()
    assert sorted(r.doc_id for r in kept) == [i for i in sorted(want) if want[i][1] == i]


@pytest.mark.parametrize("seed", range(4))
def test_near_links_equal_brute_force(seed):
    import numpy as np

    r = np.random.default_rng(seed)
    sets = []
    for _ in range(6):  # groups around a centre, some of them near to each other
        centre = r.integers(0, 1 << 62, r.integers(1, 60)).astype(np.uint64)
        for _ in range(r.integers(1, 40)):
            own = centre.copy()
            own[r.random(len(own)) < r.random() * 0.2] = r.integers(0, 1 << 62)
            sets.append(np.unique(own))
    sets = [np.array(x, np.uint64) for x in sorted({tuple(x.tolist()) for x in sets})]
    group = np.sort(r.integers(0, 2, len(sets)))
    i, j = jaccard.near_links(group, [x.tobytes() for x in sets], 85)
    want, got = jaccard.Forest(len(sets)), jaccard.Forest(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if group[a] == group[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                want.join(np.array([a]), np.array([b]))
    assert got.join(i, j).all() and got.root.tolist() == want.root.tolist()


def test_sketch_bounds_the_overlap():
    import numpy as np

    r = np.random.default_rng(1)
    for n, m in ((5, 9), (100, 120), (3000, 2900)):
        a, b = (np.unique(r.integers(0, 5000, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (n, m))
        assert jaccard.overlap_bound(jaccard.sketch(a), jaccard.sketch(b)) >= len(np.intersect1d(a, b))


ITEMS = [(1, prose(40, 2)), (2, " ".join(prose(80, 0).split()[5:25])), (3, "one"), (4, ""), (5, None), (None, "two three"), (6, "É x"), (2, prose(12, 3))]


@pytest.mark.parametrize("block", [10**6, 5])
def test_contamination_equals_brute_force(spark, docs, block):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontaminate.find_contamination(docs.withColumn("hit_items", F.lit(1)), items, block_words=block)
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.hit_spans), r.hit_items) for r in found.collect()}
    assert got == dict(zip((i for i, _ in corpus()), brute.contamination(corpus(), ITEMS)))
    clean = {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()}
    assert clean == {i for i, x in got.items() if x[1] == 0}


def test_contamination_without_rows(spark, docs):
    nothing = empty(spark, "item_id bigint, text string")
    assert decontaminate.find_contamination(docs, nothing).where("size(hit_spans) > 0").count() == 0
    assert decontaminate.find_contamination(empty(spark), nothing).count() == 0


def test_lines_drop_later_runs(spark):
    a, b, c, d = "alpha one", "beta two", "gamma three", "delta four"
    rows = [(1, "\n".join([a, b, c, d])), (2, "\n".join(["x", b, " " + c, d, "y"])), (3, "\n".join([a, b])), (4, "\n".join([a, b, c, a, b, c])), (5, None), (6, ""), (7, "\n\n\n\n\n"), (8, "\n".join([a, b, c, d]))]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, SHAPE).withColumn("n_lines", F.lit("own"))).collect()}
    assert got[1] == (rows[0][1], 4, 0) and got[2] == ("x\ny", 5, 3) and got[3] == (rows[2][1], 2, 0)
    assert got[4] == ("", 6, 6) and got[5] == (None, 0, 0) and got[6] == ("", 1, 0) and got[7][2] == 0 and got[8] == ("", 4, 4)
    assert dedup_lines(empty(spark)).count() == 0


def test_line_runs_equal_brute_force(spark):
    r = random.Random(9)
    own = ["a", "b ", " c", "d e f", "", " ", "é é", "w " * 12, "x " * 19 + "y", "v " * 30]
    rows = [(r.choice([i, i, i, 7, None]), "\n".join(r.choice(own) for _ in range(r.randint(0, 30)))) for i in range(60)]
    rows += [(100, "v " * 30), (101, "one\n" + "v " * 30), (102, "z " * 11 + "\n" + "t " * 10), (103, "q\n" + "z " * 11 + "\n" + "t " * 10)]
    rows = sorted(set(rows), key=lambda x: str(x))

    def removed(rank):
        seen, gone = {}, {x: set() for x in rows}
        for row in rows:
            lines = [x.strip(" ") for x in row[1].split("\n")]
            n = [len(x.split()) for x in lines]
            for s in range(len(lines)):
                for k in (1, 2, 3):
                    if s + k <= len(lines) and any(lines[s : s + k]) and (k == 3 or sum(n[s : s + k]) >= 20) and (sum(n[s : s + k - 1]) < 20 or sum(n[s + 1 : s + k]) < 20):
                        seen.setdefault(tuple(lines[s : s + k]), []).append((rank(row), s, row, k))
        for places in seen.values():
            for _, s, row, k in sorted(places)[1:]:
                gone[row] |= set(range(s, s + k))
        return gone

    keys = {(x.doc_id, x.text): x.k for x in spark.createDataFrame(rows, SHAPE).withColumn("k", F.xxhash64(F.coalesce("doc_id", F.lit(lines.LAST)), "text")).collect()}
    gone = removed(lambda x: (x[0] is None, x[0] or 0, keys[x]))
    table = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], SHAPE + ", key long").repartition(5)
    got = {rows[x.key]: (x.text, x.n_removed) for x in dedup_lines(table).collect()}
    assert got == {x: ("\n".join(y for j, y in enumerate(x[1].split("\n")) if j not in gone[x]), len(gone[x])) for x in rows}
    assert sum(map(len, gone.values())) > 50 and gone[103, rows[[y[0] for y in rows].index(103)][1]] == {1, 2}


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, prose(r.randint(0, 40), i), r.choice(["a", "b", "c", None])) for i in range(3000)] + [(1, "w w", "a"), (1, "w w", "a"), (None, None, "zero")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sized = table.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    for chunk in (50_000, 100):
        mixed = mixing.mix(sized, chunk=chunk).toPandas()
        assert len(mixed) == len(rows) and mixed["copies"].between(0, 3).all()
        for _, own in mixed.groupby("source", dropna=False):
            goal, size = own["target"].iloc[0], own["source_size"].iloc[0]
            assert own["size"].sum() == size and goal <= 3 * size + 1e-6
            assert abs((own["size"] * own["copies"]).sum() - goal) <= max(40, 0.005 * goal)
        assert abs(mixed.groupby("source", dropna=False)["target"].first().sum() - mixed["size"].sum()) < 1e-6
    again = mixing.mix(sized.repartition(7)).toPandas()
    key = ["doc_id", "size", "copies"]
    assert sorted(map(tuple, again[key].fillna(-1).to_numpy())) == sorted(map(tuple, mixing.mix(sized).toPandas()[key].fillna(-1).to_numpy()))
    assert mixing.sample(table).count() == int(again["copies"].sum())
    assert mixing.mix(sized.limit(0)).count() == 0


@pytest.mark.parametrize("long", [1000, 20])
def test_mixing_equals_brute_force(spark, long):
    r = random.Random(11)
    names = ["a", "b", "c", "d", None, "zero"]
    rows = [(i, 0 if (s := r.choice(names)) == "zero" else int(r.paretovariate(1.2) * 5), s) for i in range(800)] + [(i, 7, "d") for i in range(3)] + [(None, 9, None)]
    table = spark.createDataFrame([(*x, "own") for x in rows], "doc_id bigint, size bigint, source string, row string")
    mixed = mixing.mix(table, long=long)
    assert mixed.columns == ["doc_id", "size", "source", "row", "source_size", "target", "copies"]
    got = {}
    for x in mixed.collect():
        got.setdefault((x.source, x.target), []).append((x.doc_id, x.size, x.copies))
    sizes = {}
    for _, size, s in rows:
        sizes[s] = sizes.get(s, 0) + size
    assert {s: pytest.approx(t) for s, t in got} == brute.targets(sizes)
    for (s, goal), own in got.items():
        assert sorted(own, key=str) == brute.copies([(i, n) for i, n, x in rows if x == s], {s: goal}, 1, long)
        if long == 1000 and sizes[s]:
            assert abs(sum(n * c for _, n, c in own) - goal) <= max(10, 0.01 * goal)


def test_targets_stop_at_three_times(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 97)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == {"a": 3.0, "b": 3.0, "c": 3.0, "d": 91.0}


def test_pii_base_patterns(spark):
    rows = ["mail a.b@c.de, a@b@c.org x@y", "1.2.3.4 300.1.1.1 1.2.3.4.5 01.02.03.004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (988) 555-2485 +12 +1234567890123456", "é 10.0.0.1 z@z.z", None, "", "@" * 50 + "a@b.c" + "9" * 60]
    table = spark.createDataFrame(list(enumerate(rows)), SHAPE).withColumn("spans", F.lit(0))
    got = {r.doc_id: [tuple(x) for x in r.base] for r in pii.find(table).collect()}
    for i, text in enumerate(rows):
        t = text or ""
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        want = [("email", *m.span()) for m in pii.EMAIL.finditer(t)]
        want += [("ip", *m.span()) for m in pii.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in pii.CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [("phone", *m.span()) for m in pii.PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
        assert got[i] == want, text
    assert pii.find(empty(spark)).count() == 0


def test_pii_contexts_find_unseen_identifiers(spark):
    known = [f"please call me at +1 (555) 010-{i:04d} soon, friend" for i in range(30)]
    known += [f"write to box{i}@x{i}.org or so" for i in range(8)]
    new = ["please call me at 555 019 9776 soon, friend", "the year was in 1999.5000 then", "write to joe2@local or so", "call me at 555.0199.77", f"{'x' * 500} at 5550-1234 {'y' * 500}"]
    table = spark.createDataFrame(list(enumerate(known + new)), SHAPE)
    got = {r.doc_id: [(x.kind, (known + new)[r.doc_id][x.start : x.end]) for x in r.spans] for r in pii.find(table).collect()}
    assert got[38] == [("phone", "555 019 9776")] and got[39] == [] and got[40] == [("email", "joe2@local")] and got[41] == [("phone", "555.0199.77")] and got[42] == []
    assert [k for k, _ in got[0]] == ["phone"] and [k for k, _ in got[30]] == ["email"]


def test_pii_instances_induce_patterns(spark):
    rows = [f"call me at +1 (555) 010-{i:04d} today" for i in range(9)]
    rows += [f"call me at 77-{i}-77 today" for i in range(2)] + [f"pager: no {k} 77-{i}-77 it is" for i in range(2) for k in "ab"]
    edges = [(f"p{k}", f"s{i}", "phone") for i in range(8) for k in range(1)] + [("p0", f"n{i}", None) for i in range(1)]
    edges += [("p1", f"s{i}", "phone") for i in range(4)] + [("p1", "n0", None), ("p2", "n0", None), ("p2", "m", None)] + [("p3", f"s{i}", None) for i in range(5)] + [("p3", "z", None)]
    got = {r.pattern: r.kind for r in pii.learn(spark.createDataFrame(edges, "pattern string, instance string, kind string")).collect()}
    assert got == {"p0": "phone", "p1": "phone"} and pii.find(spark.createDataFrame(list(enumerate(rows)), SHAPE)).count() == len(rows)


def test_toxicity_learns_and_ranks(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(40, i).split() + (r.sample(["vile", "wicked", "nasty"], 2) if bad else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    table = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], SHAPE)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    index = toxicity.fit(table, labels.where(~toxicity.held_out()))
    got = {x.doc_id: x.score for x in toxicity.score(table, index).collect()}
    out = [(y, got[i]) for i, _, y in rows if labels.where(f"doc_id = {i}").where(toxicity.held_out()).count() and i < 40 or False]
    assert all((s >= 0.5) == bool(y) for y, s in out) and all(0 <= s <= 1 for s in got.values()) and got[900] < 0.5
    none = toxicity.fit(table, labels.limit(0))
    assert {x.score for x in toxicity.score(table, none).collect()} == {0.0}
    assert toxicity.score(empty(spark), index).count() == 0


def test_toxicity_equals_brute_force():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    odds = 1 / np.arange(1, 301) ** 0.7
    odds /= odds.sum()
    texts = [{int(t): int(r.integers(1, 4)) for t in r.choice(300, r.integers(0, 40), replace=False, p=odds)} for _ in range(900)]
    toxic = (r.random(900) < 0.2).astype(float)
    rows = pa.table({"example": pa.array(np.arange(900)), "toxic": pa.array(toxic.astype(np.int32)), "terms": pa.array([sorted(x) for x in texts], pa.list_(pa.int64())), "counts": pa.array([[x[t] for t in sorted(x)] for x in texts], pa.list_(pa.int32()))})
    df = np.array([sum(t in x for x in texts) for t in range(300)], float)
    index = toxicity._index(rows, lambda v: (df[v.astype(np.int64)], 1000), toxic.mean())
    weight = {}
    for t in range(300):
        a, b = (sum(y == k for x, y in zip(texts, toxic) if t in x) + 0.5 for k in (1, 0))
        p, q = a / (toxic.sum() + 1), b / (900 - toxic.sum() + 1)
        weight[t] = (np.log(1001 / (df[t] + 1)) + 1) * np.log(p * (1 - q) / (q * (1 - p))) ** 2 / (1 / a + 1 / b)
    dense = np.array([[(1 + np.log(x[t])) * weight[t] if t in x else 0 for t in range(300)] for x in texts])
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-12)[:, None]
    for _ in range(30):
        terms = np.sort(r.choice(300, r.integers(1, 30), replace=False))
        counts = r.integers(1, 4, len(terms))
        own = np.array([(1 + np.log(c)) * weight[t] for t, c in zip(terms, counts)])
        cosine = dense[:, terms] @ (own / np.linalg.norm(own))
        best = np.argsort(-cosine, kind="stable")[: toxicity.K]
        votes = 1 / (1 + toxicity.SOFT - cosine[best])
        want = (votes @ toxic[best] + toxicity.PRIOR * toxic.mean()) / (votes.sum() + toxicity.PRIOR)
        at = np.searchsorted(index.vocabulary, terms.astype(np.uint64))
        query = index.queries(np.array([0, len(at)]), at, counts)
        got, near = index.raw(at, query, index.base(np.array([0, len(at)]), at, query)[0])
        assert abs(got - want) < 1e-4 and np.allclose(np.sort(cosine[near]), np.sort(cosine[best]), atol=1e-5)


def test_token_limits(spark):
    h = spark.createDataFrame([(0, 2), (3, 1), (5, 4), (3000, 1)], "n_tokens bigint, n_docs bigint")
    got = {r.n_tokens: (r.docs_over, r.tokens_over, r.truncated_tokens) for r in lengths.limits(h).collect()}
    sizes = [0, 0, 3, 5, 5, 5, 5, 3000]
    assert got == {k: (sum(s > k for s in sizes), sum(s for s in sizes if s > k), sum(min(s, k) for s in sizes)) for k in (0, 3, 5, 3000)}
    assert lengths.quantile(lengths.limits(h), 0.5).first()[0] == 5 and lengths.limits(h.limit(0)).count() == 0


def test_token_lengths(spark, docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(lengths.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in lengths.token_lengths(docs.withColumn("n_tokens", F.lit("x"))).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in corpus()}


LINE = "The quiet river crossed the valley, and the old mill by the bridge turned its wheel through the long summer days."


def test_form_around_the_page_is_no_form_of_it():
    body = f"<div class='menu'><a href=1>Home</a></div><div><p>{LINE}</p><p>{LINE}</p></div><div>Your name <input></div>"
    assert pages.main_text(f"<body><form id='aspnetForm'>{body}</form></body>")[0] == f"{LINE} {LINE}"
    own = f"<body><div><p>{LINE}</p><p>{LINE}</p></div><form><p>Tell us what you think of it, and leave your address below.</p></form></body>"
    assert pages.main_text(own)[0] == f"{LINE} {LINE}"


@pytest.mark.parametrize("extra", ["<div class='discussion'><p>" + LINE + "</p></div>", "<p>We use cookies on this site. Accept all or change your settings here.</p>", "<div>Copyright 2024 by us. All rights reserved.</div>"])
def test_discussions_and_unnamed_notices_go(extra):
    assert pages.main_text(f"<body><article><p>{LINE}</p><p>{LINE}</p></article>{extra}</body>")[0] == f"{LINE} {LINE}"


def test_deep_pages_take_time_in_proportion():
    import time

    def seconds(n):
        began = time.process_time()
        found = pages.main_text("<div>" * n + f"<p>{LINE}</p>" + "</div><p>x</p>" * n + f"<p>{LINE}</p>")
        assert found[0].count(LINE) == 2
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.05)
