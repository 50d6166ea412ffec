import random
import re

import pytest
import xxhash
from brute import SPACED, fold

from ultraframe.llm import simhash
from ultraframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def restated(text, size=4):
    words = SPACED.findall(fold(text))
    if not words:
        return 0
    own = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(prints, apart=4):
    """The least position that links lead to, for each position."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= apart:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [restated(r.text) for r in docs]
    expected = {(r.doc_id, f"{p:016x}", docs[c].doc_id) for r, p, c in zip(docs, prints, joined(prints))}
    found = QUERIES["op12_simhash"](spark, SF)
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(docs)
    assert any(a != c for a, _, c in expected)


def chains(seed, n):
    """Fingerprints near each other in every band, in chains, and far ones."""
    rng = random.Random(seed)
    out = [0, 2**64 - 1, *[rng.getrandbits(64) for _ in range(n // 4)]]
    while len(out) < n:
        x = rng.choice(out)
        for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 4, 4, 5, 6])):
            x ^= 1 << bit
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("owners", [4096, 2])
@pytest.mark.parametrize("apart", [4, 1])
def test_all_links_and_slices(spark, apart, owners):
    prints = chains(apart, 500)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = {(r.u, r.v) for r in simhash.links(frame, apart, owners).collect()}
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= apart for u, v in links)
    root = {signed(p): signed(p) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        root[find(u)] = find(v)
    groups = joined(prints, apart)
    place = {}
    for p, g in zip(prints, groups):
        assert place.setdefault(g, find(signed(p))) == find(signed(p))
    assert len(set(place.values())) == len(place)


def test_crowded_ball_gives_few_links(spark):
    """All that lie a bit or two from one fingerprint: over 2,000 texts in a few cells, and no pairs of them all."""
    prints = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    n = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, 512).count()
    assert len(prints) - 1 <= n < 150 * len(prints)


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(100_000))
    rows = [(5, None), (3, ""), (4, " \t\n"), (9, "one two"), (8, "ONE  two"), (7, "one two"), (2, long), (2, long), (None, "one two"), (1, "a b c d a b c d")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, `a.b` string")
    found = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    prints = [restated(t) for _, t in rows]
    assert prints[0] == prints[2] == 0
    ids = [i for i, _ in rows]
    group = joined(prints)
    least = {g: min(i for i, h in zip(ids, group) if h == g and i is not None) for g in group}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(found, key=key) == sorted(((i, f"{p:016x}", least[g]) for i, p, g in zip(ids, prints, group)), key=key)
    assert re.fullmatch("[0-9a-f]{16}", found[0][1])


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), 5)
