import hashlib
from collections import Counter

import numpy as np
import pytest

from ultraframe.llm import alignment
from ultraframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def encoded(text):
    a, b = alignment._side(alignment.BYTE_BPE), alignment._side(alignment.PIECES)
    x, y = a.encode([text])[0], b.encode([text])[0]
    whole = (" " + text).encode()
    return ([], []) if a.bytes_of(x) != whole or b.bytes_of(y) != whole else ([(i, a.pieces[i]) for i in x], [(i, b.pieces[i]) for i in y])


def cut(a, b):
    """Groups of two lists of (id, bytes), by walking along both."""
    out, own, ends = [], ([], []), [0, 0]
    a, b = list(a), list(b)
    while a or b:
        side = 0 if a and (ends[0] <= ends[1] or not b) else 1
        token, piece = (a, b)[side].pop(0)
        own[side].append(token)
        ends[side] += len(piece)
        if ends[0] == ends[1]:
            out.append(own)
            own = ([], [])
    return out


def brute(docs):
    held, counts = [], Counter()
    for _, text in docs:
        groups = cut(*encoded(text)) if text else []
        held.append(groups)
        counts.update({(x, y) for a, b in groups for x in a for y in b})
    top = {}
    for (x, _), n in counts.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (i, _), groups in zip(docs, held):
        links = [(x, y) for a, b in groups for x in a for y in b]
        spelled = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
key = lambda r: tuple((v is None, v or 0) if i == 0 else v for i, v in enumerate(r))


def test_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = QUERIES["op13_alignment"](spark, SF).select(*COLUMNS)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(docs), key=key)


ODD = ["aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "  two  spaces\n\nlines\t", "日本語のテキスト と 中文字符", "naïve café ☕️ 👩‍👩‍👧 ​", "<|endoftext|> <s> </s> <unk> <0x41>", "123456789 3.14159", "▁ in a text", "\x00\x01 nul", "א ב ג ‮ ד", "x" * 5000]


@pytest.mark.parametrize("heavy,block", [(1 << 16, 1 << 21), (3, 2), (1, 1)])
def test_odd_texts_blocks_and_few_heavy_pairs(spark, heavy, block):
    docs = [(i % 7, t) for i, t in enumerate(ODD + ODD[:3])] + [(None, "a text"), (90, None), (91, ""), (92, " ")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, place int, `a.b` string").repartition(3)
    found = alignment.align(frame, heavy=heavy, block=block).select(*COLUMNS)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(docs), key=key)


def test_bytes_that_come_back_differently_have_no_tokens():
    assert encoded("▁ in a text")[0] == []  # the piece writes U+2581 as a space
    assert encoded("plain")[0] != []


def test_groups_by_intervals():
    ends_a, ends_b = np.array([3, 5, 6, 9, 10]), np.array([1, 3, 7, 8, 9, 10])
    a, b = alignment.groups(ends_a, ends_b)
    assert a.tolist() == [0, 1, 1, 1, 2] and b.tolist() == [0, 0, 1, 1, 1, 2]


@pytest.mark.parametrize("block", [1, 3, 10**6])
def test_pairs_of_large_groups(block):
    rng = np.random.default_rng(block)
    a, b = rng.integers(0, 6, 200), rng.integers(0, 5, 260)
    group_a, group_b = np.sort(np.append(rng.integers(0, 9, 191), range(9))), np.sort(np.append(rng.integers(0, 9, 251), range(9)))
    expected = Counter((int(x), int(y)) for x, g in zip(a, group_a) for y, h in zip(b, group_b) if g == h)
    parts = list(alignment.pairs(a, b, group_a, group_b, block))
    found = [(int(k) >> 32, int(k) & 0xFFFFFFFF) for keys, _ in parts for k in keys]
    assert len(found) == len(set(found)) and dict(zip(found, (int(t) for _, times in parts for t in times))) == expected
    assert block > 1 or max(len(keys) for keys, _ in parts) <= 5


def test_no_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("known", [0, 1 << 19])
def test_remembered_words_change_nothing(monkeypatch, known):
    monkeypatch.setattr(alignment, "KNOWN", known)
    monkeypatch.setattr(alignment, "TOGETHER", 3)
    texts = ODD[:9] + ["plain words and plain words", "mixed　width space", "tab\tand  two", "end ", "ünï cödé ünï", "a" * 100 + " b", "words ▁ and words"] * 2
    both = alignment.Both(alignment._side(alignment.BYTE_BPE), alignment._side(alignment.PIECES))
    assert both.by_words
    for part in (texts, texts[::-1]):
        found = both.encode(part)
        at_a, at_b = np.append(0, np.cumsum(found.n_a)), np.append(0, np.cumsum(found.n_b))
        for i, t in enumerate(part):
            assert found.a[at_a[i] : at_a[i + 1]].tolist() == both.a.encode([t])[0]
            assert found.b[at_b[i] : at_b[i + 1]].tolist() == both.b.encode([t])[0]
            assert found.same[i] == (encoded(t)[0] != [])
