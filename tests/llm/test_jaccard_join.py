from __future__ import annotations

import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, width):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def brute(texts, width, percent):
    sets = sets_of(texts, width)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    seen = set()
    for ids in where.values():
        seen |= {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in seen:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def family(rng, n, size, edits, head):
    base = [f"{head}{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def texts_for(rng):
    texts = [None, "", " \n", "one", "One", "two words", "TWO\twords", "a b c", "É a b", "é a b"]
    for size, edits in ((12, 1), (40, 3), (100, 6), (300, 12), (900, 30)):
        texts += family(rng, 14, size, edits, f"f{size}x")
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[k * 6 : k * 6 + 200]) for k in range(20)]  # each links to the next only
    passage = " ".join(f"p{i}" for i in range(120))
    texts += [passage + " " + " ".join(f"q{i}_{k}" for k in range(20 + 3 * i)) for i in range(12)]
    return texts


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_against_all_pairs(spark, docs, corpus, width, percent):
    texts = texts_for(random.Random(width)) + [r["text"] for r in corpus]
    want = brute(texts, width, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(docs(texts), width=width, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize(("parts", "may_differ"), [(3, 1), (4, 2), (3, 2)])
def test_other_enumerations_against_all_pairs(spark, docs, parts, may_differ):
    texts = texts_for(random.Random(parts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(docs(texts), width=3, percent=80, parts=parts, may_differ=may_differ).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 3, 80)


def test_subsets_that_are_surely_shared():
    """Against every way to deal the parts that differ to the groups."""
    for parts, may_differ in ((2, 1), (3, 1), (3, 2), (4, 2), (5, 2)):
        kept = [math.comb(parts - d, parts - may_differ) for d in range(parts + 1)]
        for groups in (1, 2, 3):
            for most in range(groups * (may_differ + 1)):
                want = min(sum(kept[d] for d in dealt) for dealt in itertools.product(range(parts + 1), repeat=groups) if sum(dealt) <= most)
                assert J.surely_shared(np.array([most]), np.array([groups]), parts, may_differ).tolist() == [want] and want > 0


def test_parts_that_cannot_be_enumerated():
    for parts, may_differ in ((2, 2), (2, 0), (1, 1)):
        with pytest.raises(ValueError, match="parts"):
            J.signatures(np.arange(3), np.array([3]), 80, parts, may_differ)


def left(found, row, order):
    """Signatures of a set without the ones that come first in ``order``, as many as it may leave out on each side."""
    out = set()
    for side in (0, 1):
        at = (found[0] == row) & (found[2] == side)
        out |= set(sorted(found[1][at].tolist(), key=order.get)[int(found[3][at].max(initial=0)) :])
    return out


@pytest.mark.parametrize(("parts", "may_differ"), [(2, 1), (3, 1), (4, 2), (5, 3)])
def test_signatures_meet_for_every_similar_pair(parts, may_differ):
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        for _ in range(150):
            n = int(rng.integers(1, 400))
            a = rng.choice(2**62, n, replace=False)
            most = max(0, int(n * (100 - percent) / percent))
            drop, add = int(rng.integers(0, n)) if n > 1 else 0, int(rng.integers(0, most + 2))
            drop = min(drop, most)
            b = np.concatenate([a[drop:], rng.choice(2**62, add)])
            inter, union = n - drop, n + add
            if not len(b) or 100 * inter < percent * union:
                continue
            found = J.signatures(np.concatenate([a, b]).astype(np.int64), np.array([len(a), len(b)]), percent, parts, may_differ)
            order = {s: x for s, x in zip(np.unique(found[1]).tolist(), rng.permutation(len(found[1])).tolist(), strict=False)}
            assert left(found, 0, order) & left(found, 1, order)  # whichever signatures are the most frequent


def test_one_of_each_stays(spark, docs):
    texts = family(random.Random(1), 6, 200, 2, "z") + ["alone in the world here", None, None, ""]
    kept = {r["doc_id"] for r in J.first_of_each(docs(texts), width=3, percent=90).collect()}
    assert kept == {0, 6, 7, 8, 9}


def test_repeated_heads_and_null_ids(spark, docs):
    text = " ".join(f"w{i}" for i in range(50))
    rows = docs([text, "other words stand here now", text + " more"]).collect()
    rows = [tuple(r) for r in rows]
    none = [(None, *r[1:]) for r in rows]
    other = (5, text, "en", "s", 1)  # id 5 twice, once with a copy of text 0
    alone = (5, "one two three four five six", "en", "s", 1)
    only = (None, "seven eight nine ten eleven twelve", "en", "s", 1)
    df = spark.createDataFrame([*rows, *rows, *none, other, alone, only, only], docs([]).schema)
    kept = sorted(((r["doc_id"], r["text"][:5]) for r in J.first_of_each(df).collect()), key=str)
    assert kept == [(0, text[:5]), (1, "other"), (5, "one t"), (None, "seven")]


def test_a_family_below_the_threshold(spark, docs):
    """Two thousand texts that share a passage of over half their words: no link, and few candidates."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"o{rng.randrange(10**9)}" for _ in range(40)]) for _ in range(2000)]
    got = J.components(docs([*texts, texts[7] + " tail"])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {**{i: i for i in range(2000)}, 2000: 7}


def test_long_texts(spark, docs):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**7)}" for _ in range(500_000)]
    texts = [" ".join(words), " ".join(words[:450_000]), " ".join(words[:200_000])]
    assert [r["component_id"] for r in sorted(J.components(docs(texts)).collect(), key=lambda r: r["doc_id"])] == [0, 0, 2]


def test_repeated_ids_and_empty(spark, docs):
    df = docs(["a b c d", "a b c d", "x"])
    assert J.components(df.union(df)).count() == 6
    assert J.components(docs([])).count() == 0
