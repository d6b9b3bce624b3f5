from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_docs=D.MIN_DOCS, top=D.TOP):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + D.UNIT * (c[t] + 2) // total for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            found = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]}
            found["term"] = [(-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items in found.items():
                ranked = sorted(items, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(ranked[: None if part == "pair" else top])]
    return sorted(out)


def rows_of(df, **sizes):
    out = D.audit(df, **sizes)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and [t for _, t in out.dtypes] == ["string"] * 4 + ["bigint", "int"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("block", [2, 32])
def test_against_plain_version(spark, docs, corpus, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "_HELD", 50)
    monkeypatch.setattr(D, "_PIECE", 64)
    rows = [(r["text"], r["lang"], r["source"]) for r in corpus]
    rows += [(None, None, None), ("", "xx", "a"), ("nothing kept", "xx", "b"), ("ÄÖ Äö äÖ   é x1y", "en", None), *[("Zwölf zwölf\x00ZWÖLF", "de", "only here")] * 12]
    assert rows_of(docs([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])) == plain(rows)


def test_ties_and_one_source(docs):
    texts, sources = ["a b c"] * 11 + ["b c d"] * 11, ["x"] * 11 + ["y"] * 11
    assert rows_of(docs(texts, sources=sources)) == plain([(t, "en", s) for t, s in zip(texts, sources, strict=True)])
    assert rows_of(docs(texts)) == plain([(t, "en", "s") for t in texts])
    assert rows_of(docs(["a b", "b c"], sources=["x", "y"]), min_docs=1, top=1) == plain([("a b", "en", "x"), ("b c", "en", "y")], 1, 1)


def test_edges(docs):
    assert rows_of(docs([])) == []
    long = docs([("word " * 3 + "other ") * 400_000] + ["word and other"] * 12, sources=["a"] * 7 + ["b"] * 6)
    assert rows_of(long) == plain([(r["text"], r["lang"], r["source"]) for r in long.collect()])
    clash = docs(["a b c"] * 12, sources=["x"] * 6 + ["y"] * 6)
    assert rows_of(clash.withColumns({c: F.lit(1) for c in ("term", "n", "docs", "a", "b", "m", "part", "item")})) == rows_of(clash)
