from __future__ import annotations

import random
import re

import pytest

from textloom.operators import chunking as C

TOK = C.Tokenizer()


def texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    out = ["", "  ", "one", "one two three.", "x" * 700, " ".join(rng.choice(words) for _ in range(513))]
    for _ in range(15):
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + rng.choice(".!?") for _ in range(rng.randint(1, 40))]
        out.append(rng.choice(["\n\n", "\n", " "]).join(sentences))
    return out


def test_tokens_join_to_the_text():
    for t in texts():
        assert "".join(TOK.split(t)) == t.rstrip()


def test_recursive_covers_and_bounds():
    for t in texts():
        pieces = list(C.split_pieces(t, 64, TOK)) if t else []
        assert "".join(pieces) == t and all(TOK.count(p) <= 64 for p in pieces)
        chunks = C.recursive_chunks(t, 64, 8)
        assert bool(chunks) == bool(t.strip())
        assert all(c["token_count"] <= 64 + 8 for c in chunks)
        assert [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
        words = t.split()
        for c in chunks:
            if max(map(len, words), default=0) < 60:
                assert words[c["start_token"] : c["end_token"]] == c["text"].split()


def test_recursive_overlap_is_the_tail_of_the_last_chunk():
    t = " ".join(f"t{i}" for i in range(300))
    a, b, *_ = C.recursive_chunks(t, 100, 10)
    assert a["text"].split()[-10:] == b["text"].split()[:10]


def test_fixed_matches_a_plain_model(spark):
    cases = [(i, " ".join(f"t{k}" for k in range(n))) for i, n in enumerate((0, 1, 50, 511, 512, 513, 924, 974, 975, 1436, 2000))]
    rows = C.chunk_fixed(spark.createDataFrame(cases, "doc_id int, text string")).collect()
    for i, t in cases:
        m = len(t.split())
        starts = [s for s in range(0, m, 462) if s == 0 or s - 462 + 512 < m]
        got = sorted((r["start_token"], r["end_token"], r["text"]) for r in rows if r["doc_id"] == i)
        assert got == [(s, min(s + 512, m), " ".join(t.split()[s : s + 512])) for s in starts]


def test_semantic_rules():
    one = C.semantic_chunks("just one sentence without an end")
    assert len(one) == 1 and one[0]["overlap_prefix_tokens"] is None
    assert len(C.semantic_chunks("word " * 600)) == 2
    two = C.semantic_chunks("Alpha beta gamma. Delta epsilon zeta.", least=1)
    assert len(two) == 1  # one similarity has no deviation, so there is no break
    text = " ".join(f"Topic {k // 20} word{k // 20} again{k // 20} item." for k in range(120))
    for c in C.semantic_chunks(text, size=100, overlap=10, least=30):
        assert c["token_count"] <= 100 + 10
    body = " ".join(c["text"] for c in C.semantic_chunks(text, size=100, overlap=0, least=30))
    assert body.split() == text.split()


def test_breakpoints_are_strict():
    assert C.breakpoints([[1.0, 0.0], [1.0, 0.0]]) == [False]
    assert C.breakpoints([[1, 0], [1, 0], [0, 1], [0, 1], [0, 1], [0, 1]]) == [False, True, False, False, False]
    assert C.breakpoints([]) == []


def test_strategies(spark):
    df = spark.createDataFrame([(1, "One. Two. Three."), (2, None)], "doc_id int, text string")
    for s in ("fixed", "recursive", "semantic"):
        assert {r["doc_id"] for r in C.chunk_with(df, s).collect()} == {1}
    with pytest.raises(ValueError):
        C.chunk_with(df, "unknown")
    with pytest.raises(ValueError):
        C.chunk_fixed(df, size=10, overlap=10)
    assert C.pick_strategy(100, "fixed") == "recursive" and C.pick_strategy(5) == "semantic"


def test_text_without_separators_is_cut_between_tokens():
    tok = C.Tokenizer(re.compile(r"\S{3}|\S+"))
    text = "abcdefghij" * 5
    pieces = list(C.split_pieces(text, 4, tok))
    assert "".join(pieces) == text and [len(p) for p in pieces] == [12, 12, 12, 12, 2]
    assert all(tok.count(p) <= 4 for p in pieces)
