from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe, fragments, token_files

HARD = [
    None,
    "",
    " ",
    "\n\n y",
    "x\n\ny  z\t\t.a",
    "it's we're 'sy !'s |'s x'Sx I'M",
    "à theà  é. î, æ. œ. …,  à à 　b",
    "<|endoftext|> a<|endoftext|>, b.<|endoftext|>",
    "é😀 日本語 テスト。カタ, Привет мир. ΑΣ ΣΑΣ, İstanbul, KELVIN K.",
    "é, ä. ñ ́x ,̸ ≠",
    "\x1c\x1d a\x85b c﻿",
    "3.14,15 a.b,c ... ,,, word,word.word",
    "a" * 3000,
    "ab " * 20000,
    "ÀÉÎ ÖØ× ÷ ÿ.",
]


def noise(rng, n):
    alphabet = "aeth INGà.,'! \n\t é|<>_-19　ñß\"…®"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fragments_equal_the_library(corpus, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(str(path))
    coder = fragments.FragmentCodes(str(path))
    for t in HARD + noise(random.Random(3), 3000) + [r["text"] for r in corpus]:
        assert np.frombuffer(coder.encode(t), np.uint32).tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)[:200]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_beside_symbols_and_line_ends_equal_the_library(name):
    coder, draw = fragments.FragmentCodes(str(public_tokenizers.path(name))), random.Random(3)
    parts = ["Word", "été", "à", "é", "don't", " ", "  ", "\n", "\n\n", "\u00a0", ".", ",", "!", "$$$", "#", "%", "&&", "*", "'", "3", "я", "\u0300"]
    for _ in range(5000):
        text = "".join(draw.choices(parts, k=draw.randint(1, 9)))
        assert np.frombuffer(coder.encode(text), np.uint32).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(fragments, "CACHE_BYTES", 10 * (fragments.ENTRY_BYTES + 10))
    coder = fragments.FragmentCodes(str(public_tokenizers.path("byte_bpe_50k.json")))
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t = "one two three four five six seven eight nine one two"
    for text in (t, t, t + " x" * 200, t):
        assert np.frombuffer(coder.encode(text), np.uint32).tolist() == library.encode(text).ids and len(coder) + len(coder.old) <= 12
    fragments.codes(str(public_tokenizers.path("byte_bpe_50k.json")))
    fragments.release()
    assert not fragments.codes.cache_info().currsize


def test_op6_digests(spark, docs, corpus):
    texts = HARD + [r["text"] for r in corpus[:60]]
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    rows = {r["doc_id"]: r for r in bpe.report(docs(texts), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    wide = bpe.decode(bpe.encode(docs(texts), path), path)
    assert wide.columns == [*docs([]).columns, "ids", "decoded"]
    assert {r["doc_id"]: r["decoded"] for r in wide.collect()} == {i: t or "" for i, t in enumerate(texts)}
    broken = spark.createDataFrame([(1, [50256, 447, 220]), (2, None)], "doc_id int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(broken, path).orderBy("doc_id").collect()] == [library.decode([50256, 447, 220], skip_special_tokens=False), ""]


def test_packed_codes():
    rng = np.random.default_rng(1)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], rng.integers(0, 50000, 5000), rng.integers(0, 300, 3000), np.full(600, 256)):
        ids = np.array(ids, np.uint32)
        packed = token_files.Packed(token_files.pack(ids))
        assert packed.all().tolist() == ids.tolist() and len(packed) == len(ids)
        assert [packed.at(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()


def test_op5(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 2000)
    texts = HARD + [r["text"] for r in corpus]
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    rows = sorted(token_files.report(docs(texts).repartition(7), path).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.report(docs([]), path).count() == 0
    folder = token_files.stored_path(spark, "test-tokens")
    token_files.write(docs(texts).repartition(5), folder, path, end_id=2)
    every = [i for t in texts for i in [*library.encode(t or "", add_special_tokens=False).ids, 2]]
    wanted = [*range(0, len(every), 97), len(every) - 1]
    places = spark.createDataFrame([(p,) for p in [*wanted, wanted[3], len(every), -1]], "place long")
    assert sorted(map(tuple, token_files.lookup(places, folder).collect())) == [(p, every[p]) for p in wanted]
    found = token_files.index(spark, folder).collect()
    assert sum(r["n_ids"] for r in found) == len(every) and sum(r["docs"] for r in found) == len(texts)
    assert all(r["last_id"] == 2 for r in rows)
    df = docs(["a", "b"])
    assert token_files.report(df.union(df), path).count() == 4
