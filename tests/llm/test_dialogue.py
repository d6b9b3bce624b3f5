from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import dialogue as D

SCHEMA = "conv_id long, turn long, role string, text string"
SHAPE = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        yield from [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)


def kinds_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        last = text.rstrip(BLANKS)
        out.append(D.BLANK if not last else D.DUPLICATE if (role, text) in seen else D.TRUNCATED if last[-1] not in ".!?" else D.SOUND)
        seen.add((role, text))
    return out


def search(kinds, initials, most):
    """(cost, letters, roles) by trying every string of edits with up to ``most`` insertions."""
    best = None
    slots = len(kinds) + 1
    choices = [["D"] if k in (D.BLANK, D.DUPLICATE) else ["D", "K", "Ru", "Ra"] for k in kinds]
    for n in range(most + 1):
        for where in itertools.combinations_with_replacement(range(slots), n):
            for what in itertools.product("ua", repeat=n):
                for edits in itertools.product(*choices):
                    letters, shape, cost, roles = "", "", 2 * n, []
                    for at in range(slots):
                        for w, x in zip(where, what, strict=True):
                            if w == at:
                                letters, shape, roles = letters + "I", shape + x, [*roles, x]
                        if at < len(kinds):
                            e = edits[at]
                            letters += e[0]
                            cost += {"D": 3, "K": 0, "R": 2}[e[0]] + (e != "D" and kinds[at] == D.TRUNCATED)
                            got = "" if e == "D" else initials[at] if e == "K" else e[1]
                            shape += got if e == "D" or got else "?"
                            roles.append(e)
                    if SHAPE.fullmatch(shape) and (best is None or (cost, letters) < best[:2]):
                        best = (cost, letters, roles)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_walk_is_the_least_of_the_cheapest(seed):
    rng = random.Random(seed)
    for _ in range(12):
        n = rng.randrange(0, 5)
        kinds, initials = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)], [rng.choice(["s", "u", "a", "u", "a", "t", ""]) for _ in range(n)]
        cost, letters, _ = search(kinds, initials, 3)
        [(state, got, given)] = D.walk(kinds, initials, D.to_go(kinds, initials, D.LAST), [0])
        assert got + "I" * len(D.finish(state)) == letters
        assert D.through(D.passage(kinds, initials), D.LAST)[0] == cost and len(given) == len(got)


def plain(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for conv, turn, role, text in damage(rows):
        convs[conv].append((turn, role, text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        kinds, initials = kinds_of(turns), [t[1][:1] for t in turns]
        numbers = [t[0] for t in turns if t[0] is not None]
        # costs to go by plain recursion over (turn, state), the walk by letters in order
        n, inf = len(turns), 10**9
        go = [[inf] * 4 for _ in range(n + 1)]
        forced = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
        kept = lambda q, x: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, x))

        def steps(i, q, go=go, kinds=kinds, initials=initials, n=n, forced=forced, kept=kept):
            to, role = forced[q]
            if i < n:
                yield "D", 3, i + 1, q, None
            yield "I", 2, i, to, role
            if i < n and kinds[i] in (D.SOUND, D.TRUNCATED):
                extra = kinds[i] == D.TRUNCATED
                if (k := kept(q, initials[i])) is not None:
                    yield "K", extra, i + 1, k, None
                yield "R", 2 + extra, i + 1, to, role

        for i in range(n, -1, -1):
            if i == n:
                go[i][0] = go[i][3] = 0
            for _ in range(6):
                for q in range(4):
                    go[i][q] = min([go[i][q], *(c + go[j][r] for _, c, j, r, _ in steps(i, q))])
        i, q, letters, lines = 0, 0, "", []
        while not (i == n and q in (0, 3)):
            letter, _, j, r, role = next(s for s in steps(i, q) if s[1] + go[s[2]][s[3]] == go[i][q])
            letters += letter
            if letter == "I":
                lines.append(f"{role}:")
            elif letter != "D":
                lines.append(f"{role or turns[i][1]}:{turns[i][2]}")
            i, q = j, r
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, kinds.count(1), kinds.count(2), kinds.count(3), illegal, go[0][0], letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(spark, df, **sizes):
    out = D.report(df, **sizes)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = out.collect()
    found = {r[0]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert made(spark, df) == want
    assert made(spark, df, partition_turns=40, segment_turns=2) == want


@pytest.mark.parametrize("sizes", [{}, {"partition_turns": 150, "segment_turns": 3}, {"partition_turns": 90, "segment_turns": 1, "segment_chars": 5}])
def test_odd_rows_and_a_hot_conversation(spark, sizes):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "open end", "", " \n", None, "ends. \t", "é", "x" * 300 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "umpire", "a"]
    rows = [(rng.choice([7, 7, 7, None, 1, 2, 3]), rng.choice([None, *range(-3, 40)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    rows += [(9, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(200)] + [(11, 3, None, None)]
    rows += [(c, 0, "user", "alone.") for c in range(100, 160)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in want.values())
    assert made(spark, df, **sizes) == want
    clash = df.withColumns({c: F.lit(1) for c in ("conv", "kind", "place", "part", "segment", "digest", "dropped")})
    assert made(spark, clash, **sizes) == want


def test_edges(spark):
    assert made(spark, spark.createDataFrame([], SCHEMA)) == {}
    rows = [(1, 0, "user", "a long text " * 200_000), (1, 1, "assistant", "b" * 2_000_000 + "."), (2, 5, "user", "x.")]
    assert made(spark, spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    out = D.repair(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "So?")], SCHEMA)).collect()
    assert [(r["audit"], r["repaired"], r["state"]) for r in out] == [("KDR", "user:Hi.\nassistant:So?\n", 3)]


def test_composition_is_the_whole_pass():
    rng = random.Random(3)
    kinds, initials = [rng.choice([0, 1, 2, 3]) for _ in range(40)], [rng.choice("suat") for _ in range(40)]
    whole = D.through(D.passage(kinds, initials), D.LAST)
    for cut in (0, 1, 17, 40):
        behind = D.through(D.passage(kinds[cut:], initials[cut:]), D.LAST)
        assert D.through(D.passage(kinds[:cut], initials[:cut]), behind) == whole
