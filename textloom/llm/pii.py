"""Personal data by weak supervision (operator 1), in DataFrame and SQL functions only.

Candidate spans come from the base patterns and from wider ones (spelled-out addresses, numbers without a plus
sign, unchecked digit chains). Five labelers vote yes, no or nothing on each: the strict pattern, the number's
plausibility or checksum, its layout, a gazetteer (top-level domains, card issuers, dialling codes, private
networks) and the words before it. Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability per kind; its posteriors are the soft labels of a logistic span classifier over the span's shape and
context, which decides every candidate that is no base span. Base spans always stay.

Scale: one narrow pass counts (kind, votes, features) patterns - a table bounded by its finite alphabet, the only thing
the driver sees - and a second pass scores candidates where they are found. No text is shuffled.

Defined results: a null or empty text has no spans; texts are read whole at any length, each pattern is written so that it
cannot backtrack over a long run, and spans are merged by halving and running maxima, so a text's cost is in proportion
to its length and its spans; repeated rows give equal results; extra columns are ignored by ``report``
and kept by ``redact``; without any candidate the classifier accepts none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import count_below, let, packed, running_max, unpacked

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: Base patterns, possessive where no match can change, so that long runs cost linear time.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider candidates.
WIDE_EMAIL = rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{{1,63}}+(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{{1,63}}+){{1,8}}+"
WIDE_PHONE = r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"
#: A full international number, where the base pattern runs on into digits that follow.
WIDE_DIAL = r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])"
#: Single numbers of card length, which base chains swallow when numbers follow one another.
WIDE_CARD = r"(?<![0-9])(?:[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{13,19})(?![0-9])"
#: Gazetteers and cue words.
TLD = r"(?i).*(?:\.|dot[\])]?\x20)(?:com|org|net|edu|gov|info|biz|io|example|test|eu|uk|us|de|fr|es|it|nl|pl|ch|at|be|ca|mx|ar|br|in|jp|cn)$"
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|64|65|62).*"
DIAL = r"^(?:\+|00)\x20?\(?(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]).*"
PRIVATE = r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|169\.254)\..*"
CUES = {
    "email": r"(?i)(?:e-?mail|mailto|contact|correo|courriel|kontakt|write to|reach)\W{0,3}(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|login|from|addr)\W{0,3}(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment)\W{0,3}(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:\btel|phone|call|fax|mobile|cell|whatsapp|telefon|handy|llam|appel)\w*\W{0,3}(?:\w+\W+){0,2}$",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|build|release|section|chapter|page|serial|sku|\bv)\W{0,3}$"
CONTEXT = 40
VOTERS = ("strict", "plausible", "layout", "gazetteer", "context")
#: Added spans must be this sure; numbers that only look like a card are left alone.
THRESHOLD = 0.9
EM_ROUNDS = 50


#: A match: code-point start, exclusive end, string, and what stands before and after it.
_MATCHES = "array<struct<s:int,e:int,m:string,b:string,a:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches, with up to CONTEXT characters before each, no further back than the match before the last, and the two after it.

    Offsets are running sums of the lengths between and of the matches, taken over blocks of 256 so that a text
    with very many matches costs far less than the square of their number.
    """
    block = 256

    def place(ms: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(F.transform(gaps, F.length), F.lit(1), F.size(ms)), F.transform(ms, F.length), lambda g, n: g + n)

        def total(xs: Column) -> Column:
            return F.aggregate(xs, F.lit(0), lambda a, x: a + x)

        def before(i: Column) -> Column:
            last = F.when(i > 0, F.concat(F.right(F.get(gaps, i - 1), F.lit(CONTEXT)), F.get(ms, i - 1))).otherwise("")
            return F.right(F.concat(last, F.right(F.get(gaps, i), F.lit(CONTEXT))), F.lit(CONTEXT))

        def ends(st: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(st) - 1) / block).cast("int")), lambda b: total(F.slice(st, b * block + 1, F.lit(block))))

            def of(sm: Column) -> Column:
                base = F.transform(F.sequence(F.lit(0), F.size(sm) - 1), lambda b: total(F.slice(sm, F.lit(1), b)))
                return let(
                    base,
                    lambda bs: F.transform(
                        ms,
                        lambda m, i: let(
                            F.get(bs, F.floor(i / block).cast("int")) + total(F.slice(st, F.floor(i / block).cast("int") * block + 1, i % block + 1)),
                            lambda e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m"), before(i).alias("b"), F.left(F.get(gaps, i + 1), F.lit(2)).alias("a")),
                        ),
                    ),
                )

            return let(sums, of)

        return let(steps, ends)

    empty = F.lit([]).cast(_MATCHES)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ms: F.when(F.size(ms) == 0, empty).otherwise(let(F.split(text, pattern, -1), lambda gaps: place(ms, gaps))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(12, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _raw(text: Column) -> dict[str, Column]:
    """Matches of each base pattern, not yet filtered; a cheap test keeps the patterns off texts without their marks."""
    empty = F.lit([]).cast(_MATCHES)
    has = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    return {k: F.when(has[k], matches(text, patterns[k])).otherwise(empty) for k in KINDS}


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0"))


def _described(kind: str, spans: Column, strict: bool) -> Column:
    """Candidates with their votes (one character a labeler) and feature string."""

    def one(x: Column) -> Column:
        m, d = x["m"], F.length(_digits(x["m"]))
        before = x["b"]
        ok = _valid(kind, m)
        strict_vote = _vote(ok, ~ok) if strict else F.lit("0")
        if kind == "email":
            plausible = _vote(~m.rlike(r"@[0-9.-]+$") & (F.length(m) <= 254), m.rlike(r"@[0-9.-]+$"))
            layout, gazetteer = _vote(F.contains(m, F.lit("@")), F.lit(False)), _vote(m.rlike(TLD), F.lit(True))
        elif kind == "ip":
            plausible = _vote(ok, ~ok)
            layout = _vote(~x["a"].rlike(r"^\.[0-9]") & ~m.rlike(r"(?:^|\.)0[0-9]"), F.lit(True))
            gazetteer = _vote(m.rlike(PRIVATE), F.lit(False))
        elif kind == "card":
            good = F.when(d.between(12, 19), luhn(_digits(m))).otherwise(False)
            plausible, gazetteer = _vote(good, ~good), _vote(_digits(m).rlike(ISSUER), F.lit(True))
            layout = _vote(m.rlike(r"^(?:[0-9]{13,16}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$"), ~d.between(12, 19))
        else:
            plausible = _vote(d.between(9, 15), ~d.between(7, 15))
            layout = _vote(m.rlike(r"^(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}$"), F.lit(False))
            gazetteer = _vote(m.rlike(DIAL), F.lit(False))
        context = _vote(before.rlike(CUES[kind]), before.rlike(AGAINST))
        shape = F.concat(
            F.when(d < 4, "a").when(d < 7, "b").when(d < 9, "c").when(d < 12, "d").when(d < 16, "e").when(d < 20, "f").otherwise("g"),
            F.when(m.rlike(r"[()]"), "p").otherwise("-"),
            F.when(m.rlike(r"^\+"), "q").when(m.rlike(r"@"), "r").when(m.rlike(r"[0-9]\.[0-9]"), "s").otherwise("-"),
            F.when(m.rlike(r"[\x20-]"), "t").otherwise("-"),
            F.when(context == "+", "u").when(context == "-", "v").otherwise("-"),
            F.when(gazetteer == "+", "w").otherwise("-"),
            F.when(plausible == "+", "x").otherwise("-"),
        )
        return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.concat(strict_vote, plausible, layout, gazetteer, context).alias("votes"), shape.alias("shape"))

    return F.transform(spans, one)


def annotate(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_base`` (spans (s, k, e), sorted) and ``_cand`` (described candidates); purely row-local."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_raw", F.struct(*[c.alias(k) for k, c in _raw(t).items()]))

    def kept(kind: str) -> Column:
        return _tagged(F.filter(F.col(f"_raw.{kind}"), lambda x: _valid(kind, x["m"])), kind)

    base = F.concat(*[kept(k) for k in KINDS])
    empty = F.lit([]).cast(_MATCHES)
    low = F.lower(t)
    wide_email = F.when(F.contains(t, F.lit("@")) | low.rlike(r"\bat\b.{1,70}\bdot\b"), matches(t, WIDE_EMAIL)).otherwise(empty)
    wide_phone = F.when(t.rlike(r"[0-9][\x20./)-]{1,3}[0-9]{3}"), matches(t, WIDE_PHONE)).otherwise(empty)
    wide_card = F.when(t.rlike(r"[0-9]{4}[\x20-]?[0-9]{4}"), matches(t, WIDE_CARD)).otherwise(empty)
    wide_dial = F.when(F.contains(t, F.lit("+")), matches(t, WIDE_DIAL)).otherwise(empty)
    cand = F.concat(
        *[_described(k, F.col(f"_raw.{k}"), True) for k in KINDS],
        _described("email", wide_email, False),
        _described("card", wide_card, False),
        _described("phone", wide_phone, False),
        _described("phone", wide_dial, False),
    )
    return df.withColumns({"_base": F.sort_array(base), "_cand": cand}).drop("_raw")


@dataclass
class Model:
    """Labeler reliabilities and the span classifier's weights."""

    accuracy: dict[tuple[int, str], float]
    weights: dict[str, float]


def _names(kind: int, shape: str) -> list[str]:
    return [f"{kind}", *[f"{kind}{i}{c}" for i, c in enumerate(shape)]]


def fit(patterns: list[tuple[int, str, str, int]]) -> Model:
    """EM over (kind, votes, shape, count), then a logistic classifier on the posteriors. Plain arithmetic."""
    post: dict[tuple[int, str, str], float] = {}
    accuracy: dict[tuple[int, str], float] = {}
    for kind in range(len(KINDS)):
        rows = [(v, s, n) for k, v, s, n in patterns if k == kind]
        if not rows:
            continue
        prior = 0.5
        rate = [{y: {"+": 0.6 if y else 0.15, "-": 0.1 if y else 0.45, "0": 0.3 if y else 0.4} for y in (1, 0)} for _ in VOTERS]
        gold = {}
        for _ in range(EM_ROUNDS):
            soft = []
            for v, _s, n in rows:
                one, no = math.log(prior), math.log(1 - prior)
                for j, x in enumerate(v):
                    one, no = one + math.log(rate[j][1][x]), no + math.log(rate[j][0][x])
                soft.append(1 / (1 + math.exp(min(60.0, max(-60.0, no - one)))))
            total = sum(n for *_, n in rows)
            yes = sum(p * n for p, (*_, n) in zip(soft, rows, strict=True))
            prior = min(0.99, max(0.01, (yes + 1) / (total + 2)))
            for j in range(len(VOTERS)):
                for y, mass in ((1, yes), (0, total - yes)):
                    for x, pull in (("+", 3.0 if y else 0.5), ("-", 0.5 if y else 3.0), ("0", 1.0)):
                        hit = sum((p if y else 1 - p) * n for p, (v, _s, n) in zip(soft, rows, strict=True) if v[j] == x)
                        rate[j][y][x] = (hit + pull) / (mass + 4.5)
            gold = {(kind, v, s): p for p, (v, s, _n) in zip(soft, rows, strict=True)}
        post |= gold
        for j, name in enumerate(VOTERS):
            right, wrong = prior * rate[j][1]["+"] + (1 - prior) * rate[j][0]["-"], prior * rate[j][1]["-"] + (1 - prior) * rate[j][0]["+"]
            accuracy[kind, name] = right / (right + wrong)
    weights: dict[str, float] = {}
    total = sum(n for *_, n in patterns) or 1
    rows = [(_names(k, s), post[k, v, s], n / total) for k, v, s, n in patterns]
    squares: dict[str, float] = {}
    for _ in range(300):
        grads: dict[str, float] = {}
        for names, p, share in rows:
            z = sum(weights.get(x, 0.0) for x in names)
            g = (1 / (1 + math.exp(min(60.0, max(-60.0, -z)))) - p) * share
            for x in names:
                grads[x] = grads.get(x, 0.0) + g
        for x, g in grads.items():
            g += 1e-4 * weights.get(x, 0.0)
            squares[x] = squares.get(x, 0.0) + g * g
            weights[x] = weights.get(x, 0.0) - 0.5 * g / (math.sqrt(squares[x]) + 1e-9)
    return Model(accuracy, weights)


def train(annotated: DataFrame) -> Model:
    """Count the patterns of all candidates and fit. The result has a few hundred rows at any corpus size."""
    flat = annotated.select(F.explode("_cand").alias("c")).groupBy("c.k", "c.votes", "c.shape").agg(F.count(F.lit(1)).alias("n"))
    return fit(sorted((r["k"], r["votes"], r["shape"], r["n"]) for r in flat.collect()))


def _score(model: Model, c: Column) -> Column:
    if not model.weights:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for kv in sorted(model.weights.items()) for x in kv])

    def weight(name: Column) -> Column:
        return F.coalesce(F.try_element_at(table, name), F.lit(0.0))

    kind = c["k"].cast("string")
    z = weight(kind)
    for i in range(7):
        z = z + weight(F.concat(kind, F.lit(str(i)), F.substring(c["shape"], i + 1, 1)))
    return 1 / (1 + F.exp(-z))


#: Spans that one inner fold takes; only a block's own array grows by one span at a time.
_FOLD = 128


def _apart(xs: Column) -> Column:
    """Of spans sorted by start, each one that begins at or after the end of the last one taken: a fold in blocks."""
    kind = "struct<s:int,k:int,e:int>"

    def state(end: Column, found: Column) -> Column:
        return F.struct(end.cast("int").alias("end"), found.alias("found"))

    def take(acc: Column, x: Column) -> Column:
        return F.when(x["s"] >= acc["end"], state(x["e"], F.array_append(acc["found"], x))).otherwise(acc)

    def block(acc: Column, b: Column) -> Column:
        inner = F.aggregate(F.slice(xs, b * _FOLD + 1, F.lit(_FOLD)), state(acc["end"], F.array().cast(f"array<{kind}>")), take)
        return let(inner, lambda i: state(i["end"], F.array_append(acc["found"], i["found"])))

    blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _FOLD).cast("int"))
    return F.flatten(F.aggregate(blocks, state(F.lit(-1), F.array().cast(f"array<array<{kind}>>")), block, lambda a: a["found"]))


def all_spans(model: Model, base: Column, cand: Column) -> Column:
    """Base spans and accepted candidates that touch neither a base span nor an earlier accepted one; sorted.

    ``base`` is sorted; the base spans that begin before a candidate's end are counted by halving, and the furthest end of
    those tells whether one reaches into it.
    """

    def free(xs: Column) -> Column:
        starts, ends = F.transform(base, lambda b: b["s"]), running_max(F.transform(base, lambda b: b["e"]))

        def touched(st: Column, en: Column) -> Column:
            return F.filter(xs, lambda c: let(count_below(st, c["e"]), lambda n: (n == 0) | (F.get(en, n - 1) <= c["s"])))

        return F.when(F.size(base) == 0, xs).otherwise(let(starts, lambda st: let(ends, lambda en: touched(st, en))))

    def apart(xs: Column) -> Column:
        once = F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1) != x))
        return let(once, _apart)

    taken = F.sort_array(F.transform(F.filter(cand, lambda c: _score(model, c) >= THRESHOLD), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    added = let(taken, lambda xs: F.when(F.size(xs) == 0, xs).otherwise(let(free(xs), apart)))
    return F.sort_array(F.concat(base, added))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (s, k, e), kind by its place in KINDS. Reads ``df`` twice."""
    marked = annotate(df, text)
    model = train(marked)
    return marked.withColumns({"base": F.col("_base"), "spans": all_spans(model, F.col("_base"), F.col("_cand"))}).drop("_base", "_cand")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans."""
    found = detect(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = [count(i) for i in range(len(KINDS))]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


#: Characters of a text that are searched for a place at once.
_BLOCK = 1 << 16


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to before ``end`` of a text in blocks; a place in a long string costs its distance from the start."""
    first, last = F.floor(start / _BLOCK).cast("int"), F.floor(end / _BLOCK).cast("int")
    one = F.substring(F.get(blocks, first), start % _BLOCK + 1, end - start)
    more = F.concat(F.substring(F.get(blocks, first), start % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(blocks, last), F.lit(1), end % _BLOCK))
    return F.when(first == last, one).otherwise(more)


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _BLOCK).cast("int")), lambda b: F.substring(text, b * _BLOCK + 1, F.lit(_BLOCK)))

    def join(bs: Column, ends: Column) -> Column:
        upto = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
        heads = F.filter(F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), x["k"].alias("k"), upto(i).alias("at"))), lambda x: x["s"] >= x["at"])
        parts = F.transform(heads, lambda x: F.concat(_cut(bs, x["at"], x["s"]), F.get(names, x["k"])))
        return F.concat(F.array_join(parts, ""), _cut(bs, F.element_at(ends, -1), F.length(text)))

    ends = running_max(F.transform(spans, lambda x: x["e"]))
    return F.when(F.size(spans) > 0, let(blocks, lambda bs: let(ends, lambda en: join(bs, en)))).otherwise(text)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of the text replaced by its kind in brackets; all columns stay, n_chars is renewed."""
    found = detect(packed(df, text=text))
    found = found.withColumn("_masked", masked(F.col("text"), F.col("spans")))
    changed = {text: F.col("_masked")}
    if "n_chars" in df.columns and text != "n_chars":
        changed["n_chars"] = F.length("_masked").cast(df.schema["n_chars"].dataType)
    return unpacked(found, df.columns, **changed)
