"""Source divergence audit by joint count histograms (operator 12).

How far the term distributions of two sources of a language lie apart is a sum over all kept terms of a function f of two
smoothed probabilities, and a probability depends on the term's count alone. So for each pair of sources the distinct
combinations of two counts are tallied, those with a count of zero from the sources' own histograms, and f is evaluated once
a combination and multiplied by how many terms have it. All arithmetic is on whole numbers.

Scale: documents are read once; terms are counted in each task before they are shuffled, in maps that are emptied when they
are full. A term's counts in a language's sources lie in rows of ``BLOCK`` sources; two rows of a term meet in a join, and
the pairs of counts in them are added up where they arise, so a shuffled row stands for all terms of a task with the same
combination. A hot source or language is as many rows as it has distinct terms. Pairs of sources are dealt by source, as
the result has a row for each of them. The best terms of a source are cut before the shuffle (a window with a limit).

Defined results: null text, lang and source are ''; a text without terms still makes its source occur; a language without
kept terms has pairs of value 0 and no terms; a language with one source has no pairs; repeated rows count each; texts are read whole;
ids and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialise, sized
from textloom.llm.fragments import release

#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 10
#: Ranks of a source's own terms.
TOP = 10
UNIT = 1_000_000_000
#: Sources in a row of a term's counts, and slices that the sources are dealt in to be paired.
BLOCK = 32
SLICES = 64
#: Entries of a task's maps before they are emptied.
_HELD = 300_000
#: Bytes of a text that are split at once.
_PIECE = 1 << 22
#: ASCII other than letters ends a term, A-Z become lower case, the bytes of other characters stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: str) -> Iterator[list[bytes]]:
    data, at = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES), 0
    while len(data) - at > _PIECE and (cut := data.find(b" ", at + _PIECE)) >= 0:
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, its occurrences, its documents); a row with a null term for each lang and source."""
    release()
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            n, own = len(found) + 1, docs[lang, source]
            terms = [None, *(t.decode("utf-8", "surrogatepass") for t in found)]
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.string()), pa.array([0, *found.values()], pa.int64()), pa.array([0, *(own[t] for t in found)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            mine, different = counts[lang, source], set()
            for terms in _terms(text.as_py()):
                mine.update(terms)
                different.update(terms)
            docs[lang, source].update(different)
        if sum(map(len, counts.values())) > _HELD:
            yield from emptied()
    yield from emptied()


def probability(n: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a term with n of ``total`` occurrences, in units, as a long."""
    over = F.lit(UNIT).cast("decimal(20,0)") * (n.cast("decimal(18,0)") + F.lit(2).cast("decimal(18,0)"))
    return F.lit(1).cast("long") + F.call_function("div", over, (total + 2 * kept).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pairs(groups: DataFrame) -> DataFrame:
    """(lang, a, b): the numbers of every two sources of a language, the smaller first, dealt by the first."""
    left = groups.select("lang", F.col("source_no").alias("a"), F.pmod("source_no", F.lit(SLICES)).alias("slice"))
    right = groups.select("lang", F.col("source_no").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    return left.join(right, ["lang", "slice"]).filter("a < b").select("lang", "a", "b")


def _met(cells: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, m): how many terms occur x > 0 times in source a and y > 0 times in source b."""
    rows = cells.groupBy("lang", "term", F.floor(F.col("source_no") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("source_no", "n"))).alias("held"))  # BLOCK entries at most
    first, second = rows.toDF("lang", "term", "i", "u"), rows.toDF("lang", "term", "j", "v")
    both = first.join(second, ["lang", "term"]).filter("i <= j")

    def pair(x: Column, y: Column) -> Column:
        return F.struct(x["source_no"].alias("a"), y["source_no"].alias("b"), x["n"].alias("x"), y["n"].alias("y"))

    each = F.flatten(F.transform("u", lambda x: F.transform(F.filter("v", lambda y: y["source_no"] > x["source_no"]), lambda y: pair(x, y))))
    return both.select("lang", F.explode(each).alias("c")).groupBy("lang", "c.a", "c.b", "c.x", "c.y").agg(F.count(F.lit(1)).alias("m"))


def joint(cells: DataFrame, pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, m): the joint histogram of every pair of sources, cells with zero counts included.

    A pair's terms that only one source has are those of the source's own histogram less those that both have; terms
    that neither has are all kept terms less the rest.
    """
    met, none = _met(cells), F.lit(0).cast("long")
    own = cells.groupBy("lang", "source_no", "n").agg(F.count(F.lit(1)).alias("h"))
    cell = lambda x, y, m: F.struct(x.alias("x"), y.alias("y"), m.cast("long").alias("m"))

    def spread(df: DataFrame, *found: Column) -> DataFrame:
        return df.select("lang", "a", "b", F.explode(F.array(*found)).alias("c")).select("lang", "a", "b", "c.*")

    x, y, m, n, h = map(F.col, ("x", "y", "m", "n", "h"))
    parts = [
        spread(met, cell(x, y, m), cell(x, none, -m), cell(none, y, -m), cell(none, none, m)),
        spread(pairs.join(own.withColumnRenamed("source_no", "a"), ["lang", "a"]), cell(n, none, h), cell(none, none, -h)),
        spread(pairs.join(own.withColumnRenamed("source_no", "b"), ["lang", "b"]), cell(none, n, h), cell(none, none, -h)),
        pairs.join(kept, "lang", "left").select("lang", "a", "b", none.alias("x"), none.alias("y"), F.coalesce("kept", none).alias("m")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Part ``pair``: how far each other source of the language lies; part ``term``: terms that a source has more of."""
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = rows.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    counts = materialise(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    terms = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    numbered = counts.filter(F.col("term").isNull()).select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("source_no"))
    groups = sized(materialise(numbered, "divergence-sources"))
    cells = materialise(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]).join(groups, ["lang", "source"]), "divergence-cells")

    own = cells.groupBy("lang", "source_no").agg(F.sum("n").alias("total"))
    kept = materialise(cells.select("lang", "term", "all").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("lang_total")), "divergence-languages")
    kept = sized(kept)
    sizes = groups.join(own, ["lang", "source_no"], "left").join(kept, "lang", "left").select("lang", "source", "source_no", F.coalesce("total", F.lit(0).cast("long")).alias("total"), "kept", "lang_total")
    sizes = sized(materialise(sizes, "divergence-sizes"))

    p, q = probability(F.col("n"), F.col("total"), F.col("kept")), probability(F.col("all"), F.col("lang_total"), F.col("kept"))
    more = cells.drop("source").join(sizes, ["lang", "source_no"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own_terms = more.select("lang", "source", F.lit("term").alias("part"), "item", apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    side = lambda no, name, total: sizes.select("lang", F.col("source_no").alias(no), F.col("source").alias(name), F.col("total").alias(total), *(["kept"] if no == "a" else []))
    tallied = joint(cells, _pairs(groups), kept.select("lang", "kept")).filter("m > 0 or (x = 0 and y = 0)")
    tallied = tallied.join(side("a", "source_a", "total_a"), ["lang", "a"]).join(side("b", "source_b", "total_b"), ["lang", "b"])
    f = F.when(F.col("m") == 0, 0).otherwise(F.col("m") * apart(probability(F.col("x"), F.col("total_a"), F.col("kept")), probability(F.col("y"), F.col("total_b"), F.col("kept"))))
    values = tallied.groupBy("lang", "source_a", "source_b").agg(F.sum(f).alias("value"))
    way = lambda u, v: F.struct(F.col(u).alias("source"), F.col(v).alias("item"))
    ways = values.select("lang", F.explode(F.array(way("source_a", "source_b"), way("source_b", "source_a"))).alias("w"), "value")
    pairs = ways.select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(own_terms)
