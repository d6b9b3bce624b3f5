"""SimHash fingerprints, edited-text comparison and a permuted-table radius search (operator 10), DataFrame functions only.

Terms are the ASCII-lower-cased words of a text; each occurrence votes with the square of its length (12 at most),
so function words weigh little. Bit j of the 64-bit fingerprint is set when the weight of the terms whose hash has
bit j exceeds half of all weight. Counts of two bits share one long (32-bit lanes), so 32 sums make a fingerprint.

The next document in id order is found without a global sort: ids are cut at quantiles (``RANGES`` at most, from one
mergeable summary), ranges into even buckets of about ``BUCKET_ROWS``, rows are dealt by bucket once, and everything else
(window, vote sums, comparison) stays in that stage. Where ids are so uneven that a bucket has more than ``SPLIT_OVER``
times as many rows, it is cut again at its own quantiles, level by level. An id that holds a range or more by itself, or
rows without an id, are cut by the hash of the text that orders them. Only the first row of each bucket travels to the
bucket before it; the order of buckets is found level by level.

The radius search cuts a fingerprint into six blocks and keeps one table for each choice of three blocks: two
fingerprints within three bits agree on at least three blocks, so they meet in a table. Equal fingerprints are one
row with a count, and a pair is reported by the first table it meets in. The report lists the fingerprints found.

Defined results: null and empty texts have the fingerprint 0 and likeness 1 to each other; the last document's
next is the first, a single document is its own next; rows without an id come first, and rows with equal ids are
ordered by a hash of the text; a text may have 2^32 / MAX_LENGTH^2 words (29 million, at least 60 MB) before the counts
of two bits could run into each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_ROWS, count_below, let, lower_ascii, materialise, words

BUCKET_ROWS = 128
#: Quantiles of the ids that the driver sees, and buckets that a range can have.
RANGES = 4096
FINE = 1 << 20
#: A bucket of more than SPLIT_OVER * BUCKET_ROWS rows is cut into at most PIECES, at most LEVELS times.
SPLIT_OVER, PIECES, LEVELS = 3, 64, 4
#: Bits of a bucket's number for each of those cuts.
_PIECE_BITS = 7
#: Buckets in a group of buckets whose order one window task finds.
FAN = 4096
RADIUS = 3
#: (first bit, bits) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
MAX_LENGTH = 12
_LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    """(hash, weight) of each word of the text."""
    return F.transform(
        words(lower_ascii(text)),
        lambda w: F.struct(F.xxhash64(w).alias("h"), (F.least(F.length(w), F.lit(MAX_LENGTH)) * F.least(F.length(w), F.lit(MAX_LENGTH))).cast("long").alias("w")),
    )


def _votes(df: DataFrame, keys: list[str], text_terms: Column) -> DataFrame:
    """Fingerprint ``fp`` (long) per ``keys``; rows of a key are together already or are combined before they travel."""
    flat = df.select(*keys, F.explode_outer(text_terms).alias("_t"))
    h, w = F.coalesce(F.col("_t.h"), F.lit(0).cast("long")), F.coalesce(F.col("_t.w"), F.lit(0).cast("long"))
    sums = [F.sum(F.shiftright(h, j).bitwiseAND(F.lit(_LANES)) * w).alias(f"_v{j}") for j in range(32)]
    voted = flat.groupBy(*keys).agg(F.sum(w).alias("_all"), *sums)
    fp = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"_v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"_v{j}"), 32)
        for bit, lane in ((j, low), (j + 32, high)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            fp = fp.bitwiseOR(F.when(2 * lane > F.col("_all"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return voted.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row: the general interface without neighbours; repeated rows give repeated rows."""
    keyed = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_row"))
    return _votes(keyed, ["doc_id", "_row"], terms(F.col("text"))).drop("_row")


def _next_bucket(buckets: DataFrame) -> DataFrame:
    """(bucket, next_bucket): the following bucket that has rows; the last is followed by the first."""
    grouped = buckets.distinct().withColumn("_group", F.expr(f"bucket div {FAN << LEVELS * _PIECE_BITS}"))
    inside = grouped.withColumn("_in", F.lead("bucket").over(Window.partitionBy("_group").orderBy("bucket")))
    tops = grouped.groupBy("_group").agg(F.min("bucket").alias("_first"))
    order = Window.orderBy("_group")  # one row for each FAN x BUCKET_ROWS documents
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("_group", F.coalesce(F.lead("_first").over(order), F.min("_first").over(whole)).alias("_after"))
    return inside.join(tops, "_group").select("bucket", F.coalesce("_in", "_after").alias("next_bucket"))


def _even_buckets(rows: DataFrame) -> Column:
    """The bucket of (doc_id, tie), ascending with it: quantile range first, then an even part of the range."""
    n, missing = rows.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(1, min(RANGES, n // BUCKET_ROWS))
    marks = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(ranges + 1)], 20 * RANGES)).first()[0] or [0]
    parts = min(FINE - 1, -(-n // (ranges * BUCKET_ROWS)))

    def by_tie(count: Column) -> Column:
        """Ties are spread evenly over all longs."""
        return F.least(count - 1, F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * count))

    bounds = F.array(*[F.lit(m).cast("long") for m in marks])
    times = F.array(*[F.lit(marks.count(m)).cast("long") for m in marks])
    # places of the range's lower bound and of the bound after it; an id below all bounds joins the first range
    low = F.greatest(count_below(bounds, F.col("doc_id") + 1) - 1, F.lit(0))

    def part(k: Column) -> Column:
        start, end = F.get(bounds, k).cast("double"), F.coalesce(F.get(bounds, k + 1), F.get(bounds, k)).cast("double")
        even = F.floor((F.col("doc_id") - start) / F.greatest(end - start, F.lit(1.0)) * (parts - 1)) + 1
        heavy = (F.col("doc_id") == F.get(bounds, k)) & (F.get(times, k) > 1)
        # the bound itself comes before the ids above it; one that repeats is cut by tie
        inside = F.when(heavy, by_tie(F.least(F.get(times, k) * parts, F.lit(FINE // 2))) - FINE // 2).when(F.col("doc_id") <= start, F.lit(0)).otherwise(F.least(F.greatest(even, F.lit(0)), F.lit(parts)))
        return (k.cast("long") + 1) * (2 * FINE) + FINE + inside.cast("long")

    none = by_tie(F.lit(max(1, min(missing // BUCKET_ROWS, 2**33))).cast("long")) - F.lit(2**34)
    return F.when(F.col("doc_id").isNull(), none).otherwise(let(low, part))


def _cut(rows: DataFrame, cuts: DataFrame, level: int) -> DataFrame:
    """``rows`` (with doc_id, tie, bucket) with the buckets that ``cuts`` (bucket, by_tie, marks) names in pieces.

    A piece reaches from behind a mark to the next one; a value that holds several marks is a piece by itself.
    """
    value = F.when(F.col("by_tie"), F.col("tie")).otherwise(F.col("doc_id"))
    piece = let(count_below(F.col("marks"), value), lambda k: 2 * k + F.coalesce(F.get(F.col("marks"), k + 1) == value, F.lit(False)).cast("int"))
    shifted = F.shiftleft(F.coalesce(piece, F.lit(0)).cast("long"), (LEVELS - 1 - level) * _PIECE_BITS)
    return rows.join(cuts, "bucket", "left").withColumn("bucket", F.col("bucket") + F.when(F.col("marks").isNull(), F.lit(0).cast("long")).otherwise(shifted)).drop("by_tie", "marks")


def bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, tie and more) with ``bucket``, which ascends with (doc_id, tie).

    Buckets that hold too many rows are cut at their own quantiles: of the ids, or of the ties where all ids are one. Only
    rows that are equal in both stay together in any number. Where ids are spread evenly enough nothing is joined.
    """
    base = F.shiftleft(_even_buckets(rows), LEVELS * _PIECE_BITS)
    rows = rows.withColumn("bucket", base)
    quantiles = [i / PIECES for i in range(1, PIECES)]
    for level in range(LEVELS):
        keyed = rows.select("doc_id", "tie", "bucket")
        ends = [f("doc_id").alias(f"{name}_id") for name, f in (("low", F.min), ("high", F.max))] + [f("tie").alias(f"{name}_tie") for name, f in (("low", F.min), ("high", F.max))]
        found = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *ends).filter(F.col("n") > SPLIT_OVER * BUCKET_ROWS)
        one_id = F.col("low_id").eqNullSafe(F.col("high_id"))
        heavy = materialise(found.filter(~one_id | (F.col("low_tie") < F.col("high_tie"))).select("bucket", "n", one_id.alias("by_tie")), "heavy")
        many = heavy.count()
        if not many:
            break
        few = many <= BROADCAST_ROWS // PIECES  # one row of PIECES longs each
        value = F.when(F.col("by_tie"), F.col("tie")).otherwise(F.col("doc_id"))
        marked = keyed.join(F.broadcast(heavy) if few else heavy, "bucket").groupBy("bucket", "by_tie", "n").agg(F.percentile_approx(value, quantiles, 20 * PIECES).alias("marks"))
        # as many pieces as give BUCKET_ROWS rows each
        wanted = F.least(F.lit(PIECES), F.ceil(F.col("n") / BUCKET_ROWS))
        first = lambda i: F.floor((i + 1) * wanted / PIECES) > F.floor(i * wanted / PIECES)
        cuts = materialise(marked.select("bucket", "by_tie", F.filter("marks", lambda _, i: first(i)).alias("marks")), "cuts")
        rows = _cut(rows, F.broadcast(cuts) if few else cuts, level)
    return rows


def compare(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_chars, edited_sha256, fp, edited_fp (longs) and next_fp."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = bucketed(rows.select("doc_id", "text", F.xxhash64("text").alias("tie")))
    order = Window.partitionBy("bucket").orderBy("doc_id", "tie")
    seen = rows.withColumns({"_rank": F.row_number().over(order), "_next": F.lead("text").over(order)})
    firsts = seen.filter(F.col("_rank") == 1).select(F.col("bucket").alias("next_bucket"), F.col("text").alias("first_text"))
    firsts = firsts.join(_next_bucket(rows.select("bucket")), "next_bucket").select("bucket", "first_text")
    firsts = _votes(firsts, ["bucket", "first_text"], terms(F.col("first_text"))).withColumnRenamed("fp", "first_fp")
    # dealt by bucket like the rows themselves: first rows hold whole texts and grow with the table, so they are not broadcast
    seen = seen.join(firsts.hint("merge"), "bucket", "left").withColumn("_next", F.coalesce("_next", "first_text"))
    size = F.length("text")
    half = F.expr("length(text) div 2").cast("int")
    seen = seen.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("_next"), F.lit(1), half)))
    texts = F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("text")), F.struct(F.lit(1).alias("part"), F.col("edited").alias("text")))
    keys = ["bucket", "doc_id", "tie", "_rank", "n_chars", "edited_sha256", "first_fp"]
    parts = seen.select("bucket", "doc_id", "tie", "_rank", size.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "first_fp", F.explode(texts).alias("_p"))
    voted = _votes(parts.select(*keys, F.col("_p.part").alias("part"), F.col("_p.text").alias("ptext")), [*keys, "part"], terms(F.col("ptext")))
    both = voted.groupBy(*keys).agg(F.max(F.when(F.col("part") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("part") == 1, F.col("fp"))).alias("edited_fp"))
    following = F.coalesce(F.lead("fp").over(Window.partitionBy("bucket").orderBy("_rank")), F.col("first_fp"))
    return both.withColumn("next_fp", following).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def _tables(fp: Column) -> Column:
    """(table, key) of a fingerprint in each of the permuted tables."""
    keys = []
    for t, chosen in enumerate(combinations(BLOCKS, len(BLOCKS) - RADIUS)):
        mask = sum(((1 << bits) - 1) << at for at, bits in chosen)
        keys.append(F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(mask - (1 << 64 if mask >> 63 else 0)).cast("long")).alias("key")))
    return F.array(*keys)


def _first_table(diff: Column) -> Column:
    """The first table whose blocks are all equal, from the bits that differ."""
    out = F.lit(-1)
    for t, chosen in reversed(list(enumerate(combinations(BLOCKS, len(BLOCKS) - RADIUS)))):
        mask = sum(((1 << bits) - 1) << at for at, bits in chosen)
        out = F.when(diff.bitwiseAND(F.lit(mask - (1 << 64 if mask >> 63 else 0)).cast("long")) == 0, F.lit(t)).otherwise(out)
    return out


def within_radius(queries: DataFrame, fps: DataFrame) -> DataFrame:
    """(q, fp, distance, n): every distinct ``fp`` of ``fps`` within RADIUS bits of a distinct ``fp`` q of ``queries``,
    itself too, and how many rows of ``fps`` have it. Rows with equal fingerprints are one pair; ``neighbours`` names them."""
    many = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).select("fp", "n", F.explode(_tables(F.col("fp"))).alias("_t"))
    many = many.select("fp", "n", "_t.table", "_t.key")
    few = queries.select(F.col("fp").alias("q")).distinct().select("q", F.explode(_tables(F.col("q"))).alias("_t"))
    few = few.select("q", F.col("_t.table").alias("q_table"), F.col("_t.key").alias("q_key"))
    diff = F.col("fp").bitwiseXOR(F.col("q"))
    met = (F.col("table") == F.col("q_table")) & (F.col("key") == F.col("q_key")) & (F.bit_count(diff) <= RADIUS) & (_first_table(diff) == F.col("q_table"))
    return many.join(few, met).select("q", "fp", F.bit_count(diff).alias("distance"), "n")


def neighbours(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, neighbour, distance) of every document of ``queries`` and every other one of ``rows`` within RADIUS bits.

    Both have (doc_id, fp). The pairs of a large group of copies are as many as its queries times its size.
    """
    asked, held = queries.select("doc_id", F.col("fp").alias("q")).distinct(), rows.select(F.col("doc_id").alias("neighbour"), "fp").distinct()
    pairs = within_radius(queries, rows).drop("n").join(asked, "q").join(held, "fp")
    return pairs.filter("doc_id <> neighbour").select("doc_id", "neighbour", "distance")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", query_every: int = 100) -> DataFrame:
    """The comparison of every document, and for ids divisible by ``query_every`` the number of other documents
    whose fingerprint is within RADIUS bits and the sorted fingerprints within it, its own included (null for the rest).

    The documents of a listed fingerprint are the rows with this ``fingerprint``, so copies are not listed one by one.
    """
    rows = materialise(compare(df, doc_id, text), "simhash")
    is_query = F.coalesce(F.pmod(F.col("doc_id"), F.lit(query_every)) == 0, F.lit(False))
    pairs = within_radius(rows.filter(is_query), rows)
    near = pairs.groupBy(F.col("q").alias("_q")).agg(F.sum("n").alias("n_within"), F.array_sort(F.collect_list(fingerprint_text(F.col("fp")))).alias("near_fps"))
    asked, others = rows.filter(is_query), rows.filter(~is_query)  # only questions are dealt by fingerprint
    found = asked.join(near, F.col("fp") == F.col("_q"), "left").unionByName(others, allowMissingColumns=True)
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("fp")).alias("fingerprint"),
        fingerprint_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        (F.col("n_within") - 1).alias("n_within_radius"),
        F.col("near_fps").alias("fingerprints_within_radius"),
    )
