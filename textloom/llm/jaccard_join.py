"""N-gram Jaccard join by PartEnum signatures (operator 2).

A document's set is its distinct word shingles as 64-bit hashes. Sizes are cut into bands [l, l / similarity]; two
sets that are similar enough lie in one band or in neighbouring ones, so a set takes part in its own band and in the
next. In a band whose largest size is r, similar sets differ in at most k = 2 r (1 - s) / (1 + s) shingles. The
shingle domain is partitioned by hash into first-level groups; in some group the sets differ in at most
``may_differ`` shingles, so of that group's ``parts`` second-level parts all but ``may_differ`` are equal in both, and
enumerating the subsets of ``parts - may_differ`` parts gives a signature that both share. A signature is the sum of
mixed hashes of the shingles in the chosen parts. Equal sets are one class before all this. Two parts of which one may
differ are the default: subsets of one part, the fewest signatures for a number of shingles that differ.

With spare groups similar sets share several signatures, ``t`` at least, so each set may leave out its t - 1 most
frequent ones: the rarest shared signature is among those that both keep. This takes apart the large buckets of
texts that have a common passage and little else in common, and it cannot lose a pair (see ``signatures``).

Links are found without all pairs of a group. Each signature bucket is a run of sorted rows: every member is compared
with the bucket's smallest id, and the exact Jaccard test decides. Buckets that this leaves in different components are
compared with their member of most links, round by round. The pairs that still are apart then are tested one by one.
A pair's sets only meet if a parity sketch, which never exceeds the true difference, lets them be similar: no link
between different texts is lost. Components come from distributed label propagation; neither links nor labels reach
the driver.

Scale: within a slice of rows only the first member of a bucket is dealt by signature, so a signature that a third of
all rows share is dealt once a slice. A text of any length is one row of a Python worker, which needs about 60 times its
size. Classes are known by 64 bits beside their size.

Defined results: null, empty and blank texts have 0 shingles and are a component of their own; a text that only null ids
have is linked with nothing; a text shorter than the shingle is one shingle; documents with equal ids share a row's
fate by their text; texts are read whole; extra columns are ignored by ``components`` and kept by ``first_of_each``,
which keeps one of several rows with equal id and text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import slices
from textloom.llm.common import discard, materialise, packed, sized, unpacked
from textloom.llm.fragments import release

#: Second-level parts of a group and how many of them may differ: each subset of PARTS - MAY_DIFFER parts is a signature.
PARTS, MAY_DIFFER = 2, 1
#: One spare group, and one more for so many differing shingles (see ``signatures``).
SPARE_EACH = 8
#: Bytes of text that a Python worker expands at once.
SLICE_BYTES = 2 << 20
MAX_ROUNDS = 60
#: Rounds in which a torn bucket is compared with its best-linked member before its remaining pairs are: at most so many,
#: and only while one pair in so many turns out to be a link.
HUB_ROUNDS, HUB_YIELD = 8, 20
#: Longs in a set's parity sketch, and in the folded one that members of a bucket are compared by.
SKETCH_WORDS, FOLDED_WORDS = 32, 8
#: Sets that more than one document in so many has are named by a broadcast; there are fewer of them than this.
HOT_SETS = 10_000


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte; those of A-Z equal those of a-z.
_BYTE = np.random.default_rng(20_000).integers(0, 2**63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64, as products of two short tables."""
    low = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2047, base, np.uint64))))
    high = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n >> 11, low[-1:] * base, np.uint64))))
    return np.multiply.outer(high, low).ravel()[:n]


def text_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct word shingles of each text as one flat array, by text then hash.

    Words are runs without ASCII white space; a word's hash is the sum of its bytes' numbers times powers of a multiplier,
    taken from one running sum over the bytes of all texts, so no word becomes a Python object.
    """
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    none = np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    if ends[-1] == ends[0]:
        return none
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~_IS_SPACE[raw]
    edge = np.concatenate(([True], np.zeros(len(raw), bool)))
    edge[ends] = True  # a word ends with its text
    first = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    last = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True]))))
    if not len(first):
        return none
    terms = _BYTE[raw]
    terms *= _powers(_MULTIPLIER, len(raw))
    running = np.concatenate(([np.uint64(0)], np.cumsum(terms)))
    del terms
    word = _mix((running[last + 1] - running[first]) * _powers(_INVERSE, len(raw) + 1)[first] + (last - first).astype(np.uint64))
    del running
    at = np.searchsorted(first, ends)
    counts = np.diff(at)
    owner = np.repeat(np.arange(len(texts)), counts)
    room = at[1:][owner] - np.arange(len(word))  # words from here to the text's end
    full = np.flatnonzero(room >= width)
    code = np.full(len(full), np.uint64(width))
    for k in range(width):
        code = _mix(code * np.uint64(0x2545F4914F6CDD1D) + word[full + k])
    owners = owner[full]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        short = counts[few].astype(np.uint64) + np.uint64(1_000_003)
        for k in range(width - 1):
            short = np.where(counts[few] > k, _mix(short * np.uint64(0x2545F4914F6CDD1D) + word[np.minimum(at[few] + k, len(word) - 1)]), short)
        code, owners = np.concatenate([code, short]), np.concatenate([owners, few])
    order = np.argsort(code)
    order = order[np.argsort(owners[order].astype(np.uint16 if len(texts) < 65536 else np.int64), kind="stable")]
    code, owners = code[order], owners[order]
    fresh = np.concatenate(([True], (code[1:] != code[:-1]) | (owners[1:] != owners[:-1])))
    return code[fresh], np.bincount(owners[fresh], minlength=len(texts))


def set_keys(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; equal sets have equal keys."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_mix(flat + np.uint64(0x632BE59BD9B4E019)))))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return _mix(sums[ends[1:]] - sums[ends[:-1]] + sizes.astype(np.uint64)).view(np.int64)


def parity_sketch(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS longs a set: bit j is the parity of the shingles that hash to j.

    Each shingle in which two sets differ flips one bit, so the bits that differ never outnumber the shingles that do.
    """
    bits, ends = SKETCH_WORDS * 64, np.concatenate(([0], np.cumsum(sizes)))
    cell = (_mix(flat ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bits)).astype(np.int64)
    out = np.zeros((len(sizes), SKETCH_WORDS), np.int64)
    for lo in range(0, len(sizes), 512):  # rows whose cells are counted at once
        n = sizes[lo : lo + 512]
        odd = np.bincount(np.repeat(np.arange(len(n)) * bits, n) + cell[ends[lo] : ends[lo + len(n)]], minlength=len(n) * bits).astype(np.uint8) & 1
        out[lo : lo + len(n)] = np.packbits(odd, bitorder="little").view(np.int64).reshape(len(n), SKETCH_WORDS)
    return out.ravel()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        yield from slices(batch, "text", SLICE_BYTES)


def _member_rows(width: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            flat, sizes = text_sets(part.column("text"), width)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("content"), pa.array(sizes), pa.array(set_keys(flat, sizes))], ["doc_id", "content", "n_shingles", "id"])

    return emit


def _set_rows(width: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            flat, sizes = text_sets(part.column("text"), width)
            same = set_keys(flat, sizes) == part.column("id").to_numpy()  # ids can repeat with other texts
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat.view(np.int64)))
            marks = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * SKETCH_WORDS), pa.array(parity_sketch(flat, sizes)))
            yield pa.RecordBatch.from_arrays([part.column("id"), sets, pa.array(sizes), marks], ["id", "hs", "n", "sketch"]).filter(pa.array(same))

    return emit


class Bands:
    """Size bands for a similarity of percent / 100, and each band's partitioning."""

    def __init__(self, percent: int):
        self.percent = percent

    def bounds(self, largest: int) -> np.ndarray:
        """First sizes of the bands up to the one after ``largest``."""
        starts, low = [], 1
        while True:
            starts.append(low)
            if low > largest:
                return np.array(starts, np.int64)
            low = low * 100 // self.percent + 1

    def difference(self, top: np.ndarray) -> np.ndarray:
        """The most shingles in which two similar sets of at most ``top`` shingles differ."""
        return 2 * top * (100 - self.percent) // (100 + self.percent)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def surely_shared(most: np.ndarray, groups: np.ndarray, parts: int, may_differ: int) -> np.ndarray:
    """The fewest signatures that sets share if they differ in at most ``most`` shingles.

    A group with d parts that differ keeps comb(parts - d, parts - may_differ) of its subsets. Each further part of a group
    costs fewer of them than the one before, so most are lost if the shingles that differ are dealt evenly to the groups.
    """
    kept = np.array([comb(parts - d, parts - may_differ) if d <= parts else 0 for d in range(may_differ + 2)], np.int64)
    each, over = np.divmod(most, groups)
    return over * kept[each + 1] + (groups - over) * kept[each]


def signatures(flat: np.ndarray, sizes: np.ndarray, percent: int, parts: int = PARTS, may_differ: int = MAY_DIFFER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row index, signature, band's shift, how many may be left out) of non-empty sets given as one flat array of
    hashes and the sizes of the sets.

    There is a signature for each group and each subset of ``parts - may_differ`` of its parts. Similar sets share ``s`` of
    them at least (``surely_shared``). A subset of parts that hold no shingle would be shared by unrelated sets, so it is no
    signature of a set that has a signature to share without it; such a set with e empty subsets shares t = s - e
    signatures with each similar set and may leave out t - 1. A set with s empty subsets or more has all its subsets as
    signatures.
    """
    if not 0 < may_differ < parts:
        raise ValueError("some parts, but not all, may differ")
    bands = Bands(percent)
    starts = bands.bounds(int(sizes.max()))
    own = np.searchsorted(starts, sizes, "right") - 1
    out: list[tuple[np.ndarray, ...]] = []
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    subsets = [list(chosen) for chosen in combinations(range(parts), parts - may_differ)]
    place, value = _mix(flat.view(np.uint64)), _mix(flat.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for shift in (0, 1):
        band = own + shift
        most = bands.difference(starts[band] * 100 // percent)
        groups = most // (may_differ + 1) + 2 + most // SPARE_EACH
        first = np.concatenate(([0], np.cumsum(parts * groups)))
        cell = first[owner] + (((place >> np.uint64(32)) * (parts * groups).astype(np.uint64)[owner]) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(first[-1], np.uint64)
        np.add.at(sums, cell, value)
        held = np.bincount(cell, minlength=first[-1]) > 0
        # one row for each group, one column for each subset of its parts
        total = np.stack([sums.reshape(-1, parts)[:, chosen].sum(1) for chosen in subsets], 1).ravel()
        filled = np.stack([held.reshape(-1, parts)[:, chosen].any(1) for chosen in subsets], 1).ravel()
        of = np.repeat(np.arange(n), len(subsets) * groups)
        at = np.arange(len(of)) - (first[:-1] // parts * len(subsets))[of]
        sig = _mix(_mix(band[of].astype(np.uint64) * np.uint64(0x100000000) + at.astype(np.uint64)) + total)
        spare = surely_shared(most, groups, parts, may_differ) - np.bincount(of[~filled], minlength=n)
        use = filled | (spare < 1)[of]
        out.append((of[use], sig[use], np.full(int(use.sum()), shift, np.int64), np.maximum(spare - 1, 0)[of[use]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _signature_rows(width: int, percent: int, parts: int, may_differ: int):
    """Rows (sig, id, place, head, n): of a slice's members of a bucket the first has their number as n, the others
    have it as their head and n = 0; place is twice the number of signatures to leave out, plus the band's shift."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            flat, sizes = text_sets(part.column("text"), width)
            if not len(flat):
                continue
            keys = set_keys(flat, sizes)
            rows, sigs, side, spare = signatures(flat, sizes[sizes > 0], percent, parts, may_differ)
            ids = keys[sizes > 0][rows]
            order = np.lexsort((ids, sigs))
            sigs, ids, side, spare = sigs[order].view(np.int64), ids[order], side[order], spare[order]
            fresh = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (ids[1:] != ids[:-1])))
            sigs, ids, side, spare = sigs[fresh], ids[fresh], side[fresh], spare[fresh]  # copies of a set in this slice are one row
            new = np.concatenate(([True], sigs[1:] != sigs[:-1]))
            starts = np.flatnonzero(new)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(sigs)), 0))
            n = np.zeros(len(sigs), np.int32)
            n[starts] = np.diff(np.append(starts, len(sigs)))
            # spare and side in one number; rows of a set together, as what repeats is compressed
            place, head, by = (spare * 2 + side).astype(np.int32), ids[lead], np.lexsort((side, ids))
            columns = [pa.array(sigs[by]), pa.array(ids[by]), pa.array(place[by]), pa.array(head[by], mask=new[by]), pa.array(n[by])]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "id", "place", "head", "n"])

    return emit


def _buckets(rows: DataFrame) -> DataFrame:
    """(sig, id, centre) of the signatures that sets share and keep; centre is another member or the set itself."""
    rows = materialise(rows, "signatures")
    alone = Window.partitionBy("sig")
    counted = rows.filter("head IS NULL").select("sig", "id", "place", F.sum("n").over(alone).alias("n"), F.min("id").over(alone).alias("centre")).filter("n > 1")
    # one half of the signatures after the other, so that the shuffle files of half of them exist at a time
    firsts = materialise(counted.filter("sig < 0"), "firsts").union(materialise(counted.filter("sig >= 0"), "firsts"))
    repeats = materialise(rows.filter("head IS NOT NULL").select("sig", "id", "place", "head"), "repeats")
    discard(rows)
    sizes = firsts.groupBy("sig").agg(F.max("n").alias("n"))
    others = repeats.join(sizes, "sig").select("sig", "id", "place", "n", F.col("head").alias("centre"))
    # one row for each set and signature; copies of a set in other slices can have another centre
    shared = firsts.union(others).groupBy("id", "place", "sig").agg(F.max("n").alias("n"), F.min("centre").alias("centre"))
    rank = F.row_number().over(Window.partitionBy("id", "place").orderBy(F.desc("n"), "sig"))
    kept = shared.withColumn("rank", rank).filter(F.col("rank") > F.expr("place div 2"))
    kept = materialise(kept.select("sig", "id", "centre"), "buckets")
    discard(firsts, repeats)
    return kept


def _labels(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over ``links`` (a, b), for the ids in ``links``.

    Alternates pointing every node at the least label around it and at its label's label; star-shaped links settle in
    two or three rounds, chains in logarithmically many.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "labels")
    for _ in range(MAX_ROUNDS):
        around = both.join(now.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        nearer = now.join(around.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # also lower the old label's own node, so that whole trees move at once
        hook = nearer.groupBy(F.col("old").alias("id")).agg(F.min("comp").alias("hook"))
        hooked = nearer.join(hook, "id", "left").select("id", "old", F.least("comp", F.coalesce("hook", "comp")).alias("comp"))
        up = hooked.select(F.col("id").alias("up"), F.col("comp").alias("up_comp"))
        stepped = materialise(hooked.join(up, F.col("comp") == F.col("up"), "left").select("id", "old", F.least("comp", F.coalesce("up_comp", "comp")).alias("comp")), "labels")
        moved = stepped.filter("old <> comp").limit(1).count()
        now = stepped.select("id", "comp")
        if not moved:
            return now
    raise RuntimeError("label propagation did not settle")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union; only pairs that sizes and sketches let be
    similar are joined with their sets."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    sized_ = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = materialise(both.filter(sized_ & ((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb")))).select("a", "b"), "near")
    left = near.join(sets.select(F.col("id").alias("a"), F.col("hs").alias("ha"), F.col("n").alias("na")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("hs").alias("hb"), F.col("n").alias("nb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def linked_classes(rows: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(id, comp) for the sets that are linked to another.

    ``rows`` has the signatures of each set as ``_signature_rows`` gives them; ``fetch(ids)`` returns (id, hs, n, sketch),
    one row for each id.
    """
    star = _buckets(rows)
    pairs = star.filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    # a centre can have left the signature out itself, so it is a member of the bucket only by its own row
    known = materialise(fetch(star.select("id").union(pairs.select(F.explode(F.array("a", "b")).alias("id"))).distinct()), "sets")
    links = materialise(_verified(pairs, known, percent), "links")
    labels = _labels(links)
    members = star.select("sig", "id")
    for _ in range(HUB_ROUNDS):
        members = _open(members, labels)
        degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        ranked = members.join(degree, "id", "left").select("sig", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("id")).alias("order"), "id", "comp").alias("hub"))
        hubs = ranked.groupBy("sig").agg(F.max("hub").alias("hub"))
        apart = members.join(hubs, "sig").filter("comp <> hub.comp").select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
        apart = materialise(apart.join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = materialise(_verified(apart, known, percent), "links")
        pairs, more = pairs.union(apart), found.count()
        if not more:
            break
        links = links.union(found)
        labels = _labels(links)
        if more * HUB_YIELD < apart.count():
            break
    # folding a sketch keeps its bound; only pairs that sizes and folded sketches let be similar leave the join
    folded = [reduce(lambda x, y: x.bitwiseXOR(y), (F.get("sketch", F.lit(i)) for i in range(k, SKETCH_WORDS, FOLDED_WORDS))).alias(f"f{k}") for k in range(FOLDED_WORDS)]
    rest = _open(members, labels).join(known.select("id", "n", *folded), "id")
    left, right = (rest.select("sig", *(F.col(c).alias(f"{side}_{c}") for c in rest.columns if c != "sig")) for side in ("a", "b"))
    differ = sum((F.bit_count(F.col(f"a_f{k}").bitwiseXOR(F.col(f"b_f{k}"))) for k in range(FOLDED_WORDS)), F.lit(0))
    near = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & ((100 + percent) * differ <= (100 - percent) * (F.col("a_n") + F.col("b_n")))
    cross = left.join(right, (left["sig"] == right["sig"]) & (F.col("a_id") < F.col("b_id")) & (F.col("a_comp") != F.col("b_comp")) & near)
    cross = cross.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    untried = materialise(cross.distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = materialise(_verified(untried, known, percent), "links")
    return labels if more.isEmpty() else _labels(links.union(more))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, id, comp) of the buckets whose members lie in different components."""
    marked = members.select("sig", "id").join(labels, "id", "left").select("sig", "id", F.coalesce("comp", "id").alias("comp"))
    torn = marked.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("sig")
    return materialise(marked.join(torn, "sig"), "open")


def _classed(df: DataFrame, doc_id: str, text: str, width: int, percent: int, parts: int = PARTS, may_differ: int = MAY_DIFFER) -> DataFrame:
    """(doc_id, content, n_shingles, component_id) of every row; content is a hash of its text."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.dtypes[0][1]
    hashed = docs.select("doc_id", F.xxhash64("text").alias("content"), "text")
    members = materialise(hashed.mapInArrow(_member_rows(width), f"doc_id {kind}, content long, n_shingles long, id long"), "members")
    least = materialise(members.filter("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "least")

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = materialise(least.join(ids, "id").select(F.col("least").alias("doc_id"), "id"), "wanted")
        found = docs.join(sized(wanted), "doc_id")  # beyond the bound of ``sized`` texts are dealt by id
        sets = found.select("id", "text").mapInArrow(_set_rows(width), "id long, hs array<long>, n long, sketch array<long>")
        # an id can have several rows with the same text
        return sets if least.count() == members.filter("n_shingles > 0").select("doc_id").distinct().count() else sets.dropDuplicates(["id"])

    labels = linked_classes(docs.mapInArrow(_signature_rows(width, percent, parts, may_differ), "sig long, id long, place int, head long, n int"), fetch, percent)
    tops = least.join(labels, "id").groupBy("comp").agg(F.min("least").alias("component"))
    linked = labels.join(tops, "comp").select("id", "component")
    named = materialise(least.join(linked, "id", "left").select("id", "copies", F.coalesce("component", "least").alias("component")), "named")
    # rows of a set with many copies are not dealt by it, nor are those without a set
    often = F.col("copies") > members.count() / HOT_SETS
    filled, hot = members.filter("n_shingles > 0"), named.filter(often).select("id", "component")
    seldom = filled.join(F.broadcast(hot.select("id")), "id", "left_anti").join(named.filter(~often).select("id", "component"), "id")
    empty = members.filter("n_shingles = 0").withColumn("component", F.col("doc_id"))
    out = filled.join(F.broadcast(hot), "id").unionByName(seldom).unionByName(empty)
    return out.select("doc_id", "content", "n_shingles", F.col("component").alias("component_id"))


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, parts: int = PARTS, may_differ: int = MAY_DIFFER) -> DataFrame:
    """Per document: n_shingles and component_id, the smallest doc_id reachable over links.

    ``parts`` and ``may_differ`` set the enumeration; no choice of them changes the result.
    """
    return _classed(df, doc_id, text, width, percent, parts, may_differ).select("doc_id", "n_shingles", "component_id")


def first_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The row of ``df`` with the smallest id of each component, one where several have its id and text; all columns stay.

    Of texts that only rows without an id have, one row stays; a row without an id goes if its text has one elsewhere.
    """
    rows = packed(df, doc_id=doc_id, text=text).withColumn("content", F.xxhash64("text"))
    judged = materialise(_classed(df, doc_id, text, width, percent).groupBy("doc_id", "content", "component_id").agg(F.count(F.lit(1)).alias("n")), "judged")
    head = F.col("doc_id").eqNullSafe(F.col("component_id"))
    others = materialise(judged.filter(~head | (F.col("n") > 1)).select(F.col("doc_id").alias("o_id"), F.col("content").alias("o_content"), head.alias("again")), "others")
    same = F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("content") == F.col("o_content"))
    left = rows.join(sized(others), same, "left")
    once = left.filter(F.col("o_content").isNull()).select("_row")
    again = left.filter("again").dropDuplicates(["doc_id", "content"]).select("_row")
    return unpacked(once.union(again), df.columns)
