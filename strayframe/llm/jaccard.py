"""N-gram Jaccard join: a size-aware heavy-light similarity join over sets of word shingles.

Documents with equal sets form a class first; classes are joined. Light sets (up to a size boundary) are joined by
fixed-size subsets: a pair of sizes (a, b) needs an overlap of ``c`` shingles, both sides emit their subsets of just
``c`` shingles, and a set of each size meet in a subset exactly if they link, so nothing needs to be verified. Heavy
sets scan inverted lists: a set is listed under its rarest shingles, as many as any partner must hit, and what meets in
a list is verified. The boundary is the one of least cost over the sizes of all documents.

In a list of up to SHORT sets all pairs are looked at whose sizes and places in the list's sets allow for a link. A longer
list is that of a group of near copies, whose pairs would grow with its square. It gets a base, its most ordinary set.
For sets x and y and any base, x and y differ in as many shingles as (x differs from base) and (y differs from base)
differ. So a group is joined by its members' differences from the base, which are few and mostly their own:

- members that link to the base are one component with it, which costs an edge a member;
- any other pair needs an overlap of the two differences, ``(w_x + w_y) / 2`` shingles with ``w`` = difference less
  the share of a set's size that may differ. That is an overlap join again: differences are listed under their rarest
  shingles (what the base lacks first, then what it has, the rarely lost first). Two sets that link differ from the base
  in about as many shingles, so a set unlike the base has no longer a list than without one, and the shingles that made
  the list long are none of it.

A list's least weight and most room tell which of its entries can have a partner there at all; the others leave it before it
counts as long, and what is long is cut by size first, as sets of unlike sizes don't link. Unlike sets that share a passage have heavy differences, so they leave, and a round of differences is enough for most
data. Lists of differences that are long even so get a base of their own, and so on. After ROUNDS of that the rest is compared
pair by pair: that is quadratic where a group's members lie around its base at a distance just beyond the threshold. No link between two components is left out and no list is cut.

Shingles are 64-bit hashes; two different ones are equal by chance once in 10^19 pairs.

Defined cases: a null text, or one without words, has an empty set and is its own component. A text of fewer words
than a shingle has one shingle, all of them. Repeated rows and copies are one class. A null doc_id gets a row; a
component whose doc_ids are all null has a null component_id. Rows of one doc_id and different texts are different
documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations
from math import ceil, comb, floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, release, stored, text_or_empty
from .graph import components

#: The most frequent shingles, at most so many (12 bytes each), come last in the order of rarity. The order decides speed alone.
FREQUENT = 300_000
#: Shingles that a task holds before it hands on those that it saw more than once.
COUNT_AT = 2_000_000
#: What a step through an inverted list costs, in subset probes.
LIST_STEP = 6
LIGHT_MOST = 24
#: Candidates up to this number are sent to the scan by broadcast (8 bytes each, 24 with their digests).
BROADCAST_IDS = 500_000
SIGNATURE = 512
#: Lists of up to so many sets, and of so many differences, are compared pair by pair.
SHORT, SHORT_APART = 16, 64
#: Rounds of lists of differences before the rest is compared pair by pair.
ROUNDS = 4


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of the text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space as in ASCII
    if not words:
        return np.zeros(0, dtype=np.uint64)
    one = xxhash.xxh3_64_intdigest
    h = np.array([one(w) for w in words], dtype=np.uint64)
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities as 64-bit words; a power of two of bits, so that the two halves of a longer one XORed are a shorter one."""
    bits = max(SIGNATURE, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else SIGNATURE
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bits_apart(a: str, b: str) -> Column:
    """Bits in which two signatures differ, the longer one being folded once; 0 if their lengths are further apart."""
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def folded(x: str, other: str) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), xor(F.slice(x, 1, half), F.slice(x, half + 1, half))).otherwise(F.col(x))

    short = F.greatest(F.size(a), F.size(b)) <= 2 * F.least(F.size(a), F.size(b))
    count = F.aggregate(xor(folded(a, b), folded(b, a)), F.lit(0), lambda k, x: k + F.bit_count(x))
    return F.when(short, count).otherwise(0)


def overlap(a: int, b: int, t: Fraction) -> int:
    """The least intersection of sets of sizes a and b whose Jaccard similarity is t or more."""
    return ceil(Fraction(a + b) * t / (1 + t))


def partner_sizes(a: int, t: Fraction) -> range:
    return range(ceil(a * t), floor(a / t) + 1)


def listed(a: int, t: Fraction) -> int:
    """How many of its rarest shingles a set of size a is listed under."""
    return a - ceil(a * t) + 1


def subset_count(a: int, boundary: int, t: Fraction) -> int:
    return sum(comb(a, overlap(a, b, t)) for b in partner_sizes(a, t) if b <= boundary)


def boundary_of(sizes: dict[int, int], t: Fraction) -> int:
    """The largest size handled by subsets: least total of subset probes and list steps."""
    best, at = None, 0
    for x in range(0, LIGHT_MOST + 1):
        cost = sum(n * (subset_count(a, x, t) if a <= x else 0) for a, n in sizes.items() if a <= LIGHT_MOST)
        cost += sum(n * LIST_STEP * listed(a, t) for a, n in sizes.items() if a and (a > x or floor(a / t) > x))
        if best is None or cost < best:
            best, at = cost, x
    return at


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    for lo in range(0, batch.num_rows, 64):
        yield from batch.column(column).slice(lo, 64).to_pylist()


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """The shingles met most often, in ascending frequency. Each task counts what it reads and hands on the
    shingles that it met at least twice in COUNT_AT; the totals are ranked over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def hand_on() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= 2
            return pa.RecordBatch.from_arrays([_signed(values[keep]), pa.array(times[keep].astype(np.int64))], names=["s", "n"])

        for batch in batches:
            for text in _texts(batch, 0):
                held.append(shingle_set(text, n))
                size += len(held[-1])
                if size >= COUNT_AT:
                    yield hand_on()
                    held, size = [], 0
        if held:
            yield hand_on()

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(count, "s bigint, n bigint")
    top = counted.groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(FREQUENT)
    rows = top.toArrow()
    return rows.column("s").to_numpy()[::-1].copy().view(np.uint64)


def set_table(docs: DataFrame, n: int, t: Fraction, known: Broadcast) -> DataFrame:
    """Per row: doc_id, a hash of the text, size, digest and signature of the set, ``odd``: how many in a thousand of its
    shingles are none of the frequent ones, and ``rare``: its listed shingles, the rarest first; small sets come whole."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signs, odd, rare = [], [], [], [], []
            for text in _texts(batch, 2):
                s = shingle_set(text, n)
                rank = _ranks(s, *known.value)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signs.append(signature(s))
                odd.append(1000 * int((rank == 0).sum()) // max(1, len(s)))
                ordered = s[np.argsort(rank, kind="stable")]
                rare.append(ordered if len(s) <= LIGHT_MOST else ordered[: listed(len(s), t)])
            arrays = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.list_(pa.int64())), pa.array(odd, pa.int32()), _lists(rare)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], names=["doc_id", "tie", "size", "digest", "sign", "odd", "rare"])

    rows = _keyed(docs).select("doc_id", "tie", "text")
    return stored(rows.mapInArrow(sets, "doc_id bigint, tie bigint, size bigint, digest binary, sign array<bigint>, odd int, rare array<bigint>"), "sets")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))


def _ranks(s: np.ndarray, values: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles' places in the order of frequency, from 1; 0 for those that are not frequent."""
    if not len(s) or not len(values):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
    return np.where(values[at] == s, ranks[at].astype(np.int64) + 1, 0)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate([*parts, np.zeros(0, np.uint64)])))


def light_links(classes: DataFrame, boundary: int, t: Fraction) -> DataFrame:
    """(u, v) of light sets that meet in a subset from two sides. For sizes a < b all sets of size a there link to all of size b
    (but not to each other), so each is given the smallest set of the other side; for a = b all link."""

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners, sides = [], [], []
            for number, rare in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for size in partner_sizes(len(rare), t):
                    if size <= boundary:
                        a, b = sorted((len(rare), size))
                        c = overlap(a, b, t)
                        if a == b and c == a:
                            continue  # an equal set: the same class
                        for chosen in combinations(sorted(rare), c):
                            keys.append(xxhash.xxh3_128_digest(np.array([a, b, *chosen], dtype=np.int64).tobytes()))
                            owners.append(number)
                            sides.append(0 if a == b else 1 if len(rare) == a else 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64()), pa.array(sides, pa.int32())], names=["key", "u", "side"])

    light = classes.where((F.col("size") > 0) & (F.col("size") <= boundary))
    probes = stored(light.select("c", "rare").mapInArrow(subsets, "key binary, u bigint, side int"), "probes")
    least = [F.min(F.when(F.col("side") == k, F.col("u"))).alias(f"v{k}") for k in range(3)]
    first = probes.groupBy("key").agg(F.count("*").alias("n"), *least).where("n > 1 and (v0 is not null or v1 is not null and v2 is not null)").drop("n")
    first = stored(first, "first")  # a table of its own, so that a frequent key's probes can be split in the join
    other = F.when(F.col("side") == 0, F.col("v0")).when(F.col("side") == 1, F.col("v2")).otherwise(F.col("v1"))
    out = stored(probes.join(first, "key").select("u", other.alias("v")).where("u <> v").distinct(), "links")
    release(classes.sparkSession, probes, first)
    return out


def alike(pairs: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (u, v) of class numbers whose signatures allow for the similarity."""
    for side in ("u", "v"):
        pairs = pairs.join(classes.select(F.col("c").alias(side), F.col("size").alias(f"{side}_size"), F.col("sign").alias(f"{side}_sign")).hint("merge"), side)
    near = bits_apart("u_sign", "v_sign") * (t.denominator + t.numerator) <= (F.col("u_size") + F.col("v_size")) * (t.denominator - t.numerator)
    return stored(pairs.where(near).select("u", "v"), "alike")


def verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (u, v) of class numbers whose whole sets reach the similarity."""
    left = sets.select(F.col("c").alias("u"), F.col("shingles").alias("a")).hint("merge")
    right = sets.select(F.col("c").alias("v"), F.col("shingles").alias("b")).hint("merge")
    both = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - both
    return pairs.join(left, "u").join(right, "v").where(both * t.denominator >= union * t.numerator).select("u", "v")


def _may_link(x: Callable[[str], Column], y: Callable[[str], Column], boundary: int, t: Fraction) -> Column:
    """Whether two sets that meet in a list can link: their sizes fit, one is above the boundary, they are not both known to
    be linked to the base, and where this is the first shingle that they share, enough are left in both behind it."""
    size, other, up, down = x("size"), y("size"), t.numerator, t.denominator
    fits = (size * down >= other * up) & (other * down >= size * up) & (F.greatest(size, other) > boundary)
    behind = F.least(x("r") - x("at"), y("r") - y("at"))
    return fits & ~(x("core") & y("core")) & (behind * (2 * (up + down)) >= x("w") + y("w"))


def _counted(entries: DataFrame, boundary: int, t: Fraction) -> DataFrame:
    """The entries of lists (b, s) that some other entry of their list may link to, with the list's length n before those went.
    A partner's w may be as large as the room that an entry leaves, ``2 * (up + down) * (r - at) - w``, and the other way round,
    so the least w and the most room of a list's sets (those linked to the base apart) tell which entries have no partner."""
    room = (F.col("r") - F.col("at")) * (2 * (t.numerator + t.denominator)) - F.col("w")
    kinds = {"linked": F.col("core"), "other": ~F.col("core")}
    bounds = [x for k, of in kinds.items() for x in (F.min(F.when(of, F.col("w"))).alias(f"{k}_w"), F.max(F.when(of, room)).alias(f"{k}_room"))]
    shared = entries.groupBy("b", "s").agg(F.count("*").cast("int").alias("n"), F.max("size").alias("top"), *bounds)
    shared = stored(shared.where((F.col("n") > 1) & (F.col("top") > boundary) & F.col("other_w").isNotNull()).drop("top"), "shared")
    has = {k: F.coalesce((F.col(f"{k}_w") <= room) & (F.col(f"{k}_room") >= F.col("w")), F.lit(False)) for k in kinds}
    met = entries.join(shared.hint("merge"), ["b", "s"])  # both sides are tables, so a long list can be split
    out = stored(met.where(has["other"] | ~F.col("core") & has["linked"]).select(*entries.columns, "n"), "lists")
    release(entries.sparkSession, shared)
    return out


def _by_size(lists: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(the entries with their lists cut by size, a table that they are read from). Sets that link have sizes of one band or of two neighbours, as a
    band is a factor of 1 / t wide. So a list becomes one of each two neighbouring bands that it has, or of a band that has none."""
    width = max(log(1 / t), 1e-6) * (1 + 1e-9)
    banded = lists.withColumn("band", F.floor(F.log("size") / width).cast("int"))
    bands = stored(banded.groupBy("b", "s").agg(F.collect_set("band").alias("bands")), "bands")  # a logarithm of the sizes
    has = lambda k: F.array_contains("bands", F.col("band") + k)
    keys = F.array_compact(F.array(F.when(has(-1) | ~has(1), F.col("band")), F.when(has(1), F.col("band") + 1)))
    cut = banded.join(bands.hint("merge"), ["b", "s"]).withColumn("key", F.explode(keys))
    return cut.withColumn("s", F.xxhash64("s", "key")).select(*lists.columns), bands


def _short_and_long(entries: DataFrame, most: int, boundary: int, t: Fraction) -> tuple[list[DataFrame], DataFrame | None, list[DataFrame]]:
    """The lists of up to ``most`` entries, those that stay longer (None: there are none), and the tables that hold both. Longer lists are cut by
    size and counted again without the entries that have no partner, as long as a tenth of their entries goes."""
    tables = [_counted(entries, boundary, t)]
    short, long = [tables[0].where(F.col("n") <= most)], tables[0].where(F.col("n") > most)
    before, now = None, long.count()
    while now and (before is None or now * 10 <= before * 9):
        left = long.drop("n")
        if before is None:
            left, bands = _by_size(left, t)
            tables.append(bands)
        tables.append(_counted(left, boundary, t))
        short, long = [*short, tables[-1].where(F.col("n") <= most)], tables[-1].where(F.col("n") > most)
        before, now = now, long.count()
    return short, long if now else None, tables


def _all_pairs(short: DataFrame, boundary: int, t: Fraction) -> DataFrame:
    """(u, v) with u > v of lists whose length is bounded."""
    members = short.groupBy("b", "s").agg(F.collect_list(F.struct("c", "size", "at", "r", "w", "core")).alias("m"))
    later = lambda x: F.filter("m", lambda y: (y["c"] < x["c"]) & _may_link(x.getField, y.getField, boundary, t))
    pairs = F.transform("m", lambda x: F.transform(later(x), lambda y: F.struct(x["c"].alias("u"), y["c"].alias("v"))))
    return members.select(F.explode(F.flatten(pairs)).alias("p")).select("p.u", "p.v").distinct()


def _rest(lists: DataFrame, boundary: int, t: Fraction) -> DataFrame:
    """(u, v) with u > v of lists of any length."""
    names = ("c", "size", "at", "r", "w", "core")
    other = lists.select("b", "s", *(F.col(k).alias(f"v_{k}") for k in names))
    may = _may_link(F.col, lambda k: F.col(f"v_{k}"), boundary, t)
    return lists.join(other.hint("merge"), ["b", "s"]).where((F.col("c") > F.col("v_c")) & may).select(F.col("c").alias("u"), F.col("v_c").alias("v")).distinct()


def _based(long: DataFrame) -> DataFrame:
    """(c, b): the sets of long lists, each list's with its most ordinary set (lowest ``far``) as their base."""
    base = stored(long.groupBy("b", "s").agg(F.min(F.struct("far", "c"))["c"].alias("base")), "bases")
    out = stored(long.join(base.hint("merge"), ["b", "s"]).select("c", F.col("base").alias("b")).distinct(), "based")
    release(long.sparkSession, base)
    return out


def differences(based: DataFrame, sets: DataFrame, known: Broadcast, t: Fraction) -> DataFrame:
    """Entries (b, s, c, size, at, r, w, core, far) of each set's difference from its base: the shingles s it is listed
    under, their places ``at`` in it, its size r, the weight w, and whether the set links to the base. A linked set has a
    row without s, too."""
    up, down = t.numerator, t.denominator
    bases = stored(sets.join(based.select(F.col("b").alias("c")).distinct().hint("merge"), "c").select(F.col("c").alias("b"), F.col("shingles").alias("base")), "bases")
    pairs = based.join(sets.select("c", F.col("shingles").alias("own")).hint("merge"), "c").join(bases.hint("merge"), "b").select("b", "c", "base", "own")
    names = ["b", "s", "c", "size", "at", "r", "w", "core", "far"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k, (b, c) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                base, own = (batch.column(j)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for j in (2, 3))
                apart = np.setxor1d(base, own, assume_unique=True)
                lost = np.isin(apart, base, assume_unique=True)
                rank = _ranks(apart, *known.value)
                ordered = apart[np.argsort(np.where(lost, (1 << 40) - rank, rank), kind="stable")]
                r, size, slack = len(apart), len(own), (down - up) * len(base)
                w = (up + down) * r - (down - up) * size
                core = w <= slack
                most = size * down // up  # a partner's size; it differs from the base about as much, or else the two differ too much
                partner = max(slack + 1 if core else -slack, (up + down) * r - (down - up) * (size + 2 * most))
                least = max(1, -(-(w + partner) // (2 * (up + down))))
                many = max(0, r - least + 1)
                alone = [None] if core else []
                own_rows = [[x] * (many + len(alone)) for x in (b, c, size, r, w, core, r)]
                own_rows[1:1], own_rows[4:4] = [[*ordered[:many].view(np.int64).tolist(), *alone]], [[*range(many), *alone]]
                for column, values in zip(out, own_rows, strict=True):
                    column += values
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=names)

    out = stored(pairs.mapInArrow(find, "b bigint, s bigint, c bigint, size bigint, at int, r int, w bigint, core boolean, far int"), "apart")
    release(based.sparkSession, bases)
    return out


def _classes_joined(docs: DataFrame, n: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie, size, digest of each row; digest, root, component_id of each class)."""
    spark = docs.sparkSession
    prepare(spark)
    ranked = frequent_shingles(docs, n)
    order = np.argsort(ranked)
    release(spark)  # the plans and shuffle files of what ran before
    known = spark.sparkContext.broadcast((ranked[order], order.astype(np.int32)))  # FREQUENT entries at most
    table = set_table(docs, n, t, known)
    classes = table.where("size > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), *(F.first(k).alias(k) for k in ("size", "sign", "odd", "rare")))
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # written once, so a class keeps its number
    sizes = {r[0]: r[1] for r in classes.where(F.col("size") <= 2 * LIGHT_MOST).groupBy("size").count().toLocalIterator()}
    boundary = boundary_of(sizes, t)
    light = light_links(classes, boundary, t)

    cut = F.col("size") - F.ceil(F.col("size") * t.numerator / t.denominator) + 1
    reach = classes.where(F.col("size") * t.denominator > boundary * t.numerator)  # has partners above the boundary
    listing = F.posexplode(F.slice("rare", 1, cut.cast("int"))).alias("at", "s")
    entries = reach.select(F.lit(-1).cast("bigint").alias("b"), "c", "size", F.col("size").cast("int").alias("r"), (F.col("size") * (2 * t.numerator)).alias("w"), F.lit(False).alias("core"), F.col("odd").alias("far"), listing)
    short, long, tables = _short_and_long(entries, SHORT, boundary, t)
    pairs = alike(_all_pairs(reduce(DataFrame.unionByName, short), boundary, t), classes, t)
    based = _based(long) if long else None
    release(spark, *tables)  # what was shuffled for the lists goes, too
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("c"))
    wanted = (wanted.unionByName(based.select("c")) if based else wanted).distinct()
    wanted = stored(wanted.join(classes.select("c", "digest", "least").hint("merge"), "c"), "wanted")
    sets = _whole_sets(docs, wanted, n)
    links = [light, stored(verified(pairs, sets, t), "links")]
    release(spark, pairs, wanted)
    parts: list[DataFrame] = []
    for turn in range(ROUNDS):
        if not based:
            break
        apart = differences(based, sets, known, t)
        parts.append(apart)
        links.append(apart.where("s is null and b <> c").select(F.col("b").alias("u"), F.col("c").alias("v")))
        short, long, tables = _short_and_long(apart.where("s is not null"), SHORT_APART, boundary, t)
        met = _all_pairs(reduce(DataFrame.unionByName, short), boundary, t)
        last = turn + 1 == ROUNDS
        parts.append(stored(verified(met.unionByName(_rest(long, boundary, t)).distinct() if last and long else met, sets, t), "links"))
        links.append(parts[-1])
        release(spark, based)
        based = _based(long) if long and not last else None
        release(spark, *tables)
    release(spark, sets)

    joined = components(reduce(DataFrame.unionByName, links))
    named = classes.select("c", "digest", "least").join(joined.withColumnRenamed("node", "c").hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = stored(named.select("digest", "least", "root"), "roots")
    smallest = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    out = stored(named.join(smallest.hint("merge"), "root").select("digest", "root", "component_id"), "named")
    release(spark, classes, named, smallest, joined, *links[:2], *parts)
    return table.select("doc_id", "tie", "size", "digest"), out


def near_copies(docs: DataFrame, *, n: int = 4, similarity: Fraction = Fraction(85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) of each row of docs."""
    rows, named = _classes_joined(docs, n, similarity)
    out = rows.join(named.drop("root").hint("merge"), "digest", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(c, shingles) of the wanted classes (c, digest, least): a text of each made into its set again. A doc_id that stands
    for several texts gives the sets of all of them, those not asked for fall out."""
    spark = docs.sparkSession
    rows = _keyed(docs)
    ids = wanted.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
    many = wanted.count()
    chosen = rows.join(F.broadcast(ids) if many <= BROADCAST_IDS else ids.hint("shuffle_hash"), "doc_id", "left_semi")
    if not wanted.where("least is null").isEmpty():
        chosen = chosen.unionByName(rows.where("doc_id is null"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in (shingle_set(x, n) for x in _texts(batch, 0)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists(sets)], names=["digest", "shingles"])

    made = chosen.select("text").mapInArrow(make, "digest binary, shingles array<bigint>")
    names = wanted.select("c", "digest")
    out = stored(made.join(F.broadcast(names) if many <= BROADCAST_IDS else names.hint("merge"), "digest").select("c", "shingles"), "whole")
    if out.count() == many:
        return out
    once = stored(out.groupBy("c").agg(F.first("shingles").alias("shingles")), "whole")  # rows or doc_ids that repeat
    release(spark, out)
    return once


def one_of_each(docs: DataFrame, *, n: int = 5, similarity: Fraction = Fraction(8, 10)) -> DataFrame:
    """docs without near copies: of each component the row stays whose doc_id is smallest (null last; of several texts of
    that doc_id, the one of the least hash; of equal rows, one). Rows without words are no copies of anything and stay."""
    rows, named = _classes_joined(docs, n, similarity)
    placed = stored(rows.where("digest is not null").join(named.select("digest", "root").hint("merge"), "digest").select("doc_id", "tie", "root"), "placed")
    first = stored(placed.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("first")).where("n > 1"), "first")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")))
    gone = stored(placed.join(first.hint("merge"), "root").where(other).select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")).distinct(), "gone")
    again = placed.groupBy("doc_id", "tie").count().where("count > 1").select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie"))
    again = stored(again, "again")
    mine = F.struct(*(docs[k] for k in docs.columns)).alias("row")
    keyed = docs.select(mine, F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text_or_empty()).alias("tie"))
    small = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys.hint("shuffle_hash")
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("tie") == F.col("gone_tie"))
    kept = keyed.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    repeated = kept.join(small(again), same, "left_semi").groupBy("id", "tie").agg(F.first("row").alias("row"))
    return kept.join(small(again), same, "left_anti").select("row.*").unionByName(repeated.select("row.*"))
