"""Near duplicates by ProbMinHash: signatures of weighted five-word shingles, banding, exact
verification of candidate pairs, and classes of linked documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ledgerfold.llm.common import components, hashed, maybe_in, ship, trimmed, without, words
from ledgerfold.session import stored

SHINGLE, SIMILARITY = 5, 0.8
#: 20 bands of 4 registers: a pair at 0.8 meets in at least one with probability 0.99997.
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: Buckets up to this size give all their pairs; larger ones are cut finer.
SMALL = 12
#: Registers that a finer bucket agrees in.
DEPTHS = (8, 16, 32, 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles of texts given as one array of word hashes, and the
    text each is of. A text of fewer words, but not none, is one shingle."""
    lengths = np.diff(starts)
    counts = np.where(lengths >= SHINGLE, lengths - SHINGLE + 1, np.minimum(lengths, 1))
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[:-1][owner]
    padded = np.concatenate([flat, np.zeros(SHINGLE, np.uint64)])
    value = np.zeros(len(first), np.uint64)
    for i in range(SHINGLE):
        inside = i < lengths[owner]
        value = _mixed(value * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[first + i], np.uint64(i + 1)))
    return value, owner


def _signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """ProbMinHash registers, one row per text.

    A shingle of weight w sends points at exponential times of rate w, each to a register
    chosen at random by its own hash; a register keeps the shingle whose point came first.
    Two texts agree in a register with the probability Jaccard similarity of their weights.
    A shingle stops as soon as its next point is later than every register of its text.
    """
    texts = len(starts) - 1
    value, owner = _shingles(flat, starts)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    weight = 1 + np.log(np.diff(np.append(first, len(value))))
    value, owner = value[first], owner[first]
    least = np.full(texts * REGISTERS, np.inf)
    kept = np.zeros(texts * REGISTERS, np.uint64)
    time, turn, live = np.zeros(len(value)), 0, np.arange(len(value))
    while len(live):
        turn += 1
        draw = _mixed(value[live] + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15))
        time[live] -= np.log(((draw >> np.uint64(11)).astype(float) + 1) / 2.0**53) / weight[live]
        place = owner[live] * REGISTERS + (_mixed(draw) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(least, place, time[live])
        won = least[place] == time[live]
        kept[place[won]] = value[live][won]
        last = least.reshape(texts, REGISTERS).max(axis=1)
        live = live[time[live] < last[owner[live]]]
    return kept.astype(np.uint32).view(np.int32).reshape(texts, REGISTERS)


def _blocks(column: pa.Array, words_at_once: int = 25_000):
    """Runs of texts with a bounded number of words, one text at least: word hashes, starts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + words_at_once, side="right")) - 1)
        j = min(j, n)
        yield flat[starts[i]:starts[j]], starts[i:j + 1] - starts[i]
        i = j


@arrow_udf(T.ArrayType(T.IntegerType()))
@trimmed
def signature(hashes: pa.Array) -> pa.Array:
    with np.errstate(over="ignore"):
        rows = [_signatures(*block) for block in _blocks(hashes)]
    flat = np.concatenate(rows) if rows else np.zeros((0, REGISTERS), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * REGISTERS, pa.int32()), pa.array(flat.ravel()))


@arrow_udf(T.ArrayType(T.LongType()))
@trimmed
def shingle_set(hashes: pa.Array) -> pa.Array:
    found = []
    with np.errstate(over="ignore"):
        for flat, starts in _blocks(hashes):
            value, owner = _shingles(flat, starts)
            cut = np.searchsorted(owner, np.arange(len(starts)))
            found += [np.unique(value[cut[i]:cut[i + 1]]).view(np.int64) for i in range(len(starts) - 1)]
    return pa.array(found, pa.list_(pa.int64()))


@arrow_udf(T.DoubleType())
@trimmed
def jaccard(left: pa.Array, right: pa.Array) -> pa.Array:
    scores = []
    for a, b in zip(left, right):
        a, b = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
        both = len(np.intersect1d(a, b, assume_unique=True))
        scores.append(both / max(1, len(a) + len(b) - both))
    return pa.array(scores, pa.float64())


def _bucket(depth: int) -> Column:
    """The bucket of band ``band`` at ``depth`` registers, counted on round the signature."""
    return F.xxhash64("band", F.slice(F.concat("sig", "sig"), F.col("band") * ROWS + 1, F.lit(depth)))


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes (node, sig) to verify, with ``weight``, how many bucket mates
    ``b`` has in all; and the large buckets (bucket, node, hub), of which not all pairs are given.

    A small bucket gives all its pairs. A large one would give a number that grows with the
    square of its size: there every member is paired with the hub alone, the member with
    the most bucket mates over all bands (in a group of copies, the text that they are
    copies of), and the bucket is cut by further registers until its parts are small. No
    bucket is gathered beyond ``SMALL`` entries, and the pairs grow as the members do. The
    links among members that this does not give are for ``remaining`` to find.
    """
    rows = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    rows = rows.select("node", "band", _bucket(ROWS).alias("bucket"))
    found, central, uncut, depths = None, None, None, [*DEPTHS]
    while True:
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        rows = stored(rows.join(sizes, "bucket"), "buckets")
        if central is None:
            central = stored(rows.groupBy("node").agg(F.sum("size").alias("weight")), "central")
        small = rows.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_set("node")).alias("n"))
        pairs = F.flatten(F.transform("n", lambda x, i: F.transform(F.slice("n", i + 2, SMALL), lambda y: F.struct(y.alias("a"), x.alias("b")))))
        pairs = small.select(F.inline(pairs))
        large = rows.where(F.col("size") > SMALL)
        hubs = large.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
        hubs = stored(hubs, "hubs")
        uncut = large.join(hubs, "bucket").select("bucket", "node", "hub") if uncut is None else uncut
        stars = large.join(hubs, "bucket").where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))
        found = pairs.union(stars) if found is None else found.union(pairs).union(stars)
        if not depths or not large.limit(1).count():
            break
        rows = large.select("node", "band").join(nodes, "node").select("node", "band", _bucket(depths.pop(0)).alias("bucket"))
    found = found.distinct()
    ranked = found.join(central.select(F.col("node").alias("a"), F.col("weight").alias("wa")), "a").join(central.select(F.col("node").alias("b"), F.col("weight").alias("wb")), "b")
    # The end with more bucket mates comes second.
    up = (F.col("wb") > F.col("wa")) | ((F.col("wb") == F.col("wa")) & (F.col("b") < F.col("a")))
    return ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("wa", "wb").alias("weight")), uncut


def remaining(large: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that can still be links among members of ``large`` buckets (bucket,
    node, hub) whose components, ``roots``, are not all the same.

    This is exact. A member is described by the shingles in which it differs from the hub of
    its bucket: what all have in common, however long and however many share it, is left out.
    Two sets of ``n`` and ``m`` shingles with a Jaccard similarity of 0.8 differ in
    ``d = (n + m) / 9`` shingles at most, so of their ``k`` and ``l`` differences from the hub
    ``o = (k + l - d) / 2`` are the same at least, and whatever order differences are put in,
    they share one of the first ``k - o + 1`` and ``l - o + 1``. The rarest come first, so few
    sets meet; pairs within a component are left out where they meet. Where no difference has to
    be shared, both are links of the hub, which ``candidates`` gives. No bucket or shingle is
    gathered.
    """
    placed = large.join(roots, "node", "left").select("bucket", "node", "hub", F.coalesce("root", "node").alias("root"))
    apart = placed.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    members = stored(placed.join(apart, "bucket", "left_semi").where("node <> hub").select("node", "hub", "root").distinct(), "apart")
    both = members.join(sets, "node").join(sets.toDF("hub", "t"), "hub")
    differ = both.select("hub", "node", "root", F.size("s").alias("n"), F.concat(F.array_except("s", "t"), F.array_except("t", "s")).alias("d"))
    entries = stored(differ.select("hub", "node", "root", "n", F.size("d").alias("k"), F.explode("d").alias("shingle")), "entries")
    # A difference of one set brings it together with no other, so it only takes a place.
    counts = entries.groupBy("hub", "shingle").agg(F.count("*").alias("f")).where("f > 1")
    own = ["hub", "node", "root", "n", "k"]
    shared = entries.join(counts, ["hub", "shingle"]).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("d"))
    # No other is larger than 5 / 4 of a set, and none with as many differences or more asks
    # for more than d + 1 places; those that no other set has come first.
    heads = shared.select(*own, F.posexplode("d.shingle").alias("i", "shingle"), (F.col("k") - F.size("d") + 1).alias("alone"))
    heads = stored(heads.select(*own, (F.col("i") + F.col("alone")).alias("at"), "shingle").where("at <= floor(n / 4) + 1"), "heads")
    other = heads.toDF("hub", "node_b", "root_b", "n_b", "k_b", "at_b", "shingle")
    near = F.least("n", "n_b") * 5 >= F.greatest("n", "n_b") * 4
    shares = F.expr("ceil((k + k_b - floor((n + n_b) / 9)) / 2)")
    first = (F.col("at") <= F.col("k") - shares + 1) & (F.col("at_b") <= F.col("k_b") - shares + 1)
    met = heads.join(other, ["hub", "shingle"]).where((F.col("node") > F.col("node_b")) & (F.col("root") != F.col("root_b")) & near & first)
    return met.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return one.where(jaccard("sa", "sb") >= SIMILARITY).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and class_id, the smallest doc_id
    of its class. Classes are the components of links: two texts are linked if their words
    are the same, or if the sets of their five-word shingles have a Jaccard similarity of
    0.8 or more.

    Equal texts become one node before anything is compared. Candidates come from banded
    signatures; of these, first each node's pair with its most connected partner is
    verified, then the pairs that still lie in different components, and then those of large
    buckets that were not listed and still do. Verification is exact.

    Null, empty and wordless texts are alone in their class, and so are rows without an id.
    Repeated rows are repeated in the result; an id that stands for several texts links
    them all. Texts of any length count whole; one of fewer than five words is one shingle.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", hashed(words(F.col("text"))).alias("h"))
    rows = rows.select("doc_id", F.size("h").alias("n"), F.xxhash64("h").alias("d1"), F.xxhash64(F.lit(1), "h").alias("d2"), signature("h").alias("sig"))
    base = stored(rows, "signatures")
    with_words = base.where("n > 0 AND doc_id IS NOT NULL")
    texts = stored(with_words.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "texts")
    own = with_words.select("doc_id", "d1", "d2", "sig").join(texts, ["d1", "d2"]).where("doc_id = node")
    nodes = stored(own.groupBy("node").agg(F.first("sig").alias("sig")), "nodes")
    pairs, large = candidates(nodes)
    pairs = stored(pairs, "candidates")
    needed = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "needed")
    # The filter keeps most texts that no pair needs from being sent to the join.
    ids = maybe_in(docs.select("doc_id", "text"), "doc_id", needed, "maybe").where("maybe").select("doc_id", "text")
    wanted = ids.join(needed, F.col("doc_id") == F.col("node"), "left_semi")
    sets = stored(wanted.select(F.col("doc_id").alias("node"), shingle_set(hashed(words(F.col("text")))).alias("s")), "shingles")
    first = pairs.groupBy("a").agg(F.max_by("b", F.struct("weight", -F.col("b"))).alias("b"))
    links = stored(_verified(first, sets), "links")
    roots = stored(components(links, "roots"), "roots")
    left = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    left = left.where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    for rest in (lambda: left, lambda: remaining(large, roots, sets)):
        more = stored(_verified(rest(), sets), "links")
        if more.limit(1).count():
            links = links.union(more)
            roots = stored(components(links, "roots"), "roots")
    classes = texts.join(roots, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("class_id"))
    found = base.select("doc_id", "d1", "d2", "n").join(classes, ["d1", "d2"], "left")
    return found.select("doc_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, all columns kept;
    rows without an id stay."""
    gone = near_duplicates(docs).where("doc_id <> class_id").select("doc_id").distinct()
    return without(docs, F.col("doc_id"), stored(gone, "copies"))
