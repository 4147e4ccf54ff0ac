"""Near-duplicate documents by ProbMinHash, banding and verification.

Sketch.  A text is the bag of its five-word shingles, weighted by how often they occur.  Every
shingle is a Poisson process whose rate is its weight; each arrival falls on a random
register, and a register keeps the shingle that arrived first.  A shingle stops as soon as its next
arrival is later than the latest first arrival of the sketch, so long texts cost about one
arrival per shingle.  Two texts agree in a register with the probability
Jaccard similarity of their weighted bags.  Texts that repeat a shingle have a second sketch with
all weights 1: there they agree with the plain Jaccard similarity.

Classes.  Equal texts are one node (its md5), so groups of copies collapse before anything
else.  Each band of registers is a bucket key; texts of one bucket are candidates.  Instead
of all pairs of a bucket, a round tests its members against few pivots and then contracts
what is linked: first the member with most bucket company, then the most connected
member that is still apart, then random pivots.  Members of buckets that still hold two classes then
meet by a prefix index (:func:`prefixes`): similar texts share a shingle among the rarest fifth of each,
so only members with such a shingle in common are paired.  No candidate pair is left untested unless its
texts are in one class already or cannot be similar, so classes are those of all pairs; groups of
thousands of near copies cost a few tests per member, and copies that were edited too much to be
similar to anything have rare shingles of their own and meet nobody.

Pairs that the shingles of one text alone rule out (:func:`may_link`, an exact bound) are not tested.

Verification is exact on the shingle bags (32-bit shingle hashes): a pair is linked when
its Jaccard similarity or its probability Jaccard similarity is at least 0.8.

Defined results: each row gets the smallest ``doc_id`` of its class.  A text of one to four words is
a single shingle; texts without a word are linked only to equal texts.  Rows
without a ``doc_id`` are linked to nothing and have class null.  Repeated rows are equal texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import blocks, durable, ship, stored, text_of

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4       # a pair at 0.8 shares no band with probability 3e-6
REGISTERS = BANDS * ROWS
SEED = 0x9E3779B97F4A7C15
#: Buckets of few members are tested whole in the second round; larger ones against pivots,
#: this many random ones in the third round; the fourth is the prefix index.
FEW = 8
CELLS = 64
RANDOM_PIVOTS = 8
COUNTERS = 1 << 18        # counters of shingle frequency, by hash: what the prefix index orders by

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 52-bit shingle hash), sorted, one row per occurrence."""
    t = pc.fill_null(texts, "")
    for c in "\t\n\x0b\x0c\r":
        t = pc.replace_substring(t, c, " ")
    cut = pc.split_pattern(t, " ")
    each = cut.flatten().dictionary_encode()
    names = each.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), U, len(names))
    which = each.indices.to_numpy()
    size = cut.value_lengths().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    if "" in names:
        real = which != names.index("")
        which, doc = which[real], doc[real]
    w = hashes[which]
    n = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(n) - n
    padded = np.concatenate([w, np.zeros(WORDS - 1, U)])
    place = np.arange(len(w)) - begin[doc]
    left = np.concatenate([n[doc] - place, np.zeros(WORDS - 1, np.int64)])  # words from here to the text's end
    h = np.zeros(len(w), U)
    for k in range(WORDS):
        # a word beyond the end counts as zero: only texts under five words have such shingles
        h = mix(h * U(SEED) + np.where(left[:len(w)] > k, padded[k:k + len(w)], U(0)) + U(k + 1))
    first = (left[:len(w)] >= WORDS) | (place == 0)
    key = (doc[first].astype(U) << U(52)) | (h[first] >> U(12))
    key.sort()
    return (key >> U(52)).astype(np.int64), key & U((1 << 52) - 1)


def sketch(doc: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """Registers (n x REGISTERS shingle hashes) of the weighted bags."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(doc))).astype(float)
    doc, element = doc[at], shingle[at]
    first = np.full(n * REGISTERS, np.inf)
    owner = np.zeros(n * REGISTERS, U)
    live, time = np.arange(len(doc)), np.zeros(len(doc))
    arrival = 0
    while len(live):
        arrival += 1
        r = mix(element[live] * U(SEED) + U(arrival))
        time = time + -np.log(((r >> U(11)).astype(float) + 0.5) / 2.0**53) / weight[live]
        s = mix(r + U(0xD1B54A32D192ED03))
        slot = doc[live] * REGISTERS + (((s & U(0xFFFFFFFF)) * U(REGISTERS)) >> U(32)).astype(np.int64)
        sooner = np.flatnonzero(time < first[slot])
        order = sooner[np.argsort(-time[sooner], kind="stable")]  # the earliest is written last
        first[slot[order]] = time[order]
        owner[slot[order]] = element[live[order]]
        latest = first.reshape(n, REGISTERS).max(axis=1)
        more = time < latest[doc[live]]  # a later arrival cannot be first any more
        live, time = live[more], time[more]
    return owner.reshape(n, REGISTERS)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band, the band's number included."""
    r = registers.reshape(len(registers), BANDS, ROWS)
    h = np.tile(np.arange(1, BANDS + 1, dtype=U), (len(registers), 1))
    for k in range(ROWS):
        h = mix(h * U(SEED) + r[:, :, k])
    return h.view(np.int64)


def bucket_keys(doc: np.ndarray, shingle: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text number of each, ascending): the band keys of the bags weighted by shingle counts and, for
    texts that repeat a shingle, those of the same process with all weights 1.  Without repeats
    the two are the same keys, so texts of either kind meet in the buckets of both."""
    some = np.flatnonzero(np.bincount(doc, minlength=n))
    keys = band_keys(sketch(doc, shingle, n))[some]
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (shingle[1:] == shingle[:-1])
    uneven = np.unique(doc[again])
    once = ~again & np.isin(doc, uneven)
    plain = band_keys(sketch(np.searchsorted(uneven, doc[once]), shingle[once], len(uneven))) if len(uneven) else keys[:0]
    of = np.concatenate([np.repeat(some, BANDS), np.repeat(uneven, BANDS)])
    every = np.concatenate([keys.ravel(), plain.ravel()])
    order = np.lexsort((every, of))
    of, every = of[order], every[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (every[1:] != every[:-1])
    return every[new], of[new]


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Exact test of two shingle bags (sorted 32-bit hashes, repeated as often as they occur)."""
    u, x = np.unique(a, return_counts=True)
    v, y = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    common = len(i)
    if not common:
        return False
    if common >= least * (len(u) + len(v) - common):
        return True
    # probability Jaccard: sum over common d of 1 / sum over d' of max(x' / x, y' / y)
    x, y = x.astype(float), y.astype(float)
    only_x, only_y = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    cx, cy = x[i], y[j]
    order = np.argsort(cx / cy, kind="stable")
    cx, cy = cx[order], cy[order]
    ratio = cx / cy
    start = np.searchsorted(ratio, ratio, "left")  # equal ratios count on the x side
    above = np.concatenate([np.cumsum(cx[::-1])[::-1], [0.0]])[start]
    below = np.concatenate([[0.0], np.cumsum(cy)])[start]
    p = (1 / ((above + only_x) / cx + (below + only_y) / cy)).sum()
    return bool(p >= least - 1e-12)


def node_key():
    return F.unhex(F.md5(text_of().cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands) of each document; bands is empty without a word."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for big in blocks(batch, 2):
                for k in range(0, len(big), 4096):  # the text number has 12 bits in the sort key
                    part = big.slice(k, 4096)
                    keys, of = bucket_keys(*shingles(part.column(2)), len(part))
                    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(part)))]).astype(np.int32)
                    bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), bands], names=["doc_id", "node", "bands"])

    return docs.select("doc_id", node_key().alias("node"), F.col("text")).mapInArrow(run, "doc_id long, node binary, bands array<long>")


def unique_shares(bag_rows: DataFrame) -> DataFrame:
    """(node, n, total, lone, lone_total, cells): distinct shingles and occurrences of each bag,
    those of them on shingles that no other bag has, and the distinct shingles by hash cell.

    A shingle is summed to (bags, one of them) before the shuffle; only shingles of one
    bag go on, so a shingle that all copies share costs one row per task.
    """

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                v, c = np.unique(np.frombuffer(batch.column(1)[i].as_buffer(), np.uint32), return_counts=True)
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(v), pa.binary()), pa.array(v.astype(np.int64)),
                                                      pa.array(c.astype(np.int64)), pa.array(np.full(len(v), len(v), np.int64)),
                                                      pa.array(np.full(len(v), c.sum(), np.int64))], names=["node", "shingle", "tf", "n", "total"])

    rows = bag_rows.select("node", "bag").mapInArrow(run, "node binary, shingle long, tf long, n long, total long")
    one = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("bags"), F.min(F.struct("node", "tf", "n", "total")).alias("o")).where(F.col("bags") == 1)

    def count_cells(batches):
        for batch in batches:
            found = [np.bincount(np.unique(np.frombuffer(x.as_buffer(), np.uint32)) % CELLS, minlength=CELLS).astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["node", "cells"])

    cells = bag_rows.select("node", "bag").mapInArrow(count_cells, "node binary, cells array<int>")
    lone = one.groupBy("o.node").agg(F.count(F.lit(1)).alias("lone"), F.sum("o.tf").alias("lone_total"))
    sizes = rows.select("node", "n", "total").groupBy("node").agg(F.max("n").alias("n"), F.max("total").alias("total"))
    return sizes.join(lone, "node", "left").fillna(0, ["lone", "lone_total"]).join(cells, "node")


def may_link(least: float = SIMILARITY):
    """Can a member and the pivot (columns ``s`` and ``t``: unique shares, or null) be similar?

    Common shingles are in two bags, so a bag's lone shingles bound both similarities.  With
    a = n - lone, Jaccard is at most min(a) / (n + n' - min(a)).  With C the share of a bag's
    occurrences on other shingles and U = 1 - C, probability Jaccard is at most
    C C' / (C' + U' C) and C C' / (C + U C').  Common shingles also fall in the same hash cells,
    so the sum of the smaller cell counts bounds their number and the Jaccard similarity; where no
    shingle repeats in either text both similarities are the Jaccard one and this bound holds
    for both.  The bounds are exact: they drop no link.
    """
    a = F.least(F.col("s.n") - F.col("s.lone"), F.col("t.n") - F.col("t.lone"))
    jaccard = a / (F.col("s.n") + F.col("t.n") - a)
    u, v = F.col("s.lone_total") / F.col("s.total"), F.col("t.lone_total") / F.col("t.total")
    c, d = 1 - u, 1 - v
    weighted = F.least(c * d / (d + v * c + 1e-12), c * d / (c + u * d + 1e-12))
    shared = F.aggregate(F.zip_with("s.cells", "t.cells", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    plain = (F.col("s.n") == F.col("s.total")) & (F.col("t.n") == F.col("t.total"))
    by_cell = shared / (F.col("s.n") + F.col("t.n") - shared)
    bound = F.greatest(F.least(jaccard, by_cell), F.when(plain, F.least(weighted, by_cell)).otherwise(weighted))
    return F.coalesce(bound >= least - 1e-9, F.lit(True))


def bags(docs: DataFrame) -> DataFrame:
    """(node, bag): the shingle bag as sorted 32-bit hashes."""

    def run(batches):
        for batch in batches:
            for big in blocks(batch, 1):
                for k in range(0, len(big), 4096):
                    part = big.slice(k, 4096)
                    doc, shingle = shingles(part.column(1))
                    low = (shingle >> U(20)).astype(np.uint32)
                    ends = np.cumsum(np.bincount(doc, minlength=len(part)))
                    raw = [low[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["node", "bag"])

    return docs.select("node", "text").mapInArrow(run, "node binary, bag binary")


def verified(pairs: DataFrame, bag_rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bags are similar."""

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [similar(np.frombuffer(x[i].as_buffer(), np.uint32), np.frombuffer(y[i].as_buffer(), np.uint32)) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    j = (pairs.join(bag_rows.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
         .join(bag_rows.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a"))
    return j.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a binary, b binary")


def shingle_counts(bag_rows: DataFrame) -> np.ndarray:
    """How many of the bags hold a shingle, summed over the shingles of one counter."""
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.unique(np.frombuffer(x.as_buffer(), np.uint32)) % COUNTERS, minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["slot", "n"])

    found = bag_rows.select("bag").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int64)                       # at most one row per counter
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def prefix_of(bag: np.ndarray, counts: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The shingles of one bag that an index must hold, rarest first.

    Of two similar texts take the rarest shingle they share, in an order that all texts use.  What comes
    before it in either text is not shared.  With a Jaccard similarity of ``least`` at most 1 - ``least``
    of a text's distinct shingles are not shared, with a probability Jaccard similarity of ``least`` at
    most 1 - ``least`` of its occurrences (that similarity is at most the shared part of either bag).  So
    the shared shingle lies in both prefixes: those with at most that much before them."""
    v, c = np.unique(bag, return_counts=True)
    order = np.lexsort((v, counts[v % COUNTERS]))
    v, c = v[order], c[order]
    rest = 1 - least + 1e-9
    return v[(np.arange(len(v)) <= rest * len(v)) | (np.cumsum(c) - c <= rest * c.sum())]


def prefixes(bag_rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(shingle, node, place): the prefix of each bag, with how many of its shingles are rarer."""
    def run(batches):
        for batch in batches:
            found = [prefix_of(np.frombuffer(x.as_buffer(), np.uint32), counts).astype(np.int64) for x in batch.column(1)]
            node = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            place = pa.array(np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in found)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), node, place], names=["shingle", "node", "place"])

    return bag_rows.select("node", "bag").mapInArrow(run, "shingle long, node binary, place long")


def rare_pairs(members: DataFrame, bag_rows: DataFrame) -> DataFrame:
    """(a, b): members (node, label, s) of different classes that share a shingle of their prefixes."""
    mine = bag_rows.join(members.select("node"), "node")
    side = members.select("node", "label", F.col("s.n").alias("n"), (F.col("s.n") == F.col("s.total")).alias("plain"))
    index = stored(prefixes(mine, shingle_counts(mine)).join(side, "node"))
    # a shingle of one member pairs nothing; the rest is stored, so that a busy shingle can be split
    busy = stored(index.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                   .where(F.col("lo") != F.col("hi")).select("shingle"))
    index = stored(index.join(busy, "shingle"))
    x, y = index.alias("x"), index.alias("y")
    # texts without repeated shingles are similar by one measure: they share at least this many, so at
    # most the rest of either stands before the first one that they share
    common = F.ceil((F.col("x.n") + F.col("y.n")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    sizes = ((F.col("x.place") <= F.col("x.n") - common) & (F.col("y.place") <= F.col("y.n") - common)) | ~F.col("x.plain") | ~F.col("y.plain")
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") > F.col("y.node"))
                   & (F.col("x.label") != F.col("y.label")) & sizes)
    pairs = stored(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    of = lambda c, to: members.select(F.col("node").alias(c), F.col("s").alias(to))
    return pairs.join(of("a", "s"), "a").join(of("b", "t"), "b").where(may_link()).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node of its component.

    Alternating large-star and small-star steps; each step is a grouped minimum whose
    partial form runs before the shuffle, and edges are checkpointed between rounds.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where(F.col("b") < F.col("a"))
        # stored: a join of two plain shuffles can split a node with very many neighbours
        low = stored(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m")))
        moved = near.join(low, F.col("a") == F.col("c"))
        if large:
            return moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # b joins a's smallest neighbour, and so does a itself
        return (moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                .union(low.select(F.col("c").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b")))

    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    mark = None
    while True:
        e = stored(star(star(e, True), False).distinct())
        # a finished graph is a set of stars: every node has one neighbour, a centre
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b"), F.col("b")).distinct())
        mark = (now["n"], now["h"])


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs`` (doc_id, text)."""
    return _classes(docs).select("doc_id", "class_id")


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, node, label): also the text's node and its component."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sig = durable(signatures(docs))
    nodes = durable(sig.where(F.col("doc_id").isNotNull()).groupBy("node")
                    .agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")))
    members = _buckets(nodes)
    label = _link(docs, nodes, members)
    # class of a node: the smallest id of its component
    named = nodes.select("node", "rep").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    low = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    of_node = named.select("node", "label").join(low, "label").select("node", "label", "class_id")
    # equal texts are one key here: the many side is split by the skew join, the few side is one row
    return (sig.select("doc_id", "node").join(of_node, "node", "left")
            .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "node", "label"))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, company): members of buckets of two texts or more; buckets with the
    same members count once; ``company`` is how many others the node meets in all."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    size = (rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"),
                                       F.min("node").alias("m"))
            .where(F.col("n") >= 2))
    once = size.groupBy("n", "same", "m").agg(F.min("bucket").alias("bucket"), F.count(F.lit(1)).alias("times")).select("bucket", "n", "times")
    kept = durable(rows.join(once, "bucket"))
    company = kept.groupBy("node").agg(F.sum((F.col("n") - 1) * F.col("times")).alias("company"))
    return durable(kept.select("bucket", "node", "n").join(company, "node"))


def _hubs(links: DataFrame) -> DataFrame:
    """(node, label): a node of the same component for every linked node; not yet the same
    one for the whole component.  Each node looks to the neighbour with most links, then to
    that one's choice, so a star gets one label in one step."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = stored(both.groupBy("a").agg(F.count(F.lit(1)).alias("d")))
    seen = both.join(degree.select(F.col("a").alias("b"), "d"), "b").groupBy("a").agg(F.max(F.struct("d", F.col("b").alias("to"))).alias("n"))
    choice = durable(seen.join(degree, "a").select("a", F.greatest("n", F.struct("d", F.col("a").alias("to")))["to"].alias("to")))
    return (choice.join(choice.select(F.col("a").alias("to"), F.col("to").alias("label")), "to")
            .select(F.col("a").alias("node"), "label"))


def _link(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, label) of all nodes that are linked to another one."""
    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    bag_rows = durable(bags(docs.withColumn("node", node_key()).join(wanted.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"])
                            .select("node", "text")).dropDuplicates(["node"]))
    # unique shares of the members of large buckets: what cannot be similar is never paired there
    large = members.where(F.col("n") > FEW).select("node").distinct()
    shares = unique_shares(bag_rows.join(large, "node")).select("node", F.struct("n", "total", "lone", "lone_total", "cells").alias("s"))
    members = durable(members.join(shares, "node", "left"))
    links = tested = used = None
    for turn in range(4):
        m = members if links is None else members.join(_hubs(links), "node", "left")
        m = m.withColumn("label", F.coalesce("label", "node") if links is not None else F.col("node"))
        if turn:
            # only buckets that still hold two classes; those of few members are done after turn 1
            m = m if turn == 1 else m.where(F.col("n") > FEW)
            split = m.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
            # stored first: only a join of two plain shuffles can split a hot bucket
            split = durable(split.where(F.col("lo") != F.col("hi")).select("bucket"))
            m = durable(m.join(split, "bucket"))
            if m.isEmpty():
                break
        rank = F.struct("company", "node", "label", "s")
        top = lambda x: x.groupBy("bucket").agg(F.max(rank).alias("p")).select(
            "bucket", F.col("p.node").alias("pivot"), F.col("p.label").alias("with"), F.col("p.s").alias("t"))
        as_pivots = lambda x: x.select("bucket", F.col("node").alias("pivot"), F.col("label").alias("with"), F.col("s").alias("t"))
        if turn == 0:
            p = used = durable(top(m))
        elif turn == 1:  # large buckets: the most connected member outside the first pivot's class
            old = used.select("bucket", "pivot").join(as_pivots(m), ["bucket", "pivot"]).select("bucket", F.col("with").alias("old"))
            p = top(m.where(F.col("n") > FEW).join(old, "bucket").where(F.col("label") != F.col("old")))
            p = p.union(as_pivots(m.where(F.col("n") <= FEW)))
        elif turn == 2:
            p = as_pivots(m.where(F.pmod(F.xxhash64("node", F.lit(SEED % 1000)), F.col("n")) < RANDOM_PIVOTS))
        if turn < 3:
            pairs = (m.join(p, "bucket").where((F.col("label") != F.col("with")) & may_link())
                     .select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct())
        else:
            pairs = rare_pairs(durable(m.dropDuplicates(["node"]).select("node", "label", "s")), bag_rows)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        # tables, not checkpoints: a checkpoint hands on the constraints of its plan, and the planner multiplies them
        pairs = stored(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        new = stored(verified(pairs, bag_rows))
        links = new if links is None else links.union(new)
    return components(links)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, same columns: of each class only the text with the smallest id
    (one row of it); rows without an id stay."""
    # the class's representative: its smallest id, and of that id's texts in the class the first node
    keep = (_classes(docs.select("doc_id", "text")).where(F.col("doc_id") == F.col("class_id"))
            .groupBy("doc_id", "label").agg(F.min("node").alias("keep_node")).select(F.col("doc_id").alias("keep_id"), "keep_node"))
    stay = (docs.where(F.col("doc_id").isNotNull())
            .join(keep, (F.col("doc_id").cast("long") == F.col("keep_id")) & (node_key() == F.col("keep_node")), "left_semi")
            .withColumn("keep_node", node_key()).dropDuplicates(["doc_id", "keep_node"]))
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return classes(docs)
