"""Exact self-join of texts on the Jaccard similarity of their word n-gram sets.

Texts with equal sets form one class; classes are joined.  Two sets that reach
the similarity differ in at most H elements, a bound that follows from their
sizes.  Sets are handled in bands of size.  A hash deals the universe of
elements to more than H units, so that one group of units at least differs in
fewer elements than it has units, and two sets are compared only if they agree
on a signature of such a group:

* ``exact``: one unit, one signature of all its elements;
* ``subset``: two units, one signature per two of its three parts;
* ``deletion``: two units, one signature of the group and one per group with
  one element deleted.

The split of a band's units among the kinds is the one of least cost, counted
in signatures and expected false candidates.  Groups with next to no elements
say little; a set leaves such signatures out as long as the units that it
leaves out stay within an allowance by which the units exceed H + 1.

Candidates are compared with the least member of their signature, its hub, first.
Where different components are left around a hub, pairs across these follow, in
blocks.  Both are done inside tasks, in two steps: a parity sketch gives a lower
bound of the difference, and the rows that may have a link come back with their
sets and are verified exactly (``pairwise``).  A task gives back no more links than
connect what it holds.  Nothing is sampled or capped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from . import pairwise as P
from .common import BROADCAST_BYTES, bounded_batches, broadcast_hot, cut, discard, maybe_among, release
from .pairwise import sketch

EXACT, SUBSET, DELETION = 0, 1, 2


@dataclass(frozen=True)
class Options:
    """k: words of an n-gram; num, den: the least similarity, num / den; hit_rate: assumed chance that two unrelated
    sets share a given element; common_share: assumed share of elements that any other set has; verify_cost,
    compare_cost: cost of verifying and of comparing the sketches of a candidate pair, in signatures; filter_bits: size
    of the bit table that keeps unshared signatures out of the second pass (a power of two); block_bytes: sketches, or
    sets, of one side that are compared in one task (a single longer one is alone)."""

    k: int = 3
    num: int = 90
    den: int = 100
    hit_rate: float = 0.002
    verify_cost: float = 3.0
    compare_cost: float = 0.002
    common_share: float = 0.1
    filter_bits: int = 1 << 25
    block_bytes: int = 4 << 20

    @property
    def band_ratio(self) -> float:
        """Of a band's largest to its least size: wide against the ratio of similar sets' sizes, as a set near a bound
        has the signatures of two bands."""
        return 1 + 4 * (self.den - self.num) / self.den


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    exact: int
    subset: int
    deletion: int
    spare: int
    small: int

    @property
    def units(self) -> int:
        return self.exact + 2 * (self.subset + self.deletion)

    @property
    def slots(self) -> int:
        return self.exact + 3 * self.subset + self.deletion


def difference(total: int, options: Options) -> int:
    """Most elements in which two similar sets of ``total`` elements together can differ."""
    return total * (options.den - options.num) // (options.den + options.num)


def _tail(mean: float, upto: int) -> float:
    """Chance that a Poisson number is at most ``upto``."""
    return sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(upto + 1))


def _hits(mean: float, small: int, q: float) -> float:
    """Chance that an unrelated set agrees on a signature of more than ``small`` elements, Poisson with that mean."""
    return max(0.0, math.exp(-mean * (1 - q)) - sum(math.exp(-mean) * (mean * q) ** i / math.factorial(i) for i in range(small + 1)))


def allocate(low: int, high: int, rows: int, options: Options) -> Band:
    """The cheapest units of a band among the kinds, for so many rows."""
    need = difference(2 * high, options) + 1
    best = None
    for small in (2, 1, 0, -1):
        for kind in (SUBSET, DELETION):
            for share in (1.0, 0.75, 0.5, 0.25, 0.0):
                spare = 0
                for _ in range(6):  # the allowance raises the number of units, which shortens them
                    units = need + spare
                    groups = int((1 - share) * units) // 2
                    single = units - 2 * groups
                    s = low / units
                    part = _tail(4 * s / 3, small) * 3 if kind == SUBSET else _tail(2 * s, small)
                    lost = single * _tail(s, small) + 2 * groups * min(1.0, part)
                    wanted = math.ceil(lost + 3 * math.sqrt(2 * lost)) if small >= 0 else 0
                    if wanted <= spare:
                        break
                    spare = wanted
                    if spare > need:
                        break
                if wanted > spare or spare > need:
                    continue
                q, s = options.hit_rate, math.sqrt(low * high) / units

                def price(chance):
                    """Of one signature: its row, its pair with the least member, its pairs with all others."""
                    others = rows * chance
                    return 1 + options.verify_cost * min(options.common_share, others) + options.compare_cost * others

                cost = single * price(_hits(s, small, q))
                cost += 3 * groups * price(_hits(4 * s / 3, small, q)) if kind == SUBSET else groups * (2 * s + 1) * price(_hits(2 * s, small + 1, q) / q)
                band = Band(low, high, single, groups if kind == SUBSET else 0, groups if kind == DELETION else 0, spare, small)
                if best is None or cost < best[0]:
                    best = (cost, band)
    return best[1]


def bands(rows: int, largest: int, options: Options) -> list[Band]:
    out, low = [], 1
    while low <= largest:
        high = max(low, math.ceil(low * options.band_ratio) - 1)
        out.append(allocate(low, high, rows, options))
        low = high + 1
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, n of each row): per row the sorted distinct hashes of its n-grams; a row of fewer words, but not
    none, has its whole sequence as the only one."""
    own = K.ascii_lower(data)
    starts, ends, rows = K.words(own, offsets, K.NOT_SPACE)
    hashes = K.word_hashes(own, starts, ends)
    n = len(offsets) - 1
    gram, at = K.gram_hashes(hashes, rows, k)
    row = rows[at]
    words = np.bincount(rows, minlength=n)
    first = np.cumsum(words) - words
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        whole = np.zeros(len(short), K.U)
        for j in range(k - 1):
            more = words[short] > j
            whole[more] = K.splitmix(whole[more] ^ hashes[first[short[more]] + j])
        gram = np.concatenate([gram, K.splitmix(whole ^ K.U(0xABCD))])
        row = np.concatenate([row, short])
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[keep], np.bincount(row[keep], minlength=n).astype(np.int64)


def signatures(elements: np.ndarray, n: np.ndarray, plan: list[Band], options: Options) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, row of each).  A set has those of its own band and of each higher band in which a similar larger
    set may be, as the band of the larger set is the one in which two sets meet."""
    first = np.cumsum(n) - n
    lows = np.array([b.low for b in plan])
    top = np.searchsorted(lows, n * options.den // options.num, side="right") - 1
    own = np.searchsorted(lows, n, side="right") - 1
    sig, of = [], []
    for extra in range(int((top - own).max(initial=0)) + 1):
        for b in np.unique(own[(n > 0) & (own + extra <= top)] + extra):
            rows = np.flatnonzero((n > 0) & (own + extra == b) & (b <= top))
            s, r = _band_signatures(elements, first, n, rows, int(b), plan[b])
            sig.append(s)
            of.append(r)
    if not sig:
        return np.zeros(0, K.U), np.zeros(0, np.int64)
    return np.concatenate(sig), np.concatenate(of)


def _band_signatures(elements, first, n, rows, b: int, band: Band):
    size = n[rows]
    at = np.repeat(first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
    who = np.repeat(np.arange(len(rows)), size)
    e = elements[at]
    mixed = K.splitmix(e ^ K.U(0x5BD1E995))
    unit = (K.splitmix(e ^ K.U(b + 1)) % K.U(band.units)).astype(np.int64)
    pair = (unit - band.exact) >> 1
    third = (mixed % K.U(3)).astype(np.int64)
    grouped = band.exact + (3 * pair + third if band.subset else pair)
    slot = np.where(unit < band.exact, unit, grouped)
    width = band.slots
    index = who * width + slot
    total = np.zeros(len(rows) * width, K.U)
    np.add.at(total, index, mixed)
    count = np.bincount(index, minlength=len(total)).reshape(len(rows), width)
    total = total.reshape(len(rows), width)
    tag = K.splitmix(np.arange(2 * width + 2, dtype=K.U) + K.U((b + 1) << 32))
    sums, sizes, weights, tags = [total[:, : band.exact]], [count[:, : band.exact]], [np.ones(band.exact, np.int64)], [tag[: band.exact]]
    if band.subset:
        t, c = total[:, band.exact :].reshape(len(rows), -1, 3), count[:, band.exact :].reshape(len(rows), -1, 3)
        for j, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
            sums.append(t[:, :, x] + t[:, :, y])
            sizes.append(c[:, :, x] + c[:, :, y])
            weights.append(np.full(band.subset, 2, np.int64))
            tags.append(K.splitmix(tag[band.exact + 3 * np.arange(band.subset)] + K.U(j)))
    if band.deletion:
        sums.append(total[:, band.exact :])
        sizes.append(count[:, band.exact :])
        weights.append(np.full(band.deletion, 2, np.int64))
        tags.append(tag[band.exact : width])
    sums, sizes, weights, tags = np.concatenate(sums, 1), np.concatenate(sizes, 1), np.concatenate(weights), np.concatenate(tags)
    # A deletion group's signatures may miss one element, so it counts as small already with one more.
    limit = np.full(sums.shape[1], band.small)
    if band.deletion:
        limit[-band.deletion :] += band.small >= 0
    small = sizes <= limit
    lost = (small * weights).sum(1)  # a subset group with several small signatures counts several times: on the safe side
    out = ~small | (lost > band.spare)[:, None]
    final = K.splitmix(sums * K.U(0x9FB21C651E98DF25) + tags)
    r, c = np.nonzero(out)
    result, of = [final[r, c]], [rows[r]]
    if band.deletion:
        d = np.flatnonzero(slot >= band.exact)
        column = sums.shape[1] - band.deletion + slot[d] - band.exact
        d, column = d[out[who[d], column]], column[out[who[d], column]]
        result.append(K.splitmix((sums[who[d], column] - mixed[d]) * K.U(0x9FB21C651E98DF25) + tags[column]))
        of.append(rows[who[d]])
    return np.concatenate(result), np.concatenate(of)


def sketch_words(n: int, options: Options) -> int:
    """64-bit words of the parity sketch of a set of n elements: a power of two, at least 4 bits per allowed difference.
    At that length unrelated sets differ in some twice as many bits as are allowed, and sets at three quarters of the
    allowed similarity in more; what passes besides is verified exactly."""
    return 1 << max(0, math.ceil(math.log2(max(1, 4 * difference(2 * n, options)) / 64)))


SLIM = "doc_id {id}, doc_key long, n long, set_a long, set_b long, sketch array<long>"


def _names(elements: np.ndarray, bound: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit name of each set: the sum of its mixed elements."""
    c = np.concatenate((np.zeros(1, K.U), np.cumsum(K.splitmix(elements ^ K.U(seed)), dtype=K.U)))
    return (c[bound[1:]] - c[bound[:-1]]).view(np.int64)


#: Bits of a signature that are kept: sets that agree in these only are candidates like others.
SIGNATURE_BITS = 48
#: Signatures that a task holds before it sends them on, and about as many as come together in one group.
HELD = 1 << 20


def _signed(batches, plan: list[Band], options: Options):
    """(names of sets, signatures, set of each) of texts, chunk by chunk."""
    for batch in batches:
        data, offsets, _ = K.utf8_column(batch.column(0))
        for a, b in K.chunks(offsets):
            elements, n = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], options.k)
            sig, of = signatures(elements, n, plan, options)
            yield _names(elements, np.concatenate(([0], np.cumsum(n))), 1), sig >> K.U(64 - SIGNATURE_BITS), of


PACKED = "part int, first long, width int, steps binary, names binary"


def _pack(sig: np.ndarray, names: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """Sorted signatures (and names of their sets) dealt to parts by range: of each part the first signature, and the
    steps from one to the next in four bytes where they fit."""
    cuts = np.searchsorted(sig * K.U(parts) >> K.U(SIGNATURE_BITS), np.arange(parts + 1))
    part = np.flatnonzero(np.diff(cuts))
    steps, width, held = [], [], []
    for a, b in zip(cuts[part], cuts[part + 1], strict=True):
        step = np.diff(sig[a:b])
        width.append(4 if int(step.max(initial=0)) < 1 << 32 else 8)
        steps.append(step.astype(f"<u{width[-1]}").tobytes())
        held.append(b"" if names is None else names[a:b].tobytes())
    columns = [pa.array(part, pa.int32()), pa.array(sig[cuts[part]].view(np.int64)), pa.array(width, pa.int32()), pa.array(steps, pa.binary()), pa.array(held, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])


def _unpack(table: pa.Table) -> np.ndarray:
    out = []
    for first, width, steps in zip(*(table.column(c) for c in ("first", "width", "steps")), strict=True):
        step = np.frombuffer(steps.as_buffer(), f"<u{width.as_py()}").astype(K.U)
        out.append(K.U(first.as_py()) + np.concatenate((np.zeros(1, K.U), np.cumsum(step, dtype=K.U))))
    return np.concatenate(out)


def _in_lots(found):
    """(signatures, names), each lot of about HELD sorted by signature."""
    sig, names, n = [], [], 0
    for s, m in found:
        sig.append(s)
        names.append(m)
        n += len(s)
        if n >= HELD:
            s, m, sig, names, n = np.concatenate(sig), np.concatenate(names), [], [], 0
            order = np.argsort(s)
            yield s[order], m[order]
    if n:
        s, m = np.concatenate(sig), np.concatenate(names)
        order = np.argsort(s)
        yield s[order], m[order]


def encode(docs: DataFrame, options: Options) -> DataFrame:
    """Per document of (doc_id, doc_key, text): the size, a 128-bit name and a sketch of its set."""

    def run(batches):
        for batch in batches:
            data, offsets, _ = K.utf8_column(batch.column(2))
            for a, b in K.chunks(offsets):
                elements, n = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], options.k)
                bound = np.concatenate(([0], np.cumsum(n)))
                sketches = [sketch(elements[bound[i] : bound[i + 1]], sketch_words(int(n[i]), options)) for i in range(b - a)]
                at = np.concatenate(([0], np.cumsum([len(x) for x in sketches]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(n),
                        pa.array(_names(elements, bound, 1)),
                        pa.array(_names(elements, bound, 2)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64))),
                    ],
                    names=["doc_id", "doc_key", "n", "set_a", "set_b", "sketch"],
                )

    return docs.mapInArrow(run, SLIM.format(id=docs.dtypes[0][1]))


def sets_of(docs: DataFrame, wanted: DataFrame, options: Options) -> DataFrame:
    """(row, elements) of the wanted rows (row, doc_id, doc_key), computed again from their texts.

    Only texts that may be wanted are shuffled: a bit table of bounded size says so where they are read."""
    wanted = cut(wanted)
    w = wanted.select("row", F.col("doc_id").alias("w_id"), F.col("doc_key").alias("w_key"))
    some = maybe_among(docs, F.xxhash64("doc_id", "doc_key"), wanted.select(F.xxhash64("doc_id", "doc_key").alias("h")), wanted.count())
    # Repeated rows give the same set several times.
    texts = some.join(w, some["doc_id"].eqNullSafe(w["w_id"]) & (some["doc_key"] == w["w_key"])).groupBy("row").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets, _ = K.utf8_column(batch.column(1))
            for a, b in K.chunks(offsets):
                elements, n = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], options.k)
                bound = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([elements[bound[i] : bound[i + 1]].tobytes() for i in range(b - a)], pa.binary())], names=["row", "elements"]
                )

    return texts.mapInArrow(run, "row long, elements binary")


def _forest(batches):
    """A partition's edges (a, b) as stars (u, v) with the same components, v the least row of each."""
    for batch in batches:
        a, b = (np.asarray(c) for c in batch.columns)
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while len(a):
            m = np.minimum(least[a], least[b])
            before = least.copy()
            for end in (a, b, before[a], before[b]):
                np.minimum.at(least, end, m)
            least = least[least]
            if (least == before).all():
                break
        far = np.flatnonzero(least < np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[least[far]])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(row, root) of all rows with a link (a, b); the root is the least row reachable.

    Each task first replaces its links by stars.  Then large-star and small-star steps in turn: rounds grow with the
    logarithm of the longest path, and each has one row per link at most.  Edges point from a greater row to a lesser.
    """
    edges = cut(links.select("a", "b").where("a <> b").mapInArrow(_forest, "u long, v long").distinct())
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        state = nodes.agg(F.max((F.col("up") > 1) | (F.col("up") * F.col("down") > 0)).alias("open"), F.max("down").alias("most"), F.sum("down").alias("total")).first()
        if not state["open"]:  # each row has one edge, and no root has one
            break
        up = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        # A row that holds many edges is joined apart; it need not have an edge of its own.
        sizes = edges.groupBy("v").agg(F.count(F.lit(1)).alias("size"))
        parents = sizes.join(up, "v", "left")
        large = broadcast_hot(edges, parents, ["v"], "size", state["total"], state["most"]).select("u", F.coalesce("m", "v").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        discard(edges)
        edges = new
    roots = edges.select(F.col("v").alias("row")).distinct().withColumn("root", F.col("row"))
    return edges.select(F.col("u").alias("row"), F.col("v").alias("root")).unionByName(roots)


# Rows around a hub: hub, row, n, root, sketch, centre (whether the row is the hub that others are compared with).
AROUND = "hub long, row long, n long, root long, sketch array<long>, centre boolean"
# They are dealt with the length of the sketch only; sketches and sets join them in front of the task that compares.
DEALT = "hub long, row long, n long, root long, words int, centre boolean"


def _tasks(total, limit: int):
    return F.pmod(F.xxhash64("hub", "i", "j"), F.lit(max(1, int(total or 0) // limit))).alias("task")


def deal_star(rows: DataFrame, weight, limit: int) -> DataFrame:
    """Each hub's centre against its other rows, these in blocks of about ``limit`` bytes (``weight`` is a row's).

    Adds i, j (the part), side and task.  The centre is repeated once per block, so rows grow in proportion."""
    columns, rows = rows.columns, rows.withColumn("bytes", weight)
    sizes = cut(rows.where("not centre").groupBy("hub").agg(F.sum("bytes").alias("size")))
    total, most = sizes.agg(F.sum("size"), F.max("size")).first()
    blocks = sizes.select("hub", "size", F.ceil(F.col("size") / limit).cast("int").alias("blocks"))
    others = broadcast_hot(rows.where("not centre"), blocks, ["hub"], "size", total, most).withColumn("i", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    centres = rows.where("centre").join(blocks, "hub").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sided = others.withColumn("side", F.lit(P.RIGHT)).unionByName(centres.withColumn("side", F.lit(P.LEFT))).withColumn("j", F.lit(-1))
    return sided.select(*columns, "i", "j", "side", _tasks(total, limit // 2))


def deal_across(rows: DataFrame, weight, limit: int) -> DataFrame:
    """All rows of a hub against those of other roots, in pairs of blocks of about ``limit`` bytes.

    Rows of a root that alone fills more than a block get blocks of their own, which are not compared with each other:
    a large group of near copies grows in proportion once it is known to be one."""
    columns, rows = rows.columns, rows.withColumn("bytes", weight)
    per = cut(rows.groupBy("hub", "root").agg(F.sum("bytes").alias("size")))
    own = F.when(F.col("size") > limit, F.ceil(F.col("size") / limit))
    light = F.sum(F.when(F.col("size") <= limit, F.col("size")))
    hubs = per.groupBy("hub").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("roots"), F.ceil(F.coalesce(light, F.lit(0)) / limit).cast("int").alias("mixed"), F.coalesce(F.sum(own), F.lit(0)).cast("int").alias("pure"))
    hubs = cut(hubs.where("roots > 1").select("hub", "size", "mixed", (F.col("mixed") + F.col("pure")).alias("blocks")))
    total, most, dealt = hubs.agg(F.sum("size"), F.max("size"), F.sum(F.col("size") * F.col("blocks"))).first()
    if not total or most <= limit:  # every hub is one block
        alone = rows.join(hubs.select("hub"), "hub", "left_semi").withColumn("i", F.lit(0)).withColumn("j", F.lit(0)).withColumn("side", F.lit(P.BOTH))
        return alone.select(*columns, "i", "j", "side", _tasks(total, limit // 2))
    k = F.ceil(F.col("size") / limit).cast("int")
    before = F.sum("k").over(W.partitionBy("hub").orderBy("root").rowsBetween(W.unboundedPreceding, -1))
    pure = per.where(F.col("size") > limit).withColumn("k", k).join(hubs.select("hub", "mixed"), "hub")
    pure = cut(pure.select("hub", "root", "size", "k", (F.col("mixed") + F.coalesce(before, F.lit(0))).cast("int").alias("base")))
    placed = broadcast_hot(rows, hubs, ["hub"], "size", total, most).drop("size")
    placed = broadcast_hot(placed, pure, ["hub", "root"], "size", total, most, "left")
    number = F.xxhash64("row")
    placed = placed.withColumn("own", F.when(F.col("k").isNotNull(), F.col("base") + F.pmod(number, F.greatest("k", F.lit(1)))).otherwise(F.pmod(number, F.greatest("mixed", F.lit(1)))).cast("int"))
    foreign = lambda w: F.col("k").isNull() | (w < F.col("base")) | (w >= F.col("base") + F.col("k"))
    paired = placed.withColumn("with", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), foreign)))
    paired = paired.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with"))
    side = F.when(F.col("own") == F.col("with"), P.BOTH).when(F.col("own") < F.col("with"), P.LEFT).otherwise(P.RIGHT)
    return paired.select(*columns, "i", "j", side.alias("side"), _tasks(dealt, 2 * limit))


def linked(rows: DataFrame, deal, sets, options: Options, every: bool = False, sketches: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among rows around common hubs, dealt to tasks by ``deal``.  The rows are as AROUND, or as DEALT with
    ``sketches`` (row, sketch) apart; sets: gives (row, elements) of some rows.  Not every: only links that join different
    roots, no more of a task than it takes to connect what it holds."""
    if sketches is None:
        sketches = rows.select("row", "sketch").dropDuplicates(["row"])
        rows = rows.withColumn("words", F.size("sketch")).drop("sketch")
    columns = [c.split()[0] for c in DEALT.split(", ")]

    def look(table: pa.Table) -> pa.Table:
        K.trim_memory()
        plain, parts = P.parts_of(table)
        sketches, keep = P.Sketches(P.one_array(table, "sketch")), np.zeros(table.num_rows, bool)
        for part in parts:
            keep[P.open_rows(plain["n"], plain["root"], plain["side"], sketches, part, options)] = True
        return table.select(columns).filter(pa.array(keep))

    def prove(table: pa.Table) -> pa.Table:
        K.trim_memory()
        plain, parts = P.parts_of(table)
        elements = P.one_array(table, "elements")
        again = [sketch(np.frombuffer(x.as_buffer(), K.U), w) for x, w in zip(elements, plain["words"].tolist(), strict=True)]
        at = np.concatenate(([0], np.cumsum(plain["words"]))).astype(np.int32)
        sketches = P.Sketches(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(again) if again else np.zeros(0, np.int64))))
        a, b = [], []
        for part in parts:
            own = {int(x): np.frombuffer(elements[int(x)].as_buffer(), K.U) for x in part}
            for x, found in P.links(plain["n"], plain["root"], plain["side"], sketches, own, part, options, every):
                a.append(np.full(len(found), plain["row"][x]))
                b.append(plain["row"][found])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    sketch_bytes = 8 * F.col("words") + 64
    some = cut(deal(rows, sketch_bytes, options.block_bytes).join(sketches, "row").groupBy("task").applyInArrow(look, DEALT).dropDuplicates(["hub", "row"]))
    full = deal(some, 8 * F.col("n") + sketch_bytes, options.block_bytes).join(sets(some.select("row").distinct()), "row")
    found = cut(full.groupBy("task").applyInArrow(prove, "a long, b long").distinct())
    discard(some)
    return found


def once(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents (doc_id, doc_key, text), of which one of each text stays at least: copies have the same signatures.
    Rows whose ids have one hash stay together.  rows: their (doc_id, doc_key, n)."""
    copied = rows.where("n > 0").groupBy("doc_key").agg(F.min(F.xxhash64("doc_id")).alias("keeper"), F.count(F.lit(1)).alias("copies"))
    copied = cut(copied.where("copies > 1"))
    many, total, most = copied.agg(F.count(F.lit(1)), F.sum("copies"), F.max("copies")).first()
    first = F.col("copies").isNull() | (F.xxhash64("doc_id") == F.col("keeper"))
    if many * 64 <= BROADCAST_BYTES:
        return docs.join(F.broadcast(copied), "doc_key", "left").where(first).select(*docs.columns)
    maybe, sure = maybe_among(docs, F.col("doc_key"), copied.select(F.col("doc_key").alias("h")), many, rest=True)
    return sure.unionByName(broadcast_hot(maybe, copied, ["doc_key"], "copies", total, most, "left").where(first).select(*docs.columns))


def repeated_signatures(docs: DataFrame, plan: list[Band], options: Options, parts: int) -> np.ndarray:
    """A bit table of fixed size that holds all signatures which two documents have.

    Signatures alone are shuffled, without their sets and packed by range; a task sends each of a lot twice at most.
    The table goes by the signatures' upper bits, so a range has its own words, and no more reach the driver."""
    shift = SIGNATURE_BITS - (options.filter_bits.bit_length() - 1)

    def run(batches):
        for sig, _ in _in_lots((sig, np.zeros(len(sig), np.int8)) for _, sig, _ in _signed(batches, plan, options)):
            keep = np.ones(len(sig), bool)
            keep[2:] = sig[2:] != sig[:-2]
            yield _pack(sig[keep], None, parts)

    def words(table: pa.Table) -> pa.Table:
        K.trim_memory()
        sig = np.sort(_unpack(table))
        at = sig[1:][sig[1:] == sig[:-1]] >> K.U(shift)
        word, first = np.unique(at >> K.U(6), return_index=True)
        bits = np.bitwise_or.reduceat(K.U(1) << (at & K.U(63)), first) if len(at) else at
        return pa.table({"word": word.view(np.int64), "bits": bits.view(np.int64)})

    found = docs.select("text").mapInArrow(run, PACKED).groupBy("part").applyInArrow(words, "word long, bits long").toArrow()
    table = np.zeros(options.filter_bits >> 6, np.int64)
    np.bitwise_or.at(table, found["word"].to_numpy(), found["bits"].to_numpy())
    return table.view(K.U)


def around_hubs(docs: DataFrame, repeated: np.ndarray, plan: list[Band], options: Options, parts: int) -> DataFrame:
    """(hub, cls): names of sets and of the least set that has a signature in common, the hub itself included.

    Signatures are computed again, as they would take more space than the texts, and those that the bit table does not
    hold are left out where they are computed."""
    shift = SIGNATURE_BITS - (options.filter_bits.bit_length() - 1)
    held = docs.sparkSession.sparkContext.broadcast(repeated.tobytes())

    def run(batches):
        table = np.frombuffer(held.value, K.U)

        def found():
            for names, sig, of in _signed(batches, plan, options):
                at = sig >> K.U(shift)
                keep = ((table[at >> K.U(6)] >> (at & K.U(63))) & K.U(1)).astype(bool)
                yield sig[keep], names[of[keep]]

        for sig, names in _in_lots(found()):
            yield _pack(sig, names, parts)

    def pairs(table: pa.Table) -> pa.Table:
        K.trim_memory()
        sig, cls = _unpack(table), np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("names")])
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(first, len(sig)))
        hub, shared = np.repeat(cls[first], size), np.repeat(cls[first] != cls[first + size - 1], size)
        hub, cls = hub[shared], cls[shared]
        order = np.lexsort((cls, hub))
        hub, cls = hub[order], cls[order]
        new = np.ones(len(hub), bool)
        new[1:] = (hub[1:] != hub[:-1]) | (cls[1:] != cls[:-1])
        return pa.table({"hub": hub[new], "cls": cls[new]})

    return docs.select("text").mapInArrow(run, PACKED).groupBy("part").applyInArrow(pairs, "hub long, cls long").distinct()


@dataclass
class Joined:
    """rows: one row per document (doc_id, doc_key, n, row, set_a, set_b); classes: one row per distinct set (set_a,
    set_b, n, rep); links: verified pairs (a, b) of representatives; roots: (row, root) of linked representatives."""

    rows: DataFrame
    classes: DataFrame
    links: DataFrame
    roots: DataFrame


def jaccard_join(docs: DataFrame, options: Options | None = None, all_links: bool = False, id_col: str = "doc_id", text_col: str = "text", largest: int = 1 << 31) -> Joined:
    """Join all texts with all others.

    all_links: verify every candidate, so that ``links`` has each pair of similar distinct sets; else pairs inside a
    component that is already known are not looked at, and links only span the components.
    Null and empty texts and texts without words have no set and link with nothing; texts of any length are one row;
    repeated rows are one class; ids may repeat or be null; an empty table gives empty frames; other columns, whatever
    their names, are not looked at.
    """
    options = options or Options()
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col], docs[text_col].isNull()).alias("doc_key"), docs[text_col].alias("text"))
    plan = bands(max(1, docs.count()), largest, options)
    rows = cut(encode(slim, options).withColumn("row", F.monotonically_increasing_id()))
    one = F.min(F.struct("row", "doc_id", "doc_key", "sketch")).alias("one")
    classes = cut(rows.where("n > 0").groupBy("set_a", "set_b", "n").agg(one).select("set_a", "set_b", "n", F.col("one.row").alias("rep"), "one.doc_id", "one.doc_key", "one.sketch"))
    facts = classes.select(F.col("set_a").alias("cls"), F.col("rep").alias("row"), "n", F.size("sketch").alias("words"))
    sketches = classes.select(F.col("rep").alias("row"), "sketch")

    # A set goes by half of its name here.
    distinct = once(slim, rows)
    parts = min(1 << 14, max(32, (classes.agg(F.sum("n")).first()[0] or 0) // (2 * HELD)))
    repeated = repeated_signatures(distinct, plan, options, parts)
    release(spark)
    around = around_hubs(distinct, repeated, plan, options, parts)
    columns = ["hub", "row", "n", F.col("row").alias("root"), "words", (F.col("cls") == F.col("hub")).alias("centre")]
    rows_around = cut(around.join(facts, "cls").select(*columns))
    release(spark)

    def sets(some):
        wanted = classes.join(some, classes["rep"] == some["row"], "left_semi")
        return sets_of(slim, wanted.select(F.col("rep").alias("row"), "doc_id", "doc_key"), options)

    def rooted(roots):
        if all_links:
            return others
        known = roots.withColumnRenamed("root", "known")
        return others.join(known, "row", "left").select("hub", "row", "n", F.coalesce("known", "root").alias("root"), "words", "centre")

    links = linked(rows_around, deal_star, sets, options, all_links, sketches)
    roots = cut(components(links))
    release(spark)
    # All pairs with the hub have been looked at, so it is left out from here on.
    others = rows_around.where("not centre")
    labelled = cut(rooted(roots))
    # Hubs of more than a block: one of their rows after the other takes the hub's place while that connects much, so
    # that near copies around a stranger become one root before pairs of blocks are formed.
    weight = F.sum(8 * F.col("words") + 64).alias("bytes")
    while not all_links:
        open_hubs = labelled.groupBy("hub").agg(weight, F.countDistinct("root").alias("roots")).where((F.col("bytes") > options.block_bytes) & (F.col("roots") > 1))
        before = open_hubs.agg(F.sum("roots")).first()[0]
        if not before:
            break
        centre = labelled.join(open_hubs.select("hub"), "hub", "left_semi").groupBy("hub").agg(F.min_by(F.struct("row", "root"), F.xxhash64("row", F.lit(before))).alias("c"), F.count(F.lit(1)).alias("size"))
        size = centre.agg(F.sum("size"), F.max("size")).first()
        chosen = broadcast_hot(labelled, centre, ["hub"], "size", *size).where("row = c.row or root <> c.root")
        more = linked(cut(chosen.select("hub", "row", "n", "root", "words", (F.col("row") == F.col("c.row")).alias("centre"))), deal_star, sets, options, sketches=sketches)
        links = cut(links.unionByName(more))
        roots = cut(components(links))
        discard(labelled)
        labelled = cut(rooted(roots))
        after = labelled.join(open_hubs.select("hub"), "hub", "left_semi").groupBy("hub").agg(F.countDistinct("root").alias("roots")).agg(F.sum("roots")).first()[0]
        if 4 * after > 3 * before:
            break
    more = linked(labelled, deal_across, sets, options, all_links, sketches)
    discard(rows_around)
    discard(labelled)
    if more.limit(1).count():
        links = links.unionByName(more).distinct()
        roots = cut(components(links))
    release(spark)
    return Joined(rows.drop("sketch"), classes.select("set_a", "set_b", "n", "rep"), links, roots)


def component_rows(joined: Joined) -> DataFrame:
    """One row per document: doc_id, doc_key, row, n_shingles, component_id (least doc_id of its component) and keep
    (true for one document of each component: that with the least doc_id, ties broken by text and row).

    Documents without a set, null and empty texts among them, are components of their own.  Null ids come last; a
    component of null ids alone has a null id.  Repeated rows are one component, of which one is kept."""
    rows, key = joined.rows, ["set_a", "set_b", "n"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("doc_key").alias("key"), F.col("row").alias("row"))).alias("first")
    # By class first, so that copies are summed up where they are read and a component has one row per class.
    by_class = rows.where("n > 0").groupBy(*key).agg(first, F.count(F.lit(1)).alias("copies"))
    rooted = cut(by_class.join(joined.classes, key).join(joined.roots.withColumnRenamed("row", "rep"), "rep", "left").select(*key, F.coalesce("root", "rep").alias("root"), "first", "copies"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("size"))
    total, most = least.agg(F.sum("size"), F.max("size")).first()
    known = cut(broadcast_hot(rooted, least, ["root"], "size", total, most).select(*key, "least", "copies"))
    total, most = known.agg(F.sum("copies"), F.max("copies")).first()
    linked_rows = broadcast_hot(rows.where("n > 0"), known, key, "copies", total, most)
    linked_rows = linked_rows.select("doc_id", "doc_key", "row", F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("keep"))
    alone = rows.where("n = 0").select("doc_id", "doc_key", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("keep"))
    return linked_rows.unionByName(alone)


def one_per_component(docs: DataFrame, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which one document of each component stays: that with the least
    id, ties broken by the text's hash.  Documents without a set (null or empty texts, texts without words) are alone
    and stay; of rows that repeat id and text one stays.  Columns may have any names; an empty table stays empty.

    Only rows that may have to go are shuffled: a bit table of bounded size says so where they are read."""
    fate = component_rows(jaccard_join(docs, options, id_col=id_col, text_col=text_col)).where("n_shingles > 0")
    fate = fate.groupBy("doc_id", "doc_key").agg(F.max("keep").alias("stays"), F.count(F.lit(1)).alias("copies")).where("not stays or copies > 1")
    fate = cut(fate.select(F.col("doc_id").alias("f_id"), F.col("doc_key").alias("f_key"), "stays"))
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    plain = plain.withColumn("d_id", at).withColumn("d_key", F.xxhash64(text, text.isNull()))
    hashed = F.xxhash64("d_id", "d_key")
    maybe, sure = maybe_among(plain, hashed, fate.select(F.xxhash64("f_id", "f_key").alias("h")), fate.count(), rest=True)
    looked = maybe.join(fate, maybe["d_id"].eqNullSafe(fate["f_id"]) & (maybe["d_key"] == fate["f_key"]), "left")
    once = looked.where("stays").dropDuplicates(["d_id", "d_key"])
    every = [c for c in plain.columns if c.startswith("c")]
    out = sure.select(*every).unionByName(looked.where("stays is null").select(*every)).unionByName(once.select(*every))
    return out.toDF(*names)
