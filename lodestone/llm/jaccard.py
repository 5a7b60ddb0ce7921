"""Exact n-gram Jaccard join by pivots in metric space (operator 10).

The distance of two shingle sets is 1 - Jaccard. Whole documents make poor pivots here:
nearly all distances are 1, so every region's window would hold the corpus. So a pivot
of the first level is a *part* of a set: shingles are dealt into slices by their hash,
and a document belongs to the region of each pivot (slice, its shingles there) that it
equals. Sets that link differ in at most ``most_different`` shingles; each spoils one
slice, so a document that enters the regions of one slice more than that shares a region
with every set it links with. Sets near a border of the size classes, which decide how
many slices there are, are replicated into the next class.

The second level is the textbook one: of each region the most central member, the one
that meets most others in its regions, is the pivot, and all members are measured
against it. What has one pivot is its Voronoi cell, and border members are in several
cells. Members in the pivot's component are settled: they are not compared with each
other. The others of the cell, its strangers, meet all its members: by the triangle
inequality two members can only link if their distances to the pivot differ by no more
than the link distance, counts of shingles in buckets bound their distance from below,
and what is left is measured exactly. A cell is compared in blocks, each block of members
with each block of strangers in a task, so a cell of near copies costs in proportion to
its members.

Where members times strangers are more than one block by another, as among many texts of
one template that don't link, regions recur: all distances to a pivot are alike there and
its inequality rules nothing out, so the cell is not compared. Its members get new regions
instead, whose pivots are again parts of sets: single shingles, the rarest among these
members first, as many of each set as two sets that link must share one of. What the
members have in common is thereby left aside. The regions of all such cells are one table,
which a member of many of them enters once, and are worked as the ones before, with
pivots, cells and strangers; no pair is measured twice. This goes on while it at least halves the members of such
cells; what doesn't is compared in blocks, so no link is lost. Equal sets are one class
from the start, so copies are never paired.

Defined results: texts without words have the empty set, link with nothing and are
their own component; rows with a null doc_id are grouped like others, and a component's
id is the smallest doc_id that is not null (null if there is none); equal rows are in
one component; very long texts are read whole; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import memo
from lodestone.llm.common import only, settle
from lodestone.llm.graph import components
from lodestone.llm.wordhash import hashed

WORDS, LINK = 4, 85
#: Members of a cell that one task compares with as many others.
BLOCK = 2000
#: From this size class on, slices of one shingle don't count.
LARGE = 256
#: Buckets of the shingle counts that bound a pair's difference from below.
BUCKETS = 256
#: Bits of the filters that workers hold; a fuller filter lets more rows pass and changes no result.
FILTER_BITS, BITS_A_WORD = 1 << 24, 63
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def _shingles(codes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text's word hashes; fewer words are one shingle."""
    if not len(codes):
        return codes
    width = min(n, len(codes))
    h = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        h = _mix(h * _B + codes[k : len(codes) - width + 1 + k])
    return np.unique(h)


def sets_of(texts: list[str | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """The shingles of each text."""
    memo.use("jaccard")
    codes, at = hashed(texts, ascii_only=True)
    for a, b in zip(at, at[1:]):
        yield _shingles(codes[a:b], n)


def most_different(n: int, link: int = LINK) -> int:
    """The largest symmetric difference of a set of n shingles with one that it links with."""
    return int((100 - link) * (n + n * 100 / link) / (100 + link) + 1e-9)


#: The least size of each size class: half octaves.
BOUNDS = np.unique(np.ceil(2.0 ** (np.arange(90) / 2)).astype(np.int64))


def slices_of(most: int, link: int = LINK) -> int:
    """Slices of the sets of a size class, from its largest size."""
    need = most_different(most, link)
    return 1 if not need else need + need // 4 + 6


def regions(h: np.ndarray, link: int = LINK) -> tuple[np.ndarray, bool]:
    """Hashes of the regions that a set enters, and whether it has too few slices that count.
    Empty slices don't count, and in larger sets those of one shingle don't either: what is
    equal in two sets counts in both, so the first slices that count, one more than can
    differ, hold one that two linked sets share. A larger set with too few enters all of
    those, where it meets each set that has enough, and the first slices of any size, where
    it meets its like."""
    n, out, odd = len(h), [], False
    if not n:
        return np.zeros(0, np.uint64), False
    own = int(np.searchsorted(BOUNDS, n, side="right")) - 1
    # The window of the next size class: sets as large as what this one may link with.
    last = int(np.searchsorted(BOUNDS, n * 100 // link, side="right")) - 1
    need = most_different(n, link) + 1
    for c in range(own, last + 1):
        m = slices_of(int(BOUNDS[c + 1]) - 1, link)
        place = (_mix(h ^ _B) % np.uint64(m)).astype(np.int64)
        held = np.bincount(place, minlength=m)
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(held)
        total = np.append(np.uint64(0), np.cumsum(_mix(h + _A)[order]))
        taken = np.flatnonzero(held >= (2 if BOUNDS[c] >= LARGE else 1))[:need]
        if len(taken) < need:
            some = np.flatnonzero(held)
            odd |= len(some) < need
            taken = np.union1d(taken, some[:need])
        sums = total[ends[taken]] - total[ends[taken] - held[taken]]
        out.append(_mix(sums * _A + (np.uint64(c << 32) + taken.astype(np.uint64)) * _B + held[taken].astype(np.uint64)))
    return np.concatenate(out), odd


def single(h: np.ndarray, most: int, link: int = LINK) -> np.ndarray:
    """For sets up to a size: single shingles of which two sets that link share one."""
    n = len(h)
    return _mix(h[: n - -(-n * link // 100) + 1] + _B) if 0 < n <= most else np.zeros(0, np.uint64)


def prints(h: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set."""
    if not len(h):
        return 0, 0
    s, t = np.uint64(2 * seed + 1), np.uint64((2 * seed + 1) * int(_B) & (1 << 64) - 1)
    one = _mix(np.array([_mix(h * s).sum() + s], np.uint64))
    two = _mix(np.array([np.bitwise_xor.reduce(_mix(h + t)) + np.uint64(len(h))], np.uint64))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def counts(h: np.ndarray) -> bytes:
    """How many shingles fall into each bucket (255: so many or more)."""
    return np.minimum(np.bincount((_mix(h + _B) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


DOCS = "doc_id long, n long, node long, twin long, odd boolean, regions array<long>, counts binary"


def summarise(docs: DataFrame, n: int, link: int, seed: int) -> DataFrame:
    """DOCS of every document. node and twin are the set's fingerprints; a node's regions are listed at its first document in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, nodes, twins, odds, lists, held = [], [], [], [], [], []
            if len(seen) > 1_000_000:
                seen.clear()
            for h in sets_of(batch.column(1).to_pylist(), n):
                node, twin = prints(h, seed)
                own, odd = (np.zeros(0, np.uint64), False) if node in seen else regions(h, link)
                held.append(None if node in seen or not len(h) else counts(h))
                seen.add(node)
                for into, x in ((sizes, len(h)), (nodes, node), (twins, twin), (odds, odd), (lists, own.view(np.int64))):
                    into.append(x)
            offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
            flat = pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(twins, pa.int64()), pa.array(odds, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(held, pa.binary())], ["doc_id", "n", "node", "twin", "odd", "regions", "counts"])

    return only(docs, "doc_id", "text").mapInArrow(run, DOCS)


def filter_of(keys: DataFrame, name: str, spot: Column | None = None) -> np.ndarray:
    """A bitmap of FILTER_BITS bits of the hashes of a long column, or of given spots: as many bits whatever the table."""
    spot = F.pmod(F.xxhash64(name), F.lit(FILTER_BITS)) if spot is None else spot
    rows = keys.select(spot.alias("s")).groupBy((F.col("s") / BITS_A_WORD).cast("long").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(s % {BITS_A_WORD} as int))")).alias("b")).collect()
    bits = np.zeros((FILTER_BITS // BITS_A_WORD + 1) * BITS_A_WORD, bool)
    if rows:
        at, word = np.array([r["w"] for r in rows], np.int64), np.array([r["b"] for r in rows], np.int64)
        for k in range(BITS_A_WORD):
            bits[at[(word >> k) & 1 == 1] * BITS_A_WORD + k] = True
    return np.packbits(bits)


def _held(bits: np.ndarray, spot: np.ndarray) -> pa.Array:
    return pa.array((bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool))


def _spot(name: str):
    return F.pmod(F.xxhash64(name), F.lit(FILTER_BITS)).alias("_spot")


def _close_pairs(link: int):
    """A function of a block of a cell and a block of its strangers, which ask: the pairs that may link and are not in one component."""
    reach, at_once = (100 - link) / 100 + 1e-9, 1 << 20

    def run(group: pa.Table) -> pa.Table:
        node, n, root = (group.column(c).to_numpy() for c in ("node", "n", "root"))
        d = group.column("d").to_numpy(zero_copy_only=False).astype(float)  # not measured: not a number
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        asking, met = np.flatnonzero(asks), np.flatnonzero(~asks)
        step, out_a, out_b = max(1, at_once // max(1, len(met))), [], []
        for lo in range(0, len(asking), step):
            x = asking[lo : lo + step, None]
            fine = root[x] != root[met]
            fine &= np.minimum(n[x], n[met]) * 100 >= np.maximum(n[x], n[met]) * link
            fine &= ~(np.abs(d[x] - d[met]) > reach)  # by the triangle inequality
            every_i, every_j = np.nonzero(fine)
            for k in range(0, len(every_i), 1 << 16):
                i, j = asking[lo + every_i[k : k + (1 << 16)]], met[every_j[k : k + (1 << 16)]]
                ci, cj = counts[i], counts[j]
                differ = np.where((ci < 255) & (cj < 255), np.abs(ci - cj), 0).sum(axis=1)
                ok = 100 * (n[i] + n[j] - differ) >= link * (n[i] + n[j] + differ)
                out_a.append(np.minimum(node[i[ok]], node[j[ok]]))
                out_b.append(np.maximum(node[i[ok]], node[j[ok]]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([*out_a, none]), "b": np.concatenate([*out_b, none])})

    return run


def _with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of two components, with their roots ra and rb; a node without links is its own."""
    both = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    return both.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).filter("ra <> rb")


class Join:
    """The join of one table of documents."""

    def __init__(self, docs: DataFrame, n: int = WORDS, link: int = LINK):
        self.docs, self.n, self.link = only(docs, "doc_id", "text"), n, link
        for seed in range(1, 9):
            self.seed = seed
            self.all = settle(summarise(self.docs, n, link, seed))
            self.nodes = settle(self.all.filter("n > 0").groupBy("node").agg(F.min("twin").alias("lo"), F.max("twin").alias("hi"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
            if self.nodes.filter("lo <> hi").isEmpty():
                return  # no two sets have one fingerprint
        raise RuntimeError("fingerprints of different sets are equal under eight seeds")

    def entered(self) -> DataFrame:
        """(node, region) of the first level."""
        entered = self.all.select("node", F.explode("regions").alias("region"))
        # Sets with too few slices of any size, small ones if there are any, are joined by single shingles instead.
        most = self.all.filter("odd").agg(F.max("n").alias("n")).first()["n"]
        if most is not None:
            entered = entered.unionByName(self._singles(most * 100 // self.link))
        return entered

    def rarest(self, wide: DataFrame) -> DataFrame:
        """(node, region) of the next level for the members of wide cells: a region is a shingle, a set enters those of its rarest."""
        one = self.sets(wide).select("node", F.size("set").alias("n"), F.explode("set").alias("region"))
        held = settle(one.groupBy("region").agg(F.count(F.lit(1)).alias("held")))
        # A shingle of one member leads to no pair, but has its place in the order.
        ordered = F.sort_array(F.collect_list(F.struct("held", "region")))
        first = F.slice(ordered, F.lit(1), F.expr(f"cast(n - ceil(n * {self.link} / 100) + 1 as int)"))
        ranked = one.join(held, "region").groupBy("node", "n").agg(first.alias("first"))
        return settle(ranked.select("node", F.explode("first").alias("f")).filter("f.held > 1").select("node", "f.region"))

    def members(self, entered: DataFrame) -> DataFrame:
        """(region, node, weight, pivot) of the regions with more than one node. weight: how often a node meets others; the heaviest is the pivot."""
        shared = settle(entered.groupBy("region").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("region"))
        packed = self.docs.sparkSession.sparkContext.broadcast(filter_of(shared, "region"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["region", "node"]).filter(_held(packed.value, batch.column(2).to_numpy()))

        met = entered.select("region", "node", _spot("region")).mapInArrow(run, "region long, node long")
        inside = settle(met.join(shared, "region").distinct())
        # What is aggregated by a key is settled before it is joined by that key, so a hot key's rows can be split among tasks.
        size = settle(inside.groupBy("region").agg(F.count(F.lit(1)).alias("size")))
        weight = settle(inside.join(size, "region").groupBy("node").agg(F.sum("size").alias("weight")))
        weighed = settle(inside.join(weight, "node"))
        central = settle(weighed.groupBy("region").agg(F.max(F.struct("weight", "node")).alias("m")).select("region", F.col("m.node").alias("pivot")))
        return settle(weighed.join(central, "region"))

    def _singles(self, most: int) -> DataFrame:
        n, link, seed = self.n, self.link, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = list(sets_of(batch.column(0).to_pylist(), n))
                lists = [single(h, most, link).view(np.int64) for h in sets]
                nodes = np.repeat(np.array([prints(h, seed)[0] for h in sets], np.int64), [len(x) for x in lists])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]))], ["node", "region"])

        return self.docs.select("text").mapInArrow(run, "node long, region long").distinct()

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, set) of the wanted nodes. Texts are read again, and only the sets of wanted nodes are shuffled."""
        n, seed = self.n, self.seed
        want = settle(self.nodes.join(wanted.distinct(), "node").select("node", "doc_id"))
        packed = self.docs.sparkSession.sparkContext.broadcast(filter_of(want, "doc_id"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(sets_of(batch.column(0).filter(_held(packed.value, batch.column(1).to_numpy())).to_pylist(), n))
                offsets = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                flat = pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([prints(h, seed)[0] for h in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["node", "set"])

        found = self.docs.select("text", _spot("doc_id")).mapInArrow(run, "node long, set array<long>")
        return settle(found.join(want.select("node"), "node").groupBy("node").agg(F.first("set").alias("set")))

    def counts(self) -> DataFrame:
        """(node, counts) of every node; each of its documents has the same."""
        if not hasattr(self, "_counts"):
            self._counts = settle(self.all.filter("counts is not null").groupBy("node").agg(F.first("counts").alias("counts")))
        return self._counts

    def measured(self, pairs: DataFrame, done: DataFrame | None = None) -> DataFrame:
        """Distinct pairs (a, b) with common, the shingles of both, and either, those of one or both.
        Pairs whose sizes rule a link out, and those done before, are left out."""
        size = self.nodes.select("node", "n")
        sized = pairs.distinct().join(size.selectExpr("node as a", "n as na"), "a").join(size.selectExpr("node as b", "n as nb"), "b")
        possible = sized.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.link)
        if done is not None:
            possible = possible.join(done, ["a", "b"], "left_anti")
        # What bucket counts differ by, the sets differ by at least.
        held = self.counts()
        both = possible.join(held.selectExpr("node as a", "counts as ca"), "a").join(held.selectExpr("node as b", "counts as cb"), "b")
        link = self.link

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ca, cb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for k in (4, 5))
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                differ = np.where((ca < 255) & (cb < 255), np.abs(ca - cb), 0).sum(axis=1)
                # common = (na + nb - differ) / 2 at most, either is the rest
                ok = 100 * (na + nb - differ) >= link * (na + nb + differ)
                yield pa.RecordBatch.from_arrays(batch.columns[:4], batch.schema.names[:4]).filter(pa.array(ok))

        pairs = settle(both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(close, "a long, b long, na long, nb long"))
        sets = self.sets(pairs.selectExpr("a as node").unionByName(pairs.selectExpr("b as node")))
        x = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        return settle(x.select("a", "b", common.alias("common"), (F.col("na") + F.col("nb")).alias("both")).select("a", "b", "common", (F.col("both") - F.col("common")).alias("either")))

    def joined(self, roots: DataFrame | None, near: DataFrame) -> DataFrame:
        """(node, root) of every node with a link: the roots so far, joined by further links. Those are followed between roots."""
        links = near.filter(F.col("common") * 100 >= F.col("either") * self.link).select("a", "b")
        if roots is None:
            return components(links)
        between = _with_roots(links, roots).selectExpr("ra as a", "rb as b")
        over = components(between)
        known = roots.join(over.toDF("root", "last"), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        return settle(known.unionByName(over.join(roots, "node", "left_anti")))

    def cells(self, members: DataFrame, near: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The Voronoi region of a pivot: the members of all regions it is the pivot of, with their distance to it where
        it was measured, and their component; and the sizes of those with strangers."""
        d = (1 - F.col("common") / F.col("either")).alias("d")
        distance = near.select(F.col("a").alias("pivot"), F.col("b").alias("node"), d).unionByName(near.select(F.col("b").alias("pivot"), F.col("a").alias("node"), d))
        cell = members.select("pivot", "node").distinct().join(distance, ["pivot", "node"], "left").join(roots, "node", "left")
        cell = settle(cell.select("pivot", "node", "d", F.coalesce("root", "node").alias("root")))
        # What is in the pivot's component needs no comparison with its like: only the others of the cell, the strangers, meet all.
        home = cell.filter("node = pivot").select("pivot", F.col("root").alias("home"))
        placed = settle(cell.filter("node <> pivot").join(home, "pivot").select("pivot", "node", "d", "root", (F.col("root") != F.col("home")).alias("strange")))
        size = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("strange"), 1)).alias("strangers"))
        return placed, settle(size.filter("strangers > 0 and size > 1"))

    def within(self, placed: DataFrame, sizes: DataFrame) -> DataFrame:
        """The pairs (a, b) of strangers with others of their cells that may link, block by block."""
        count = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
        split = sizes.select("pivot", count("size").alias("blocks"), count("strangers").alias("strangers"))
        own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        block = settle(placed.join(split, "pivot").join(self.nodes.select("node", "n"), "node").join(self.counts(), "node"))
        shown = ["pivot", "node", "n", "root", "d", "counts"]
        every = block.select(*shown, F.lit(False).alias("asks"), own("blocks").alias("i"), spread("strangers").alias("j"))
        asking = block.filter("strange").select(*shown, F.lit(True).alias("asks"), spread("blocks").alias("i"), own("strangers").alias("j"))
        return every.unionByName(asking).groupBy("pivot", "i", "j").applyInArrow(_close_pairs(self.link), "a long, b long")

    def rooted(self) -> DataFrame:
        """(node, doc_id, root) of every node; linked nodes have one root."""
        entered, roots, done, before = self.entered(), None, None, None
        while True:
            members = self.members(entered)
            pairs = members.filter("node <> pivot").selectExpr("least(pivot, node) as a", "greatest(pivot, node) as b")
            near = self.measured(pairs if roots is None else _with_roots(pairs.distinct(), roots).select("a", "b"), done)
            roots = self.joined(roots, near)
            placed, sizes = self.cells(members, near, roots)
            wide = F.col("size") * F.col("strangers") > BLOCK * BLOCK
            again = settle(placed.join(sizes.filter(wide).select("pivot"), "pivot").select("node").distinct())
            left = again.count()
            recurs = 0 < left and (before is None or 2 * left <= before)
            done = near.select("a", "b") if done is None else done.unionByName(near.select("a", "b"))
            more = self.measured(self.within(placed, sizes.filter(~wide) if recurs else sizes), done)
            roots = self.joined(roots, more)
            if not recurs:
                return settle(self.nodes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")))
            done, entered, before = done.unionByName(more.select("a", "b")), self.rarest(again), left

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row. Sets get their component first, so copies are met once, at the end."""
        rooted = self.rooted()
        low = settle(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
        of = settle(rooted.join(low, "root").select("node", "component_id"))
        rows = self.all.select("doc_id", F.col("n").alias("n_shingles"), "node")
        some = rows.filter("n_shingles > 0").join(of, "node").select("doc_id", "n_shingles", "component_id")
        none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return some.unionByName(none)


def link_documents(docs: DataFrame, n: int = WORDS, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link where 100 * common >= link * either."""
    return Join(docs, n, link).classes()


def keep_one(docs: DataFrame, n: int = WORDS, link: int = LINK) -> DataFrame:
    """docs with one row of each component: the first by doc_id (null last), of one doc_id's rows the first by a hash of
    the text, of equal rows any one. Rows have a key of their own, so none goes for its doc_id. Rows without words stay."""
    named = settle(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")))
    classes = settle(link_documents(named.select(F.col("key").alias("doc_id"), "row.text"), n, link).filter("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("of")))
    many = settle(classes.groupBy("of").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("of"))
    order = F.struct(F.col("row.doc_id").isNull().alias("unnamed"), "row.doc_id", F.xxhash64("row.text").alias("hash"), "key")
    members = settle(named.select("key", order.alias("place")).join(classes.join(many, "of"), "key").select("key", "place", "of"))
    first = members.groupBy("of").agg(F.min("place").alias("first")).select(F.col("first.key").alias("key"))
    gone = settle(members.select("key").join(first, "key", "left_anti"))
    return named.join(gone, "key", "left_anti").select("row.*")
