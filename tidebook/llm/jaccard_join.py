"""N-gram Jaccard join with a count-vector R-tree.

The distinct 4-word shingles of a text are hashed into groups. Two texts that are alike enough differ in so few
shingles that some group must be equal in both, which deals texts into blocks by (group, its content) without losing a pair. The counts of the
groups make every text a point; the overlap of two texts is at most the sum of the smaller coordinates. R-trees over
the points of a block find what this bound leaves together, and in these clusters the shingles of surviving pairs are compared exactly, by their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import components, cut, drop, short_batches, small
from .wordhash import exact_sets, mix, shingle_pairs

SHINGLE = 4
PERCENT = 85
_FAN = 8
#: Shingles of a node when a cluster is compared exactly.
PART = 1 << 19
#: Texts of a node when a block is searched.
BLOCK = 4096
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Bands:
    """Size bands of shingle sets for a similarity of percent/100 or more.

    Sets of a band's sizes differ in at most d shingles, and two sets of a and b in at most r * (a + b), with r = (100 - percent) / (100 + percent).
    With g = d + 3 groups at least g - r * (a + b) are equal; a set of a may leave out (g - 1) / 2 - r * a groups, its emptiest, which say
    least: two sets leave out fewer than are equal, so an equal group remains to both. Sets smaller than least
    are alike only if equal.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        differ = lambda n: (100 - percent) * 2 * n // (100 + percent)
        # From here on a set may be alike to a larger one, or to another of its size.
        self.least = next(n for n in range(1, 1 << 20) if differ(n) or 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62
        self.low, self.groups = [self.least], []
        while self.low[-1] < 1 << 40 and percent < 100:
            high = self.low[-1] * 3 // 2 + 1
            self.groups.append(differ(high - 1) + 3)
            self.low.append(high)

    def spare(self, band: int, n: int) -> int:
        """Groups that a set of n may leave out of a band."""
        return max(0, ((self.groups[band] - 1) * (100 + self.percent) - 2 * (100 - self.percent) * n) // (2 * (100 + self.percent)))

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n shingles must be found: its own, and the next if sets from there can be alike."""
        if n < self.least:
            return []
        b = int(np.searchsorted(self.low, n, "right")) - 1
        return [b, b + 1] if 100 * n >= self.percent * self.low[b + 1] else [b]

    def bits(self, n: int) -> int:
        """Bits of the group number of the points: about eight shingles a group."""
        return max(3, int(n // 8).bit_length())


def alike(both, a, b, percent: int = PERCENT):
    """Whether an overlap of both reaches the similarity for sets of a and b."""
    return (100 + percent) * both >= percent * (a + b)


def block_keys(u: np.ndarray, bands: Bands) -> np.ndarray:
    """Block keys of a set, given as sorted distinct hashes."""
    out = []
    spread = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(u ^ _C3))))
    for b in bands.of(len(u)):
        g = bands.groups[b]
        at = ((u >> np.uint64(32)) * np.uint64(g)) >> np.uint64(32)
        edge = np.searchsorted(at, np.arange(g + 1, dtype=np.uint64))
        size = np.diff(edge)
        keep = np.sort(np.argsort(size, kind="stable")[bands.spare(b, len(u)) :])
        content = (spread[edge[1:]] - spread[edge[:-1]])[keep]
        out.append(mix(content + keep.astype(np.uint64) * _C1 + np.uint64((b + 1) * int(_C2) & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def point(u: np.ndarray, bits: int) -> np.ndarray:
    """Group counts of a set, by leading bits of the hash."""
    return np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)


def coarser(p: np.ndarray, size: int) -> np.ndarray:
    return p if len(p) == size else p.reshape(size, -1).sum(1)


class RTree:
    """R-tree over count points, loaded in order of size: nodes of _FAN, each with its upper corner and its smallest and largest set."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        self.order = np.argsort(sizes, kind="stable")
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > _FAN:
            p, lo, hi = self.levels[-1]
            cut_at = np.arange(0, len(p), _FAN)
            self.levels.append((np.maximum.reduceat(p, cut_at), np.minimum.reduceat(lo, cut_at), np.maximum.reduceat(hi, cut_at)))

    def search(self, p: np.ndarray, n: int) -> np.ndarray:
        """Rows whose bound on the overlap with (p, n) is enough."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, lo, hi = (x[at] for x in self.levels[depth])
            fits = (100 * hi >= self.percent * n) & (100 * n >= self.percent * lo)
            bound = np.minimum(corner, p).sum(1)
            # A node's sets overlap in at most bound, and need at least what its smallest possible partner would.
            need = np.maximum(lo, -(-self.percent * n // 100))
            at = at[fits & alike(bound, n, need, self.percent)]
            if depth:
                at = (at[:, None] * _FAN + np.arange(_FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


SETS = "doc_id long, n long, s1 long, s2 long, keys array<long>, point binary"


def _set_columns(percent: int, shingle: int):
    """SETS of (doc_id, text): the size of a text's set, 128 bits that name it (sums of two independent hashes of its shingles), its block keys and its point."""
    bands = Bands(percent)

    def run(batches):
        for b in small(batches):
            ids, ns, s1, s2, offs, keys, points = [], [], [], [], [0], [], []
            for i, (h, h2) in zip(b.column(0).to_pylist(), shingle_pairs(b.column(1).to_pylist(), shingle), strict=True):
                u, at = np.unique(h, return_index=True)
                ids.append(i)
                ns.append(len(u))
                s1.append(int(mix(u).sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mix(h2[at]).sum(dtype=np.uint64).view(np.int64)))
                k = block_keys(u, bands)
                keys.append(k)
                offs.append(offs[-1] + len(k))
                points.append(point(u, bands.bits(len(u))).astype("<i4").tobytes() if len(k) else b"")
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
            cols = [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())]
            cols += [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), flat), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SETS.split(", ")])

    return run


def forest(comp: np.ndarray, partners):
    """Yield links (x, y) that join rows of different comp, one for each comp that a search reaches: at most one fewer than comps.

    partners(x, left) gives the rows of left, a mask, that x is linked with.
    """
    left = np.ones(len(comp), bool)
    for seed in range(len(comp)):
        if not left[seed]:
            continue
        queue = np.flatnonzero(left & (comp == comp[seed])).tolist()
        left[queue] = False
        while queue:
            x = queue.pop()
            for y in partners(x, left).tolist():
                if left[y]:
                    yield x, y
                    reached = np.flatnonzero(left & (comp == comp[y]))
                    left[reached] = False
                    queue += reached.tolist()


def _grouped(batches, width: int, links):
    """Rows that come sorted by their first width columns, group by group, through links(rows), which yields (a, b)."""

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    held, key = [], None
    for b in small(batches):
        found = []
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:width] != key:
                found += links(held)
                held, key = [], row[:width]
            held.append(row[width:])
        yield out(found)
    yield out(list(links(held)))


def _block_links(percent: int):
    """For rows (rid, n, c, point) of a block: links that the bound allows, joining different components c."""

    def links(rows):
        if len(rows) < 2:
            return
        points = [np.frombuffer(r[3], "<i4") for r in rows]
        size = min(len(p) for p in points)
        pts = np.stack([coarser(p, size) for p in points])
        ns = np.array([r[1] for r in rows])
        tree = RTree(pts, ns, percent)

        def partners(x, left):
            found = tree.search(pts[x], ns[x])
            return found[left[found]]

        for x, y in forest(np.array([r[2] for r in rows]), partners):
            yield rows[x][0], rows[y][0]

    return links


def _exact_links(percent: int, shingle: int, spanning: bool):
    """For rows (rid, text) of a cluster's part: links between alike sets, all of them or a spanning forest.

    The words themselves are compared: their shingles are numbered exactly within the part.
    """

    def links(rows):
        sets = exact_sets([r[1] for r in rows], shingle) if len(rows) > 1 else []
        rows, sets = [r for r, u in zip(rows, sets, strict=False) if len(u)], [u for u in sets if len(u)]
        if len(rows) < 2:
            return
        ns = np.array([len(u) for u in sets])
        bits = Bands(percent).bits(int(np.median(ns)))
        pts = np.stack([point(u, bits) for u in sets])
        tree = RTree(pts, ns, percent)

        def partners(x, left):
            found = tree.search(pts[x], ns[x])
            found = found[left[found]]
            if not len(found):
                return found
            u = sets[x]
            joined = np.concatenate([sets[i] for i in found])
            at = np.minimum(np.searchsorted(u, joined), len(u) - 1)
            both = np.add.reduceat((u[at] == joined).astype(np.int64), np.concatenate(([0], np.cumsum(ns[found])[:-1])))
            return found[alike(both, ns[x], ns[found], percent)]

        if spanning:
            for x, y in forest(np.arange(len(rows)), partners):
                yield rows[x][0], rows[y][0]
            return
        for x in range(len(rows)):
            for y in partners(x, np.arange(len(rows)) > x).tolist():
                yield tuple(sorted((rows[x][0], rows[y][0])))

    return links


def _bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points leave the similarity possible."""
    pts = reps.select("rid", "n", "point")
    p = pairs.join(pts.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa")), "a")
    p = p.join(pts.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb")), "b")

    def run(batches):
        for b in small(batches):
            keep = []
            for na, xa, nb, xb in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(xa, "<i4"), np.frombuffer(xb, "<i4")
                size = min(len(x), len(y))
                keep.append(bool(alike(int(np.minimum(coarser(x, size), coarser(y, size)).sum()), na, nb, percent)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return p.select("a", "b", "na", "pa", "nb", "pb").mapInArrow(run, "a long, b long")


def _parts(members: DataFrame, group: str, weight, most: int, percent: int) -> DataFrame:
    """(group, i, j, rid) of members (group, rid, n): each group cut, by set size, into nodes of about weight most, and each two nodes that sizes let
    be alike in a part (i, j) of their own. A task so holds two nodes at once, however large the group.

    The weights of a group's sizes are added up, one row a size; sets of one size that weigh more than a node are dealt among several by a hash.
    """
    upto = Window.partitionBy(group).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sized = members.groupBy(group, "n").agg(F.sum(weight).alias("w_")).withColumn("ahead_", F.coalesce(F.sum("w_").over(upto), F.lit(0)))
    sized = sized.select(F.col(group).alias("g_"), F.col("n").alias("n_"), F.floor(F.col("ahead_") / most).cast("long").alias("at_"), F.ceil(F.col("w_") / most).cast("long").alias("of_"))
    m = members.select(group, "rid", "n").join(sized, (F.col(group) == F.col("g_")) & (F.col("n") == F.col("n_")))
    m = m.select(group, "rid", "n", (F.shiftleft("at_", 31) + F.pmod(F.xxhash64("rid"), "of_")).alias("node"))
    nodes = m.groupBy(group, "node").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = nodes.select(F.col(group).alias("g_"), F.col("node").alias("j"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"))
    meet = (F.col(group) == F.col("g_")) & (F.col("node") <= F.col("j")) & (100 * F.col("hi") >= percent * F.col("lo_")) & (100 * F.col("hi_") >= percent * F.col("lo"))
    pairs = nodes.join(other, meet).select(group, F.col("node").alias("i"), "j")
    ends = pairs.withColumn("node", F.explode(F.array_distinct(F.array("i", "j"))))
    return m.join(ends, [group, "node"]).select(group, "i", "j", "rid")


def _verified(clusters: DataFrame, docs: DataFrame, percent: int, shingle: int, spanning: bool = True) -> DataFrame:
    """Links (a, b) between the texts of each cluster (rid, c, n) whose sets are alike: all, or a spanning forest of each part.

    A cluster is compared in parts of PART shingles; nearly all are one part.
    """
    dealt = _parts(clusters, "c", F.col("n"), PART, percent)
    # Of a number with several texts each is compared; the texts of its copies are one.
    texts = docs.select(F.col("doc_id").alias("rid"), "text").where("text is not null").join(clusters.select("rid").distinct().hint("merge"), "rid").distinct()
    dealt = dealt.join(texts, "rid").select("c", "i", "j", "rid", "text").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "rid")
    found = dealt.mapInArrow(lambda batches: _grouped(batches, 3, _exact_links(percent, shingle, spanning)), "a long, b long")
    return found.where("a <> b").distinct()


class Classes:
    """The tables that the join's steps share: members (doc_id, n, s1, s2) of every row, reps (rid, n, s1, s2, point) of every different set, and clusters (rid, c, n) that hold every linked pair."""

    def __init__(self, docs: DataFrame, percent: int, shingle: int):
        texts = short_batches(docs).select("doc_id", "text")
        full = cut(texts.mapInArrow(_set_columns(percent, shingle), SETS))
        self.members = cut(full.select("doc_id", "n", "s1", "s2"))
        reps = full.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rid"), F.first("keys").alias("keys"), F.first("point").alias("point"))
        self.reps = cut(reps)
        drop(full)

        # A doc_id with several texts has a row for each here; it is one node of every graph below.
        keyed = self.reps.where("rid is not null").select(F.explode("keys").alias("key"), "rid")
        hubs = cut(keyed.groupBy("key").agg(F.min("rid").alias("hub"), F.count("*").cast("int").alias("m")).where("m > 1"))
        # Merged at every size: a small input would be broadcast, and measured in that way, where a large one never is.
        blocks = cut(keyed.join(hubs.hint("merge"), "key").where("m > 2 or rid <> hub").select("key", "rid", "hub", "m"))
        drop(hubs)
        stars = blocks.where("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()
        near = cut(_bounded(stars, self.reps, percent).distinct())
        comp = cut(components(near).withColumnsRenamed({"node": "rid", "component": "c"}))
        members = blocks.where("m > 2").join(comp, "rid", "left").select("key", "rid", "m", F.coalesce("c", "rid").alias("c"))
        several = members.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
        members = cut(members.join(several, "key"))
        drop(blocks, comp)
        large = _parts(members.where(F.col("m") > BLOCK).join(self.reps.select("rid", "n"), "rid"), "key", F.lit(1), BLOCK, percent)
        large = large.join(members.select("key", "rid", "c"), ["key", "rid"]).select("key", "i", "j", "rid", "c")
        zero = F.lit(0).cast("long")
        dealt = members.where(F.col("m") <= BLOCK).select("key", zero.alias("i"), zero.alias("j"), "rid", "c").union(large)
        dealt = dealt.join(self.reps.select("rid", "n", "point"), "rid").select("key", "i", "j", "rid", "n", "c", "point")
        dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rid")
        found = cut(near.union(dealt.mapInArrow(lambda batches: _grouped(batches, 3, _block_links(percent)), "a long, b long")))
        drop(members, near)
        comp = components(found).withColumnsRenamed({"node": "rid", "component": "c"})
        self.clusters = cut(comp.join(self.reps.groupBy("rid").agg(F.sum("n").alias("n")), "rid"))
        drop(found)


def join_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Words are runs of other bytes than 0x20 and 0x09-0x0D, with A-Z as a-z; a text's set is its distinct shingles of so many words, or its whole
    sequence if it has fewer words. Texts link when 100 * intersection >= percent * union. component_id is the least
    doc_id reached by links. A null text, an empty one and one without words have 0 shingles and link with nothing. Rows that share a doc_id
    are one document, which links as each of its texts does. A row with null doc_id
    is reached through its text's other rows only, and is its own, null, component without them. An empty table gives no rows.

    Blocks whose members the bound joins through their hub, the least document, are settled in one linear pass; the members of others are searched in the
    block's R-tree. Both only yield links that join components, so a block or cluster of n texts never gives more than n - 1 rows. Texts are read
    twice: for their sets, and where they are in a cluster for their words.
    """
    t = Classes(docs, percent, shingle)
    links = cut(_verified(t.clusters, docs, percent, shingle))
    # Texts of one doc_id are linked through it: classes that meet in a document.
    classes = t.reps.select("s1", "s2", "rid")
    shared = t.members.where("n > 0 and doc_id is not null").select("doc_id", "s1", "s2").distinct()
    twice = shared.groupBy("doc_id").count().where("count > 1").select("doc_id")
    same = shared.join(twice, "doc_id").join(classes, ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rid").alias("b"))
    comp = components(links.union(same)).withColumnsRenamed({"node": "rid", "component": "c"})
    classes = cut(classes.join(comp, "rid", "left").select("s1", "s2", F.coalesce("c", "rid").alias("c")))
    drop(t.reps, t.clusters, links)
    # A text with very many copies has one row in classes; adaptive execution splits its members.
    known = t.members.where("n > 0").join(classes, ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    none = t.members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return known.union(none)


def join_links(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(links, membership): every link (a, b), a < b, between representatives of different texts, and the representative rid of every row's text (doc_id, rid).

    The representative of a text is the least doc_id that has it; a text that only rows without doc_id have has none, and no links. Rows and rules as in join_components. For a family of k mutually
    alike texts this gives k * (k - 1) / 2 rows, where join_components needs k - 1.
    """
    t = Classes(docs, percent, shingle)
    links = cut(_verified(t.clusters, docs, percent, shingle, spanning=False))
    members = t.members.where("n > 0").join(t.reps.select("s1", "s2", "rid"), ["s1", "s2"], "left").select("doc_id", "rid")
    return links, members.union(t.members.where("n = 0").select("doc_id", F.col("doc_id").alias("rid")))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
