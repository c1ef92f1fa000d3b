"""Similarity join of documents on word shingles by trees of signatures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm.common import LAST, batch_bytes, components, row_key, small_batches, unused, written
from morphlake.llm.shingles import sets

#: Members that one traversal compares at most; larger groups are dealt out by size band and block.
BLOCK = 4096
#: The same for whole sets.
SETS = 512
#: The part of the hash space whose shingles are in bitmaps: 1 / 2 ** PART.
PART = 2
FAN = 4


def needed(a: int, b: int, percent: int) -> int:
    """Least intersection of sets of a and b elements that link."""
    return -(-percent * (a + b) // (100 + percent))


class Node:
    """Documents first to last of a list ordered by size: OR of their bitmaps, ranges of what bounds an overlap.

    least, most: set sizes. inside: most elements that bitmaps speak of. outside: most other elements.
    lost: most elements that share a bit with another one of their set. one: the only group, if there is one.
    """

    __slots__ = ("bits", "children", "first", "inside", "last", "least", "lost", "most", "one", "outside")

    def bound(self, other: Node) -> int:
        """No document here shares more elements with one there."""
        common = (self.bits & other.bits).bit_count() + min(self.lost, other.lost)
        return min(self.outside, other.outside) + min(common, self.inside, other.inside)


def folded(bits: int, width: int) -> int:
    """A bitmap of a power of two of bits halved, by OR, until it has no more than `width` bits."""
    while bits.bit_length() > width:
        half = 1 << ((bits.bit_length() - 1).bit_length() - 1)
        bits = (bits >> half) | (bits & ((1 << half) - 1))
    return bits


def tree(items: list[tuple], width: int) -> Node | None:
    """items: (size, bits, inside, group), by size; bits are folded to `width` bits."""
    level = []
    for k, (size, bits, inside, group) in enumerate(items):
        node, bits = Node(), folded(bits, width)
        node.bits, node.least, node.most, node.inside, node.outside = bits, size, size, inside, size - inside
        node.lost, node.first, node.last, node.children, node.one = inside - bits.bit_count(), k, k, None, group
        level.append(node)
    while len(level) > 1:
        up = []
        for at in range(0, len(level), FAN):
            own = level[at : at + FAN]
            node = Node()
            node.bits = 0
            for x in own:
                node.bits |= x.bits
            node.least, node.most = min(x.least for x in own), max(x.most for x in own)
            node.inside, node.outside, node.lost = (max(getattr(x, f) for x in own) for f in ("inside", "outside", "lost"))
            node.first, node.last, node.children = own[0].first, own[-1].last, own
            node.one = own[0].one if all(x.one == own[0].one for x in own) else None
            up.append(node)
        level = up
    return level[0] if level else None


def traverse(left: Node, right: Node, percent: int, same: bool):
    """Pairs of documents of two trees (or of one with itself) that no bound excludes and that aren't of one group."""
    stack = [(left, right)]
    while stack:
        a, b = stack.pop()
        if same and a is b:
            if a.children and a.one is None:
                own = a.children
                stack += [(own[i], own[j]) for i in range(len(own)) for j in range(i, len(own))]
            continue
        if a.one is not None and a.one == b.one:
            continue
        if 100 * a.most < percent * b.least or 100 * b.most < percent * a.least:
            continue
        if a.bound(b) < needed(a.least, b.least, percent):
            continue
        if a.children is None and b.children is None:
            yield a.first, b.first
        elif b.children is None or (a.children is not None and a.last - a.first >= b.last - b.first):
            stack += [(x, b) for x in a.children]
        else:
            stack += [(a, x) for x in b.children]


def survivors(members: list[tuple], percent: int):
    """Pairs (i, j) of members (size, bits, inside, group, side) that may link; members of side 1 or 2 meet only the other side, those of 0 everyone.

    Bitmaps are as wide as the power of two that a set's size doesn't exceed, so trees are by width; those whose sizes can link meet at the smaller width.
    """
    widths: dict[int, list[int]] = {}
    for i in sorted(range(len(members)), key=lambda i: (members[i][0], members[i][3])):
        widths.setdefault(width_of(members[i][0]), []).append(i)
    trees = {w: tree([members[i][:4] for i in own], w) for w, own in widths.items()}
    for w, own in widths.items():
        runs = [(own, trees[w], own, trees[w])]
        for v, more in widths.items():
            if v > w and 100 * members[own[-1]][0] >= percent * members[more[0]][0]:
                runs.append((own, trees[w], more, tree([members[i][:4] for i in more], w)))
        for x, tx, y, ty in runs:
            for p, q in traverse(tx, ty, percent, tx is ty):
                i, j = x[p], y[q]
                if not members[i][4] or members[i][4] != members[j][4]:
                    yield i, j


def width_of(size: int) -> int:
    return max(64, 1 << (size - 1).bit_length())


def _bitmap(own: np.ndarray) -> tuple[bytes, int]:
    some = own[own >> np.uint64(64 - PART) == 0] if PART else own
    width = width_of(len(own))
    bits = np.zeros(width, np.uint8)
    bits[(some & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes(), len(some)


def _profiles(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """k, k2 (name the row), doc_id, s (names the set), n, inside, bits, prefix: the shingles of least hash, as many as a linked set can't all miss; short: how many of them suffice against sets that aren't smaller."""
    schema = "k long, k2 long, doc_id long, s long, n int, inside int, bits binary, prefix array<long>, short int"

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 1 << 20):
            out = []
            for own in sets(*batch_bytes(batch.column(3)), size):
                n = len(own)
                if not n:
                    out.append((0, 0, 0, None, [], 0))
                    continue
                name = (int(np.bitwise_xor.reduce(own * np.uint64(0x9E3779B97F4A7C15) ^ own >> np.uint64(29))) * 0xBF58476D1CE4E5B9 + int(own.sum()) + n) & (2**64 - 1)
                bits, inside = _bitmap(own)
                out.append((name - (1 << 64) if name >> 63 else name, n, inside, bits, own[: n - -(-percent * n // 100) + 1].view(np.int64), n - -(-2 * percent * n // (100 + percent)) + 1))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], [c.split()[0] for c in schema.split(", ")])

    return rows.select("k", "k2", "doc_id", "text").mapInArrow(run, schema)


def _dealt(members: DataFrame, percent: int, key: str, most: int) -> DataFrame:
    """members(key, s, n, ...) with the group that compares them, their side in it and whether it is their own band's.

    The members of a key are one group, or if there are more than `most`, one group for each size band
    (a band's sets meet their own and the band's below), or for each pair of blocks of a band.
    """
    ratio = math.log(100 / percent) if percent < 100 else 1.0
    band = F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")
    rows = members.join(members.groupBy(key).agg(F.count("*").alias("m")), key)
    small = rows.where(F.col("m") <= most).withColumns({"band": F.lit(-1), "i": F.lit(0), "j": F.lit(0), "side": F.lit(0), "home": F.lit(True)})
    large = rows.where(F.col("m") > most).withColumn("band", F.explode(F.array(band, band + 1))).withColumn("home", F.col("band") == band)
    sized = large.groupBy(key, "band").agg(F.ceil(F.count("*") / most).cast("int").alias("nb"))
    large = large.join(sized, [key, "band"]).withColumn("own", F.pmod(F.xxhash64("s"), F.col("nb")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    large = large.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).withColumn("side", F.when(F.col("i") == F.col("j"), F.lit(0)).when(F.col("own") == F.col("i"), F.lit(1)).otherwise(F.lit(2)))
    names = [key, "band", "i", "j", "side", "home", *(c for c in members.columns if c != key)]
    return small.select(names).unionByName(large.select(names))


def _by_group(dealt: DataFrame, key: str, columns: list[str], judge, schema: str) -> DataFrame:
    """judge(rows of columns) for each group with more than one row, streamed: groups are dealt out by their keys and sorted, so a task holds one group at a time."""
    keys = [key, "band", "i", "j"]

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        rows, last, out = [], None, []
        for batch in batches:
            at = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            own = list(zip(*(batch.column(4 + k).to_pylist() for k in range(len(columns))), strict=True))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a or tuple(at[:, 0].tolist()) != last:
                    out += judge(rows) if len(rows) > 1 else ()
                    rows = []
                rows = rows + own[a:b] if rows else own[a:b]
            last = tuple(at[:, -1].tolist()) if batch.num_rows else last
            if len(out) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                out = []
        out += judge(rows) if len(rows) > 1 else ()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, *columns).mapInArrow(run, schema)


def _few(members: list[tuple], percent: int):
    """What survivors gives, for a group so small that a tree has nothing to save."""
    for i in range(1, len(members)):
        n, bits, inside, group, side = members[i]
        for j in range(i):
            n2, bits2, inside2, group2, side2 = members[j]
            if 100 * min(n, n2) < percent * max(n, n2) or group == group2 or (side and side == side2):
                continue
            a, b = int.from_bytes(bits, "little"), int.from_bytes(bits2, "little")
            width = 8 * min(len(bits), len(bits2))
            a, b = folded(a, width), folded(b, width)
            common = (a & b).bit_count() + min(inside - a.bit_count(), inside2 - b.bit_count())
            if min(n - inside, n2 - inside2) + min(common, inside, inside2) >= needed(n, n2, percent):
                yield j, i


class Union:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[b] = a
        return a != b


def _candidates(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest, for each group, of the pairs that a traversal leaves over."""

    def judge(rows: list[tuple]) -> list:
        members = [r[:5] for r in rows]
        if len(rows) <= 12:
            found = _few(members, percent)
        else:
            found = survivors([(n, int.from_bytes(bits, "little"), *rest) for n, bits, *rest in members], percent)
        forest, out = Union(len(rows)), []
        for i, j in found:
            if not (rows[i][6] and rows[j][6]) and rows[i][5] != rows[j][5] and forest.join(i, j):
                out.append((min(rows[i][5], rows[j][5]), max(rows[i][5], rows[j][5])))
        return out

    return _by_group(dealt, "token", ["n", "bits", "inside", "g", "side", "s", "late"], judge, "a long, b long").distinct()


def overlaps(own: list[np.ndarray]) -> np.ndarray | None:
    """Intersection sizes of all pairs of sets by products of incidence matrices, or None where those would be too large to pay."""
    sizes = np.array([len(x) for x in own])
    names, ids = np.unique(np.concatenate(own), return_inverse=True)
    if len(names) * len(own) ** 2 > 3e10:
        return None
    who = np.repeat(np.arange(len(own)), sizes)
    order = np.argsort(ids, kind="stable")
    ids, who = ids[order], who[order]
    out = np.zeros((len(own), len(own)), np.float32)
    for at in range(0, len(names), 4096):
        a, b = np.searchsorted(ids, [at, at + 4096])
        part = np.zeros((len(own), min(4096, len(names) - at)), np.float32)
        part[who[a:b], ids[a:b] - at] = 1
        out += part @ part.T
    return out


def _linked(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b, links): for each set that links in its group, one that it is joined to there, and how many links the group counts for it.

    All pairs are judged on whole sets; a pair is counted in one group only, that of its larger set's band and of its blocks.
    """

    def judge(rows: list[tuple]) -> list:
        own = [np.frombuffer(r[0], np.uint64) for r in rows]
        sizes, side, home = np.array([len(x) for x in own]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        common = overlaps(own) if len(rows) > 12 else None
        if common is None:
            profiles = [(len(x), *_bitmap(x), k, r[1]) for k, (x, r) in enumerate(zip(own, rows, strict=True))]
            pairs = _few([(n, bits, inside, g, sd) for n, bits, inside, g, sd in profiles], percent) if len(rows) <= 12 else survivors([(n, int.from_bytes(bits, "little"), inside, g, sd) for n, bits, inside, g, sd in profiles], percent)
            found = [(i, j) for i, j in pairs if _link(own[i], own[j], percent)]
            a, b = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))
        else:
            a, b = np.nonzero(np.triu(100 * common.astype(np.float64) >= percent * (sizes[:, None] + sizes[None, :] - common), 1))
        fine = ((side[a] == 0) | (side[a] != side[b])) & (home[a] | home[b])
        a, b = a[fine], b[fine]
        links = np.bincount(np.concatenate([a, b]), minlength=len(rows))
        label = np.arange(len(rows))
        while len(a):  # least number that links reach
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return [(rows[k][3], rows[label[k]][3], int(links[k])) for k in np.flatnonzero(links).tolist()]

    return _by_group(dealt, "cluster", ["tokens", "side", "home", "s"], judge, "a long, b long, links long")


def _link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _shingled(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(s, tokens): whole sets, as bytes, of the wanted rows (k, k2, s)."""

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, 1 << 20):
            found = sets(*batch_bytes(batch.column(1)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary())], ["s", "tokens"])

    return rows.select("k", "k2", "text").join(wanted, ["k", "k2"]).select("s", "text").mapInArrow(run, "s long, tokens binary").dropDuplicates(["s"])


def _grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(k, k2, doc_id, n, root, n_links): for each row, keyed by row_key, the size of its set and a name of its component; no root without shingles."""
    k, k2 = row_key(id_col, text_col)
    rows = docs.select(k.alias("k"), k2.alias("k2"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = written(_profiles(rows, size, percent), "profiles")
    each = seen.where("n > 0").select("s", "n", "short", F.posexplode("prefix").alias("at", "token"))
    shared = each.groupBy("token").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.min(F.col("at") - F.col("short")).alias("early")).where("lo <> hi and early < 0").select("token")
    met = each.join(shared, "token", "left_semi").groupBy("token", "s").agg(F.first("n").alias("n"), F.min(F.col("at") >= F.col("short")).alias("late"))
    signed = seen.where("n > 0").groupBy("s").agg(F.min(F.struct("k", "k2")).alias("row"), F.max("bits").alias("bits"), F.max("inside").alias("inside"))
    members = met.join(signed.drop("row"), "s").withColumn("g", F.monotonically_increasing_id())
    first = written(_candidates(_dealt(written(members, "members"), percent, "token", BLOCK), percent), "pairs")
    clusters = written(components(first).select(F.col("node").alias("s"), F.col("root").alias("cluster")), "clusters")
    shingled = _shingled(rows, clusters.join(signed.select("s", "row.k", "row.k2"), "s").select("k", "k2", "s"), size)
    sized = written(shingled.join(clusters, "s").withColumn("n", F.octet_length("tokens") / 8), "sets")
    links = written(_linked(_dealt(sized, percent, "cluster", SETS), percent), "links")
    star = written(components(links), "star")
    degree = links.groupBy("a").agg(F.sum("links").alias("n_links"))
    found = seen.select("k", "k2", "doc_id", "n", "s").join(star.select(F.col("node").alias("s"), "root"), "s", "left").join(degree.withColumnRenamed("a", "s"), "s", "left")
    root = F.when(F.col("n") > 0, F.coalesce("root", "s")).alias("root")
    return found.select("k", "k2", "doc_id", F.col("n").cast("bigint").alias("n"), root, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row for each row of docs.

    Sets of `size`-word shingles link at a Jaccard similarity of percent / 100; component_id is the
    smallest doc_id that links reach. n_links counts the other distinct sets that a document's set links with.

    Equal sets become one. Sets that share a shingle of their prefix (so many of least hash that linked sets
    can't miss each other) meet in a group, where a traversal of signature trees leaves pairs that may link; a
    spanning forest of those goes on. What the forests join is a cluster: linked sets are in one cluster, and its whole sets are compared
    with each other. Groups and clusters of very many sets are dealt out by size band and block.

    Null and empty texts have no shingles and no links. A text of fewer words is one shingle. A very long text is
    read whole, in one task, which takes about 60 bytes of memory for each of its bytes.
    Rows that repeat are linked by their equal sets; null ids are reported, but never name a component
    (component_id is null where no id is there). An empty table gives an empty result. Other columns are ignored.
    """
    found = _grouped(docs, size, percent, id_col, text_col)
    least = found.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = found.where("n > 0").join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return out.unionByName(found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "n_links"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one of smallest id; columns as they were.

    A document is an id with its text. Of two linked documents of one id the one of least hash stays; one that is linked with
    none stays, whatever else has its id. A null id ranks last. Rows alike in id and text are one document and stay or go
    together. Null, empty and blank texts stay. Very long texts as in jaccard_components. An empty table gives an empty result.
    """
    found = written(_grouped(docs, size, percent, id_col, text_col).where("n > 0").select("root", F.coalesce("doc_id", F.lit(LAST)).alias("d"), "k", "k2"), "grouped")
    first = found.groupBy("root").agg(F.min(F.struct("d", "k", "k2")).alias("first"))
    one, two = unused(docs, "__k"), unused(docs, "__k2")
    gone = found.join(first, "root").where(F.struct("d", "k", "k2") != F.col("first")).select(F.col("k").alias(one), F.col("k2").alias(two)).distinct()
    k, k2 = row_key(id_col, text_col)
    return docs.withColumns({one: k, two: k2}).join(gone, [one, two], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
