"""Buckets, candidate pairs and connected components of documents or lines.

Nothing here gathers links or components to the driver, and no step needs the members
of one component in one task. Signatures of a task travel in packed arrays, dealt by a
range of their hash; members of a large bucket are compared block by block, where only
pairs that sizes and sketches allow, or the links among these, become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import _spark
from ._arrays import mix, release

#: Columns of packed signatures: the part of the hash range, nodes, signatures of each node, signatures.
PACKED = "part int, nodes binary, counts binary, sigs binary"


def packed_rows(node: np.ndarray, sig: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """PACKED rows of (node, signature) pairs, one row a part; a signature keeps its 32 lower bits within the part."""
    part = ((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.lexsort((node, part))
    node, sig, part = node[order], sig[order].astype(np.uint32), part[order]
    head = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (part[1:] != part[:-1]))))
    counts = np.diff(np.append(head, len(node))).astype(np.uint32)
    filled, at = np.unique(part[head], return_index=True)
    runs, cells = np.append(at, len(head)), np.append(head[at], len(node))
    cut = lambda x, edges: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
    for i in range(0, len(filled), 500):
        j = min(i + 500, len(filled))
        yield pa.RecordBatch.from_arrays([pa.array(filled[i:j].astype(np.int32)), cut(node[head], runs[i : j + 1]), cut(counts, runs[i : j + 1]), cut(sig, cells[i : j + 1])], names=["part", "nodes", "counts", "sigs"])


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def bucket_pairs(node: np.ndarray, sig: np.ndarray, small: int, pivots: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((a, b), (group, node)) of the nodes that share a signature.

    A bucket of at most `small` nodes gives all its pairs; a larger one the pairs with
    `pivots` of its nodes, of smallest hash, and its members under a digest of them all.
    """
    none = np.zeros(0, np.uint64)
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    same = sig[1:] == sig[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(sig) else np.zeros(0, bool)
    sig, node = distinct_pairs(sig[shared], node[shared])
    if not len(sig):
        return (none, none), (none, none)
    head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(head, len(sig)))
    left, right, groups, members = [none], [none], [none], [none]
    for m in np.unique(size[(size > 1) & (size <= small)]).tolist():
        cells = node[head[size == m][:, None] + np.arange(m)]
        cells = cells[np.unique(mix(cells, m).sum(1, dtype=np.uint64), return_index=True)[1]]  # each set of members once
        i, j = np.triu_indices(m, 1)
        x, y = distinct_pairs(cells[:, i].ravel(), cells[:, j].ravel())
        left.append(x)
        right.append(y)
    known: set[int] = set()
    for a, m in zip(head[size > small].tolist(), size[size > small].tolist(), strict=True):
        some = node[a : a + m]
        group = int(mix(some, 5).sum(dtype=np.uint64))
        if group not in known:
            known.add(group)
            first = some[np.argsort(mix(some, 6))[:pivots]]
            x, y = np.repeat(first, m), np.tile(some, len(first))
            left.append(np.minimum(x, y)[x != y])
            right.append(np.maximum(x, y)[x != y])
            groups.append(np.full(m, group, np.uint64))
            members.append(some)
    return distinct_pairs(np.concatenate(left), np.concatenate(right)), (np.concatenate(groups), np.concatenate(members))


def met(packed: DataFrame, parts: int, small: int, pivots: int) -> DataFrame:
    """(a, b) pairs, g null, and (g, a) members of large buckets, b null. A task holds the signatures of its parts of the hash range, no texts."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, nodes, counts, sigs in zip(*(batch.column(c).to_pylist() for c in ("part", "nodes", "counts", "sigs")), strict=True):
                held.setdefault(part, []).append((nodes, counts, sigs))
        for part in list(held):
            rows = held.pop(part)
            node, count, sig = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*rows, strict=True), (np.uint64, np.uint32, np.uint32), strict=True))
            (a, b), (g, member) = bucket_pairs(np.repeat(node, count), sig, small, pivots)
            blank = lambda n: pa.nulls(n, pa.int64())
            whole = lambda x: pa.array(x.view(np.int64))
            for i in range(0, len(a), 100_000):
                x, y = a[i : i + 100_000], b[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([blank(len(x)), whole(x), whole(y)], names=["g", "a", "b"])
            for i in range(0, len(g), 100_000):
                x, y = g[i : i + 100_000], member[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([whole(x), whole(y), blank(len(x))], names=["g", "a", "b"])
            rows = node = count = sig = a = b = g = member = None
        release()

    return packed.repartition(parts, "part").mapInArrow(meet, "g long, a long, b long")


def sketches(features: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set, the parities of its features at each bit; as many bits as a power of two of 4 times its size, 64 at least."""
    sizes = np.diff(offsets)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(4 * sizes, 1))).astype(np.int64))
    base = np.concatenate(([0], np.cumsum(bits)))
    place = np.repeat(base[:-1], sizes) + (mix(features, 17) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch brought down to `size` bytes by adding parities of bits that come together; still a lower bound."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), 0)


def mixed_members(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(g, node, root), written, of those `groups` (g, node; distinct) whose nodes have several roots in `roots` (node, root; others stand alone).

    Groups of the same nodes, told by two 64-bit hashes of each, are kept once.
    """
    rooted = groups.join(roots, "node", "left").select("g", "node", F.coalesce("root", "node").alias("root"))
    total = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)"))
    sets = rooted.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), total(1).alias("s1"), total(2).alias("s2"))
    several = sets.filter("lo <> hi").groupBy("m", "s1", "s2").agg(F.min("g").alias("g")).select("g")
    return _spark.written(rooted.join(several, "g", "left_semi"))


def crossing_pairs(mixed: DataFrame, known: DataFrame, same: Callable[[str, str], bool] | None = None, members: int = 1024, features: int = 1_000_000) -> DataFrame:
    """Plausible pairs (a, b) of nodes of one group of `mixed_members` with different roots; `known` has node, size, sketch.

    A group is cut into blocks of about `members` nodes and `features` features, and a
    task compares the sketches of two blocks. Only pairs that sizes and sketches allow
    are rows, each once a task. Where `known` has words, too, they travel to the blocks in
    which their node is in such a pair, and `same` decides of two words at once whether
    they are a link; a task then returns links only, and none between nodes that its
    links connect already, so less than one a node.
    """
    partitions = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = mixed.join(known.select("node", "size"), "node").groupBy("g").agg(F.count("*").alias("m"), F.sum("size").alias("features"))
    blocks = size.select("g", F.ceil(F.greatest(F.col("m") / members, F.col("features") / features)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = mixed.join(blocks, "g").select("g", "node", "root", own.alias("own"), other.alias("other")).select("g", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    columns = ["g", "i", "j", "own", "node", "root", "size", "sketch", *(["words"] if same else [])]

    def in_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.join(known.select("node", *columns[6:]), "node").select(*columns).repartition(partitions, "g", "i", "j").sortWithinPartitions("g", "i", "j", "node")

    def held_blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[:3] != key:
                    if held:
                        yield held
                    key, held = row[:3], []
                held.append(row)
        if held:
            yield held

    def plausible(x: dict, y: dict) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, 1_000_000 // max(1, y["sketch"].size))
        left, right = [], []
        for at in range(0, len(x["node"]), step):
            one = slice(at, at + step)
            differ = np.bitwise_count(x["sketch"][one][:, None] ^ y["sketch"][None]).sum(2, dtype=np.int64)
            na, nb = x["size"][one][:, None], y["size"][None]
            fit = (7 * differ <= na + nb) & (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (x["root"][one][:, None] != y["root"][None])
            if x is y:
                fit &= np.arange(len(fit))[:, None] + at < np.arange(len(y["node"]))[None]
            i, j = np.nonzero(fit)
            left.append(i + at)
            right.append(j)
        return np.concatenate(left), np.concatenate(right)

    def sides_of(rows: list[tuple]) -> tuple[dict, dict] | None:
        """The two blocks of a task; None if one of two is empty."""
        _, first, last, *_ = rows[0]
        width = min(len(r[7]) for r in rows)
        sides = []
        for side in sorted({r[3] for r in rows}):
            mine = [r for r in rows if r[3] == side]
            sides.append({"node": np.array([r[4] for r in mine]), "root": np.array([r[5] for r in mine]), "size": np.array([r[6] for r in mine]), "sketch": np.stack([folded(r[7], width) for r in mine]), "rows": mine})
        return None if first != last and len(sides) < 2 else (sides[0], sides[-1])

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each task whose node is in a plausible pair there."""
        schema = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("own", pa.int32()), ("node", pa.int64()), ("root", pa.int64())])
        out = []
        for rows in held_blocks(batches, columns[:8]):
            if both := sides_of(rows):
                x, y = both
                i, j = plausible(x, y)
                found = {x["rows"][n] for n in np.unique(i).tolist()} | {y["rows"][n] for n in np.unique(j).tolist()}
                out += [r[:6] for r in found]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        release()

    def block_pairs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        if not (both := sides_of(rows)):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y = both
        i, j = plausible(x, y)
        if same:
            above: dict[int, int] = {}

            def top(root: int) -> int:
                while root in above:
                    root = above[root]
                return root

            keep = np.zeros(len(i), bool)
            for at, (one, two) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                a, b = top(x["rows"][one][5]), top(y["rows"][two][5])
                if a != b and same(x["rows"][one][8], y["rows"][two][8]):
                    above[a] = b
                    keep[at] = True
            i, j = i[keep], j[keep]
        a, b = x["node"][i], y["node"][j]
        return np.minimum(a, b), np.maximum(a, b)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for rows in held_blocks(batches, columns):
            a, b = block_pairs(rows)
            left.append(a)
            right.append(b)
            if sum(map(len, left)) > 500_000:
                a, b = distinct_pairs(np.concatenate(left), np.concatenate(right))
                left, right = [], []
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if left:
            a, b = distinct_pairs(np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        release()

    rows = in_blocks(dealt, columns[:8])
    if same:
        rows = in_blocks(rows.mapInArrow(involved, "g long, i int, j int, own int, node long, root long"), columns)
    return rows.mapInArrow(blocked, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer change; each
    step keeps at most as many links as before.
    """
    links, state = _observed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        before, last = links, state
        both = links.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # A centre can have any number of neighbours: this join may be split. A neighbour has few centres.
        # No number of partitions is given, so the last, small rounds are dealt to few tasks.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower.hint("shuffle_hash"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links, state = _observed(small.distinct())
        _spark.drop_written(before)
        if state == last:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined_components(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of the links that gave `roots` (node, root) and of `more` (a, b): only the roots of linked components meet again."""
    of = lambda c: F.coalesce(f"root_{c}", c).alias(c)
    known = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    across = more.join(known("a"), "a", "left").join(known("b"), "b", "left").select(of("a"), of("b"))
    tops = _spark.written(components(across))
    moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    # Nodes that had no link before.
    return moved.unionByName(tops.join(roots, "node", "left_anti"))


def _observed(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The written table of `links` with its count and hash sum, both taken while it is written."""
    seen = Observation()
    table = _spark.written(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
    return table, (seen.get["n"], seen.get["s"])


def by_ids(docs: DataFrame, ids: DataFrame, most: int = 500_000) -> DataFrame:
    """Rows of `docs` whose doc_id is in `ids`; broadcasts the ids only where a count shows at most `most`."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id")
