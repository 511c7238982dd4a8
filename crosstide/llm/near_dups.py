"""MinHash near-dedup with an LSH forest: sorted signature orders, longest-common-prefix neighbours, depth by region.

A document's set holds the distinct runs of `width` words; links are confirmed on whole sets. Documents with equal
sets form a class, of which the least id goes on.

The forest: each tree is an order of the signature's values, by which documents are sorted. What neighbours in a tree
share is their longest common prefix; a run of neighbours that share the first 4 values at least (fewer under 0.85) is
a region. A region of CROWD documents or fewer is a leaf. A more crowded one goes a value deeper and falls apart into
the runs that share that too, until each has CROWD or fewer or all DEPTH values are shared. Documents of a region that
was cut go through EXTRA more trees, since deeper prefixes are shared more seldom. Only a crowd of copies stays whole
(an eighth of it or more shares all DEPTH values): its documents do get linked, and then need no more pairs. A leaf's
documents are neighbours, and what hangs together by leaves over all trees is a thicket. A pair at the threshold
misses a region of 4 values in all 16 trees with probability 7e-6; where regions are cut at a depth of 8, it misses
all 64 with 1e-9, at 12 with 5e-5. Sorted runs are cut where the tasks' ranges end, and joined again over these ends.

Thickets are settled on whole sets in cells of CELL documents at most (about; fewer long ones, CELL_BYTES of hashes).
A cell compares signatures, then the sets of the likely pairs that aren't yet connected. Larger thickets are cut into
several cells, each of which sends on SAMPLE documents per component of two or more; samples are settled likewise,
until one cell holds them or they get no fewer. Then every document outside its thicket's largest component is held
against cells that are WIDER times as large, in a thicket of more than 64 of these against those in which it shares a
leaf with some document (it has 64 leaves at most): by signatures first, and with whole sets only the documents of
likely pairs. In a crowd of n that are likely, but not linked, that is the n * n / 512 rows of an exact answer.

Likely: signatures agree in 16 values fewer than the threshold's share of 64, or in more; a linked pair has fewer
with probability 3e-7 at 0.85 and 7e-7 at 0.8.

Null or empty text, or no words: an empty set, linked with nothing. Null ids: linked with nothing, component null,
kept. Repeated ids are one document and share a component, also where their texts differ: each distinct set keeps its
own signature and items and links for itself (an empty text's row apart, which links with nothing). An empty table:
none. Very long texts: a text's set is made at once, in some 100 bytes a word. Other columns are left out of
`components`; `drop_near` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordHashes, id_text, join_keyed, mixed, partitions, removed, shingle_hashes, table, tidy, written

WIDTH, PERCENT = 3, 85
VALUES, TREES, DEPTH, EXTRA = 64, 16, 16, 48
#: Documents of a leaf; of a cell, and bytes of their hashes; documents that a component sends on.
CROWD, CELL, CELL_BYTES, SAMPLE = 2048, 128, 16 << 20, 16
#: Times the documents of a cell that a cell has where documents are held against those of others.
WIDER = 4
#: Documents with sets to make that are broadcast at most; some 300 bytes each.
FEW = 1 << 16

_FACTORS = (mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_hashes = WordHashes()


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The set as sorted distinct hashes."""
    return np.unique(shingle_hashes(_hashes.of(text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()), width))


def signature(items: np.ndarray) -> np.ndarray:
    """The least value of the set under each of VALUES orders."""
    low, high = (items & np.uint64(0xFFFFFFFF)).astype(np.uint32), (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(items), 2048):
        x = low[k : k + 2048, None] * _FACTORS
        x += high[k : k + 2048, None]
        np.minimum(out, x.min(axis=0), out=out)
    return out


def set_key(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (n + m - common)


def shared(percent: int) -> tuple[int, int]:
    """Values that a region shares, and values in which signatures have to agree to be looked at."""
    return 4 if percent >= 85 else 3 if percent >= 75 else 2, max(1, VALUES * percent // 100 - 16)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, key, sig = [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text, width)
                    n.append(len(s))
                    key.append(set_key(s) if len(s) else None)
                    sig.append(signature(s).astype(">u4").tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "key", "sig"])
        tidy(_hashes)

    return run


def _sets(width: int):
    """Rows (doc_id, key, sig, text) -> the sets of those whose text has that key: an id may have several texts. Each
    set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, bytes]] = set()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                keep, items = [], []
                for k, (doc, key, text) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                    if (doc, key) in done:
                        continue
                    s = shingles(text, width)
                    if set_key(s) == key:
                        done.add((doc, key))
                        keep.append(k)
                        items.append(s.tobytes())
                own = part.select(["doc_id", "sig"]).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(items, pa.binary())], names=["doc_id", "sig", "items"])
        tidy(_hashes)

    return run


def orders(trees: range) -> np.ndarray:
    """For each tree the places of its DEPTH values: the first trees begin where no other one does, the others are drawn."""
    drawn = np.random.default_rng(20).permuted(np.tile(np.arange(VALUES), (TREES + EXTRA, 1)), axis=1)
    return np.array([(t * (VALUES // TREES) + np.arange(DEPTH)) % VALUES if t < TREES else drawn[t, :DEPTH] for t in trees])


def _planted(trees: range):
    """Rows (doc_id, sig) -> (tree, key, doc_id): the low halves of the values in the tree's order."""
    order = orders(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                low = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u2").reshape(part.num_rows, VALUES, 2)[:, :, 1]
                for t, places in zip(trees, order, strict=True):
                    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEPTH), part.num_rows, [None, pa.py_buffer(np.ascontiguousarray(low[:, places]).tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, t, np.int32)), keys.cast(pa.binary()), part.column(0)], names=["tree", "key", "doc_id"])

    return run


def common_prefixes(trees: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many leading values each row shares with the row before; the first row and a tree's first: -1."""
    same = keys[1:] == keys[:-1]
    shared_ = np.where(same.all(axis=1), keys.shape[1], same.argmin(axis=1))
    return np.concatenate(([-1], np.where(trees[1:] == trees[:-1], shared_, -1)))[: len(keys)]


def leaves(lcp: np.ndarray, size: int, crowd: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Leaves (first row, row after the last) of sorted rows by the prefixes they share, and which rows lie in a region that was cut."""
    out, cut, depth = [], np.zeros(len(lcp), bool), DEPTH

    def runs(low: int, high: int, d: int) -> list[tuple[int, int]]:
        edge = [low, *(low + 1 + np.flatnonzero(lcp[low + 1 : high] < d)).tolist(), high]
        return [(a, b) for a, b in zip(edge, edge[1:], strict=False) if b - a > 1]

    left = [(a, b, size) for a, b in runs(0, len(lcp), size)]
    while left:
        a, b, d = left.pop()
        if b - a <= crowd or d == depth or max((y - x for x, y in runs(a, b, depth)), default=0) * 8 >= b - a:
            out.append((a, b))
        else:
            cut[a:b] = True
            left += [(x, y, d + 1) for x, y in runs(a, b, d + 1)]
    return sorted(out), cut


LEAVES = [("doc_id", pa.int64()), ("leaf", pa.int64()), ("head", pa.int64()), ("cut", pa.bool_()), ("tree", pa.int32()), ("key", pa.binary())]


def _grown(size: int, crowd: int):
    """Rows (tree, key, doc_id) in order -> rows of leaves: doc_id, leaf, head (its least document), cut; a row without a leaf
    if it was cut off; and the part's two ends, with tree and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, keys, docs, ends = np.zeros(0, np.int32), np.zeros((0, DEPTH), ">u2"), np.zeros(0, np.int64), []

        def batch(doc, leaf, head, cut, tree=None, key=None) -> pa.RecordBatch:
            n = len(doc)
            cols = (doc, leaf, head, cut, tree or [None] * n, key or [None] * n)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, LEAVES, strict=True)], names=[x for x, _ in LEAVES])

        def grow(upto: int, lcp: np.ndarray) -> pa.RecordBatch:
            found, cut = leaves(lcp[:upto], size, crowd)
            doc, leaf, head = [], [], []
            for a, b in found:
                doc += docs[a:b].tolist()
                name = xxhash.xxh3_64_intdigest(trees[a].tobytes() + keys[a].tobytes() + docs[a].tobytes()) >> 1
                leaf += [name] * (b - a)
                head += [int(docs[a:b].min())] * (b - a)
            inside = np.zeros(upto, bool)
            for a, b in found:
                inside[a:b] = True
            off = np.flatnonzero(cut & ~inside)
            flags = [x for a, b in found for x in cut[a:b].tolist()]
            return batch(doc + docs[off].tolist(), leaf + [None] * len(off), head + [None] * len(off), flags + [True] * len(off))

        for b in batches:
            if not b.num_rows:
                continue
            trees = np.concatenate((trees, b.column(0).to_numpy()))
            keys = np.concatenate((keys, np.frombuffer(b"".join(b.column(1).to_pylist()), ">u2").reshape(-1, DEPTH)))
            docs = np.concatenate((docs, b.column(2).to_numpy()))
            if not ends:
                ends.append((int(docs[0]), int(trees[0]), keys[0].tobytes()))
            lcp = common_prefixes(trees, keys)
            upto = int(np.flatnonzero(lcp < size)[-1])  # the last region may go on
            if upto:
                yield grow(upto, lcp)
                trees, keys, docs = trees[upto:], keys[upto:], docs[upto:]
        if len(docs):
            yield grow(len(docs), common_prefixes(trees, keys))
            ends.append((int(docs[-1]), int(trees[-1]), keys[-1].tobytes()))
            yield batch([e[0] for e in ends], [None] * 2, [None] * 2, [False] * 2, [e[1] for e in ends], [e[2] for e in ends])

    return run


def _met(size: int):
    """The parts' ends in order -> links (a, b) between neighbours that share a region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = [], None
        for b in batches:
            for tree, key, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                now = (tree, key[: 2 * size])
                if last and last[0] == now and last[1] != doc:
                    out.append((doc, last[1]))
                last = (now, doc)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def forest(signed: DataFrame, trees: range, size: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """signed (doc_id, sig) -> leaves (doc_id, leaf, head, cut) and links (a, b) between tasks' ends."""
    rows = signed.select("doc_id", "sig").mapInArrow(_planted(trees), "tree int, key binary, doc_id long")
    ordered = rows.repartitionByRange(partitions(signed.sparkSession), "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")
    grown = written(ordered.mapInArrow(_grown(size, crowd), "doc_id long, leaf long, head long, cut boolean, tree int, key binary"), "leaves")
    ends = grown.where("tree is not null").select("tree", "key", "doc_id").repartition(1).sortWithinPartitions("tree", "key", "doc_id")
    return grown.where("tree is null").select("doc_id", "leaf", "head", "cut"), ends.mapInArrow(_met(size), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): the least node reachable. Large star and small star by turns;
    a hub's edges stay where they are (see join_keyed)."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_keyed(both, low, "a", total=2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # a node has a row for each lesser neighbour here, and hubs are the least of theirs: one exchange by node serves
        # the distinct and the least
        large = large.repartition(partitions(now.sparkSession), "a").distinct()
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a"))).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b")
        before, now = now, written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        removed(before)
    pairs = now.groupBy("a").agg(F.min("b").alias("component"))
    return pairs.select(F.col("a").alias("node"), "component").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _settle(percent: int):
    """A cell's documents -> (doc_id, hub): the least document of its component here. Sets of one id are one document."""
    likely = shared(percent)[1]

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
        ids = rows.column("doc_id").to_numpy()[order]
        sigs = np.stack([np.frombuffer(rows.column("sig")[int(k)].as_py(), ">u4").astype(np.uint32) for k in order])
        items = [np.frombuffer(rows.column("items")[int(k)].as_py(), np.uint64) for k in order]
        parent = np.searchsorted(ids, ids).tolist()

        def top(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for k in range(len(ids)):
            for j in np.flatnonzero((sigs[:k] == sigs[k]).sum(axis=1) >= likely).tolist():
                a, b = top(k), top(j)
                if a != b and linked(items[k], items[j], percent):
                    parent[max(a, b)] = min(a, b)
        once = np.unique(ids, return_index=True)[1].tolist()
        return pa.table({"doc_id": pa.array([int(ids[k]) for k in once], pa.int64()), "hub": pa.array([int(ids[top(k)]) for k in once], pa.int64())})

    return run


def _cells(members: DataFrame, cell: int) -> DataFrame:
    """members (doc_id, thicket, n_shingles) with cells: the number of the thicket's cells, and block: which one."""
    sizes = members.groupBy("thicket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / cell), F.ceil(F.sum("n_shingles") * 8 / CELL_BYTES)).cast("int").alias("cells"))
    out = join_keyed(members, sizes, "thicket")
    return out.withColumn("block", F.when(F.col("cells") > 1, F.pmod(F.xxhash64("doc_id", "cells"), F.col("cells"))).otherwise(F.lit(0).cast("long")))


def _samples(members: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, thicket): SAMPLE documents of each component of two or more that a cell of a larger thicket found."""
    own = Window.partitionBy("thicket", "block", "hub")
    rows = members.where("cells > 1").join(found, "doc_id").withColumns({"n": F.count(F.lit(1)).over(own), "at": F.row_number().over(own.orderBy(F.xxhash64("doc_id", F.lit("sample"))))})
    return rows.where((F.col("n") > 1) & (F.col("at") <= SAMPLE)).select("doc_id", "thicket", "n_shingles")


def _cross(percent: int):
    """A cell and a share of its thicket's documents outside the main component -> links (a, b) between components."""
    likely = shared(percent)[1]

    def run(rows: pa.Table) -> pa.Table:
        ids, label, guest = (rows.column(c).to_pylist() for c in ("doc_id", "component", "guest"))
        sigs = np.stack([np.frombuffer(x, ">u4").astype(np.uint32) for x in rows.column("sig").to_pylist()])
        items, parent = rows.column("items"), {c: c for c in label}
        here = np.array([k for k, g in enumerate(guest) if not g], np.int64)

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out = []
        for k in [k for k, g in enumerate(guest) if g]:
            mine = None
            for j in here[(sigs[here] == sigs[k]).sum(axis=1) >= likely].tolist():
                a, b = top(label[k]), top(label[j])
                if a != b:
                    mine = np.frombuffer(items[k].as_py(), np.uint64) if mine is None else mine
                    if linked(mine, np.frombuffer(items[j].as_py(), np.uint64), percent):
                        parent[max(a, b)] = min(a, b)
                        out.append((ids[k], ids[j]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


INVOLVED = "doc_id long, thicket long, block long, share int, component long, guest boolean"


def _likely(percent: int):
    """Signatures of a cell and of guests -> those rows that are in a likely pair of two components."""
    least = shared(percent)[1]

    def run(rows: pa.Table) -> pa.Table:
        sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), ">u4").reshape(rows.num_rows, VALUES).astype(np.uint32)
        label, guest = rows.column("component").to_numpy(), rows.column("guest").to_numpy()
        here, keep = np.flatnonzero(~guest), np.zeros(rows.num_rows, bool)
        for k in np.flatnonzero(guest).tolist():
            met = here[((sigs[here] == sigs[k]).sum(axis=1) >= least) & (label[here] != label[k])]
            keep[met] = True
            keep[k] |= len(met) > 0
        return rows.select(["doc_id", "thicket", "block", "share", "component", "guest"]).filter(pa.array(keep))

    return run


def _leftover(large: DataFrame, label: DataFrame, grown: DataFrame, sets: DataFrame, percent: int, cell: int) -> DataFrame:
    """Links (a, b) across the cells of thickets: every document outside a thicket's main component against the cells, which
    are WIDER than before, of vast thickets only those in which it shares a leaf. large: (doc_id, thicket, n_shingles),
    label: (node, component)."""
    large = _cells(large.select("doc_id", "thicket", "n_shingles"), WIDER * cell)
    rows = large.join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = written(rows.select("doc_id", "thicket", "cells", F.col("block").cast("long").alias("block"), "component"), "large")
    sizes = rows.groupBy("thicket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("thicket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("several")).where("several > 1").select("thicket", "main")
    rows = written(join_keyed(rows, main, "thicket"), "large")
    minor = rows.where("component <> main").select("doc_id", "thicket", "block", "component", "cells")
    #: A document has TREES + EXTRA leaves at most; a thicket of no more cells is looked through without them.
    small = minor.where(F.col("cells") <= TREES + EXTRA).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1)))
    guests = small.select("doc_id", "thicket", F.col("other").alias("block"), "component")
    vast = rows.where(F.col("cells") > TREES + EXTRA)
    if not vast.isEmpty():
        in_leaf = written(grown.where("leaf is not null").join(vast, "doc_id").select("leaf", "doc_id", "thicket", "block", "component", "main"), "in_leaf")
        blocks = in_leaf.select("leaf", F.col("block").alias("other")).distinct()
        met = in_leaf.where("component <> main").join(blocks, "leaf")
        guests = guests.unionByName(met.select("doc_id", "thicket", F.col("other").alias("block"), "component").distinct())
    guests = written(guests, "guests")
    shares = guests.groupBy("thicket", "block").agg(F.ceil(F.count(F.lit(1)) / (WIDER * cell)).cast("int").alias("shares"))
    dealt = guests.join(shares, ["thicket", "block"]).withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit("share")), F.col("shares")).cast("int"))
    hosts = rows.join(shares, ["thicket", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    names = ["doc_id", "thicket", "block", "share", "component"]
    both = dealt.select(*names, F.lit(True).alias("guest")).unionByName(hosts.select(*names, F.lit(False).alias("guest")))
    signatures = sets.select("doc_id", "sig").distinct()
    likely = both.join(signatures, "doc_id").groupBy("thicket", "block", "share").applyInArrow(_likely(percent), INVOLVED)
    likely = written(likely.distinct(), "likely")
    return likely.join(sets, "doc_id").groupBy("thicket", "block", "share").applyInArrow(_cross(percent), "a long, b long")


def _repeated(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of an id that has texts with several sets."""
    several = signed.where("key is not null and doc_id is not null").groupBy("doc_id").agg(F.collect_set("key").alias("keys")).where(F.size("keys") > 1)
    least = several.select(F.col("doc_id").alias("own"), F.explode("keys").alias("key")).join(classes.select("key", "doc_id"), "key")
    return least.select(F.col("own").alias("a"), F.col("doc_id").alias("b")).where("a <> b")


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, cell: int = CELL, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id."""
    docs = id_text(docs, id_col, text_col)
    signed = written(docs.mapInArrow(_sign(width), "doc_id long, n_shingles long, key binary, sig binary"), "signed")
    classes = signed.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "sig", "n_shingles")).alias("r")).select("key", "r.*")
    classes = written(classes, "classes")
    size = shared(percent)[0]
    grown, links = forest(classes, range(TREES), size, crowd)
    if not grown.where("cut").isEmpty():
        cut = classes.join(grown.where("cut").select("doc_id").distinct(), "doc_id", "left_semi")
        more, further = forest(cut, range(TREES, TREES + EXTRA), size, crowd)
        grown, links = grown.unionByName(more), links.unionByName(further)
    edges = grown.where("head <> doc_id").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).unionByName(links)
    thickets = written(components(edges).withColumnRenamed("component", "thicket"), "thickets")

    inside = thickets.withColumnRenamed("node", "doc_id")
    wanted = written(classes.join(inside, "doc_id").select("doc_id", "thicket", "n_shingles", "key", "sig"), "wanted")
    side = wanted.select("doc_id", "key", "sig")
    side = F.broadcast(side) if wanted.count() <= FEW else side
    sets = written(docs.join(side, "doc_id").select("doc_id", "key", "sig", "text").mapInArrow(_sets(width), "doc_id long, sig binary, items binary"), "sets")
    links, large = _repeated(signed, classes), None
    members = _cells(wanted.groupBy("doc_id", "thicket").agg(F.sum("n_shingles").alias("n_shingles")), cell)
    while True:
        members = written(members, "members")
        found = members.join(sets, "doc_id").groupBy("thicket", "block").applyInArrow(_settle(percent), "doc_id long, hub long")
        found = written(found, "settled")
        some = found.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
        links = links.unionByName(some)
        several = members.where("cells > 1")
        n = several.count()
        if not n:
            break
        large = members.where("cells > 1") if large is None else large
        samples = written(_samples(members, found), "samples")
        if samples.count() > n // 2:
            break
        members = _cells(samples, cell)
    label = components(links)
    if large is not None:
        more = _leftover(large, label, grown, sets, percent, cell)
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(written(more, "leftover")))
    named = classes.select("key", F.col("doc_id").alias("node")).join(label, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    return join_keyed(signed.select("doc_id", "n_shingles", "key"), named, "key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, the least id of each component; rows with a null id stay."""
    kept = near_components(docs, id_col=id_col, text_col=text_col, **how).where("doc_id = component_id").select(F.col("doc_id").alias("kept id")).distinct()
    with_id = docs.join(kept, F.col(id_col) == F.col("kept id"), "left_semi")
    return with_id.unionByName(docs.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
