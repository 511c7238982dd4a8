r"""Benchmark decontamination by suffix arrays of the training texts.

Documents are taken in shards; each shard gets a suffix array over its words, and every suffix of a benchmark item
that starts a window (8 words; a shorter item is one window) is binary-searched in it, for the window's length. That
gives the places of each window; from there the match is followed on to its full length, so that each item found comes
with its longest verbatim match and where that starts. An item's last 7 suffixes start no window and aren't searched;
`longest` is 0 where no window hits. The array holds the suffixes that can matter: those within a run of benchmark
words at least as long as the shortest window; other words can't be part of a match. It is sorted by prefix doubling:
ranks of pairs at growing offsets, until all are unique or longer than any item. Windows with a word that the shard
lacks aren't searched.

The benchmark is taken in blocks of items of MAX_WORDS at most (or one item), one on the driver and in the tasks at a
time; the findings of several blocks are written and then joined by document. Shards are bounded, so a task's memory
doesn't grow with the input, but for a text longer than a shard, which is a shard of its own.

Null or empty text: no words, no hit. Items without words or with a null id: no windows. Rows with equal item_id are
one item. Repeated documents each get a row. Of equally long matches of an item in a document the first one counts. An
empty table of either kind: no hits. Other columns are left out of the report; `clean` keeps all columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.shipping import ship

from .common import id_text, table, written

WINDOW = 8
#: Items with windows in a document that make it contaminated.
MIN_ITEMS = 2
#: Words of the benchmark that go to a task at once, and bytes of text in a shard.
MAX_WORDS, SHARD_BYTES = 4_000_000, 16 << 20

#: A-Z to lower case; whatever is not a digit, a letter or beyond ASCII to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Benchmark:
    """Items as numbers of words, one after the other with a 0 after each, and their windows."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        flat, starts, sizes, owners = [], [], [], []
        self.longest = 0
        for name, text in items:
            ws = words_of(text)
            if not ws:
                continue
            size, at = min(window, len(ws)), len(flat)
            for k in range(len(ws) - size + 1):
                starts.append(at + k)
                sizes.append(size)
                owners.append(len(self.names))
            flat += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            flat.append(0)
            self.longest = max(self.longest, len(ws))
            self.names.append(name)
        self.flat = np.array(flat + [0] * (self.longest + 1), np.int32)
        self.starts, self.sizes, self.owners = (np.array(x, np.int64) for x in (starts, sizes, owners))
        self.shortest = int(self.sizes.min()) if sizes else 0


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions `at` of words sorted by what follows, by prefix doubling; 0 ends a text and sorts first."""
    rank = words.astype(np.int64)
    ranks = np.zeros(len(words), np.int64)
    ranks[at] = rank[at]
    size, unique = 1, False
    while size < depth and not unique:
        ahead = at + size
        inside = ahead < len(words)
        second = np.zeros(len(at), np.int64)
        second[inside] = ranks[ahead[inside]]
        key = ranks[at] * (int(ranks.max(initial=0)) + 1) + second
        values, new = np.unique(key, return_inverse=True)
        ranks[at] = new + 1
        unique, size = len(values) == len(at), size * 2
    return at[np.argsort(ranks[at], kind="stable")]


def common_length(words: np.ndarray, p: np.ndarray, flat: np.ndarray, q: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from p and q on, `most` at most, and the sign of the first difference (words - flat)."""
    n, sign = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        a, b = words[p[live] + n[live]], flat[q[live] + n[live]]
        same = (a == b) & (b != 0)
        sign[live[~same]] = np.sign(a[~same].astype(np.int64) - b[~same])
        live = live[same]
        n[live] += 1
        live = live[n[live] < most[live]]
    return n, sign


def bound(words: np.ndarray, array: np.ndarray, flat: np.ndarray, q: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
    """Where in the suffix array the suffixes that begin with flat[q : q + size] start, or with upper end."""
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(array), np.int64)
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live]) // 2
        n, sign = common_length(words, array[mid], flat, q[live], size[live])
        before = np.where(n == size[live], upper, sign < 0)
        low[live[before]] = mid[before] + 1
        high[live[~before]] = mid[~before]
    return low


def search(texts: list[str | None], bench: Benchmark) -> list[tuple[int, np.ndarray, dict[int, tuple[int, int]]]]:
    """For each text of a shard: words, which of them are hit, by item found its longest match (words, first word)."""
    get = bench.vocabulary.get
    numbers, counts = [], []
    for text in texts:
        ws = words_of(text)
        counts.append(len(ws))
        numbers.append(np.fromiter([get(w, 0) for w in ws], np.int32, len(ws)))
        numbers.append(np.zeros(1, np.int32))
    pad = np.zeros(bench.longest + 1, np.int32)
    words = np.concatenate([*numbers, pad])
    starts = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
    hit, found = np.zeros(len(words) + 1, np.int32), [{} for _ in texts]
    if bench.shortest:
        known = words > 0
        apart = np.concatenate(([-1], np.flatnonzero(~known)))
        position = np.flatnonzero(known)
        after = np.searchsorted(apart, position)
        at = position[apart[after] - apart[after - 1] > bench.shortest]
        if len(at):
            array = suffix_array(words, at, bench.longest)
            seen = np.zeros(len(bench.vocabulary) + 1, bool)
            seen[words[at]] = True
            for k in range(1, bench.shortest):  # a suffix of the array goes on for as long as the shortest window
                seen[words[at + k]] = True
            for k in range(bench.shortest, int(bench.sizes.max())):
                ahead = at + k
                seen[words[ahead[ahead < len(words)]]] = True
            lacking = np.concatenate(([0], np.cumsum(~seen[bench.flat])))
            asked = np.flatnonzero(lacking[bench.starts + bench.sizes] == lacking[bench.starts])
            starts_, sizes_ = bench.starts[asked], bench.sizes[asked]
            low = bound(words, array, bench.flat, starts_, sizes_, False)
            high = bound(words, array, bench.flat, starts_, sizes_, True)
            for k in np.flatnonzero(high > low).tolist():
                size, owner = int(sizes_[k]), int(bench.owners[asked[k]])
                places = array[low[k] : high[k]]
                np.add.at(hit, places, 1)
                np.add.at(hit, places + size, -1)
                most = np.full(len(places), bench.longest)
                n, _ = common_length(words, places, bench.flat, np.full(len(places), starts_[k]), most)
                doc = np.searchsorted(starts, places, "right") - 1
                for d, m, place in zip(doc.tolist(), n.tolist(), (places - starts[doc]).tolist(), strict=True):
                    best = found[d].get(owner)
                    if best is None or (-m, place) < (-best[0], best[1]):
                        found[d][owner] = (m, place)
    covered = np.cumsum(hit) > 0
    return [(counts[k], covered[starts[k] : starts[k] + counts[k]], found[k]) for k in range(len(texts))]


def shards(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of SHARD_BYTES or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SHARD_BYTES, "right")))
        yield at, texts.slice(at, n).to_pylist()
        at += n


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", max_words: int = MAX_WORDS) -> Iterator[Benchmark]:
    """The benchmark on the driver, a block at a time holding max_words at most (or one item); one at least."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).orderBy("id", "text")
    now, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r.text) // 2 + 1
        if now and size + n > max_words and r.id != now[-1][0]:
            yield Benchmark(now)
            now, size = [], 0
        now.append((r.id, r.text))
        size += n
    yield Benchmark(now)


SCHEMA = "doc_id long, n_words long, hits array<struct<start:int,end:int>>, found array<struct<item:string,words:long,start:long>>"
_RUNS, _ITEMS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("item", pa.string()), ("words", pa.int64()), ("start", pa.int64())]))


def _by_name(bench: Benchmark, found: dict[int, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Rows with equal item_id are one item: its best match."""
    out: dict[str, tuple[int, int]] = {}
    for k, (words, start) in found.items():
        name = bench.names[k]
        out[name] = min(out.get(name, (words, start)), (words, start), key=lambda x: (-x[0], x[1]))
    return out


def _scanned(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """docs (doc_id, text) -> SCHEMA."""
    sent = docs.sparkSession.sparkContext.broadcast(bench)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value
        for b in batches:
            for at, texts in shards(b.column(1)):
                rows = search(texts, bench)
                runs = []
                for _, hit, _ in rows:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
                    runs.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                items = [[{"item": x, "words": n, "start": s} for x, (n, s) in sorted(_by_name(bench, r[2]).items())] for r in rows]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array(runs, _RUNS), pa.array(items, _ITEMS)], names=["doc_id", "n_words", "hits", "found"])

    return docs.mapInArrow(scan, SCHEMA)


def _blockwise(docs: DataFrame, first: Benchmark, rest: Iterator[Benchmark], second: Benchmark) -> DataFrame:
    """docs (row, text), a written table -> (row, n_words, hits, found) over all blocks, each block's findings written."""
    asked, parts = docs.select(F.col("row").alias("doc_id"), "text"), None
    for bench in itertools.chain((first, second), rest):
        one = written(_scanned(asked, bench).where("size(hits) > 0 or n_words > 0"), "findings")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """A row for each document: doc_id, n_words, hits (runs of hit words, end exclusive; runs of several blocks may
    overlap), found (each item with its longest match: words, and the first one's place), items, longest (words)."""
    docs, parts = id_text(docs, id_col, text_col), blocks(benchmark, item_col, item_text_col, max_words)
    first = next(parts)
    if (second := next(parts, None)) is None:
        out = _scanned(docs, first)
    else:
        docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        merged = docs.select("row", "doc_id").join(_blockwise(docs, first, parts, second), "row", "left")
        kinds = {f.name: f.dataType.simpleString() for f in merged.schema.fields}
        none = {c: F.array().cast(kinds[c]) for c in ("hits", "found")} | {"n_words": F.lit(0).cast("long")}
        out = merged.select("doc_id", *[F.coalesce(c, x).alias(c) for c, x in none.items()])
    return out.select("doc_id", "n_words", "hits", "found", F.transform("found", lambda x: x["item"]).alias("items"), F.coalesce(F.array_max(F.transform("found", lambda x: x["words"])), F.lit(0).cast("long")).alias("longest"))


def covered(hits) -> F.Column:
    """Words in the union of the runs, which are sorted by start."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(hits, start, lambda a, h: F.struct(F.greatest(a["end"], h["end"]).alias("end"), (a["n"] + F.greatest(h["end"] - F.greatest(a["end"], h["start"]), F.lit(0))).alias("n")))["n"]


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_items: int = MIN_ITEMS, item_col: str = "item_id", item_text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """docs, all columns, without those in which windows of min_items items occur."""
    ship(docs.sparkSession)
    parts, names = blocks(benchmark, item_col, item_text_col, max_words), docs.columns
    first = next(parts)
    if (second := next(parts, None)) is not None:
        kept = [f"k{k}" for k in range(len(names))]
        rows = docs.toDF(*kept).withColumn("row", F.monotonically_increasing_id())
        rows = written(rows, "numbered")
        text = F.coalesce(F.col(kept[names.index(text_col)]), F.lit("")).alias("text")
        found = _blockwise(rows.select("row", text), first, parts, second)
        bad = found.where(F.size("found") >= min_items).select("row")
        return rows.join(bad, "row", "left_anti").select(*kept).toDF(*names)
    place, sent = names.index(text_col), docs.sparkSession.sparkContext.broadcast(first)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value
        for b in batches:
            for at, texts in shards(b.column(place)):
                bad = [len(_by_name(bench, r[2])) >= min_items for r in search(texts, bench)]
                yield b.slice(at, len(texts)).filter(pa.array([not x for x in bad], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= MIN_ITEMS).alias("contaminated")
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS win, least(len(w), 8) AS n FROM bi),
s AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n),
h AS (SELECT di.doc_id, di.i, di.n, bw.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM di) di JOIN bw ON di.n = bw.n AND di.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
