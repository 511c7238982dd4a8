"""Exact substring dedup by distributed prefix doubling.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller id. Names of strings
are doubled: the name of 2n bytes comes from the pair of names at offsets 0 and n, so all strings of 1, 2, 4, 8 ...
bytes are named in a few vector steps. Names are fingerprints, equal on all machines, so a pair's name needs no table.
Spark ranks names twice. At FIRST bytes, every name that no other document has is unique and its positions leave. At
LENGTH bytes, past the threshold, each surviving name gets the least document id that has it.

To send a pair for every byte at each round would move the corpus many times. So a string of LENGTH bytes is ranked
at the first round through one place in it, the least name of FIRST bytes inside; equal strings have equal places, so
none is lost. Neighbouring strings mostly share the place; a run of them, with its bytes, is what the second round
sees. There the strings themselves are named, by two independent names of 64 bits each: bytes go on 128 equal bits. In
the first round 32 bits of a name within its part are enough, since equal ones of different places only send on more.

1. Documents go to batches by a hash, written as a bucketed table, which the later steps read without a shuffle; it is
   dropped when the result is written, and so are the tables between the steps.
2. Each batch sends its distinct places once, by the name's part; a part says, a bit each, which occur elsewhere.
3. Each batch sends the distinct runs of those, with the least id in the batch that has each; a part finds the
   least id of every string of LENGTH bytes and answers by run and offset.
4. Each batch marks what the answers cover.

Batches and parts follow from the bytes of text, BATCH_BYTES and PART_BYTES each, so neither grows with the input.
Within a batch equal places and runs are sent once, so a passage that a third of the corpus shares reaches a part
once per batch.

Null text: empty. A null id counts as the largest. Repeated ids: neither is smaller, so they don't remove each other.
A long text is in one batch, however long, and named by overlapping stretches. An empty table: none. Other columns are
left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, mixed, removed, table, written

LENGTH, FIRST = 50, 24
#: Bytes of text behind a batch and a part, about.
BATCH_BYTES, PART_BYTES = 3 << 20, 8 << 20
#: Bytes named at once: the arrays of a step stay in the processor's cache.
SLICE = 1 << 18
LAST_ID = 2**63 - 1

#: Names of single bytes and factors, for each of two independent namings.
_BYTES = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(x)) for x in (0x9E3779B97F4A7C15, 0xA24BAED4963EE407)]
_FACTORS = [mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(x)) | np.uint64(1) for x in (0xD1342543DE82EF95, 0x9FB21C651E98DF25)]


def names(data: np.ndarray, sizes: tuple[int, ...], naming: int = 0) -> list[np.ndarray]:
    """For each size (rising), the names of the strings of that size at each place of data where one fits."""
    first, factors = _BYTES[naming], _FACTORS[naming]
    need = [[k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1] for size in sizes]
    powers, out = [first[data]], []
    for k in range(max(n[0] for n in need)):
        p, half = powers[-1], 1 << k
        powers.append(p[:-half] * factors[k] + p[half:] if len(p) > half else p[:0])
    for size, parts in zip(sizes, need, strict=True):
        fits, at = max(0, len(data) - size + 1), 0
        got = np.zeros(fits, np.uint64)
        for k in parts:
            if at:
                got *= factors[32 + k]
            got += powers[k][at : at + fits]
            at += 1 << k
        out.append(mixed(got))
    return out


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings that share their place: text, first start, number of strings, the place's name."""
    found: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            size += len(texts[end])
            end += 1
        lengths = np.array([len(t) for t in texts[at:end]], np.int64)
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        if len(data) >= LENGTH:
            for shift in range(0, len(data), 4 * SLICE):  # a long text by overlapping stretches
                piece = data[shift : shift + 4 * SLICE + LENGTH - 1]
                if len(piece) < LENGTH:
                    break
                low = least(names(piece, (FIRST,))[0], LENGTH - FIRST + 1)
                owner = np.repeat(np.arange(at, end), lengths)[shift : shift + len(low)]
                start = np.cumsum(lengths) - lengths
                inside = np.arange(shift, shift + len(low)) - start[owner - at]
                fits = inside + LENGTH <= lengths[owner - at]
                change = np.concatenate(([True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (fits[1:] != fits[:-1])))
                first = np.flatnonzero(change)
                count = np.diff(np.concatenate((first, [len(low)])))
                ok = fits[first]
                first, count = first[ok], count[ok]
                found.append((owner[first], inside[first], count, low[first]))
        at = end
    if not found:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Batch:
    """A batch's documents in a fixed order, and their runs."""

    def __init__(self, docs: pa.Table, parts: int):
        ids = [LAST_ID if x is None else x for x in docs.column("doc_id").to_pylist()]
        texts = [t.encode("utf-8", "surrogatepass") for t in docs.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids, self.texts, self.null = [ids[k] for k in order], [texts[k] for k in order], {LAST_ID} & set(ids)
        self.owner, self.start, self.count, self.name = runs(self.texts)
        id_of = np.array(self.ids, np.int64)
        doc = id_of[self.owner] if len(self.owner) else self.owner
        #: Distinct names by part and value, and whether two documents of the batch have them.
        pairs = np.lexsort((doc, self.name))
        n, d = self.name[pairs], doc[pairs]
        first = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1]))[: len(n)])
        self.names = n[first]
        last = np.concatenate((first[1:], [len(n)]))[: len(first)] - 1
        self.shared = d[first] != d[last] if len(first) else np.zeros(0, bool)
        self.part = (mixed(self.names) % np.uint64(parts)).astype(np.int64)

    def by_part(self) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(self.part, kind="stable")
        cuts = np.flatnonzero(np.diff(self.part[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            yield int(self.part[at[0]]), at

    def surviving(self, bits: dict[int, bytes]) -> tuple[dict[int, list[bytes]], dict[bytes, tuple[int, int]], np.ndarray, dict[int, list[int]]]:
        """By part the distinct runs, in order; where each is; which runs survive; the least ids by part."""
        keep = np.zeros(len(self.names), bool)
        for part, at in self.by_part():
            if part in bits:
                keep[at] = np.unpackbits(np.frombuffer(bits[part], np.uint8))[: len(at)] > 0
        number = np.searchsorted(self.names, self.name)
        live = np.flatnonzero(keep[number]) if len(number) else number
        parts, place, least_ids = {}, {}, {}
        part_of = self.part[number[live]].tolist()
        for part, o, s, c in zip(part_of, self.owner[live].tolist(), self.start[live].tolist(), self.count[live].tolist(), strict=True):
            text = self.texts[o][s : s + c + LENGTH - 1]
            if text not in place:  # documents come by rising id, so the first has the least
                rows = parts.setdefault(part, [])
                place[text] = (part, len(rows))
                rows.append(text)
                least_ids.setdefault(part, []).append(self.ids[o])
        return parts, place, live, least_ids


def _rows(fields: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


NAMES = [("part", pa.int64()), ("batch", pa.int64()), ("names", pa.binary()), ("shared", pa.binary())]
BITS = [("batch", pa.int64()), ("part", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
RUNS = [("part", pa.int64()), ("batch", pa.int64()), ("sizes", pa.binary()), ("ids", pa.binary()), ("data", pa.binary())]
OUT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())]
_ddl = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}


def _schema(fields: list) -> str:
    return ", ".join(f"{n} {_ddl.get(t, 'array<struct<start:long,end:long>>')}" for n, t in fields)


def _send_names(parts: int):
    def run(docs: pa.Table) -> pa.Table:
        batch, number = Batch(docs, parts), docs.column("batch")[0].as_py()
        return _rows(NAMES, [(part, number, (batch.names[at] >> np.uint64(32)).astype(np.uint32).tobytes(), np.packbits(batch.shared[at]).tobytes()) for part, at in batch.by_part()])

    return run


def _rank_names(rows: pa.Table) -> pa.Table:
    """A bit for each name of each batch: whether it occurs in two documents."""
    batches, blobs, shared = rows.column("batch").to_pylist(), rows.column("names").to_pylist(), rows.column("shared").to_pylist()
    part = rows.column("part")[0].as_py()
    every = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs])
    local = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8))[: len(x) // 4] for s, x in zip(shared, blobs, strict=True)]).astype(bool)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(every), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice |= local
    out, at = [], 0
    for number, x in zip(batches, blobs, strict=True):
        n = len(x) // 4
        out.append((number, part, 0, np.packbits(twice[at : at + n]).tobytes(), None, None))
        at += n
    return _rows(BITS, out)


def _send_runs(parts: int):
    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(RUNS, [])
        batch, number = Batch(docs, parts), docs.column("batch")[0].as_py()
        found, _, _, ids = batch.surviving(dict(zip(said.column("part").to_pylist(), said.column("a").to_pylist(), strict=True)))
        return _rows(RUNS, [(part, number, np.array([len(t) for t in texts], np.uint32).tobytes(), np.array(ids[part], np.int64).tobytes(), pa.compress(b"".join(texts), codec="zstd", asbytes=True)) for part, texts in found.items()])

    return run


def _rank_strings(rows: pa.Table) -> pa.Table:
    """For each run the least ids of its strings, as stretches: number of stretches, their lengths, own id - least id."""
    part, batches = rows.column("part")[0].as_py(), rows.column("batch").to_pylist()
    sizes = [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows.column("sizes").to_pylist()]
    owners = [np.frombuffer(x, np.int64) for x in rows.column("ids").to_pylist()]
    hashes, checks = [], []
    for size, blob in zip(sizes, rows.column("data").to_pylist(), strict=True):
        data, first, at = np.frombuffer(pa.decompress(blob, int(size.sum()), codec="zstd", asbytes=True), np.uint8), 0, 0
        while first < len(size):
            last = first + max(1, int(np.searchsorted(np.cumsum(size[first:]), SLICE, "right")))
            n = int(size[first:last].sum())
            ends = np.cumsum(size[first:last])
            inside = np.ones(n - LENGTH + 1, bool)
            for k in range(1, LENGTH):  # those that would reach into the next run
                cut = ends[:-1] - k
                inside[cut[cut < len(inside)]] = False
            for naming, into in ((0, hashes), (1, checks)):
                into.append(names(data[at : at + n], (LENGTH,), naming)[0][inside])
            first, at = last, at + n
    every, check = np.concatenate(hashes), np.concatenate(checks)
    counts = np.concatenate(sizes) - LENGTH + 1
    own = np.repeat(np.concatenate(owners), counts)
    order = np.argsort(every, kind="stable")
    new = every[order[1:]] != every[order[:-1]]
    if (~new & (check[order[1:]] != check[order[:-1]])).any():  # one name for two strings
        order = np.lexsort((check, every))
        new = (every[order[1:]] != every[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
    heads = np.flatnonzero(np.concatenate(([True], new)))
    low = np.minimum.reduceat(own[order], heads)
    gap = np.empty(len(every), np.int64)
    gap[order] = own[order] - np.repeat(low, np.diff(np.concatenate((heads, [len(every)]))))
    run_at = np.cumsum(counts) - counts
    edge = np.concatenate(([True], gap[1:] != gap[:-1]))
    edge[run_at] = True
    stretch = np.flatnonzero(edge)
    length = np.diff(np.concatenate((stretch, [len(gap)])))
    per_run = np.diff(np.concatenate((np.searchsorted(stretch, run_at), [len(stretch)])))
    out, run, at = [], 0, 0
    for number, size in zip(batches, sizes, strict=True):
        n = per_run[run : run + len(size)]
        total = int(n.sum())
        out.append((number, part, 1, n.astype(np.uint32).tobytes(), length[at : at + total].astype(np.uint32).tobytes(), gap[stretch[at : at + total]].tobytes()))
        run, at = run + len(size), at + total
    return _rows(BITS, out)


def _mark(parts: int, texts: bool):
    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(OUT, [])
        batch = Batch(docs, parts)
        bits, answers = {}, {}
        for row in said.to_pylist():
            if row["kind"] == 0:
                bits[row["part"]] = row["a"]
            else:
                n = np.frombuffer(row["a"], np.uint32).astype(np.int64)
                answers[row["part"]] = (np.concatenate(([0], np.cumsum(n))), np.frombuffer(row["b"], np.uint32).astype(np.int64), np.frombuffer(row["c"], np.int64))
        _, place, live, ids = batch.surviving(bits)
        covered: dict[int, list[tuple[int, int]]] = {}
        for o, s, c in zip(batch.owner[live].tolist(), batch.start[live].tolist(), batch.count[live].tolist(), strict=True):
            part, k = place[batch.texts[o][s : s + c + LENGTH - 1]]
            at, length, gap = answers[part]
            first, last, own = int(at[k]), int(at[k + 1]), ids[part][k]
            for j in range(first, last):
                n = int(length[j])
                if own - int(gap[j]) < batch.ids[o]:
                    covered.setdefault(o, []).append((s, s + n + LENGTH - 1))
                s += n
        rows = []
        for o, (doc, text) in enumerate(zip(batch.ids, batch.texts, strict=True)):
            spans: list[list[int]] = []
            for s, e in sorted(covered.get(o, ())):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            kept, at = [], 0
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            rest = b"".join([*kept, text[at:]])
            rows.append((None if doc == LAST_ID and batch.null else doc, len(text), [{"start": s, "end": e} for s, e in spans], rest if texts else None, hashlib.sha256(rest).hexdigest()))
        return _rows(OUT, rows)

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_bytes, spans (removed bytes, end exclusive, maximal), kept (bytes; null without
    `texts`), kept_sha256."""
    spark = docs.sparkSession
    docs = id_text(docs, id_col, text_col)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cores = spark.sparkContext.defaultParallelism
    batches, parts = max(cores, -(-size // batch_bytes)), max(cores, -(-size // part_bytes))
    buckets = max(cores, batches // 4)
    # a hash of its own, lest batches and buckets go together
    docs = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(batches)))
    name = f"substring_dedup_{uuid.uuid4().hex}"
    docs.repartition(buckets, "batch").write.bucketBy(buckets, "batch").sortBy("batch").option("compression", "zstd").saveAsTable(name)
    try:
        docs = spark.table(name)
        sent = docs.groupBy("batch").applyInArrow(_send_names(parts), _schema(NAMES))
        bits = written(sent.groupBy("part").applyInArrow(_rank_names, _schema(BITS)), "bits")
        found = docs.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(_send_runs(parts), _schema(RUNS))
        answers = written(found.groupBy("part").applyInArrow(_rank_strings, _schema(BITS)), "answers")
        out = written(docs.groupBy("batch").cogroup(bits.unionByName(answers).groupBy("batch")).applyInArrow(_mark(parts, texts), _schema(OUT)), "deduped")
        removed(bits, answers)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"), texts=False)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
