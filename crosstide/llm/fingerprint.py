"""Document fingerprints: one-permutation MinHash with optimal densification, kept as low-order bits.

Each shingle of five words is hashed once; the top bits of the hash say its bin, and a bin keeps its least hash. An
empty bin copies the bin that a hash of (bin, attempt) leads to, with attempts until a full one is met, so that two
documents' empty bins meet as their full ones do (optimal densification). BITS low-order bits of each bin are stored,
of the hash mixed with the bin's number: else all copies of one hash would keep the same bits, and agree by chance all
together. Bins of different shingles agree by chance with probability 2^-BITS, each for itself; the likeness takes that
out: (agreeing - c) / (1 - c) with c = 2^-BITS, not under 0. For texts without a common shingle it stays under 0.1 but
for one in 10^5 or so, however short they are.

Documents without words have the fingerprint of no shingle, all zero with the mark `-`; two such are alike (1), one
such and another are not (0). Null text: empty. Repeated ids are ordered by text; null ids come last. Other columns
are left out.

Edited texts need the next document by falling id: documents are dealt by ranges of it and sorted; a range's last
document and its first one are handed on with their texts, and a second pass joins the ranges' ends. That pass reads
two documents for each range. An empty table: none. A long text is shingled at once, in some 100 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordHashes, id_text, mixed, partitions, shingle_hashes, table, tidy, written

BINS, BITS, WIDTH = 256, 4, 5
_hashes = WordHashes()


def _attempts(bins: int, rounds: int = 64) -> np.ndarray:
    """Where bin b goes at attempt r: row r, column b."""
    r, b = np.meshgrid(np.arange(rounds, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (mixed(mixed(r + np.uint64(0x51ED27)) + b) % np.uint64(bins)).astype(np.int64)


_GO = {BINS: _attempts(BINS)}


def fingerprint(text: str, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> np.ndarray | None:
    """The low-order bits of each bin; None if there are no words. Bins: a power of two."""
    return of_shingles(shingle_hashes(_hashes.of(text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()), width), bins, bits)


def of_shingles(h: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    if not len(h):
        return None
    h = np.sort(h)
    top = (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    least, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    least[top[first]], full[top[first]] = h[first], True
    if len(first) < bins:
        go = _GO.setdefault(bins, _attempts(bins))
        empty = np.flatnonzero(~full)
        for row in go:
            to = row[empty]
            met = full[to]
            least[empty[met]] = least[to[met]]
            empty = empty[~met]
            if not len(empty):
                break
        if len(empty):  # no full bin met in all attempts: the first full one
            least[empty] = h[0]
    own = mixed(np.arange(1, bins + 1, dtype=np.uint64))
    return (mixed(least ^ own) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(f: np.ndarray | None, bins: int = BINS, bits: int = BITS) -> str:
    if f is None:
        return "-" + "0" * (bins * bits // 4)
    return "+" + np.packbits(np.unpackbits(f[:, None], axis=1)[:, 8 - bits :]).tobytes().hex()


def unpacked(s: str, bins: int = BINS, bits: int = BITS) -> np.ndarray | None:
    if s[0] == "-":
        return None
    flat = np.unpackbits(np.frombuffer(bytes.fromhex(s[1:]), np.uint8)).reshape(bins, bits)
    return np.packbits(np.concatenate((np.zeros((bins, 8 - bits), np.uint8), flat), axis=1))


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimate of the Jaccard similarity of the shingle sets, without the matches by chance."""
    if a is None or b is None:
        return float(a is None and b is None)
    c = 2.0**-bits
    return max(0.0, (float(np.mean(a == b)) - c) / (1 - c))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
EDGE = [("part", pa.int64()), ("place", pa.int64()), ("text", pa.string())]
_ddl = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
SCHEMA = ", ".join(f"{n} {_ddl[t]}" for n, t in FIELDS)
EDGE_SCHEMA = f"{SCHEMA}, " + ", ".join(f"{n} {_ddl[t]}" for n, t in EDGE)


def _row(doc: int, text: str, fp: np.ndarray | None, after: str, after_fp: np.ndarray | None) -> tuple:
    new = edited(text, after)
    new_fp = fp if new == text else fingerprint(new)
    return doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), packed(fp), packed(new_fp), likeness(fp, new_fp), likeness(fp, after_fp)


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range but its last; its first and last document with their texts, place 0 and 1."""
    from pyspark import TaskContext

    part, last, rows, none = TaskContext.get().partitionId(), None, [], (None,) * len(FIELDS)
    for b in batches:
        for k in range(0, b.num_rows, 512):
            for doc, text in zip(b.column(0).slice(k, 512).to_pylist(), b.column(1).slice(k, 512).to_pylist(), strict=True):
                fp = fingerprint(text)
                if last is None:
                    rows.append((doc, *none[1:], part, 0, text))
                else:
                    rows.append((*_row(*last, text, fp), None, None, None))
                last = (doc, text, fp)
            yield _batch(rows, FIELDS + EDGE)
            rows = []
    if last is not None:
        yield _batch([(last[0], *none[1:], part, 1, last[1])], FIELDS + EDGE)
    tidy(_hashes)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over all ranges' ends in order: each last document meets the first one of the next range, the very last the very first."""
    start = last = None
    for b in batches:
        rows = []
        for doc, place, text in zip(b.column("doc_id").to_pylist(), b.column("place").to_pylist(), b.column("text").to_pylist(), strict=True):
            fp = fingerprint(text)
            if place == 1:
                last = (doc, text, fp)
                continue
            start = start or (text, fp)
            if last is not None:
                rows.append(_row(*last, text, fp))
        if rows:
            yield _batch(rows, FIELDS)
    if last is not None:
        yield _batch([_row(*last, *start)], FIELDS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: FIELDS, see the module."""
    docs = id_text(docs, id_col, text_col)
    order = (F.col("doc_id").desc_nulls_last(), F.col("text"))
    dealt = docs.repartitionByRange(partitions(docs.sparkSession), order[0]).sortWithinPartitions(*order)
    found = written(dealt.mapInArrow(_inside, EDGE_SCHEMA), "fingerprints")
    names = [n for n, _ in FIELDS]
    ends = found.where("part is not null").select("doc_id", "part", "place", "text").repartition(1).sortWithinPartitions("part", "place")
    return found.where("part is null").select(*names).unionByName(ends.mapInArrow(_ends, SCHEMA))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
