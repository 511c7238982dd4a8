r"""Personal data by bootstrapped contextual extraction.

Base entities (email, ip, card, phone; the patterns below) are the seeds, and keys in formats that nothing else has
(SECRET: long mixed hex numbers and two well-known prefixes) are seeds of the kind secret. Each identifier-like token, a
seed or not, is an instance: SHORTEST or more ASCII letters, digits and ._@/+-, with 3 digits or more (names without
digits are none). Its lexical patterns are what stands before it and what stands after it: two words each, and what is
glued to it. Words that don't fit into REACH characters give no pattern; such an instance, or one at an end of the text,
has the other pattern or none, but is marked like any other. Patterns and instances form a graph: an edge for each pair
that occurs, counted once. Spark scores it by turns. A pattern's confidence for a kind: the scores of its instances of
that kind, over all its instances and all its occurrences beside ordinary words; it needs SUPPORT known instances. An
instance's score: 1 - product of (1 - confidence) over its supported patterns, weak ones too; of equal kinds the first
as listed. After ROUNDS turns, instances of ACCEPT or more are personal data wherever they occur. Base spans always
stay; added ones never overlap them.

The patterns that go to the tasks for counting ordinary words do so in blocks of PATTERNS. Edges are distinct before
they are joined, so a context that a third of the corpus shares is one row.

Null or empty text: no spans. A long text is read in one pass. Repeated rows: a row each. Null ids: as others. An empty
table: an empty one. Other columns: only on request, whatever their names; columns named base and spans are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosstide.shipping import ship

from .common import spread, table, written

#: The order of kinds in every result, and those whose spans are base spans.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
SUPPORT, ACCEPT, ROUNDS, PATTERNS = 5, 0.8, 3, 50_000
#: Characters of an identifier at least, and of a context at most.
SHORTEST, REACH = 6, 200

#: Formats of keys, fixed values.
SECRET = re.compile(r"(?=[0-9]*[a-fA-F])(?:[0-9a-f]{32,}|[0-9A-F]{32,})|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_IDENTIFIER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._@/+-")
_GLUE_BEFORE, _GLUE_AFTER = re.compile(r"\W*"), re.compile(r"\W*\Z")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+: around each @, since no part holds one."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """By kind, in the order of KINDS."""
    out: list[list[tuple[int, int]]] = [emails(text), [], [], []]
    if _DIGITS.search(text):
        # a run of digits matches from its start or not at all, so starts within one are left out
        out[1] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out[2].append(m.span())
        if "+" in text:
            out[3] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """What stands before and after, lower-cased, digits as 0: `<word word glue` and `>glue word word`."""
    out = []
    before = text[max(0, start - REACH) : start]
    words = before.split()
    glue = words.pop() if words and not before[-1].isspace() else ""
    if len(words) > 2 or len(words) == 2 and (start <= REACH or before[0].isspace()):
        out.append(f"<{words[-2]} {words[-1]} {glue}")
    after = text[end : end + REACH]
    words = after.split()
    glue = words.pop(0) if words and not after[0].isspace() else ""
    if len(words) > 2 or len(words) == 2 and (end + REACH >= len(text) or after[-1].isspace()):
        out.append(f">{glue} {words[0]} {words[1]}")
    return [_DIGITS.sub("0", p.lower()) for p in out]


def name_of(identifier: str) -> str:
    """The identifier in lower case; a long one by its hash."""
    low = identifier.lower()
    return low if len(low) <= 80 else xxhash.xxh3_128_hexdigest(low.encode())


def instances(text: str, spans: list[list[tuple[int, int]]]) -> list[tuple[int, int, int | None, str, list[str]]]:
    """start, end, kind (none: not a seed), instance, patterns of each identifier."""
    out, taken = [], sorted((s, e, k) for k, found in enumerate(spans) for s, e in found)
    for s, e, k in taken:
        out.append((s, e, k, name_of(text[s:e]), contexts(text, s, e)))
    done, nearest = 0, 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        s, e = m.span()
        while s > done and text[s - 1] in _IDENTIFIER:
            s -= 1
        while e < len(text) and text[e] in _IDENTIFIER:
            e += 1
        done = e
        while e > s and text[e - 1] in "._@/+-":
            e -= 1
        while s < e and text[s] in "._@/+-":
            s += 1
        while nearest < len(taken) and taken[nearest][1] <= s:
            nearest += 1
        if e - s < SHORTEST or sum(c.isdigit() for c in text[s:e]) < 3:
            continue
        at = nearest
        while at < len(taken) and taken[at][0] < e and taken[at][1] <= s:
            at += 1
        if at < len(taken) and taken[at][0] < e:
            continue
        out.append((s, e, 4 if SECRET.fullmatch(text, s, e) else None, name_of(text[s:e]), contexts(text, s, e)))
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def _scan(n: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, found = [], []
            for at in range(0, b.num_rows, 512):
                for text in b.column(n).slice(at, 512).to_pylist():
                    by_kind = base_spans(text) if text else [[], [], [], []]
                    spans.append([{"kind": k, "start": s, "end": e} for k, x in enumerate(by_kind) for s, e in x])
                    found.append([dict(zip(("start", "end", "kind", "instance", "patterns"), x, strict=True)) for x in instances(text, by_kind)] if text else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(spans, _SPAN), pa.array(found, _FOUND)], names=names)

    return run


def _followers(wanted: list[str]):
    """How often each pattern occurs beside anything. Patterns are found by the first of their two words."""
    before: dict[str, list[tuple[str, str, str]]] = {}
    after: dict[str, list[tuple[str, str, str]]] = {}
    for p in wanted:
        if p[0] == "<":
            first, second, glue = p[1:].split(" ")
            before.setdefault(first, []).append((second, glue, p))
        else:
            glue, first, second = p[1:].split(" ")
            after.setdefault(first, []).append((second, glue, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                for text in b.column(0).slice(at, 512).to_pylist():
                    words = _DIGITS.sub("0", text.lower()).split()
                    for k in [k for k, w in enumerate(words) if w in before]:
                        for second, glue, p in before[words[k]]:
                            if words[k + 1 : k + 2] == [second] and k + 2 < len(words) and _GLUE_BEFORE.match(words[k + 2])[0] == glue:
                                counts[p] += 1
                    for k in [k for k, w in enumerate(words) if w in after]:
                        for second, glue, p in after[words[k]]:
                            if k and words[k + 1 : k + 2] == [second] and _GLUE_AFTER.search(words[k - 1])[0] == glue:
                                counts[p] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "followed"])

    return run


def _ordinary(texts: DataFrame, promising: DataFrame) -> DataFrame | None:
    """(pattern, followed) over all texts, a block of patterns at a time."""
    out, block = None, []

    def scan(block: list[str]) -> DataFrame:
        return texts.mapInArrow(_followers(block), "pattern string, followed long")

    for r in promising.select("pattern").distinct().toLocalIterator():
        block.append(r.pattern)
        if len(block) == PATTERNS:
            out, block = scan(block) if out is None else out.unionByName(scan(block)), []
    if block:
        out = scan(block) if out is None else out.unionByName(scan(block))
    return None if out is None else written(out.groupBy("pattern").agg(F.sum("followed").alias("followed")), "followed")


def accepted(scanned: DataFrame, texts: DataFrame, support: int = SUPPORT, accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame | None:
    """(instance, kind, score) of unseen identifiers; none if no pattern has the support."""
    seen = scanned.select(F.explode("found").alias("f")).select(F.explode("f.patterns").alias("pattern"), "f.instance", "f.kind").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n"))
    edges = written(seen, "edges")
    promising = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("known")).where(F.col("known") >= support)
    followed = _ordinary(texts, promising)
    if followed is None:
        return None
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("n"))
    sizes = sizes.join(followed, "pattern", "left").select("pattern", (F.col("instances") + F.greatest(F.coalesce("followed", F.lit(0)) - F.col("n"), F.lit(0))).alias("all"))
    unseen = edges.where("kind is null").select("pattern", "instance")
    known = edges.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    new = None
    for _ in range(rounds):
        now = known if new is None else known.unionByName(new)
        scored = edges.select("pattern", "instance").join(now, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("known"))
        trusted = scored.where(F.col("known") >= support).join(sizes, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("all") + 0.5)).alias("confidence"))
        best = unseen.join(trusted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        best = best.groupBy("instance").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("b")).select("instance", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
        new = written(best.where(F.col("score") >= accept), "instances")
    return new


def _found(docs: DataFrame, keep: list[str], text_col: str, **how) -> DataFrame:
    """keep's columns as k0, k1 ... with base and spans."""
    ship(docs.sparkSession)
    kept = [f"k{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{text_col}`").alias("text"))
    added = StructType.fromDDL("base array<struct<kind:int,start:long,end:long>>, found array<struct<start:long,end:long,kind:int,instance:string,patterns:array<string>>>")
    schema = StructType([*rows.schema.fields[:-1], *added.fields])
    scanned = spread(rows).mapInArrow(_scan(len(keep), schema.names), schema)
    scanned = written(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    extra = accepted(scanned, spread(rows.select(F.coalesce("text", F.lit("")).alias("text"))), **how)
    span = "array<struct<kind:int,start:long,end:long>>"
    seeds = F.transform(F.filter("found", lambda f: f["kind"] >= len(BASE)), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))).cast(span)
    if extra is None:
        return scanned.select(*kept, "base", F.array_sort(F.concat("base", seeds)).alias("spans"))
    more = scanned.select("row", F.explode("found").alias("f")).where("f.kind is null").select("row", "f.start", "f.end", "f.instance").join(extra, "instance")
    more = more.groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    return scanned.join(more, "row", "left").select(*kept, "base", F.array_sort(F.concat("base", seeds, F.coalesce("more", F.array().cast(span)))).alias("spans"))


def find(docs: DataFrame, keep: list[str], text_col: str = "text", **how) -> DataFrame:
    """keep's columns with base and spans: arrays of struct<kind (place in KINDS), start, end>, code points, end exclusive."""
    keep = [c for c in keep if c not in ("base", "spans")]
    return _found(docs, keep, text_col, **how).toDF(*keep, "base", "spans")


def said(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, each span of the text replaced by its kind, as in [EMAIL]; of overlapping ones the first names the whole."""
    names = docs.columns
    found = _found(docs, names, text_col, **how)
    place = {c: f"k{k}" for k, c in enumerate(names)}
    text, kinds = F.col(place[text_col]), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        new = s["start"] >= a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(new, F.concat(a["parts"], F.array(between, F.element_at(kinds, s["kind"] + 1)))).otherwise(a["parts"]).alias("parts"))

    whole = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    out = found.withColumn(place[text_col], F.when(F.size("spans") > 0, whole).otherwise(text))
    if "n_chars" in place:
        n = place["n_chars"]
        out = out.withColumn(n, F.when(F.size("spans") > 0, F.length(place[text_col]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*place.values()).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
