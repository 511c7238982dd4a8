"""Operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstide.llm import decontaminate, fingerprint, near_dups, packing, pii, substring_dedup

random.seed(11)
LETTERS = "abcdefgh"
LONG = " ".join("".join(random.choice(LETTERS) for _ in range(5)) for _ in range(30_000))


def text(n, words=40):
    return " ".join(f"w{random.randrange(words)}" for _ in range(n))


def corpus(spark, rows):
    """documents with columns whose names clash with those of the operators."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("x").alias("batch"), F.lit(1).alias("row"), F.lit("y").alias("key"), F.lit(2).alias("part"), F.lit(3).alias("component_id"), F.lit("z").alias("kept"))


ODD = [(None, "a null id with words in it"), (901, None), (902, ""), (903, " \n\t"), (904, "one"), (905, "one"), (905, "one"), (906, LONG)]


def brute_substrings(docs):
    first, out = {}, []
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark):
    share = text(30)
    docs = [(k, random.choice([text(12), share, text(5) + share + text(6), "ü" * 70 + share[:60], "a" * random.randrange(40, 200)])) for k in range(80)]
    docs += [(d, t) for d, t in ODD if d is not None and len(t or "") < 1000] + [(950, docs[3][1]), (951, docs[3][1]), (7, docs[9][1]), (800, text(60_000, 10_000)[:300_000])]
    out = substring_dedup.dedup(corpus(spark, docs), batch_bytes=20_000, part_bytes=30_000)
    got = sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
    assert got == brute_substrings(docs)
    assert substring_dedup.dedup(corpus(spark, docs[:0] + [(1, "x")]).limit(0)).count() == 0
    assert [r.doc_id for r in substring_dedup.dedup(corpus(spark, [(None, "n" * 60)])).collect()] == [None]


def sets_of(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    n = min(width, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_components(docs, width, percent):
    s = {}
    for d, t in docs:
        s[d] = sets_of(t, width)
    parent = {d: d for d in s}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(s[a] & s[b])
            if n and 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s[d]), top(d)) for d in s}


@pytest.mark.parametrize("cell", [256, 8])
def test_near_dups(spark, cell):
    base = [f"w{i}" for i in range(50)]
    docs = []
    for k in range(90):
        w = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            w[random.randrange(50)] = f"x{random.randrange(99)}"
        docs.append((2 * k + 1, " ".join(w)))
    docs += [(500 + k, text(25)) for k in range(20)] + ODD
    want = brute_components([x for x in docs if x[0] is not None], 3, 85)
    got = near_dups.near_components(corpus(spark, docs), cell=cell).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None
    kept = near_dups.drop_near(corpus(spark, docs), cell=cell)
    assert {r.doc_id for r in kept.collect()} == {d for d, v in want.items() if v[1] == d} | {None} and "batch" in kept.columns
    assert near_dups.near_components(corpus(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("cell", [256, 2])
def test_near_dups_of_repeated_ids(spark, cell):
    """Each text of a repeated id links for itself, and the id is one document."""
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abcdef"]
    a, b, c, d, e, f = texts
    near = lambda t: t + " more"
    docs = [(1, a), (1, b), (2, near(a)), (3, near(b)), (10, c), (11, c), (11, d), (12, near(d)), (20, e), (21, near(e)), (22, f)]
    want = {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20, 22: 22}
    got = near_dups.near_components(corpus(spark, docs), cell=cell).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((k, want[k]) for k, _ in docs)


def test_near_dups_crowds(spark):
    """Documents that share most of their words: regions that are cut, extra trees, thickets of many cells."""
    base = [f"w{k}" for k in range(60)]
    rows = [base + text(random.choice([8, 14, 20]), 3000).split() for _ in range(120)]
    for _ in range(50):
        t = list(random.choice(rows[:120]))
        t[random.randrange(len(t))] = "x"
        rows.append(t)
    docs = [(k, " ".join(t)) for k, t in enumerate(rows)]
    want = {d: v[1] for d, v in brute_components(docs, 3, 85).items()}
    got = near_dups.near_components(corpus(spark, docs), cell=4, crowd=8).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_dups_recall(spark):
    """All 10,000 documents of sf0.1 against an exact join by prefixes of the sets, rarest items first."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: near_dups.shingles(r.text or "", 3) for r in docs.collect()}
    count, first, near = {}, {}, []
    for h in np.concatenate(list(sets.values())).tolist():
        count[h] = count.get(h, 0) + 1
    for d, s in sets.items():
        ordered, met = sorted(s.tolist(), key=lambda h: (count[h], h)), set()
        for h in ordered[: len(s) - (-(-len(s) * 85 // 100)) + 1 if len(s) else 0]:
            met |= set(first.get(h, ()))
            first.setdefault(h, []).append(d)
        near += [(d, e) for e in met if near_dups.linked(s, sets[e])]
    group = {r.doc_id: r.component_id for r in near_dups.near_components(docs).collect()}
    assert len(near) > 100 and sum(group[a] == group[b] for a, b in near) >= 0.99 * len(near)


def test_leaves():
    lcp = np.array([-1, 4, 16, 16, 7, 4, 4, 5, 2, 9])
    assert near_dups.leaves(lcp, 4, 100)[0] == [(0, 8), (8, 10)]
    found, cut = near_dups.leaves(np.array([-1, *[4] * 20, 6, 6, 4, 4]), 4, 8)
    assert found == [(20, 23)] and cut.all()
    assert near_dups.leaves(np.array([-1, *[16] * 20, 4, 4]), 4, 8)[0] == [(0, 23)]  # a crowd of copies


def brute_benchmark(docs, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in docs:
        w, hit, found = word(t), set(), set()
        for i, x in items:
            v = word(x)
            n = min(8, len(v))
            for k in range(len(v) - n + 1 if v and i is not None else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [decontaminate.MAX_WORDS, 25])
def test_decontamination(spark, most):
    items = [(k, text(random.randrange(1, 30), 12)) for k in range(9)] + [(10, "É-é ÉA b"), (11, None), (12, "!!"), (None, "w1 w2"), (3, text(9, 12))]
    docs = [(k, text(60, 14)) for k in range(30)] + [(40, f"{items[2][1]}, {items[4][1].upper()}!"), (41, "x É É eÉ éÉ é-éa-B É é é"), (42, "É é Éa b")] + [x for x in ODD if x[0] != 906]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(corpus(spark, docs), bench, max_words=most).withColumn("n", decontaminate.covered(F.col("hits"))).collect()
    assert sorted(((r.doc_id, r.n_words, r.n, len(r["items"]), ",".join(r["items"])) for r in got), key=str) == brute_benchmark(docs, items)
    left = decontaminate.clean(corpus(spark, docs), bench, max_words=most)
    assert left.count() == sum(x[3] < 2 for x in brute_benchmark(docs, items)) and left.columns == corpus(spark, docs).columns
    none = decontaminate.matches(corpus(spark, docs), bench.limit(0)).collect()
    assert all(not r["items"] and not r.hits for r in none) and decontaminate.matches(corpus(spark, docs).limit(0), bench).count() == 0


def test_fingerprints(spark):
    docs = [(k, random.choice([text(80), text(3), "", "ä" * 9])) for k in range(60)] + [(5, "tie"), *ODD]
    got = fingerprint.fingerprints(corpus(spark, docs)).collect()
    ordered = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = []
    for k, (d, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        want.append((d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        by_text.setdefault(r.n_chars if r.n_chars < 9 else r.doc_id, set())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in got if r.doc_id in (904, 905)}) == 1
    a, b = fingerprint.fingerprint(LONG), fingerprint.fingerprint(LONG[: len(LONG) // 2])
    assert abs(fingerprint.likeness(a, b) - 0.5) < 0.15 and np.array_equal(a, fingerprint.unpacked(fingerprint.packed(a)))
    assert fingerprint.fingerprints(corpus(spark, docs).limit(0)).count() == 0
    words = [fingerprint.fingerprint(" ".join(f"q{k}x{j}" for j in range(k % 5 + 1))) for k in range(250)]
    unlike = [fingerprint.likeness(a, b) for k, a in enumerate(words) for b in words[:k]]
    assert max(unlike) < 0.2 and sum(unlike) / len(unlike) < 0.02  # short texts agree by chance no more than long ones
    one = fingerprint.fingerprints(corpus(spark, [(1, "just one")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_pii(t):
    def good(k, x):
        d = re.sub("[^0-9]", "", x)
        return k == 0 or k == 1 and all(int(p) <= 255 for p in x.split(".")) or k == 2 and 16 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 8 <= len(d) <= 15

    return [[m.span() for m in re.finditer(p, t) if good(k, m[0])] for k, p in enumerate(PATTERNS)]


def test_pii_base_patterns():
    for _ in range(4000):
        t = "".join(random.choice("ab1.@-_%+ 94()") for _ in range(60))
        assert pii.base_spans(t) == brute_pii(t), t
    assert pii.base_spans("1" * 100_000 + "@" * 1000 + "+" * 1000) is not None


def test_pii_bootstrapping(spark):
    docs = [(k, f"please write to user{k}@mail.example.com soon") for k in range(10)] + [(50, "please write to jane88776 soon"), (51, "see chapter 20240101 now"), (52, "4111 1111 1111 1111 é 10.0.0.1 +1 (555) 123-4567"), *ODD]
    got = {r.doc_id: r for r in pii.find(corpus(spark, docs), ["doc_id"]).collect()}
    assert [(s.kind, s.start, s.end) for s in got[50].spans] == [(0, 16, 25)] and got[50].base == [] and got[51].spans == []
    assert [s.kind for s in got[52].spans] == [1, 2, 3] and got[901].spans == []
    clean = {r.doc_id: r.text for r in pii.redact(corpus(spark, docs)).collect()}
    assert clean[50] == "please write to [EMAIL] soon" and clean[52] == "[CARD] é [IP] [PHONE]" and clean[901] is None and clean[906] == LONG
    assert pii.redact(corpus(spark, docs)).columns == corpus(spark, docs).columns and pii.find(corpus(spark, docs).limit(0), ["doc_id"]).count() == 0


def test_pii_without_context(spark):
    """An accepted identifier is marked where no two words come before it, too."""
    docs = [(k, f"please write to user{k}@mail.com today") for k in range(20)]
    docs += [(30, "please write to jane88776 today"), (31, "jane88776 wrote"), (32, "hi JANE88776"), (33, "a " + "x" * 90 + " jane88776"), (34, "bob12345 wrote"), (35, "a@mail.com wrote")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(corpus(spark, docs), ["doc_id"]).collect()}
    assert [got[k] for k in range(30, 36)] == [[(0, 16, 25)], [(0, 0, 9)], [(0, 3, 12)], [(0, 93, 102)], [], [(0, 0, 10)]]
    clean = {r.doc_id: r.text for r in pii.redact(corpus(spark, docs)).collect()}
    assert clean[31] == "[EMAIL] wrote" and clean[32] == "hi [EMAIL]"


def test_pii_weak_patterns(spark):
    """Two patterns of 0.63 make 0.86; one of them is not enough."""
    docs = [(10 * a + k, f"{p} user{a}{k}@mail.com today") for a, p in enumerate(("please write", "contact him")) for k in range(6)]
    docs += [(30, "please write soon"), (31, "contact him soon"), (32, "contact him later"), (40, "please write jane88776"), (41, "contact him jane88776"), (42, "please write bob12345")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(corpus(spark, docs), ["doc_id"]).collect()}
    assert got[40] == [(0, 13, 22)] and got[41] == [(0, 12, 21)] and got[42] == []


def test_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    hard = ["don't I'LL we've 've x's", "a\x1cb\x85c\xa0d\u2003e", "<|endoftext|> a<|startoftext|>b <| |>", "²³ ½ x2y3", "ΑΣ ΟΔΟΣ", "e\u0301 é İ ǅ ﬁ", "日本語 text", "\U0001f600 ok", "...,,, !!", "a" * 5000, "Ünï-cödé, (w/ 123.45)"]
    docs = [(k, t) for k, t in enumerate(hard)] + [(k + 20, text(random.randrange(9000), 3000)) for k in range(12)] + ODD
    out = packing.pack(corpus(spark, docs), path).collect()
    by: dict = {}
    for r in out:
        assert r.offset == 0 and r.length == 1 << r.bucket and r.length <= 4096 and len(r.ids) == 4 * r.length
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert len({r.sequence_id for r in out}) == len(out)
    for d, t in docs:
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        rows = sorted(by[(d, len(want))], key=lambda r: r.start)
        if d != 905:
            assert b"".join(bytes(r.ids) for r in rows) == want.tobytes(), t[:50]
            assert zlib.crc32(want.tobytes()) == zlib.crc32(b"".join(bytes(r.ids) for r in rows))
    assert packing.lengths(4096 * 2 + 13) == [4096, 4096, 8, 4, 1] and packing.pack(corpus(spark, docs).limit(0), path).count() == 0


def test_packing_ids_of_odd_mixtures():
    public = pytest.importorskip("public_tokenizers")
    enc, r = packing.ChunkEncoder(public.path("word_bpe_49k.json")), random.Random(5)
    usual = [c for c in map(chr, range(0x20, 0x250)) if not enc.ODD.match(c)]
    pools = [usual, list("ab'stmdrevl .,1\n"), list("abcé'ES T<|>12!-_"), usual + list("İ\u0301中\x00\x0b\x85\xa0\u200bΣς"), list("'stmrdvel")]
    texts = ["'", "''s", "!'s", "'small", "1's", "Ⱥbc ȺȾ", "x\xadx", *("".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(300) for pool in pools)]
    for _ in range(2):  # the second time from the cache
        for t, got in zip(texts, enc.batch(texts), strict=True):
            assert got == np.array(enc.whole.encode(t, add_special_tokens=False).ids, np.uint32).tobytes(), repr(t)


def test_pii_redaction_keeps_other_columns(spark):
    schema = "row int, doc_id int, text string, found int, base double, spans string, more string, `a.b` string, n_chars int"
    rows = [(777, 1, "call john@ex.org now", 2, 3.5, "x", "y", "z", 20), (778, 1, None, None, None, None, None, None, None), (779, 2, "token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", 0, 0.0, "", "", "", 46)]
    out = sorted(map(tuple, pii.redact(spark.createDataFrame(rows, schema)).collect()))
    assert out == [(777, 1, "call [EMAIL] now", 2, 3.5, "x", "y", "z", 16), rows[1], (779, 2, "token [SECRET]", 0, 0.0, "", "", "", 14)]


def test_pii_finds_unseen_keys(spark):
    keys = [(k, f'so token = "{random.getrandbits(160) | 0xABC << 148:040x}" then') for k in range(8)]
    docs = [*keys, (50, 'so token = "Zx93-44k1" then'), (51, "Zx93-44k1 opens this"), (52, "page 20240101 of it")]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(corpus(spark, docs), ["doc_id"]).collect()}
    assert found[50] == [(4, 12, 21)] and found[51] == [(4, 0, 9)] and found[52] == [] and all(found[k] for k in range(8))
    assert sum(len(x.spans) for x in pii.find(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ["doc_id"]).collect()) > 82


def test_decontamination_places(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x y")], "n long, said string")
    docs = corpus(spark, [(1, "z a b c d e f g h i, then A B C D E F G H I J"), (2, "x y"), (3, "a b c d e f g")])
    got = {r.doc_id: r for r in decontaminate.matches(docs, items, item_col="n", item_text_col="said").collect()}
    assert [tuple(x) for x in got[1].found] == [("1", 10, 11)] and got[1].longest == 10
    assert [tuple(x) for x in got[2].found] == [("2", 2, 0)] and not got[3].found
