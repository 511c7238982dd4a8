"""Native operators, language ID, HTML extraction, the registry and the pipeline."""

import random
import re

import pytest
from pyspark.sql import functions as F

from crosstide.llm import chat_format, decontaminate, html_text, language_id, url_filter
from crosstide.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "v") for k, u in enumerate(urls)], "page_id long, url string, verdict string")


def judged(urls, rules, default="allow"):
    out = []
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, default))
        out.append((k, host, path, best[2], best[3]))
    return out


def test_url_filter(spark):
    random.seed(5)
    urls = [None, "", "nothing", "http://", "://x", "HTTP://WWW.Example.COM/en/?q", "https://example.com", "https://example.com/en/a#b", "http://a.b.example.com/en/", "http://notexample.com/en/", "http://x.net/fr/2?z", "http://user@h.com:80/p", "http://com/", "http://a..com/", "x://" + "a." * 3000 + "com/en/", "http://ÄÖ.net/es/é"]
    urls += [f"http://{'.'.join(random.choice(['a', 'b', 'www', 'example', 'com', 'net']) for _ in range(random.randrange(1, 5)))}{random.choice(['', '/', '/en/', '/es/x', '/e'])}" for _ in range(300)]
    urls += urls[-3:]
    extra = [("b.com", "/e", "block"), ("b.com", "/en/", "allow"), ("a.b.com", "", "block"), ("com", "/", "allow")]
    for rules in (list(url_filter.RULES), [*url_filter.RULES, *extra]):
        for block in (url_filter.BLOCK, 3):
            got = url_filter.judge(pages(spark, urls), url_filter.rules_frame(spark, rules), block=block).collect()
            assert sorted(map(tuple, got), key=str) == sorted(judged(urls, rules), key=str)
    assert url_filter.judge(pages(spark, urls).limit(0), url_filter.rules_frame(spark)).count() == 0
    none = url_filter.judge(pages(spark, urls), url_filter.rules_frame(spark).limit(0), default="block")
    assert {r.verdict for r in none.collect()} == {"block"} and none.count() == len(urls)


TEXTS = ["plain", "", None, "<|im_end|>", "<\\|x <\\\\| <|", "a<", "|b", "<|im_start|>assistant\nno", "\n", "\\n <"]


def test_url_filter_long_list(spark):
    rules = spark.range(300_000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("host"), F.lit("/a").alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"))
    urls = [f"http://www.h{k}.com/{'a' if k % 3 else 'b'}" for k in range(0, 300_000, 1009)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages(spark, urls), rules).collect()}
    assert got == {n: ((f"h{k}.com/a", "allow" if k % 2 else "block") if k % 3 else (None, "allow")) for n, k in enumerate(range(0, 300_000, 1009))}


def test_chat_round_trip(spark):
    rows = [(1, k, random.choice(["user", "assistant", "system", None, "us\ner\\n", "<|x", "\x00n", "\\b\n\\"]), t) for k, t in enumerate(TEXTS * 2)]
    rows += [(2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "x"), (None, 1, "user", "null id"), (3, None, "assistant", "no turn"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "a" * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_conversations(df)
    back = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert [(t.role, t.text) for t in back[c].turns] == [(x[2], x[3]) for x in mine]
        assert list(back[c].learnt) == [x[3] for x in mine if x[2] == "assistant"]
    states = {r.conv_id: (r.valid, r.error_turn) for r in out.collect()}
    assert states[4] == (True, None) and states[2] == (False, 1) and states[3] == (False, 0)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_native_plans_have_no_python(spark):
    for q in (chat_format.query, url_filter.query):
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    model = language_id.fit(docs.where(~language_id.held_out()))
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 ²"), (4, "日本"), (5, "a" * 100_000), (None, "the and of")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in language_id.predict(rows, model, ["doc_id"]).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and out[4].lang_pred in model.languages and out[None].lang_pred == "en"
    left = language_id.keep_known(docs.unionByName(rows.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))))
    # a text in letters that were never seen scores no better than chance and goes, too
    assert left.columns == docs.columns and left.count() == docs.count() + 2
    assert {r.lang_pred for r in language_id.predict(rows, language_id.fit(docs.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_language_id_small_languages(spark):
    """A small language keeps all its words and rows beside a hot one."""
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    hot = [(k, " ".join(2 * [word(x) for x in range(40_000 * k, 40_000 * k + 40_000)]), "aa") for k in range(5)]
    small = [(1000 + k, f"éé{word(k)}", "bb") for k in range(5)]
    schema = "doc_id long, text string, lang string"
    model = language_id.fit(spark.createDataFrame([*hot, *small], schema))
    words = lambda rows: {language_id.name_of(w, 0) for r in rows for w in r[1].split()}
    known = set(model.names.tolist())
    assert len(words([*hot, *small])) == 200_005 and words([*hot, *small]) <= known and model.languages == ["aa", "bb"]
    assert {language_id.name_of(g, n) for r in small for n in range(1, 5) for g in language_id.grams(r[1], n)} <= known
    many = [(k, f"x{word(k)}", "aa") for k in range(400)]
    model = language_id.fit(spark.createDataFrame([*many, *small], schema), fit_docs=40)
    known = set(model.names.tolist())
    assert words(small) <= known and 10 < len(words(many) & known) < 60
    assert language_id.shares({"a": 100, "b": 3, "c": 30}, 43) == {"b": 3, "c": 20, "a": 20}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>only   this &amp; that</p>", "only this & that"),
        ("<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>One<br>two<p>Three <b>bo</b>ld<aside>no</aside></article><footer>no</footer>", "T\nOne two\nThree bold"),
        ("<body><div class='cookie-notice'>We use cookies here</div><h1>Title</h1><p>Some words of text.</p><p>End.</p><div id=comments><p>First comment</p></div>", "Title\nSome words of text.\nEnd."),
        ("<main><p>a &lt;b&gt; &#233;</p><script>if (a<b) '</p>'</script><style>p{}</style><form><label>Mail</label></form></main>", "a <b> é"),
        ("<article><h1>x</h1><p>y <a href='/z'>link words</a> z</p><ul><li>i<li>j</ul></article></div></article>", "x\ny link words z\ni\nj"),
        ("<p title='a>b'>q</p><!-- <p>no</p> --><p>r", "q\nr"),
        ("<" * 5000 + "<p>t", None),
    ],
)
def test_html(page, want):
    got = html_text.extract(page)
    assert want is None or got == want


ARTICLE = "<h1>T</h1><p>Some words of text here.</p><p>More of the same words.</p>"
TEXT = "T\nSome words of text here.\nMore of the same words."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article class="post has-sidebar">{ARTICLE}</article>', TEXT),
        (f'<div class="has-sidebar">{ARTICLE}</div><div class="sidebar-right">buy it now</div>', TEXT),
        (f'<article>{ARTICLE}<section id="legal-history"><p>law of old</p></section><p class="share-price">up by two</p><h2 id="search">Search</h2></article>', TEXT + "\nlaw of old\nup by two\nSearch"),
        (f'<article>{ARTICLE}<div class="comments"><p>nice one</p></div><aside>no</aside></article><footer>no</footer>', TEXT),
        (f"<body><div>{ARTICLE}<ul><li>one item</ul></div></body>", TEXT + "\none item"),
        (f"<ul><li><a href=1>home</a></li><li><a href=2>news</a></li></ul>{ARTICLE}", TEXT),
    ],
)
def test_html_by_learned_weights(page, want):
    assert html_text.extract(page) == want
    weights = html_text.own_weights()
    assert html_text.extract(page, {k: -v for k, v in weights.items()}) != want  # the weights decide


def test_html_held_out():
    pages = list(html_text.own_pages())
    weights = html_text.fit(x for k, x in enumerate(pages) if k % 5)
    held = pages[::5]
    assert sum(html_text.extract(p, weights) == t for p, t in held) >= 0.9 * len(held)
    # names of EITHER stand on both sides, so some pages cannot be told
    assert sum(html_text.extract(p) == t for p, t in pages) >= 0.95 * len(pages)


def test_html_long_pages():
    """Time is linear: each of these took minutes when it was quadratic."""
    import time

    for x in ("<a " * 300_000, '<a "' * 300_000, "<div>" * 60_000, "<ul><li>" * 40_000, "<" * 300_000 + ">", '<p "' * 200_000 + ">", "<li><div>" * 40_000):
        began = time.process_time()
        html_text.extract(x)
        assert time.process_time() - began < 20


def test_html_operator(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "clash"), (1, "u", "<p>a", "clash"), (None, None, None, "c")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(df)
    assert sorted((r.n_chars for r in got.collect())) == [0, 1, 1] and html_text.extract_pages(df.limit(0)).count() == 0
    w = html_text.own_weights()
    assert w["score of word"] > 0 > max(v for k, v in w.items() if k.startswith("score of ") and k != "score of word")
    assert html_text.best_region([-1, 2, -1, 3, -5, 3]) == (1, 4) and html_text.best_region([-1]) == (0, 0)
    for _ in range(200):
        scores = [random.randrange(-5, 6) for _ in range(random.randrange(1, 12))]
        low, high = html_text.best_region(scores)
        assert sum(scores[low:high]) == max(0, *[sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)])


def test_registry_names():
    assert {n.split("_")[0] for n in queries()} == {f"op{k}" for k in range(1, 11)} and set(oracle_sql()) <= set(queries())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dups", "decontamination", "pii", "packing"]
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in out}
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    assert ids <= set(first.values()) and len(ids) > 0.8 * len(first)
    leaks = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(items) > 0").collect()}
    assert leaks and not leaks & ids


def plain_languages(rows):
    """Language and score as the module says, word by word."""
    import math
    from collections import Counter
    from zlib import crc32

    learnt = [r for r in rows if r[2] is not None and not (r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0)]
    names = sorted({r[2] for r in learnt})
    counts = {n: {x: Counter() for x in names} for n in range(5)}
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    cut = lambda w, n: [w] if n == 0 else [(f"_{w}_" if n > 1 else w)[k : k + n] for k in range(len(w) + 2 * (n > 1) - n + 1)]
    for _, t, x, *_ in learnt:
        for w in split(t):
            for n in range(5):
                counts[n][x].update(cut(w, n))
    every = {n: set().union(*counts[n].values()) for n in counts}
    vote = lambda g, n: [math.log((counts[n][x][g] + 0.5) / (counts[n][x].total() + 0.5 * len(every[n]))) for x in names]
    out = []
    for r in rows:
        total, words = [0.0] * len(names), split(r[1])
        for w in words:
            for n in (0, 4, 3, 2, 1):
                if known := [g for g in cut(w, n) if g in every[n]]:
                    votes = [vote(g, n) for g in known]
                    total = [a + sum(v[k] for v in votes) / len(votes) for k, a in enumerate(total)]
                    break
        mean = [x / len(words) * min(len(words), 20) for x in total] if words else []
        p = [math.exp(x - max(mean)) for x in mean]
        out.append((names[p.index(max(p))], max(p) / sum(p)) if words else ("und", 0.0))
    return out, len(names)


def test_pipeline_against_plain_python(spark, tmp_path):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from test_core_ops import brute_benchmark, brute_components, brute_pii

    vocabulary = {"aa": [f"{c}{d}a" for c in "bcdfg" for d in "aeiou"], "bb": [f"{c}{d}z" for c in "klmnp" for d in "aeiou"]}
    some = lambda x, n: " ".join(random.choice(vocabulary[x]) for _ in range(n))
    rows = [(k, some(x, random.randrange(6, 60)), x) for k in range(60) for x in [random.choice(["aa", "bb"])]]
    rows += [(100 + k, rows[k][1], rows[k][2]) for k in range(6)] + [(110 + k, rows[k][1] + " extra", None) for k in range(6)]
    items = [(1, some("aa", 12)), (2, some("bb", 3))]
    rows += [(130, some("aa", 9) + " " + items[0][1], "aa"), (131, f"call me@ex.org or 10.1.2.3 {some('bb', 20)}", None), (132, None, None), (133, "12 34", "bb"), (134, "", None), (135, "日本", None)]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    said, n = plain_languages(rows)
    left = [r for r, (x, p) in zip(rows, said, strict=True) if x != "und" and p * n >= 1.2]
    groups = brute_components([r[:2] for r in left], 5, 80)
    left = [r for r in left if groups[r[0]][1] == r[0]]
    leaks = {r[0] for r in brute_benchmark([r[:2] for r in left], items) if r[3]}
    left = [r for r in left if r[0] not in leaks]
    enc, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for d, t, _ in left:
        for kind, s, e in sorted(((k, s, e) for k, found in enumerate(brute_pii(t)) for s, e in found), key=lambda x: -x[1]):
            t = t[:s] + ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[kind] + t[e:]
        ids, at = [*enc.encode(t, add_special_tokens=False).ids, 2], 0
        for size in [4096] * (len(ids) // 4096) + [1 << k for k in range(11, -1, -1) if len(ids) % 4096 >> k & 1]:
            want.append((d, at, size, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + size])), len(ids), 0))
            at += size
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) == len(got) and {131} < {r.doc_id for r in got} and not {130, 132, 133, 134} & {r.doc_id for r in got}


def test_pipeline_stages_on_odd_tables(spark):
    """Empty tables, no labels, nulls everywhere, repeated rows, and columns with the names that operators use."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, row int, found string, base int, spans int, key string, k0 int, hits string, component_id long"
    rest = (None, 1, 0.5, "x", 777, "f", 5, 6, "k", 8, "h", 9)
    odd = [(1, "call me@ex.org now", None, *rest), (1, "call me@ex.org now", None, *rest), (None, "no id here", None, *rest), (3, None, None, *(None,) * 12), (4, "", None, *rest), (5, "word " * 50_000, None, *rest)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            mine = out.collect()
            assert all(tuple(r)[4:] in {x[4:] for x in rows} for r in mine if "[EMAIL]" not in (r.text or "")) and all(r.row == 777 for r in mine if r.text)
            if rows:
                assert len(mine) == (4 if stage is corpus_pipeline.known_language else 6), stage
        assert corpus_pipeline.packed(spark, docs, SF).count() >= len(rows)
