"""Language ID: known words by their log frequency in each language, unseen ones by ever shorter character n-grams.

The model: for all words learnt from and all their n-grams of 1 to 4 characters (words bounded by `_`) the smoothed
log frequency in each language, under 64-bit hashes of the word or n-gram. A word's vote is its row; an unseen word's is
the mean of its known n-grams of the greatest length at which any is known. A text's votes are averaged, the averages
times at most VOICES words are made probabilities, and the score is that of the best language; of languages that are
equally good, the first by name.

Learning takes whole texts of rows with a non-null language, at most FIT_DOCS of them (about). Languages have equal
shares of these, and what one doesn't need goes to the others: a small language is learnt from all its rows. Within a
language the share is dealt by a hash of the id. No word or n-gram of these rows is left out. Only the text is looked
at in a prediction. The model is two arrays, some 20 bytes and 4 a language for each word or n-gram; it goes to every
worker, and its size is bounded by FIT_DOCS texts. A long text is split into its words at once, so a task holds a few
times the longest text.

`und`, score 0: null text, no letter, or nothing learnt. A text whose letters were never seen gets the first language
(by name) at 1 / languages. Repeated rows each get a row; null ids are never held out. An empty table gives an empty
one. Columns that `predict` is asked to keep and that are named lang_pred or score are replaced by the prediction;
`keep_known` changes no column.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosstide.shipping import ship

from .common import spread, table, tidy

#: Rows learnt from at most, characters of the longest n-gram, words that count in a score.
FIT_DOCS, LONGEST, VOICES = 40_000, 4, 20
#: A language is told if its score is so many times that of chance, one over the number of languages.
SURE = 1.2
UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if there is no letter."""
    found = WORDS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def grams(word: str, n: int) -> list[str]:
    w = f"_{word}_" if n > 1 else word
    return [w[k : k + n] for k in range(len(w) - n + 1)]


def name_of(gram: str, n: int) -> int:
    """64 bits for a word (n = 0) or an n-gram."""
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass"), n)


class Model:
    """languages; names, sorted, of words and n-grams; votes, a row for each name."""

    #: Words whose votes a worker remembers.
    CACHE = 100_000

    def __init__(self, languages: list[str], kinds: np.ndarray, names: np.ndarray, counts: np.ndarray):
        """kinds: n of each name; counts: a row for each name, a column for each language."""
        self.languages = languages
        order = np.argsort(names, kind="stable")
        self.names, kinds, counts = names[order], kinds[order], counts[order].astype(np.float64)
        self.votes = np.zeros((len(names), len(languages)), np.float32)
        for n in range(LONGEST + 1):
            at = kinds == n
            self.votes[at] = np.log((counts[at] + 0.5) / (counts[at].sum(axis=0) + 0.5 * max(1, int(at.sum()))))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("languages", "names", "votes")}

    def known(self, names: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each name whether it is known, and its row."""
        wanted = np.array(names, np.uint64)
        at = np.minimum(np.searchsorted(self.names, wanted), max(0, len(self.names) - 1))
        return (self.names[at] == wanted if len(self.names) else np.zeros(len(wanted), bool)), at

    def votes_of(self, words: list[str]) -> np.ndarray:
        """A row of votes for each word."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        there, at = self.known([name_of(w, 0) for w in words])
        out[there] = self.votes[at[there]]
        left = np.flatnonzero(~there).tolist()
        for n in range(LONGEST, 0, -1):
            said = [grams(words[k], n) for k in left]
            sizes = np.array([len(g) for g in said], np.int64)
            there, at = self.known([name_of(g, n) for gs in said for g in gs])
            owner = np.repeat(np.arange(len(left)), sizes)[there]
            hits = np.bincount(owner, minlength=len(left))
            sums = np.zeros((len(left), len(self.languages)))
            np.add.at(sums, owner, self.votes[at[there]])
            for j in np.flatnonzero(hits).tolist():
                out[left[j]] = sums[j] / hits[j]
            left = [k for j, k in enumerate(left) if not hits[j]]
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Each text's language and score."""
        if "seen" not in self.__dict__:
            self.seen: dict[str, int] = {}
            self.rows = np.zeros((0, len(self.languages)), np.float32)
        counts = [Counter(words_of(t)) if t and self.languages else None for t in texts]
        if len(self.seen) > self.CACHE:
            self.seen, self.rows = {}, self.rows[:0]
        if new := list({w for c in counts if c for w in c if w not in self.seen}):
            self.seen |= {w: k for k, w in enumerate(new, len(self.rows))}
            self.rows = np.concatenate((self.rows, self.votes_of(new)))
        out = []
        for c in counts:
            if not c:
                out.append((UNKNOWN, 0.0))
                continue
            at, often = np.fromiter(map(self.seen.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.float64, len(c))
            n = often.sum()
            mean = (often @ self.rows[at]) / n * min(n, VOICES)
            p = np.exp(mean - mean.max())
            p /= p.sum()
            best = int(p.argmax())
            out.append((self.languages[best], float(p[best])))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n, name, count of a task's rows, n = 0 for words."""
    words: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in words.items():
            found = [counts, *[Counter() for _ in range(LONGEST)]]
            for w, c in counts.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        found[n][g] += c
            for n, f in enumerate(found):
                names = np.array([name_of(g, n) for g in f], np.uint64).view(np.int64)
                many = np.fromiter(f.values(), np.int64, len(f))
                for k in range(0, len(names), 50_000):
                    part = names[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([n] * len(part), pa.int32()), pa.array(part), pa.array(many[k : k + 50_000])], names=["lang", "n", "name", "count"])
        words.clear()

    for b in batches:
        for k in range(0, b.num_rows, 512):
            for lang, text in zip(b.column(0).slice(k, 512).to_pylist(), b.column(1).slice(k, 512).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > 300_000:
                yield from out()
    yield from out()
    tidy()


def shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Rows of each language, `most` in all: equal shares, and what a language doesn't need to the others."""
    out = {}
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, most // (len(sizes) - k))
        most -= out[lang]
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> Model:
    """A model of at most fit_docs rows of labelled (about; dealt by a hash of the id)."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sizes.values()) > fit_docs:
        cuts = F.create_map(*[F.lit(x) for lang, n in shares(sizes, fit_docs).items() for x in (lang, int((2**32) * (n / sizes[lang])))])
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(2**32)) < F.element_at(cuts, F.col("lang")))
    counts = spread(rows.select("lang", "text")).mapInArrow(_counted, "lang string, n int, name long, count long")
    found = counts.groupBy("lang", "n", "name").agg(F.sum("count").alias("count")).toArrow()
    languages = sorted(sizes)
    raw = found.column("name").to_numpy().view(np.uint64)
    names, first, at = np.unique(raw, return_index=True, return_inverse=True)
    matrix = np.zeros((len(names), len(languages)), np.float32)
    column = {lang: k for k, lang in enumerate(languages)}
    said = found.column("lang").combine_chunks().dictionary_encode()
    if len(names):
        of = np.array([column[x] for x in said.dictionary.to_pylist()], np.int64)[said.indices.to_numpy()]
        matrix[at, of] = found.column("count").to_numpy()
    return Model(languages, found.column("n").to_numpy()[first] if len(names) else np.zeros(0, np.int32), names, matrix)


_models: dict[str, Model] = {}


def _judged(docs: DataFrame, model: Model, columns: list[str], text_col: str, schema: StructType, out) -> DataFrame:
    """columns and the text through out(batch, its first columns, predictions)."""
    sent, key, n = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex, len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:  # a worker's one copy, found by name, so that it stays between tasks
            _models.clear()
            _models[key] = sent.value
        for b in batches:
            got = [g for k in range(0, b.num_rows, 256) for g in _models[key].predict_all(b.column(n).slice(k, 256).to_pylist())]
            yield out(b.columns[:n], got)
        tidy()

    return spread(docs.select(*columns, F.col(text_col).alias(f"text {key}"))).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """columns of docs with lang_pred and score."""
    columns = [c for c in columns if c not in ("lang_pred", "score")]
    names = [*columns, "lang_pred", "score"]

    def out(kept: list[pa.Array], got: list[tuple[str, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*kept, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=names)

    schema = StructType([*docs.select(*columns).schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])
    return _judged(docs, model, columns, text_col, schema, out)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sure: float = SURE) -> DataFrame:
    """docs, all columns, without texts whose language can't be told: those without a letter, and those whose best
    language scores under `sure` times chance. Learnt from the labelled ones that aren't held out; without two languages
    to tell apart only texts without a letter go."""
    model, columns = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col), docs.columns
    if len(model.languages) < 2:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))

    least = sure / len(model.languages)

    def out(kept: list[pa.Array], got: list[tuple[str, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(kept, names=columns).filter(pa.array([lang != UNKNOWN and score >= least for lang, score in got], pa.bool_()))

    return _judged(docs, model, columns, text_col, docs.schema, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
