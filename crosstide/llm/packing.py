"""Packing by powers of two: no padding, and no sequence that crosses documents.

A document's ids (its text's, then the end id) are cut into pieces whose lengths are the binary digits of its
length: as many of `max_len` as go in, then falling powers of two. Each piece is a sequence; `bucket` is the power,
so a bucket's sequences have equal length and are batched without padding, max_len >> bucket of them to a full
batch. A piece needs nothing but its own document, so there is no shuffle: rows are numbered within their task, and
the task's number stands above that.

Ids are those of the tokenizer for the whole text, which is split into the tokenizer's words; these are looked up in a
cache of bounded size, or encoded by its BPE model, several hundred at a time: a word ends at the token that carries the
word-end mark. A text with unusual characters or `<|` is split at white space instead, which the tokenizer drops and
which bounds its words, and its unusual chunks go through the tokenizer itself.

Null or empty text: one piece, the end id alone. Repeated rows: a set of pieces each. Other columns are left out.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

MAX_LEN = 4096
END_ID = 2
#: Rows handed on at once.
ROWS = 4000


class ChunkEncoder:
    """text -> its ids as little-endian unsigned 32-bit bytes."""

    CHUNKS, WORDS = 100_000, 600_000
    #: Whatever is not Latin, and the capital I with a dot, whose small form is two characters.
    ODD = re.compile("[^\n\r\t\x20-\x7e\xa1-\u012f\u0131-\u024f]")
    BLANK = re.compile("[ \t\n\r]+")

    def __init__(self, path: str):
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(" "), "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: The tokenizer's own pattern of words, a fixed value.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        #: Its words that aren't runs of letters, in a text without odd characters: a first character that is neither
        #: letter nor blank, and how the word goes on. One class in front lets the search skip letters quickly.
        usual = [c for c in map(chr, range(0x250)) if not self.ODD.match(c) and not c.isspace()]
        marks, numbers = ("".join(map(re.escape, (c for c in usual if unicodedata.category(c)[0] in kind))) for kind in ("CMPSZ", "N"))
        self.between = re.compile(f"[{marks}{numbers}](?:(?<=')(?:s|t|re|ve|m|ll|d)|(?<![{numbers}])[{marks}]*|)")
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, k in self.whole.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.of_chunk: dict[str, bytes] = {}
        self.of_word: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for k in range(0, len(words), 400):
            part = words[k : k + 400]
            ids = np.array(self.words.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, at = ids.tobytes(), 0
                for word, cut in zip(part, cuts.tolist(), strict=True):
                    out[word] = raw[4 * at : 4 * cut]
                    at = cut
            else:  # a word without an end token: one by one
                out |= {w: np.array(self.words.encode(w, add_special_tokens=False).ids, np.uint32).tobytes() for w in part}
        return out

    def words_in(self, chunk: str) -> list[str] | None:
        """The tokenizer's words in a chunk; none if the tokenizer itself has to look at it."""
        stem = chunk.rstrip(".,")
        if stem.isalpha() and not self.ODD.search(stem):
            return [stem.lower()] if len(stem) == len(chunk) else [stem.lower(), chunk[len(stem) :]]
        return None if self.ODD.search(chunk) or "<|" in chunk else self.pattern.findall(chunk.lower())

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that the cache lacks; it takes them in while it has room."""
        got, split, known = {}, {}, self.of_word
        for c in chunks:
            words = self.words_in(c)
            if words is None:
                got[c] = np.array(self.whole.encode(c, add_special_tokens=False).ids, np.uint32).tobytes()
            else:
                split[c] = words
        new = self._encode_words(list({w for ws in split.values() for w in ws if w not in known}))
        for c, ws in split.items():
            got[c] = b"".join([known[w] if w in known else new[w] for w in ws])
        if len(self.of_word) < self.WORDS:
            self.of_word |= new
        if len(self.of_chunk) < self.CHUNKS:
            self.of_chunk |= got
        return got

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        get, rows, gaps, odd_gaps = self.of_word.get, [], [], []
        for t in texts:
            if self.ODD.search(t) or "<|" in t:
                parts = self.BLANK.split(t.strip(" \t\n\r"))
                ids, left = list(map(self.of_chunk.get, parts)), odd_gaps
            else:
                parts = self.between.sub(r" \g<0> ", t.lower()).split()
                ids, left = list(map(get, parts)), gaps
            rows.append(ids)
            k = -1
            for _ in range(ids.count(None)):
                k = ids.index(None, k + 1)
                left.append((ids, k, parts[k]))
        new = self._encode_words(list({w for _, _, w in gaps})) if gaps else {}
        for ids, k, w in gaps:
            ids[k] = new[w]
        if len(self.of_word) < self.WORDS:
            self.of_word |= new
        more = self.learn({c for _, _, c in odd_gaps if c}) if odd_gaps else {}
        more[""] = b""
        for ids, k, c in odd_gaps:
            ids[k] = more[c]
        for ids in rows:
            yield b"".join(ids)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """n as pieces: as many of max_len as go in, then the binary digits of the rest, falling."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, offset long"


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian), doc_tokens, bucket, sequence_id, offset."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len has to be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), np.array([end_id], np.uint32).tobytes()
        for b in batches:
            rows: list[tuple] = []
            ids = b.column(0).to_pylist()
            for k in range(0, b.num_rows, 256):
                for doc, raw in zip(ids[k : k + 256], enc.batch(b.column(1).slice(k, 256).to_pylist()), strict=True):
                    raw += end
                    total, at = len(raw) // 4, 0
                    for n in lengths(total, max_len):
                        rows.append((doc, at, n, raw[4 * at : 4 * (at + n)], total, n.bit_length() - 1, 0))
                        at += n
                if len(rows) >= ROWS:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("offset", pa.int64())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    out = id_text(docs, id_col, text_col).mapInArrow(pieces, SCHEMA)
    return out.select("doc_id", "start", "length", "ids", "doc_tokens", "bucket", F.monotonically_increasing_id().alias("sequence_id"), "offset")


def digests(docs: DataFrame) -> DataFrame:
    """The pieces of docs with a checksum for the ids."""
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
