"""Encoding of the whole corpus with a public tokenizer, by a table of distinct words.

Byte-level BPE never joins across the words its pattern cuts, so each distinct word is encoded
once: split the texts, count words (summed per batch before the shuffle), encode the distinct
ones, and put the ids back by position. The most frequent words, a bounded number of bounded
length, are sent to the tasks; only the rest are joined, so no hot word ever meets in one task.
`decode` goes back through an id-to-piece join.

Defined results: null and empty texts have no ids (an empty list); blanks, control characters and
special-token strings in a text are ordinary text; equal texts get equal ids; very long texts are
encoded whole; rows are kept one for one, repeated ids included.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, spread

#: Where the vocabulary files are, the words sent to tasks and the longest of them, and the same of long words, so that
#: neither a frequent word nor a frequent long run of signs meets in one task.
TOKENIZERS, HEAD_WORDS, HEAD_CHARS, LONG_WORDS, LONG_CHARS = "/opt/tokenizers", 50_000, 48, 2_000, 4_096
#: Fixed value: the published word pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LIST = pa.list_(pa.int32())


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all texts (one column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(PATTERN).findall
        for b in batches:
            c: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    c.update(find(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "k"])

    return texts.mapInArrow(count, "word string, k long").groupBy("word").agg(F.sum("k").alias("n"))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Adds ids to a table of distinct words (word, n)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        for b in batches:
            ids = [e.ids for e in t.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, _LIST)], ["word", "n", "ids"])

    return words.mapInArrow(encode, "word string, n long, ids array<int>")


def encode(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, head_words: int = HEAD_WORDS) -> DataFrame:
    """id_col, ids for every row of df."""
    spark = df.sparkSession
    path = os.path.join(folder, f"{name}.json")
    docs = spread(df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")))
    words = materialize(encode_words(word_counts(docs.select("text")), path), "words")
    most = lambda rows, n: rows.orderBy(F.desc("n"), "word").limit(n).collect()
    size = F.length("word")
    top = most(words.where(size <= HEAD_CHARS), head_words) + most(words.where((size > HEAD_CHARS) & (size <= LONG_CHARS)), min(LONG_WORDS, head_words))
    sent = spark.sparkContext.broadcast({r.word: list(r.ids) for r in top})
    id_type = df.schema[id_col].dataType.simpleString()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, head = regex.compile(PATTERN).findall, sent.value
        for b in batches:
            parts, rest = [], []
            for t in b.column(1).to_pylist():
                now: list[int] = []
                cut, missing = [now], []
                for w in find(t) if t else ():
                    ids = head.get(w)
                    if ids is None:
                        missing.append(w)
                        now = []
                        cut.append(now)
                    else:
                        now.extend(ids)
                parts.append(cut)
                rest.append(missing)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(_LIST)), pa.array(rest, pa.list_(pa.string()))], ["doc", "parts", "rest"])

    placed = docs.mapInArrow(put, f"doc {id_type}, parts array<array<int>>, rest array<string>")
    placed = materialize(placed.withColumn("row", F.monotonically_increasing_id()), "placed")
    tail = placed.where(F.size("rest") > 0).select("row", F.posexplode("rest").alias("pos", "word")).join(words.select("word", "ids"), "word")
    tail = tail.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]).alias("more"))
    done = placed.where(F.size("rest") == 0).select("doc", F.col("parts")[0].alias("ids"))
    joined = placed.where(F.size("rest") > 0).join(tail, "row")
    woven = F.flatten(F.transform("parts", lambda p, i: F.concat(p, F.coalesce(F.get("more", i), F.array().cast("array<int>")))))
    return done.union(joined.select("doc", woven.alias("ids"))).withColumnRenamed("doc", id_col)


def pieces(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id, piece (binary): the vocabulary of a byte-level tokenizer."""
    t = _tokenizer(os.path.join(folder, f"{name}.json"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    rows = [(i, bytearray(back[c] for c in p)) for p, i in t.get_vocab().items() if all(c in back for c in p)]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(df: DataFrame, id_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_col, text: ids joined to pieces and put together by position; no ids give the empty text."""
    vocabulary = pieces(df.sparkSession, name, folder)
    rows = df.select(id_col, F.monotonically_increasing_id().alias("row"), "ids")
    each = rows.select(id_col, "row", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(vocabulary), "id", "left")
    hexed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))), lambda x: F.coalesce(x["h"], F.lit(""))), "")
    return each.groupBy(id_col, "row").agg(F.decode(F.unhex(hexed), "UTF-8").alias("text")).drop("row")
