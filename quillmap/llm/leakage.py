"""Evaluation texts leaking into training text: a prefix-filtered set join, then item-sized windows.

1. Item texts are folded (markup, case, accents, look-alike letters, control characters, broken
   encodings, line-end hyphens) and cut into words; items of the same words are one text. Sentences
   that STOCK texts or more share are stock and go. Word 3-shingles of an item are the set to contain.
   Stock, rarity of words and the vocabulary are taken over all items at once.
2. Documents are folded once, into a table of word lists. Document frequencies of the item shingles
   are counted over all documents; each item keeps its shingles from rare to frequent, and its prefix:
   any document that holds the share ALPHA of its shingles must hold one of them.
3. Documents meet items by a join on prefix shingles; the length bound and the positional bound drop
   pairs that cannot reach the share, and the shingles behind the prefix complete the count.
4. The rest is verified over windows around the item's own words, where the item's words must recur in
   their order in one or two stretches that cover COVER of them and in which the item's own names,
   figures and terms recur too. (Exact containment would lose passages with single words changed.)

3-shingles and the share are of this problem's statement (half the words, single words changed), where
five-word shingles at 0.8 would lose cases. The small sides of the joins are sent to the tasks only
behind a count of their rows; beyond it the same joins are shuffled.

Defined results: null and empty texts leak nothing; an item whose words are all stock, or of fewer than
three words, is found nowhere; one of three or four words is found where all of them stand in order;
items of equal words are found in the same documents; equal documents are reported each; very long
documents are read whole; empty tables give no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, rows_bounded, spread

#: Words of a shingle, share of an item's shingles a candidate must hold, share of its words a case
#: must cover, share of own words in a stretch, texts that make a sentence stock.
SHINGLE, ALPHA, COVER, OWN, STOCK = 3, 0.12, 0.5, 0.45, 2
#: Rows (of one or two numbers) of a side that is sent to the tasks; words of all items, which are (an error beyond).
SENT_ROWS, MOST_WORDS = 2_000_000, 4_000_000
#: Words that may stand between two matches of one stretch.
SLACK = 7
#: Letters of other scripts that look like Latin ones, and letters without accents to fold.
_LOOKS = str.maketrans(
    "аеорсухіјѕԁһкмнтвгԛԝοαρνυκιτηεχωлп" + "øłđðþıſ" + "АЕОРСУХІЈЅКМНТВΟΑΡΝΥΚΙΤΗΕΧΒΜΖ",
    "aeopcyxijsdhkmhtbrqwoapvukitnexwnn" + "olddtis" + "aeopcyxijskmhtboapnykithexbmz",
)
_LOOK = re.compile("[" + "".join(map(chr, _LOOKS)) + "]")
_MARKS = frozenset(chr(i) for i in range(0x300, 0x1F000) if unicodedata.combining(chr(i)))
#: Emphasis signs, and the marks inside numbers and words; a set in front, so that the scan is fast.
_INNER = re.compile(r"[*_`.,'](?:(?<=[*_`])|(?<=\d[.,])(?=\d)|(?<=\w')(?=\w))")
_WORDS = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>|\{\\[^{}]{0,40}\}|\\[a-z]+\{")
_BROKEN = re.compile("[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]+")
_HIDDEN = re.compile("[\u0000-\u0008\u000b\u000e-\u001b\u007f-\u0084\u0086-\u009f­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _mend(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252", "strict").decode("utf-8")
    except UnicodeError:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]


def words_of(text: str | None) -> list[str]:
    """Folded words in order; a word broken at a line end by a hyphen gives both parts."""
    if not text:
        return []
    if "Ã" in text or "â" in text or "Â" in text:
        text = _BROKEN.sub(_mend, text)
    if "&" in text:
        text = html.unescape(text)
    text = _HIDDEN.sub("", text)
    if "<" in text or "\\" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_LOOKS) if _LOOK.search(text) else text)
        for mark in _MARKS.intersection(text):
            text = text.replace(mark, "")
        text = text.replace("’", "'").replace("‘", "'").replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")
    return _WORDS.findall(_INNER.sub("", text.lower()))


def beginnings(vocabulary: frozenset[str]) -> frozenset[str]:
    return frozenset(w[:i] for w in vocabulary for i in range(1, len(w)))


def rejoin(words: list[str], vocabulary: frozenset[str], starts: frozenset[str]) -> list[str]:
    """Puts parts of a broken word together where only the whole is a word of the items. starts: beginnings(vocabulary)."""
    out, i, n = [], 0, len(words)
    while i < n:
        w = words[i]
        if w not in vocabulary and w in starts:
            whole = w
            for k in range(i + 1, min(i + 12, n)):
                if len(words[k]) > 14 or len(whole) > 24:
                    break
                whole += words[k]
                if whole in vocabulary and (len(words[k]) == 1 or words[k] not in vocabulary or len(whole) > 5):
                    w, i = whole, k
                    break
                if whole not in starts:
                    break
        out.append(w)
        i += 1
    return out


class Item:
    """What is looked up of one item: its words, its own ones, and those that are one letter away."""

    def __init__(self, words: list[str], own: set[str]):
        self.words, self.own, self.all = words, own, set(words)
        self.shorter: dict[str, str] = {}
        for w in sorted(self.all):
            if len(w) > 4:
                for i in range(len(w)):
                    self.shorter.setdefault(w[:i] + w[i + 1 :], w)

    def _alike(self, w: str) -> str:
        """The item's word that is one letter away from w, else w."""
        if w in self.all or len(w) < 4:
            return w
        short = self.shorter
        if hit := short.get(w):
            return hit
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            if v in self.all and len(v) > 3:
                return v
            if v in short and abs(len(short[v]) - len(w)) <= 1:
                return short[v]
        return w

    def covered(self, words: list[str]) -> float:
        """Share of the item's words in the best one or two stretches of the text."""
        # windows around the item's own words; the rest of a long text cannot match and shrinks to a gap
        keep, reach = bytearray(len(words)), 2 * SLACK + 4
        for i, w in enumerate(words):
            if w in self.own:
                a, b = max(0, i - reach), min(len(words), i + reach + 1)
                keep[a:b] = b"\1" * (b - a)
        text, gap = [], 0
        for i, w in enumerate(words):
            gap = 0 if keep[i] else gap + 1
            if gap <= SLACK + 1:
                text.append(self._alike(w) if keep[i] else f"\0{i}")
        if not any(keep):
            return 0.0
        left, total = list(self.words), 0
        for _ in range(2):
            best = self._stretch(left, text)
            if best is None:
                break
            span, i0, i1, j0, j1 = best
            total += span
            left = [w if not i0 <= i < i1 else f"\1{i}" for i, w in enumerate(left)]
            text = [w if not j0 <= j < j1 else f"\2{j}" for j, w in enumerate(text)]
        return total / len(self.words)

    def _stretch(self, item: list[str], text: list[str]) -> tuple[int, int, int, int, int] | None:
        blocks = [b for b in SequenceMatcher(None, text, item, autojunk=False).get_matching_blocks() if b.size]
        best, run = None, []
        least, least_own = min(5, len(self.words)), min(2, sum(w in self.own for w in self.words))

        def weigh() -> None:
            nonlocal best
            # loose ends (one stray word) don't count
            while run and run[0].size < 2 and len(run) > 1:
                run.pop(0)
            while run and run[-1].size < 2 and len(run) > 1:
                run.pop()
            if not run:
                return
            i0, i1, j0, j1 = run[0].b, run[-1].b + run[-1].size, run[0].a, run[-1].a + run[-1].size
            matched = sum(b.size for b in run)
            own = [i for i in range(i0, i1) if self.words[i] in self.own]
            got = {i for b in run for i in range(b.b, b.b + b.size)}
            if matched >= least and matched >= 0.5 * (i1 - i0) and len(own) >= least_own and sum(i in got for i in own) >= OWN * len(own) and (best is None or i1 - i0 > best[0]):
                best = (i1 - i0, i0, i1, j0, j1)

        for b in blocks:
            if run and (b.a - run[-1].a - run[-1].size > SLACK or b.b - run[-1].b - run[-1].size > SLACK):
                weigh()
                run = []
            run.append(b)
        weigh()
        return best


@lru_cache(4096)
def _item(words: tuple[str, ...], own: tuple[str, ...]) -> Item:
    return Item(list(words), set(own))


def _sent(small: DataFrame) -> DataFrame:
    """small, marked to be sent to the tasks where its rows are few enough."""
    return F.broadcast(small) if rows_bounded(small, SENT_ROWS) else small


def _shingles(words: Column) -> Column:
    """Distinct hashes of the word shingles of a list (of at least SHINGLE words)."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])))


def prepare_items(items: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(key, words without stock, own: those of few texts) of each text with words enough, and (key, item_id) of all items."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [[" ".join(w) for s in _SENTENCE.split(t or "") if (w := words_of(s))] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.list_(pa.string()))], ["item_id", "said"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null and t is not null")
    folded = materialize(rows.mapInArrow(fold, "item_id long, said array<string>").where(F.size("said") > 0), "items")
    kinds = materialize(folded.groupBy("said").agg(F.min("item_id").alias("key")), "kinds")
    each = kinds.select("key", F.posexplode("said").alias("pos", "s"))
    stock = each.where(F.size(F.split("s", " ")) > 4).groupBy("s").agg(F.count_distinct("key").alias("n")).where(F.col("n") >= STOCK)
    kept = each.join(stock, "s", "left_anti").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("x"))
    kept = kept.select("key", F.flatten(F.transform("x", lambda v: F.split(v["s"], " "))).alias("words")).where(F.size("words") >= SHINGLE)
    rare = max(4, int(0.02 * kinds.count()))
    often = each.select("key", F.explode(F.split("s", " ")).alias("w")).distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= rare)
    own = kept.select("key", F.explode(F.array_distinct("words")).alias("w")).join(often, "w").groupBy("key").agg(F.array_sort(F.collect_list("w")).alias("own"))
    ready = materialize(kept.join(own, "key", "left").select("key", "words", F.coalesce("own", F.array().cast("array<string>")).alias("own")), "ready")
    return ready, folded.join(kinds, "said").select("key", "item_id").distinct()


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """doc_id, item_id, covered (share of the item's words) for every document that gives an item away."""
    spark = docs.sparkSession
    ready, members = prepare_items(items, item_id, item_text)
    words = ready.select(F.explode("words").alias("w")).distinct()
    if not rows_bounded(words, MOST_WORDS):
        raise ValueError(f"the items have more than {MOST_WORDS} distinct words; give them in parts")
    sent = spark.sparkContext.broadcast(frozenset(r.w for r in words.collect()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        starts = beginnings(vocabulary)
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rejoin(words_of(t), vocabulary, starts) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["doc_id", "words"])

    source = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length(text) > 0))
    folded = source.mapInArrow(fold, "doc_id long, words array<string>").where(F.size("words") >= SHINGLE)
    folded = materialize(folded.withColumn("row", F.monotonically_increasing_id()), "folded")
    of_items = materialize(ready.select("key", F.size("words").alias("n_words"), F.explode(_shingles(F.col("words"))).alias("s")), "of_items")
    wanted = _sent(of_items.select("s").distinct())
    held = materialize(folded.select("row", F.size("words").alias("n"), F.explode(_shingles(F.col("words"))).alias("s")).join(wanted, "s", "left_semi"), "held")
    # rarity over all documents; an item's rows are as many as its words
    df = held.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    own, ranked = Window.partitionBy("key"), Window.partitionBy("key").orderBy("df", "s")
    order = of_items.join(df, "s", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("k", F.count(F.lit(1)).over(own)).withColumn("at", F.row_number().over(ranked))
    order = order.withColumn("need", F.least("k", F.greatest(F.lit(2), F.floor(F.lit(ALPHA) * F.col("k"))))).withColumn("left", F.col("k") - F.col("at") + 1)
    order = materialize(order.select("key", "s", "n_words", "need", "left", (F.col("left") >= F.col("need")).alias("first")), "order")
    met = held.join(_sent(order.where("first").drop("first")), "s").where(F.col("n") >= COVER * F.col("n_words") / 2)
    met = met.groupBy("row", "key").agg(F.count(F.lit(1)).alias("got"), F.max("left").alias("left"), F.max("need").alias("need"))
    # behind its first met shingle an item has left - 1 more, the last need - 1 of them outside the prefix
    met = materialize(met.where((F.col("left") >= F.col("need")) & (F.col("got") + F.col("need") - 1 >= F.col("need"))), "met")
    tails = order.where("not first").groupBy("key").agg(F.collect_list("s").alias("tail"))
    has = held.join(_sent(met.select("row").distinct()), "row", "left_semi").groupBy("row").agg(F.collect_list("s").alias("has"))
    more = F.when(F.col("got") < F.col("need"), F.size(F.array_intersect("has", F.coalesce("tail", F.array().cast("array<long>"))))).otherwise(0)
    chosen = materialize(met.join(tails, "key", "left").join(has, "row").where(F.col("got") + more >= F.col("need")).select("row", "key"), "chosen")
    wide = folded.join(_sent(chosen), "row").join(ready, "key").select("doc_id", "key", folded["words"].alias("doc"), ready["words"].alias("item"), "own")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                share = [_item(tuple(i), tuple(o)).covered(w) for w, i, o in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share, pa.float64())], ["doc_id", "key", "covered"])

    found = wide.mapInArrow(verify, "doc_id long, key long, covered double").where(F.col("covered") >= COVER)
    return found.join(members, "key").groupBy("doc_id", "item_id").agg(F.round(F.max("covered"), 6).alias("covered"))
