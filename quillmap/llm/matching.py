"""Matching entities across sources without keys.

1. Fit, on all records: random walks over the record - attribute - token graph, at least one from each record
   (to one of its attributes, to a token of it, to another record with that token, ...)
   give token sequences; skip-gram with negative sampling trains the token vectors on them, in parts of
   the records whose vectors are averaged by how often a token was met. Tokens are hashed 4-grams of
   characters, so the model has a fixed size and slips of the pen move a vector little. Rarity, centre
   and width are those of all records.
2. Every record gets one vector for each attribute view (title, head of the title, keywords,
   authors with source, doi), the rarity-weighted sum of its token vectors, and from each some
   table keys: signs of its products with random hyperplanes. Records of the two sides that share a
   key are candidates. No key is cut: one with very many pairs (records under one stock heading, or
   whose titles begin alike) goes out as tiles of bounded size, in which every pair is reranked and
   only matches are written.
3. Candidates are reranked exactly on title, doi, year, authors, source and keywords. Stock headings
   are found, not listed: titles that stand over records of UNLIKE or more unlike makers.
4. Confidence: the exact cosine of the two records (mean over the views both have, in the space where
   all vectors are centred and equally wide) and the evidence apart from the doi are calibrated by a
   logistic curve. Its labels don't come from the rerank: they are whether the dois of a pair are the
   same, over all pairs of few-pair keys that have both. `match_pairs` gives the pairs without it.

Defined results: null and blank attributes give no view, no key and no evidence; records without
any view are unmatched; repeated records are matched each; an empty side gives no rows; ids and
extra columns may have any name.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import discard, materialize, rows_bounded, spread
from .names import near_words

#: Buckets of the token vocabulary, dimensions, evidence of a match.
BUCKETS, DIM, EVIDENCE = 1 << 15, 32, 2.4
#: Walks of a part of the fit at least (each record starts as many as it takes, one or more), their steps, and how far a token moves on the mean of a batch; unlike makers of a stock heading, and the most headings that are sent.
WALKS, STEPS, RATE, UNLIKE, SENT_HEADINGS = 60_000, 6, 0.3, 5, 1_000_000
#: Batches of the walks of a part, and walks of one at least; records of a part of the fit at least (where there are so many), and parts at most.
BATCHES, BATCH, PART_ROWS, PARTS = 64, 910, 60_000, 8
#: Token vectors that are added up at once.
SUMMED = 1 << 15
#: Blocks in which the arrays of tasks are added up.
BLOCKS, ARRAYS = 16, "block int, x binary"
#: The views of the cosine: title, keywords, makers, doi.
COSINE_VIEWS = (0, 2, 3, 4)
#: Bits of a key: so many more than the logarithm of the records that chance meetings stay few at any
#: size; at most the dimensions less one, as a key is a 31-bit number.
MORE_BITS, LEAST_BITS, MOST_BITS = 5, 16, 31
#: Views and tables of each.
VIEWS = ("title", "head", "keywords", "makers", "doi")
TABLES = (3, 3, 3, 3, 2)
#: Pairs of a key beyond which it is reranked in tiles, by view, and the rows of a side of a tile.
HOT, TILE = (100, 10, 100, 100, 100), 500
#: Pairs of a tile from which bounds are made for the whole tile at once, and rows of a block of word pairs,
#: and share of open pairs below which titles are compared pair by pair.
BULK, WORD_ROWS, FEW_LEFT = 200, 512, 0.05
HEAD = 36
_TAG = re.compile(r"<[^<>]{1,60}>")
_WORD = re.compile(r"[a-z0-9]+")
_DOI = re.compile(r"10\.\d{3,}/?[^\s;,]+")
#: Openers of works about another work.
_ABOUT = re.compile(r"^(correction|corrigendum|erratum|errata|addendum|retraction|retracted|reply|response|comment|commentary|author correction|publisher correction|rejoinder)( to| on| for)?\b")
_PART = re.compile(r"\bpart ([ivx]+|\d+)\b(?! of\b)")
SCHEMA = "id long, side int, keys array<int>, bits binary, fact string"
FACTS = "id long, side int, fact string"
SCORES = ", cosine double, rest double, evidence double"


def plain(s: str | None) -> str:
    """Lower-case words without markup, accents and punctuation."""
    if not s:
        return ""
    if "&" in s:
        s = html.unescape(s).replace("&", " and ")
    if "<" in s:
        s = _TAG.sub("", s)
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() if "ø" not in s and "–" not in s else unicodedata.normalize("NFKD", s.replace("ø", "o").replace("–", "-")).encode("ascii", "ignore").decode()
    return " ".join(_WORD.findall(s.lower()))


def plain_doi(s: str | None) -> str | None:
    m = _DOI.search(s.lower()) if s else None
    if not m:
        return None
    d = re.sub(r"/(abstract|full|pdf|epdf|meta)$", "", m[0].rstrip(".;,"))
    return re.sub(r"[^a-z0-9]", "", d)


def plain_year(s: str | None) -> int | None:
    m = re.search(r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)", s or "")
    return int(m[0]) if m else None


def features(title, doi, year, authors, source, keywords) -> tuple:
    t = plain(title)
    makers = sorted({w for w in plain(authors).split() if len(w) > 3})
    words = sorted(set(plain(keywords).split()))
    src = plain(source)
    d = plain_doi(doi)
    views = (t, t[:HEAD], " ".join(words), " ".join([*makers, src]) if makers else "", d or "")
    return t, d, plain_year(year), makers, src, words, views


def _views(r: dict) -> tuple[str, ...]:
    """The views of a record as read back from its fact."""
    return r["title"], r["title"][:HEAD], " ".join(r["words"]), " ".join([*r["makers"], r["source"]]) if r["makers"] else "", r["doi"]


def _fact_views(s: str) -> tuple[str, ...]:
    """The views of a record from its fact as it is written."""
    title, doi, _, makers, source, words = s.split("\x1f")
    return title, title[:HEAD], words, f"{makers} {source}" if makers else "", doi


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character 4-grams of all texts, and the text of each. Vectorised over the batch."""
    raw = np.frombuffer("".join(f"^{t}$\0\0\0" for t in texts).encode("ascii"), np.uint8)
    lengths = np.array([len(t) + 5 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    if len(raw) < 4:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g = raw[:-3].astype(np.uint32) | raw[1:-2].astype(np.uint32) << 8 | raw[2:-1].astype(np.uint32) << 16 | raw[3:].astype(np.uint32) << 24
    ok = (raw[:-3] != 0) & (raw[1:-2] != 0) & (raw[2:-1] != 0)
    ok &= owner[:-3] == owner[3:]
    h = (g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
    return h[ok].astype(np.int64), owner[:-3][ok]


def token_counts(records: list[tuple[str, ...]]) -> np.ndarray:
    """In how many of the records (as views) each token stands."""
    keys = np.sort(np.concatenate([(o << 15 | t).astype(np.uint32) for t, o in (_tokens([r[v] for r in records]) for v in range(len(VIEWS) - 1))]))
    return np.bincount(keys[np.r_[True, keys[1:] != keys[:-1]]] & (BUCKETS - 1), minlength=BUCKETS) if len(keys) else np.zeros(BUCKETS, np.int64)


def _uniform(h: np.ndarray, k: int) -> np.ndarray:
    """Numbers of [0, 1) that hang on h and k alone, so that no division of the rows changes them."""
    z = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53


def draws(records: list[tuple[str, ...]], h: np.ndarray, per: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(walks, steps) tokens of `per` walks from each record, -1 where the attribute is empty, and a number of each walk; h: one of each record.
    These stay at their record; `cross` lets them go on at others."""
    tokens = [_tokens([r[v] for r in records]) for v in range(len(VIEWS) - 1)]
    flat = np.concatenate([t for t, _ in tokens])
    first = np.cumsum([0, *(len(t) for t, _ in tokens)])
    ends = np.stack([first[v] + np.searchsorted(o, np.arange(len(records) + 1)) for v, (_, o) in enumerate(tokens)])
    r = np.repeat(np.arange(len(records)), per)
    h = np.repeat(h, per) ^ (np.tile(np.arange(per, dtype=np.uint64), len(records)) << np.uint64(40))
    out = np.full((len(r), steps), -1, np.int16)
    for s in range(steps):
        v = (_uniform(h, 2 * s) * len(tokens)).astype(np.int64)
        at, end = ends[v, r], ends[v, r + 1]
        ok = end > at
        out[ok, s] = flat[(at + (_uniform(h, 2 * s + 1) * (end - at)).astype(np.int64))[ok]]
    return out, h


def cross(walks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The walks when, after each token, half of them change to another record that holds it: those at one token change
    places, each going on where the next one was, so that as many are at every record as before."""
    walks = walks.copy()
    for i in range(walks.shape[1] - 1):
        go = np.flatnonzero((walks[:, i] >= 0) & (_uniform(h, 100 + i) < 0.5))
        if len(go):
            go = go[np.lexsort((_uniform(h[go], 200 + i), walks[go, i]))]
            first = np.flatnonzero(np.r_[True, walks[go[1:], i] != walks[go[:-1], i]])
            to = np.roll(go, -1)
            to[np.r_[first[1:], len(go)] - 1] = go[first]
            walks[go, i + 1 :] = walks[to, i + 1 :]
    return walks


def _add(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to those of total at `at`, which may repeat."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    total[at[first]] += np.add.reduceat(rows.take(order, 0), first, axis=0)


def train(start: np.ndarray, df: np.ndarray, walks: np.ndarray, seed: int) -> np.ndarray:
    """(BUCKETS, 1 + DIM): how often a token was met, and its way from start times that, by skip-gram with negative
    sampling on walks in random order. Every batch moves a token by the mean of what its pairs ask for; there are about BATCHES
    whatever the rows, so that vectors don't go the further the more there are."""
    rng, vec, out = np.random.default_rng(seed), start.copy(), np.zeros_like(start)
    noise = np.cumsum(df.astype(float) ** 0.75)
    seen, size = np.zeros(BUCKETS), max(BATCH, -(-len(walks) // BATCHES))
    for s in range(0, len(walks), size):
        (move, n), (pull, np_), (push, nn) = ((np.zeros_like(vec), np.zeros(BUCKETS, np.int64)) for _ in range(3))
        for c in range(s, min(s + size, len(walks)), BATCH):
            w = walks[c : min(c + BATCH, s + size)].astype(np.int64)
            x, y = np.r_[w[:, :-1].ravel(), w[:, :-2].ravel()], np.r_[w[:, 1:].ravel(), w[:, 2:].ravel()]
            ok = (x >= 0) & (y >= 0) & (x != y)
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            va, step = vec.take(x, 0), np.zeros((len(x), DIM), np.float32)
            bad = np.minimum(np.searchsorted(noise, rng.random((3, len(x))) * noise[-1]), BUCKETS - 1)
            for target, want, total, count in ((y, 1.0, pull, np_), *((k, 0.0, push, nn) for k in bad)):
                o = out.take(target, 0)
                g = (want - 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", va, o), -30, 30))))[:, None].astype(np.float32)
                step += g * o
                _add(total, target, g * va)
                count += np.bincount(target, minlength=BUCKETS)
            _add(move, x, step)
            n += np.bincount(x, minlength=BUCKETS)
        share = lambda k: (RATE / np.maximum(k, 1))[:, None].astype(np.float32)
        out += pull * share(np_) + 3 * push * share(nn)
        vec += move * share(n)
        seen += n
    return np.c_[seen, (vec - start) * seen[:, None]]


class Model:
    """Token vectors and rarity weights, from walks over records. Fitted here on records in memory; `fit_model` does the same over a table."""

    def __init__(self, records: list[tuple[str, ...]], bits: int = 20, seed: int = 5, walks: int = WALKS, steps: int = STEPS):
        n = len(records)
        self.begin(n, token_counts(records) if n else np.zeros(BUCKETS, np.int64), bits, seed)
        if n and walks and self.df.any():
            tokens, h = draws(records, np.random.default_rng(seed).integers(0, 1 << 63, n).astype(np.uint64), -(-walks // n), steps)
            order = np.argsort(h)
            self.move(train(self.start, self.df, cross(tokens[order], h[order]), seed))
        self.widen(self.moments(records))

    def begin(self, n: int, df: np.ndarray, bits: int, seed: int = 5) -> None:
        """Random vectors, and the weights of tokens that stand in df of n records."""
        self.bits, self.seed, self.df = bits, seed, df
        start = np.random.default_rng(seed).standard_normal((BUCKETS, DIM)).astype(np.float32)
        self.start = start / np.linalg.norm(start, axis=1, keepdims=True)
        self.weight = np.maximum(np.log((n + 2) / (df + 1)).astype(np.float32), 0.05)
        self.move(np.zeros((BUCKETS, 1 + DIM)))

    def move(self, met: np.ndarray) -> None:
        """Sets the vectors by what `train` gave, summed over the parts."""
        vec = self.start + (met[:, 1:] / np.maximum(met[:, :1], 1)).astype(np.float32)
        self.vec = (vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9) * self.weight[:, None]).astype(np.float32)

    def moments(self, records: list[tuple[str, ...]]) -> np.ndarray:
        """(views, 1 + DIM + DIM * DIM): number, sum and sum of products of the vectors of a view."""
        out = np.zeros((len(VIEWS), 1 + DIM + DIM * DIM))
        for v in range(len(VIEWS)):
            x = self._units([r[v] for r in records if r[v]]).astype(np.float64)
            out[v] = np.r_[len(x), x.sum(0), (x.T @ x).ravel()]
        return out

    def widen(self, moments: np.ndarray) -> None:
        """What all records of a view share would send them to one side of most planes: planes are drawn in the space
        where the vectors are centred and equally wide in every direction."""
        rng = np.random.default_rng((self.seed, 1))
        self.mean, self.wide, self.planes = np.zeros((len(VIEWS), DIM), np.float32), [], []
        for v, tables in enumerate(TABLES):
            n, total, products = moments[v, 0], moments[v, 1 : 1 + DIM], moments[v, 1 + DIM :].reshape(DIM, DIM)
            wide = np.eye(DIM)
            if n > DIM:
                self.mean[v] = total / n
                values, axes = np.linalg.eigh((products - np.outer(total, total) / n) / (n - 1) + 1e-5 * np.eye(DIM))
                wide = axes / np.sqrt(values)
            self.wide.append(wide.astype(np.float32))
            self.planes += [(wide @ rng.standard_normal((DIM, self.bits))).astype(np.float32) for _ in range(tables)]

    def _units(self, texts: list[str]) -> np.ndarray:
        x = self.vectors(texts)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One vector a text; zero where the text is empty. Texts of about the same length are added up together."""
        out = np.zeros((len(texts), DIM), np.float32)
        tok, own = _tokens(texts)
        first = np.searchsorted(own, np.arange(len(texts) + 1))
        n = np.diff(first)
        order = np.argsort(n, kind="stable")
        s = int(np.searchsorted(n[order], 1))
        while s < len(order):
            most = int(n[order[min(s + 128, len(order)) - 1]])
            r = order[s : s + max(1, min(128, SUMMED // most))]
            s += len(r)
            if len(r) == 1:
                for c in range(first[r[0]], first[r[0] + 1], SUMMED):
                    out[r[0]] += self.vec.take(tok[c : min(c + SUMMED, first[r[0] + 1])], 0).sum(0)
                continue
            i = np.arange(n[r[-1]])
            ok = (i < n[r][:, None]).astype(np.float32)
            x = self.vec.take(tok[np.minimum(first[r][:, None] + i, len(tok) - 1)], 0)
            out[r] = np.matmul(ok[:, None], x)[:, 0]
        return out

    def cosines(self, a: list[dict], b: list[dict]) -> np.ndarray:
        """Exact cosines of pairs of records: the mean over the views both have; 0 where there is none."""
        total, n = np.zeros(len(a)), np.zeros(len(a))
        for v in COSINE_VIEWS:
            x, y = ([_views(r)[v] for r in rows] for rows in (a, b))
            texts = sorted({*x, *y} - {""})
            at = {t: i for i, t in enumerate(texts)}
            u = (self._units(texts) - self.mean[v]) @ self.wide[v]
            u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-9)
            both = np.array([bool(p and q) for p, q in zip(x, y)], bool)
            i, j = (np.array([at[t] for t, ok in zip(side, both) if ok], np.int64) for side in (x, y))
            total[both] += (u[i] * u[j]).sum(1)
            n += both
        return total / np.maximum(n, 1)

    def keys(self, views: list[list[str]]) -> np.ndarray:
        """(rows, tables) keys, -1 where the view is empty."""
        power = (1 << np.arange(self.bits)).astype(np.int64)
        cols, k = [], 0
        for v, tables in enumerate(TABLES):
            x = self._units(views[v]) - self.mean[v]
            empty = np.array([not t for t in views[v]], bool)
            for _ in range(tables):
                key = (x @ self.planes[k] > 0) @ power
                key[empty] = -1
                cols.append(key)
                k += 1
        return np.stack(cols, 1).astype(np.int32)


def fields(df: DataFrame, id_col: str, side: int, title, doi, year, authors, source, keywords) -> DataFrame:
    """The attributes of one source under common names; all as strings."""
    text = lambda c: c.cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.lit(side).alias("side"), text(title).alias("title"), text(doi).alias("doi"), text(year).alias("year"), text(authors).alias("authors"), text(source).alias("source"), text(keywords).alias("keywords"))


def _facts(records: DataFrame) -> DataFrame:
    """id, side and the cleaned attributes of each record in one text."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(*r) for r in zip(*(b.column(i).to_pylist() for i in range(2, 8)))]
            facts = ["\x1f".join((r[0], r[1] or "", str(r[2] or ""), " ".join(r[3]), r[4], " ".join(r[5]))) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(facts, pa.string())], ["id", "side", "fact"])

    return records.mapInArrow(clean, FACTS)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _binary(rows: np.ndarray) -> pa.Array:
    """A column of the bytes of each row."""
    return pa.Array.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _fixed(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The rows that `_binary` made a column of; a copy."""
    fixed = column.cast(pa.binary(width * np.dtype(dtype).itemsize))
    return np.frombuffer(fixed.buffers()[1], dtype).reshape(-1, width)[fixed.offset : fixed.offset + len(fixed)].copy()


def _array_rows(x: np.ndarray) -> pa.RecordBatch:
    """x as rows (block, bytes of doubles), for `_summed`."""
    blocks = np.array_split(np.ravel(x).astype(np.float64), BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "x"])


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the arrays that the tasks of parts give as `_array_rows`. Each block is added up in one task; the driver gets one array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                total[k] = total.get(k, 0.0) + np.frombuffer(x.as_buffer(), np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "x"])

    rows = parts.repartitionById(BLOCKS, "block").mapInArrow(add, ARRAYS).collect()
    return np.concatenate([np.frombuffer(r.x, np.float64) for r in sorted(rows, key=lambda r: r.block)]).reshape(shape)


def fit_model(facts: DataFrame, n: int, bits: int, walks: int = WALKS, steps: int = STEPS) -> Model:
    """The model of all n records of facts: three passes, for rarity, walks, and centre and width. Only sums leave a task."""
    sc, model = facts.sparkSession.sparkContext, Model.__new__(Model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in _slices(batches):
            total += token_counts([_fact_views(f) for f in b.column(0).to_pylist()])
        yield _array_rows(total)

    model.begin(n, _summed(facts.select("fact").mapInArrow(count, ARRAYS), (BUCKETS,)).astype(np.int64), bits)
    parts = max(1, min(PARTS, n // PART_ROWS))
    per = max(1, -(-walks * parts // n))
    begun = sc.broadcast((model.start, model.df, model.seed))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            own = b.column(0).to_numpy().view(np.uint64)
            tokens, h = draws([_fact_views(f) for f in b.column(1).to_pylist()], own, per, steps)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat((own % np.uint64(parts)).astype(np.int32), per)), pa.array(h.view(np.int64)), _binary(tokens)], ["part", "h", "walk"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), _fixed(b.column(2), np.int16, steps)) for b in batches if b.num_rows]
        if held:
            part, h, tokens = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for p in np.unique(part):
                at = part == p
                yield _array_rows(train(begun.value[0], begun.value[1], cross(tokens[at], h[at]), begun.value[2] + int(p)))

    rows = facts.select(F.xxhash64("id", "side", "fact").alias("h"), "fact").mapInArrow(walk, "part int, h long, walk binary")
    if walks and model.df.any():
        model.move(_summed(rows.repartitionById(parts, "part").sortWithinPartitions("part", "h", "walk").mapInArrow(learn, ARRAYS), (BUCKETS, 1 + DIM)))
    begun.unpersist()
    del model.start, model.df  # of no more use; the model is sent to all tasks
    sent = sc.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(VIEWS), 1 + DIM + DIM * DIM))
        for b in _slices(batches):
            total += sent.value.moments([_fact_views(f) for f in b.column(0).to_pylist()])
        yield _array_rows(total)

    model.widen(_summed(facts.select("fact").mapInArrow(measure, ARRAYS), (len(VIEWS), 1 + DIM + DIM * DIM)))
    sent.unpersist()
    return model


def _sign(facts: DataFrame, model: Model) -> DataFrame:
    sent = facts.sparkSession.sparkContext.broadcast(model)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            views = [_fact_views(f) for f in b.column(2).to_pylist()]
            keys = sent.value.keys([[r[v] for r in views] for v in range(len(VIEWS))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], np.int32)), pa.array(keys.ravel())), _binary(keys), b.column(2)], ["id", "side", "keys", "bits", "fact"])

    return facts.mapInArrow(sign, SCHEMA)


def _keyed(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, side, key), and the keys both sides have (key, n0, n1, hot). A hot key whose rows all share the first
    key of its view is left out: all its pairs are pairs of that key, which is hot too."""
    view_of = [v for v, t in enumerate(TABLES) for _ in range(t)]
    firsts = np.cumsum((0, *TABLES[:-1])).tolist()
    by_pos = lambda values: F.array(*[F.lit(x) for x in values])[F.col("pos")]
    each = signed.select("id", "side", "keys", F.posexplode("keys").alias("pos", "k")).where("k >= 0")
    each = each.withColumn("first", F.col("keys")[by_pos([firsts[v] for v in view_of])]).withColumn("key", F.shiftleft(F.col("pos").cast("long"), 40).bitwiseOR(F.col("k").cast("long")))
    size = each.groupBy("key").agg(F.sum(1 - F.col("side")).alias("n0"), F.sum("side").alias("n1"), F.min("first").alias("lo"), F.max("first").alias("hi")).where("n0 > 0 and n1 > 0")
    size = size.withColumn("pos", F.shiftright("key", 40).cast("int")).withColumn("hot", F.col("n0").cast("double") * F.col("n1") > by_pos([HOT[v] for v in view_of]))
    new = (F.col("pos") == by_pos([firsts[v] for v in view_of])) | (F.col("lo") != F.col("hi"))
    return each.select("id", "side", "key"), materialize(size.where(~F.col("hot") | new).select("key", "n0", "n1", "hot"), "keys")


def _candidates(each: DataFrame, size: DataFrame) -> DataFrame:
    """a (side 0), b (side 1): pairs that share a key of few pairs."""
    left, right = each.where("side = 0").select("key", F.col("id").alias("a")), each.where("side = 1").select("key", F.col("id").alias("b"))
    return left.join(size.where("not hot").select("key"), "key").join(right, "key").select("a", "b").distinct()


def _tile_pairs(bits: list[list[bytes]], pos: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile that share no key before the one at pos (else they belong there)."""
    x, y = (np.frombuffer(b"".join(v), np.int32).reshape(len(v), -1) for v in bits)
    ok = np.ones((len(x), len(y)), bool)
    for p in range(pos):
        ok &= (x[:, None, p] != y[None, :, p]) | (x[:, None, p] < 0)
    return np.nonzero(ok)


@lru_cache(1 << 17)
def _signature(w: str) -> int:
    """Bits of the characters of w, and of the letters it has twice: an insertion changes one bit, a substitution two, a swap none."""
    bits = 0
    for c in set(w):
        i = ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) - 48 if "0" <= c <= "9" else 63
        bits |= 1 << i
        if i < 26 and w.count(c) > 1:
            bits |= 1 << (36 + i)
    return bits


def _near_sets(a: list[str], b: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, block of rows): True where near_words of the words of a and b can hold; all pairs that do are True."""
    sa, sb = (np.array([_signature(w) for w in ws], np.uint64) for ws in (a, b))
    la, lb = (np.array([len(w) for w in ws], np.int64) for ws in (a, b))
    for s in range(0, len(a), WORD_ROWS):
        l = la[s : s + WORD_ROWS, None]
        most = np.where(np.minimum(l, lb) < 11, 1, 2)
        yield s, (np.abs(l - lb) <= most) & (np.bitwise_count(sa[s : s + WORD_ROWS, None] ^ sb) <= 2 * most)


def _partners(x: list[list[str]], y: list[list[str]], titles: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(len(x), len(y)) twice: how many words of each list of x can have a partner in each list of y, and (of titles) the
    other way round. Partners are equal or perhaps near; in titles also one that begins or ends the other, among makers as pair_evidence asks."""
    at = [{w: i for i, w in enumerate(sorted({w for ws in rows for w in ws}))} for rows in (x, y)]
    a, b = (list(d) for d in at)
    ok = np.zeros((len(a), len(b)), bool)
    ends = [[np.array([w[k] for w in ws], "U1") for k in (0, -1)] for ws in (a, b)]
    for s, near in _near_sets(a, b):
        e = s + len(near)
        l = np.array([len(w) for w in a[s:e]], np.int64)[:, None]
        m = np.array([len(w) for w in b], np.int64)
        if titles:
            near &= (np.minimum(l, m) > 3) & ~(np.char.isdigit(ends[0][0][s:e])[:, None] & np.char.isdigit(ends[1][0]))
        else:
            near &= (l > 4) & (np.abs(l - m) < 2) & ((ends[0][0][s:e, None] == ends[1][0]) | (ends[0][1][s:e, None] == ends[1][1]))
        ok[s:e] = near
    for k, (own, other) in enumerate(((at[0], at[1]), (at[1], at[0]))):
        for w, i in own.items():
            for part in (w, *(w[:c] for c in range(1, len(w))), *(w[c:] for c in range(1, len(w)))) if titles else (w,):
                j = other.get(part)
                if j is not None:
                    ok[(i, j) if k == 0 else (j, i)] = True
    counts = [np.zeros((len(rows), len(d)), np.float32) for rows, d in zip((x, y), at)]
    for c, rows, d in zip(counts, (x, y), at):
        np.add.at(c, (np.repeat(np.arange(len(rows)), [len(ws) for ws in rows]), np.array([d[w] for ws in rows for w in ws], np.int64)), 1)

    def met(rel: np.ndarray, c: np.ndarray) -> np.ndarray:
        """(words, lists): lists with a partner of the word."""
        out = np.zeros((len(rel), len(c)), np.float32)
        i, j = np.nonzero(rel)
        if len(i):
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            has = (c > 0).T
            for s in range(0, len(first), 2 * WORD_ROWS):
                f = first[s : s + 2 * WORD_ROWS]
                end = first[s + 2 * WORD_ROWS] if s + 2 * WORD_ROWS < len(first) else len(i)
                out[i[f]] = np.logical_or.reduceat(has[j[f[0] : end]], f - f[0], axis=0)
        return out

    return counts[0] @ met(ok, counts[1]), (counts[1] @ met(ok.T, counts[0])).T if titles else None


def _reachable(x: list[dict], y: list[dict]) -> np.ndarray:
    """(len(x), len(y)): whether the evidence of a pair can reach EVIDENCE. Bounds from above of each part of pair_evidence for a
    whole tile at once, from counts of words that can be partners; the same rules as there, so that none that passes is False."""
    seen: dict = {"": 0}
    code = lambda rows, name: np.array([seen.setdefault(r[name], len(seen)) for r in rows], np.int64)

    def near(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a text: both have it, equal, perhaps near."""
        p, q = code(x, name), code(y, name)
        (a, i), (b, j) = ((sorted({r[name] for r in rows}), rows) for rows in (x, y))
        rel = np.concatenate([block for _, block in _near_sets(a, b)])
        places = [np.searchsorted(np.array(ws), [r[name] for r in rows]) for ws, rows in ((a, i), (b, j))]
        return (p > 0)[:, None] & (q > 0), p[:, None] == q, rel[places[0][:, None], places[1]]

    stock = np.array([r["stock"] for r in x], bool)[:, None] | np.array([r["stock"] for r in y], bool)
    p, q = code(x, "title"), code(y, "title")
    long = np.array([len(r["title"]) >= 12 for r in x], bool)[:, None]
    alike, none = p[:, None] == q, (p[:, None] == 0) | (q == 0)
    t = np.where(none, 0.0, np.where(alike, np.where(stock | ~long, 0.0, 3.0), np.where(stock, 0.0, 3.0)))
    both, equal, close = near("doi")
    same = both & equal
    e = t + np.where(same, 2.5, np.where(both, np.where(close, 1.0, -1.0), 0.0))
    ax, ay = (np.array([r["year"] for r in rows], np.int64) for rows in (x, y))
    gap = np.abs(ax[:, None] - ay)
    e += np.where((ax[:, None] == 0) | (ay == 0), 0.0, np.where(gap == 0, 0.5, np.where(gap == 1, 0.2, -0.8)))
    both, equal, close = near("source")
    e += np.where(both, np.where(equal | close, 0.7, -0.5), 0.0)
    at = {w: i for i, w in enumerate(sorted({w for r in (*x, *y) for w in r["words"]}))}
    has = [np.zeros((len(rows), len(at)), np.float32) for rows in (x, y)]
    for h, rows in zip(has, (x, y)):
        for i, r in enumerate(rows):
            h[i, [at[w] for w in r["words"]]] = 1
    least = np.minimum(has[0].sum(1)[:, None], has[1].sum(1)).astype(float)
    share = (has[0] @ has[1].T).astype(float) / np.maximum(least, 1)
    e += np.where(least == 0, 0.0, np.where(share >= 0.6, 1.5, np.where(share >= 0.3, 0.3, -0.7)))
    mx, my = (np.array([len(r["makers"]) for r in rows], np.int64) for rows in (x, y))
    least = np.minimum(mx[:, None], my)
    open_ = e + np.where(least == 0, 0.0, 1.5) >= EVIDENCE - 1e-6
    i, j = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    if not len(i):
        return open_
    hit = np.zeros(open_.shape, np.float32)
    hit[np.ix_(i, j)] = _partners([x[k]["makers"] for k in i], [y[k]["makers"] for k in j], False)[0]
    e += np.where(least == 0, 0.0, np.where(hit >= 0.5 * least, 1.5, np.where(hit > 0, 0.5, -1.5)))
    ok = open_ & (e >= EVIDENCE - 1e-6)
    if ok.mean() < FEW_LEFT:
        return ok
    wx, wy = ([r["title"].split() for r in rows] for rows in (x, y))
    nx, ny = (np.array([len(w) for w in ws], np.int64) for ws in (wx, wy))
    hit_x, hit_y = _partners(wx, wy, True)
    short = np.minimum(nx[:, None], ny)
    miss = np.where(nx[:, None] <= ny, nx[:, None] - hit_x, ny - hit_y)  # words of the shorter title without a partner count as bad
    less = np.where(stock, np.where((nx[:, None] == ny) & (miss == 0), 0.0, -9.0), np.select([miss == 0, (miss == 1) & (short >= 6), (miss == 2) & (short >= 8)], [3.0, 2.0, 0.5], -4.0))
    less = np.where(alike | none, t, less)
    return ok & (less > -9) & ((less >= 0) | same) & (e - t + less >= EVIDENCE - 1e-6)


def _possible(x: list[dict], y: list[dict], u: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs (u, v) of x and y whose evidence can reach EVIDENCE: bounds from above of what pair_evidence adds, the
    cheap ones first, so that none that passes is lost."""
    if len(u) >= BULK:
        ok = _reachable(x, y)[u, v]
        u, v = u[ok], v[ok]

    def codes(name: str) -> list[np.ndarray]:
        seen: dict = {"": 0, 0: 0}
        return [np.array([seen.setdefault(r[name], len(seen)) for r in rows], np.int64) for rows in (x, y)]

    (tx, ty), (dx, dy) = codes("title"), codes("doi")
    pair, at = np.unique(tx[u] << 32 | ty[v], return_inverse=True)
    names = {int(c): (r["title"], r["stock"]) for c, r in (*zip(tx, x), *zip(ty, y))}
    t = np.array([title_evidence(p[0], q[0], p[1] or q[1]) for p, q in ((names[c >> 32], names[c & 0xFFFFFFFF]) for c in pair.tolist())], float)[at]

    def keep(ok: np.ndarray) -> None:
        nonlocal u, v, e
        u, v, e = u[ok], v[ok], e[ok]

    same = (dx[u] == dy[v]) & (dx[u] > 0)
    e = t + np.where(same, 2.5, np.where((dx[u] > 0) & (dy[v] > 0), 1.0, 0.0))
    keep((t > -9) & ((t >= 0) | same))
    ax, ay = (np.array([r["year"] for r in rows], np.int64) for rows in (x, y))
    gap = np.abs(ax[u] - ay[v])
    e += np.where((ax[u] == 0) | (ay[v] == 0), 0.0, np.where(gap == 0, 0.5, np.where(gap == 1, 0.2, -0.8)))
    for name, most in (("source", 0.7), ("makers", 1.5)):
        hx, hy = (np.array([bool(r[name]) for r in rows], bool) for rows in (x, y))
        e += np.where(hx[u] & hy[v], most, 0.0)
    keep(e + 1.5 >= EVIDENCE - 1e-6)
    wx, wy = ([set(r["words"]) for r in rows] for rows in (x, y))
    nx, ny = (np.array([len(w) for w in ws], np.int64) for ws in (wx, wy))
    least = np.minimum(nx[u], ny[v])
    share = np.array([len(wx[i] & wy[j]) for i, j in zip(u.tolist(), v.tolist())], float) / np.maximum(least, 1)
    e += np.where(least == 0, 0.0, np.where(share >= 0.6, 1.5, np.where(share >= 0.3, 0.3, -0.7)))
    keep(e >= EVIDENCE - 1e-6)
    other = (dx[u] > 0) & (dy[v] > 0) & (dx[u] != dy[v])
    e -= [2.0 if o and not near_words(x[i]["doi"], y[j]["doi"]) else 0.0 for o, i, j in zip(other.tolist(), u.tolist(), v.tolist())]
    keep(e >= EVIDENCE - 1e-6)
    return zip(u.tolist(), v.tolist())


def _scores(ids: tuple[list, list], x: list[dict], y: list[dict], e: list[float], model: Model | None, *more: list) -> pa.RecordBatch:
    """Rows of pairs: their ids and, with a model, cosine, evidence apart from the doi and evidence."""
    told = (model.cosines(x, y) if x else [], list(map(apart_from_doi, x, y)), e, *more) if model else ()
    return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in ids), *(pa.array(v, pa.float64()) for v in told)], ["a", "b", "cosine", "rest", "evidence", "same"][: 2 + len(told)])


def _tiled(each: DataFrame, size: DataFrame, left_facts: DataFrame, right_facts: DataFrame, model) -> DataFrame:
    """a, b (with a model also cosine, rest, evidence) of all matches among the pairs that share a hot key, made and reranked tile by tile."""
    hot = size.where("hot").select("key", F.ceil(F.col("n0") / TILE).cast("int").alias("m0"), F.ceil(F.col("n1") / TILE).cast("int").alias("m1"))

    def side(k: int, name: str, facts: DataFrame) -> DataFrame:
        own, other = (F.pmod(F.xxhash64(name), F.col(f"m{k}")).cast("int"), F.explode(F.sequence(F.lit(0), F.col(f"m{1 - k}") - 1)))
        rows = each.where(f"side = {k}").select("key", F.col("id").alias(name)).join(hot, "key").join(facts, name)
        return rows.select("key", own.alias("ij"[k]), other.alias("ij"[1 - k]), F.lit(k).alias("side"), F.col(name).alias("id"), F.col(f"b{name}").alias("bits"), F.col(f"f{name}").alias("fact")).select("key", "i", "j", "side", "id", "bits", "fact")

    rows = side(0, "a", left_facts).unionByName(side(1, "b", right_facts))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(t: pa.Table) -> pa.RecordBatch:
            k = t.column("side").to_numpy()
            halves = [t.filter(pa.array(k == n)) for n in (0, 1)]
            ids, bits = ([h.column(c).to_pylist() for h in halves] for c in ("id", "bits"))
            facts = [[_fact(f) for f in h.column("fact").to_pylist()] for h in halves]
            found = []
            if ids[0] and ids[1]:
                for u, v in _possible(*facts, *_tile_pairs(bits, t.column("key")[0].as_py() >> 40)):
                    e = pair_evidence(facts[0][u], facts[1][v])
                    if e >= EVIDENCE:
                        found.append((u, v, e))
            x, y = [facts[0][u] for u, _, _ in found], [facts[1][v] for _, v, _ in found]
            return _scores(([ids[0][u] for u, _, _ in found], [ids[1][v] for _, v, _ in found]), x, y, [e for _, _, e in found], model and model.value)

        rest: pa.Table | None = None  # the tile whose rows may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            at = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            ends = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1].tolist()
            for s, e in zip(ends, ends[1:]):
                yield tile(t.slice(s, e - s))
            rest = t.slice(ends[-1])
        if rest is not None and len(rest):
            yield tile(rest)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(rerank, "a long, b long" + (SCORES if model else ""))


def _is_stock(a: str, heading: str) -> bool:
    """a is the heading but for a slip of the pen in its words."""
    x, y = a.split(), heading.split()
    return len(x) == len(y) and all(u == v or len(u) > 3 and near_words(u, v) for u, v in zip(x, y))


@lru_cache(1 << 16)
def title_evidence(a: str, b: str, stock: bool = False) -> float:
    """Above 0: the same title, as far as it goes; None-like -9: two works by their titles. stock: a or b is a stock heading."""
    if not a or not b:
        return 0.0
    if a == b:
        return 0.0 if stock or len(a) < 12 else 3.0
    ka, kb = _ABOUT.match(a), _ABOUT.match(b)
    if bool(ka) != bool(kb) or ka and kb and ka[1] != kb[1]:
        return -9.0
    pa_, pb = _PART.search(a), _PART.search(b)
    if pa_ and pb and pa_[1] != pb[1]:
        return -9.0
    if stock:
        return 0.0 if _is_stock(a, b) else -9.0
    x, y = a.split(), b.split()
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if 2 * sum(w in long for w in short) < len(short):
        return -4.0
    # fuzzy alignment of the words in order, one slip allowed a word, a missing or split word at times
    i = j = same = bad = 0
    while i < len(short) and j < len(long):
        u, v = short[i], long[j]
        if u == v or (not u[0].isdigit() and len(u) > 2 and len(v) > 2 and (near_words(u, v) if min(len(u), len(v)) > 3 else False)) or (len(u) > 2 and v.startswith(u) and not u.isdigit()) or (len(v) > 2 and u.startswith(v) and not v.isdigit()):
            same += 1
            i += 1
            j += 1
        elif j + 1 < len(long) and u == long[j + 1]:
            bad += 1
            j += 1
        elif i + 1 < len(short) and short[i + 1] == v:
            bad += 1
            i += 1
        elif j + 1 < len(long) and u == v + long[j + 1]:
            same += 1
            i += 1
            j += 2
        elif i + 1 < len(short) and v == u + short[i + 1]:
            same += 1
            i += 2
            j += 1
        else:
            bad += 2
            i += 1
            j += 1
    rest = len(long) - j
    bad += len(short) - i
    if bool(pa_) != bool(pb) and rest == 0:
        return -9.0
    if pa_ and not pb or pb and not pa_:
        # one names a part; the other must break off before it
        tail = long[j:]
        if not rest or "part" not in tail or rest <= 2:
            return -9.0
    if bad == 0 and rest == 0:
        return 3.0
    if bad == 0 and same >= 3:
        return 2.0  # one breaks off, or lacks its subtitle
    if bad == 1 and same >= 5:
        return 2.0 if rest == 0 else 1.0
    if bad <= 2 and same >= 6:
        return 0.5
    return -4.0


def pair_evidence(a: dict, b: dict) -> float:
    t = title_evidence(a["title"], b["title"], a["stock"] or b["stock"])
    if t <= -9.0 or (t < 0 and (not a["doi"] or a["doi"] != b["doi"])):
        return -9.0
    e = t
    if a["doi"] and b["doi"]:
        e += 2.5 if a["doi"] == b["doi"] else 1.0 if near_words(a["doi"], b["doi"]) else -1.0
    if a["year"] and b["year"]:
        gap = abs(a["year"] - b["year"])
        e += 0.5 if gap == 0 else 0.2 if gap == 1 else -0.8
    if a["makers"] and b["makers"]:
        x, y = a["makers"], b["makers"]
        both = len(set(x) & set(y))
        if both < min(len(x), len(y)):
            both += sum(any(abs(len(w) - len(v)) < 2 and (w[0] == v[0] or w[-1] == v[-1]) and near_words(w, v) for v in y) for w in x if len(w) > 4 and w not in y)
        share = both / max(1, min(len(x), len(y)))
        e += 1.5 if share >= 0.5 else 0.5 if both else -1.5
    if a["source"] and b["source"]:
        e += 0.7 if a["source"] == b["source"] or near_words(a["source"], b["source"]) else -0.5
    if a["words"] and b["words"]:
        x, y = set(a["words"]), set(b["words"])
        share = len(x & y) / min(len(x), len(y))
        e += 1.5 if share >= 0.6 else 0.3 if share >= 0.3 else -0.7
    return e


def apart_from_doi(a: dict, b: dict) -> float:
    """The evidence of the other attributes, from -6 on."""
    return max(-6.0, pair_evidence(a | {"doi": ""}, b))


def _fact(s: str) -> dict:
    title, doi, year, makers, source, words, stock = s.split("\x1f")
    return {"title": title, "doi": doi, "year": int(year) if year else 0, "makers": makers.split(), "source": source, "words": words.split(), "stock": stock == "1"}


def stock_headings(signed: DataFrame) -> DataFrame:
    """title: those over records of UNLIKE or more unlike makers (by the first of each record's)."""
    part = F.split("fact", "\x1f")
    rows = signed.select(part[0].alias("title"), F.substring_index(part[3], " ", 1).alias("maker")).where("title <> '' and maker <> ''").distinct()
    return rows.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= UNLIKE).select("title")


#: Weights of (cosine, evidence apart from the doi, 1) that calibration starts from and is lightly held to.
PRIOR = (4.0, 1.0, -4.0)


def _logistic(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights of P(same work | x) by Newton steps of length 1 at most, held towards PRIOR. sums: gradient and curvature at weights."""
    w = prior = np.array(PRIOR)
    for _ in range(60):
        g, h = sums(w)
        step = np.linalg.solve(h + 0.5 * np.eye(len(w)), g - 0.5 * (w - prior))
        w = w + step / max(1.0, np.linalg.norm(step))
        if np.linalg.norm(step) < 1e-9:
            break
    return w


def _array_sums(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x

    return sums


def _table_sums(known: DataFrame) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The sums over all rows of known (cosine, rest, same), a job for each call."""

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (F.col("cosine"), F.col("rest"), F.lit(1.0))
        z = sum((float(a) * b for a, b in zip(w[1:], x[1:])), float(w[0]) * x[0])
        p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
        rows = known.select(*(v.alias(f"x{i}") for i, v in enumerate(x)), (F.col("same") - p).alias("d"), (p * (1 - p)).alias("q"))
        pairs = [(i, j) for i in range(3) for j in range(3)]
        r = rows.agg(*(F.coalesce(F.sum(F.col(f"x{i}") * F.col("d")), F.lit(0.0)) for i in range(3)), *(F.coalesce(F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("q")), F.lit(0.0)) for i, j in pairs)).first()
        return np.array(r[:3]), np.array(r[3:]).reshape(3, 3)

    return sums


def calibrate(cosine: np.ndarray, rest: np.ndarray, same: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, mean squared error over the held-out half) of P(same dois | cosine, rest)."""
    x = np.stack([cosine, rest, np.ones_like(cosine)], 1)
    w = _logistic(_array_sums(x[~held], same[~held])) if (~held).any() else np.array(PRIOR)
    p = 1 / (1 + np.exp(-np.clip(x[held] @ w, -30, 30)))
    return w, float(((p - same[held]) ** 2).mean()) if held.any() else float("nan")


def match_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, cosine, evidence, confidence of every match of left and right (as `fields` gives them)."""
    return _matched(left, right, True)


def match_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b of every match: those of match_records, without working out cosines and confidence."""
    return _matched(left, right, False)


def _matched(left: DataFrame, right: DataFrame, told: bool) -> DataFrame:
    spark: SparkSession = left.sparkSession
    both = left.unionByName(right)
    n = left.count() + right.count()
    if not n:
        return spark.createDataFrame([], "a long, b long" + (", cosine double, evidence double, confidence double" if told else ""))
    bits = min(MOST_BITS, DIM - 1, max(LEAST_BITS, n.bit_length() + MORE_BITS))
    facts = materialize(_facts(spread(both)), "facts")
    model = fit_model(facts, n, bits)
    signed = materialize(_sign(facts, model), "signed")
    discard(facts)
    sent = spark.sparkContext.broadcast(model) if told else None
    each, size = _keyed(signed)
    pairs = _candidates(each, size)
    headings = materialize(stock_headings(signed), "headings").withColumn("stock", F.lit("1"))
    marked = signed.withColumn("title", F.substring_index("fact", "\x1f", 1)).join(F.broadcast(headings) if rows_bounded(headings, SENT_HEADINGS) else headings, "title", "left").withColumn("fact", F.concat("fact", F.lit("\x1f"), F.coalesce("stock", F.lit(""))))
    left_facts, right_facts = (marked.where(F.col("side") == k).select(F.col("id").alias(n), F.col("bits").alias(f"b{n}"), F.col("fact").alias(f"f{n}")) for k, n in ((0, "a"), (1, "b")))
    wide = pairs.join(left_facts.drop("ba"), "a").join(right_facts.drop("bb"), "b").select("a", "b", "fa", "fb")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x, y = ([_fact(f) for f in b.column(i).to_pylist()] for i in (2, 3))
            e = [pair_evidence(u, v) for u, v in zip(x, y)]
            label = [float(u["doi"] == v["doi"]) if told and u["doi"] and v["doi"] else None for u, v in zip(x, y)]
            use = [i for i, v in enumerate(label) if v is not None or e[i] >= EVIDENCE]
            ids = tuple(b.column(i).take(pa.array(use, pa.int64())) for i in (0, 1))
            yield _scores(ids, [x[i] for i in use], [y[i] for i in use], [e[i] for i in use], sent and sent.value, [label[i] for i in use])

    scored = materialize(wide.mapInArrow(rerank, "a long, b long" + (SCORES + ", same double" if told else "")), "scored")
    tiled = _tiled(each, size, left_facts, right_facts, sent)
    # a pair of a tile may share a key of few pairs as well
    if not told:
        return scored.unionByName(tiled).dropDuplicates(["a", "b"])
    w = _logistic(_table_sums(scored.where("same is not null").select("cosine", "rest", "same")))
    logit = float(w[0]) * F.col("cosine") + float(w[1]) * F.col("rest") + float(w[2]) + (F.col("evidence") - F.col("rest"))
    matches = scored.where(F.col("evidence") >= EVIDENCE).drop("same").unionByName(tiled).dropDuplicates(["a", "b"])
    return matches.select("a", "b", "cosine", "evidence", F.round(1 / (1 + F.exp(-logit)), 6).alias("confidence"))
