"""Term networks: co-occurrence, two-mode, coupling, co-citation, citation, strength, components.

Records carry their terms as one array per row, so pairs are made inside the row and only counted
across rows: one shuffle of partially aggregated pairs, no self-join. Terms are compared in lower
case with white space collapsed; null and blank terms don't count, a term counts once per record;
records without terms add nothing; an empty table gives an empty network. Edges have src < dst.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..runtime import global_rank, materialize, rows_bounded

#: Documents of a list of one key, and hot keys that are sent to the tasks.
BLOCK, SENT_KEYS = 512, 1_000_000
#: Rows (document, key) of a block of documents, pairs counted at once, and rows of a batch of results.
BLOCK_ROWS, PAIRS_AT_ONCE, OUT_ROWS = 4_000_000, 2_000_000, 65_536


def term_array(terms: Column) -> Column:
    """Sorted distinct normalised terms of an array; never null."""
    clean = F.filter(F.transform(F.filter(terms, lambda x: x.isNotNull()), lambda x: collapse(F.lower(x))), lambda x: x != "")
    return F.coalesce(F.array_sort(F.array_distinct(clean)), F.array().cast("array<string>"))


def doc_terms(df: DataFrame, rec: str, terms: Column, *keep: str) -> DataFrame:
    """rec, terms (sorted, distinct), keep: records with at least one term."""
    return df.select(F.col(rec).alias("rec"), term_array(terms).alias("terms"), *keep).where(F.size("terms") > 0)


def node_counts(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, term, count: records per term."""
    return docs.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("count"))


def pairs(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, src, dst, n (terms of the record): one row per pair of terms of a record."""
    each = F.flatten(F.transform("terms", lambda x, i: F.transform(F.slice("terms", i + 2, F.size("terms")), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    return docs.where(F.size("terms") > 1).select(*keys, F.size("terms").alias("n"), F.explode(each).alias("p")).select(*keys, "n", "p.src", "p.dst")


def cooccurrence(docs: DataFrame, fractional: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, src, dst, weight: +1 for each record with both, or +1/(n-1) of the record's n terms."""
    weight = F.sum(1.0 / (F.col("n") - 1)) if fractional else F.count(F.lit(1)).cast("double")
    return pairs(docs, *keys).groupBy(*keys, "src", "dst").agg(F.round(weight, 3).alias("weight"))


def keep_frequent(docs: DataFrame, least: int) -> DataFrame:
    """Records with only the terms of at least `least` records: cut before pairs are made."""
    counts = node_counts(docs).where(F.col("count") >= least)
    kept = docs.select("rec", F.explode("terms").alias("term")).join(counts.select("term"), "term", "left_semi")
    return kept.groupBy("rec").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def bipartite(df: DataFrame, rec: str, left: Column, right: Column, fractional: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes: type, term, count; edges: src, dst, weight) of two term columns; records with an empty side are skipped.
    Fractional: an edge gets 1/(n1 n2) of a record, a node 1/n of its side."""
    rows = df.select(term_array(left).alias("l"), term_array(right).alias("r")).where((F.size("l") > 0) & (F.size("r") > 0))
    one = F.lit(1.0)
    each = rows.select(F.explode("l").alias("src"), "r", F.size("l").alias("n1")).select("src", F.explode("r").alias("dst"), "n1", F.size("r").alias("n2"))
    edges = each.groupBy("src", "dst").agg(F.round(F.sum(one / (F.col("n1") * F.col("n2")) if fractional else one), 3).alias("weight"))

    def side(name: str, kind: str) -> DataFrame:
        part = rows.select(F.explode(name).alias("term"), F.size(name).alias("n"))
        return part.groupBy("term").agg(F.round(F.sum(one / F.col("n") if fractional else one), 3).alias("count")).select(F.lit(kind).alias("type"), "term", "count")

    return side("l", "left").unionByName(side("r", "right")), edges


def top_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """The n most frequent terms; ties by term."""
    return nodes.orderBy(F.desc("count"), "term").limit(n)


def induced(edges: DataFrame, nodes: DataFrame, least: float = 0.0) -> DataFrame:
    """Edges of at least `least` whose ends are both in nodes (term)."""
    ends = nodes.select("term")
    return edges.where(F.col("weight") >= least).join(ends.withColumnRenamed("term", "src"), "src", "left_semi").join(ends.withColumnRenamed("term", "dst"), "dst", "left_semi")


def bipartite_top(nodes: DataFrame, edges: DataFrame, n: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The n top right-hand nodes, the left-hand nodes tied to them by `least` or more, and those edges."""
    top = top_nodes(nodes.where("type = 'right'").select("term", "count"), n).withColumn("type", F.lit("right"))
    kept = edges.where(F.col("weight") >= least).join(top.select(F.col("term").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")
    left = nodes.where("type = 'left'").join(kept.select(F.col("src").alias("term")).distinct(), "term", "left_semi")
    return top.select("type", "term", "count").unionByName(left.select("type", "term", "count")), kept


def link_strength(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """term, links, strength (round 3); with nodes also those without links, at 0."""
    both = edges.select(F.col("src").alias("term"), "weight").unionAll(edges.select("dst", "weight"))
    out = both.groupBy("term").agg(F.count(F.lit(1)).alias("links"), F.round(F.sum("weight"), 3).alias("strength"))
    if nodes is None:
        return out
    return nodes.select("term").join(out, "term", "left").select("term", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def term_averages(docs: DataFrame, *values: str) -> DataFrame:
    """term and the average of each value column over its records (round 2); null values don't count."""
    return docs.select(F.explode("terms").alias("term"), *values).groupBy("term").agg(*(F.round(F.avg(v), 2).alias(f"avg_{v}") for v in values))


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """row, col, value: both halves and the diagonal (term counts)."""
    a = edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value"))
    return a.unionAll(a.select("col", "row", "value")).unionAll(nodes.select("term", "term", F.col("count").cast("double")))


def incidence(docs: DataFrame, nodes: DataFrame, *keep: str) -> DataFrame:
    """rec, keep, term: the ones of the 0/1 document-term matrix; records without any node drop out."""
    return docs.select("rec", *keep, F.explode("terms").alias("term")).join(nodes.select("term"), "term", "left_semi").select("rec", *keep, "term")


def shared(df: DataFrame, doc: str, key: str, block: int = BLOCK, dense: bool | None = None) -> DataFrame:
    """a < b, weight: how many distinct keys two documents share (coupling; with columns swapped, co-citation). Pairs are made
    inside lists of at most about `block` documents of a key and between two such lists, so that a key of very many
    documents is many small rows, and counted with partial sums. Where the pairs are many for the rows (or `dense` says
    so) no pair becomes a row: blocks of documents are multiplied with each other, and only sums leave a task."""
    d = df.select(F.col(doc).alias("doc"), F.col(key).alias("key")).where("doc is not null and key is not null")
    keys = materialize(d.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    rows, pairs_ = keys.agg(F.sum("n"), F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil((rows or 0) / BLOCK_ROWS), math.ceil(math.sqrt(4 * cores)))
    if dense or dense is None and rows and pairs_ > 4.0 * rows * blocks:
        return _multiplied(d, keys, blocks)
    d = d.distinct()
    hot = keys.select("key", F.ceil(F.col("n") / block).cast("int").alias("nb")).where("nb > 1")
    hot = F.broadcast(hot) if rows_bounded(hot, SENT_KEYS) else hot
    rows = d.join(hot, "key", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("x", F.pmod(F.xxhash64("doc"), F.col("nb")).cast("int"))
    lists = rows.groupBy("key", "x", "nb").agg(F.array_sort(F.collect_list("doc")).alias("docs"))
    pair = lambda u, v: F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    inside = F.flatten(F.transform("docs", lambda u, i: F.transform(F.slice("docs", i + 2, F.size("docs")), lambda v: pair(u, v))))
    found = lists.where(F.size("docs") > 1).select(F.explode(inside).alias("p"))
    other = lists.where("nb > 1").select("key", F.col("x").alias("y"), F.col("docs").alias("more"))
    across = lists.where("nb > 1").select("key", "docs", F.explode(F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda y: y > F.col("x"))).alias("y")).join(other, ["key", "y"])
    found = found.unionAll(across.select(F.explode(F.flatten(F.transform("docs", lambda u: F.transform("more", lambda v: pair(u, v))))).alias("p")))
    return found.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("weight"))


def _multiplied(d: DataFrame, keys: DataFrame, blocks: int) -> DataFrame:
    """`shared` by blocks: documents and keys get numbers, the rows of a block of documents are packed (keys in order), and each
    two blocks are multiplied in one task, a document of the first at a time."""
    kind = d.schema["doc"].dataType.simpleString()
    send = lambda t: F.broadcast(t) if rows_bounded(t, SENT_KEYS) else t
    docs = materialize(global_rank(d.select("doc").distinct(), "doc", name="k").select("doc", (F.col("k") - 1).alias("k")), "docs")
    size = max(1, math.ceil(docs.count() / blocks))
    number = materialize(global_rank(keys.select("key"), "key", name="l"), "numbers")
    rows = d.join(send(docs), "doc").join(send(number), "key").select((F.col("k") / size).cast("int").alias("block"), (F.col("k") % size).cast("int").alias("at"), F.col("l").cast("long").alias("l"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            block, at, l = (b.column(i).to_numpy() for i in range(3))
            for k in np.unique(block).tolist():
                held.setdefault(k, []).append((l << 31 | at)[block == k])
        for k in list(held):
            code = np.unique(np.concatenate(held.pop(k)))
            for s in range(0, len(code), PAIRS_AT_ONCE):
                c = code[s : s + PAIRS_AT_ONCE]
                first = int(c[0] >> 31)
                # the difference of the keys in order packs well
                step = np.diff(c >> 31, prepend=first).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([first], pa.int64()), pa.array([step.tobytes()], pa.binary()), pa.array([(c & 0x7FFFFFFF).astype(np.int32).tobytes()], pa.binary())], ["block", "first", "step", "at"])

    packed = materialize(rows.repartition(blocks, "block").mapInArrow(pack, "block int, first long, step binary, at binary"), "packed")
    names = docs.groupBy((F.col("k") / size).cast("int").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc"))), lambda x: x["doc"]).alias("docs"))
    parts = packed.withColumn("docs", F.lit(None).cast(f"array<{kind}>")).unionByName(names, allowMissingColumns=True)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    sent = parts.select("*", other).select(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "first", "step", "at", "docs")

    def multiply(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        i, j = rows[0]["i"], rows[0]["j"]
        side = {}
        for k in {i, j}:
            own = sorted((r for r in rows if r["block"] == k and r["at"] is not None), key=lambda r: r["first"])
            names = next((r["docs"] for r in rows if r["block"] == k and r["docs"] is not None), None)
            if names is None or not own:
                return
            keys = np.concatenate([r["first"] + np.cumsum(np.frombuffer(r["step"], np.int32), dtype=np.int64) for r in own])
            side[k] = names, keys, np.concatenate([np.frombuffer(r["at"], np.int32) for r in own])
        (left, ka, da), (right, kb, db) = side[i], side[j]
        starts, ends = np.searchsorted(kb, ka, "left"), np.searchsorted(kb, ka, "right")
        order = np.argsort(da, kind="stable")
        of = np.searchsorted(da[order], np.arange(len(left) + 1))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        have = 0
        left_docs, right_docs = pa.array(left, TYPES.get(kind)), pa.array(right, TYPES.get(kind))

        def batch() -> pa.RecordBatch:
            a, b, w = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([left_docs.take(pa.array(a)), right_docs.take(pa.array(b)), pa.array(w)], ["a", "b", "weight"])

        for a in range(len(left)):
            own = order[of[a] : of[a + 1]]
            s, n = starts[own], ends[own] - starts[own]
            s, n = s[n > 0], n[n > 0]
            if not len(n):
                continue
            total = np.zeros(len(right), np.int64)
            upto = np.cumsum(n)
            cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(PAIRS_AT_ONCE, upto[-1], PAIRS_AT_ONCE)), len(n)])
            for x, y in zip(cuts[:-1], cuts[1:]):
                m = n[x:y]
                total += np.bincount(db[np.repeat(s[x:y] - np.cumsum(m) + m, m) + np.arange(m.sum())], minlength=len(right))
            if i == j:
                total[: a + 1] = 0
            hit = np.flatnonzero(total)
            if len(hit):
                out.append((np.full(len(hit), a, np.int32), hit.astype(np.int32), total[hit]))
                have += len(hit)
                if have >= OUT_ROWS:
                    yield batch()
                    out, have = [], 0
        if out:
            yield batch()

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and (held[0]["i"], held[0]["j"]) != (r["i"], r["j"]):
                    yield from multiply(held)
                    held = []
                held.append(r)
        if held:
            yield from multiply(held)

    return sent.repartition(blocks * (blocks + 1) // 2, "i", "j").sortWithinPartitions("i", "j").mapInArrow(tiles, f"a {kind}, b {kind}, weight long")


#: Arrow types of documents whose Python values don't tell them.
TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def work_key(author: Column, year: Column, source: Column) -> Column:
    """Key of a work by its first author, year and source; null where one of them is missing."""
    parts = [F.nullif(_words(author), F.lit("")), F.nullif(F.regexp_extract(year.cast("string"), "(1[89][0-9]{2}|20[0-9]{2})", 1), F.lit("")), F.nullif(_words(source), F.lit(""))]
    return F.when(parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.concat_ws("|", *parts))


def references(df: DataFrame, record: str, refs: Column) -> DataFrame:
    """record, key, doi, author, source: one row per distinct reference of a list of texts such as 'Doe J, 2001, J MAPS, V1,
    DOI 10.1/x'. A reference without author, year and source has a null key; one without a doi a null doi."""
    each = df.select(F.col(record).alias("record"), F.explode(refs).alias("ref")).where("ref is not null").withColumn("p", F.split("ref", ", *"))
    author, year, source = (F.get("p", F.lit(i)) for i in range(3))
    doi = F.nullif(F.lower(F.regexp_extract("ref", r"(10\.[0-9]{4,9}/[^ ,;\]]+)", 1)), F.lit(""))
    out = each.select("record", work_key(author, year, source).alias("key"), doi.alias("doi"), F.nullif(_words(author), F.lit("")).alias("author"), F.nullif(_words(source), F.lit("")).alias("source"))
    return out.where("key is not null or doi is not null").distinct()


def cited(refs: DataFrame, part: str = "full") -> DataFrame:
    """record, node: what each record cites: whole references (their doi, else their key), their sources or their authors."""
    node = F.coalesce(F.concat(F.lit("doi:"), "doi"), F.col("key")) if part == "full" else F.col(part)
    return refs.select("record", node.alias("node")).where("node is not null").distinct()


def citations(refs: DataFrame, works: DataFrame) -> DataFrame:
    """src (citing), dst (cited): references joined to the works (record, key, doi) they name, by doi or by key; directed,
    no self-citation."""
    rows = lambda df, name: df.select(F.col("record").alias(name), F.explode(F.array_compact(F.array(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("key:"), "key")))).alias("k")).distinct()
    return rows(refs, "src").join(rows(works, "dst"), "k").where("src <> dst").select("src", "dst").distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None, most: int = 60) -> DataFrame:
    """term, component (its smallest term). Minimum labels with pointer jumping: the rounds grow with the
    logarithm of the longest path. Each round is a table in the shared folder."""
    half = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).where("x <> y")
    both = materialize(half.unionAll(half.select("y", "x")).distinct(), "links")
    ids = both.select(F.col("x").alias("term")).distinct()
    if nodes is not None:
        ids = ids.union(nodes.select("term")).distinct()
    label = materialize(ids.withColumn("component", F.col("term")), "label")
    for _ in range(most):
        near = both.join(label.withColumnsRenamed({"term": "y", "component": "c"}), "y").groupBy("x").agg(F.min("c").alias("low"))
        step = label.join(near, F.col("term") == F.col("x"), "left").select("term", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        # the label of the label, so that chains halve
        jump = step.select(F.col("term").alias("component"), F.col("component").alias("up"))
        new = materialize(step.join(jump, "component", "left").select("term", "old", F.least("component", "up").alias("component")), "label")
        changed = new.where("old <> component").limit(1).count()
        label = new.select("term", "component")
        if not changed:
            break
    return label


def largest_component(label: DataFrame) -> DataFrame:
    """term: the nodes of the largest component (ties: the smaller name); single nodes don't count."""
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "component").limit(1)
    return label.join(sizes.select("component"), "component", "left_semi").select("term")


def merge_small(label: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """term, cluster from 1 by size: clusters under `least` members go, all at once, to the large cluster they
    are tied to most (ties: the smaller id), or to the largest. label: term, cluster."""
    sizes = label.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    big = sizes.where(F.col("n") >= least)
    both = edges.select("src", "dst", "weight").unionAll(edges.select("dst", "src", "weight"))
    ties = both.join(label.withColumnsRenamed({"term": "src", "cluster": "own"}), "src").join(label.withColumnsRenamed({"term": "dst", "cluster": "other"}), "dst")
    ties = ties.join(big.select(F.col("cluster").alias("other")), "other", "left_semi").join(big.select(F.col("cluster").alias("own")), "own", "left_anti")
    to = ties.groupBy("own", "other").agg(F.sum("weight").alias("w")).groupBy("own").agg(F.min(F.struct((-F.col("w")).alias("w"), "other")).alias("best"))
    largest = sizes.orderBy(F.desc("n"), "cluster").limit(1).select(F.col("cluster").alias("largest"))
    moved = label.join(big.select(F.col("cluster"), F.lit(True).alias("keep")), "cluster", "left").join(to, F.col("cluster") == F.col("own"), "left").crossJoin(F.broadcast(largest))
    new = moved.select("term", F.when(F.col("keep"), F.col("cluster")).otherwise(F.coalesce("best.other", "largest")).alias("cluster"))
    ranked = new.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    number = global_rank(ranked, F.desc("n"), "cluster", name="k").select("cluster", F.col("k").cast("int").alias("k"))
    return new.join(number, "cluster").select("term", F.col("k").alias("cluster"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges of both networks; where both have an edge the second's weight holds."""
    b = second.select("src", "dst", F.col("weight").alias("__w"))
    return first.select("src", "dst", "weight").join(b, ["src", "dst"], "full").select("src", "dst", F.coalesce("__w", "weight").alias("weight"))
