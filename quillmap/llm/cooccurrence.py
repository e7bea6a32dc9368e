"""Items that appear together: sorted runs of packed 64-bit pair codes.

Every kept item gets a dense 32-bit id; a pair is the 64-bit code ``id_a << 32 | id_b``. Each task
fills a bounded buffer with codes, sorts it and writes it as a run of (code, length) rows; Spark's
shuffle sorts the runs externally (spilling and merging), and one streaming pass adds up equal
neighbours. Lift and odds ratio (with continuity correction) follow from the counts.

Items that cannot be in a result are left out first, without loss: a pair needs n_ab >= min_pairs,
so both items do; and n_ab <= min(n_a, n_b) makes max(n_a, n_b) <= n / min_lift. With it the items
that stand in a third of all records go before any pair is made.

Defined results: null or empty lists and blank items don't count; an item counts once in a record;
ties and repeated records are plain counts; an empty table gives no rows. A record of very many
items is cut into blocks of BLOCK ids, so that its pairs spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, norm_blank

#: Codes a task holds before it writes a run (8 bytes each), and ids in a block of a long record.
RUN_CODES, BLOCK = 2_000_000, 512


def record_items(df: DataFrame, rec: str, items: str) -> DataFrame:
    """rec, items: the distinct normalised items of each record that has any."""
    folded = F.filter(F.array_distinct(F.transform(F.filter(F.col(items), lambda x: x.isNotNull()), norm_blank)), lambda x: x != "")
    return df.select(F.col(rec).alias("rec"), folded.alias("items")).where(F.size("items") > 0)


def _number(items: DataFrame) -> DataFrame:
    """Adds dense ids from 0: place within the partition plus the partitions before it. Only one
    row per partition of the table reaches the driver."""
    spark = items.sparkSession
    held = materialize(items.withColumn("mid", F.monotonically_increasing_id()), "items")
    parts = held.groupBy(F.shiftright("mid", 33).alias("part")).count().collect()
    rows, at = [], 0
    for r in sorted(parts, key=lambda r: r["part"]):
        rows.append((r["part"], at))
        at += r["count"]
    if at >= 1 << 31:
        raise ValueError("more than 2^31 items pass the filters; raise min_pairs")
    offsets = spark.createDataFrame(rows, "part long, start long")
    return held.withColumn("part", F.shiftright("mid", 33)).join(F.broadcast(offsets), "part").select((F.col("start") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), "item", "n_item")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) id lists to sorted runs of (code, n). b null: all pairs within a; else all of a with b."""
    held: list[np.ndarray] = []
    size = 0

    def run() -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])

    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        offs = a.offsets.to_numpy()
        flat = a.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(offs)
        alone = np.asarray(b.is_null())
        for length in np.unique(lengths[alone]):
            if length < 2:
                continue
            i, j = np.triu_indices(length, 1)
            starts = offs[:-1][alone & (lengths == length)]
            step = max(1, RUN_CODES // max(1, len(i)))
            for k in range(0, len(starts), step):
                ids = flat[starts[k : k + step, None] + np.arange(length)]
                x, y = ids[:, i].ravel(), ids[:, j].ravel()
                held.append((np.minimum(x, y) << 32) | np.maximum(x, y))
                size += len(x)
                if size >= RUN_CODES:
                    yield run()
                    size = 0
        for r in np.flatnonzero(~alone):
            x = np.asarray(flat[offs[r] : offs[r + 1]])
            y = np.asarray(b[int(r)].values.to_numpy(zero_copy_only=False))
            x, y = np.repeat(x, len(y)), np.tile(y, len(x))
            held.append((np.minimum(x, y) << 32) | np.maximum(x, y))
            size += len(x)
            if size >= RUN_CODES:
                yield run()
                size = 0
    if held:
        yield run()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length sums over rows sorted by code; only the last code is carried between batches."""
    last, total = None, 0
    for b in batches:
        codes, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(codes):
            continue
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        sums, codes = np.add.reduceat(n, first), codes[first]
        if last is not None:
            if codes[0] == last:
                sums[0] += total
            else:
                codes, sums = np.r_[last, codes], np.r_[total, sums]
        last, total = int(codes[-1]), int(sums[-1])
        yield pa.RecordBatch.from_arrays([pa.array(codes[:-1]), pa.array(sums[:-1])], ["code", "n"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total], pa.int64())], ["code", "n"])


def pair_counts(ids: DataFrame) -> DataFrame:
    """code, n of every pair of ids (column ids: list of distinct 32-bit ids per record)."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("ids") / BLOCK).cast("int") - 1), lambda k: F.slice("ids", k * BLOCK + 1, BLOCK))
    none = F.lit(None).cast("array<long>")
    tiles = F.flatten(F.transform(blocks, lambda x, i: F.transform(F.slice(blocks, i + 1, F.size(blocks)), lambda y, j: F.struct(x.alias("a"), F.when(j > 0, y).alias("b")))))
    short = ids.where(F.size("ids").between(2, BLOCK)).select(F.col("ids").alias("a"), none.alias("b"))
    long = ids.where(F.size("ids") > BLOCK).select(F.explode(tiles).alias("t")).select("t.a", "t.b").repartition(F.xxhash64("a", "b"))
    n = ids.sparkSession.conf.get("spark.sql.shuffle.partitions")
    runs = short.union(long).mapInArrow(_runs, "code long, n long")
    return runs.repartition(int(n), "code").sortWithinPartitions("code").mapInArrow(_merge, "code long, n long")


def cooccurrence(records: DataFrame, min_pairs: int = 5, min_lift: float = 10.0) -> DataFrame:
    """item_a, item_b, n_ab, n_a, n_b, n, lift, odds_ratio of every pair of items with
    n_ab >= min_pairs and n_ab * n >= min_lift * n_a * n_b. records: as record_items gives."""
    records = materialize(records, "records")  # counted, filtered and paired: its cells are cut once
    n = records.count()
    exploded = records.select("rec", F.explode("items").alias("item"))
    kept = exploded.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).where((F.col("n_item") >= min_pairs) & (F.col("n_item") * F.lit(float(min_lift)) <= F.lit(n)))
    items = materialize(_number(kept), "numbered")
    ids = exploded.join(items.select("item", "id"), "item").groupBy("rec").agg(F.collect_list("id").alias("ids"))
    pairs = pair_counts(ids).where(F.col("n") >= min_pairs)
    left = items.select(F.col("id").alias("x"), F.col("item").alias("i_x"), F.col("n_item").alias("n_x"))
    right = items.select(F.col("id").alias("y"), F.col("item").alias("i_y"), F.col("n_item").alias("n_y"))
    named = pairs.select(F.shiftright("code", 32).alias("x"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("y"), F.col("n").alias("n_ab")).join(left, "x").join(right, "y")
    first = F.col("i_x") < F.col("i_y")
    out = named.select(
        F.when(first, F.col("i_x")).otherwise(F.col("i_y")).alias("item_a"), F.when(first, F.col("i_y")).otherwise(F.col("i_x")).alias("item_b"), "n_ab",
        F.when(first, F.col("n_x")).otherwise(F.col("n_y")).alias("n_a"), F.when(first, F.col("n_y")).otherwise(F.col("n_x")).alias("n_b"), F.lit(n).cast("long").alias("n"),
    ).where(F.col("n_ab") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    a, b, c = F.col("n_ab") + 0.5, F.col("n_a") - F.col("n_ab") + 0.5, F.col("n_b") - F.col("n_ab") + 0.5
    d = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab") + 0.5
    return out.withColumn("lift", F.round(F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")), 6)).withColumn("odds_ratio", F.round(a * d / (b * c), 6))
