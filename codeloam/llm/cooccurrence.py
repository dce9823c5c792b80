"""Items that appear together: counts of pairs within records and how far they exceed chance.

Items get 32-bit numbers from a sorted dictionary, pairs are packed into 64-bit codes, and the codes are sorted. Spark's
sort spills sorted runs and merges them; a scan over the sorted codes counts their runs. This is done once within each
input task, so that a pair of any frequency sends one row per task, and once after the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import pinned, stored

#: An item with more than one in HOT of the rows is spread over SALTS tasks where rows meet their items; there are fewer than HOT of them.
HOT, SALTS = 64, 16

_PAIRS = """explode(flatten(transform(slice(_ids, 1, size(_ids) - 1), (x, i) ->
    transform(slice(_ids, i + 2, size(_ids)), y -> shiftleft(x, 32) | y)))) as code"""


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums `n` over runs of equal codes; the last run is carried into the next batch."""
    code: int | None = None
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1]
        sums, heads = np.add.reduceat(n, starts), codes[starts]
        if code is not None:
            if heads[0] == code:
                sums[0] += count
            else:
                heads, sums = np.r_[code, heads], np.r_[count, sums]
        code, count = int(heads[-1]), int(sums[-1])
        if len(heads) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(heads[:-1]), pa.array(sums[:-1])], names=["code", "n"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([count], pa.int64())], names=["code", "n"])


def _runs(codes: DataFrame) -> DataFrame:
    return codes.sortWithinPartitions("code").mapInArrow(_run_lengths, "code long, n long")


def cooccurrence(df: DataFrame, scope: list[str], record: str, item: str, max_items: int = 100, min_together: int = 1) -> DataFrame:
    """Pairs per scope: scope, item_a < item_b, n_ab, n_a, n_b, records, lift, odds_ratio.

    Counts are over records of 1 to max_items distinct items: the bound belongs to the statistic (a record of many items
    says little of any pair), and `records` is their number. lift = n_ab * records / (n_a * n_b); odds_ratio has 1/2 added
    to each of the four cells, so it is finite. Null items are ignored, as are null records; null scopes are a value like
    any other; items repeated in a record count once. min_together drops rarer pairs after counting.
    """
    spark = df.sparkSession
    sc = [f"_s{i}" for i in range(len(scope))]
    rows = df.where(F.col(record).isNotNull() & F.col(item).isNotNull()).select(*[F.col(k).alias(s) for k, s in zip(scope, sc)], F.col(record).alias("_record"), F.col(item).alias("_item")).distinct()
    # sizes come from partial counts, so a record with any share of the rows is never gathered
    rows = stored(rows)
    sized = rows.groupBy(*sc, "_record").agg(F.count("*").alias("_size")).where(F.col("_size") <= max_items)
    totals = sized.groupBy(*sc).agg(F.count("*").alias("records"))
    right = sized.select(*[F.col(s).alias(f"{s}r") for s in sc], F.col("_record").alias("_rr"))
    used = rows.join(right, [*(F.col(s).eqNullSafe(F.col(f"{s}r")) for s in sc), F.col("_record") == F.col("_rr")], "left_semi")
    # number = row * parts + part: unique, and below 2^31 while no part holds more than 2^31 / parts items
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = used.groupBy(*sc, "_item").agg(F.count("*").alias("_n"))
    place = F.monotonically_increasing_id()
    items = counted.repartition(parts, *sc, "_item").sortWithinPartitions(*sc, "_item").withColumn("_at", place)
    number = F.shiftrightunsigned("_at", 33) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) * parts
    items = pinned(items.withColumn("_id", F.expr(f"if((_at & 8589934591L) < {(1 << 31) // parts}L, 0L, cast(raise_error('more than 2^31 items') as long))") + number).drop("_at"))
    many = F.col("_n") * HOT > rows.count()
    salts = F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    ids = items.select(*[F.col(s).alias(f"{s}r") for s in sc], F.col("_item").alias("_ir"), "_id", F.explode(salts).alias("_sr"))
    hot = items.where(many).select(*[F.col(s).alias(f"{s}h") for s in sc], F.col("_item").alias("_ih"), F.lit(1).alias("_hot"))
    salted = used.join(F.broadcast(hot), [*(F.col(s).eqNullSafe(F.col(f"{s}h")) for s in sc), F.col("_item") == F.col("_ih")], "left")
    salted = salted.select(*sc, "_record", "_item", F.when(F.col("_hot") == 1, F.pmod(F.xxhash64("_record"), F.lit(SALTS)).cast("int")).otherwise(0).alias("_salt"))
    coded = salted.join(ids, [*(F.col(s).eqNullSafe(F.col(f"{s}r")) for s in sc), F.col("_item") == F.col("_ir"), F.col("_salt") == F.col("_sr")]).select(*sc, "_record", "_id")
    baskets = coded.groupBy(*sc, "_record").agg(F.sort_array(F.collect_list("_id")).alias("_ids")).where("size(_ids) > 1")
    codes = baskets.select(F.expr(_PAIRS)).withColumn("n", F.lit(1).cast("long"))
    pairs = _runs(_runs(codes).repartition(parts, "code")).where(F.col("n") >= min_together)
    a = items.select(*sc, F.col("_id").alias("_a"), F.col("_item").alias("x"), F.col("_n").alias("nx"))
    b = items.select(F.col("_id").alias("_b"), F.col("_item").alias("y"), F.col("_n").alias("ny"))
    named = pairs.withColumn("_a", F.shiftrightunsigned("code", 32)).withColumn("_b", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))).join(a, "_a").join(b, "_b")
    total = totals.select(*[F.col(s).alias(f"{s}r") for s in sc], "records")
    out = named.join(total, [F.col(s).eqNullSafe(F.col(f"{s}r")) for s in sc])
    first = F.col("x") < F.col("y")
    out = out.select(
        *[F.col(s).alias(k) for k, s in zip(scope, sc)], F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), F.col("n").alias("n_ab"),
        F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("n_a"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("n_b"), "records",
    )
    only_a, only_b = F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    neither = F.col("records") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    return out.withColumn("lift", F.col("n_ab") * F.col("records") / (F.col("n_a") * F.col("n_b"))).withColumn("odds_ratio", (F.col("n_ab") + 0.5) * (neither + 0.5) / ((only_a + 0.5) * (only_b + 0.5)))
