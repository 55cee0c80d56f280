"""Append and entity tables: merge, deletes, lineage, slices, compaction, statistics and pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import number_rows, running_sums


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """An append table keeps every row, equal ones too."""
    return table.unionByName(rows)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; the plan prunes before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge(table: DataFrame, log: DataFrame, keys: Sequence[str], version: str, seq: str = "seq", op: str = "op", keep_deletes: bool = False) -> DataFrame:
    """An entity table after a log of writes (op I, U or D): the highest version wins, then the later sequence.

    A stale write that arrives late loses by its version; a delete removes the key if it wins. table has
    the same columns; its rows count as sequence 0 where it has none. With keep_deletes the deletes that
    won stay as rows, so that a write that is older yet comes later can't bring the key back.
    """
    base = table
    if seq not in table.columns:
        base = base.withColumn(seq, F.lit(0).cast("long"))
    if op not in table.columns:
        base = base.withColumn(op, F.lit("I"))
    won = latest(base.unionByName(log, allowMissingColumns=True), keys, [F.col(version).desc(), F.col(seq).desc()])
    return won if keep_deletes else won.filter(F.col(op) != "D").drop(op)


def delete_positions(rows: DataFrame, deletes: DataFrame, on: Sequence[str] = ("file_path", "pos")) -> DataFrame:
    """Rows without those at deleted positions. Spark broadcasts the deletes only if their size allows it."""
    return rows.join(deletes.select(*on), list(on), "left_anti")


def with_position(files: DataFrame) -> DataFrame:
    """Adds file_path and pos, as the Parquet reader tells them."""
    return files.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"))


def with_lineage(rows: DataFrame, order: Sequence[Column | str], first_id: int, seq: int) -> DataFrame:
    """Adds _row_id, from first_id on in order, and _last_updated_seq."""
    return number_rows(rows, *order, name="_row_id", start=first_id).withColumn("_last_updated_seq", F.lit(seq).cast("long"))


# ---------------------------------------------------------------- slices of the key space


def slice_bounds(rows: DataFrame, key: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Half-open bounds [lo, hi) of n slices of the different keys in each partition, even but for one key; the last has no hi.

    Keys are numbered over range partitions, so no task holds a partition's keys.
    """
    keys = number_rows(rows.select(*by, key).distinct(), *by, key, name="_n")
    span = keys.groupBy(*by).agg(F.min("_n").alias("_from"), F.count("*").alias("_keys"))
    named = span.select(*[F.col(c).alias(f"_{c}") for c in by], "_from", "_keys")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    r, size, longer = F.col("_n") - F.col("_from"), F.floor(F.col("_keys") / n), F.col("_keys") % n
    tile = F.when(r < longer * (size + 1), F.floor(r / (size + 1))).otherwise(longer + F.floor((r - longer * (size + 1)) / F.greatest(size, F.lit(1))))
    lows = keys.join(named, same).groupBy(*by, (tile + 1).cast("int").alias("slice")).agg(F.min(key).alias("lo"))
    return lows.withColumn("hi", F.lead("lo").over(Window.partitionBy(*by).orderBy("slice")))  # n rows for each partition


def assign_slices(rows: DataFrame, bounds: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with their slice: as many as there are lower bounds up to the key. bounds: a few rows for each partition, gathered in one."""
    los = bounds.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sort_array(F.collect_list("lo")).alias("_los"))
    slice_ = F.size(F.filter("_los", lambda lo: lo <= F.col(key)))
    if by:
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        joined = rows.join(los, same)
    else:
        # One row of n numbers.
        first = los.first()
        joined = rows.withColumn("_los", F.array(*[F.lit(x) for x in (first._los if first else [])]))
    return joined.withColumn("slice", slice_).filter("slice > 0").drop("_los", *[f"_{c}" for c in by])


def slice_stats(assigned: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    return assigned.groupBy(*by, "slice").agg(F.count("*").alias("n_rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def split_decision(stats: DataFrame, most: int) -> DataFrame:
    return stats.withColumn("split", F.col("n_rows") > most)


def merge_small(stats: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """Neighbouring slices as one while they have `most` rows at most together: adds merged, from 0. A larger slice stays alone.

    The few slices of a partition are gathered in one row and taken in order.
    """
    listed = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("slice", F.struct(*[c for c in stats.columns if c not in (*by, "slice")]).alias("rest")))).alias("all"))
    start = F.struct(F.array().cast("array<bigint>").alias("bins"), F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("rows"))

    def step(s: Column, x: Column) -> Column:
        fits = (s.bin >= 0) & (s.rows + x.rest.n_rows <= most)
        bin_ = F.when(fits, s.bin).otherwise(s.bin + 1)
        return F.struct(F.array_append(s.bins, bin_).alias("bins"), bin_.alias("bin"), (F.when(fits, s.rows).otherwise(F.lit(0).cast("long")) + x.rest.n_rows).alias("rows"))

    binned = listed.withColumn("bins", F.aggregate("all", start, step, lambda s: s.bins))
    flat = binned.select(*by, F.explode(F.arrays_zip("all", "bins")).alias("x"))
    return flat.select(*by, "x.all.slice", "x.all.rest.*", F.col("x.bins").alias("merged"))


# ---------------------------------------------------------------- files


def compaction_plan(files: DataFrame, order: str, size: str, target: int, by: Sequence[str] = ()) -> DataFrame:
    """Bins of about target size (more by a part of one file at most) by cumulative size in order, in each partition `by`.

    files: one row for each file. Sums run over range partitions, so no task holds all files.
    """
    summed = running_sums(files, [*by, order], {"_upto": F.col(size)})
    if by:
        first = summed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min(F.col("_upto") - F.col(size)).alias("_start"))
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        summed = summed.join(first, same).drop(*[f"_{c}" for c in by])
    else:
        summed = summed.withColumn("_start", F.lit(0))
    return summed.withColumn("bin", F.floor((F.col("_upto") - F.col(size) - F.col("_start")) / target).cast("long")).drop("_upto", "_start")


def file_stats(rows: DataFrame, file: Column | str, columns: Sequence[str]) -> DataFrame:
    """Rows, and least and largest values of columns, for each file."""
    stats = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy(file).agg(F.count("*").alias("n_rows"), *stats)


def orphans(found: DataFrame, live: DataFrame, on: str) -> DataFrame:
    """What is found and not live."""
    return found.join(live.select(F.col(on)), on, "left_anti")


def validate(rows: DataFrame, required: Sequence[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """Adds verdict: the first rule that a row breaks, or ok. Nulls in required columns break `null_<column>`."""
    verdict = F.lit("ok")
    for name, fine in reversed(list((rules or {}).items())):
        verdict = F.when(~F.coalesce(fine, F.lit(False)), name).otherwise(verdict)
    for c in reversed(required):
        verdict = F.when(F.col(c).isNull(), f"null_{c}").otherwise(verdict)
    return rows.withColumn("verdict", verdict)


def route(key: Column, n: int) -> Column:
    """Affinity: the same key always goes to the same of n workers. The hash is md5, so that other systems agree."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n
