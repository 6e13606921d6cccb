"""Keyed tables that take small commits: buckets of the key, a folder of changes per commit, compaction of touched buckets.

Layout below the table's folder::

    base/g=<commit>/bucket=<b>/   whole rows of a bucket, written by the commit that created or compacted it
    delta/c=<commit>/bucket=<b>/  changed rows of one commit, only for the buckets that it touches
    _log/c=<commit>/              one marker per commit; data without a marker does not exist for readers

A marker names the buckets that its commit wrote. A compaction rewrites only buckets that have changes; all other bucket
files stay as they are. A reader starts from the newest base of each bucket and lays the later changes over it: changes
are folded to one row per key first, so the base is joined with as many rows as were edited, not with its own history.

One writer at a time is assumed, as for any table without a lock service; a writer that dies leaves folders without a
marker, whose number the next writer passes over.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidemark.operators.mutation import latest_per_key
from tidemark.session import cut_lineage

BUCKETS = 256
_SETS, _FRESH, _COMMIT, _BUCKET = "__sets", "__fresh", "c", "bucket"
_MARKER = "kind string, key string, buckets int, touched array<int>, bases array<struct<bucket:int,commit:long>>, schema string"


@dataclass
class State:
    """What the markers say: the key, the number of buckets, each bucket's base and the changes since."""

    key: str
    buckets: int
    schema: T.StructType
    bases: dict[int, int]
    deltas: dict[int, list[int]]    # commit: touched buckets
    last: int

    def changes_of(self, wanted: Iterable[int] | None = None) -> dict[int, list[int]]:
        """Per commit the buckets whose change is newer than their base."""
        chosen = None if wanted is None else set(wanted)
        newer = {c: [b for b in touched if c > self.bases.get(b, -1) and (chosen is None or b in chosen)] for c, touched in self.deltas.items()}
        return {c: touched for c, touched in newer.items() if touched}


def state_of(spark: SparkSession, table: str) -> State | None:
    """The table as its markers describe it; None where there is no table. Markers older than the last full list of bases are not needed."""
    try:
        markers = spark.read.schema(_MARKER + ", c long").option("basePath", f"{table}/_log").json(f"{table}/_log")
        last_full = markers.filter("bases IS NOT NULL").agg(F.max(_COMMIT)).first()[0]
        rows = markers.filter(F.col(_COMMIT) >= last_full).orderBy(_COMMIT).collect() if last_full is not None else []
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if not rows:
        return None
    full = rows[0]
    deltas = {r[_COMMIT]: list(r["touched"]) for r in rows if r["kind"] == "delta"}
    # changes that a compaction left alone belong to markers before it; the full list names the commit from which each bucket counts
    older = markers.filter((F.col(_COMMIT) < full[_COMMIT]) & (F.col(_COMMIT) > min(b["commit"] for b in full["bases"])) & (F.col("kind") == "delta"))
    deltas.update({r[_COMMIT]: list(r["touched"]) for r in older.collect()})
    return State(full["key"], full["buckets"], T.StructType.fromJson(json.loads(full["schema"])),
                 {b["bucket"]: b["commit"] for b in full["bases"]}, dict(sorted(deltas.items())), rows[-1][_COMMIT])


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(buckets)).cast("int")


def _mark(spark: SparkSession, table: str, commit: int, kind: str, key: str, buckets: int, touched: Sequence[int],
          bases: dict[int, int] | None, schema: T.StructType) -> None:
    listed = None if bases is None else sorted(bases.items())
    marker = spark.createDataFrame([(kind, key, buckets, sorted(touched), listed, schema.json())], _MARKER)
    marker.coalesce(1).write.mode("errorifexists").json(f"{table}/_log/c={commit}")


def _write(df: DataFrame, table: str, folder: str, mark: str, commit: int) -> int:
    """Write rows by bucket below a commit number that is free; returns that number."""
    while True:
        try:
            df.hint("rebalance", _BUCKET).write.mode("errorifexists").partitionBy(_BUCKET).parquet(f"{table}/{folder}/{mark}={commit}")
            return commit
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            commit += 1


def _written_buckets(spark: SparkSession, path: str, schema: T.StructType) -> list[int]:
    """Buckets that a written folder has: the partition column alone, no data is read."""
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])).parquet(path)
    return [r[0] for r in found.select(_BUCKET).distinct().collect()]


def create(df: DataFrame, table: str, key: str, buckets: int = BUCKETS) -> int:
    """Start a table from rows with unique keys; returns the number of its first commit."""
    if state_of(df.sparkSession, table) is not None:
        raise FileExistsError(table)
    commit = _write(df.withColumn(_BUCKET, bucket_of(key, buckets)), table, "base", "g", 1)
    _mark(df.sparkSession, table, commit, "base", key, buckets, [], {b: commit for b in range(buckets)}, df.schema)
    return commit


def _need(spark: SparkSession, table: str) -> State:
    state = state_of(spark, table)
    if state is None:
        raise FileNotFoundError(f"{table} has no committed version")
    return state


def _bases(spark: SparkSession, table: str, state: State, wanted: Iterable[int] | None) -> DataFrame:
    """Base rows of the wanted buckets, each from its own generation. Paths are as many as generations, buckets a partition filter."""
    chosen = set(range(state.buckets)) if wanted is None else set(wanted)
    by_generation: dict[int, list[int]] = {}
    for bucket in sorted(chosen):
        by_generation.setdefault(state.bases[bucket], []).append(bucket)
    schema = T.StructType([*state.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
    out = None
    for generation, own in by_generation.items():
        part = spark.read.schema(schema).parquet(f"{table}/base/g={generation}")
        part = part if len(own) == state.buckets else part.filter(F.col(_BUCKET).isin(own))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _folded(spark: SparkSession, table: str, state: State, wanted: Iterable[int] | None) -> DataFrame | None:
    """All later changes, one row per key: ``__v_<column>`` (set or not, value) and whether the key is new."""
    changes = state.changes_of(wanted)
    if not changes:
        return None
    fields = [*state.schema.fields, T.StructField(_SETS, T.ArrayType(T.StringType())), T.StructField(_FRESH, T.BooleanType()), T.StructField(_BUCKET, T.IntegerType())]
    rows = None
    for commit, touched in changes.items():
        part = spark.read.schema(T.StructType(fields)).parquet(f"{table}/delta/c={commit}").filter(F.col(_BUCKET).isin(touched)).withColumn(_COMMIT, F.lit(commit))
        rows = part if rows is None else rows.unionByName(part)
    others = [f.name for f in state.schema.fields if f.name != state.key]
    when_set = {c: F.when(F.array_contains(_SETS, c), F.col(_COMMIT)) for c in others}
    return rows.groupBy(state.key).agg(
        F.max(_FRESH).alias(_FRESH),
        *[F.max_by(F.struct(F.col(c).alias("value")), when_set[c]).alias(f"__v_{c}") for c in others])


def read(spark: SparkSession, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
    """The table's rows as of the last commit; ``buckets`` restricts the files that are read."""
    state = _need(spark, table)
    base = _bases(spark, table, state, buckets).drop(_BUCKET)
    folded = _folded(spark, table, state, buckets)
    if folded is None:
        return base
    others = [f.name for f in state.schema.fields if f.name != state.key]
    kept = base.join(folded.filter(~F.col(_FRESH)).drop(_FRESH), state.key, "left").select(*[
        F.when(F.col(f"__v_{c}").isNotNull(), F.col(f"__v_{c}.value")).otherwise(F.col(c)).alias(c) if c in others else F.col(c) for c in base.columns])
    fresh = folded.filter(_FRESH).select(*[F.col(f"__v_{c}.value").alias(c) if c in others else F.col(c) for c in base.columns])
    return kept.unionByName(fresh)


def keys_of(spark: SparkSession, table: str, state: State, wanted: Iterable[int] | None) -> DataFrame:
    """Keys of the wanted buckets: one column of their bases and changes."""
    keys = _bases(spark, table, state, wanted).select(state.key)
    for commit, touched in state.changes_of(wanted).items():
        fields = [f for f in state.schema.fields if f.name == state.key]
        part = spark.read.schema(T.StructType([*fields, T.StructField(_FRESH, T.BooleanType()), T.StructField(_BUCKET, T.IntegerType())]))
        keys = keys.unionByName(part.parquet(f"{table}/delta/c={commit}").filter(F.col(_BUCKET).isin(touched) & F.col(_FRESH)).select(state.key))
    return keys


def _commit(df: DataFrame, table: str, state: State) -> int:
    """Write prepared change rows and their marker; an empty batch leaves no commit."""
    spark = df.sparkSession
    commit = _write(df, table, "delta", _COMMIT, state.last + 1)
    touched = _written_buckets(spark, f"{table}/delta/c={commit}", state.schema)
    if not touched:
        return state.last
    _mark(spark, table, commit, "delta", state.key, state.buckets, touched, None, state.schema)
    return commit


def _with_known(rows: DataFrame, table: str, state: State) -> DataFrame:
    """Bucketed rows with ``__known``: whether the table holds the key. Reads the key column of the touched buckets only."""
    spark = rows.sparkSession
    bucketed = cut_lineage(rows.withColumn(_BUCKET, bucket_of(state.key, state.buckets)))
    touched = [r[0] for r in bucketed.select(_BUCKET).distinct().collect()]    # at most as many as the table has buckets
    known = keys_of(spark, table, state, touched).withColumn("__known", F.lit(True))
    return bucketed.join(known, state.key, "left").withColumn("__known", F.coalesce("__known", F.lit(False)))


def commit_upsert(batch: DataFrame, table: str, mapped: Sequence[str], loaded_at: Column,
                  timestamp: str | None = None, touch_timestamp: bool = False) -> int:
    """Commit a batch with unique keys: known keys take the mapped columns, new ones get NULL elsewhere and ``loaded_at``."""
    state = _need(batch.sparkSession, table)
    mapped = [c for c in mapped if c != state.key]
    rows = _with_known(batch.select(state.key, *mapped), table, state)
    columns = []
    for field in state.schema.fields:
        if field.name == state.key or field.name in mapped:
            value = F.col(field.name).cast(field.dataType)
        elif field.name == timestamp:
            value = loaded_at.cast(field.dataType)
        else:
            value = F.lit(None).cast(field.dataType)
        columns.append(value.alias(field.name))
    others = [f.name for f in state.schema.fields if f.name != state.key]
    changed = [*mapped, *([timestamp] if timestamp and touch_timestamp else [])]
    sets = F.when(F.col("__known"), F.array(*map(F.lit, changed))).otherwise(F.array(*map(F.lit, others)))
    return _commit(rows.select(*columns, sets.alias(_SETS), (~F.col("__known")).alias(_FRESH), _BUCKET), table, state)


def commit_update(updates: DataFrame, table: str, columns: Sequence[str], order: str) -> dict[str, int]:
    """Commit new values of some columns; the last update per key wins, unknown keys are ignored. Counts as submitted."""
    state = _need(updates.sparkSession, table)
    wanted = updates.select(state.key, *dict.fromkeys([*columns, order]))
    last = latest_per_key(wanted, state.key, order)
    known = _with_known(last, table, state).filter("__known")
    values = [(F.col(f.name).cast(f.dataType) if f.name == state.key or f.name in columns else F.lit(None).cast(f.dataType)).alias(f.name)
              for f in state.schema.fields]
    commit = _commit(known.select(*values, F.array(*map(F.lit, columns)).alias(_SETS), F.lit(False).alias(_FRESH), _BUCKET), table, state)
    spark = updates.sparkSession
    if commit == state.last:
        return {"submitted": updates.count(), "matched": 0}
    hit = spark.read.parquet(f"{table}/delta/c={commit}").select(state.key).withColumn("__hit", F.lit(1))
    found = updates.select(state.key).join(hit, state.key, "left").agg(F.count(F.lit(1)).alias("submitted"), F.count("__hit").alias("matched")).first()
    return found.asDict()


def compact(spark: SparkSession, table: str, least: int = 1) -> list[int]:
    """Rewrite the buckets that have at least ``least`` commits of changes; returns them. Other buckets' files stay."""
    state = _need(spark, table)
    counts: dict[int, int] = {}
    for touched in state.changes_of().values():
        for bucket in touched:
            counts[bucket] = counts.get(bucket, 0) + 1
    chosen = sorted(b for b, n in counts.items() if n >= least)
    if not chosen:
        return []
    rows = read(spark, table, chosen).withColumn(_BUCKET, bucket_of(state.key, state.buckets))
    commit = _write(rows, table, "base", "g", state.last + 1)
    _mark(spark, table, commit, "base", state.key, state.buckets, chosen, {**state.bases, **{b: commit for b in chosen}}, state.schema)
    return chosen
