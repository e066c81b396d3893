"""Optimistic validation of transactions against refs, and their ordered admission."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.functions.ident import absent_as_zero, is_zero
from logfold.operators.lineage import cut
from logfold.operators.state import running


def chain_breaks(updates: DataFrame) -> DataFrame:
    """updates with `expected`, the id that the ref had before, and whether `old_oid` is not that. An ordinal orders a generation's updates."""
    order = [c for c in ("generation", "ordinal") if c in updates.columns]
    before = F.lag("new_oid").over(Window.partitionBy("repo_id", "ref").orderBy(*order))
    expected = F.coalesce(before, F.repeat(F.lit("0"), F.length("old_oid")))
    return updates.withColumn("expected", expected).withColumn("broken", F.col("old_oid") != F.col("expected"))


def transaction_state(updates: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """One row a transaction: applied (all refs are at new), before (all at old), after (all at new, absent counting as zeros).

    A transaction without updates has no row here; by definition it is applied."""
    now = absent_as_zero(F.col("oid"), F.col("old_oid"))
    applied = F.when(is_zero(F.col("new_oid")), F.col("oid").isNull()).otherwise(F.col("oid").eqNullSafe(F.col("new_oid")))
    joined = updates.join(refs, ["repo_id", "ref"], "left")
    return joined.groupBy(*keys).agg(F.count("*").alias("n_updates"), F.every(applied).alias("applied"), F.every(now == F.col("old_oid")).alias("before"), F.every(now == F.col("new_oid")).alias("after"))


def lock_conflicts(incoming: DataFrame, prepared: DataFrame) -> DataFrame:
    """Incoming transactions that share a ref with another one that is prepared.

    Another one exists if the ref's smallest or largest prepared transaction is another, so a busy ref costs one row."""
    ends = prepared.groupBy("repo_id", "ref").agg(F.min("tx").alias("_first"), F.max("tx").alias("_last"))
    return incoming.join(ends, ["repo_id", "ref"]).where((F.col("_first") != F.col("tx")) | (F.col("_last") != F.col("tx"))).drop("_first", "_last")


def stale(prepared: DataFrame, now: int, age: int = 300_000_000) -> DataFrame:
    """Prepared transactions with a time, at least `age` microseconds old."""
    return prepared.where(F.col("created").isNotNull() & (F.col("created") != 0) & (F.lit(now) - F.col("created") >= age))


def latest_entry(entries: DataFrame, wanted: DataFrame, heads: DataFrame) -> DataFrame:
    """wanted (repo_id, tx) with the newest generation of an entry with that id; without one, the head's and no file."""
    last = entries.groupBy("repo_id", "tx").agg(F.max_by("file", "generation").alias("file"), F.max("generation").alias("generation"))
    out = wanted.join(last, ["repo_id", "tx"], "left").join(heads, "repo_id", "left")
    return out.select("repo_id", "tx", F.coalesce("generation", "head").alias("generation"), F.coalesce("file", F.lit("")).alias("file"))


def abort_action(before: Column, after: Column, certified: Column) -> Column:
    """What an abort does: nothing where history may not change or nothing was applied, else the inverse entry."""
    return F.when(~certified, "keep").when(after, "append_inverse").when(before, "none").otherwise("error")


def reference_step(state: Column) -> Column:
    """The step that each state of a reference transaction calls for."""
    return F.when(state == "prepared", "commit").when(state == "aborted", "abort").when(state == "committed", "finalize").otherwise("error")


ADMITTED = "repo_id string, batch long, tx long, generation long, status string"
ORDER = ("arrival", "tx", "ordinal")
#: Partitions a core of the sorts by ref, which hold every row twice; a share of the rows that fits beside others.
PIECES = 16


def _status(refs: dict[int, int], moves: list[tuple[int, int, int]]) -> str:
    """Outcome of a transaction (ref, old, new as numbers of _coded) on the live refs: applied already, else every old id must hold."""
    if all(refs.get(ref, 0) == new for ref, _, new in moves):
        return "applied"
    return "conflict" if any(refs.get(ref, 0) != old for ref, old, _ in moves) else "accepted"


def _move(refs: dict[int, int], ref: int, new: int) -> None:
    if new:
        refs[ref] = new
    else:
        refs.pop(ref, None)


class Refs:
    """The live refs of one repository while its transactions are admitted in order, in batches that hold or fail as one."""

    def __init__(self, repo: str):
        self.repo, self.refs, self.generation = repo, {}, 0
        self.batch, self.undo, self.open, self.failed = None, [], [], False

    def settle(self, batch: int, tx: int, moves: list[tuple[int, int, int]]) -> list[tuple]:
        """Takes the next transaction; returns the outcomes of the batch before, if this one opens another."""
        out = self.close() if batch != self.batch else []
        self.batch = batch
        status = "rolled_back" if self.failed else _status(self.refs, moves)
        if status == "conflict":
            self._roll_back()
        elif status == "accepted":
            self.generation += 1
            for ref, _, new in moves:
                self.undo.append((ref, self.refs.get(ref, 0)))
                _move(self.refs, ref, new)
        self.open.append((tx, self.generation, status))
        return out

    def _roll_back(self) -> None:
        """Puts back what the batch has changed; nothing of it shows."""
        for ref, before in reversed(self.undo):
            _move(self.refs, ref, before)
        self.generation -= sum(s == "accepted" for _, _, s in self.open)
        self.open = [(tx, self.generation, "rolled_back") for tx, _, _ in self.open]
        self.failed = True

    def close(self) -> list[tuple]:
        out = [(self.repo, self.batch, *x) for x in self.open]
        self.undo, self.open, self.failed = [], [], False
        return out


def _admit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    log, at, held = None, None, []

    def settled():
        return log.settle(at[1], at[2], held) if held else []

    for frame in frames:
        out = []
        for repo, batch, tx, ref, old, new in zip(*(frame[c].tolist() for c in ("repo_id", "batch", "tx", "_ref", "_old", "_new")), strict=True):
            if (repo, batch, tx) != at:
                out += settled()
                held = []
                if log is None or repo != log.repo:
                    out += log.close() if log else []
                    log = Refs(repo)
                at = (repo, batch, tx)
            held.append((ref, old, new))
        if out:
            yield pd.DataFrame(out, columns=["repo_id", "batch", "tx", "generation", "status"])
    if log:
        yield pd.DataFrame(settled() + log.close(), columns=["repo_id", "batch", "tx", "generation", "status"])


def _coded(updates: DataFrame, columns: list[str]) -> DataFrame:
    """columns of updates with _ref, _old and _new, numbers in place of the texts: refs have different numbers, ids of one ref
    have the same number if they are equal, and 0 stands for zeros, whatever their length.

    The numbers are ranks and not hashes, so comparing them is exact. They come from sorts by ref, and what an ordered
    pass has to read and hold is a few bytes a row, however long names and ids are."""
    alike = Window.partitionBy("repo_id", "ref").orderBy("_oid")
    row = Window.partitionBy("repo_id", "ref").orderBy("_row", "_side")
    pieces = PIECES * updates.sparkSession.sparkContext.defaultParallelism
    rows = updates.select(*columns, "ref", "old_oid", "new_oid").repartition(pieces, "repo_id", "ref").withColumn("_row", F.monotonically_increasing_id())
    sides = rows.select(*columns, "ref", "_row", F.posexplode(F.array("old_oid", "new_oid")).alias("_side", "_oid"))
    sides = sides.withColumn("_ref", F.first("_row").over(alike)).withColumn("_new", F.when(is_zero(F.col("_oid")), 0).otherwise(F.dense_rank().over(alike)))
    return sides.withColumn("_old", F.lag("_new").over(row)).where("_side = 1").select(*columns, "_ref", "_old", "_new")


def batch_outcomes(updates: DataFrame, order: tuple = ORDER) -> DataFrame:
    """Outcome of each transaction of updates (with batch), repositories side by side and each one in order.

    In turn: applied already, else every old id must hold, else conflict. A conflict fails its whole batch: what the
    batch changed before is put back, and its other transactions are rolled back. The order inside a repository is the
    semantics, so its rows stream through one task in Arrow batches, sorted by the shuffle, with numbers in place of refs
    and ids; only the live refs and the open batch are held. Repositories are never null."""
    rows = _coded(updates, list(dict.fromkeys(["repo_id", "batch", *order, "tx"])))
    rows = rows.repartition("repo_id").sortWithinPartitions("repo_id", "batch", *order).select("repo_id", "batch", "tx", "_ref", "_old", "_new")
    return rows.mapInPandas(_admit, ADMITTED)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """repo_id, the transaction's columns and status, from rows that begin with repo_id, _part and those columns and end with _ref, _old, _new."""
    part, at, refs, held = None, None, {}, []

    def settled() -> str:
        status = _status(refs, held)
        for ref, _, new in held if status == "accepted" else ():
            _move(refs, ref, new)
        return status

    schema = None
    for b in batches:
        schema = pa.schema([b.schema.field(0), *(b.schema.field(k) for k in range(2, b.num_columns - 3)), ("status", pa.string())])
        out = []
        for *key, ref, old, new in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != at:
                if at:
                    out.append((at[0], *at[2:], settled()))
                if key[:2] != part:
                    part, refs = key[:2], {}
                at, held = key, []
            held.append((ref, old, new))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((at[0], *at[2:], settled()), schema, strict=True)], schema=schema)


def ordered_admission(updates: DataFrame, order: tuple = ORDER) -> DataFrame:
    """Outcome of each transaction (repo_id, tx, generation, status) where each is a batch of its own: rows alike in all of order but its last column, the row's place.

    An outcome depends only on what came before on the transaction's own refs. So each ref is a stream of its own, and
    only refs that share transactions with others go together, as one stream a repository. Generations, which
    count a repository's accepted transactions, come from sums in buckets of a day."""
    tx = list(dict.fromkeys([*order[:-1], "tx"]))
    spread = updates.groupBy("repo_id", *tx).agg(F.min("ref").alias("_least"), F.max("ref").alias("_most")).where("_least <> _most").drop("_least", "_most")
    spread = spread.select(*(F.col(c).alias(f"_{c}") for c in spread.columns))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ["repo_id", *tx]))
    shared = updates.join(spread, same, "left_semi").select("repo_id", "ref").distinct().withColumn("_shared", F.lit(True))
    rows = _coded(updates.join(shared, ["repo_id", "ref"], "left"), list(dict.fromkeys(["repo_id", *tx, order[-1], "_shared"])))
    rows = rows.withColumn("_part", F.when(F.col("_shared"), -1).otherwise(F.col("_ref")))
    rows = rows.repartition("repo_id", "_part").sortWithinPartitions("repo_id", "_part", *tx, order[-1]).select("repo_id", "_part", *tx, "_ref", "_old", "_new")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select("repo_id", *tx).dtypes)
    outcomes = cut(rows.mapInArrow(_alone, f"{kinds}, status string"), "outcomes")
    day = F.coalesce(F.floor(F.col(tx[0]) / 86_400_000_000), F.lit(-(2**62)))
    return running(outcomes, ["repo_id"], tx, day, F.col("status") == "accepted", "generation").select("repo_id", "tx", "generation", "status")


def batch_admission(outcomes: DataFrame) -> DataFrame:
    """One row a batch of batch_outcomes: it commits only if no transaction of it conflicts, and writes only if one changes something."""
    failed = F.count_if(F.col("status") == "conflict") > 0
    return outcomes.groupBy("repo_id", "batch").agg(F.count("*").alias("n"), failed.alias("failed"), (~failed & (F.count_if(F.col("status") == "accepted") > 0)).alias("writes"), F.max("generation").alias("generation"))
