"""Tables by key whose writes replace rows, all at once or not at all.

A table's rows lie in buckets by a hash of some of its columns. A write reads and rewrites only the buckets that its rows fall
into, into new folders, and then names them in a marker file; readers follow the newest marker, so they see a write as a whole or
not yet. What a run that was killed had written without a marker is never read, and the next write goes over it. Every write has a
source and a number; one that a marker already holds (a task, a job or a stream's batch that is run again) changes nothing.

One writer at a time: a second one finds its marker's name taken and fails. vacuum() removes folders that no marker names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.upserts import latest
from lectern.operators.windows import ranked_in_parts
from lectern.sources.shared import written


@dataclass(frozen=True)
class Table:
    """schema; keys: columns that name a row; by: those of them (default: all) whose hash says the bucket; last: where a write
    repeats a key, the row that is largest in these columns stays; scope: columns (`by` among them) whose stored rows go when a write has
    any row like them."""

    schema: str
    keys: Sequence[str]
    by: Sequence[str] = ()
    last: Sequence[str] = ()
    scope: Sequence[str] = ()


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, Table], buckets: int = 64):
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), dict(tables), buckets
        for t in self.tables.values():
            if t.scope and not set(t.by or t.keys) <= set(t.scope):
                raise ValueError("rows of one scope must lie in one bucket")

    # -- the marker ------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def _names(self, folder: str) -> list[str]:
        fs, where = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _state(self) -> tuple[int, dict]:
        """Number and content of the newest marker: the writes done, and each table's folder by bucket."""
        done = [n for n in self._names("markers") if n.isdigit()]
        if not done:
            return 0, {"writes": {}, "tables": {}}
        return int(done[-1]), json.loads(self.spark.read.text(f"{self.path}/markers/{done[-1]}", wholetext=True).first()[0])

    def _publish(self, number: int, state: dict) -> None:
        """Written aside and renamed, so that a marker is there wholly or not."""
        fs, folder = self._fs(f"{self.path}/markers")
        fs.mkdirs(folder)
        _, aside = self._fs(f"{self.path}/markers/.new")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        _, final = self._fs(f"{self.path}/markers/{number:012d}")
        if fs.exists(final) or not fs.rename(aside, final):
            raise RuntimeError(f"another writer has made {final}")

    # -- reading and writing ---------------------------------------------------------------------------------------

    def rows(self, name: str) -> DataFrame:
        """The table as the newest marker has it."""
        return self._read(name, list(self._state()[1]["tables"].get(name, {}).values()))

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def done(self, source: str, number: int) -> bool:
        return self._state()[1]["writes"].get(source, -1) >= number

    def put(self, changes: Mapping[str, DataFrame], source: str, number: int) -> bool:
        """Writes rows into one or more tables as one write; False if this write was done before."""
        at, state = self._state()
        if state["writes"].get(source, -1) >= number:
            return False
        for name, new in changes.items():
            state["tables"][name] = state["tables"].get(name, {}) | self._written(name, new, at + 1, state["tables"].get(name, {}))
        state["writes"][source] = number
        self._publish(at + 1, state)
        return True

    def _written(self, name: str, new: DataFrame, number: int, have: dict[str, str]) -> dict[str, str]:
        t = self.tables[name]
        columns = self.spark.createDataFrame([], t.schema).columns
        bucket = F.pmod(F.xxhash64(*(t.by or t.keys)), F.lit(self.buckets)).cast("int").alias("bucket")
        if t.last:
            new = latest(new, list(t.keys), [F.col(c).desc() for c in t.last])
        staged = f"data/{name}/{number:012d}"
        new = new.select(*columns, bucket)
        if not have:  # nothing to replace: written once
            new.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{staged}")
            return {n.split("=")[1]: f"{staged}/{n}" for n in self._names(staged) if n.startswith("bucket=")}
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{staged}-new")  # run once, whatever made it
        touched = [n.split("=")[1] for n in self._names(f"{staged}-new") if n.startswith("bucket=")]  # a bucket each at most
        fresh = self._read(name, [f"{staged}-new/bucket={b}" for b in touched]).select(*columns, bucket)
        old = self._read(name, [have[b] for b in touched if b in have]).select(*columns, bucket)
        for on in (t.keys, t.scope):
            if on:
                gone = fresh.select(*on).distinct()
                same = [old[c].eqNullSafe(gone[c]) for c in on]
                match = same[0]
                for s in same[1:]:
                    match = match & s
                old = old.join(gone, match, "left_anti")
        both = old.unionByName(fresh).hint("rebalance", "bucket")  # a bucket may take several files, so that a large one is split
        both.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{staged}")
        fs, aside = self._fs(f"{self.path}/{staged}-new")
        fs.delete(aside, True)
        return {b: f"{staged}/bucket={b}" for b in touched}

    def vacuum(self) -> int:
        """Removes what the newest marker doesn't name: replaced buckets, and what killed writes left. Returns how many folders."""
        _, state = self._state()
        named = {f for folders in state["tables"].values() for f in folders.values()}
        removed = 0
        for name in self._names("data"):
            for version in self._names(f"data/{name}"):
                for b in self._names(f"data/{name}/{version}"):
                    if b.startswith("bucket=") and f"data/{name}/{version}/{b}" not in named:
                        fs, where = self._fs(f"{self.path}/data/{name}/{version}/{b}")
                        removed += bool(fs.delete(where, True))
        return removed

    def filled(self, name: str, wanted: DataFrame, make: Callable[[DataFrame], DataFrame], source: str, number: int, on: Sequence[str]) -> DataFrame:
        """Stored rows for the wanted (columns `on`); where there are none, make(missing) is asked, and its rows are stored first."""
        missing = wanted.select(*on).distinct().join(self.rows(name).select(*on).distinct(), list(on), "left_anti")
        self.put({name: make(missing)}, source, number)
        return self.rows(name).join(wanted.select(*on).distinct(), list(on), "left_semi")


EXTRACTIONS = {
    "runs": Table("run_id long, review_id string, paper_id string, model_id string, status string, claims_count long, started_at timestamp_ntz", ["run_id"]),
    "claims": Table("id string, review_id string, paper_id string, run_id long, claim_index int, claim_text string, confidence double", ["id"], last=["run_id", "claim_index"]),
}


def save_extractions(store: Store, results: DataFrame, source: str, number: int) -> bool:
    """Runs with the numbers that follow the largest stored one, in the order of started_at and review_id, and their claims, which
    replace those of the same id; as one write.

    results: review_id, paper_id, model_id, status, started_at, claims (array of id, claim_index, claim_text, confidence). Numbered rows
    are written, as both tables are made of them.
    """
    if store.done(source, number):
        return False
    last = store.rows("runs").agg(F.coalesce(F.max("run_id"), F.lit(0).cast("long"))).first()[0]
    rows = ranked_in_parts(results, [], [F.to_date("started_at"), F.hour("started_at")], [F.col("started_at"), F.col("review_id")], "nth").withColumn("run_id", F.col("nth") + F.lit(last).cast("long"))
    rows = written(rows.drop("nth"))
    runs = rows.select("run_id", "review_id", "paper_id", "model_id", "status", F.greatest(F.size("claims"), F.lit(0)).cast("long").alias("claims_count"), "started_at")
    claims = rows.select("run_id", "review_id", "paper_id", F.explode("claims").alias("c")).select("c.id", "review_id", "paper_id", "run_id", "c.claim_index", "c.claim_text", "c.confidence")
    return store.put({"runs": runs, "claims": claims}, source, number)
