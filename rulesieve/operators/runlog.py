"""Run log, sweep plan, costs and the step cache."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("corpus", "condition", "model", "seed", "temperature", "variant")
LOG = "corpus string, condition string, model string, seed long, temperature double, variant string, ok boolean, attempts long, raw_response string, failure_reason string, input_tokens long, output_tokens long, cost_usd double"
# Fixed values.
ATTEMPTS, BACKOFF = 3, 2.0
NOT_RETRIED = ("NotFoundError", "AuthenticationError", "PermissionDeniedError", "UnprocessableEntityError", "InvalidRequestError", "PermissionError")


def run_key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in (columns or KEY)])


def plan(corpora: DataFrame, conditions: DataFrame, models: DataFrame, seeds: DataFrame) -> DataFrame:
    """All runs: a product of four small dimension tables."""
    out = corpora
    for d in (conditions, models, seeds):
        out = out.crossJoin(F.broadcast(d))
    return out


def pending(planned: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Planned runs that have no successful record."""
    return planned.join(log.filter("ok").select(*key), key, "left_anti")


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("model").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("spend"),
    )


def ok_by_cell(log: DataFrame) -> DataFrame:
    return log.groupBy("corpus", "model").agg(F.count_if("ok").alias("n_ok"), F.count(F.lit(1)).alias("n"))


def with_cost(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost`` from dollars per million tokens; unknown model or tokens: null."""
    cost = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6
    return log.join(F.broadcast(prices), "model", "left").withColumn("cost", cost).drop("price_in", "price_out")


def without_mocks(log: DataFrame, mocks: tuple[str, ...] = ("mock",)) -> DataFrame:
    return log.filter(~F.col("model").isin(*mocks))


def purge_failures(log: DataFrame, reason: str, path: str) -> dict[str, str]:
    """Write kept, archived and audit tables under a new folder; a reason is required."""
    if not reason.strip():
        raise ValueError("a purge needs a reason")
    parts = {"kept": log.filter("ok"), "archived": log.filter("NOT ok").withColumn("purge_reason", F.lit(reason))}
    parts["audit"] = log.agg(F.count_if(~F.col("ok")).alias("n_purged"), F.count_if("ok").alias("n_kept")).withColumn("reason", F.lit(reason))
    for name, d in parts.items():
        d.write.parquet(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in parts}


def mock_response(key: str) -> str:
    """A rule set that only depends on the run's key."""
    draw = int(hashlib.sha256(key.encode()).hexdigest(), 16)
    rules = [{"rule_id": f"r{i}", "column": f"c{draw >> 8 * i & 3}", "dimension": "validity", "predicate_type": "not_null", "parameters": {}, "severity": "warn"} for i in range(1 + draw % 3)]
    return json.dumps({"rules": rules})


def attempted(call: Callable[[str], str], key: str, attempts: int, backoff: float) -> tuple[str | None, int, str | None]:
    """Answer, attempts and the last failure; waits grow by two, and faults of configuration end at once."""
    why = None
    for attempt in range(1, attempts + 1):
        try:
            if not ((text := call(key)) or "").strip():
                raise ValueError("empty response")
            return text, attempt, None
        except Exception as e:  # any failure is data
            why = f"{type(e).__name__}: {e}"
            if type(e).__name__ in NOT_RETRIED:
                break
            if attempt < attempts:
                time.sleep(backoff * 2 ** (attempt - 1))
    return None, attempt, why


def execute(runs: DataFrame, call: Callable[[str], str] = mock_response, attempts: int = ATTEMPTS, backoff: float = BACKOFF) -> DataFrame:
    """Run ``call`` on each run's key on the executors; failures become records, never other seeds."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                key = "|".join(str(r[k]) for k in KEY)
                text, tried, why = attempted(call, key, attempts, backoff)
                rows.append({**{k: r[k] for k in KEY}, "ok": text is not None, "attempts": tried, "raw_response": text, "failure_reason": why,
                             "input_tokens": len(key) // 4, "output_tokens": len(text or "") // 4, "cost_usd": None})
            yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in LOG.split(", ")])

    return runs.mapInPandas(batches, LOG)


class StepCache:
    """Tables built once under names, with a record beside them: code version, schema, rows, digest of the content.

    A table is built again if it is absent or incomplete, if another code version
    built it, or on demand.
    """

    def __init__(self, spark: SparkSession, root: str, version: str = "1"):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def _path(self, name: str) -> str:
        if not name or set(name) & set("/\\"):
            raise ValueError(f"{name!r} is no step name")
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        """Whether the step is complete: its writer's mark and its record are there."""
        where, fs = self._fs(f"{self._path(name)}.meta/_SUCCESS")
        return fs.exists(where)

    def record(self, name: str) -> dict | None:
        """``name, version, schema, rows, digest, written_at`` of a complete step."""
        return self.spark.read.json(f"{self._path(name)}.meta").first().asDict() if self.has(name) else None

    def digest(self, name: str) -> tuple[int, str]:
        """Rows of the stored table and a digest of them that no order changes."""
        df = self.spark.read.parquet(self._path(name))
        bits = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")
        return tuple(df.agg(F.count(F.lit(1)), F.coalesce(bits, F.lit("0"))).first())

    def intact(self, name: str) -> bool:
        """Whether the stored rows are those that were written."""
        known = self.record(name)
        return known is not None and (known["rows"], known["digest"]) == self.digest(name)

    def get(self, name: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        path = self._path(name)
        if force or (known := self.record(name)) is None or known["version"] != self.version:
            self.drop(name)
            build().write.mode("overwrite").parquet(path)
            made = self.spark.read.parquet(path)
            fields = "name string, version string, schema string, rows long, digest string"
            self.spark.createDataFrame([(name, self.version, made.schema.json(), *self.digest(name))], fields).withColumn(
                "written_at", F.current_timestamp()
            ).coalesce(1).write.mode("overwrite").json(f"{path}.meta")
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        for path in (f"{self._path(name)}.meta", self._path(name)):
            where, fs = self._fs(path)
            fs.delete(where, True)

    def status(self, names: list[str]) -> dict[str, bool]:
        return {n: self.has(n) for n in names}

    def clear(self, names: list[str], confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("clearing needs confirm=True")
        for n in names:
            self.drop(n)
