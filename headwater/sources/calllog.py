"""The host-call log: one JSON object a line, appended while a run goes on, and what can be read off it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import error_signature

SCHEMA = "ts string, kind string, ms double, tag string, ok boolean, text string, error string"


class CallLog:
    """Appends a line for each host call: its text to 400 characters, the first line of its error to 300."""

    def __init__(self, path: str | Path, clock: Callable[[], float] = time.time):
        self.path, self.clock = Path(path), clock
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def record(self, kind: str, tag: str, text: str, ms: float, error: str | None = None) -> dict:
        now = self.clock()
        row = {"ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.localtime(now)) + f".{int(now * 1000) % 1000:03d}", "kind": kind, "ms": round(ms, 1), "tag": tag, "ok": error is None, "text": text[:400]}
        if error is not None:
            row["error"] = error.splitlines()[0][:300] if error else ""
        with self.path.open("a", encoding="utf-8") as out:
            out.write(json.dumps(row) + "\n")
        return row


class LoggedSession:
    """A session whose calls are all logged; errors are logged and raised again."""

    def __init__(self, session, log: CallLog):
        self.session, self.log = session, log

    def _call(self, kind: str, text: str, tag: str, fn: Callable):
        began = time.perf_counter()
        error = None
        try:
            return fn()
        except Exception as failure:
            error = str(failure)
            raise
        finally:
            self.log.record(kind, tag, text, (time.perf_counter() - began) * 1000, error)

    def query(self, sql: str, params: tuple = (), tag: str = ""):
        return self._call("sql", sql, tag, lambda: self.session.query(sql, params, tag=tag))

    def pull(self, spark: SparkSession, sql: str, tag: str = "") -> DataFrame:
        """Logged when the frame is made; what executors read of it later is not timed."""
        return self._call("sql", sql, tag, lambda: self.session.pull(spark, sql, tag=tag))

    def run_command(self, command: str, tag: str = ""):
        return self._call("command", command, tag, lambda: self.session.run_command(command, tag=tag))

    def close(self) -> None:
        self.session.close()


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(list(paths))


def bottlenecks(log: DataFrame) -> DataFrame:
    """(tag, n, total_ms, mean_ms, n_failed) for each tag."""
    return log.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.sum("ms"), 1).alias("total_ms"), F.round(F.avg("ms"), 2).alias("mean_ms"), F.count_if(~F.col("ok")).alias("n_failed"))


def slowest(log: DataFrame, limit: int = 5) -> DataFrame:
    return log.orderBy(F.desc("ms"), "ts", "text").limit(limit)


def error_counts(log: DataFrame) -> DataFrame:
    """(signature, n) of the failed calls."""
    return log.where("error IS NOT NULL").groupBy(error_signature(F.col("error")).alias("signature")).agg(F.count("*").alias("n"))


def signature_samples(messages: DataFrame, samples: int = 3, limit: int | None = None) -> DataFrame:
    """(signature, n, samples): messages (id, message) by signature, the first few of each, most frequent first."""
    from ..functions.text import parse_error_signature

    first = F.array_sort(F.collect_list(F.struct("id", "message")))
    # the smallest few by id, kept small while they are gathered
    keyed = messages.withColumn("signature", parse_error_signature(F.col("message")))
    from pyspark.sql import Window as W

    ranked = keyed.withColumn("_n", F.row_number().over(W.partitionBy("signature").orderBy("id"))).where(F.col("_n") <= samples)
    shown = ranked.groupBy("signature").agg(F.array_join(F.transform(first, lambda x: x["id"].cast("string")), ",").alias("samples"))
    out = keyed.groupBy("signature").agg(F.count("*").alias("n")).join(shown, "signature").orderBy(F.desc("n"), "signature")
    return out.limit(limit) if limit else out
