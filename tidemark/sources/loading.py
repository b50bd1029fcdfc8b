"""Full refresh of a set of tables with an audit of the run, and what a contract says before any of it.

Tables are Parquet folders under one root. A refresh writes children and parents to a new folder each,
so that readers of the last approved run are not disturbed; the audit row tells which run to read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import checks

AUDIT = "run_id string, started_at timestamp, ended_at timestamp, status string, tables array<struct<name:string,rows:bigint>>, error string"


def contract_checks(df: DataFrame, rows: int, content_hash: str | None = None, observed_hash: str | None = None) -> DataFrame:
    """Control records: the number of rows and, where given, the content hash are those of the contract."""
    found = [("row_count", rows, df.count(), True)]
    if content_hash is not None:
        found.append(("content_hash", content_hash, observed_hash, True))
    return checks.records(df.sparkSession, found)


def excluded_columns(spark: SparkSession, columns: Sequence[str], contract: Sequence[str]) -> DataFrame:
    """The columns that discovery leaves out, each with its role and the reason. No job runs."""
    why = {"dq": "ground truth of the data set", "technical": "made by an earlier step", "unexpected": "not in the contract"}
    rows = [(c, r, why[r]) for c, r in checks.roles(columns, contract).items() if r in why]
    return spark.createDataFrame(rows, "column string, role string, reason string")


def audit_row(spark: SparkSession, run_id: str, started, ended, status: str, tables: Sequence[tuple[str, int]], error: str | None) -> DataFrame:
    return spark.createDataFrame([(run_id, started, ended, status, list(tables), error)], AUDIT)


@dataclass(frozen=True)
class Control:
    """A figure of a table that is observed while the table is written.

    measure: an aggregate without DISTINCT. expected: a number, a function of all figures observed in the run,
    by (table, control), or None for a figure that only others are held against.
    """

    name: str
    measure: Column
    expected: float | Callable[[dict[tuple[str, str], float]], float] | None
    critical: bool = True
    tolerance: float = 0.01


CONTROLS = "run_id string, table_name string, control string, observed double, expected double, critical boolean, status string"


def judged(controls: dict[str, Sequence[Control]], seen: dict[tuple[str, str], float], run_id: str) -> list[tuple]:
    """A record per control, in the order of the tables."""
    out = []
    for table, listed in controls.items():
        for c in listed:
            observed = float(seen[table, c.name])
            expected = c.expected(seen) if callable(c.expected) else c.expected
            fine = expected is None or abs(observed - float(expected)) <= c.tolerance
            out.append((run_id, table, c.name, observed, None if expected is None else float(expected), c.critical, "aprovado" if fine else "reprovado"))
    return out


def full_refresh(
    spark: SparkSession, tables: dict[str, Callable[[], DataFrame]], root: str, run_id: str,
    check: Callable[[str, DataFrame], bool] | None = None, controls: dict[str, Sequence[Control]] | None = None,
) -> DataFrame:
    """Write every table (parents first) to <root>/<run_id>/<name>, count and check it, and append the run to
    <root>/audit: RUNNING at the start, then APPROVED or FAILED with the error, which is raised.

    Rows and controls are observed by the write itself (no second pass over a table); when all tables are
    written, the controls are judged and appended to <root>/controls. A critical one that fails raises, so the
    run is never approved and readers of the last approved run see none of it.
    """
    now = lambda: spark.range(1).select(F.current_timestamp()).first()[0]
    started, loaded, seen = now(), [], {}
    log = lambda status, ended, error=None: audit_row(spark, run_id, started, ended, status, loaded, error).write.mode("append").parquet(f"{root}/audit")
    log("RUNNING", None)
    try:
        for name, make in tables.items():
            path = f"{root}/{run_id}/{name}"
            watch, listed = Observation(f"{run_id}-{name}"), (controls or {}).get(name, ())
            make().observe(watch, F.count("*").alias("__rows"), *[c.measure.alias(c.name) for c in listed]).write.parquet(path)
            loaded.append((name, watch.get["__rows"]))
            seen |= {(name, c.name): watch.get[c.name] for c in listed}
            if check is not None and not check(name, spark.read.parquet(path)):
                raise ValueError(f"the check of {name} rejects the run")
        if controls:
            told = judged(controls, seen, run_id)
            spark.createDataFrame(told, CONTROLS).write.mode("append").parquet(f"{root}/controls")
            bad = [f"{t}.{c}: {o} for {e}" for _, t, c, o, e, critical, status in told if critical and status == "reprovado"]
            if bad:
                raise ValueError("critical controls fail: " + "; ".join(bad))
    except Exception as e:
        log("FAILED", now(), str(e)[:500])
        raise
    log("APPROVED", now())
    return spark.read.schema(AUDIT).parquet(f"{root}/audit").filter(F.col("run_id") == run_id)


def last_approved(audit: DataFrame) -> DataFrame:
    """The tables of the approved run that ended last: run_id, ended_at, name, rows."""
    last = audit.filter("status = 'APPROVED'").agg(F.max_by(F.struct("run_id", "ended_at", "tables"), F.struct("ended_at", "run_id")).alias("r"))
    return last.select("r.run_id", "r.ended_at", F.explode("r.tables").alias("t")).select("run_id", "ended_at", "t.*")


def report_bundle(spark: SparkSession, frames: dict[str, DataFrame], root: str, stage: str) -> DataFrame:
    """Named result tables of a stage written under <root>/<stage>, and one summary row per table, in order."""
    rows = []
    for i, (name, df) in enumerate(frames.items()):
        df.write.mode("overwrite").parquet(f"{root}/{stage}/{name}")
        rows.append((stage, i + 1, name, spark.read.parquet(f"{root}/{stage}/{name}").count(), len(df.columns)))
    summary = spark.createDataFrame(rows, "stage string, place int, name string, rows bigint, columns int")
    summary.write.mode("overwrite").parquet(f"{root}/{stage}/summary")
    return summary
