"""Leases decided as their ledger comes in: keyed state with event-time timeouts.

A job's commands wait in state until the watermark has passed them, so they are decided in order of their time whatever order they
come in; a timeout at the next waiting command or lease's end wakes them. Nothing is kept of what is decided but the ``Job``.

A key's state costs far more to fetch and put back than a command does to decide, so jobs are dealt by their hash over ``SHARDS`` keys, each
with the state of its jobs: what state costs goes by the keys, the rest by the commands. A task holds one key's commands at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.leases import COMMAND, OUTCOME, Job, commands

#: Keys of the state. A key has 33 jobs where there are 540,000.
SHARDS = 16_384
#: Both are JSON: a list of each job's name and fields, and a list of commands with their job's name first, all as text.
_STATE = "jobs string, waiting string"
_COLUMNS = ["job", *(c.split()[0] for c in OUTCOME.split(", "))]


def _command(row: list[str | None]) -> tuple:
    at_us, seq, action, owner, fence, desired, delay_s = row[1:]
    return int(at_us), seq and int(seq), action, owner, fence and int(fence), desired, delay_s and int(delay_s)


@dataclass
class Leases:
    """The jobs of a key: takes in its new commands and decides all that the watermark has passed."""

    lease_us: int
    max_attempts: int

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs, waiting = map(json.loads, state.get) if state.exists else ([], [])
        if not state.hasTimedOut:
            for new in frames:
                waiting += json.loads(f"[{','.join(new['command'])}]")
        watermark = state.getCurrentWatermarkMs()
        out, jobs, waiting, wake = self.decide({name: Job(*job) for name, *job in jobs}, waiting, 1000 * watermark)
        state.update((json.dumps([(name, *job.row()) for name, job in jobs.items()]), json.dumps(waiting)))
        if wake is not None:  # a timeout has come once the watermark is beyond its millisecond
            state.setTimeoutTimestamp(max(wake // 1000, 1))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    def decide(self, jobs: dict[str | None, Job], waiting: list[list], now: int) -> tuple[list[tuple], dict[str | None, Job], list[list], int | None]:
        """Outcomes of what lies before ``now``, the jobs after it, the commands that still wait and the time of what comes next."""
        due, left, out, wake = {}, [], [], []
        for row in waiting:
            command = _command(row)
            if command[0] < now:
                due.setdefault(row[0], []).append(command)
            else:
                left.append(row)
                wake.append(command[0])
        for name in due.keys() - jobs.keys():
            jobs[name] = Job()
        for name, job in jobs.items():
            for command in sorted(due.get(name, ()), key=lambda c: c[:2]):
                out += [(name, *o) for o in job.apply(command, self.lease_us, self.max_attempts)]
            out += [(name, *o) for o in job.settle(now)]
            if job.state == "RUNNING" and not job.told:
                wake.append(job.expires_us)
        return out, jobs, left, min(wake, default=None)


def decide(ledger: DataFrame, lease_seconds: int, max_attempts: int, delay: str) -> DataFrame:
    """The outcomes of ``operators.leases.decide``, of all commands and lease ends that the watermark, ``delay`` behind the newest command, has passed.

    State holds a job's name as text, so it has to be of a type that text gives back, such as numbers and text.
    """
    kind = ledger.schema["job"].dataType.simpleString()
    text = F.to_json(F.array(*(F.col(c).cast("string") for c in ("job", *COMMAND))))
    rows = commands(ledger).withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", delay)
    rows = rows.select(F.pmod(F.xxhash64("job"), F.lit(SHARDS)).alias("shard"), "at", text.alias("command"))
    shards = rows.groupBy("shard").applyInPandasWithState(Leases(1_000_000 * lease_seconds, max_attempts), f"job string, {OUTCOME}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return shards.withColumn("job", F.col("job").cast(kind))
