"""Leases on jobs, from a ledger of commands: claims, renewals, completions, cancellations, suspensions.

A ledger has one row a command: ``job``, ``at`` (timestamp), ``seq`` (order within one time), ``action``, and what the action names:
``owner``, ``fence`` (null: not checked), ``desired`` state and ``delay_s`` of a completion. ``Job`` is all that is kept of a job; the same
``Job.apply`` decides a finished ledger (``decide``) and one that comes in as a stream (``lontarix.streaming.leases``).

- CLAIM gives a lease to a job that is queued, waits for a retry whose time has come and has attempts left, or runs under a lease that has
  run out (its last moment still counts). It raises the fence and counts an attempt. A refused claim changes nothing.
- RENEW and COMPLETE are for the holder alone: its owner, its fence, before the lease runs out; a renewal not once a cancellation is asked for.
- CANCEL ends a job that nobody holds; a running one ends when its holder completes or its lease runs out.
- SUSPEND takes a waiting job out of the queue, RESUME puts it back with all its attempts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a completion may ask for, and states that no command leaves.
DESIRED, ENDED = ("SUCCEEDED", "FAILED", "RETRY_WAIT"), ("SUCCEEDED", "FAILED", "CANCELLED")
COMMAND = ("at_us", "seq", "action", "owner", "fence", "desired", "delay_s")
OUTCOME = "seq long, outcome string, state string, fence long, expires_us long"


@dataclass
class Job:
    state: str = "QUEUED"
    owner: str | None = None
    fence: int = 0
    expires_us: int | None = None
    attempts: int = 0
    next_us: int | None = None
    cancel: bool = False
    told: bool = False

    def _end(self, state: str) -> None:
        self.state, self.owner, self.expires_us = state, None, None

    def _ran_out(self, now: int) -> bool:
        return self.state == "RUNNING" and self.expires_us < now

    def settle(self, now: int) -> list[tuple]:
        """What has happened by itself before ``now``: a lease that ran out is told once, an abandoned cancellation is carried out."""
        out = []
        if self._ran_out(now) and not self.told:
            self.told = True
            out.append((None, "EXPIRED", self.state, self.fence, self.expires_us))
        if self.cancel and (self.state in ("QUEUED", "RETRY_WAIT", "SUSPENDED") or self._ran_out(now)):
            self._end("CANCELLED")
        return out

    def apply(self, command: tuple, lease_us: int, max_attempts: int) -> list[tuple]:
        """Outcomes of one command, those of what happened before it included."""
        now, seq, action, owner, fence, desired, delay_s = command
        out = self.settle(now)
        held = self.state == "RUNNING" and owner == self.owner and fence in (None, self.fence) and self.expires_us >= now
        outcome = "REFUSED"
        if action == "CLAIM":
            due = self.state == "RETRY_WAIT" and self.next_us <= now and self.attempts < max_attempts
            if not self.cancel and (self.state == "QUEUED" or due or self._ran_out(now)):
                self.state, self.owner, self.expires_us, self.told = "RUNNING", owner, now + lease_us, False
                self.fence, self.attempts, outcome = self.fence + 1, self.attempts + 1, "CLAIMED"
        elif action == "RENEW":
            outcome = "STALE"
            if held and not self.cancel:
                self.expires_us, outcome = now + lease_us, "RENEWED"
        elif action == "COMPLETE":
            outcome = "STALE"
            if held and desired in DESIRED:
                spent = desired == "RETRY_WAIT" and self.attempts >= max_attempts
                self._end("CANCELLED" if self.cancel else "FAILED" if spent else desired)
                self.next_us, outcome = now + 1_000_000 * (delay_s or 0), "COMPLETED"
        elif action == "CANCEL" and self.state not in ENDED:
            self.cancel, outcome = True, "CANCELLING"
            self.settle(now)
        elif action == "SUSPEND" and self.state in ("QUEUED", "RETRY_WAIT"):
            self.state, outcome = "SUSPENDED", "SUSPENDED"
        elif action == "RESUME" and self.state == "SUSPENDED":
            self.state, self.attempts, outcome = "QUEUED", 0, "RESUMED"
        out.append((seq, outcome, self.state, self.fence, self.expires_us))
        return out

    def row(self) -> tuple:
        return astuple(self)


def commands(ledger: DataFrame) -> DataFrame:
    """(job, at_us, seq, action, owner, fence, desired, delay_s); what a ledger has no column for is null."""
    has = set(ledger.columns)
    optional = [(F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in (("owner", "string"), ("fence", "long"), ("desired", "string"), ("delay_s", "long"))]
    return ledger.select("job", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), F.col("seq").cast("long"), "action", *optional)


def decide(ledger: DataFrame, lease_seconds: int, max_attempts: int, until_us: int | None = None) -> DataFrame:
    """(job, seq, outcome, state, fence, expires_us) of every command in order of (at, seq), and a row without seq for each lease that ran out.

    With ``until_us`` only commands before that time are decided, and leases that run out before it are told, as a stream does whose
    watermark is there. A job's commands are folded in order by one task that holds nothing of them but the ``Job``.
    """
    kind = ledger.schema["job"].dataType.simpleString()
    rows = commands(ledger)
    if until_us is not None:
        rows = rows.where(F.col("at_us") < until_us)
    rows = rows.repartition("job").sortWithinPartitions("job", "at_us", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        job, name, job_type = Job(), none, pa.null()

        def told(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = (job_type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["job", "seq", "outcome", "state", "fence", "expires_us"])

        for batch in batches:
            job_type, out = batch.schema.field(0).type, []
            for owner, *command in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name is none or owner != name:
                    if name is not none and until_us is not None:
                        out += [(name, *o) for o in job.settle(until_us)]
                    job, name = Job(), owner
                out += [(owner, *o) for o in job.apply(tuple(command), 1_000_000 * lease_seconds, max_attempts)]
            if out:
                yield told(out)
        if name is not none and until_us is not None and (out := [(name, *o) for o in job.settle(until_us)]):
            yield told(out)

    return rows.mapInArrow(run, f"job {kind}, {OUTCOME}")
