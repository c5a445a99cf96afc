"""Writing documents in batches to a service that may refuse some: a data source whose tasks send groups, fall back to single documents
where a group is refused, and report what failed when they commit."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: A task that has so many refused documents ends the write: the service is down, or the documents aren't for it.
MOST_FAILED = 1000


@dataclass
class Sent(WriterCommitMessage):
    """What one task has done."""

    sent: int = 0
    groups: int = 0
    failed: list = field(default_factory=list)


def send_group(send: Callable, name: str, rows: list[dict], key: str, done: Sent) -> None:
    """Sends a group, or where that is refused each of its documents by itself."""
    done.groups += 1
    try:
        send(name, rows)
        done.sent += len(rows)
        return
    except Exception:  # whatever the service says, the documents are tried one by one
        pass
    for k, row in enumerate(rows):
        try:
            send(f"{name}.{k}", [row])
            done.sent += 1
        except Exception as e:
            done.failed.append({"id": row[key], "error": str(e)[:200]})
            if len(done.failed) > MOST_FAILED:
                raise RuntimeError(f"more than {MOST_FAILED} documents were refused, the last one with: {e}") from e


def source_of(send: Callable, key: str, size: int, name: str) -> type[DataSource]:
    """A data source of this name that sends rows by a function; it travels with the job."""

    class Writer(DataSourceWriter):
        def __init__(self, options):
            self.run, self.report = options["run"], options["report"]

        def write(self, iterator):
            from pyspark import TaskContext

            part, done, group = TaskContext.get().partitionId(), Sent(), []
            for row in iterator:
                group.append(row.asDict())
                if len(group) == size:
                    send_group(send, f"{self.run}-{part:05d}-{done.groups:07d}", group, key, done)
                    group = []
            if group:
                send_group(send, f"{self.run}-{part:05d}-{done.groups:07d}", group, key, done)
            return done

        def commit(self, messages):
            told = [m for m in messages if m]
            with open(self.report, "w") as f:
                json.dump({"sent": sum(m.sent for m in told), "groups": sum(m.groups for m in told), "failed": [x for m in told for x in m.failed]}, f)

    class Batched(DataSource):
        @classmethod
        def name(cls):
            return name

        def writer(self, schema, overwrite):
            return Writer(self.options)

    return Batched


def write_batched(rows: DataFrame, send: Callable[[str, list[dict]], None], key: str, size: int = 50, run: str | None = None) -> dict:
    """Sends all rows in groups of size and returns how many were sent, in how many groups, and which were refused ([{id, error}]).

    send takes a group's name and its rows, and raises where the service refuses them. Names are made of the run, the partition and
    the group's number, and rows are dealt by key and in its order, so a task that is tried again sends the same groups by the same
    names: a service that keeps the last of a name, or of a document's id, has nothing twice. The report is written and read on the driver.
    """
    spark, name = rows.sparkSession, f"batched_{uuid.uuid4().hex[:12]}"
    spark.dataSource.register(source_of(send, key, size, name))
    handle, report = tempfile.mkstemp(suffix=".json")
    os.close(handle)
    try:
        dealt = rows.repartition(key).sortWithinPartitions(key)
        dealt.write.format(name).mode("append").option("run", run or uuid.uuid4().hex).option("report", report).save()
        with open(report) as f:
            return json.load(f)
    finally:
        os.unlink(report)
