"""Messages in files, addressed by partition and offset (S3, T4, K1, K8).

A Spark data source, ``cabline_log``, for batch and stream, reading and
writing. Where no message broker runs, it gives a stream what the file source
lacks: starting offsets (earliest, latest or given ones), messages a trigger,
a stated answer to lost data, and a stream writer that publishes an epoch once.

Spark's tasks write and read the messages, in Arrow batches; a log is

    segments/<name>.parquet   messages of one partition, written by one task
    commits/<number>.json     the segments published together, the first and next
                              offset of each partition, each writer's last epoch

A commit file appears by one rename, so an epoch is there whole or not at
all. An epoch that its writer has committed before is thrown away, as are the
segments of an aborted one; a failed task's are in no commit and never read.
The driver handles names and offsets, never messages. Planning a micro-batch
opens the commits since its start. One writer at a time: a second one that
commits at the same moment fails. A hot key is one partition but as many
segments as tasks wrote it, and each is read by a task of its own.

Paths: local ones (on storage that all executors share) or URIs that
``pyarrow.fs`` knows.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

FORMAT = "cabline_log"
PARTITIONS = 8
MESSAGE = pa.schema([("key", pa.string()), ("value", pa.string())])
ROW = "key string, value string, partition int, offset long"
EARLIEST, LATEST = -2, -1  # as single offsets, like those of the broker's source
HELD_BYTES = 32 << 20  # of messages that a writing task keeps in memory, a row group of each partition
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


class DataLost(Exception):
    """Messages between the start and the end of a read are gone."""


class Log:
    """Names and offsets of one log."""

    def __init__(self, path: str) -> None:
        # file:/x and file:///x are local paths
        path = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))

    def _json(self, path: str) -> dict:
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != pafs.FileType.NotFound

    def put(self, path: str, content: dict) -> None:
        """``content`` at ``path``, whole or not at all."""
        self.fs.create_dir(path.rsplit("/", 1)[0])
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(temporary) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(temporary, path)

    def numbers(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def commit_at(self, number: int) -> dict:
        return self._json(f"{self.root}/commits/{number:020d}.json")

    def newest(self) -> dict:
        numbers = self.numbers()
        return self.commit_at(numbers[-1]) if numbers else {"number": -1, "starts": [], "ends": [], "writers": {}, "segments": []}

    def publish(self, segments: list[tuple[int, int, str]], writer: str | None, epoch: int | None, partitions: int) -> bool:
        """Commit ``(partition, messages, name)`` segments behind what is there; False if the epoch was there before."""
        last = self.newest()
        if writer is not None and epoch is not None and last["writers"].get(writer, -1) >= epoch:
            self.remove(name for _, _, name in segments)
            return False
        n = max([partitions, len(last["ends"])] + [p + 1 for p, _, _ in segments])
        ends = last["ends"] + [0] * (n - len(last["ends"]))
        rows = []
        for p, count, name in sorted(segments):
            rows.append([p, ends[p], ends[p] + count, name])
            ends[p] += count
        writers = {**last["writers"], **({writer: epoch} if writer is not None and epoch is not None else {})}
        self._next(last, starts=last["starts"] + [0] * (n - len(last["starts"])), ends=ends, writers=writers, segments=rows)
        return True

    def _next(self, last: dict, **content) -> None:
        number = last["number"] + 1
        path = f"{self.root}/commits/{number:020d}.json"
        if self.exists(path):
            raise RuntimeError(f"another writer has just committed to {self.root}")
        self.put(path, {"number": number, **content})

    def remove(self, names) -> None:
        for name in names:
            path = f"{self.root}/segments/{name}"
            if self.exists(path):
                self.fs.delete_file(path)

    def trim(self, before: dict[int, int]) -> None:
        """Give up all messages below the given offsets. Segments that lie below as a whole are removed."""
        last = self.newest()
        starts = [min(max(s, before.get(p, s)), e) for p, (s, e) in enumerate(zip(last["starts"], last["ends"]))]
        self._next(last, starts=starts, ends=last["ends"], writers=last["writers"], segments=[])
        for number in self.numbers():
            self.remove(name for p, _, after, name in self.commit_at(number)["segments"] if after <= starts[p])

    def slices(self, start: dict, end: dict, fail: bool) -> list[Slice]:
        """The parts of segments from ``start`` to ``end``. What was trimmed or is missing fails the read or is left out."""
        numbers = self.numbers()
        first = self.newest()["starts"]
        low = {int(p): int(start.get(p, 0)) for p in end}
        if fail and any(first[p] > low[p] for p in low if int(end[str(p)]) > low[p]):
            raise DataLost(f"messages of {self.root} below {first} are gone, the read starts at {low}")
        low = {p: max(o, first[p]) for p, o in low.items()}
        out = []
        for number in reversed(numbers):
            commit = self.commit_at(number)
            if all(e <= low.get(p, e) for p, e in enumerate(commit["ends"])):
                break
            for p, a, b, name in commit["segments"]:
                x, y = max(a, low.get(p, b)), min(b, int(end.get(str(p), 0)))
                if x < y:
                    out.append(Slice(f"{self.root}/segments/{name}", p, a, x, y, fail))
        return sorted(out, key=lambda s: (s.partition, s.first))


@dataclass
class Slice(InputPartition):
    """Messages ``first`` to ``after`` (excluded) of a segment that begins at offset ``base``."""

    file: str
    partition: int
    base: int
    first: int
    after: int
    fail: bool


def read_slice(fs, s: Slice | None):
    """The messages of a slice as Arrow batches; of none (a log without messages), nothing."""
    if s is None:
        return
    try:
        f = fs.open_input_file(s.file)
    except FileNotFoundError as e:
        if s.fail:
            raise DataLost(f"{s.file}: offsets {s.first} to {s.after} of partition {s.partition} are gone") from e
        return
    with f:
        at = s.base
        for batch in pq.ParquetFile(f).iter_batches(batch_size=8192):
            a, b = max(s.first - at, 0), min(s.after - at, batch.num_rows)
            if a < b:
                part = batch.slice(a, b - a)
                offsets = pa.array(range(at + a, at + b), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s.partition] * (b - a), pa.int32()), offsets], names=["key", "value", "partition", "offset"])
            at += batch.num_rows


class _Options:
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.starting = options.get("startingOffsets", "latest")
        self.fail = str(options.get("failOnDataLoss", "true")).lower() == "true"
        self.limit = int(options.get("maxOffsetsPerTrigger", 0))
        self.position = options.get("position")
        self.partitions = int(options.get("partitions", PARTITIONS))
        self.writer = options.get("writer")
        self.epoch = int(options["epoch"]) if "epoch" in options else None


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, o: _Options) -> None:
        if not o.position:
            raise ValueError("option position: a folder that keeps where this query began and is")
        self.o, self.at = o, None

    def _files(self) -> tuple[Log, str]:
        return Log(self.o.path), Log(self.o.position).root

    def initialOffset(self) -> dict:
        log, position = self._files()
        kept = f"{position}/initial.json"
        if not log.exists(kept):  # a query that has read nothing yet still begins where it first did
            newest = log.newest()
            named = {"earliest": newest["starts"], "latest": newest["ends"]}
            if self.o.starting in named:
                start = {str(p): x for p, x in enumerate(named[self.o.starting])}
            else:
                given = {int(p): int(x) for p, x in json.loads(self.o.starting).items()}
                by = {EARLIEST: newest["starts"], LATEST: newest["ends"]}
                start = {str(p): by[given.get(p, LATEST)][p] if given.get(p, LATEST) < 0 else given[p] for p in range(len(newest["ends"]))}
            log.put(kept, start)
        return log._json(kept)

    def latestOffset(self) -> dict:
        log, position = self._files()
        ends = {str(p): x for p, x in enumerate(log.newest()["ends"])}
        if not self.o.limit:
            return ends
        if self.at is None:
            kept = f"{position}/planned.json"
            self.at = log._json(kept) if log.exists(kept) else self.initialOffset()
        left, out = self.o.limit, {}
        waiting = sorted(ends, key=lambda p: ends[p] - self.at.get(p, 0))
        for i, p in enumerate(waiting):  # an even share each; what a short partition leaves goes to the others
            take = min(ends[p] - self.at.get(p, 0), -(-left // (len(waiting) - i)))
            out[p], left = self.at.get(p, 0) + max(take, 0), left - max(take, 0)
        return out

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        log, position = self._files()
        slices = log.slices(start, end, self.o.fail)
        if self.o.limit:
            log.put(f"{position}/planned.json", end)
            self.at = end
        return slices

    def read(self, partition: Slice):
        return read_slice(Log(self.o.path).fs, partition)


class LogReader(DataSourceReader):
    """All messages that are there."""

    def __init__(self, o: _Options) -> None:
        self.o = o

    def partitions(self) -> list[Slice]:
        newest = Log(self.o.path).newest()
        of = lambda offsets: {str(p): x for p, x in enumerate(offsets)}
        return Log(self.o.path).slices(of(newest["starts"]), of(newest["ends"]), self.o.fail)

    def read(self, partition: Slice):
        return read_slice(Log(self.o.path).fs, partition)


@dataclass
class Staged(WriterCommitMessage):
    segments: list


def stage(o: _Options, batches) -> Staged:
    """In a task: each partition's messages into a segment of their own, published by nobody yet.
    They are held until they fill row groups, since the few of one batch pack badly."""
    log, writers, counts, held, size = Log(o.path), {}, {}, {}, 0
    log.fs.create_dir(f"{log.root}/segments")

    def flush() -> None:
        for p, rows in held.items():
            writers[p][1].write_table(pa.Table.from_batches(rows))
        held.clear()

    try:
        for batch in batches:
            part = batch.column(batch.schema.get_field_index("partition"))
            for p in pc.unique(part).to_pylist():
                rows = batch.filter(pc.equal(part, p)).select(["key", "value"]).cast(MESSAGE)
                if p not in writers:
                    name = f"{uuid.uuid4().hex}.parquet"
                    writers[p] = name, pq.ParquetWriter(f"{log.root}/segments/{name}", MESSAGE, filesystem=log.fs, compression="zstd", compression_level=1, use_dictionary=["key"])
                held.setdefault(p, []).append(rows)
                counts[p], size = counts.get(p, 0) + rows.num_rows, size + rows.nbytes
            if size >= HELD_BYTES:
                flush()
                size = 0
        flush()
    finally:
        for _, w in writers.values():
            w.close()
    return Staged([(p, counts[p], name) for p, (name, _) in writers.items()])


def _all(messages) -> list:
    return [s for m in messages if m is not None for s in m.segments]


class LogWriter(DataSourceArrowWriter):
    def __init__(self, o: _Options) -> None:
        self.o = o

    def write(self, iterator):
        return stage(self.o, iterator)

    def commit(self, messages) -> None:
        Log(self.o.path).publish(_all(messages), self.o.writer, self.o.epoch, self.o.partitions)

    def abort(self, messages) -> None:
        Log(self.o.path).remove(name for _, _, name in _all(messages))


class LogStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, o: _Options) -> None:
        if not o.writer:
            raise ValueError("option writer: a name that stays with the query's checkpoint")
        self.o = o

    def write(self, iterator):
        return stage(self.o, iterator)

    def commit(self, messages, batchId: int) -> None:
        Log(self.o.path).publish(_all(messages), self.o.writer, batchId, self.o.partitions)

    def abort(self, messages, batchId: int) -> None:
        Log(self.o.path).remove(name for _, _, name in _all(messages))


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema):
        return LogReader(_Options(self.options))

    def streamReader(self, schema):
        return LogStreamReader(_Options(self.options))

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("a log is appended to")
        return LogWriter(_Options(self.options))

    def streamWriter(self, schema, overwrite: bool):
        return LogStreamWriter(_Options(self.options))


def register_log(spark: SparkSession) -> None:
    """Make the format known to the session, and the library to its Python workers."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [env.get("PYTHONPATH", "")])])
    spark.dataSource.register(MessageLog)


def log_rows(msgs: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Messages with their partition: one key, one partition, as with the broker. No shuffle."""
    p = F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(partitions)).cast("int")
    return msgs.select(F.col("key").cast("string"), F.col("value").cast("string"), p.alias("partition"))


def append_messages(msgs: DataFrame, path: str, writer: str | None = None, epoch: int | None = None, partitions: int = PARTITIONS) -> None:
    """K1 as one commit. With ``writer`` and ``epoch`` a repeated append changes nothing."""
    register_log(msgs.sparkSession)
    w = log_rows(msgs, partitions).write.format(FORMAT).mode("append").option("path", path).option("partitions", partitions)
    if writer is not None and epoch is not None:
        w = w.option("writer", writer).option("epoch", epoch)
    w.save()


def read_messages(spark: SparkSession, path: str, fail_on_data_loss: bool = True) -> DataFrame:
    register_log(spark)
    return spark.read.format(FORMAT).option("failOnDataLoss", str(fail_on_data_loss)).load(path)
