"""A streaming sink for routed events: files per target, visible batch by batch.

Tasks gather the rows of each target (database and table) and write a file when a buffer has grown to ``bytes`` or has been
open for ``seconds``; rows without a route go under an error prefix, by the kind of error.  A file counts only once the
batch's list of files names it: the list is written by the driver when all tasks are done, in one step.  Files of tasks that
failed are in no list, those of a batch that failed are deleted, and a batch that is sent again after its list was written
leaves what is there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from quern.sources.readers import ROUTE

#: Limits of a target's buffer, and where rows go that have no target; ``!{type}`` is the kind of error.
BYTES, SECONDS, ERRORS = 1 << 20, 60.0, "errors/!{type}/"
COLUMNS = "database string, table string, payload string, error string"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class RoutedWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.bytes, self.seconds, self.errors = int(options.get("bytes", BYTES)), float(options.get("seconds", SECONDS)), options.get("errors", ERRORS)

    def _at(self, name: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(f"{self.root}/{name}")

    def _flush(self, folder: str, rows: list[pa.RecordBatch]) -> str:
        name = f"{folder}{uuid.uuid4().hex}.parquet"
        fs, path = self._at(name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        pq.write_table(pa.Table.from_batches(rows).select(["payload"]), path, filesystem=fs)
        return name

    def _folders(self, batch: pa.RecordBatch) -> pa.Array:
        """Where each row goes."""
        good = pc.binary_join_element_wise("data", batch.column("database"), batch.column("table"), "", "/")
        kinds = pc.if_else(pc.is_null(batch.column("error")), good, batch.column("error"))
        return kinds

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        held: dict[tuple[str, bool], list[pa.RecordBatch]] = {}
        size: dict[tuple[str, bool], int] = {}
        since: dict[tuple[str, bool], float] = {}
        files: list[str] = []

        def flush(key: tuple[str, bool]) -> None:
            name, bad = key
            files.append(self._flush(self.errors.replace("!{type}", name) if bad else name, held.pop(key)))
            size.pop(key), since.pop(key)

        for batch in iterator:
            folders, bad = self._folders(batch), pc.is_valid(batch.column("error"))
            for wrong in (False, True):
                for name in pc.unique(folders.filter(pc.equal(bad, wrong))).to_pylist():
                    rows = batch.filter(pc.and_(pc.equal(folders, name), pc.equal(bad, wrong)))
                    key = name, wrong
                    held.setdefault(key, []).append(rows)
                    size[key] = size.get(key, 0) + rows.nbytes
                    since.setdefault(key, time.monotonic())
            now = time.monotonic()
            for key in [k for k in held if size[k] >= self.bytes or now - since[k] >= self.seconds]:
                flush(key)
        for key in list(held):
            flush(key)
        return Written(files)

    def _drop(self, files: list[str]) -> None:
        for name in files:
            fs, path = self._at(name)
            if fs.get_file_info(path).type == pafs.FileType.File:
                fs.delete_file(path)

    def commit(self, messages, batchId: int) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        fs, path = self._at(f"_batches/{batchId:010d}.json")
        if fs.get_file_info(path).type != pafs.FileType.NotFound:
            self._drop(files)  # it was committed before the driver went away
            return
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = path.rsplit("/", 1)[0] + "/." + uuid.uuid4().hex
        with fs.open_output_stream(part) as out:
            out.write("".join(json.dumps({"batch": batchId, "file": f}) + "\n" for f in files).encode())
        fs.move(part, path)

    def abort(self, messages, batchId: int) -> None:
        self._drop([f for m in messages if m is not None for f in m.files])


class RoutedSink(DataSource):
    """Format ``routed``: options ``path``, ``bytes``, ``seconds`` and ``errors``."""

    @classmethod
    def name(cls) -> str:
        return "routed"

    def schema(self) -> str:
        return COLUMNS

    def streamWriter(self, schema, overwrite: bool) -> RoutedWriter:
        return RoutedWriter(dict(self.options))


def events(bodies: DataFrame, body: str = "body", key: str = "_datalake_key") -> DataFrame:
    """(database, table, payload, error) of JSON events: the payload is the event without its route; the body as it came, where there is an error."""
    route = F.get_json_object(body, f"$.{key}")
    json_ = F.try_parse_json(body).isNotNull() & F.col(body).startswith("{")
    error = F.when(~F.coalesce(json_, F.lit(False)), "no-json").when(~F.coalesce(route.rlike(ROUTE), F.lit(False)), "no-route")
    fields = F.from_json(body, "map<string,string>")
    payload = F.when(error.isNull(), F.to_json(F.map_filter(fields, lambda k, _: k != key))).otherwise(F.col(body))
    part = lambda i: F.when(error.isNull(), F.regexp_extract(route, ROUTE, i))
    return bodies.select(part(1).alias("database"), part(2).alias("table"), payload.alias("payload"), error.alias("error"))


def start(stream: DataFrame, path: str, checkpoint: str, every: str | None = "60 seconds", **options: str):
    """Starts the sink over a stream of :func:`events`; without ``every`` it takes in all that is there and ends."""
    stream.sparkSession.dataSource.register(RoutedSink)
    writer = stream.writeStream.format("routed").option("path", path).options(**options).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def committed(spark: SparkSession, path: str, prefix: str = "data/") -> DataFrame:
    """(batch, file, payload) of all rows in files that a batch's list names and whose name has the prefix, such as ``data/database/table/`` or ``errors/``."""
    listed = spark.read.schema("batch long, file string").json(f"{path.rstrip('/')}/_batches/*.json").filter(F.col("file").startswith(prefix))
    names = [r.file for r in listed.select("file").collect()]  # one string a file, as any listing has
    if not names:
        return spark.createDataFrame([], "batch long, file string, payload string")
    rows = spark.read.schema("payload string").parquet(*[f"{path.rstrip('/')}/{n}" for n in names])
    rows = rows.withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return listed.withColumn("name", F.element_at(F.split("file", "/"), -1)).join(rows, "name").select("batch", "file", "payload")
