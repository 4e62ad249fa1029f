"""format("telemetry_ingest"): batch and stream writes as batch envelopes in a landing folder.

Register with `spark.dataSource.register(TelemetryIngest)`. Options: path (a folder that every executor reaches,
local or any address Arrow's file systems know), source, cluster_id. Each task writes JSON lines, each a request of at
most 25 records and 8 MiB with its envelope; files become visible when the write commits. A batch id is a hash of the
batch's records, so a batch that is written again has the same one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from optelem.sources.sinks import MAX_BYTES, MAX_EVENTS


@dataclass
class Written(WriterCommitMessage):
    pending: str | None
    records: int


def _plain(value):
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [_plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


class _Landing:
    def __init__(self, options) -> None:
        if "path" not in options:
            raise ValueError("telemetry_ingest needs the option path")
        self.address, self.source, self.cluster = options["path"], options.get("source", "spark"), options.get("cluster_id")

    def _folder(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.address or self.address.startswith("file:"):
            files, path = fs.FileSystem.from_uri(self.address)
        else:
            files, path = fs.LocalFileSystem(), self.address
        return files, path.rstrip("/")

    def _request(self, records: list[str]) -> bytes:
        body = ",".join(records)
        head = {"source": self.source, "cluster_id": self.cluster, "batch_id": hashlib.sha256(body.encode()).hexdigest()}
        return (json.dumps(head)[:-1] + ', "records": [' + body + "]}").encode()

    def write(self, rows: Iterator) -> Written:
        files, path = self._folder()
        files.create_dir(path, recursive=True)
        name = f"{path}/.{uuid.uuid4().hex}.pending"
        envelope = len(self._request([]))
        records, size, count = [], envelope, 0
        with files.open_output_stream(name) as out:
            for row in rows:
                text = json.dumps(_plain(row), ensure_ascii=False)
                n = len(text.encode())
                if envelope + n > MAX_BYTES:
                    raise ValueError("a record is larger than a batch may be; separate such rows first")
                if records and (len(records) == MAX_EVENTS or size + 1 + n > MAX_BYTES):
                    out.write(self._request(records) + b"\n")
                    records, size = [], envelope
                size += n + bool(records)
                records.append(text)
                count += 1
            if records:
                out.write(self._request(records) + b"\n")
        return Written(name, count)

    def publish(self, messages, prefix: str) -> None:
        """Give the files their names; what an earlier attempt of the same job or batch has left under the prefix goes."""
        files, path = self._folder()
        kept = set()
        for number, message in enumerate(m for m in messages if m is not None and m.pending):
            if message.records == 0:
                files.delete_file(message.pending)
            else:
                final = f"{path}/{prefix}-{number:05d}.json"
                files.move(message.pending, final)
                kept.add(final.rsplit("/", 1)[1])
        for found in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if found.base_name.startswith(f"{prefix}-") and found.base_name not in kept:
                files.delete_file(found.path)

    def discard(self, messages) -> None:
        files, _ = self._folder()
        for message in messages:
            if message is not None and message.pending and files.get_file_info(message.pending).is_file:
                files.delete_file(message.pending)


class IngestWriter(DataSourceWriter):
    def __init__(self, options) -> None:
        self.landing = _Landing(options)
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> Written:
        return self.landing.write(iterator)

    def commit(self, messages) -> None:
        self.landing.publish(messages, f"job-{self.job}")

    def abort(self, messages) -> None:
        self.landing.discard(messages)


class IngestStreamWriter(DataSourceStreamWriter):
    def __init__(self, options) -> None:
        self.landing = _Landing(options)

    def write(self, iterator) -> Written:
        return self.landing.write(iterator)

    def commit(self, messages, batchId) -> None:
        self.landing.publish(messages, f"stream-{batchId}")

    def abort(self, messages, batchId) -> None:
        self.landing.discard(messages)


class TelemetryIngest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetry_ingest"

    def writer(self, schema, overwrite) -> IngestWriter:
        return IngestWriter(self.options)

    def streamWriter(self, schema, overwrite) -> IngestStreamWriter:
        return IngestStreamWriter(self.options)
