"""Message logs with the six columns of Kafka's source, replayed from files, and the parsing of their payloads.

`messages` reads a real broker where options name one; else a log is a folder with a file for each partition and batch of
messages (`<topic>/<partition>/<first offset>.jsonl`), on a path that driver and executors see. Each micro-batch reads ranges of
offsets of every partition, on executors. A fresh checkpoint starts at `earliest` or `latest`, an old one where it stopped.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"


def send(path: str, topic: str, partition: int, payloads: Iterable[str], keys: Iterable[str] | None = None, at: float = 0.0) -> int:
    """Appends messages a second apart from `at` on; gives the next offset."""
    folder = os.path.join(path, topic, str(partition))
    os.makedirs(folder, exist_ok=True)
    start = ends(path, topic).get(partition, 0)
    payloads = list(payloads)
    keys = list(keys) if keys is not None else [None] * len(payloads)
    draft = os.path.join(folder, f".{start:020d}")
    with open(draft, "w", encoding="utf-8") as f:
        for k, (key, value) in enumerate(zip(keys, payloads, strict=True)):
            f.write(json.dumps([key, value, at + k]) + "\n")
    # the file's name tells where it ends, so that offsets are found without reading
    os.rename(draft, os.path.join(folder, f"{start:020d}-{start + len(payloads):020d}.jsonl"))
    return start + len(payloads)


def files(path: str, topic: str, partition: int) -> list[tuple[int, int, str]]:
    folder = os.path.join(path, topic, str(partition))
    names = sorted(n for n in os.listdir(folder) if n.endswith(".jsonl"))
    return [(*map(int, n[:-6].split("-")), os.path.join(folder, n)) for n in names]


def ends(path: str, topic: str) -> dict[int, int]:
    """The next offset of each partition."""
    folder = os.path.join(path, topic)
    parts = sorted(int(p) for p in os.listdir(folder) if p.isdigit()) if os.path.isdir(folder) else []
    return {p: max((b for _, b, _ in files(path, topic, p)), default=0) for p in parts}


class Range(InputPartition):
    def __init__(self, path: str, topic: str, partition: int, start: int, end: int):
        self.path, self.topic, self.partition, self.start, self.end = path, topic, partition, start, end


def replayed(r: Range) -> Iterator[tuple]:
    for a, b, name in files(r.path, r.topic, r.partition):
        if b <= r.start or a >= r.end:
            continue
        with open(name, encoding="utf-8") as f:
            for offset, line in enumerate(f, a):
                if r.start <= offset < r.end:
                    key, value, at = json.loads(line)
                    when = datetime.datetime.fromtimestamp(at, datetime.timezone.utc)
                    yield None if key is None else key.encode(), None if value is None else value.encode(), r.topic, r.partition, offset, when


class BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.topic = options["path"], options["subscribe"]

    def partitions(self):
        return [Range(self.path, self.topic, p, 0, end) for p, end in ends(self.path, self.topic).items()] or [Range(self.path, self.topic, -1, 0, 0)]

    def read(self, partition):
        return replayed(partition) if partition.end else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.topic, self.begin = options["path"], options["subscribe"], options.get("startingoffsets", "earliest")

    def initialOffset(self):
        found = ends(self.path, self.topic)
        return {str(p): n if self.begin == "latest" else 0 for p, n in found.items()}

    def latestOffset(self):
        return {str(p): n for p, n in ends(self.path, self.topic).items()}

    def partitions(self, start, end):
        # a partition that is new since the start is read from its first message
        return [Range(self.path, self.topic, int(p), start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]

    def read(self, partition):
        return replayed(partition)


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return BatchReader(dict(self.options))

    def streamReader(self, schema):
        return StreamReader(dict(self.options))


def messages(spark: SparkSession, stream: bool = True, **options: str) -> DataFrame:
    """The six columns of a topic: from a broker with the option kafka.bootstrap.servers, else from the log at path; subscribe names the topic."""
    spark.dataSource.register(MessageLog)
    reader = (spark.readStream if stream else spark.read).format("kafka" if "kafka.bootstrap.servers" in options else "message_log")
    return reader.options(**options).load()


def payloads(found: DataFrame, schema: str) -> DataFrame:
    """The fields of JSON payloads beside the messages' own columns; `raw` has what is no object of that schema, with all fields null then."""
    text = F.col("value").cast("string")
    event = F.from_json(text, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = found.select(event.alias("event"), text.alias("text"), F.col("key").cast("string").alias("message_key"), "topic", "partition", "offset", F.col("timestamp").alias("enqueued_at"))
    bad = F.col("event").isNull() | F.col("event._bad").isNotNull()
    fields = [f.split()[0] for f in schema.split(",")]
    return parsed.select(*[F.col(f"event.{c}").alias(c) for c in fields], "message_key", "topic", "partition", "offset", "enqueued_at", F.when(bad, F.col("text")).alias("raw"))


def kafka_options(servers: str, topic: str, user: str, secret: str, starting: str = "earliest") -> dict[str, str]:
    """Options of a broker that asks for a name and password over TLS."""
    login = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{user}" password="{secret}";'
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": login, "startingOffsets": starting}
