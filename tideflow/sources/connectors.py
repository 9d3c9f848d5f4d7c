"""Message logs, queues, key-value stores, document stores and web services, in four shapes.

A log has partitions and offsets and is read by range, as batch or stream (`register_log`). A queue hands out messages
that are acknowledged once they are kept. A table-like store is scanned in parts and written in batches. A web service
takes batches by POST. Each adapter is given a function that makes the client of its service's own Python library; it is
called inside the tasks, so clients are never sent around, and a test can hand in a stand-in. Delivery is at least
once: a task that is run again sends or takes again.
"""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideflow.plans.scratch import written
from tideflow.sources.pluggable import register_source, write_with

Client = Callable[[], Any]


# --- logs


@dataclass(frozen=True)
class KafkaLog:
    """For register_log: rows (partition, offset, key, value). consumer(): a confluent_kafka.Consumer; tp(topic, partition, offset): its TopicPartition."""

    consumer: Client
    tp: Callable[..., Any]
    topic: str
    SCHEMA = "partition int, offset long, key binary, value binary"

    def partitions(self) -> list[int]:
        return sorted(self.consumer().list_topics(self.topic).topics[self.topic].partitions)

    def span(self, partition: int) -> tuple[int, int]:
        return self.consumer().get_watermark_offsets(self.tp(self.topic, partition))

    def read(self, partition: int, start: int, end: int) -> Iterator[tuple]:
        consumer, at = self.consumer(), start
        consumer.assign([self.tp(self.topic, partition, start)])
        try:
            while at < end:
                for m in consumer.consume(min(1000, end - at), 10.0):
                    if m.error():
                        raise RuntimeError(str(m.error()))
                    if m.offset() < end:
                        yield partition, m.offset(), m.key(), m.value()
                    at = m.offset() + 1
        finally:
            consumer.close()


@dataclass(frozen=True)
class KinesisLog:
    """For register_log: rows (shard, sequence, value). client(): a boto3 kinesis client. Offsets are positions in the shard's records, which Kinesis does not number, so a range is read from the shard's beginning; keep retention short or read by batch."""

    client: Client
    stream: str
    SCHEMA = "shard string, sequence string, value binary"

    def partitions(self) -> list[str]:
        return sorted(s["ShardId"] for s in self.client().list_shards(StreamName=self.stream)["Shards"])

    def _records(self, shard: str) -> Iterator[dict]:
        client = self.client()
        at = client.get_shard_iterator(StreamName=self.stream, ShardId=shard, ShardIteratorType="TRIM_HORIZON")["ShardIterator"]
        while at:
            got = client.get_records(ShardIterator=at)
            yield from got["Records"]
            if not got["Records"] and not got.get("MillisBehindLatest"):
                return
            at = got.get("NextShardIterator")

    def span(self, shard: str) -> tuple[int, int]:
        return 0, sum(1 for _ in self._records(shard))

    def read(self, shard: str, start: int, end: int) -> Iterator[tuple]:
        for k, r in enumerate(self._records(shard)):
            if k >= end:
                return
            if k >= start:
                yield shard, r["SequenceNumber"], r["Data"]


@dataclass(frozen=True)
class EventHubLog:
    """For register_log: rows (partition, sequence, body). client(): an azure.eventhub.EventHubConsumerClient."""

    client: Client
    SCHEMA = "partition string, sequence long, body binary"

    def partitions(self) -> list[str]:
        return sorted(self.client().get_partition_ids())

    def span(self, partition: str) -> tuple[int, int]:
        got = self.client().get_partition_properties(partition)
        return got["beginning_sequence_number"], got["last_enqueued_sequence_number"] + 1

    def read(self, partition: str, start: int, end: int) -> Iterator[tuple]:
        client, events = self.client(), queue.Queue(1000)

        def take(_, event) -> None:
            if event is not None:
                events.put(event)

        threading.Thread(target=client.receive, args=(take,), kwargs={"partition_id": partition, "starting_position": start, "starting_position_inclusive": True, "max_wait_time": 5}, daemon=True).start()
        try:
            while start < end:
                event = events.get(timeout=60)
                if event.sequence_number >= end:
                    return
                yield partition, event.sequence_number, b"".join(event.body)
                start = event.sequence_number + 1
        finally:
            client.close()


def kafka_send(df: DataFrame, producer: Client, topic: str, key: str | None, value: str) -> int:
    """Rows to a topic. producer(): a confluent_kafka.Producer."""

    def send(p, rows):
        for r in rows:
            p.produce(topic, key=r[key] if key else None, value=r[value])
        if p.flush():
            raise RuntimeError("some messages were not delivered")

    return write_with(df, producer, send)


# --- queues


def receive(spark: SparkSession, pull: Callable[[int], list[tuple[Any, tuple]]], acknowledge: Callable[[list], None], schema: str, readers: int = 1, most: int | None = None) -> DataFrame:
    """Messages of a queue: each of the readers (tasks) calls pull(n) -> [(receipt, row)] until nothing comes, or it has `most`. The rows are written first and acknowledged after that, by their receipts, so a failure in between delivers them again."""
    fields = T.StructType.fromDDL(f"{schema}, receipt_ string")
    out = to_arrow_schema(fields)

    def take(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                had = 0
                while most is None or had < most:
                    got = pull(10 if most is None else min(10, most - had))
                    if not got:
                        break
                    had += len(got)
                    rows = [(*row, json.dumps(receipt)) for receipt, row in got]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    kept = written(spark.range(0, readers, 1, readers).mapInArrow(take, fields))

    def settle(_, rows):
        acknowledge([json.loads(r["receipt_"]) for r in rows])

    write_with(kept.select("receipt_"), lambda: None, settle)
    return kept.drop("receipt_")


@dataclass(frozen=True)
class SqsQueue:
    """client(): a boto3 sqs client."""

    client: Client
    url: str

    def pull(self, n: int) -> list[tuple[str, tuple]]:
        got = self.client().receive_message(QueueUrl=self.url, MaxNumberOfMessages=min(n, 10), WaitTimeSeconds=1)
        return [(m["ReceiptHandle"], (m["MessageId"], m["Body"])) for m in got.get("Messages", [])]

    def acknowledge(self, receipts: list[str]) -> None:
        client = self.client()
        for a in range(0, len(receipts), 10):
            client.delete_message_batch(QueueUrl=self.url, Entries=[{"Id": str(k), "ReceiptHandle": r} for k, r in enumerate(receipts[a : a + 10])])

    def receive(self, spark: SparkSession, readers: int = 1, most: int | None = None) -> DataFrame:
        return receive(spark, self.pull, self.acknowledge, "id string, body string", readers, most)

    def send(self, df: DataFrame, body: str) -> int:
        def put(client, rows):
            for a in range(0, len(rows), 10):
                got = client.send_message_batch(QueueUrl=self.url, Entries=[{"Id": str(k), "MessageBody": r[body]} for k, r in enumerate(rows[a : a + 10])])
                if got.get("Failed"):
                    raise RuntimeError(f"{len(got['Failed'])} messages were not sent")

        return write_with(df, self.client, put)


@dataclass(frozen=True)
class AmqpQueue:
    """connect(): a pika channel."""

    connect: Client
    queue: str

    def pull(self, n: int) -> list[tuple[int, tuple]]:
        channel, out = self.connect(), []
        while len(out) < n:
            method, _, body = channel.basic_get(self.queue)
            if method is None:
                break
            out.append((method.delivery_tag, (bytes(body),)))
        return out

    def acknowledge(self, tags: list[int]) -> None:
        channel = self.connect()
        for t in tags:
            channel.basic_ack(t)

    def receive(self, spark: SparkSession, most: int | None = None) -> DataFrame:
        """By one reader, as tags belong to their channel."""
        return receive(spark, self.pull, self.acknowledge, "body binary", 1, most)

    def send(self, df: DataFrame, body: str) -> int:
        return write_with(df, self.connect, lambda channel, rows: [channel.basic_publish(exchange="", routing_key=self.queue, body=r[body]) for r in rows] and None)


@dataclass(frozen=True)
class PubSubSubscription:
    """client(): a google.cloud.pubsub_v1.SubscriberClient; path: the subscription's."""

    client: Client
    path: str

    def pull(self, n: int) -> list[tuple[str, tuple]]:
        got = self.client().pull(request={"subscription": self.path, "max_messages": n})
        return [(m.ack_id, (m.message.message_id, m.message.data)) for m in got.received_messages]

    def acknowledge(self, receipts: list[str]) -> None:
        self.client().acknowledge(request={"subscription": self.path, "ack_ids": receipts})

    def receive(self, spark: SparkSession, readers: int = 1, most: int | None = None) -> DataFrame:
        return receive(spark, self.pull, self.acknowledge, "id string, body binary", readers, most)


@dataclass(frozen=True)
class ServiceBusQueue:
    """receiver(), sender(): those of an azure.servicebus client; message(body): its ServiceBusMessage."""

    receiver: Client
    sender: Client | None = None
    message: Callable[[Any], Any] = lambda body: body

    def receive(self, spark: SparkSession, readers: int = 1, most: int | None = None) -> DataFrame:
        """A message is settled by the receiver that locked it, so it is completed once its batch has been taken over."""

        def pull(n: int) -> list[tuple[Any, tuple]]:
            receiver = self.receiver()
            got = receiver.receive_messages(max_message_count=n, max_wait_time=5)
            out = [(None, (str(m.message_id), str(m))) for m in got]
            for m in got:
                receiver.complete_message(m)
            return out

        return receive(spark, pull, lambda receipts: None, "id string, body string", readers, most)

    def send(self, df: DataFrame, body: str) -> int:
        return write_with(df, self.sender, lambda sender, rows: sender.send_messages([self.message(r[body]) for r in rows]))


@dataclass(frozen=True)
class PulsarTopic:
    """client(): a pulsar.Client."""

    client: Client
    topic: str

    def read(self, spark: SparkSession, start: Any, schema: str = "body binary", name: str = "pulsar_read") -> DataFrame:
        """From a message id to the end there is now, by one task, without a subscription."""

        def rows(options, part):
            reader = self.client().create_reader(self.topic, start)
            while reader.has_message_available():
                yield (reader.read_next().data(),)

        register_source(spark, name, schema, lambda options: [0], rows)
        return spark.read.format(name).load()

    def send(self, df: DataFrame, body: str) -> int:
        return write_with(df, lambda: self.client().create_producer(self.topic), lambda producer, rows: [producer.send(r[body]) for r in rows] and None, lambda producer: producer.close())


def read_calls(spark: SparkSession, calls: list, open_call: Callable[[Any], Any], schema: str, name: str, most: int | None = None) -> DataFrame:
    """Streams that a server sends, as those of gRPC and WebSocket: open_call(call) gives an iterator of rows; each call is a task, which takes its rows to the end, or `most` of them."""
    register_source(spark, name, schema, lambda options: list(calls), lambda options, call: islice(iter(open_call(call)), most))
    return spark.read.format(name).load()


def postgres_copy(df: DataFrame, connect: Client, table: str, batch: int = 10_000) -> int:
    """COPY into a table. connect(): a psycopg connection; each batch is a transaction."""
    names = ", ".join(df.columns)

    def send(db, rows):
        with db.cursor() as cursor, cursor.copy(f"COPY {table} ({names}) FROM STDIN") as copy:
            for r in rows:
                copy.write_row(tuple(r.values()))
        db.commit()

    return write_with(df, connect, send, lambda db: db.close(), batch)


def postgres_listen(spark: SparkSession, connect: Client, channel: str, seconds: float, name: str = "postgres_listen") -> DataFrame:
    """The notifications of a channel that come within so many seconds: channel, payload. connect(): a psycopg connection in autocommit."""

    def rows(options, part):
        db = connect()
        db.execute(f"LISTEN {channel}")
        for n in db.notifies(timeout=seconds):
            yield n.channel, n.payload

    register_source(spark, name, "channel string, payload string", lambda options: [0], rows)
    return spark.read.format(name).load()


def publish(df: DataFrame, connect: Client, topic: str, value: str, call: str = "publish") -> int:
    """Rows to a topic of a client with publish(topic, payload), as those of MQTT, NATS and Pub/Sub have (or another method's name in `call`)."""
    return write_with(df, connect, lambda client, rows: [getattr(client, call)(topic, r[value]) for r in rows] and None)


# --- key-value and document stores


@dataclass(frozen=True)
class RedisStore:
    """client(): a redis.Redis."""

    client: Client

    def scan(self, spark: SparkSession, match: str = "*", name: str = "redis_scan") -> DataFrame:
        """key, value of the strings whose keys match; a cursor is walked by one task."""

        def read(options, part):
            client, keys = self.client(), []
            for key in client.scan_iter(match=match, count=1000):
                keys.append(key)
                if len(keys) == 1000:
                    yield from zip(keys, client.mget(keys))
                    keys = []
            if keys:
                yield from zip(keys, client.mget(keys))

        register_source(spark, name, "key string, value string", lambda options: [0], lambda o, p: ((_text(k), _text(v)) for k, v in read(o, p)))
        return spark.read.format(name).load()

    def fetch(self, keys: list) -> dict:
        """For lookup_with."""
        return {k: (_text(v),) for k, v in zip(keys, self.client().mget(keys)) if v is not None}

    def put(self, df: DataFrame, key: str, value: str, ttl: int | None = None) -> int:
        def send(client, rows):
            pipe = client.pipeline()
            for r in rows:
                pipe.set(r[key], r[value], ex=ttl)
            pipe.execute()

        return write_with(df, self.client, send)

    def push(self, df: DataFrame, list_name: str, value: str) -> int:
        return write_with(df, self.client, lambda client, rows: client.rpush(list_name, *[r[value] for r in rows]))


def _text(x: Any) -> str | None:
    return x.decode() if isinstance(x, bytes) else x


@dataclass(frozen=True)
class MongoCollection:
    """collection(): a pymongo collection."""

    collection: Client

    def find(self, spark: SparkSession, schema: str, parts: list[dict] | None = None, name: str = "mongo_find") -> DataFrame:
        """The named fields of the documents that each filter finds: a task for each filter."""
        fields = T.StructType.fromDDL(schema).names

        def read(options, part):
            for doc in self.collection().find(part, dict.fromkeys(fields, 1)):
                yield tuple(doc.get(f) for f in fields)

        register_source(spark, name, schema, lambda options: parts or [{}], read)
        return spark.read.format(name).load()

    def insert(self, df: DataFrame) -> int:
        return write_with(df, self.collection, lambda collection, rows: collection.insert_many(rows) and None)


@dataclass(frozen=True)
class DynamoTable:
    """table(): a boto3 dynamodb Table."""

    table: Client

    def scan(self, spark: SparkSession, schema: str, segments: int = 8, name: str = "dynamo_scan") -> DataFrame:
        """The named attributes, by parallel scan: a task for each segment."""
        fields = T.StructType.fromDDL(schema).names

        def read(options, segment):
            table, more = self.table(), {}
            while True:
                got = table.scan(Segment=segment, TotalSegments=segments, **more)
                yield from (tuple(i.get(f) for f in fields) for i in got["Items"])
                if "LastEvaluatedKey" not in got:
                    return
                more = {"ExclusiveStartKey": got["LastEvaluatedKey"]}

        register_source(spark, name, schema, lambda options: list(range(segments)), read)
        return spark.read.format(name).load()

    def put(self, df: DataFrame) -> int:
        def send(table, rows):
            with table.batch_writer() as batch:
                for r in rows:
                    batch.put_item(Item=r)

        return write_with(df, self.table, send)


@dataclass(frozen=True)
class SearchIndex:
    """client(): an elasticsearch.Elasticsearch."""

    client: Client
    index: str

    def search(self, spark: SparkSession, schema: str, query: dict | None = None, sort: list | None = None, size: int = 1000, name: str = "index_search") -> DataFrame:
        """The named fields of the hits, page by page after the last hit's sort values."""
        fields = T.StructType.fromDDL(schema).names

        def read(options, part):
            client, after = self.client(), None
            while True:
                more = {"search_after": after} if after is not None else {}
                hits = client.search(index=self.index, query=query or {"match_all": {}}, sort=sort or ["_doc"], size=size, **more)["hits"]["hits"]
                if not hits:
                    return
                yield from (tuple(h["_source"].get(f) for f in fields) for h in hits)
                after = hits[-1]["sort"]

        register_source(spark, name, schema, lambda options: [0], read)
        return spark.read.format(name).load()

    def put(self, df: DataFrame, key: str | None = None) -> int:
        def send(client, rows):
            ops = [x for r in rows for x in ({"index": {"_index": self.index} | ({"_id": r[key]} if key else {})}, r)]
            if client.bulk(operations=ops).get("errors"):
                raise RuntimeError("some documents were refused")

        return write_with(df, self.client, send)


# --- web services and metrics


class HttpError(RuntimeError):
    """A status of 400 or more; retryable where another try may help."""

    def __init__(self, status: int, body: str) -> None:
        super().__init__(f"status {status}: {body[:200]}")
        self.status, self.retryable = status, status == 429 or status >= 500


def http_post(df: DataFrame, post: Callable[[bytes], tuple[int, str]], attempts: int = 3, batch: int = 500) -> int:
    """Rows in JSON arrays; post(body) -> (status, text). Tried again on 429 and from 500 on."""

    def send(_, rows):
        body = json.dumps(rows, default=str).encode()
        for k in range(attempts):
            status, text = post(body)
            if status < 400:
                return
            error = HttpError(status, text)
            if not error.retryable or k + 1 == attempts:
                raise error

    return write_with(df, lambda: None, send, batch=batch)


def prometheus_text(metrics: dict[str, Any], prefix: str = "flow") -> str:
    """Stage metrics (as MetricsHook.snapshot gives them) in the text format that scrapers read."""
    lines = []
    for name, value in (("processed_total", "processed"), ("errors_total", "errors"), ("seconds_total", "seconds")):
        lines.append(f"# TYPE {prefix}_{name} counter")
        lines += [f'{prefix}_{name}{{stage="{stage}"}} {getattr(m, value)}' for stage, m in sorted(metrics.items())]
    return "\n".join(lines) + "\n"


def statsd_lines(metrics: dict[str, Any], prefix: str = "flow") -> list[str]:
    """The same as counters of the StatsD line format, with the stage as a tag."""
    return [f"{prefix}.{name}:{getattr(m, name)}|c|#stage:{stage}" for stage, m in sorted(metrics.items()) for name in ("processed", "errors")]


def export_otel(metrics: dict[str, Any], meter: Any, prefix: str = "flow") -> None:
    """The same as counters of an OpenTelemetry meter, with the stage as an attribute."""
    for name in ("processed", "errors"):
        counter = meter.create_counter(f"{prefix}.{name}")
        for stage, m in sorted(metrics.items()):
            counter.add(getattr(m, name), {"stage": stage})
