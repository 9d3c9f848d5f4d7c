"""Connectors against stand-ins of their services' clients. Stand-ins keep what they hold in files, as clients are made inside tasks."""

import json
import sys
import uuid
from collections import namedtuple
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle

from tideflow import sources, streaming

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import this module

Message = namedtuple("Message", "o k v")


class Files:
    """Things kept in a folder, one file each, so that tasks of other processes see them."""

    def __init__(self, path):
        self.path = Path(path)
        self.path.mkdir(parents=True, exist_ok=True)

    def add(self, thing, name=None):
        (self.path / (name or uuid.uuid4().hex)).write_text(json.dumps(thing))

    def all(self):
        return {p.name: json.loads(p.read_text()) for p in sorted(self.path.iterdir())}


class Broker:
    """What KafkaLog asks of a consumer, and kafka_send of a producer."""

    def __init__(self, path, parts=2):
        self.files, self.parts, self.at = Files(path), parts, None

    def _of(self, p):
        return sorted((m for m in self.files.all().values() if m["p"] == p), key=lambda m: m["o"])

    def list_topics(self, topic):
        return SimpleNamespace(topics={topic: SimpleNamespace(partitions=dict.fromkeys(range(self.parts)))})

    def get_watermark_offsets(self, tp):
        return 0, len(self._of(tp[1]))

    def assign(self, tps):
        self.at = list(tps[0][1:])

    def consume(self, n, timeout):
        some = [m for m in self._of(self.at[0]) if m["o"] >= self.at[1]][:n]
        self.at[1] += len(some)
        return [SimpleNamespace(error=lambda: None, offset=lambda m=m: m["o"], key=lambda: None, value=lambda m=m: m["v"].encode()) for m in some]

    def close(self):
        pass

    def produce(self, topic, key, value):
        p = int(key) % self.parts
        self.files.add({"p": p, "o": len(self._of(p)), "v": value})

    def flush(self):
        return 0


def topic_partition(topic, partition, offset=0):
    return topic, partition, offset


def test_log(spark, tmp_path):
    at = f"{tmp_path}/broker"
    df = spark.createDataFrame([(str(k), f"m{k}") for k in range(5)], "k string, v string").coalesce(1)
    assert sources.kafka_send(df, lambda: Broker(at), "t", "k", "v") == 5
    log = sources.KafkaLog(lambda: Broker(at), topic_partition, "t")
    sources.register_log(spark, "fake_log", log.SCHEMA, lambda options: log)
    got = spark.read.format("fake_log").load().selectExpr("partition", "offset", "cast(value as string) v").collect()
    assert sorted(map(tuple, got)) == [(0, 0, "m0"), (0, 1, "m2"), (0, 2, "m4"), (1, 0, "m1"), (1, 1, "m3")]
    read = lambda: streaming.run_available(spark.readStream.format("fake_log").load().selectExpr("cast(value as string) v"), f"{tmp_path}/out", f"{tmp_path}/ck")
    read()
    sources.kafka_send(df.limit(1), lambda: Broker(at), "t", "k", "v")
    read()  # goes on behind what was read
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["m0", "m0", "m1", "m2", "m3", "m4"]


class Queue:
    def __init__(self, path):
        self.files = Files(path)

    def receive_message(self, QueueUrl, MaxNumberOfMessages, WaitTimeSeconds):  # noqa: N803
        taken = Files(self.files.path.with_suffix(".taken"))
        some = [n for n in self.files.all() if n not in taken.all()][:MaxNumberOfMessages]
        for n in some:
            taken.add(1, n)
        return {"Messages": [{"ReceiptHandle": n, "MessageId": n, "Body": self.files.all()[n]} for n in some]} if some else {}

    def delete_message_batch(self, QueueUrl, Entries):  # noqa: N803
        for e in Entries:
            (self.files.path / e["ReceiptHandle"]).unlink()

    def send_message_batch(self, QueueUrl, Entries):  # noqa: N803
        for e in Entries:
            self.files.add(e["MessageBody"])
        return {}


def test_queue(spark, tmp_path):
    queue = sources.SqsQueue(lambda: Queue(f"{tmp_path}/q"), "url")
    assert queue.send(spark.range(13).selectExpr("concat('m', id) as b").coalesce(1), "b") == 13
    assert sorted(r.body for r in queue.receive(spark).collect()) == sorted(f"m{k}" for k in range(13))
    assert not Queue(f"{tmp_path}/q").files.all()  # all were acknowledged
    assert queue.receive(spark).count() == 0


class Redis:
    def __init__(self, path):
        self.files, self.held = Files(path), []

    def scan_iter(self, match, count):
        return iter([k.encode() for k in self.files.all()])

    def mget(self, keys):
        every = self.files.all()
        return [every[k if isinstance(k, str) else k.decode()].encode() if (k if isinstance(k, str) else k.decode()) in every else None for k in keys]

    def pipeline(self):
        return self

    def set(self, k, v, ex=None):
        self.held.append((k, v))

    def execute(self):
        for k, v in self.held:
            self.files.add(v, k)
        self.held = []


def test_key_value_store(spark, tmp_path):
    import tideflow.operators as op

    store = sources.RedisStore(lambda: Redis(f"{tmp_path}/kv"))
    assert store.put(spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), "k", "v") == 2
    assert sorted(map(tuple, store.scan(spark).collect())) == [("a", "1"), ("b", "2")]
    f = sources.from_rows(spark, ["a", "x", "b"], "k string")
    got = op.lookup_with(f, "k", store.fetch, "v string")
    assert [r.v for r in got.df.orderBy("pos").collect()] == ["1", None, "2"]


class Collection:
    def __init__(self, path):
        self.files = Files(path)

    def find(self, query, fields):
        return (d for d in self.files.all().values() if all(d.get(k) == v for k, v in query.items()))

    def insert_many(self, rows):
        for r in rows:
            self.files.add(r)

    def scan(self, Segment, TotalSegments, ExclusiveStartKey=0):  # noqa: N803
        mine = [d for k, d in enumerate(self.files.all().values()) if k % TotalSegments == Segment]
        page = mine[ExclusiveStartKey : ExclusiveStartKey + 2]
        return {"Items": page} | ({"LastEvaluatedKey": ExclusiveStartKey + 2} if len(mine) > ExclusiveStartKey + 2 else {})

    def search(self, index, query, sort, size, search_after=(-1,)):
        hits = [{"_source": d, "sort": [k]} for k, d in enumerate(self.files.all().values()) if k > search_after[0]]
        return {"hits": {"hits": hits[:2]}}

    def bulk(self, operations):
        self.insert_many(operations[1::2])
        return {"errors": False}


def test_document_stores(spark, tmp_path):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(7)], "n long, s string")
    make = lambda: Collection(f"{tmp_path}/c")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(df)
    mongo = sources.MongoCollection(make)
    assert mongo.insert(df) == 7
    assert rows(mongo.find(spark, "n long, s string", [{"s": "a"}, {"s": "b"}])) == want
    assert rows(sources.DynamoTable(make).scan(spark, "n long, s string", 2)) == want
    index = sources.SearchIndex(make, "i")
    assert rows(index.search(spark, "n long, s string")) == want
    assert index.put(df) == 7 and index.search(spark, "n long", name="again").count() == 14


def test_post(spark, tmp_path):
    got = Files(f"{tmp_path}/posts")

    def post(body):
        if len(got.all()) == 0:
            got.add([])
            return 503, "busy"
        got.add(json.loads(body))
        return 200, ""

    assert sources.http_post(spark.range(5).coalesce(1), post) == 5
    assert sorted(r["id"] for rows in got.all().values() for r in rows) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception, match="status 404"):
        sources.http_post(spark.range(1), lambda body: (404, "gone"))
    assert sources.HttpError(429, "").retryable and not sources.HttpError(400, "").retryable


def test_publish(spark, tmp_path):
    class Topic:
        def publish(self, topic, payload):
            Files(f"{tmp_path}/{topic}").add(payload)

    assert sources.publish(spark.range(3).selectExpr("cast(id as string) v"), Topic, "t", "v") == 3
    assert sorted(Files(f"{tmp_path}/t").all().values()) == ["0", "1", "2"]


class Subscription:
    def __init__(self, path):
        self.queue = Queue(path)

    def pull(self, request):
        got = self.queue.receive_message("", request["max_messages"], 1).get("Messages", [])
        return SimpleNamespace(received_messages=[SimpleNamespace(ack_id=m["ReceiptHandle"], message=SimpleNamespace(message_id=m["MessageId"], data=m["Body"].encode())) for m in got])

    def acknowledge(self, request):
        self.queue.delete_message_batch("", [{"ReceiptHandle": r} for r in request["ack_ids"]])

    def receive_messages(self, max_message_count, max_wait_time):
        class Text(str):
            message_id = "m"

        got = self.queue.receive_message("", max_message_count, 1).get("Messages", [])
        return [Text(m["Body"]) for m in got]

    def complete_message(self, message):
        pass

    def send_messages(self, messages):
        for m in messages:
            self.queue.files.add(m)


def test_subscriptions(spark, tmp_path):
    make = lambda: Subscription(f"{tmp_path}/s")
    bus = sources.ServiceBusQueue(make, make)
    texts = spark.range(12).selectExpr("concat('m', id) as b").coalesce(1)
    assert bus.send(texts, "b") == 12
    got = sources.PubSubSubscription(make, "path").receive(spark, most=5)
    assert got.count() == 5 and len(Queue(f"{tmp_path}/s").files.all()) == 7
    assert bus.receive(spark).count() == 7


class Stream:
    """A log of one topic, as Pulsar and Event Hubs have it, and a database of notifications."""

    def __init__(self, path):
        self.files, self.at = Files(path), 0

    def create_producer(self, topic):
        return self

    def send(self, body):
        self.files.add(body.decode(), f"{len(self.files.all()):04}")

    def create_reader(self, topic, start):
        self.at = start
        return self

    def has_message_available(self):
        return self.at < len(self.files.all())

    def read_next(self):
        self.at += 1
        body = list(self.files.all().values())[self.at - 1].encode()
        return SimpleNamespace(data=lambda: body)

    def close(self):
        pass

    def get_partition_ids(self):
        return ["0"]

    def get_partition_properties(self, partition):
        return {"beginning_sequence_number": 0, "last_enqueued_sequence_number": len(self.files.all()) - 1}

    def receive(self, take, partition_id, starting_position, starting_position_inclusive, max_wait_time):
        for k, body in enumerate(self.files.all().values()):
            if k >= starting_position:
                take(None, SimpleNamespace(sequence_number=k, body=[body.encode()]))

    def execute(self, text):
        assert text == "LISTEN c"

    def notifies(self, timeout):
        return iter([SimpleNamespace(channel="c", payload=p) for p in self.files.all().values()])


def test_streams_of_servers(spark, tmp_path):
    make = lambda: Stream(f"{tmp_path}/s")
    pulsar = sources.PulsarTopic(make, "t")
    assert pulsar.send(spark.range(4).selectExpr("cast(concat('m', id) as binary) b").coalesce(1), "b") == 4
    assert [bytes(r.body) for r in pulsar.read(spark, 1).collect()] == [b"m1", b"m2", b"m3"]
    hub = sources.EventHubLog(make)
    sources.register_log(spark, "fake_hub", hub.SCHEMA, lambda options: hub)
    assert [(r.sequence, bytes(r.body)) for r in spark.read.format("fake_hub").load().collect()] == [(k, f"m{k}".encode()) for k in range(4)]
    assert [tuple(r) for r in sources.postgres_listen(spark, make, "c", 1).collect()] == [("c", f"m{k}") for k in range(4)]
    calls = sources.read_calls(spark, ["a", "b"], lambda call: ((call, k) for k in range(10)), "call string, n int", "fake_calls", 3)
    assert sorted(map(tuple, calls.collect())) == [(c, k) for c in "ab" for k in range(3)]


def test_copy_and_export(spark, tmp_path):
    class Database:
        def __enter__(self):
            return self

        __exit__ = lambda self, *a: None
        cursor = commit = close = lambda self: self

        def copy(self, text):
            assert text == "COPY t (id) FROM STDIN"
            return self

        def write_row(self, row):
            Files(f"{tmp_path}/t").add(row)

    assert sources.postgres_copy(spark.range(3), Database, "t") == 3
    assert sorted(Files(f"{tmp_path}/t").all().values()) == [[0], [1], [2]]
    told = []
    meter = SimpleNamespace(create_counter=lambda name: SimpleNamespace(add=lambda n, tags: told.append((name, n, tags["stage"]))))
    sources.export_otel({"s": SimpleNamespace(processed=3, errors=1)}, meter)
    assert told == [("flow.processed", 3, "s"), ("flow.errors", 1, "s")]
