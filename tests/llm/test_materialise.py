import glob
import hashlib
import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest

import llm.materialise as materialise_module
from llm import bpe
from llm.common import DROP_SHUFFLES, scratch
from llm.hashing import mixed
from llm.materialise import KEY, PAD, TOKEN, Order, materialise, permute, query, read_from, through_shards, write_shards

END = 50256


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4096])
def test_permutation(size):
    slots = permute(np.arange(size), size, "k")
    assert sorted(slots) == list(range(size))
    assert (permute(slots, size, "k", inverse=True) == np.arange(size)).all()
    if size > 100:
        assert (slots != permute(np.arange(size), size, "other")).any()


def plain_slot(index, size, key):
    """Six rounds on two halves of whole numbers, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    stream = hashlib.shake_256(key.encode()).digest(48)
    keys = [int.from_bytes(stream[i : i + 8], "little") for i in range(0, 48, 8)]
    x = index
    while True:
        left, right = x >> half, x % 2**half
        for k in keys:
            left, right = right, left ^ plain_mix((right + k) % 2**64) % 2**half
        x = right * 2**half + left
        if x < size:
            return x


def plain_mix(x):
    return int(mixed(np.array([x], np.uint64))[0])


@pytest.mark.parametrize("size", [1, 2, 5, 16, 17, 300])
def test_slots_as_a_plain_feistel_network(size):
    assert [int(s) for s in permute(np.arange(size), size, "k")] == [plain_slot(i, size, "k") for i in range(size)]


def test_attempts_write_under_names_of_their_own(docs, tmp_path, monkeypatch):
    names = []
    real = materialise_module.pafs.FileSystem.from_uri

    class Seen:
        def __init__(self, files):
            self.files = files

        def open_output_stream(self, name):
            names.append(name)
            return self.files.open_output_stream(name)

        def __getattr__(self, name):
            return getattr(self.files, name)

    class Attempt:
        number = 0

        def taskAttemptId(self):
            Attempt.number += 1
            return Attempt.number

    def from_uri(uri):
        files, root = real(uri)
        return Seen(files), root

    monkeypatch.setattr(materialise_module, "pafs", type("Files", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(from_uri)})}))
    monkeypatch.setattr(materialise_module, "TaskContext", type("Context", (), {"get": staticmethod(Attempt)}))
    batch = pa.record_batch({"shard": pa.array([0, 0]), "tokens": pa.array([b"ab", b"cd"])})
    first = materialise_module._written(iter([batch]), f"file://{tmp_path}")
    manifests = [next(first).to_pylist(), next(materialise_module._written(iter([batch]), f"file://{tmp_path}")).to_pylist()]
    assert manifests[0] == manifests[1] and len(set(names)) == 2
    assert os.listdir(tmp_path) == ["shard-000000000000.bin"]


def texts_of(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r["doc_id"], {})[r["part"]] = bytes(r["tokens"])
    out = {}
    for doc, found in parts.items():
        ids = np.frombuffer(b"".join(found[i] for i in range(len(found))), TOKEN)
        ids = ids[ids != PAD]
        assert ids[-1] == END and list(ids).count(END) == 1
        out[doc] = "".join(bpe.load(bpe.VOCABULARY).decode(ids[:-1].astype(np.uint32)))
    return out


def test_round_trip_through_shards(spark, docs, tmp_path):
    texts = ["é" * n for n in (0, 1, 3, 4, 7, 8, 9, 200)] + [None, "", "same", "same"]
    ordered = materialise(docs(texts), "key", length=16, shard=4, partition_bytes=128)
    rows = ordered.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(r["shard"] == r["slot"] // 4 and r["byte_offset"] == r["slot"] % 4 * 32 for r in rows)
    assert {len(r["tokens"]) for r in rows} == {32}
    assert texts_of(rows) == {i: t or "" for i, t in enumerate(texts)}
    manifest = write_shards(ordered, f"file://{tmp_path}/shards").collect()
    by_slot = [bytes(r["tokens"]) for r in sorted(rows, key=lambda r: r["slot"])]
    assert sum(m["sequences"] for m in manifest) == len(rows)
    for m in manifest:
        whole = b"".join(by_slot[m["shard"] * 4 : m["shard"] * 4 + 4])
        assert hashlib.sha256(whole).hexdigest() == m["sha256"]
    for start in (0, 5, len(rows) - 1):
        assert list(read_from(f"file://{tmp_path}/shards", start, len(rows), 16, 4)) == by_slot[start:]


def test_order_does_not_depend_on_other_columns_or_runs(docs):
    frame = docs([f"text {i}" for i in range(50)])
    first = {(r["doc_id"], r["slot"]) for r in materialise(frame, "k", 8).collect()}
    assert first == {(r["doc_id"], r["slot"]) for r in materialise(frame, "k", 8).collect()}


def test_awkward_rows(awkward, nothing):
    rows = materialise(awkward, "k", 1024).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sum(list(np.frombuffer(r["tokens"], TOKEN)).count(END) for r in rows) == awkward.count()
    assert materialise(nothing, "k").collect() == []


def test_query_writes_the_shards_it_returns(spark):
    rows = sorted(query(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows))) and rows
    shards = {}
    for r in rows:
        shards.setdefault((r["shard"], r["sequences"], r["sha256"]), []).append(bytes(r["tokens"]))
    assert len({k[0] for k in shards}) == len(shards)
    for (_, sequences, digest), tokens in shards.items():
        assert len(tokens) == sequences and hashlib.sha256(b"".join(tokens)).hexdigest() == digest
    plain = {(r["slot"], r["doc_id"], r["part"], bytes(r["tokens"])) for r in materialise(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), KEY).collect()}
    assert plain == {(r["slot"], r["doc_id"], r["part"], bytes(r["tokens"])) for r in rows}
    files = os.path.join(re.sub("^file:/*", "/", scratch(spark)), "*", "shard-*.bin")
    assert sum(os.path.getsize(f) for f in glob.glob(files)) >= sum(len(r["tokens"]) for r in rows)


def test_passes_shuffle_a_share_each_and_leave_no_shuffle(spark, docs, tmp_path):
    texts = ["é" * n for n in (0, 1, 3, 4, 7, 8, 9, 200)] + [None, "", "same", "same"]
    order = Order(docs(texts), "key", length=16, shard=4, partition_bytes=128)
    whole = {(r["slot"], r["shard"], r["byte_offset"], r["doc_id"], r["part"], bytes(r["tokens"])) for r in order.rows().collect()}
    stretches = order.passes(3)
    found = [[r["slot"] for r in s.collect()] for s in stretches]
    assert len(stretches) == 3 and sum(found, []) == list(range(order.size))
    assert all(s[0] % 4 == 0 for s in found)
    kept = lambda: {f for f in glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*.data")}
    before = kept()
    rows = through_shards(order, f"file://{tmp_path}/shards", 3)
    deadline = time.time() + 20  # executors drop the files a little later
    while kept() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not kept() - before
    assert whole == {(r["slot"], r["shard"], r["byte_offset"], r["doc_id"], r["part"], bytes(r["tokens"])) for r in rows.collect()}
    assert len(whole) == order.size and spark.conf.get(DROP_SHUFFLES, "false") == "false"


def test_a_pass_is_given_no_sequence_of_another(docs):
    order = Order(docs([f"text {i} " * 9 for i in range(40)]), "key", length=8, shard=2, partition_bytes=32)
    for at, rows in enumerate(order.passes(5)):
        plan = rows._jdf.queryExecution().executedPlan()
        assert "Exchange" in plan.toString() and rows.count() < order.size / 4, at


def test_no_texts_through_shards(nothing, tmp_path):
    assert through_shards(Order(nothing, "k"), f"file://{tmp_path}/shards").collect() == []


def test_rows_that_follow_each_other_are_written_and_read_at_once(tmp_path, monkeypatch):
    calls = []
    real = materialise_module.pafs.FileSystem.from_uri

    class Counted:
        def __init__(self, file):
            self.file = file

        def write(self, data):
            calls.append("write")
            return self.file.write(data)

        def read(self, size):
            calls.append("read")
            return self.file.read(size)

        def __getattr__(self, name):
            return getattr(self.file, name)

    class Files:
        def __init__(self, files):
            self.files = files

        def open_output_stream(self, name):
            return Counted(self.files.open_output_stream(name))

        def open_input_file(self, name):
            return Counted(self.files.open_input_file(name))

        def __getattr__(self, name):
            return getattr(self.files, name)

    def from_uri(uri):
        files, root = real(uri)
        return Files(files), root

    monkeypatch.setattr(materialise_module, "pafs", type("Files", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(from_uri)})}))
    monkeypatch.setattr(materialise_module, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Attempt", (), {"taskAttemptId": lambda self: 1})())}))
    slots = np.arange(40)
    tokens = pa.array([bytes([i, i + 1]) for i in range(40)], pa.binary())
    rows = pa.record_batch({"shard": pa.array(slots // 16), "byte_offset": pa.array(slots % 16 * 2), "tokens": tokens})
    folder = f"file://{tmp_path}"
    manifest = [r for b in materialise_module._written(iter([rows.slice(0, 0), rows.slice(0, 10), rows.slice(10)]), folder) for r in b.to_pylist()]
    assert [(m["shard"], m["sequences"]) for m in manifest] == [(0, 16), (1, 16), (2, 8)]
    held = [b"".join(tokens[i : i + 16].to_pylist()) for i in (0, 16, 32)]
    assert [m["sha256"] for m in manifest] == [hashlib.sha256(h).hexdigest() for h in held]
    assert calls == ["write"] * 4
    calls.clear()
    index = rows.drop_columns(["tokens"])
    asked = [index.slice(0, 0), index.slice(3, 20), index.take(pa.array([30, 5, 6, 39]))]
    back = [b["tokens"].to_pylist() for b in materialise_module._read_back(iter(asked), folder, 2)]
    assert back == [[], tokens[3:23].to_pylist(), tokens.take(pa.array([30, 5, 6, 39])).to_pylist()]
    assert calls == ["read"] * 5
