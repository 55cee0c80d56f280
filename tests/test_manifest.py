from dataclasses import replace
from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.sources import manifest as M
from tidemark.sources.commit import Conflict, ManifestStore, StoreError, retry

at = lambda s: datetime.fromtimestamp(s, UTC)
PAYLOAD = M.Any("my_type", b"my_value")
CREATED = M.Task("00112233-4455-6677-8899-aabbccddeeff", at(1700000000), at(1700000060), 3, 0, PAYLOAD)
RUNNING = replace(CREATED, status=1, worker_id="ffeeddcc-bbaa-9988-7766-554433221100", last_heartbeat=at(1700000120), lease_expires_at=at(1700000180))
FAILED = replace(CREATED, status=2, error_message="task failed", details=PAYLOAD)
HEADER = M.Header("127.0.0.1", 8080, 42)
IDS = "7766554433221100 ffeeddccbbaa9988"
TIMES = "0068e5cf8b010000 6052e6cf8b010000 0300 0000"
ANY = "6d795f7479706500 08000000 6d795f76616c7565"
CREATED_HEX = f"{IDS} {TIMES} 00 {ANY}"
RUNNING_HEX = f"{IDS} {TIMES} 01 8899aabbccddeeff 0011223344556677 c03ce7cf8b010000 2027e8cf8b010000 {ANY}"
FAILED_HEX = f"{IDS} {TIMES} 02 7461736b206661696c656400 {ANY} {ANY}"


@pytest.mark.parametrize("task,text", [(CREATED, CREATED_HEX), (RUNNING, RUNNING_HEX), (FAILED, FAILED_HEX)])
def test_task_bytes(task, text):
    raw = bytes.fromhex(text)
    body = b"TASK\x01\0\0\0" + raw
    assert M.Manifest(HEADER, [task]).to_bytes()[16:] == body + bytes(-len(body) % 8)
    assert M.decode_tasks(body) == [task]


def test_header_bytes():
    h = M.Header("1.2.3.4", 0x0506, 0x0708090A0B0C0D0E, M.ZSTD)
    raw = bytes.fromhex("01040302010605" + "0e0d0c0b0a09080701")
    assert h.to_bytes() == raw and M.Header.from_bytes(raw) == h
    assert h.url == "http://1.2.3.4:1286"
    for bad in (b"\0" + raw[1:], raw[:15]):
        with pytest.raises(M.WireError):
            M.Header.from_bytes(bad)


def test_manifest_bytes():
    m = M.Manifest(HEADER, [CREATED, RUNNING])
    raw = m.to_bytes()
    assert len(raw) == 176
    assert raw.hex() == (bytes.fromhex("010100007f901f2a00000000000000 00") + b"TASK\x02\0\0\0" + bytes.fromhex(CREATED_HEX) + bytes.fromhex(RUNNING_HEX) + bytes(6)).hex()
    packed = M.Manifest(replace(HEADER, compression=M.ZSTD), m.tasks)
    assert M.Manifest.from_bytes(packed.to_bytes()).tasks == m.tasks
    with pytest.raises(M.WireError):
        M.Manifest.from_bytes(raw[:60])


times = st.integers(-(10**12), 10**13).map(lambda ms: datetime.fromtimestamp(ms // 1000, UTC).replace(microsecond=ms % 1000 * 1000))
texts = st.text(st.characters(codec="utf-8", exclude_characters="\0"))
anys = st.builds(M.Any, texts, st.binary())
tasks = st.builds(M.Task, st.uuids().map(str), times, times, st.integers(0, 65535), st.integers(0, 65535), anys)


@given(st.lists(tasks, max_size=4), st.sampled_from([M.NONE, M.ZSTD]))
def test_round_trip(ts, compression):
    m = M.Manifest(replace(HEADER, compression=compression), ts)
    assert M.Manifest.from_bytes(m.to_bytes()) == m


def test_commits(tmp_path):
    store = ManifestStore(str(tmp_path))
    with pytest.raises(StoreError):
        store.path()
    m, first = store.load_or_init(M.Header("127.0.0.1", 8080, 0))
    assert (m.tasks, store.load_header().epoch) == ([], 0)
    m.tasks.append(CREATED)
    first.update(m)
    first.update(m)
    taken, second = store.load_or_init(M.Header("127.0.0.1", 9090, 0))
    assert taken.tasks == [CREATED] and (taken.header.port, taken.header.epoch) == (9090, 1)
    with pytest.raises(Conflict):
        first.update(m)
    with pytest.raises(Conflict):
        first.update(m)
    assert store.load_header() == taken.header
    second.update(taken)


def test_reading_with_spark(spark, tmp_path):
    store = ManifestStore(str(tmp_path))
    m, writer = store.load_or_init(replace(HEADER, epoch=2**63 + 5))
    m.tasks += [CREATED, RUNNING, FAILED]
    writer.update(m)
    head = M.read_headers(spark, store.path()).first()
    assert (head.address, head.port, int(head.epoch), head.broker_url) == ("127.0.0.1", 8080, 2**63 + 5, "http://127.0.0.1:8080")
    spark.dataSource.register(M.ManifestSource)
    for df in (M.read_tasks(spark, store.path()), spark.read.format("tidemark_manifest").load(store.path())):
        rows = df.orderBy("status").collect()
        assert [r.status for r in rows] == [0, 1, 2] and rows[0].payload.value == b"my_value"
        assert rows[1].worker_id == RUNNING.worker_id and rows[2].error_message == "task failed"


def test_retry():
    seen, pauses = [], []

    def call():
        seen.append(1)
        if len(seen) < 3:
            raise OSError
        return "done"

    assert retry(call, sleep=pauses.append) == "done" and pauses == [0.05, 0.1]
