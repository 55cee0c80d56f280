"""Substring dedup: words covered by a window of 13 words that also starts in an earlier document go.

Anchors lie at difference-cover positions: places that are 0, 1 or 3 modulo 7 in a document. Any two
equal windows of 13 words share an anchor of 7 words that is aligned in both, because the cover holds
two positions for every difference modulo 7. Only anchors are hashed and shuffled for all text; where an
anchor is found again, matches are extended to whole windows, whose smallest document is then settled.

The flow is one query: texts are dealt to units of about `UNIT_BYTES` by a hash (that exchange is used three times),
units send each different anchor once, as four bytes to a bucket by its hash, and get a bit back for it;
they send each different window near a repeated anchor once, with its smallest doc_id, and get the
smallest of all back. What many documents share is so merged in each unit first, and no task's input
grows with how often a passage is found, but with the number of units. Windows are told apart by 96-bit
hashes of their words; anchors are only a filter, so their short hashes cost nothing but work.

Edge cases: null and empty texts have no words; texts of fewer than 13 words keep them all; documents
with equal doc_id don't remove each other's words; a null doc_id is no earlier document and loses nothing;
texts are whole, however long; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .packing import chunks

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text in a unit, about; tasks hold one unit at a time.
UNIT_BYTES = 16 << 20
PAYLOAD = "unit int, bucket int, data binary"
ARROW = pa.schema([("unit", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
NEVER = np.int64(2**63 - 1)


def _multipliers(salt: int, n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{salt}:{i}") | 1 for i in range(n)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Unit:
    """The words of some documents, one after another, as hashes."""

    def __init__(self, texts: pa.Table | pa.RecordBatch):
        hashes, counts, ids = [], [], []
        for batch in texts.to_batches() if isinstance(texts, pa.Table) else [texts]:
            for part in chunks(batch):
                words = pc.ascii_split_whitespace(pc.fill_null(part.column("text"), ""))
                coded = pc.dictionary_encode(words.flatten())
                distinct = coded.dictionary.cast(pa.binary()).to_pylist()
                h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
                there = np.array([len(w) > 0 for w in distinct], bool)
                which = coded.indices.to_numpy(zero_copy_only=False)
                kept = there[which] if len(distinct) else np.zeros(0, bool)
                offsets = np.asarray(words.offsets).astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
                hashes.append(h[which[kept]] if len(distinct) else np.zeros(0, np.uint64))
                counts.append(np.diff(upto))
                ids.append(pc.fill_null(part.column("doc_id"), NEVER).to_numpy(zero_copy_only=False))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.words, self.n, self.ids = cat(hashes, np.uint64), cat(counts, np.int64), cat(ids, np.int64)
        self.begin = np.cumsum(self.n) - self.n

    def _sum(self, at: np.ndarray, length: int, salt: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j, m in enumerate(_multipliers(salt, length)):
            out += self.words[at + j] * m
        return _mix(out)

    def _places(self, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in documents of a window and more, each `last` words before the end at least, and their documents' numbers."""
        doc = np.flatnonzero(self.n >= WINDOW)
        span = self.n[doc] - last + 1
        upto = np.cumsum(span)
        place = np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - span, span)
        return place, np.repeat(doc, span)

    def anchors(self, buckets: int):
        """Positions of anchors; the different keys (bucket and 32 bits), sorted; each anchor's key; how many share it."""
        place, doc = self._places(ANCHOR)
        covered = np.isin(np.arange(PERIOD), COVER)[place % PERIOD]
        at = (self.begin[doc] + place)[covered]
        h = self._sum(at, ANCHOR, 1)
        bucket = (h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
        keys, which, count = np.unique(bucket << np.uint64(32) | h & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)
        return at, keys, which, count

    def windows_near(self, at: np.ndarray):
        """Starts of all windows that hold an anchor at one of the given positions, and their documents' numbers."""
        edge = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(edge, np.maximum(at - (PERIOD - 1), 0), 1)
        np.add.at(edge, at + 1, -1)
        near = np.cumsum(edge)[:-1] > 0
        place, doc = self._places(WINDOW)
        start = self.begin[doc] + place
        kept = near[start]
        return start[kept], doc[kept]


def _slices(buckets_of: np.ndarray):
    """bucket, begin and end of the runs of a sorted array."""
    if len(buckets_of):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(buckets_of)) + 1, [len(buckets_of)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(buckets_of[a]), a, b


def _payloads(rows) -> pa.Table:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)


def _by_key(batches, key: str):
    """(key, [(unit, bucket, data)]) of rows that are sorted by key."""
    now, rows = None, []
    for batch in batches:
        for unit, bucket, data in zip(*[batch.column(c).to_pylist() for c in ("unit", "bucket", "data")]):
            k = bucket if key == "bucket" else unit
            if k != now and rows:
                yield now, rows
                rows = []
            now = k
            rows.append((unit, bucket, data))
    if rows:
        yield now, rows


WINDOW_ROW = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("more", "u1")])


def remove_repeats(docs: DataFrame, partitions: int | None = None, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (spans of words: start, length); with text also the kept words, joined by a space."""
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units, buckets = max(3 * parts, size // UNIT_BYTES), parts
    texts = (
        docs.select("doc_id", "text")
        .withColumn("unit", F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).cast("int"))
        .repartition(parts, "unit")
    )

    def send_anchors(key, t):
        unit = key[0].as_py()
        _, keys, _, _ = Unit(t).anchors(buckets)
        return _payloads((unit, b, (keys[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()) for b, i, j in _slices((keys >> np.uint64(32)).astype(np.int64)))

    def find_repeated(batches):
        for _, rows in _by_key(batches, "bucket"):
            arrays = [np.frombuffer(d, "<u4") for _, _, d in rows]
            every = np.sort(np.concatenate(arrays))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            bits = [np.packbits(np.isin(a, twice, assume_unique=True)).tobytes() for a in arrays]
            yield from _payloads((u, b, d) for (u, b, _), d in zip(rows, bits)).to_batches()

    def send_windows(key, t, found):
        if not t.num_rows:
            return _payloads([])
        unit, u = key[0].as_py(), Unit(t)
        at, keys, which, count = u.anchors(buckets)
        again = count > 1
        bits = dict(zip(found.column("bucket").to_pylist(), found.column("data").to_pylist()))
        for b, i, j in _slices((keys >> np.uint64(32)).astype(np.int64)):
            if b in bits:
                again[i:j] |= np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i).astype(bool)
        start, doc = u.windows_near(at[again[which]])
        h, g, ids = u._sum(start, WINDOW, 2), (u._sum(start, WINDOW, 3) >> np.uint64(32)).astype(np.uint32), u.ids[doc]
        order = np.lexsort((ids, g, h))
        h, g, ids = h[order], g[order], ids[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        last = np.append(begin[1:], len(h)) - 1
        out = np.zeros(len(begin), WINDOW_ROW)
        if len(begin):
            out["h"], out["g"], out["doc"], out["more"] = h[begin], g[begin], ids[begin], ids[last] > ids[begin]
        bucket = ((out["h"] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        return _payloads((unit, b, out[i:j].tobytes()) for b, i, j in _slices(bucket))

    def settle(batches):
        for _, rows in _by_key(batches, "bucket"):
            arrays = [np.frombuffer(d, WINDOW_ROW) for _, _, d in rows]
            every = np.concatenate(arrays)
            order = np.lexsort((every["doc"], every["g"], every["h"]))
            h, g = every["h"][order], every["g"][order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            least = np.empty(len(every), np.int64)
            least[order] = every["doc"][order][np.flatnonzero(first)][np.cumsum(first) - 1]
            back = (least < every["doc"]) | (every["more"] > 0)
            every = every.copy()
            every["doc"] = least
            out, at = [], 0
            for (u, b, _), a in zip(rows, arrays):
                mine = every[at : at + len(a)][back[at : at + len(a)]]
                at += len(a)
                if len(mine):
                    out.append((u, b, mine.tobytes()))
            yield from _payloads(out).to_batches()

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), *([("text", pa.string())] if text else [])])

    def remove(t, found):
        u = Unit(t)
        gone = np.zeros(len(u.words) + 1, np.int32)
        data = b"".join(found.column("data").to_pylist())
        if data:
            known = np.frombuffer(data, WINDOW_ROW)
            known = known[np.lexsort((known["g"], known["h"]))]
            place, doc = u._places(WINDOW)
            start = u.begin[doc] + place
            h = u._sum(start, WINDOW, 2)
            lo = np.searchsorted(known["h"], h)
            hit = np.flatnonzero(known["h"][np.minimum(lo, len(known) - 1)] == h)
            start, doc, lo = start[hit], doc[hit], lo[hit]
            g = (u._sum(start, WINDOW, 3) >> np.uint64(32)).astype(np.uint32)
            while ((ahead := (known["g"][lo] != g) & (lo + 1 < len(known)) & (known["h"][np.minimum(lo + 1, len(known) - 1)] == known["h"][lo]))).any():
                lo = lo + ahead  # equal 64 bits with other words
            covered = (known["g"][lo] == g) & (known["doc"][lo] < u.ids[doc]) & (u.ids[doc] != NEVER)
            np.add.at(gone, start[covered], 1)
            np.add.at(gone, start[covered] + WINDOW, -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), u.begin) * (u.n > 0) if len(u.n) else np.zeros(0, np.int64)
        rows = []
        for i, (doc, raw) in enumerate(zip(t.column("doc_id").to_pylist(), t.column("text").cast(pa.binary()).to_pylist())):
            words, spans = (raw or b"").split(), []
            if removed[i]:
                mask = gone[u.begin[i] : u.begin[i] + u.n[i]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans = [{"start": a, "length": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
                words = [w for w, m in zip(words, mask.tolist()) if not m]
            kept = b" ".join(words)
            rows.append((doc, int(u.n[i]), int(removed[i]), hashlib.sha256(kept).hexdigest(), spans, *([kept.decode()] if text else [])))
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

    by_bucket = lambda x: x.repartition(parts, "bucket").sortWithinPartitions("bucket")
    anchors = texts.groupBy("unit").applyInArrow(send_anchors, PAYLOAD)
    repeated = by_bucket(anchors).mapInArrow(find_repeated, PAYLOAD)
    windows = texts.groupBy("unit").cogroup(repeated.repartition(parts, "unit").groupBy("unit")).applyInArrow(send_windows, PAYLOAD)
    settled = by_bucket(windows).mapInArrow(settle, PAYLOAD)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: long, length: long>>" + ", text string" * text
    return texts.groupBy("unit").cogroup(settled.repartition(parts, "unit").groupBy("unit")).applyInArrow(remove, out)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")
