"""Bounded-space online packing of tokenized documents into sequences.

Each partition keeps a fixed number of open windows. A document's full windows are sequences at once; its
rest is placed in the open window where it fits best, and if it fits nowhere the fullest window is closed.
What is open at a partition's end is merged with that of neighbouring partitions, in groups of bounded
size: pieces of the longest first, best fit. A merged window that stays far from full is cut into powers
of two, which need no padding. No other document shorter than a window is ever cut.

Edge cases: a null or empty text gives the end token alone; texts of any length are cut at full windows;
repeated rows and ties are packed one by one in the order in which Spark reads them; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import ctypes
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

WINDOW = 4096
#: Windows that a partition keeps open.
OPEN = 64
#: Partitions whose leftovers are merged in one task: at most OPEN * GROUP windows.
GROUP = 4
#: Bytes of text that are tokenized at once.
CHUNK = 1 << 20
END = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK):
    """Slices of a batch whose texts are of `most` bytes, or one longer text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto
    give_back()


def give_back() -> None:
    """Returns free memory to the system, as Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: Words that the tokenizer's rules leave in one piece, perhaps with one run of punctuation behind them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,!?;:"
#: Words and their bytes that a task remembers, besides those of one chunk.
KNOWN, KNOWN_BYTES = 400_000, 16 << 20


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class WordTokenizer:
    """Tokenizes batches; with a vocabulary of word ends each different word is encoded only once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        give_back()
        self.by_words = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        """Remembers no words: the words, all their ids one after another, where each word's begin and how many they are."""
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.begin = self.count = np.zeros(0, np.int64)

    def _remember(self, words: pa.Array, n_pieces: int) -> np.ndarray:
        """The numbers of different words in what is remembered; the first n_pieces are encoded as pieces where they are new."""
        words = words.cast(pa.large_string())
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            kept = words.take(pa.array(new))
            texts, n = kept.to_pylist(), int(np.searchsorted(new, n_pieces))
            ids = [*self._pieces(texts[:n]), *self.encode(texts[n:])]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            at[new] = len(self.known) + np.arange(len(new))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))])
            self.known = pa.concat_arrays([self.known, kept])
        return at

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for k in range(0, len(texts), 5000):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + 5000], add_special_tokens=False)]
        return out

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of lower-case pieces that no rule of the tokenizer parts: its model alone does them."""
        model, letters = self.tokenizer.model, self.letters
        return [[t.id for t in model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(letters))] for p in pieces]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words without white space, one after another; where each word's begin, and how many they are.

        A word is cut into its letters in lower case and the marks behind them where the tokenizer's rules part
        them too; such letters, marks and whole other words are remembered from chunk to chunk.
        """
        if len(self.known) > KNOWN or self.known.nbytes > KNOWN_BYTES:
            self._forget()
        core = pc.utf8_rtrim(words, MARKS)
        # Only words that were of these letters before lower-casing, which may turn others into them.
        simple = pc.match_substring_regex(core, f"^[{LETTERS}]+$")
        marked = pc.and_(simple, pc.not_equal(pc.binary_length(core), pc.binary_length(words)))
        coded = pc.dictionary_encode(pc.utf8_lower(core.filter(simple)))
        tails = pc.dictionary_encode(pc.replace_substring_regex(words.filter(marked), f"^.*[^{MARKS}]", ""))
        simple, marked = simple.to_numpy(zero_copy_only=False), marked.to_numpy(zero_copy_only=False)
        # A word is one list of ids, or that of its letters and that of its marks.
        cores, marks = coded.dictionary, tails.dictionary
        place = self._remember(pa.concat_arrays([cores, marks, words.filter(pa.array(~simple))]), len(cores) + len(marks))
        first, second = np.empty(len(words), np.int64), np.full(len(words), -1)
        first[simple] = place[coded.indices.to_numpy(zero_copy_only=False)]
        first[~simple] = place[len(cores) + len(marks) :]
        second[marked] = place[len(cores) + tails.indices.to_numpy(zero_copy_only=False)]
        two = second >= 0
        count = self.count[first] + np.where(two, self.count[second] if len(self.count) else 0, 0)
        starts = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.uint32)
        for at, src in ((starts, first), (starts[two] + self.count[first[two]], second[two])):
            m = self.count[src]
            inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat(at, m) + inside] = self.ids[np.repeat(self.begin[src], m) + inside]
        return out, starts, count


def tokenize(tokenizer: WordTokenizer, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, each with the end id, and where each text's begin (one more than texts)."""
    texts = pc.fill_null(texts, "")
    if not tokenizer.by_words:
        each = [[*ids, end] for ids in tokenizer.encode(texts.to_pylist())]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    parts = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(parts.flatten())
    table_ids, begins, counts = tokenizer.words(coded.dictionary)
    which = coded.indices.to_numpy(zero_copy_only=False)
    bounds = np.asarray(parts.offsets)
    bounds = (bounds - bounds[0]).astype(np.int64)
    n = counts[which] if len(which) else np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(n)])
    per_text = upto[bounds[1:]] - upto[bounds[:-1]] + 1
    starts = np.concatenate([[0], np.cumsum(per_text)])
    out = np.full(int(starts[-1]), end, np.uint32)
    # Every word's ids, moved on by the end ids of the texts before it.
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(int(upto[-1]))
    source = at + np.repeat((begins[which] if len(which) else n) - upto[:-1], n)
    out[at + np.repeat(text_of, n)] = table_ids[source]
    return out, starts


class _Windows:
    """Open windows by the room that is left, smallest first."""

    def __init__(self, most: int | None):
        self.most, self.room, self.made = most, [], 0

    def place(self, piece: tuple, n: int):
        """Puts a piece in; returns the window that had to be closed for it, if any."""
        closed = None
        i = bisect.bisect_left(self.room, (n, -1))
        if i < len(self.room):
            left, _, pieces = self.room.pop(i)
        else:
            if self.most and len(self.room) >= self.most:
                closed = self.room.pop(0)[2]
            left, pieces = WINDOW, []
        pieces.append(piece)
        self.made += 1
        bisect.insort(self.room, (left - n, self.made, pieces))
        return closed


def _row(doc, start, ids, total, sequence, offset, is_open, keep):
    raw = ids.astype("<u4").tobytes()
    return (doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if keep or is_open else None, is_open)


def _batches(rows, schema, size=2000):
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


ARROW = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary()), ("open", pa.bool_())])


def pack(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids also ids (little-endian unsigned 32-bit)."""

    def online(batches):
        tokenizer, windows = WordTokenizer(tokenizer_path), _Windows(OPEN)
        number = TaskContext.get().partitionId() << 32

        def rows():
            nonlocal number
            for batch in batches:
                for part in chunks(batch):
                    ids, starts = tokenize(tokenizer, part.column("text"), end)
                    for k, doc in enumerate(part.column("doc_id").to_pylist()):
                        own = ids[starts[k] : starts[k + 1]]
                        whole = len(own) // WINDOW * WINDOW
                        for s in range(0, whole, WINDOW):
                            yield _row(doc, s, own[s : s + WINDOW], len(own), number, 0, False, keep_ids)
                            number += 1
                        if whole < len(own):
                            rest = own[whole:].copy()
                            if closed := windows.place((doc, whole, rest, len(own)), len(rest)):
                                yield from emit(closed, False)
            for _, _, pieces in windows.room:
                yield from emit(pieces, pieces is not None and sum(len(p[2]) for p in pieces) < WINDOW)

        def emit(pieces, is_open):
            nonlocal number
            offset = 0
            for doc, start, own, total in pieces:
                yield _row(doc, start, own, total, number, offset, is_open, keep_ids)
                offset += len(own)
            number += 1

        yield from _batches(rows(), ARROW)

    def merged(batches):
        group, pieces, done = None, [], 0

        def flush():
            nonlocal done
            windows = _Windows(None)
            pieces.sort(key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1]))
            for p in pieces:
                windows.place(p, len(p[2]))
            for left, _, own in windows.room:
                sizes = [WINDOW - left]
                if left > WINDOW // 16:
                    sizes = [1 << b for b in range(WINDOW.bit_length(), -1, -1) if (WINDOW - left) >> b & 1]
                queue = own[::-1]
                for size in sizes:
                    offset = 0
                    while offset < size:
                        doc, start, ids, total = queue.pop()
                        if len(ids) > size - offset:
                            queue.append((doc, start + size - offset, ids[size - offset :], total))
                            ids = ids[: size - offset]
                        yield _row(doc, start, ids, total, (1 << 62) + (group << 32) + done, offset, False, keep_ids)
                        offset += len(ids)
                    done += 1

        def rows():
            nonlocal group, pieces, done
            for batch in batches:
                for g, doc, start, raw, total in zip(*[batch.column(c).to_pylist() for c in ("bin", "doc_id", "start", "ids", "doc_tokens")]):
                    if g != group:
                        yield from flush()
                        group, pieces, done = g, [], 0
                    pieces.append((doc, start, np.frombuffer(raw, "<u4"), total))
            yield from flush()

        yield from _batches(rows(), ARROW)

    first = cut(docs.select("doc_id", "text").mapInArrow(online, SCHEMA))
    leftover = first.filter("open").withColumn("bin", F.expr(f"cast(shiftright(sequence_id, 32) div {GROUP} as int)"))
    groups = max(1, -(-first.rdd.getNumPartitions() // GROUP))
    # A bin is a partition of its own.
    merge = leftover.repartitionById(groups, F.col("bin")).mapInArrow(merged, SCHEMA)
    return first.filter("not open").unionByName(merge).drop("open", *([] if keep_ids else ["ids"]))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
