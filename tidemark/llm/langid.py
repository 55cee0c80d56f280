"""Language identification by a mixture of languages, inferred for each document.

A word's likelihood under a language is that of its letter trigrams (lower case, with word borders), as
counted in labelled documents. A document is a mixture over its words, of all learned languages and of a
background in which all trigrams are alike, for words of no learned language. Its set starts with the best
single one; the one that promises the largest gain is added as long as the likelihood, less half a logarithm
of the number of words for each (the Bayesian information criterion), improves. Expectation maximisation
estimates the proportions, until none of a document's moves by more than `STEADY`. They are of all words with a letter, so those of the languages add up to less
than 1 where the background has a share.

Learning takes a bounded sample of at most `SAMPLE` labelled documents, whole texts, and gives one table
of counts, of at most `BUCKETS` rows for each language; that table is broadcast.

Edge cases: a null text, one without a letter, or one that the background alone explains, is `und` with
score 0 and no languages, as is every text where nothing could be learned; long texts are whole; ties go to the first language by name;
repeated rows get equal results; an empty table gives an empty result; other columns stay, except that
languages, lang_pred and score are replaced. A text of words of one likelihood in all languages takes
`ROUNDS` rounds at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_ids, columns, table
from .packing import chunks

SAMPLE = 20_000
BUCKETS = 1 << 17
#: Expectation maximisation ends when no proportion moves by more in a round, or after so many rounds.
STEADY, ROUNDS = 1e-3, 200
UNKNOWN = "und"


def trigrams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' letter trigrams, the word of each, and which words have a letter."""
    joined = " " + " ".join(pc.utf8_lower(words).to_pylist()) + " "
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    present = np.flatnonzero(np.bincount(c, minlength=1))
    letter = np.zeros(int(present[-1]) + 1, bool)
    letter[present] = [chr(x).isalpha() for x in present.tolist()]
    mine = letter[c]
    # White space of other kinds stays inside a word, so words are told apart by the joining space's place.
    lengths = pc.utf8_length(pc.utf8_lower(words)).to_numpy(zero_copy_only=False).astype(np.int64)
    word = np.full(len(c), -1)
    begins = np.cumsum(lengths + 1) - lengths
    word[np.arange(int(lengths.sum())) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)] = np.repeat(np.arange(len(lengths)), lengths)
    c = np.where(mine, c, 0).astype(np.uint32)
    at = np.flatnonzero(mine)
    h = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ c[at + 1] * np.uint32(0xC2B2AE3D)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    has = np.zeros(len(lengths), bool)
    has[word[at]] = True
    return (h >> np.uint32(15)).astype(np.int64) & (BUCKETS - 1), word[at], has


def split(texts: pa.Array):
    """Different words, the word of each place, and where each text's places begin."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.dictionary_encode(parts.flatten())
    offsets = np.asarray(parts.offsets).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: BUCKETS rows, a column for each language."""
        self.languages, self.counts = languages, counts
        total = counts.sum(axis=0)
        self.log = np.log((counts + 0.1) / (total + 0.1 * BUCKETS)).astype(np.float32)
        #: Of a trigram in the background.
        self.background = -float(np.log(BUCKETS))

    def predict(self, texts: pa.Array) -> list[list[tuple[str, float]]]:
        """For each text its languages with their proportions, the largest first; none if it has no letter or is background alone."""
        words, which, bounds = split(texts)
        n_docs, n_lang = len(bounds) - 1, len(self.languages)
        if not n_lang or not len(words):
            return [[]] * n_docs
        bucket, word, has = trigrams(words)
        score = np.stack([np.bincount(word, self.log[bucket, k], len(words)) for k in range(n_lang)], axis=1)
        score = np.concatenate([score, np.bincount(word, minlength=len(words))[:, None] * self.background], axis=1)
        score = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -60.0)).astype(np.float32)
        doc = np.repeat(np.arange(n_docs), np.diff(bounds))
        kept = has[which]
        which, doc = which[kept], doc[kept]
        if not len(doc):
            return [[]] * n_docs
        there = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
        docs, n = doc[there], np.diff(np.append(there, len(doc)))
        p = score[which] + np.float32(1e-12)
        log = np.log(score + np.float32(1e-12))[which]
        fits = np.add.reduceat(log, there, axis=0, dtype=np.float64)
        best = fits.max(axis=1) - 0.5 * np.log(np.maximum(n, 2))
        out = np.zeros((len(docs), n_lang + 1), np.float32)
        out[np.arange(len(docs)), fits.argmax(axis=1)] = 1
        # Rows of out that may still improve, and the words of them.
        left, mine = np.arange(len(docs)), np.arange(len(which))
        for m in range(2, n_lang + 2):
            sizes = n[left]
            begin = np.cumsum(sizes) - sizes
            shares = out[left]
            now = np.log((p[mine] * np.repeat(shares, sizes, axis=0)).sum(axis=1))
            gain = np.add.reduceat(np.maximum(log[mine] - now[:, None], 0), begin, axis=0)
            gain[shares > 0] = -1
            added = gain.argmax(axis=1)
            shares = shares * np.float32(1 - 1 / m)
            shares[np.arange(len(left)), added] = 1 / m
            # The set's m columns alone.
            columns = np.sort(np.argsort(shares <= 0, axis=1, kind="stable")[:, :m], axis=1)
            q = np.take_along_axis(p[mine], np.repeat(columns, sizes, axis=0), axis=1)
            s, fit = self._shares(q, begin, sizes, np.take_along_axis(shares, columns, axis=1))
            worth = fit - 0.5 * m * np.log(np.maximum(sizes, 2))
            better = worth > best[left] + 1e-9
            full = np.zeros_like(shares)
            np.put_along_axis(full, columns, np.maximum(s, 1e-9), axis=1)
            mine = mine[np.repeat(better, sizes)]
            left = left[better]
            best[left], out[left] = worth[better], full[better]
            if not len(left):
                break
        found: list = [[]] * n_docs
        for i, d in enumerate(docs.tolist()):
            pairs = [(self.languages[k], float(out[i, k])) for k in np.flatnonzero(out[i, :n_lang]).tolist()]
            found[d] = sorted(pairs, key=lambda x: (-x[1], x[0]))
        return found

    @staticmethod
    def _shares(p, there, n, shares):
        """Expectation maximisation from shares; the proportions and the log likelihood."""
        shares = shares.astype(np.float32)
        # Documents that still move, their words, and where each one's begin.
        left, q, sizes, begin = np.arange(len(n)), p, n, there
        for k in range(ROUNDS):
            r = q * np.repeat(shares[left], sizes, axis=0)
            r /= r.sum(axis=1, keepdims=True)
            new = np.add.reduceat(r, begin, axis=0) / sizes[:, None].astype(np.float32)
            moves = np.abs(new - shares[left]).max(axis=1) > STEADY
            shares[left] = new
            if not moves.any():
                break
            if k % 4 == 3 and not moves.all():
                left, q, sizes = left[moves], q[np.repeat(moves, sizes)], sizes[moves]
                begin = np.cumsum(sizes) - sizes
        fit = np.add.reduceat(np.log((p * np.repeat(shares, n, axis=0)).sum(axis=1, dtype=np.float64) + 1e-30), there)
        return shares, fit


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """From text and lang of at most `sample` documents."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = known.select("doc_id", "text", "lang").join(F.broadcast(bounded_ids(known, sample)), "doc_id")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch):
                langs = part.column("lang").to_pylist()
                words, which, bounds = split(part.column("text"))
                if not len(words):
                    continue
                bucket, word, _ = trigrams(words)
                lang_of = np.repeat(np.arange(len(langs)), np.diff(bounds))
                for lang in set(langs):
                    mine = np.array([x == lang for x in langs])
                    times = np.bincount(which[mine[lang_of]], minlength=len(words))
                    sums[lang] = sums.get(lang, 0) + np.bincount(bucket, times[word], BUCKETS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(s[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    if langs:
        col = np.searchsorted(np.array(langs), np.array(rows.column("lang").to_pylist()))
        counts[rows.column("bucket").to_numpy(), col] = rows.column("n").to_numpy()
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with languages (lang and proportion, the largest first), lang_pred and score (its proportion)."""
    added = ("languages", "lang_pred", "score")
    kept = [f for f in docs.schema.fields if f.name not in added]
    # Numbered names inside, as names with a dot can't be passed on.
    inner = [f"c{i}" for i in range(len(kept))]
    text_at = inner[[f.name for f in kept].index(text)]
    schema = T.StructType([*[T.StructField(c, f.dataType, f.nullable) for c, f in zip(inner, kept)], *T._parse_datatype_string("languages array<struct<lang: string, proportion: double>>, lang_pred string, score double").fields])
    # Arrays alone are broadcast, as the class itself travels with the task.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.counts))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("proportion", pa.float64())]))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            for part in chunks(batch, text_at):
                found = m.predict(part.column(text_at))
                own = [
                    pa.array([[{"lang": lang, "proportion": p} for lang, p in x] for x in found], kind),
                    pa.array([x[0][0] if x else UNKNOWN for x in found], pa.string()),
                    pa.array([min(1.0, x[0][1]) if x else 0.0 for x in found], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in inner], *own], [f.name for f in schema.fields])

    numbered = docs.select(*[c.alias(n) for c, n in zip(columns(docs, added), inner)])
    return numbered.mapInArrow(run, schema).toDF(*[f.name for f in kept], *added)


def held_out(doc_id=None):
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if doc_id is None else doc_id
    return F.crc32(key) % 4 == 2


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
