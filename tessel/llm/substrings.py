"""Substring dedup with difference-cover anchors.

A window is ``window`` consecutive words. Cover positions are those whose
index modulo ``period`` lies in a difference cover, so for any two positions
some shift below ``period`` takes both onto the cover. Short hashes are made
at cover positions only; two equal windows therefore share an aligned anchor.
Anchors found in two documents mark the places where equal windows can be, and
only there the match is extended to whole windows, which are compared by
128-bit hashes against the smallest document that holds them.

Both comparisons go through one exchange of hash columns packed by bucket.
Hashes that a batch holds many times are reduced to one entry before they are
sent, so a passage in a third of all documents sends one entry a batch.

Edge cases: a null text has no words; a text shorter than the window keeps all
its words; a null doc_id is no source and loses nothing; rows with equal
doc_id do not count against each other; ties do not arise, as only smaller
ids count; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bucket_count, fold, mix, prepare, released, text_bytes

WINDOW = 50

#: A perfect difference set modulo 31: every residue is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

#: Bytes of text that are worked on at once, and of compressed input to a bucket.
FLUSH_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20

_SEED2 = np.uint64(0xA0761D6478BD642F)


class Words:
    """The words of several documents as one array of hashes."""

    def __init__(self, hashes: WordHashes, raws: list[bytes]):
        each = [hashes.of(x.split()) for x in raws]  # words of one document at a time
        self.counts = np.array([len(h) for h in each], np.int64)
        self.h = np.concatenate(each) if raws else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(raws)), self.counts)
        self.start = np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.pos = np.arange(len(self.h)) - self.start
        self.left = np.repeat(self.counts, self.counts) - self.pos


def anchors(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of documents that have a window, and their hashes."""
    size = window - PERIOD + 1
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    at = np.flatnonzero(on[words.pos % PERIOD] & (words.left >= size) & (words.left + words.pos >= window))
    acc = np.full(len(at), np.uint64(size))
    for k in range(size):
        acc = fold(acc, words.h[at + k])
    return at, acc


def window_hashes(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the windows that start at ``at``, from hashes of power-of-two blocks."""
    level, size, acc, shift = h, 1, np.full(len(at), np.uint64(window)), 0
    while True:
        if window & size:
            acc = fold(acc, level[at + shift])
            shift += size
        size *= 2
        if size > window:
            return acc
        half = size // 2
        level = np.concatenate([fold(level[:-half], level[half:]), level[len(level) - half :]]) if len(level) > half else level


def _rows(bucket: np.ndarray, n: int, cols: list[np.ndarray]) -> list[tuple]:
    """Entries grouped by bucket: (bucket, column bytes...)."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    out = []
    for b in range(n):
        if ends[b] < ends[b + 1]:
            part = order[ends[b] : ends[b + 1]]
            out.append((b, *(c[part].tobytes() for c in cols)))
    return out


EXCHANGE = "bucket int, a binary, b binary, doc binary, pos binary"
MARKS = "doc_id long, marks binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "a", "b", "doc", "pos"])


def _marks(doc: np.ndarray, value: np.ndarray) -> list[tuple[int, bytes]]:
    """One row per document with its values, packed."""
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    return [(int(doc[a]), value[a:b].tobytes()) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True)] if len(doc) else []


def _own(marks: list[tuple[int, bytes]], n: int, salt: int) -> list[tuple]:
    """What a batch settled itself travels with the rest, dealt over the buckets."""
    return [((k + salt) % n, None, None, np.array([doc], "<i8").tobytes(), value) for k, (doc, value) in enumerate(marks)]


def _texts(batches: Iterator[pa.RecordBatch], *columns: int, flush: int = FLUSH_BYTES, rows: int = 1 << 31) -> Iterator[tuple[list, ...]]:
    """Columns of the batches, gathered up to about ``flush`` bytes of the last one, or ``rows`` rows."""
    held: tuple[list, ...] = tuple([] for _ in columns)
    size = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 250):
            part = batch.slice(k, 250)
            for into, c in zip(held, columns, strict=True):
                into += part.column(c).to_pylist()
            size += part.column(columns[-1]).nbytes
            if size >= flush or len(held[0]) >= rows:
                yield held
                held, size = tuple([] for _ in columns), 0
    if held[0]:
        yield held


def _first_of_runs(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For sorted entries, where a new key begins."""
    new = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        new[1:] = ~same
    return new


def _send_anchors(n: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for salt, (ids, raws) in enumerate(_texts(batches, 0, 1)):
            words = Words(hashes, raws)
            at, h = anchors(words, window)
            doc = np.array(ids, np.int64)[words.doc[at]]
            order = np.lexsort((doc, h))
            order = order[_first_of_runs(order, h, doc)]  # once a document
            new = _first_of_runs(order, h)
            group = np.cumsum(new) - 1
            many = np.bincount(group, minlength=1)[group] > 1
            own = order[many]  # in two documents here: no need to ask
            one = order[new]
            known = many[new]
            bucket = (h[one] >> np.uint64(40)).astype(np.int64) % n
            rows = [(b, a, k, d, None) for b, a, k, d in _rows(bucket, n, [h[one], known.astype(np.uint8), doc[one]])]
            yield _batch(rows + _own(_marks(doc[own], h[own]), n, salt))

    return released(run)


@released
def _meet_anchors(table: pa.Table) -> pa.Table:
    """Which documents hold an anchor that another document holds too."""
    a, b, doc, pos = (table.column(c).to_pylist() for c in ("a", "b", "doc", "pos"))
    out = [(int(np.frombuffer(d, "<i8")[0]), p) for x, d, p in zip(a, doc, pos, strict=True) if x is None]
    h = np.frombuffer(b"".join(x for x in a if x is not None), np.uint64)
    known = np.frombuffer(b"".join(y for x, y in zip(a, b, strict=True) if x is not None), np.uint8).astype(bool)
    docs = np.frombuffer(b"".join(d for x, d in zip(a, doc, strict=True) if x is not None), "<i8")
    order = np.argsort(h, kind="stable")
    if len(order):
        new = _first_of_runs(order, h)
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        hit = order[many & ~known[order]]
        out += _marks(docs[hit], h[hit])
    return _mark_table(out)


def _mark_table(out: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"doc_id": pa.array([x[0] for x in out], pa.int64()), "marks": pa.array([x[1] for x in out], pa.binary())})


def _send_windows(n: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unzip = WordHashes(), zstandard.ZstdDecompressor()
        for salt, (ids, marks, packed) in enumerate(_texts(batches, 0, 1, 2)):
            words = Words(hashes, [unzip.decompress(x) for x in packed])
            at, h = anchors(words, window)
            shared = np.zeros(len(at), bool)
            ends = np.searchsorted(words.doc[at], np.arange(len(ids) + 1))
            for k, own in enumerate(marks):
                part = slice(ends[k], ends[k + 1])
                shared[part] = np.isin(h[part], np.frombuffer(b"".join(own), np.uint64))
            at = at[shared]
            # windows whose first PERIOD positions hold a shared anchor
            edge = np.zeros(len(words.h) + 1, np.int32)
            np.add.at(edge, np.maximum(at - PERIOD + 1, words.start[at]), 1)
            np.add.at(edge, at + 1, -1)
            at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (words.left >= window))
            w1 = window_hashes(words.h, at, window)
            w2 = window_hashes(mix(words.h ^ _SEED2), at, window)
            doc = np.array(ids, np.int64)[words.doc[at]]
            pos = words.pos[at].astype(np.uint32)
            order = np.lexsort((doc, w2, w1))
            new = _first_of_runs(order, w1, w2)
            least = doc[order][new][np.cumsum(new) - 1] if len(order) else doc
            own = order[doc[order] > least]
            ask = order[doc[order] == least]
            bucket = (w1[ask] >> np.uint64(40)).astype(np.int64) % n
            rows = _rows(bucket, n, [w1[ask], w2[ask], doc[ask], pos[ask]])
            yield _batch(rows + _own(_marks(doc[own], pos[own]), n, salt))

    return released(run)


@released
def _meet_windows(table: pa.Table) -> pa.Table:
    """Places of windows that a document with a smaller id holds."""
    a, b, doc, pos = (table.column(c).to_pylist() for c in ("a", "b", "doc", "pos"))
    out = [(int(np.frombuffer(d, "<i8")[0]), p) for x, d, p in zip(a, doc, pos, strict=True) if x is None]
    sent = [k for k, x in enumerate(a) if x is not None]
    w1, w2 = (np.frombuffer(b"".join(c[k] for k in sent), np.uint64) for c in (a, b))
    docs = np.frombuffer(b"".join(doc[k] for k in sent), "<i8")
    at = np.frombuffer(b"".join(pos[k] for k in sent), np.uint32)
    order = np.lexsort((docs, w2, w1))
    if len(order):
        new = _first_of_runs(order, w1, w2)
        least = docs[order][new][np.cumsum(new) - 1]
        hit = order[docs[order] > least]
        out += _marks(docs[hit], at[hit])
    return _mark_table(out)


def _zipped(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Documents with compressed texts, for the shuffles to their marks."""
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("__id", "long").add("__zip", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([squeeze.compress(x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], [*columns, "__id", "__zip"])

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col("doc_id").cast("long").alias("__id"), text_bytes().alias("__zip")).mapInArrow(released(run), schema)


def _cut(columns: list[str], window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, longs, gone, whole = [], [], [], []
            for marks, packed in zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True):
                raw = unzip.decompress(packed)
                words = raw.split()
                n = len(words)
                if keep_text:
                    whole.append(raw)
                if marks:
                    edge = np.zeros(n + 1, np.int32)
                    at = np.unique(np.frombuffer(b"".join(marks), np.uint32)).astype(np.int64)
                    edge[at] += 1
                    np.add.at(edge, np.minimum(at + window, n), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                texts.append(b" ".join(words))
                longs.append(n)
                gone.append(n - len(words))
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            texts = [pa.array(whole, pa.binary()).cast(pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *texts, kept, pa.array(longs, pa.int64()), pa.array(gone, pa.int64())], [*columns, *["text"] * keep_text, "kept_text", "n_words", "n_removed"])

    return released(run)


def deduplicate(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_words`` and ``n_removed``, and with ``text`` if it is to be kept.

    Every word that a window covers whose word sequence also starts in a
    document with a smaller doc_id is removed; kept words are joined by one
    space. Windows are judged on the input.
    """
    if window < PERIOD + 4:
        raise ValueError(f"a window has at least {PERIOD + 4} words")
    spark = docs.sparkSession
    prepare(spark)
    n = bucket_count(docs, BUCKET_BYTES)
    columns = [c for c in docs.columns if c not in ("text", "kept_text", "n_words", "n_removed")]
    sources = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), text_bytes())
    shared = sources.mapInArrow(_send_anchors(n, window), EXCHANGE).groupBy("bucket").applyInArrow(_meet_anchors, MARKS)
    shared = shared.groupBy("doc_id").agg(F.collect_list("marks").alias("marks"))
    asked = _zipped(docs.where(F.col("doc_id").isNotNull()), []).join(shared, F.col("__id") == F.col("doc_id")).select("__id", "marks", "__zip")
    found = asked.mapInArrow(_send_windows(n, window), EXCHANGE).groupBy("bucket").applyInArrow(_meet_windows, MARKS)
    found = found.groupBy("doc_id").agg(F.collect_list("marks").alias("__marks")).withColumnRenamed("doc_id", "__doc")
    whole = _zipped(docs, columns).join(found, F.col("__id") == F.col("__doc"), "left")
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema
    if keep_text:
        schema = schema.add("text", "string")
    schema = schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return whole.select(*[F.col(f"`{c}`") for c in columns], "__marks", "__zip").mapInArrow(_cut(columns, window, keep_text), schema)
