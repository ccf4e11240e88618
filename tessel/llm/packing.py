"""Best-fit packing of tokenised documents: a plan on the driver, ranks on the cluster.

Matching is a sequential best-fit-decreasing pass on the driver over length
classes, of which there are at most ``capacity``, since documents of one
length are interchangeable and the input is so small. It takes the place of
bulk-synchronous sweeps with a distributed gap table and conflicts by rank,
which are not run. The plan holds a bounded number of rank ranges. The
documents themselves are range-sorted on the cluster, get their rank there and
meet the plan by length and rank, so no task or driver holds them together.

Edge cases: a null text counts as empty; an empty document is its end id
alone; documents over the capacity are cut into full pieces and a remainder;
ties go by doc_id, then piece; repeated rows are packed as often as they
occur; no documents give no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, released, stored, text_bytes

CAPACITY = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Chunks made of these alone are cut as the vocabulary's own pattern cuts them.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
_ALL_PLAIN = re.compile("(?:[A-Za-zÀ-ÖØ-öø-ÿ0-9]|[!-&(-/:-@\\[-`{-~])+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next letter from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Lately(dict):
    """A dictionary that keeps about the last ``most`` entries, in two generations."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = got
        return got


class ChunkIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, chunk by chunk.

    The tokenizer drops white space and no token or special string holds any,
    so a text's ids are its chunks' ids one after another. A chunk of Latin
    letters, digits and marks is cut into words here and its words go straight
    to the merge model; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = _Lately(self.word, most)
        self.chunks = _Lately(self.chunk, most)

    def word(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()

    def chunk(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if text.isascii() and text.isalpha():
            return self.words[text.lower()]
        if not text:
            return b""
        if "<|" not in text and _ALL_PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, _PLAIN.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, raw: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, raw.replace(b"\n", b" ").split(b" ")))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the checksum of its ids."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkIds(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(chunks.of(raw) + end)
                total = len(ids) // 4
                for k, start in enumerate(range(0, total, capacity)):
                    own = ids[4 * start : 4 * min(total, start + capacity)]
                    out.append((doc, k, start, len(own) // 4, zlib.crc32(own)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(released(run), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, largest first, on class counts.

    Rows are (length, first rank, end rank, first sequence, items a sequence,
    offset of the first item): the item of rank r goes to sequence
    first + (r - first rank) // items, at offset + ((r - first rank) % items) * length.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    sizes: list[int] = []  # gap sizes, sorted
    gaps: dict[int, list[tuple[int, int]]] = {}  # size to ranges of sequences
    fresh = 0

    def put(size: int, first: int, end: int) -> None:
        if size and first < end:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, end))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)  # the successor gap
            if at < len(sizes):
                size = sizes[at]
                first, end = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            else:
                size, each = capacity, capacity // length
                first, end = fresh, fresh + -(-left // each)
                fresh = end
            each, offset = size // length, capacity - size
            full = min(end - first, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, offset))
                put(size - each * length, first, first + full)
                rank, left, first = rank + full * each, left - full * each, first + full
            if left and first < end:  # fewer items than the next sequence takes
                out.append((length, rank, rank + left, first, each, offset))
                put(size - left * length, first, first + 1)
                first, left = first + 1, 0
            put(size, first, end)
    return out


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` rows with sequence_id and offset."""
    spark = found.sparkSession
    prepare(spark)
    found = stored(found)  # the range sort samples its input first, which would tokenise twice
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("piece")]
    # checkpoint() fixes the partitions, so that ranks counted in one job hold in the next
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    ranged = ranged.withColumn("__at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row per partition and class that begins or goes on there: at most partitions + capacity rows
    runs = ranged.groupBy("__part", "length").agg(F.count("*").alias("n"), F.min("__row").alias("first")).collect()
    counts: dict[int, int] = {}
    begins = []
    for r in sorted(runs, key=lambda r: (r["__part"], -r["length"])):
        before = counts.get(r["length"], 0)
        begins.append((r["__part"], r["length"], before - r["first"]))
        counts[r["length"]] = before + r["n"]
    rows = plan(counts, capacity)
    shift = spark.createDataFrame(begins, "__part long, length long, __shift long")
    slots = spark.createDataFrame(rows, "length long, __lo long, __hi long, __seq long, __each long, __off long")
    # both are bounded: partitions + capacity rows, and a few rows per length class
    ranked = ranged.join(F.broadcast(shift), ["__part", "length"]).withColumn("__rank", F.col("__row") + F.col("__shift"))
    s = F.broadcast(slots)
    out = ranged_join(ranked, s)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__seq") + F.expr("(__rank - __lo) div __each")).alias("sequence_id"), (F.col("__off") + F.expr("((__rank - __lo) % __each) * length")).alias("offset"))


def ranged_join(ranked: DataFrame, slots: DataFrame) -> DataFrame:
    """Each row with the slot range of its length that holds its rank."""
    by = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("__lo", "__hi", "__seq", "__each", "__off"))).alias("__slots"))
    found = ranked.join(F.broadcast(by), "length")
    slot = F.filter("__slots", lambda x: (x["__lo"] <= F.col("__rank")) & (F.col("__rank") < x["__hi"]))[0]
    return found.withColumn("__slot", slot).select(*ranked.columns, "__slot.*")
