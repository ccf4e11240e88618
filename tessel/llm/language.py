"""Language identification by Bayesian evidence fusion.

A text's likelihood under each language comes from letter trigrams, counted
for a bounded sample of rows that declare their language. It is combined with
three further kinds of evidence: the language that the source declares
(markup or metadata), read through a smoothed table of how often a declared
language is the true one; the address suffix; and the host. Host priors are
smoothed towards their suffix and those towards the whole corpus; all three
are grouped aggregations over every row.

Edge cases: a null or empty text has no likelihood, so only the other evidence
counts, and it is not kept; a null host, suffix or declaration is no evidence
of its kind; repeated rows are judged alike; ties go to the first language in
order; with no declared row there are no languages and the answer is null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, sized_join, stored, text_bytes

#: Bounds: rows that the trigrams are counted on (but LEAST_SAMPLE of each language), slots of the table.
MAX_SAMPLE, LEAST_SAMPLE, SLOTS = 3000, 20, 1 << 15

#: A text counts as this many words at most, since words of a text are not independent.
MOST_WORDS = 50

#: Pseudo-counts: of a trigram, and of the parent in each step of the hierarchy.
TRIGRAM_PRIOR, PARENT_WEIGHT = 0.5, 20.0

#: A posterior from which a text is kept as identified.
SURE = 0.5

_EDGE = b"\x02"


class WordSlots(dict):
    """What is made of a word, such as its trigram slots, kept for words seen lately."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.clear()
        got = self[word] = self.make(word)
        return got


def slots(word: bytes) -> list[int]:
    letters = word.decode("utf-8", "replace").lower()
    letters = "".join(c for c in letters if c.isalpha())
    if not letters:
        return []
    letters = f"\x02{letters}\x03"
    return [xxhash.xxh3_64_intdigest(letters[k : k + 3]) % SLOTS for k in range(len(letters) - 2)]


class TrigramSlots(dict):
    """Slots of trigrams, three code points in 63 bits, kept for those seen lately."""

    def __missing__(self, key: int) -> int:
        if len(self) >= 200_000:
            self.clear()
        got = self[key] = xxhash.xxh3_64_intdigest(chr(key >> 42) + chr(key >> 21 & 0x1FFFFF) + chr(key & 0x1FFFFF)) % SLOTS
        return got


@cache
def _alpha() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


class AllSlots:
    """``slots`` of many words at once."""

    def __init__(self):
        self.alpha = _alpha()
        self.of_trigram = TrigramSlots()

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(slots of all words, how many each has); words hold no white space, which tells them apart here."""
        letters = b"\n".join([b"", *words]).decode("utf-8", "replace").lower()
        x = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
        gap = x == 10
        kept = self.alpha[x] | gap
        x, gap = x[kept], gap[kept]
        x = np.repeat(x, 1 + gap).astype(np.int64)  # a gap ends a word and begins one
        at = np.flatnonzero(gap) + np.arange(len(words))
        x[at], x[at + 1] = 3, 2
        x = np.append(x[1:], 3)
        inside = np.flatnonzero((x[:-2] != 3) & (x[1:-1] != 3))
        count = np.bincount(np.cumsum(x == 2)[inside] - 1, minlength=len(words))
        key, back = np.unique(x[inside] << 42 | x[inside + 1] << 21 | x[inside + 2], return_inverse=True)
        return np.fromiter(map(self.of_trigram.__getitem__, key.tolist()), np.int64, len(key))[back], count


def _means(table: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over each run of ``at``; zeros for an empty run."""
    out = np.zeros((len(count), table.shape[1]))
    some = np.flatnonzero(count)
    if len(some):
        out[some] = np.add.reduceat(table[at], (np.cumsum(count) - count)[some], axis=0) / count[some, None]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = WordSlots(slots)
    for batch in batches:
        totals: dict[str, np.ndarray] = {}
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            into = totals.setdefault(lang, np.zeros(SLOTS, np.int64))
            for w in raw.split():
                for s in held[w]:
                    into[s] += 1
        rows = [(lang, int(s), int(v[s])) for lang, v in totals.items() for s in np.flatnonzero(v)]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "slot", "n"])


def learn(rows: DataFrame, max_sample: int = MAX_SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log likelihoods (slot, language) from declared rows, chosen by hash.

    Each declared language gets an equal part of ``max_sample``, and
    LEAST_SAMPLE rows where that is more; all declared values are languages.
    """
    known = rows.where(F.col("declared").isNotNull() & F.col("id").isNotNull())
    langs = sorted(r["declared"] for r in known.select("declared").distinct().collect())
    each = max(LEAST_SAMPLE, max_sample // max(1, len(langs)))
    place = F.row_number().over(Window.partitionBy("declared").orderBy(F.xxhash64("id"), "id"))
    chosen = known.select("declared", "id").withColumn("place", place).where(F.col("place") <= each).select("declared", "id").distinct()  # cut to ``each`` before the shuffle too
    sample = known.join(F.broadcast(chosen), ["declared", "id"]).select("declared", text_bytes())  # at most ``each`` ids a language are broadcast
    counts = sample.mapInArrow(_counted, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most languages x SLOTS rows
    table = np.full((SLOTS, len(langs)), TRIGRAM_PRIOR)
    at = {x: k for k, x in enumerate(langs)}
    table[counts["slot"].to_numpy(int), [at[x] for x in counts["lang"]]] += counts["n"].to_numpy()
    return langs, np.log(table / table.sum(0)) if langs else table


def text_evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """id, host, suffix, declared, n_words and ``like``, the text's log likelihood by language. Stored."""
    table = np.ascontiguousarray(table, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = table.shape[1]
        most = 200_000
        scores = np.empty((most, langs))
        has = np.empty(most)

        fresh: list[bytes] = []  # words whose scores are not made yet, the last of ``held``

        def make(word: bytes) -> int:
            fresh.append(word)
            return len(held)

        def settle() -> None:
            """Scores of fresh words, then the sums that wait for them."""
            first = len(held) - len(fresh)
            for a in range(0, len(fresh), 4000):
                at, count = every.of(fresh[a : a + 4000])
                here = slice(first + a, first + a + len(count))
                has[here], scores[here] = count > 0, _means(table, at, count)
            fresh.clear()
            for k, at in waiting:
                total[k] += scores[at].sum(0)
                n[k] += int(has[at].sum())
            waiting.clear()

        held, every = WordSlots(make, most), AllSlots()
        waiting: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            raws = batch.column(4).to_pylist()
            total, n = np.zeros((len(raws), langs)), [0] * len(raws)
            for k, raw in enumerate(raws):
                words = raw.split()
                for a in range(0, len(words), most // 2):
                    part = words[a : a + most // 2]
                    if len(held) + len(part) > most:
                        settle()
                        held.clear()
                    waiting.append((k, np.fromiter(map(held.__getitem__, part), np.int64, len(part))))
            settle()
            like = [(t / m * min(m, MOST_WORDS)).tolist() if m else [0.0] * langs for t, m in zip(total, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64()), pa.array(like, pa.list_(pa.float64()))], ["id", "host", "suffix", "declared", "n_words", "like"])

    kept = rows.select("id", "host", "suffix", "declared", text_bytes())
    return stored(kept.mapInArrow(run, kept.drop("text").schema.add("n_words", "long").add("like", T.ArrayType(T.DoubleType()))))


def _posterior(log: Column) -> Column:
    top = F.array_max(log)
    weights = F.transform(log, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: w / total)


def _added(*logs: Column) -> Column:
    out = logs[0]
    for other in logs[1:]:
        out = F.zip_with(out, other, lambda a, b: a + b)
    return out


def _sums(n: int, of: str = "post") -> Column:
    return F.array(*[F.sum(F.col(of)[k]) for k in range(n)])


def _smoothed(counts: Column, parent: Column) -> Column:
    """Shares of counts, with PARENT_WEIGHT pseudo-counts shared out as in the parent."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + PARENT_WEIGHT
    return F.zip_with(counts, parent, lambda c, p: (c + PARENT_WEIGHT * p) / total)


def identify(rows: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """(id, lang, posterior, text_lang, n_words, kept) for rows of (id, text, host, suffix, declared)."""
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select("id", "text", F.col("host").cast("string"), F.col("suffix").cast("string"), F.col("declared").cast("string"))
    langs, table = learn(rows, max_sample)
    n = len(langs)
    seen = text_evidence(rows, table)
    if not n:
        return seen.select("id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "n_words", F.lit(False).alias("kept"))
    names = F.array(*[F.lit(x) for x in langs])
    even = F.array(*[F.lit(1.0 / n)] * n)
    known = seen.where("n_words > 0").withColumn("post", _posterior(F.col("like")))
    whole = known.agg(_sums(n).alias("w")).select(_smoothed(F.coalesce("w", F.array(*[F.lit(0.0)] * n)), even).alias("whole"))  # one row
    suffix = known.where(F.col("suffix").isNotNull()).groupBy("suffix").agg(_sums(n).alias("s")).crossJoin(F.broadcast(whole))
    suffix = stored(suffix.select("suffix", _smoothed(F.col("s"), F.col("whole")).alias("suffix_prior")))
    host = known.where(F.col("host").isNotNull()).groupBy("host").agg(_sums(n).alias("h"), F.min("suffix").alias("suffix"))
    host = sized_join(host, suffix, "suffix", ["host"]).crossJoin(F.broadcast(whole))
    host = stored(host.select("host", _smoothed(F.col("h"), F.coalesce("suffix_prior", "whole")).alias("host_prior")))
    # how often a true language is declared as this one: one short row for each declared language
    declared = known.where(F.col("declared").isNotNull()).groupBy("declared").agg(_sums(n).alias("d"))
    truth = F.aggregate(F.col("d"), F.lit(0.0), lambda a, x: a + x)
    declared = stored(declared.select("declared", F.transform("d", lambda c: F.log((c + 0.05) / (truth + 0.05 * n))).alias("declared_log")))
    out = sized_join(sized_join(sized_join(seen, host, "host", ["id"]), suffix, "suffix", ["id"]), declared, "declared", ["id"]).crossJoin(F.broadcast(whole))
    prior = F.transform(F.coalesce("host_prior", "suffix_prior", "whole"), lambda p: F.log(p))
    base = F.transform("whole", lambda p: F.log(p))
    # a declaration is worth p(true | declared) / p(true)
    claim = F.coalesce(F.zip_with("declared_log", base, lambda d, b: d - b), F.array(*[F.lit(0.0)] * n))
    post = _posterior(_added(F.col("like"), prior, claim))
    out = out.withColumn("post", F.transform(post, lambda p: F.round(p, 6))).withColumn("top", F.array_max("post"))
    best = F.get(names, (F.array_position("post", F.col("top")) - 1).cast("int"))
    text_best = F.when(F.col("n_words") > 0, F.get(names, (F.array_position("like", F.array_max("like")) - 1).cast("int")))
    return out.select("id", best.alias("lang"), F.col("top").alias("posterior"), text_best.alias("text_lang"), "n_words", ((F.col("n_words") > 0) & (F.col("top") >= SURE)).alias("kept"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence rows of web pages: text without tags, host, address suffix and the lang of the html tag."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    lang = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    some = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), some(host).alias("host"), some(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"), some(lang).alias("declared"))
