"""N-gram Jaccard self-join with PartEnum signatures.

Two sets with Jaccard similarity of 3/4 or more differ in at most a seventh of
their sizes' sum, and share at least 3/4 of the larger. Both facts are used.

First, features that no other set holds are counted out, by one exchange of
all features: a set of which over a quarter is its own has no partner, and the
features left of the others are all that partners can share. A feature that a
batch finds in several of its sets is sent once for all of them. (Copies in
several batches count as several here, which lets more sets through.)

Second, PartEnum on what is left. Sets are put in size bands. For each band
the feature domain is cut into first-level partitions, so many that a linked
pair differs in at most K2 features within one of them; that partition is cut
into second-level ones, and the hash of every subset of these without K2 of
them is a signature, since the pair agrees on one such subset. A set emits
signatures for its own band and for the next, where its larger partner may be;
a group without a set of its scheme's own band is not looked at, as its members
meet in their own band.
A partition is of use to a set that is spread over more than K2 of its
second-level parts, so that no subset can be empty; a set with too few of
those for its bound says so by emitting an ordered prefix of its features too,
which binds any two such sets. So the candidates are complete.

Third, sets that share a signature are compared. The member with the smallest
share of features of its own is the group's pivot, in large groups within a
batch before anything is sent, and then over all; members meet their pivots, on
the features themselves. A few signatures of each set come first, so that a set
meets a few pivots however large its groups are, and links make components.
Then come all signatures, and only groups that hold sets of several components
are looked at: in the others nothing is left to connect. Their members meet
their pivots with no bound on their number, and links make components anew. A
member outside its pivot's component is compared with the group's other members
outside its own, in blocks of bounded size: by the triangle inequality, by
parity bitmaps, and what these let pass by the features. Only links leave that
step, and none within what is connected by then.

Equal sets are one class from the start, so copies meet no one twice.

Edge cases: a null or empty text has the empty set, linked with nothing; a
text with fewer words than a shingle is one shingle; repeated rows and ties
fall in one class; a null doc_id is no one's smallest id; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WordHashes, bucket_count, fold, forget, mix, plan_bytes, prepare, released, stored, stored_by_key, text_bytes
from .components import components
from .substrings import _texts

SHINGLE = 5

#: Features that a pair may differ in within a partition, and second-level partitions beyond those.
K2, SPARE = 2, 3

#: Bytes of compressed input to a bucket; bytes of text, and of features, that are worked on at once; bytes of features in a block.
BUCKET_BYTES, FLUSH_BYTES, SET_BYTES, BLOCK_BYTES = 4 << 20, 3 << 20, 4 << 20, 4 << 20

#: Members of a signature group that a batch sends on; of a larger group it sends the pivot alone.
MOST_SENT = 8

#: First-level partitions of a band's scheme that give the few signatures of the first round.
FEW = 2

#: Members that are compared with a pivot in one piece; the pivot's features are sent to each piece.
PIECE_ROWS = 4096

#: Rows of a batch, whose places must fit 16 bits.
BATCH_ROWS = 60_000

_PART, _BIT, _KEY = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)
_S16, _S17, _OWNER, _OWN = np.uint64(16), np.uint64(17), np.uint64(0xFFFF), np.uint64(0x10000)


def _bands(most: int = 1 << 40) -> np.ndarray:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return np.array(out, np.int64)


#: The largest set size of each band; each is about 4/3 of the one before.
BANDS = _bands()


def linked(both: int, a: int, b: int) -> bool:
    return 100 * both >= 75 * (a + b - both) and both > 0


def scheme(band: int) -> tuple[int, int, int]:
    """(first-level partitions, second-level partitions of each, features that may differ within one) of a band."""
    most = int(2 * BANDS[band] // 7)
    differ = min(K2, most)
    first = 1 if most <= K2 else -(-(most + 1) * 11 // (10 * (differ + 1))) + 1
    return first, differ + SPARE if differ else 1, differ


def _subsets(n: int, without: int) -> list[tuple[int, ...]]:
    from itertools import combinations

    return list(combinations(range(n), n - without))


class Sets:
    """Shingle sets of texts as sorted arrays of hashes."""

    def __init__(self):
        self.hashes = WordHashes(seed=5, most=150_000)

    def of(self, raw: bytes) -> np.ndarray:
        h = self.hashes.of(raw.lower().split())
        n = len(h)
        size = min(n, SHINGLE)
        if not n:
            return h
        acc = np.full(n - size + 1, np.uint64(size))
        for k in range(size):
            acc = fold(acc, h[k : n - size + 1 + k])
        return np.unique(acc >> _S16)


def class_key(s: np.ndarray) -> bytes:
    """96 bits that stand for a set, and its size."""
    with np.errstate(over="ignore"):
        return struct.pack("<QII", int(mix(s).sum()), int(mix(s ^ _KEY).sum()) >> 32, len(s))


def sizes_of(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint32).reshape(-1, 4)[:, 3].astype(np.int64)


def _keys(*parts: bytes) -> np.ndarray:
    """Class keys as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)


def signatures(sets: list[np.ndarray], size: np.ndarray, few: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the set, signature, whether of its own band) of features that others share, for sets of ``size`` features in all.

    With ``few``, one subset of each of the first partitions alone: enough to find most components, not all links.
    """
    own_band = np.searchsorted(BANDS, size)
    out_doc, out_sig, out_own = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for step in (0, 1):
        for band in np.unique(own_band).tolist():
            who = np.flatnonzero(own_band == band)
            doc, sig = _of_band([sets[k] for k in who.tolist()], size[who], band + step, few)
            out_doc.append(who[doc])
            out_sig.append(sig)
            out_own.append(np.full(len(sig), step == 0))
    return np.concatenate(out_doc), np.concatenate(out_sig), np.concatenate(out_own)


def _of_band(sets: list[np.ndarray], size: np.ndarray, band: int, few: bool) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets under the scheme of one band."""
    first, second, differ = scheme(band)
    count = np.array([len(s) for s in sets], np.int64)
    h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), count)
    part = mix(h ^ _PART)
    if few:
        early = part % np.uint64(first) < np.uint64(FEW)
        h, doc, part = h[early], doc[early], part[early]
    slot = (doc * first + (part % np.uint64(first)).astype(np.int64)) * second + (mix(part) % np.uint64(second)).astype(np.int64)
    acc = np.zeros(len(sets) * first * second, np.uint64)
    np.add.at(acc, slot, mix(h))
    acc = acc.reshape(-1, second)
    filled = np.bincount(slot, minlength=acc.size).reshape(-1, second) > 0
    place = np.tile(np.arange(first, dtype=np.uint64), len(sets))
    out_doc, out_sig = [], []
    for number, chosen in enumerate(_subsets(second, differ)[: 1 if few else None]):
        at = np.flatnonzero(filled[:, chosen].any(1))
        sig = fold(place[at], np.full(len(at), np.uint64(band << 8 | number)))
        for column in chosen:
            sig = fold(sig, acc[at, column])
        out_doc.append(at // first)
        out_sig.append(sig)
    if few:
        return np.concatenate(out_doc), np.concatenate(out_sig)
    # partitions whose every subset is filled, against the most that a partner in this band can differ in
    useful = (filled.sum(1) > differ).reshape(len(sets), first).sum(1)
    most = (size + np.minimum(BANDS[band], size * 4 // 3)) // 7 - (size - count)
    for k in np.flatnonzero(useful * (differ + 1) <= most).tolist():
        s = sets[k]
        prefix = np.sort(mix(s))[: len(s) - (3 * int(size[k]) + 3) // 4 + 1]
        out_doc.append(np.full(len(prefix), k))
        out_sig.append(fold(prefix, np.full(len(prefix), np.uint64(band << 8 | 255))))
    return np.concatenate(out_doc), np.concatenate(out_sig)


EXCHANGE = "bucket int, key binary, doc_id long, text_hash long, n long, batch long, entries binary, keys binary"
FOUND = "key binary, doc_id long, text_hash long, n long, batch long, entries binary, keys binary"
SHARED = "key binary, n long, c long, feats binary"
STARS = "pivot binary, key binary, members binary, mixed boolean"
ASKED = "bucket int, pivot binary, members binary, mixed boolean, entries binary, keys binary, counts binary, comps binary"

_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in ddl.split(", ")])


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def _cut(by: np.ndarray) -> Iterator[tuple[int, int]]:
    """Beginning and end of each run of a sorted array."""
    cuts = [*np.flatnonzero(_starts(by)).tolist(), len(by)]
    return zip(cuts, cuts[1:], strict=False)


def _dealt(entries: np.ndarray, n: int, below: np.uint64 = _S16) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, entries) of entries, each a value over ``below`` bits of others; only buckets that get any."""
    bucket = ((entries >> below) % np.uint64(n)).astype(np.uint16 if n <= 65536 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, entries = bucket[order], entries[order]
    for a, b in _cut(bucket):
        yield int(bucket[a]), entries[a:b]


def _scan(n: int):
    """Texts to rows about documents, and features packed by bucket.

    A feature travels with its owner's place in the batch, and the batch by a
    hash of its classes, so that what is found goes back to the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = Sets(), _schema(EXCHANGE)
        for salt, (ids, hashes, raws) in enumerate(_texts(batches, 0, 1, 2, flush=FLUSH_BYTES, rows=BATCH_ROWS)):
            rows: list[tuple] = []
            sets: dict[bytes, np.ndarray] = {}
            for k, (doc, th, raw) in enumerate(zip(ids, hashes, raws, strict=True)):
                s = own.of(raw)
                key = class_key(s)
                rows.append(((salt + k) % n, key, doc, th, len(s), None, None, None))
                if len(s):
                    sets[key] = s
            if sets:
                keys = b"".join(sets)
                name = xxhash.xxh3_64_intdigest(keys) >> 1
                e = np.concatenate(list(sets.values())) << _S16
                e |= np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets.values()])
                sets.clear()
                e.sort()
                f = e >> _S16
                new = _starts(f)
                count = np.diff([*np.flatnonzero(new), len(f)])
                many = np.repeat(count > 1, count)
                rows.append((name % n, None, None, None, None, name, e[many].tobytes(), keys))
                for bucket, entries in _dealt(np.concatenate([e[~many], f[new & many] << _S16 | _OWNER]), n):
                    rows.append((bucket, None, None, None, None, name, entries.tobytes(), None))
            yield _arrow(rows, schema)

    return released(run)


@released
def _shared(table: pa.Table) -> pa.Table:
    """One bucket of features to those that two classes hold, packed by batch; rows about documents and batches pass."""
    schema = _schema(FOUND)
    asks = pc.and_(pc.is_null(table["key"]), pc.is_null(table["keys"]))
    rest = table.filter(pc.invert(asks)).select(schema.names)
    table = table.filter(asks).select(["batch", "entries"])
    rows: list[tuple] = []
    if table.num_rows:
        name = table["batch"].to_numpy()
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["entries"]]
        e, batch = np.concatenate(each), np.repeat(np.arange(len(each), dtype=np.uint32), [len(x) for x in each])
        del each, table
        order = np.argsort(e)
        e, batch = e[order], batch[order]
        del order
        new = _starts(e >> _S16)
        found = ~(new & np.append(new[1:], True))  # not alone
        found &= (e & _OWNER) != _OWNER  # the place of all ones stands for owners that know already
        e, batch = e[found], batch[found]
        order = np.argsort(batch, kind="stable")
        e, batch = e[order], batch[order]
        rows = [(None, None, None, None, int(name[batch[a]]), e[a:b].tobytes(), None) for a, b in _cut(batch)] if len(e) else []
    return pa.concat_tables([rest.cast(schema), pa.Table.from_batches([_arrow(rows, schema)])])


@released
def _gathered(table: pa.Table) -> pa.Table:
    """The classes of one batch of which three quarters are shared, with the features that are."""
    key = _keys(next(x for x in table["keys"].to_pylist() if x is not None))
    size = sizes_of(key)
    e = np.frombuffer(b"".join(table["entries"].to_pylist()), np.uint64)
    owner = (e & _OWNER).astype(np.int64)
    keep = (4 * np.bincount(owner, minlength=len(key)) >= 3 * size)[owner]
    owner, feats = owner[keep], (e >> _S16)[keep]
    order = np.lexsort((feats, owner))
    owner, feats = owner[order], feats[order]
    new = _starts(owner) | _starts(feats)  # a batch that occurs twice says all of it twice
    owner, feats = owner[new], feats[new]
    rows = [(key[owner[a]].tobytes(), int(size[owner[a]]), b - a, feats[a:b].tobytes()) for a, b in _cut(owner)] if len(owner) else []
    return pa.Table.from_batches([_arrow([r for r in rows if 4 * r[2] >= 3 * r[1]], _schema(SHARED))])


def _order(keys: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Classes by the share of features of their own, then by key: the first of a group is its pivot."""
    size = sizes_of(keys)
    return np.lexsort((keys[:, 1], keys[:, 0], (size - shared) / size))


def _any(group: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """For each entry, whether any of its group has the flag."""
    return (np.bincount(group, flag, minlength=1) > 0)[group]


def _firsts(group: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """The first entry of each group that has the flag."""
    out = np.zeros(len(group), bool)
    at = np.flatnonzero(flag)
    if len(at):
        out[at[_starts(group[at])]] = True
    return out


def _ask(n: int, few: bool):
    """Signatures of a batch of labelled sets, with their members.

    An entry is 47 bits of signature, one that says whether it is of the set's
    own band (with ``few`` all are taken for that), and 16 bits of owner. Of a
    large group only its pivot is sent, with one member of another component
    and one in its own band if there are any. The others go with the pivot of
    the batch, in one row for all of its groups that are to be looked at
    anyway and in one for the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(ASKED)
        for salt, (raw_keys, comps, raw_feats) in enumerate(_texts(batches, 0, 4, 3, flush=SET_BYTES, rows=BATCH_ROWS)):
            keys = _keys(*raw_keys)
            sets = [np.frombuffer(x, np.uint64) for x in raw_feats]
            count = np.array([len(s) for s in sets], np.int64)
            rank = np.empty(len(sets), np.uint64)
            rank[order := _order(keys, count)] = np.arange(len(sets), dtype=np.uint64)
            doc, sig, own = signatures(sets, sizes_of(keys), few)
            e = np.unique((sig >> _S17) << _S17 | (own | few).astype(np.uint64) << _S16 | rank[doc])
            keys, count, comp = keys[order], count[order].astype(np.uint32), np.array(comps, np.int64)[order]
            owner, own = (e & _OWNER).astype(np.int64), (e & _OWN) > 0
            order = np.lexsort((owner, e >> _S17))
            e, owner, own = e[order], owner[order], own[order]
            new = _starts(e >> _S17)
            group = np.cumsum(new) - 1
            large = (np.bincount(group, minlength=1) > MOST_SENT)[group]
            pivot = owner[new][group]
            other = comp[owner] != comp[pivot]
            mixed = _any(group, other) & _any(group, own)
            witness = _firsts(group, other) | _firsts(group, own)
            rows: list[tuple] = []
            near = np.unique((pivot << 17 | mixed.astype(np.int64) << 16 | owner)[large & ~new])
            for a, b in _cut(near >> 16) if len(near) else ():
                p = int(near[a]) >> 17
                rows.append(((salt + p) % n, keys[p].tobytes(), keys[near[a:b] & 0xFFFF].tobytes(), bool(near[a] >> 16 & 1), None, None, None, None))
            for bucket, entries in _dealt(e[new | ~large | witness], n, _S17):
                here, local = np.unique((entries & _OWNER).astype(np.int64), return_inverse=True)
                rows.append((bucket, None, None, None, (entries & ~_OWNER | local.astype(np.uint64)).tobytes(), keys[here].tobytes(), count[here].tobytes(), comp[here].tobytes()))
            yield _arrow(rows, schema)

    return released(run)


@released
def _meet(table: pa.Table) -> pa.Table:
    """Pairs of members with the pivot over all, in groups of several components that hold a set of their own band; what batches hold of their pivots passes."""
    rows: list[tuple] = []
    keys, values, owners, owns, counts, comps, seen = [], [], [], [], [], [], 0
    for r in table.to_pylist():
        if r["pivot"] is not None:
            rows.append((r["pivot"], None, r["members"], r["mixed"]))
            continue
        e = np.frombuffer(r["entries"], np.uint64)
        values.append(e >> _S17)
        owners.append((e & _OWNER).astype(np.int64) + seen)
        owns.append((e & _OWN) > 0)
        keys.append(r["keys"])
        counts.append(np.frombuffer(r["counts"], np.uint32))
        comps.append(np.frombuffer(r["comps"], np.int64))
        seen += len(counts[-1])
    if keys:
        key, comp, value, owner, own = _keys(*keys), *(np.concatenate(x) for x in (comps, values, owners, owns))
        order = _order(key, np.concatenate(counts))
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key))
        owner, comp = rank[owner], comp[order]
        by = np.lexsort((owner, value))
        value, owner, own = value[by], owner[by], own[by]
        new = _starts(value)
        group = np.cumsum(new) - 1
        pivot = owner[new][group]
        mixed = _any(group, comp[owner] != comp[pivot]) & _any(group, own)
        pairs = np.unique((pivot << 32 | owner)[~new & mixed])
        text = [x.tobytes() for x in key[order]]
        rows += [(text[p >> 32], text[p & 0xFFFFFFFF], None, None) for p in pairs.tolist() if text[p >> 32] != text[p & 0xFFFFFFFF]]
    return pa.Table.from_batches([_arrow(rows, _schema(STARS))])


COMPARED = "pivot binary, key binary, differ long, linked boolean, c long"


@released
def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pivot, key, features in pieces that begin with the pivot's own row, to exact differences from it, and how many features the key has."""
    schema = _schema(COMPARED)
    now = np.zeros(0, np.uint64)
    for batch in batches:
        rows = []
        for a, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            feats = np.frombuffer(raw, np.uint64)
            if a == b:
                now = feats
                continue
            na, nb = (int.from_bytes(k[12:], "little") for k in (a, b))
            both = len(np.intersect1d(now, feats, assume_unique=True))
            rows.append((a, b, na + nb - 2 * both, linked(both, na, nb), len(feats)))
        yield _arrow(rows, schema)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pivot, members packed) to (pivot, key), some thousands of rows at once."""
    schema = _schema("pivot binary, key binary")
    for batch in batches:
        for pivot, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for a in range(0, len(members), 16 << 12):
                part = members[a : a + (16 << 12)]
                yield _arrow([(pivot, part[k : k + 16]) for k in range(0, len(part), 16)], schema)


def star_pairs(labelled: DataFrame, n: int, few: bool = False) -> DataFrame:
    """(pivot, key), stored: sets with the pivots of their signature groups, where a group holds several components.

    ``labelled`` has rows as `_labels` makes them. With ``few``, a few signatures of each set
    alone, and the pivots of batches stand for their members.
    """
    met = stored(labelled.mapInArrow(_ask(n, few), ASKED).groupBy("bucket").applyInArrow(_meet, STARS))
    far, near = met.where("key is not null").select("pivot", "key").distinct(), met.where("members is not null").select("pivot", "members", "mixed")
    sent = near.where("mixed").select("pivot", "members")
    if not few:
        # members of a batch's group belong to the group of that batch's pivot, too
        sent = sent.union(near.where("not mixed").join(far.select("pivot").distinct(), "pivot", "left_semi").select("pivot", "members"))
        sent = sent.union(near.withColumnRenamed("pivot", "via").join(far.withColumnRenamed("key", "via"), "via").select("pivot", "members"))
    return stored(far.union(sent.mapInArrow(_unpacked, "pivot binary, key binary")).where(F.col("pivot") != F.col("key")).distinct())


def _labels(sets: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Sets with a hash of their component; without components each is its own."""
    if roots is None:
        return sets.select("key", "n", "c", "feats", F.xxhash64("key").alias("comp"))
    roots = stored(roots.withColumnRenamed("node", "key"))
    named = sets.join(F.broadcast(roots) if plan_bytes(roots) <= BROADCAST_BYTES else roots, "key", "left")
    return named.select("key", "n", "c", "feats", F.xxhash64(F.coalesce("root", "key")).alias("comp"))


def compared_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """COMPARED rows of stored (pivot, key) rows, stored.

    Features are joined to rows once: a pivot travels as one more row of each
    piece of its members, and pieces are bounded, so no pivot is one task's.
    """
    pieces = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces"))
    each = pairs.join(pieces, "pivot").select("pivot", "key", F.pmod(F.xxhash64("key"), "pieces").cast("int").alias("piece"))
    own = pieces.select("pivot", F.col("pivot").alias("key"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    rows = each.union(own).join(sets.select("key", "feats"), "key").repartition("pivot", "piece")
    rows = rows.sortWithinPartitions("pivot", "piece", F.col("key") != F.col("pivot"))
    return stored(rows.select("pivot", "key", "feats").mapInArrow(_compared, COMPARED))


def _size(key: str) -> F.Column:
    """The set size that a class key ends with."""
    return F.conv(F.hex(F.reverse(F.substring(key, 13, 4))), 16, 10).cast("long")


def _linked(compared: DataFrame) -> DataFrame:
    """LINKS rows of the pairs that are linked."""
    size = _size("pivot") + _size("key")
    similarity = (size - F.col("differ")) / (size + F.col("differ"))
    return compared.where("linked").select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b"), similarity.alias("similarity"))


def sketches(feats: list[np.ndarray], bits: int) -> np.ndarray:
    """Parities of the features over ``bits`` bits, a power of two, as rows of words."""
    out = np.zeros((len(feats), bits), np.uint8)
    who = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    at = (mix(np.concatenate(feats) ^ _BIT) & np.uint64(bits - 1)).astype(np.int64)
    np.add.at(out, (who, at), 1)
    return np.packbits(out & 1, axis=1).view(np.uint64)


LINKS = "a binary, b binary, similarity double"
LISTED = "pivot binary, i int, j int, other boolean, key binary, comp binary, differ long, outside boolean, feats binary"


def _block_links(rows: list[tuple]) -> list[tuple]:
    """Links of members outside their pivot's component with others of the group, none within what is connected."""
    asked = [r for r in rows if not r[0]]
    rows = [r for r in rows if r[0]]
    if not asked or not rows:
        return []
    feats = [np.frombuffer(r[5], np.uint64) for r in rows]
    keys = [r[1] for r in rows]
    size, count = sizes_of(_keys(*keys)), np.array([len(f) for f in feats])
    bits = 1 << int(np.clip(4 * np.median(count), 64, 1 << 15) - 1).bit_length()
    table = sketches(feats, bits)
    ours = sketches([np.frombuffer(r[5], np.uint64) for r in asked], bits)
    differ, outside = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    names: dict[bytes, int] = {}
    comp = np.array([names.setdefault(r[2], len(names)) for r in rows])
    order = {k: x for x, k in enumerate(sorted({*keys, *(r[1] for r in asked)}))}
    place = np.array([order[k] for k in keys])
    out = []
    for (_, key, own, away, _, packed), sketch in zip(asked, ours, strict=True):
        f = np.frombuffer(packed, np.uint64)
        n = int.from_bytes(key[12:], "little")
        mine = names.setdefault(own, len(names))
        fits = (comp != mine) & (4 * np.minimum(size, n) >= 3 * np.maximum(size, n)) & (7 * np.abs(differ - away) <= size + n)
        fits &= ~outside | (place > order[key])  # two that are both outside come up once
        at = np.flatnonzero(fits)
        least = (size[at] - count[at]) + (n - len(f)) + np.bitwise_count(table[at] ^ sketch).sum(1).astype(np.int64)
        for k in at[7 * least <= size[at] + n].tolist():
            if comp[k] == mine:
                continue
            both = len(np.intersect1d(f, feats[k], assume_unique=True))
            if linked(both, n, int(size[k])):
                out.append((min(key, keys[k]), max(key, keys[k]), both / (n + int(size[k]) - both)))
                gone = comp[k]
                comp[comp == gone] = mine
                for name in [x for x, v in names.items() if v == gone]:
                    names[name] = mine
    return out


@released
def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LISTED rows, sorted by block, to the links of each block."""
    schema = _schema(LINKS)
    now, held = None, []
    for batch in batches:
        out = []
        for *block, other, key, comp, differ, outside, feats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now:
                out += _block_links(held)
                now, held = block, []
            held.append((other, key, comp, differ, outside, feats))
        yield _arrow(out, schema)
    yield _arrow(_block_links(held), schema)


def left_over_links(compared: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Links in groups of which some members are outside the pivot's component."""
    each = compared.select("pivot", "key", "differ", "c").join(roots.select(F.col("node").alias("key"), F.col("root").alias("comp")), "key", "left")
    each = each.join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("top")), "pivot", "left")
    each = each.withColumn("comp", F.coalesce("comp", "key")).withColumn("outside", F.col("comp") != F.coalesce("top", "pivot"))
    each = stored(each.select("pivot", "key", "differ", "comp", "outside", "c"))
    blocks = lambda size: F.ceil(F.coalesce(size, F.lit(0)) * 8 / BLOCK_BYTES).cast("int")
    away = lambda x: F.when(F.col("outside"), x)
    bounds = [f(away(x)).alias(f"{side}_{name}") for name, x in (("n", _size("key")), ("d", F.col("differ"))) for side, f in (("low", F.min), ("high", F.max))]
    lists = each.groupBy("pivot").agg(F.count("*").alias("members"), blocks(F.sum(F.when(F.col("outside"), F.col("c")))).alias("across"), blocks(F.sum("c")).alias("down"), *bounds)
    lists = lists.where((F.col("members") > 1) & (F.col("across") > 0)).drop("members")
    # sizes and differences of any partner of a member outside; members beyond both are left out before features are joined
    most, n = F.col("high_n") + F.col("n"), F.col("n")
    near = (4 * n >= 3 * F.col("low_n")) & (3 * n <= 4 * F.col("high_n"))
    near &= (7 * (F.col("differ") - F.col("high_d")) <= most) & (7 * (F.col("low_d") - F.col("differ")) <= most)
    each = each.withColumn("n", _size("key")).join(lists, "pivot").where(F.col("outside") | near).join(sets.select("key", "feats"), "key")
    place = lambda salt, n: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n)).cast("int")
    all_of = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    cell = lambda i, j, other: F.struct(i.alias("i"), j.alias("j"), F.lit(other).alias("other"))
    others = all_of("across", lambda i: cell(i, place(2, "down"), True))
    asked = all_of("down", lambda j: cell(place(1, "across"), j, False))
    rows = each.select("*", F.explode(F.when(F.col("outside"), F.concat(others, asked)).otherwise(others)).alias("cell")).select("*", "cell.*")
    rows = rows.select(*[x.split()[0] for x in LISTED.split(", ")]).repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    return rows.mapInArrow(_left_over, LINKS)


def similar_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, component_id, component_key) of every row, and the links (a, b, similarity) between classes.

    Links hold the comparisons that were needed to connect what is connected:
    pairs that a path of other links joins already may be left out. The key of
    a component tells apart those without any doc_id; empty sets have none.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    n = bucket_count(docs, BUCKET_BYTES)
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), text_bytes())
    found = stored(source.mapInArrow(_scan(n), EXCHANGE).groupBy("bucket").applyInArrow(_shared, FOUND))
    rows = found.where("batch is null").select("key", "doc_id", "text_hash", "n")
    sets = found.where("batch is not null").select("batch", "entries", "keys").groupBy("batch").applyInArrow(_gathered, SHARED)
    sets = stored_by_key(sets.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "c", "feats")]), "key")  # copies in several batches have equal rows
    buckets = bucket_count(sets, BUCKET_BYTES, text="feats")
    early = compared_pairs(star_pairs(_labels(sets), buckets, few=True), sets)
    roots = components(_linked(early))
    compared = compared_pairs(star_pairs(_labels(sets, roots), buckets), sets)
    links = _linked(early).union(_linked(compared)).distinct()
    roots = components(links)
    more = stored(left_over_links(compared, sets, roots))
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
    forget(sets)
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    named = stored(classes.join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("root"), "rep"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stored(named.join(least, "root").select("key", "root", "component_id"))
    out = rows.join(named, "key", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("root").alias("component_key"))
    return out, links
