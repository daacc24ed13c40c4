"""Texts whose word 5-grams overlap: a Jaccard self-join along chosen paths.

Method. Every text becomes a set of shingles (windows of five words), and equal sets become one.
A set's path in a run picks one of its elements at a time: the coordinate is drawn from the path
so far, the element is the set's minimum under that coordinate's hash, so two sets at Jaccard
similarity s stay together at each step with probability s. A bucket is split on while it holds
more than ``LEAF`` sets, at most ``DEPTH`` times, so most pairs are met after one step. Runs are
repeated until a pair at the threshold that goes through all steps is met with the target recall:
``runs = log(1 - recall) / log(1 - threshold ** DEPTH)``.

Buckets are brute-forced on 128-byte sketches, which a pair at the threshold passes but for four
standard deviations; buckets that are still large are cut in blocks, and each pair of blocks is
brute-forced, so nothing is skipped. The pairs that pass link sets to candidate components. In
each component every pair is compared exactly, again in pairs of blocks if it is large, and the
exact links give the classes. So a link is lost only if no chain of met pairs joins its ends.

What leaves a task is linear in its sets: a link to the local root, and sums of links. Pairs are
never rows; components are found by rounds of joins over tables in the shared folder; a copy
group of any size is one set, weighted by its size. Large buckets, classes and copy groups are
salted where they are joined to their counts.

Defined cases: words are runs of characters other than space and ASCII 9 to 13, compared as they
are; a text of one to four words is one shingle; null, empty and blank texts have none, and each
is a class of its own without links; a document's links are the other documents at or over the
threshold, copies included; repeated rows count as copies; null identifiers are carried, and a
class of nulls has a null class id; an empty table gives an empty result; extra columns pass through, but one
that has the name of a result gives way to it. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop_written, in_arrow, join_spread, map_beside, with_room, written

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
DEPTH = 3
LEAF = 48
COORDINATES = 128
BLOCK = 512
BLOCK_SHINGLES = 1 << 19
SLICE_BYTES = 1 << 19

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15
_Q = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(SHINGLE)], _U)
_rng = np.random.Generator(np.random.PCG64(20240101))
_A = _rng.integers(0, 1 << 63, COORDINATES, _U) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; those of a slice are remembered."""
    if len(_powers.get("p", ())) >= n:
        return _powers["p"][:n], _powers["i"][:n]
    made = {}
    for key, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
        a = np.full(max(n, SLICE_BYTES), base, _U)
        a[0] = 1
        made[key] = np.cumprod(a)
    if n <= SLICE_BYTES:
        _powers.update(made)
    return made["p"][:n], made["i"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie end to end in ``data``, and each text's first word's number."""
    n = len(data)
    space = np.ones(n + 1, bool)
    space[:n] = _SPACE[data]
    before = np.ones(n, bool)
    before[1:] = space[: n - 1]
    before[starts[starts < n]] = True
    first = np.flatnonzero(~space[:n] & before)
    after = np.ones(n, bool)
    after[:-1] = space[1:n]
    after[starts[(starts > 0) & (starts <= n)] - 1] = True
    last = np.flatnonzero(~space[:n] & after)
    power, inverse = _power(max(n, 1))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * power)])
    return mix((sums[last + 1] - sums[first]) * inverse[first]), np.searchsorted(first, starts)


def _stretches(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in stretches of about a slice, which end at white space: no word is cut."""
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        while end < len(data) and not _SPACE[part := data[end : end + SLICE_BYTES]].any():
            end += SLICE_BYTES
        if end < len(data):
            end += int(_SPACE[part].argmax())
        yield data[at:end]
        at = end


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles, in order; a null has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
    slice_of = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + a : texts.offset + b + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if b > a else np.zeros(0, np.uint8)
        if not len(data):
            words, at = np.zeros(0, _U), np.zeros(b - a + 1, np.int64)
        elif b - a == 1 and len(data) > SLICE_BYTES:
            words = np.concatenate([word_hashes(part, np.zeros(1, np.int64))[0] for part in _stretches(data)])
            at = np.array([0, len(words)])
        else:
            words, at = word_hashes(data, bounds - bounds[0])
        windows = np.zeros(max(0, len(words) - SHINGLE + 1), _U)
        for k in range(SHINGLE):
            windows += words[k : len(words) - SHINGLE + 1 + k] * _Q[k]
        windows = mix(windows)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i >= SHINGLE:
                yield np.unique(windows[i : j - SHINGLE + 1])
            elif j > i:
                yield mix((words[i:j] * _Q[: j - i]).sum(keepdims=True, dtype=_U) + _U(j - i))
            else:
                yield np.zeros(0, _U)


def signature(values: np.ndarray) -> np.ndarray:
    """The minimum of the set under each coordinate's hash, as 32 bits."""
    best = np.full(COORDINATES, ~_U(0))
    for at in range(0, len(values), 4096):
        best = np.minimum(best, (values[at : at + 4096] * _A[:, None]).min(axis=1))
    return (best >> _U(32)).astype(np.uint32)


def paths(signatures: np.ndarray, runs: int) -> np.ndarray:
    """(sets, runs, DEPTH) path keys: each step's coordinate is drawn from the path before it."""
    key = np.broadcast_to(mix(np.arange(1, runs + 1, dtype=_U) * _U(_P)), (len(signatures), runs))
    out = np.empty((len(signatures), runs, DEPTH), _U)
    for step in range(DEPTH):
        coordinate = (key % _U(COORDINATES)).astype(np.int64)
        drawn = np.take_along_axis(signatures, coordinate, axis=1).astype(_U)
        key = mix(key + mix(drawn + (coordinate.astype(_U) << _U(32)) + _U(step + 1)))
        out[:, :, step] = key
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to (text, row) batches the set's identity, size, and signature."""
    for batch in batches:
        ids, sizes, signs = [], [], []
        for s in shingle_sets(batch.column(0)):
            sizes.append(len(s))
            ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            signs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary())], ["__row", "__set", "__size", "__sign"])


def _spread(runs: int) -> callable:
    """(set, signature) to one row for each run: the set and its path's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, COORDINATES)
            keys = paths(signs, runs).reshape(n * runs, DEPTH).view(np.int64)
            sets = batch.column(0).take(pa.array(np.repeat(np.arange(n), runs)))
            yield pa.RecordBatch.from_arrays([sets, *(pa.array(keys[:, k]) for k in range(DEPTH))], ["s", *(f"k{k}" for k in range(DEPTH))])

    return run


def local_roots(linked: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    """Lowers the labels of rows (``first``) and columns (``second``) to the smallest that links reach; both stay as they are where none does."""
    if not linked.any():
        return
    most = max(int(first.max()), int(second.max())) + 1
    while True:
        down = np.minimum(second, np.where(linked, first[:, None], most).min(axis=0))
        up = np.minimum(first, np.where(linked, down[None, :], most).min(axis=1))
        if (down == second).all() and (up == first).all():
            return
        first[:], second[:] = up, down


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches; a group is as large as its block pair."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class _Sides:
    """A block pair's rows: those of block ``bi`` and those of ``bj``, which are the same where it is a block with itself."""

    def __init__(self, group: pa.Table):
        ids = group.column("s").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids = [ids[i] for i in order]
        order, block = np.array(order, np.int64), group.column("block").to_numpy()
        self.same = group.column("bi")[0].as_py() == group.column("bj")[0].as_py()
        mine = block[order] == group.column("bi")[0].as_py()
        #: Places in ``ids`` of each side's rows, and the rows themselves.
        self.places = (np.flatnonzero(mine), np.flatnonzero(mine if self.same else ~mine))
        self.rows = tuple(order[p] for p in self.places)

    def roots(self, linked: np.ndarray) -> np.ndarray:
        """For each place, the first place that it is joined to."""
        first, second = (p.copy() for p in self.places)
        local_roots(linked | linked.T if self.same else linked, first, second)
        out = np.arange(len(self.ids))
        out[self.places[0]], out[self.places[1]] = first, second
        return out


def _bucket_links(least: int) -> callable:
    """Sorted (leaf, bi, bj, block, set, sketch) to links between sets whose sketches agree at ``least`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[bytes] = []
        v: list[bytes] = []
        for group in _groups(batches, ["leaf", "bi", "bj"]):
            sides = _Sides(group)
            sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            a, b = (sketches[r] for r in sides.rows)
            linked = np.zeros((len(a), len(b)), bool)
            for i in range(len(a)):
                j = i + 1 if sides.same else 0
                linked[i, j:] = (b[j:] == a[i]).sum(axis=1) >= least
            for i, r in enumerate(sides.roots(linked).tolist()):
                if sides.ids[i] != sides.ids[r]:
                    u.append(sides.ids[i])
                    v.append(sides.ids[r])
            if len(u) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return run


def _by_value(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of the sets in order, and the number of the set that each is from."""
    values = np.concatenate(sets) if sets else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    return values[order], owner[order]


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The whole numbers of [start, start + count), one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


COLUMNS, FEW = 512, 16


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The matrix of the intersection sizes of the sets of ``a`` with those of ``b``.

    A shingle that few pairs share adds one to each of them; the others are columns of two 0/1
    matrices, ``COLUMNS`` at a time, whose product adds them to all pairs at once.
    """
    out = np.zeros(len(a) * len(b), np.int64)
    (va, oa), (vb, ob) = _by_value(a), _by_value(b)
    shared = np.intersect1d(va, vb)
    fa, fb = np.searchsorted(va, shared), np.searchsorted(vb, shared)
    ca, cb = np.searchsorted(va, shared, "right") - fa, np.searchsorted(vb, shared, "right") - fb
    few = np.flatnonzero(ca * cb <= FEW)
    for at in range(0, len(few), 1 << 15):
        k = few[at : at + (1 << 15)]
        times = ca[k] * cb[k]
        k, turn = np.repeat(k, times), _spans(np.zeros(len(k), np.int64), times)
        pair = oa[fa[k] + turn // cb[k]].astype(np.int64) * len(b) + ob[fb[k] + turn % cb[k]]
        out += np.bincount(pair, minlength=len(out))
    out = out.reshape(len(a), len(b))
    many = np.flatnonzero(ca * cb > FEW)
    for at in range(0, len(many), COLUMNS):
        k = many[at : at + COLUMNS]
        sides = []
        for n, owner, first, count in ((len(a), oa, fa[k], ca[k]), (len(b), ob, fb[k], cb[k])):
            ones = np.zeros((n, len(k)), np.float32)
            ones[owner[_spans(first, count)], np.repeat(np.arange(len(k)), count)] = 1
            sides.append(ones)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _verify(threshold: Fraction) -> callable:
    """Sorted (comp, bi, bj, block, set, copies, text) to each set's exact links here and its local root."""
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["comp", "bi", "bj"]):
            sides = _Sides(group)
            sets = [s for chunk in group.column("text").chunks for s in shingle_sets(chunk)]
            a, b = ([sets[i] for i in r.tolist()] for r in sides.rows)
            copies = group.column("copies").to_numpy()
            na, nb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
            linked = overlaps(a, b) * (p + q) >= p * (na[:, None] + nb[None, :])
            if sides.same:
                linked = np.triu(linked, 1)
            links = np.zeros(len(sets), np.int64)
            links[sides.places[0]] += linked @ copies[sides.rows[1]]
            links[sides.places[1]] += copies[sides.rows[0]] @ linked
            roots = [sides.ids[r] for r in sides.roots(linked).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(sides.ids, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], ["s", "links", "root"])

    return run


def _block_pairs(df: DataFrame, blocks: str, key: str) -> DataFrame:
    """Each row for every pair of blocks that its own is in: (bi, bj) with bi <= bj."""
    df = df.withColumn("block", F.pmod(F.xxhash64(key), F.col(blocks)).cast("int"))
    df = df.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return df.withColumn("bi", F.least("block", "__o").cast("int")).withColumn("bj", F.greatest("block", "__o").cast("int")).drop("__o")


def components(links: DataFrame) -> DataFrame:
    """(s, root) for the ends of ``links`` (u, v): the smallest of each connected component.

    Labels fall to the smallest among neighbours, then to their label's label, until none falls.
    An end of many links, and a label of many sets, are salted where they are joined.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = written(both.distinct(), "links", rows=both.count())
    n = both.count()
    degrees = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    table = written(degrees.select(F.col("u").alias("s"), F.least("u", "m").alias("root"), "n"), "labels", rows=n)
    labels = table
    while True:
        ends = labels.select(F.col("s").alias("__s"), F.col("root").alias("__root"), F.col("n").alias("__n"))
        near = join_spread(both, "v", ends, "__s", "__n", F.col("u"), n).groupBy(F.col("u").alias("__u")).agg(F.min("__root").alias("near"))
        step = labels.join(near, F.col("s") == F.col("__u")).select("s", "n", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        shared = labels.groupBy(F.col("root").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
        jump = labels.select("s", F.col("root").alias("__r")).join(shared, F.col("s") == F.col("__s"), "left").select(F.col("s").alias("__s"), "__r", F.coalesce("__n", F.lit(0)).alias("__n"))
        step = join_spread(step, "mid", jump, "__s", "__n", F.col("s"), n, hot=shared, how="left")
        new = written(step.select("s", F.least("mid", F.coalesce("__r", "mid")).alias("root"), "n", "was"), "labels", rows=n)
        changed = new.where(F.col("root") != F.col("was")).limit(1).count()
        drop_written(table)
        table, labels = new, new.select("s", "root", "n")
        if not changed:
            return labels.select("s", "root")


def _leaves(spread: DataFrame) -> DataFrame:
    """(leaf, n, s): sets in buckets of two or more, split on while a bucket has over LEAF of them."""
    out, rest, tables = None, spread, [spread]
    every = left = spread.count()
    for step in range(DEPTH):
        key = f"k{step}"
        counts = written(rest.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("leaf"), "n"), "counts", rows=left)
        tables.append(counts)
        met = join_spread(rest, key, counts, "leaf", "n", F.col("s"), left)
        done = (met if step == DEPTH - 1 else met.where(F.col("n") <= LEAF)).select("leaf", "n", "s")
        out = done if out is None else out.unionByName(done)
        if step < DEPTH - 1:
            rest = written(met.where(F.col("n") > LEAF).drop("leaf", "n"), "split", rows=left)
            left = rest.count()
            tables.append(rest)
    leaves = written(out, "leaves", rows=every)
    for table in tables:
        drop_written(table)
    return leaves


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, recall: float = RECALL, carry_text: bool = True) -> DataFrame:
    """All rows of ``df`` with class_id (the smallest identifier of the class), class_size, n_links and kept (one row of each class)."""
    limit = Fraction(threshold).limit_denominator(1000)
    runs = math.ceil(math.log(1 - recall) / math.log(1 - threshold**DEPTH))
    least = math.floor(COORDINATES * threshold - 4 * math.sqrt(COORDINATES * threshold * (1 - threshold)))
    df = with_room(df, [id_col, text_col], ["class_id", "class_size", "n_links", "kept", "root"])
    added = [T.StructField("__set", T.BinaryType()), T.StructField("__size", T.IntegerType()), T.StructField("__sign", T.BinaryType())]
    rows = written(map_beside(df, text_col, df.columns, _measure, added), "sets")

    id_ = F.col(f"`{id_col}`").cast("long")
    known = rows.where(F.col("__set").isNotNull())
    sets = known.groupBy(F.col("__set").alias("s")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(id_).alias("first"), F.first("__size").alias("size"), F.first("__sign").alias("sign"))
    sets = written(sets, "distinct")

    spread = in_arrow(sets.select("s", "sign"), _spread(runs), "s binary, " + ", ".join(f"k{k} bigint" for k in range(DEPTH)))
    leaves = _leaves(written(spread, "paths"))
    # The sketch: the low byte of each coordinate's minimum.
    sketch = F.unhex(F.regexp_replace(F.hex("sign"), "(..)......", "$1"))
    buckets = leaves.join(sets.select(F.col("s").alias("__s"), sketch.alias("sketch")), F.col("s") == F.col("__s")).drop("__s")
    buckets = _block_pairs(buckets.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "blocks", "s")
    buckets = buckets.select("leaf", "bi", "bj", "block", "s", "sketch").repartition("leaf", "bi", "bj").sortWithinPartitions("leaf", "bi", "bj")
    met = written(in_arrow(buckets, _bucket_links(least), "u binary, v binary"), "met")
    drop_written(leaves)
    comps = components(met).select("s", F.col("root").alias("comp"))

    # The text of a set is that of its first document.
    members = comps.join(sets.select("s", "copies", "first", "size"), "s")
    weight = members.groupBy("comp").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("c"))
    weight = weight.select(F.col("comp").alias("__c"), F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("c") / BLOCK)).cast("int").alias("blocks"))
    members = members.join(weight, F.col("comp") == F.col("__c")).drop("__c")
    texts = known.select(F.col("__set"), id_.alias("__id"), F.col(f"`{text_col}`").alias("text"))
    members = members.join(texts, (F.col("s") == F.col("__set")) & F.col("first").eqNullSafe(F.col("__id"))).drop("__set", "__id")
    members = members.dropDuplicates(["s"])
    pairs = _block_pairs(members, "blocks", "s").select("comp", "bi", "bj", "block", "s", "copies", "text")
    pairs = pairs.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    exact = written(in_arrow(pairs, _verify(limit), "s binary, links bigint, root binary"), "exact")
    joined = components(exact.where(F.col("s") != F.col("root")).select(F.col("s").alias("u"), F.col("root").alias("v")))

    linked = exact.groupBy("s").agg(F.sum("links").alias("links")).join(joined, "s", "left")
    full = sets.select("s", "copies", "first").join(linked, "s", "left").withColumn("root", F.coalesce("root", "s"))
    full = written(full.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1), "classes")
    classes = full.groupBy(F.col("root").alias("__r")).agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("__n"))
    by_set = full.select("s", "root", F.col("links").alias("n_links"), "copies")
    n_sets = full.count()
    by_set = join_spread(by_set, "root", written(classes, "class-sizes", rows=n_sets), "__r", "__n", F.col("s"), n_sets).drop("__r", "__n")

    own = rows if carry_text else rows.drop(text_col)
    by_set = by_set.select(F.col("s").alias("__s"), "root", "class_id", "class_size", "n_links", F.col("copies").alias("__copies"))
    hot = full.select(F.col("s").alias("__s"), F.col("copies").alias("__copies"))
    out = join_spread(own.drop("__size", "__sign"), "__set", by_set, "__s", "__copies", id_, rows.count(), hot=hot, how="left").drop("__s", "__copies")
    alone = F.col("__set").isNull()
    out = out.withColumn("class_id", F.when(alone, id_).otherwise(F.col("class_id")))
    out = out.withColumn("class_size", F.coalesce("class_size", F.lit(1)).cast("long")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    # One of the rows that carry the class's identifier is kept; there are several only if identifiers repeat.
    maybe = (~alone) & id_.eqNullSafe(F.col("class_id"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("__set"))
    chosen = out.where(maybe).withColumn("kept", place == 1)
    others = out.where(~maybe).withColumn("kept", F.col("__set").isNull())
    return others.unionByName(chosen).drop("__set", "root")
