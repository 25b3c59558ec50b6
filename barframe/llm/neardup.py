"""Near-duplicates by SetSketch registers.

A document's set of five-word shingles becomes ``REGISTERS`` registers. A register is the minimum of an
exponentially distributed hash over the set, on a logarithmic scale of base ``SCALE`` and truncated to 16
bits; the sketch of a union is the register-wise maximum. Equal registers are as likely as the sets are
similar, so bands of registers name buckets in which similar sets meet. Two sketches give a joint estimate:
the similarity that makes the counts of larger, smaller and equal registers likeliest, the set sizes being
known. What may reach the threshold by it is confirmed on the full sets.

Work within buckets stays linear while it can: first all members meet one pivot, then the member that is most
like a pivot (the original of a family of copies); members that are linked by then need no further test.
Members of a bucket that are still apart are compared in blocks, all of them, so no link that shares a bucket
is lost: sketches first, then the full sets of those that have a hopeful pair. A block yields links, not pairs.

Recall: at similarity s a pair shares a bucket with 1 - (1 - s**ROWS) ** BANDS, 0.99999998 at 0.85 and
0.999993 at 0.8, and the estimate lies within ``SIGMAS`` standard errors with 0.999997.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; fewer
than five words are one shingle; equal texts are one node; rows without id are kept and link with nothing;
rows of one id with different texts are nodes of their own; an empty table gives an empty result. In
``without_duplicates``, of several rows with the same id one stays for each component that the id names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm import bloom
from barframe.llm.common import BASE_2, U64, Words, chunks, free_name, map_arrow, mixed, signed, windows
from barframe.llm.components import components
from barframe.session import cut, settle

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base of the scale, and the rate that keeps small sets off the lower end.
SCALE, RATE = 1.001, 20.0
SIGMAS = 4.5
#: Members of a bucket that one task compares with as many others.
BLOCK = 512

_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_MULTIPLY = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are folded."""
    words = Words(column)
    hashes = words.hashes(lower=True)
    found, _, docs = windows(hashes, words.first, SHINGLE)
    counts = words.per_document
    ends = np.cumsum(np.bincount(docs, minlength=len(counts))) if len(found) else np.zeros(len(counts), np.int64)
    out = []
    for i, n in enumerate(counts):
        if n >= SHINGLE:
            out.append(np.unique(found[ends[i - 1] if i else 0 : ends[i]]))
        elif n:
            whole, _, _ = windows(hashes[words.first[i] : words.first[i + 1]], np.array([0, n]), int(n), BASE_2)
            out.append(mixed(whole + U64(n)))
        else:
            out.append(np.empty(0, U64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, one row a set."""
    sizes = np.array([len(s) for s in sets])
    x = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    least = np.empty((len(sets), REGISTERS), np.uint32)
    step = 1 << 15
    # A few thousand shingles at a time stay in the cache through all registers; sets are not split.
    at = 0
    while at < len(sets):
        to = max(at + 1, int(np.searchsorted(starts + sizes, starts[at] + step, side="right")))
        part, begins = x[starts[at] : starts[to - 1] + sizes[to - 1]], starts[at:to] - starts[at]
        for i in range(REGISTERS):
            h = (part ^ _XOR[i]) * _MULTIPLY[i]
            least[at:to, i] = np.minimum.reduceat(h ^ (h >> np.uint32(15)), begins)
        at = to
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(SCALE)), 0, 65535).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches (one row a pair), the likeliest for their register counts and set sizes."""
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    return _likeliest(more, less, a.shape[-1] - more - less, size_a / (size_a + size_b))


def _likeliest(more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    v = 1 - u
    low, high = np.zeros(np.shape(u)), np.minimum(u / v, v / u)

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = share(u - v * j), share(v - u * j)
        tiny = 1e-12
        return more * np.log(p + tiny) + less * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, 0) + tiny)

    for _ in range(30):  # the likelihood has one peak
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(a) < likelihood(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - SIGMAS * (s * (1 - s) / REGISTERS) ** 0.5


def _sketch(batches):
    for batch in chunks(batches):
        sets = shingle_sets(batch.column("text"))
        full = [i for i, s in enumerate(sets) if len(s)]
        keys, sizes, rows = np.zeros((2, len(sets)), U64), np.array([len(s) for s in sets]), [None] * len(sets)
        if full:
            for i, r in zip(full, sketches([sets[i] for i in full]), strict=True):
                rows[i] = r.tobytes()
                keys[0, i], keys[1, i] = mixed(sets[i]).sum(), mixed(sets[i] ^ U64(0x5851F42D4C957F2D)).sum()
        yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(sizes), signed(keys[0]), signed(keys[1]), pa.array(rows, pa.binary())],
                              names=["doc_id", "mark", "n_shingles", "key", "key2", "sketch"])


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            r = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(U64)
            band = np.tile(np.arange(BANDS, dtype=U64), len(r))
            packed = np.zeros(r.shape[:2], U64)
            for k in range(ROWS):
                packed = mixed(packed + r[:, :, k] + U64(1))
            packed = packed.ravel()
            yield pa.record_batch([signed(mixed(packed + mixed(band + U64(1)))), pa.array(band.astype(np.int32)), pa.array(np.repeat(batch.column("key").to_numpy(), BANDS))], names=["band", "no", "key"])


def _hopeful(percent: int):
    least = least_estimate(percent)

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
                n, m = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
                fit = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (estimate(a, b, n, m) >= least)
                yield pa.record_batch([batch.column("a").filter(pa.array(fit)), batch.column("b").filter(pa.array(fit))], names=["a", "b"])

    return keep


def _groups(batches, columns: tuple[str, ...]):
    """Runs of rows that agree in ``columns``, as tables; rows come sorted by them, a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(c).to_numpy() for c in columns]
        new = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
            part = batch.slice(a, b - a)
            if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in columns):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


_BLOCK = ("band", "i", "j")


def _apart_pairs(rows: pa.Table, percent: int, least: float) -> np.ndarray:
    """Pairs of one (bucket, block, block) that may be similar and are in different components, the likeliest first.

    A pair that meets in several buckets counts in the one of its first equal band only.
    """
    key, component, size, side, no = (rows.column(c).to_numpy() for c in ("key", "component", "n_shingles", "side", "no"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    out = [np.empty((0, 3))]
    for part in np.array_split(left, -(-len(left) // 32)):
        n, m = size[part][:, None], size[right][None, :]
        apart = (component[part][:, None] != component[right][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        i, k = np.nonzero(apart & ((key[part][:, None] < key[right][None, :]) | (right is not left)))
        for lot in np.array_split(np.arange(len(i)), -(-len(i) // 20_000) or 1):
            x, y = part[i[lot]], right[k[lot]]
            bands = (sketch[x] == sketch[y]).reshape(len(x), BANDS, ROWS).all(-1)
            here = bands.argmax(-1) == no[0] if len(x) else np.empty(0, bool)
            x, y = x[here], y[here]
            if len(x):
                near = estimate(sketch[x], sketch[y], size[x], size[y])
                out.append(np.column_stack([x, y, near])[near >= least])
    pairs = np.concatenate(out)
    return pairs[np.argsort(-pairs[:, 2], kind="stable"), :2].astype(np.int64)


def _open_members(percent: int):
    """The members that have such a pair; all others need not show their sets."""
    least = least_estimate(percent)

    def run(batches):
        for rows in _groups(batches, _BLOCK):
            needed = np.unique(_apart_pairs(rows, percent, least))
            if len(needed):
                yield from rows.select([*_BLOCK, "no", "side", "key", "component"]).take(pa.array(needed)).combine_chunks().to_batches()

    return run


def _links_within(percent: int):
    """Links between components, confirmed on full sets. Two components that a link has joined are not tested again."""
    least = least_estimate(percent)

    def run(batches):
        for rows in _groups(batches, _BLOCK):
            key, component = rows.column("key").to_numpy(), rows.column("component").to_numpy()
            sets = [np.asarray(x.values) for x in rows.column("shingles")]
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            links = []
            for x, y in _apart_pairs(rows, percent, least):
                p, q = top(int(component[x])), top(int(component[y]))
                if p != q:
                    both = np.intersect1d(sets[x], sets[y], assume_unique=True).size
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        parent[max(p, q)] = min(p, q)
                        links.append((int(key[x]), int(key[y])))
            if links:
                yield pa.record_batch([pa.array(v, pa.int64()) for v in zip(*links, strict=True)], names=["a", "b"])

    return run


class _Nodes:
    """Sketches and full sets of the distinct texts that share a bucket, written once."""

    def __init__(self, nodes: DataFrame, buckets: DataFrame, rows: DataFrame, percent: int):
        self.percent = percent
        self.nodes = cut(nodes.join(buckets.select("key").distinct(), "key"), "near-nodes")
        # Texts are not moved: a filter of the nodes' documents goes to them. The few others that pass are harmless.
        wanted = rows.sparkSession.sparkContext.broadcast(bloom.made_of(cut(self.nodes.select(F.xxhash64("doc_id", "mark").alias("h")), "near-wanted")))
        hashed = rows.where("doc_id is not null").select(F.xxhash64("doc_id", "mark").alias("h"), "text")
        self.sets = cut(map_arrow(hashed, _sets(wanted), "key long, shingles array<long>").dropDuplicates(["key"]), "near-sets")

    def hopeful(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.nodes.select(F.col("key").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        return map_arrow(pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b"), _hopeful(self.percent), "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.sets.select(F.col("key").alias(x), F.col("shingles").alias(f"set_{x}"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        counted = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either"))
        return counted.where(100 * F.col("both") >= self.percent * F.col("either")).select("a", "b", (F.col("both") / F.col("either")).alias("similarity"))


def _sets(wanted: Broadcast):
    """The full sets of the rows whose hash passes the filter, under their key."""

    def run(batches):
        for batch in batches:
            passing = bloom.holds(wanted.value, batch.column("h").to_numpy().view(U64))
            for part in chunks(iter([batch.filter(pa.array(passing))])):
                sets = [s for s in shingle_sets(part.column("text")) if len(s)]
                if sets:
                    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                    keys = np.array([mixed(s).sum() for s in sets], U64)
                    yield pa.record_batch([signed(keys), pa.ListArray.from_arrays(pa.array(offsets), signed(np.concatenate(sets)))], names=["key", "shingles"])

    return run


def _apart(buckets: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """Members of buckets that hold more than one component so far, with their component."""
    labels = components(links, label).withColumnRenamed("id", "key")
    members = buckets.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    open_ = members.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members")).where("x < y").drop("x", "y")
    return cut(members.join(open_, "band"), label)


def linked(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``_linked``, written, with all its steps deleted."""
    return settle(documents.sparkSession, lambda: _linked(documents, percent), "near-linked")


def _linked(documents: DataFrame, percent: int) -> DataFrame:
    """(doc_id, mark, n_shingles, component, component_id) of every row of ``documents``; ``mark`` is the hash of its text.

    ``component`` tells apart components of one id with unrelated texts; it is null where the set is empty.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    sketched = cut(map_arrow(rows, _sketch, "doc_id long, mark long, n_shingles long, key long, key2 long, sketch binary"), "near-sketches")
    able = sketched.where("doc_id is not null and n_shingles > 0")
    nodes = cut(able.groupBy("key", "key2").agg(F.min(F.struct("doc_id", "mark")).alias("f"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
                .select("key", "key2", "f.*", "n_shingles", "sketch"), "near-all-nodes")
    banded = map_arrow(nodes.select("key", "sketch"), _bands, "band long, no int, key long")
    pivots = banded.groupBy("band").agg(F.min("key").alias("pivot"), F.max("key").alias("last")).where("pivot < last").drop("last")
    buckets = cut(banded.join(pivots, "band"), "near-buckets")
    known = _Nodes(nodes, buckets, rows, percent)

    links = cut(known.confirmed(known.hopeful(buckets.where("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")))), "near-links-1")
    # Second pivot of a bucket: of the members other than the first, the one most like a node it was linked with.
    apart = _apart(buckets, links, "near-apart-1")
    nearest = links.selectExpr("a as key", "similarity").unionByName(links.selectExpr("b as key", "similarity")).groupBy("key").agg(F.max("similarity").alias("similarity"))
    ranked = apart.join(nearest, "key", "left").withColumn("rank", F.struct(F.coalesce("similarity", F.lit(0.0)).alias("s"), F.col("key").alias("k"), F.col("component").alias("c")))
    second = ranked.where("key <> pivot").groupBy("band").agg(F.max("rank").alias("r")).select("band", F.col("r.k").alias("next"), F.col("r.c").alias("next_component"))
    tested = apart.join(second, "band").where("component <> next_component").select(F.least("next", "key").alias("a"), F.greatest("next", "key").alias("b"))
    links = cut(links.unionByName(known.confirmed(known.hopeful(tested))), "near-links-2")
    # What is still apart meets in blocks.
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = _apart(buckets, links, "near-apart-2").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "no", (F.col("block") > F.col("other")).cast("int").alias("side"), "key", "component")
    sketches_ = known.nodes.select("key", "n_shingles", "sketch")
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since the work is not in proportion to bytes
    facing = dealt.join(sketches_, "key").repartition(tasks, *_BLOCK).sortWithinPartitions(*_BLOCK)
    open_ = cut(map_arrow(facing, _open_members(percent), "band long, i int, j int, no int, side int, key long, component long"), "near-open")
    facing = open_.join(sketches_, "key").join(known.sets, "key").repartition(tasks, *_BLOCK).sortWithinPartitions(*_BLOCK)
    links = links.select("a", "b").unionByName(map_arrow(facing, _links_within(percent), "a long, b long"))
    groups = components(links.select("a", "b"), "near-groups").withColumnRenamed("id", "key")
    # A component is named by its smallest document.
    named = nodes.select("key", "key2", "doc_id").join(groups, "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "component").select("key", "key2", "component", "component_id")
    return sketched.join(named, ["key", "key2"], "left").select("doc_id", "mark", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return linked(documents, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, one of each group; all columns as they are.

    A filter tells rows that surely stay from those in question; only the latter are moved, and only ids and texts that
    stand in several rows are gathered.
    """
    mark, spare, an_id, its_mark, rows = (free_name(documents, x) for x in ("near_mark", "near_row", "near_id", "near_id_mark", "near_rows"))
    spark = documents.sparkSession

    def decided() -> DataFrame:
        one = linked(documents, percent).where("doc_id is not null").withColumn("stays", F.col("doc_id") == F.col("component_id"))
        kept = one.where("stays").groupBy("doc_id", "component", "mark").agg(F.count(F.lit(1)).alias("n"))
        kept = kept.groupBy("doc_id", "component").agg(F.min(F.struct("mark", "n")).alias("k")).select("doc_id", "k.mark", "k.n")
        # Rows in question: those of a (doc_id, mark) that goes, or that stands in several rows.
        rows_ = one.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("all")).join(kept, ["doc_id", "mark"], "left")
        return rows_.where("n is null or all > 1").select(F.col("doc_id").alias(an_id), F.col("mark").alias(its_mark), F.col("n").isNotNull().alias(rows))

    asked = settle(spark, decided, "near-asked")
    filter_ = spark.sparkContext.broadcast(bloom.made_of(settle(spark, lambda: asked.select(F.xxhash64(an_id, its_mark).alias("h")), "near-asked-hashes")))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.holds(filter_.value, h.to_numpy().view(U64)))

    # Only rows that the filter holds are moved, to meet the decision; all others stay where they are.
    marked = documents.withColumn(mark, F.xxhash64("text")).withColumn(spare, F.col("doc_id").isNotNull() & maybe(F.xxhash64(F.col("doc_id").cast("long"), F.col(mark))))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    met = (F.col("doc_id").cast("long") == F.col(an_id)) & (F.col(mark) == F.col(its_mark))
    moved = marked.where(F.col(spare)).join(asked, met, "left")
    several = moved.where(F.col(rows)).groupBy(an_id, its_mark).agg(F.min(F.struct(*columns)).alias(spare)).select(f"{spare}.*")
    return marked.where(~F.col(spare)).select(*columns).unionByName(moved.where(F.col(rows).isNull()).select(*columns)).unionByName(several)
