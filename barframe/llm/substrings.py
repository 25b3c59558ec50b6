"""Removal of repeated passages by difference-cover anchors.

A passage counts as repeated if a window of ``WINDOW`` words also starts in a document with a smaller id;
all words under such windows go. Comparing every window with every other is what anchors save: of each
document only the ``ANCHOR``-word runs at positions in a difference cover modulo ``PERIOD`` are hashed.
For any two positions there is a shift below PERIOD that brings both into the cover, and
PERIOD - 1 + ANCHOR <= WINDOW, so two equal windows always share an anchor at the same place within them.
Anchors that two different texts share are extended to all windows around them, and only those windows are
compared, by 96-bit hashes.

Equal texts are one text: its smallest id stands for it, and each copy of at least WINDOW words goes whole.

Defined results: a null or empty text has no words and keeps the digest of the empty string; rows without
id are left as they are and remove nothing elsewhere; rows of one id never remove each other's words; an
empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.llm.common import BASE_1, BASE_2, U64, Words, chunks, map_arrow, mixed, release, signed, windows
from barframe.session import cut

WINDOW = 13
PERIOD, ANCHOR = 7, 7
#: A perfect difference set: every remainder modulo 7 is a difference of two members.
COVER = np.isin(np.arange(PERIOD), (0, 1, 3))
#: Anchors only propose windows, so 48 bits do: a chance agreement costs a comparison, never a result.
ANCHOR_BITS = U64(2**48 - 1)
EMPTY = hashlib.sha256(b"").hexdigest()


def _text_keys(hashes: np.ndarray, first: np.ndarray, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of each document's word sequence."""
    counts = np.diff(first)
    out = counts.astype(U64)
    full = counts > 0
    if len(hashes):
        powers = np.cumprod(np.full(int(counts.max()), base, U64))
        inside = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
        out[full] += np.add.reduceat(hashes * powers[inside], first[:-1][full])
    return mixed(out)


def _summary(batches):
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        keys = [_text_keys(words.hashes(second), words.first, base) for second, base in ((False, BASE_1), (True, BASE_2))]
        plain = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(words.per_document), signed(keys[0]), signed(keys[1]), batch.column("mark"), pa.array(plain)],
                              names=["doc_id", "n_words", "key", "key2", "mark", "plain"])


def _anchors(batches):
    """(text key, anchor) at the cover positions of every text that is long enough to hold a window."""
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        hashes = words.hashes()
        keys = _text_keys(hashes, words.first, BASE_1)
        found, at, docs = windows(hashes, words.first, ANCHOR)
        use = COVER[(at - words.first[docs]) % PERIOD] & (words.per_document[docs] >= WINDOW)
        if use.any():
            yield pa.record_batch([signed(keys[docs[use]]), signed(found[use] & ANCHOR_BITS)], names=["key", "anchor"])


def _half(x: np.ndarray) -> pa.Array:
    return pa.array((x >> U64(32)).astype(np.uint32).view(np.int32))


def _windows_around(batches):
    """Every window around a shared anchor: its 96-bit hash, document and start."""
    for batch in chunks(batches):
        words = Words(batch.column("text"))
        one, two = words.hashes(), words.hashes(True)
        anchors, at, docs = windows(one, words.first, ANCHOR)
        use = np.flatnonzero(COVER[(at - words.first[docs]) % PERIOD])
        anchors, at, docs = (anchors[use] & ANCHOR_BITS).view(np.int64), at[use], docs[use]
        lists = batch.column("anchors")
        given = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        # Anchor and document as one number each, both sides: sorted search over the chunk's own lists.
        pair = lambda a, d: mixed(a.view(U64) + mixed(d.astype(U64)))
        at = at[np.isin(pair(anchors, docs), pair(given.astype(np.int64), owner))]
        h1, starts, of = windows(one, words.first, WINDOW)
        h2, _, _ = windows(two, words.first, WINDOW, BASE_2)
        # Window starts lie at most WINDOW - ANCHOR before an anchor: count anchors by running sums.
        marks = np.zeros(len(one) + 1, np.int64)
        np.add.at(marks, at + 1, 1)
        upto = np.cumsum(marks)
        near = upto[np.minimum(starts + WINDOW - ANCHOR + 1, len(one))] > upto[starts]
        if near.any():
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False)[of[near]] for c in ("doc_id", "tag"))
            yield pa.record_batch([signed(h1[near]), _half(h2[near]), pa.array(ids), pa.array(tags), pa.array((starts - words.first[of])[near].astype(np.int32))],
                                  names=["h1", "h2", "doc_id", "tag", "start"])


def _without(batches):
    """What is left of each text when the words under the given windows go."""
    for batch in batches:
        keys, removed, digests = [], [], []
        for key, text, starts in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "starts")), strict=True):
            words = np.array((text or "").encode().split(), dtype=object)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.array(starts, np.int64), 1)
            np.add.at(edge, np.array(starts, np.int64) + WINDOW, -1)
            keep = np.cumsum(edge[:-1]) == 0
            keys.append(key)
            removed.append(int((~keep).sum()))
            digests.append(hashlib.sha256(b" ".join(words[keep])).hexdigest())
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["key", "n_removed", "kept"])


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """(text key, anchors that another text has too). Both uses of the anchors sum up or split their hot ones."""
    anchors = map_arrow(rows.where("doc_id is not null").select("text"), _anchors, "key long, anchor long")
    shared = anchors.groupBy("anchor").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("anchor")
    return cut(anchors.join(shared, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors")), "substring-anchors")


def repeated_windows(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary of every row, texts that share anchors, start of every window that a smaller id has too)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    summary = cut(map_arrow(rows, _summary, "doc_id long, n_words long, key long, key2 long, mark long, plain string"), "substring-summary")
    # One document stands for all with the same words; copies are summed up before they meet.
    firsts = summary.where(f"doc_id is not null and n_words >= {WINDOW}").groupBy("key", "key2").agg(F.min(F.struct("doc_id", "mark")).alias("f")).select("key", "f.*")
    proposed = firsts.join(_shared_anchors(rows), "key")
    release(rows.sparkSession)
    # ``tag`` tells apart texts of one id; windows are many, so they carry it instead of the whole key.
    tag = F.shiftright("key", 32).cast("int").alias("tag")
    texts = cut(proposed.join(rows, ["doc_id", "mark"]).select("doc_id", "key", tag, "anchors", "text"), "substring-texts")
    release(rows.sparkSession)
    near = cut(map_arrow(texts, _windows_around, "h1 long, h2 int, doc_id long, tag int, start int"), "substring-windows")
    release(rows.sparkSession)
    owners = near.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    repeated = near.join(owners, ["h1", "h2"]).where("doc_id > owner").select("doc_id", "tag", "start")
    return summary, texts, repeated


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    summary, texts, repeated = repeated_windows(documents)
    starts = cut(repeated.groupBy("doc_id", "tag").agg(F.collect_set("start").alias("starts")), "substring-starts")
    release(documents.sparkSession)
    cleaned = map_arrow(texts.select("doc_id", "tag", "key", "text").join(starts, ["doc_id", "tag"]).select("key", "text", "starts"), _without, "key long, n_removed long, kept string").dropDuplicates(["key"])
    firsts = summary.where("doc_id is not null").groupBy("key", "key2").agg(F.min("doc_id").alias("first_id"))
    known = firsts.join(cleaned, "key", "left")
    rows = summary.join(known, ["key", "key2"], "left")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    first = F.col("doc_id") == F.col("first_id")
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(first, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).when(first, F.coalesce("kept", "plain")).otherwise(F.col("plain")).alias("kept_sha256"))
