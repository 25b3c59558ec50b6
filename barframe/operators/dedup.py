"""Near-duplicate removal in arrival order, poll by poll.

The rule: walk the items of a poll in order; drop one whose normalised link equals, or whose title is
similar to, that of an item *kept* before. That is the greedy maximal independent set of a
conflict graph, which parallel rounds reproduce exactly (Blelloch, Fineman, Shun 2012): an
item without an undecided earlier neighbour is kept, neighbours of kept items are dropped.

* A poll is the unit: titles are compared within it only, so work grows with the number of polls.
* A poll of at most ``WALKED`` different items is walked as the rule says, in one row; almost every poll is one.
* Polls above that are decided by the rounds, side by side, in as many rounds as the longest chain of waiting
  items in any of them. Both ways give the same items.
* Items equal in both title and link collapse to their first before anything else.
* Equality conflicts (same link, same title) never become pairs; a group is represented by
  its first undecided item and by whether it already has a kept one.
* Fuzzy pairs come from all pairs of blocks of a poll's different titles, which is quadratic in a poll: the bound is
  so wide that common bigrams, counted by a product of matrices, leave a fifth of all pairs to bit vectors.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions.text import FUZZY_MIN_LENGTH, FUZZY_THRESHOLD, normalize_text, normalize_url
from barframe.session import cut

c = F.col
#: Different items of a poll that one row may hold; they are compared with the kept ones before them.
WALKED = 256
#: Titles of a block, pairs of titles whose distances are taken side by side, and the most tasks that pairs of blocks are dealt to.
BLOCK, PAIRS, MOST_TASKS = 2048, 8192, 10_000


def _bigrams(line: bytes) -> Counter:
    """Numbered bigrams, so that a set's overlap is the multiset's; from the eighth on they share a number, which adds to it only."""
    seen, out = Counter(), Counter()
    for pair in zip(line, line[1:]):
        out[*pair, min(seen[pair], 7)] += 1
        seen[pair] += 1
    return out


def _counts(lines: list[Counter], columns: dict) -> np.ndarray:
    """A row a line, a column a bigram of ``columns``."""
    out = np.zeros((len(lines), len(columns)), np.float32)
    for row, line in zip(out, lines):
        known = [(columns[g], k) for g, k in line.items() if g in columns]
        if known:
            at, k = zip(*known)
            row[list(at)] = k
    return out


def _distances(table: np.ndarray, inside: np.ndarray, letters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distances of title ``i`` and text ``j``, pair by pair, texts being of one length.

    Myers' bit vectors (1999): a column of the distance table is two bits a character, 64 characters a word, and
    a character of the text moves it on. ``table`` has the places of a letter in a title, ``inside`` all its places.
    """
    one, last = np.uint64(1), np.uint64(63)
    down = np.zeros((len(table), len(i)), np.uint64)
    up = ~down
    for letter in letters:
        more, less, x = one, np.uint64(0), letter[j]
        for w, (p, m) in enumerate(zip(up, down)):
            e = table[w][x, i]
            any_ = e | m
            e |= less
            h = (((e & p) + p) ^ p) | e
            plus, minus = ~(h | p) | m, p & h
            over = plus >> last, minus >> last
            plus, minus = (plus << one) | more, (minus << one) | less
            np.bitwise_or(minus, ~(any_ | plus), out=p)
            np.bitwise_and(plus, any_, out=m)
            more, less = over
    ends = inside[:, i]
    return len(letters) + (np.bitwise_count(up & ends).astype(int) - np.bitwise_count(down & ends)).sum(0)


def _similar(left: list[str], right: list[str]) -> np.ndarray:
    """Places in ``left`` and in ``right`` of ASCII titles within the edit bound.

    Texts of one length meet titles of a number of words. Those that share too few bigrams are left out first.
    """
    found = [np.empty((0, 2), np.int64)]
    ordered = lambda lines: sorted(((x.encode(), i) for i, x in enumerate(lines)), key=lambda x: len(x[0]))
    cut_up = lambda rows, many: (rows[k : k + many] for k in range(0, len(rows), many))
    texts = [(n, part) for n, same in groupby(ordered(right), lambda x: len(x[0])) for part in cut_up(list(same), 128)]
    grams = [[_bigrams(x) for x, _ in part] for _, part in texts]
    for words, run in groupby(ordered(left), lambda x: max(1, -(-len(x[0]) // 64))):
        for some in cut_up(list(run), max(1, BLOCK // words)):
            size, title_at = np.array([len(x) for x, _ in some]), np.array([i for _, i in some])
            codes = np.frombuffer(b"".join(x.ljust(64 * words, b"\xff") for x, _ in some), np.uint8).reshape(len(some), -1)
            packed = lambda hit: np.packbits(hit, axis=1, bitorder="little").view("<u8").T
            inside, table = packed(codes != 0xFF), np.zeros((words, 128, len(some)), np.uint64)
            for x in set(codes.ravel().tolist()) - {0xFF}:
                table[:, x] = packed(codes == x)
            lines = [_bigrams(x) for x, _ in some]
            columns = {g: k for k, g in enumerate(set().union(*lines))}
            held = _counts(lines, columns).T
            for (n, part), texts_grams in zip(texts, grams):
                least = n * (1.0 - FUZZY_THRESHOLD) if n >= FUZZY_MIN_LENGTH else FUZZY_MIN_LENGTH
                lo, hi = np.searchsorted(size, [least - 1e-6, n / (1.0 - FUZZY_THRESHOLD) + 1e-6])
                if lo == hi:
                    continue
                longest, text_at = np.maximum(size, n), np.array([i for _, i in part])
                shared = _counts(texts_grams, columns) @ held[:, lo:hi]
                near = np.argwhere(shared >= longest[lo:hi] * (1.0 - 2.0 * FUZZY_THRESHOLD) - 1.0 - 1e-6)
                letters = np.frombuffer(b"".join(x for x, _ in part), np.uint8).reshape(len(part), n).T
                for j, i in (pairs.T + [[0], [lo]] for pairs in cut_up(near, PAIRS)):
                    hit = _distances(table, inside, letters, i, j) / longest[i] <= FUZZY_THRESHOLD
                    found.append(np.stack([title_at[i[hit]], text_at[j[hit]]], axis=1))
    return np.concatenate(found)


def _similar_of_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Similar pairs, either way round, between the titles of blocks ``x`` and ``y`` of a poll."""
    x, y = rows["x"].iat[0], rows["y"].iat[0]
    one, two = rows[rows["b"] == x], rows[rows["b"] == y]
    found = _similar(one["title"].tolist(), two["title"].tolist())
    a, b = one["id"].to_numpy()[found[:, 0]], two["id"].to_numpy()[found[:, 1]]
    if x == y:
        a, b = a[a != b], b[a != b]
    else:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    return pd.DataFrame({"_poll": rows["_poll"].iat[0], "tx": a, "ty": b})


def similar_pairs(titles: DataFrame) -> DataFrame:
    """Similar pairs (tx, ty) of ids, either way round, of ``titles``: (_poll, id, title), each title once a poll.

    Any two titles can be similar, so all are compared: a poll is dealt into blocks, and every two of its
    blocks are one small task. Titles are copied once a block; of the pairs only those found are kept.
    """
    sizes = cut(titles.groupBy("_poll").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks")), "blocks")
    pairs = sizes.agg(F.sum(c("_blocks") * (c("_blocks") + 1) / 2)).first()[0] or 1
    dealt = titles.join(sizes, "_poll").withColumn("b", F.pmod(F.xxhash64("title"), "_blocks"))
    beside = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), c("_blocks") - 1))).select(
        "_poll", "id", "title", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))
    by = ["_poll", "x", "y"]
    # More partitions than tasks, so that few of them share one.
    return beside.repartition(int(min(4 * pairs, MOST_TASKS)), *by).groupBy(*by).applyInPandas(_similar_of_blocks, "_poll string, tx long, ty long")


def _resolve(nodes: DataFrame) -> DataFrame:
    """Greedy rounds over ``_poll``s; returns the kept nodes."""
    keys = ["_poll"]
    titles = cut(nodes.groupBy(*keys, "title").agg(F.min("ord").alias("id")), "titles")
    edges = cut(similar_pairs(titles), "edges")
    nodes = nodes.join(titles, [*keys, "title"]).select(*keys, "ord", c("id").alias("title"), "url")
    state = cut(nodes.withColumn("state", F.lit(0)), "state")  # 0 undecided, 1 kept, 2 dropped
    while True:
        open_, kept = state.where("state = 0"), state.where("state = 1")
        by = lambda df, k: df.groupBy(*keys, k).agg(F.min("ord").alias("first_" + k))
        first_title = by(open_, "title")
        waits = edges.join(first_title.withColumnRenamed("title", "ty"), keys + ["ty"]).groupBy(*keys, "tx").agg(
            F.min("first_title").alias("first_near")
        )
        free = (
            open_.join(by(open_, "url"), keys + ["url"]).join(first_title, keys + ["title"])
            .join(waits.withColumnRenamed("tx", "title"), keys + ["title"], "left")
            .where((c("ord") == c("first_url")) & (c("ord") == c("first_title")))
            .where(c("first_near").isNull() | (c("first_near") > c("ord")))
            .select(*keys, "ord", F.lit(1).alias("keep"))
        )
        marked = state.join(free, keys + ["ord"], "left").withColumn(
            "state", F.when(c("keep") == 1, 1).otherwise(c("state"))
        ).drop("keep")
        marked = cut(marked, "marked")
        kept = marked.where("state = 1")
        near = edges.join(kept.select(*keys, c("title").alias("ty")), keys + ["ty"]).select(*keys, c("tx").alias("title"))
        lost_titles = near.unionByName(kept.select(*keys, "title")).distinct().withColumn("lt", F.lit(1))
        lost_urls = kept.select(*keys, "url").distinct().withColumn("lu", F.lit(1))
        state = cut(
            marked.join(lost_titles, keys + ["title"], "left").join(lost_urls, keys + ["url"], "left")
            .withColumn("state", F.when((c("state") == 0) & (c("lt").isNotNull() | c("lu").isNotNull()), 2).otherwise(c("state")))
            .drop("lt", "lu"),
            "state",
        )
        if state.where("state = 0").isEmpty():
            return state.where("state = 1").drop("state")


def _walk(polls: DataFrame, keys: list[str]) -> DataFrame:
    """Kept nodes of polls that fit a row: every item meets the kept ones before it, in order.

    ``polls``: keys and ``nodes``, an array of (ord, title, url, n), n the title's length.
    """
    def conflict(x, n):
        longest = F.greatest(x["n"], n["n"])
        # The distance stops at the greatest that can count and is -1 beyond; the quotient decides, as everywhere else.
        distance = F.call_function("levenshtein", x["title"], n["title"], F.ceil(longest * F.lit(FUZZY_THRESHOLD)).cast("int"))
        close = F.abs(x["n"] - n["n"]) / longest <= FUZZY_THRESHOLD
        # In this order, and each only if the one before leaves it open.
        return F.when((x["url"] == n["url"]) | (x["title"] == n["title"]), True).when(
            (longest < FUZZY_MIN_LENGTH) | ~close, False).otherwise((distance >= 0) & (distance / longest <= FUZZY_THRESHOLD))

    kept = F.aggregate(
        F.sort_array("nodes"), F.slice("nodes", F.lit(1), F.lit(0)),
        lambda kept, n: F.when(F.exists(kept, lambda x: conflict(x, n)), kept).otherwise(F.array_append(kept, n)))
    return polls.select(*keys, F.inline(kept)).select(*keys, "ord")


def deduplicate(items: DataFrame, *, order: str, title: str = "title", link: str = "link", batch: list[str] | None = None) -> DataFrame:
    """Items that survive, in the sense of the rule above. ``order``: a unique long column.

    ``batch``: columns naming separate polls; each is deduplicated on its own. Without them the items
    are one poll, as a micro-batch of a stream is.
    """
    keys = list(batch or [])
    nodes = items.select(
        *keys, c(order).cast("long").alias("ord"), normalize_text(title).alias("title"), normalize_url(link).alias("url")
    )
    # Without a title or a link nothing is equal: a mark that no normalised text holds stands for it.
    alone = F.concat(F.lit("\0"), F.hex("ord"))
    nodes = nodes.withColumns({x: F.coalesce(c(x), alone) for x in ("title", "url")})
    nodes = cut(nodes.groupBy(*keys, "title", "url").agg(F.min("ord").alias("ord")), "nodes")
    large = cut(nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(c("_n") > WALKED), "large-polls")
    beside = lambda df: [df[k].eqNullSafe(large[k]) for k in keys] or F.lit(True)
    kept = None
    if not large.isEmpty():
        poll = F.to_json(F.struct(*keys)) if keys else F.lit("")
        held = cut(nodes.join(large, beside(nodes), "left_semi").withColumn("_poll", poll), "large-nodes")
        rounds = _resolve(held.select("_poll", "ord", "title", "url"))
        kept = held.join(rounds.select("_poll", "ord"), ["_poll", "ord"], "left_semi").select(*keys, "ord")
        nodes = nodes.join(large, beside(nodes), "left_anti")
    polls = nodes.groupBy(*keys).agg(F.collect_list(F.struct("ord", "title", "url", F.length("title").alias("n"))).alias("nodes"))
    walked = _walk(polls, keys)
    kept = cut((walked if kept is None else walked.unionByName(kept)).withColumnRenamed("ord", "_ord"), "kept")
    return items.join(kept, [items[k].eqNullSafe(kept[k]) for k in keys] + [c(order).cast("long") == c("_ord")], "left_semi")
