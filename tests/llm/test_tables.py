"""Table operators against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from barframe.llm import leaks, licences, mixing, neardup, quality, queries, rules, stages, substrings, tokens, toxicity, warc
from barframe.llm.common import prepare
from barframe.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta rho tau phi chi psi omega nu xi pi mu eta".split()) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    base = [sentence(rnd, 120) for _ in range(6)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(10 + i, base[0]) for i in range(5)]  # exact copies
    for i in range(12):  # near copies of one original that is not the first of them
        words = base[1].split()
        words[rnd.randrange(100)] = f"new{i}"
        out.append((20 + i, " ".join(words)))
    passage = sentence(rnd, 30)
    out += [(40 + i, f"{sentence(rnd, 20)} {passage} {sentence(rnd, 9)}") for i in range(4)]
    out += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "one"), (55, "ONE two"), (56, "a b c d e"), (57, "long " * 3000 + sentence(rnd, 50))]
    out += [(60, base[3]), (60, base[3]), (61, base[4]), (61, base[5]), (None, base[2]), (None, None)]
    return [(i, t, "en", [None, "s1", "s2", "s3"][k % 4], len(t or "")) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    # Names that the operators use themselves, as further columns.
    return spark.createDataFrame([(*r, 1, "x", 2.0, 5, "y") for r in rows], SCHEMA + ", mix_taken long, near_mark string, quality_score double, near_id long, taken string")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def words(text):
    return re.findall(WORD, text or "")


def test_substrings(docs, empty, rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - 12):
                run = tuple(w[k:k + 13])
                first[run] = min(first.get(run, i), i)
    want = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k:k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substrings.remove_repeats(empty).count() == 0


def shingles(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def smallest_of_group(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(docs, empty, rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    single = [(i, t) for i, t, *_ in rows if i is not None and i != 61]
    sets = {i: shingles(t) for i, t in single}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = smallest_of_group(sets, links)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), label[i], label[i] == i), i
    assert got[None].kept and label[31] != 31
    if block == 3:
        left = neardup.without_duplicates(docs)
        assert left.columns == docs.columns and neardup.near_duplicates(empty).count() == neardup.without_duplicates(empty).count() == 0
        ids = [r.doc_id for r in left.collect()]
        assert ids.count(60) == 0 and ids.count(None) == 2 and sorted(i for i in ids if i is not None and i != 61) == sorted({i for i in sets if label[i] == i})


def test_one_id_with_unrelated_texts_keeps_each(spark):
    rnd = random.Random(23)
    a, b, c = (sentence(rnd, 120) for _ in range(3))
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    # Id 1 names two groups that 8 and 9 join; 2 has two texts like each other; 3 stands twice, one of them in other letters, and without words.
    rows = [(1, a), (1, b), (8, near(a)), (9, near(b)), (2, c), (2, near(c)), (3, "p q r s t u"), (3, "p q r s t u"), (3, "P q r s t u"), (3, ""), (3, None), (3, "v w x"), (3, "v w x")]
    left = [(r.doc_id, r.text) for r in neardup.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(left) == 6 and {(1, a), (1, b), (3, "v w x")} < set(left)
    assert sorted((i, (t or "").lower()) for i, t in left if i == 3) == [(3, ""), (3, "p q r s t u"), (3, "v w x")]
    assert [t in (c, near(c)) for i, t in left if i == 2] == [True]


def test_stage_drops_copies_of_a_similarity_of_eight_tenths(spark, tmp_path):
    rnd = random.Random(17)
    original = sentence(rnd, 300).split()
    near, far = list(original), list(original)
    for k in range(6):
        near[20 + 45 * k] = f"n{k}"
    for k in range(10):
        far[12 + 28 * k] = f"f{k}"
    rows = [(1, " ".join(original)), (2, " ".join(near)), (3, " ".join(far)), (4, sentence(rnd, 300))]
    sets = {i: shingles(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.81 < alike(1, 2) < 0.83 and max(alike(1, 3), alike(2, 3)) < 0.75
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in stages.near_duplicate_stage(spark, docs, str(tmp_path)).collect()) == [1, 3, 4]
    assert all(r.kept for r in neardup.near_duplicates(docs).collect())


def test_star_of_copies_that_are_not_like_each_other(spark):
    """Copies of one original, each close to it and too far from one another: all are one group."""
    rnd = random.Random(9)
    original = sentence(rnd, 400).split()
    rows = [(100, " ".join(original))]
    for i in range(60):
        w = list(original)
        for at in (rnd.randrange(0, 130), rnd.randrange(135, 260), rnd.randrange(265, 395)):
            w[at] = f"c{i}x{at}"
        w[3 * i + 5] += "y"
        w[399 - i] += "z"
        rows.append((i if i < 30 else 200 + i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert got == smallest_of_group(sets, links) and len(links) < 300


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(3)
    for share in (0.3, 0.7, 0.9):
        pool = rnd.integers(0, 2**64, 3000, dtype=np.uint64)
        n = int(1000 * share)
        pairs = []
        for _ in range(30):
            pool = rnd.integers(0, 2**64, 2000 - n, dtype=np.uint64)
            pairs.append((np.unique(pool[:1000]), np.unique(pool[1000 - n:])))
        a, b = neardup.sketches([x for x, _ in pairs]), neardup.sketches([y for _, y in pairs])
        true = n / (2000 - n)
        assert abs(neardup.estimate(a, b, np.full(30, 1000), np.full(30, 1000)).mean() - true) < 0.03
        union = neardup.sketches([np.union1d(x, y) for x, y in pairs])
        assert (union == np.maximum(a, b)).all()


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(100, 130)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(None, 3)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    good = [x for x in links if None not in x]
    assert got == smallest_of_group({n for x in good for n in x}, good)


def test_leaks(spark, docs, empty, rows):
    items = [(1, " ".join(rows[2][1].split()[20:60])), (2, "one"), (3, None), (4, ""), (5, "nothing of this is anywhere at all here"), (6, "one TWO"),
             (7, " ".join(rows[4][1].split()[5:17])), (8, " ".join(rows[5][1].split()[:100]) + " and two more"), (9, "a b c d e")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def at(text, width):
        w = [x.lower() for x in words(text)]
        return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}

    want = []
    for i, t, *_ in rows:
        for item, q in items:
            width = min(5, len(words(q)))
            if width and 100 * len(at(q, width) & at(t, width)) >= 80 * len(at(q, width)):
                want.append((i, item, len(at(q, width)), len(at(q, width) & at(t, width))))
    got = [tuple(r) for r in leaks.find_leaks(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {x[1] for x in got} >= {1, 2, 6, 7, 8, 9}
    left = leaks.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not any(i == x[0] and x[0] is not None for x in want) for i, *_ in rows) - sum(x[0] is None for x in want)
    assert leaks.find_leaks(empty, bench).count() == leaks.find_leaks(docs, bench.limit(0)).count() == 0 and leaks.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_leak_blocks_are_all_searched(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 200)
    bench = spark.createDataFrame([(k, " ".join(rows[k][1].split()[10:40])) for k in range(6)], "item_id long, text string")
    assert {r.item_id for r in leaks.find_leaks(docs, bench).collect()} == set(range(6))


def test_items_of_one_text_are_searched_once(spark, docs, rows, monkeypatch):
    passage = lambda k: " ".join(rows[k][1].split()[10:40])
    bench = spark.createDataFrame([(i, passage(0)) for i in range(50)] + [(100 + k, passage(k)) for k in range(1, 6)] + [(7, passage(0)), (None, passage(0))], "item_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 300)
    assert sorted(t for block in leaks._blocks(bench) for _, t in block) == sorted(passage(k) for k in range(6))
    found = [r.item_id for r in leaks.find_leaks(docs, bench).collect() if r.doc_id == 0]
    assert sorted(found, key=repr) == sorted([*range(50), 7, None], key=repr)


def test_bins_hide_a_leak_with_the_stated_probability():
    for k in (1, 7, 13, 52, 400):
        load = leaks._load(k)
        assert load == 0 or (1 - (1 - np.exp(-load)) / load) ** k <= leaks.MISS * 1.01


def test_mixing(spark, docs, empty, rows):
    got = mixing.plan(docs).collect()
    sizes = {}
    for i, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:  # redistribute until no source is above its cap
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        target[s] = 3 * sizes[s] if s in full else level * weight[s]
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and mine[0].source_size == sizes[s] and sum(r.taken for r in mine) == round(mine[0].target)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got) and len(got) == len(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.plan(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    assert all(abs(taken.get(s, 0) - target[s]) <= 2 for s in order)
    assert mixing.plan(empty).count() == mixing.mix(empty).count() == 0


def test_equal_rows_have_shares_of_their_own(spark):
    rnd = random.Random(31)
    texts = [sentence(rnd, 9) for _ in range(5)]
    rows = [(None, t, "s1", 1) for t in texts] + [(4, "a b c d e", "s1", k) for k in range(3)] + [(None, t, "s2", 1) for t in ("one two three four five", "v w x y z")] + [
        (None, "six seven eight nine ten", "s2", k) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other long")
    goal = {r.source: round(r.target) for r in mixing.plan(docs).collect()}
    got = mixing.mix(docs).collect()
    for s, n in goal.items():
        mine = [r.text for r in got if r.source == s]
        assert sum(len(words(t)) for t in mine) == n and all(mine)
        assert sum(t not in {x[1] for x in rows} for t in mine) == 1  # one cut document a source
    first = {tuple(r) for r in got}
    assert {r for r in rows if r[2] == "s1"} <= first and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))


def test_tokens(spark, docs, empty, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library, want, start = Tokenizer.from_file(path), [], 0
    for i, t in sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokens.round_trip(docs, path).collect()), key=lambda r: r[1]) == want
    assert tokens.round_trip(empty, path).count() == 0


def test_sequences_are_reached_by_number(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = tokens.write(docs, str(tmp_path), path)
    for r in manifest.collect():
        reader, index = tokens.open_shard(str(tmp_path), r.shard)
        whole = np.concatenate(list(tokens._stream(reader)))
        assert len(whole) == r.tokens
        for k in range(-(-r.tokens // tokens.SEQUENCE)):
            ids, packed = tokens.sequence(reader, k)
            mask = tokens.unpacked(packed)
            assert len(ids) == len(mask) == tokens.SEQUENCE and ids[mask].tolist() == whole[k * tokens.SEQUENCE:(k + 1) * tokens.SEQUENCE].tolist()
            # Views of the mapped file: the same addresses as the batch's own buffers.
            batch, row = reader.get_batch(k // tokens.BATCH_ROWS), k % tokens.BATCH_ROWS
            for view, name in ((ids, "ids"), (packed, "mask")):
                assert view.__array_interface__["data"][0] == batch.column(name).values.buffers()[1].address + row * view.nbytes and not view.flags.writeable


def test_many_rows_of_one_id_are_dealt_to_several_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_BYTES", 2000)
    docs = spark.createDataFrame([(None, f"{chr(97 + k % 26)}{k} some text of row {k}") for k in range(300)] + [(7, None), (8, "")], "doc_id long, text string")
    manifest = tokens.write(docs, str(tmp_path), public_tokenizers.path("byte_bpe_50k.json"))
    rows = tokens.read(manifest, str(tmp_path)).collect()
    assert manifest.count() > 3 and len(rows) == 302
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_rules_and_licences(docs, empty, rows):
    got = rules.judged(docs).collect()
    assert len(got) == len(rows) and all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert {r.doc_id: r.kept for r in got}[0] and rules.judged(empty).count() == 0
    found = licences.scan_licences(docs).collect()
    assert len(found) == len(rows) and {r.doc_id: r.n_words for r in found}[50] == 0 and licences.scan_licences(empty).count() == licences.covered_spans(docs).count() == 0


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://e.com", "<p>x</p>"), (1, "http://e.com", "<p>x</p>"), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages))
    rows = made.collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6
    files = warc.write(made, str(tmp_path)).collect()
    back = [r for f in files for r in warc.read(open(f.file, "rb").read())]
    assert sorted(back) == sorted(bytes(r.record) for r in rows) and sum(f.records for f in files) == 8
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_archive_query_gives_whole_records(spark, data_dir):
    got = queries.QUERIES["op4_warc_derivatives"](spark, data_dir).collect()
    assert len(got) == 2 * spark.read.parquet(f"{data_dir}/pages.parquet").count()
    for r in got:
        fields, block = warc.parse(bytes(r.record))
        assert (fields["warc-type"], fields["warc-record-id"], len(block), warc.digest(block)) == (r.record_type, r.record_id, r.content_length, r.block_digest)


def test_trained_operators_on_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    for table, given in ((docs, labels), (docs, labels.limit(0)), (empty, labels)):
        scored = quality.with_score(table, quality.fit(table, given, F.lit(True)))
        assert scored.count() == table.count() and scored.where("_quality_score is null or _quality_score not between 0 and 1").count() == 0
        scored = toxicity.with_score(table, toxicity.fit(table, given, F.lit(True)))
        assert scored.count() == table.count() and scored.where("toxicity_score is null or toxicity_score not between 0 and 1").count() == 0


@pytest.fixture(scope="module")
def labels_of():
    import pyarrow.parquet as pq

    return lambda d: {r["doc_id"]: r for r in pq.read_table(f"{d}/labels.parquet").to_pylist()}


@pytest.mark.parametrize("name,column,least", [("op1_quality_classifier", "quality", 0.93), ("op2_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, labels_of, name, column, least):
    d = "/root/testdata/sf0.01"
    known = labels_of(d)
    rows = [r for r in queries.QUERIES[name](spark, d).collect() if r.held_out and r.doc_id in known]
    assert np.mean([r.predicted == known[r.doc_id][column] for r in rows]) >= least


def test_stages_take_effect_on_what_is_left(spark, docs, empty, tmp_path, rows):
    spark.createDataFrame([(1, " ".join(rows[2][1].split()[20:60]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        assert stage(spark, empty, str(tmp_path)).count() == 0
    kept = {r.doc_id for r in left.collect()}
    assert not kept & {10, 11, 2} and kept & {3, 4, 5}
    assert stages.token_stage(spark, left, str(tmp_path)).count() == left.count()


def test_pipeline_runs(spark, data_dir):
    out = corpus_pipeline.run(spark, data_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, data_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{data_dir}/{t}.parquet')")
    rel = con.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    got = queries.QUERIES[name](spark, data_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(repr, rel.fetchall()))
