"""Encoding by prefixes, collocations and tokenizer alignment against the libraries and brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barframe.llm import alignment, bloom, bpe, collocations
from barframe.llm.common import prepare

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "  two  spaces ", "x" * 5000, "\x00 nul", "a\u2581b", "<|endoftext|> <s> x</s>", "foo<|endoftext|>bar", "日本語 テキスト", "é" * 60, "\n\n x\n y",
       "don't we'll 12 3.4,5", "a\u00a0b \u200b", "word, word. word! " * 200, "\U0001f600 \ufb01"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    return Tokenizer.from_file(BYTES), plain, sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    rows = [(i if i % 4 else None, t, "n") for i, t in enumerate(ODD)] + [(3, ODD[4], "n"), (3, ODD[4], "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.tables(BYTES))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab cdehilnost'Ée1 \t\n.,!<|>\u3042\u00a0\U0001f600", max_size=80), min_size=1, max_size=4))
def test_ids_by_prefixes_equal_the_library(encoder, libraries, texts):
    assert encoder(texts) == [np.array(x.ids, "<u4").tobytes() for x in libraries[0].encode_batch(texts, add_special_tokens=False)]


def test_pretokens_are_the_librarys_for_every_character(encoder, libraries):
    split = libraries[0].pre_tokenizer.pre_tokenize_str
    points = [p for p in [*range(0x0, 0x3000), *range(0xA000, 0xAC00, 3), *range(0xF900, 0x10000), *range(0x10000, 0x32000, 7)] if not 0xD800 <= p < 0xE000]
    for p in points:
        text = f"a{chr(p)}1{chr(p)}!{chr(p)} {chr(p)} a"
        assert len(split(text)) == len(encoder.pretokens(text)), hex(p)


def test_last_tokens_are_those_of_every_prefix(encoder, libraries):
    piece = b" international-ization".replace(b"-", b"")
    last = list(next(encoder.prefixes([piece])))
    for n in range(1, len(piece) + 1):
        assert last[n] == libraries[0].encode(piece[:n].decode(), add_special_tokens=False).ids[-1]


def test_encoder_forgets_and_still_agrees(libraries, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "MOST_WORDS", 4)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    monkeypatch.setattr(bpe, "MOST_STEPS", 0)
    small = bpe.Encoder(bpe.tables(BYTES))
    for text in ["some words here, and some more words", "others follow: a, b, c", "some words here"] * 3:
        assert small([text])[0] == np.array(libraries[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoding_and_decoding_odd_rows(spark, odd, libraries):
    encoded = bpe.with_ids(odd, BYTES, column="numbers")
    assert encoded.columns == [*odd.columns, "numbers"]
    got = bpe.with_text(encoded, BYTES, ids="numbers", column="back").collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        ids = libraries[0].encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.numbers) == np.array(ids, "<u4").tobytes() and r.back == libraries[0].decode(ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.with_ids(odd.where("false"), BYTES, column="numbers").count() == 0
    plain = bpe.with_ids(odd.where("text like '%endoftext%'"), BYTES, column="numbers", special=False).collect()
    assert all(50256 not in np.frombuffer(bytes(r.numbers), "<u4") for r in plain)
    tokens = bpe.tables(BYTES).bytes
    assert bpe.decoded(np.array([999_999, 64], "<u4").tobytes(), tokens) == tokens[64].decode() and bpe.decoded(b"\xff\0\0\0", [b""] * 255 + [b"\xe9"]) == "\ufffd"


def plain_collocations(rows, least, top=2000):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        gone = {p[i:i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * f[p[i:i + m]]}
        best = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, hot", [(8 << 20, 1 / 2000), (200, 1e-4), (64, 2.0)])
def test_collocations(spark, monkeypatch, block, hot):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocations, "HOT_SHARE", hot)
    monkeypatch.setattr(collocations, "SAMPLE_OF", 1)
    prepare(spark)
    rnd = random.Random(9)
    words = "The the red Fox fox jumps over a lazy dog É é\u00a0x \x1f of and".split(" ")
    rows = [(" ".join(rnd.choice(words) + rnd.choice(["", "", ".", ",", "\t", "\n", "  "]) for _ in range(rnd.randrange(60))), rnd.choice(["en", None, "und", ""])) for _ in range(150)]
    rows += [("new york city " * 9, "en")] * 3 + [(None, "en"), ("", "de"), ("...", "fr"), ("alone", None), ("red fox " * 400, "en")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, w1 string, n long")
    want = plain_collocations(rows, 12)
    assert want and sorted(map(tuple, collocations.collocations(docs, least=12).collect())) == want
    assert collocations.collocations(docs.where("false"), least=12).count() == 0


def test_scores_pass_64_bits(spark):
    big = 6_000_000_000_000
    rows = [("en", "a", ["a"], big + 7), ("en", "b", ["b"], big + 1), ("en", "a b", ["a", "b"], big - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, words array<string>, f long")).first()
    assert (got.a, got.l, got.r, got.score) == (big - 1, big + 7, big + 1, 2_000_000 * (big - 1) // (2 * big + 8))


def test_filter_knows_all_it_was_made_of(spark, tmp_path):
    keys = np.random.default_rng(4).integers(-2**63, 2**63, 20_000)
    spark.createDataFrame([(int(k),) for k in keys[:5000]], "k long").write.parquet(str(tmp_path / "keys"))
    bits = bloom.made_of(spark.read.parquet(str(tmp_path / "keys")))
    known = bloom.holds(bits, keys.view(np.uint64))
    assert known[:5000].all() and known[5000:].mean() < 0.02
    assert not bloom.holds(bloom.made_of(spark.read.parquet(str(tmp_path / "keys")).where("false")), keys.view(np.uint64)).any()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(1, 6), st.integers(0, 2**32 - 1), st.sampled_from([1, 4, 1 << 22]))
def test_products_of_sparse_matrices(height, inner, width, seed, products):
    rnd = np.random.default_rng(seed)
    left, right = rnd.integers(0, 3, (height, inner)), rnd.integers(0, 3, (inner, width))
    a, b = (alignment.Csr.of_counts(np.repeat(r, m[r, k]), np.repeat(k, m[r, k]), *m.shape) for m in (left, right) for r, k in [np.nonzero(m)])
    whole, held = np.zeros((height, width), int), alignment.PRODUCTS
    alignment.PRODUCTS = products
    try:
        for row, column, value in a.times(b):
            whole[row, column] += value
    finally:
        alignment.PRODUCTS = held
    assert (whole == left @ right).all()
    turned = a.transposed()
    assert [(k, r) for r in range(height) for k in range(inner) if left[r, k]] == sorted(
        ((k, int(r)) for k in range(inner) for r in turned.columns[turned.starts[k]:turned.starts[k + 1]]), key=lambda x: (x[1], x[0]))


def plain_alignment(text, libraries):
    from barframe.llm.bpe import byte_letters

    _, plain, pieces = libraries
    letters = byte_letters()
    spelt = lambda i: bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("\u2581", " ").encode()
    if not text:
        return None
    a, b = plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    in_a, in_b = [bytes(letters[x] for x in plain.id_to_token(i)) for i in a], [spelt(i) for i in b]
    if not b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
        return None
    end_a, end_b = np.cumsum([len(x) for x in in_a]).tolist(), np.cumsum([len(x) for x in in_b]).tolist()
    groups, links, i, j = [], collections.Counter(), 0, 0
    for end in sorted(set(end_a) & set(end_b)):
        x, y = a[i:end_a.index(end) + 1], b[j:end_b.index(end) + 1]
        i, j = i + len(x), j + len(y)
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        links.update((p, q) for p in x for q in y)
    overlaps = sum(1 for s, e in zip([0, *end_a], end_a) for s2, e2 in zip([0, *end_b], end_b) if max(s, s2) < min(e, e2))
    return len(a), len(b), len(groups), overlaps, hashlib.sha256(";".join(groups).encode()).hexdigest(), links


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_alignment(spark, odd, libraries, monkeypatch, few):
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", few)
    want = [plain_alignment(t, libraries) for t in [*ODD, ODD[4], ODD[4]]]
    count = collections.Counter(p for w in want if w for p in w[5])
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    expected = []
    for w in want:
        if w is None:
            expected.append((0, 0, 0, 0, 0, 0, "", 0))
        else:
            links = w[5]
            expected.append((w[0], w[1], w[2], sum(links.values()), sum(v for p, v in links.items() if count[p] == most[p[0]]), sum(v * count[p] for p, v in links.items()), w[4], w[3]))
    got = [tuple(r[1:]) for r in alignment.align(odd, BYTES, PIECES).collect()]
    assert sorted(got) == sorted(expected) and sum(x[0] == 0 for x in got) == 3
    assert alignment.align(odd.where("false"), BYTES, PIECES).count() == 0


def test_sides_forget_and_still_agree(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 2)
    monkeypatch.setattr(alignment, "WORD_CHARS", 3)
    a, b = alignment.byte_level(BYTES), alignment.pieces(PIECES)
    for text in ["word, words! more; text:\ttext", "word words", "word, other", "a b c d e f words"] * 2:
        x = alignment.Aligned([text], a, b)
        assert x.ids_a.tolist() == libraries[1].encode(" " + text, add_special_tokens=False).ids and x.ids_b.tolist() == libraries[2].encode(text)
