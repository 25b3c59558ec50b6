"""Operators on single texts against plain versions: words, rules, licences, toxicity, archives, tokens."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barframe.llm import licences, quality, rules, tokens, toxicity, warc
from barframe.llm.common import Words, chunks, windows

WORD = r"[^\x20\x09-\x0D]+"
TEXTS = ["", None, " ", "a", "a b", "a  b\tc\n\nd", "é ü ß", " x\x0by ", "the the the the", "A a A a b", "z" * 5000, "x y z " * 300]
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t.*|Z!", max_size=60)), min_size=1, max_size=8)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(given_texts):
    for column in (pa.array(given_texts, pa.string()), pa.array([None, "q", *given_texts], pa.string()).slice(2)):
        w = Words(column)
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends)]
        assert got == [x for t in given_texts for x in re.findall(WORD, t or "")]
        assert w.per_document.tolist() == [len(re.findall(WORD, t or "")) for t in given_texts]
        hashes = w.hashes()
        assert len(set(zip(got, hashes.tolist()))) == len(set(got)) == len(set(hashes.tolist()))
        found, at, docs = windows(hashes, w.first, 2)
        assert len(found) == sum(max(0, n - 1) for n in w.per_document) and (w.first[docs] <= at).all()


def test_chunks_keep_every_row():
    batch = pa.record_batch([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["doc_id", "text"])
    assert [i for c in chunks(iter([batch, batch.slice(0, 0)])) for i in c.column("doc_id").to_pylist()] == list(range(len(TEXTS)))


def plain_measures(text):
    text = text or ""
    words = re.findall(WORD, text)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    under = {k for i, r in enumerate(runs) if runs.count(r) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(under)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_measures(given_texts):
    m = rules.Measures(pa.array(given_texts, pa.string()))
    got = list(zip(m.n_words.tolist(), m.word_chars.tolist(), m.n_symbols.tolist(), m.n_dup_lines.tolist(), m.n_repeat_words.tolist()))
    assert got == [plain_measures(t) for t in given_texts]


def test_cascade_is_the_same_in_any_order():
    column = pa.array([*TEXTS, "ONE TWO THREE!! " * 30, "a*** b%%% " * 40, "plain words of a text " * 20])
    first = rules.cascade(column, rules.METHOD) == -1
    again = rules.cascade(column, rules.METHOD[::-1]) == -1
    assert first.tolist() == again.tolist() and not first[-2] and not first[-3] and first[-1]
    assert rules.cascade(column, rules.METHOD, np.zeros(len(column), bool)).tolist() == [-2] * len(column)
    assert len(rules.cascade(pa.array([], pa.string()), rules.METHOD)) == 0


def plain_places(words):
    out = []
    for phrase, label in licences.PHRASES:
        p = phrase.split()
        out += [(label, i) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return out


LICENCE_WORDS = "gnu general public license apache cc by mit the of under licensed to all rights reserved x".split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(LICENCE_WORDS), max_size=60))
def test_licence_places_and_matching_statistics(words):
    automaton = licences.Automaton()
    n, n_base, first, last, base, labels, score = licences.findings(automaton, " ".join(words).upper())
    places = plain_places(words)
    assert (n, n_base) == (len(words), len(places))
    assert (first, last) == (min((i for _, i in places), default=None), max((i for _, i in places), default=None))
    assert base == ",".join(sorted({x for x, _ in places})) and 0 <= score <= 1 and set(base.split(",")) <= set(labels.split(",")) | {""}
    # Every match is a run of some template, and no longer one ends or begins there.
    templates = [[t.decode() for t in licences.words_of(t)] for t in [p for p, _ in licences.PHRASES] + [t for _, t in licences.TEMPLATES]]
    within = lambda run: any(run == t[i:i + len(run)] for t in templates for i in range(len(t)))
    matches = automaton.scan([w.encode() for w in words])[1]
    for at, size, _ in matches:
        assert within(words[at:at + size]) and not (at + size < len(words) and within(words[at:at + size + 1]))
    longest = max((k for i in range(len(words)) for k in range(1, 13) if i + k <= len(words) and within(words[i:i + k])), default=0)
    assert max((s for _, s, _ in matches), default=0) == (longest if longest >= licences.LEAST else 0)


def test_licence_chain_crosses_small_changes():
    automaton = licences.Automaton()
    notice = dict((t, label) for label, t in licences.TEMPLATES)
    mit = next(t for t in notice if t.startswith("Permission is hereby granted, free"))
    changed = mit.replace("free of charge", "free of any charge whatsoever").replace("obtaining", "who obtains")
    *_, base, labels, score = licences.findings(automaton, f"Some words first. {changed} and more")
    assert base == "" and "mit" in labels and 0.6 < score < 1
    assert licences.findings(automaton, None) == (0, 0, None, None, "", "", 0.0)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="idotscumx", max_size=12))
def test_automaton_equals_edit_distance(word):
    terms = {"idiot\0": 1, "scum\0": 0, "disgusto\0": 2, "idiom\0": 1}
    automaton = toxicity.Automaton(terms)
    near = [(distance(word, t[:-1]), i) for i, t in enumerate(sorted(terms)) if distance(word, t[:-1]) <= terms[t]]
    found = automaton.find(word)
    assert (found and found[0]) == (min(near)[0] if near else None)


def test_automaton_stems():
    automaton = toxicity.Automaton({"lowei": 1, "scum\0": 0})
    assert automaton.find("loweient")[0] == 0 and automaton.find("lowei")[0] == 0 and automaton.find("lowxient")[0] == 1
    assert automaton.find("lowe") is None and automaton.find("scumx") is None and automaton.find("") is None


def test_quotation_weighs_less():
    reader = toxicity.Reader({"idiot\0": 1})
    direct, quoted = reader.features("You are an idiot, go away now"), reader.features('He used the word "idiot" in his speech')
    assert direct[0] > 0 and direct[1] == 0 and quoted[1] > 0 and quoted[0] == 0
    assert reader.features("What an idoit, no, an idot!")[2] > 0 and reader.features("") == (0.0,) * 4


def test_lexicon_takes_words_and_stems():
    counts = {p: (90, 0) for p in ("idio", "idiot", "idiot\0")} | {"lowe": (80, 1), "lowei": (79, 0), "loweix": (20, 0), "loweiy": (30, 0)}
    assert toxicity.lexicon(counts) == ["idiot\0", "lowei"]


def test_quality_separates_and_survives_anything():
    good, bad = ["the rain in the plain falls on the quiet hill today " * 8] * 30, ["BUY!! NOW!! CHEAP!! *** $$$ " * 20] * 30
    model = quality.train([(t + str(i), y) for y, group in ((1, good), (0, bad)) for i, t in enumerate(group)])
    sizes = quality._Sizes(model)
    p = model.fit.predict(quality._features(np.array([sizes(t.encode()) for t in (good[0], bad[0], "", "x" * 200_000)])))
    assert p[0] > 0.9 and p[1] < 0.1 and ((p >= 0) & (p <= 1)).all()
    assert quality.train([]).fit is None and quality.train([("a", 1)]).fit is None
    assert quality.train([("a", 1), ("b", 0)]).fit is not None and quality.train([("", 1), ("", 0)]).fit is None


def test_warc_records_parse_back_and_refer_to_their_source():
    page = '<html lang="en"><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><p>One<br>two&nbsp;&lt;3</p><a href="/x?y=1#z">l</a><!-- c --></body>'
    source = warc.response("http://e.com/a", page)
    fields, block = warc.parse(source)
    meta, conv = warc.derive(source)
    assert fields["warc-type"] == "response" and block.endswith(page.encode()) and fields["warc-block-digest"] == warc.digest(block)
    for row, kind in ((meta, "metadata"), (conv, "conversion")):
        own, body = warc.parse(row["record"])
        assert own["warc-type"] == kind and own["warc-refers-to"] == fields["warc-record-id"] and own["warc-refers-to-target-uri"] == "http://e.com/a"
        assert own["warc-block-digest"] == warc.digest(body) and int(own["content-length"]) == len(body) and own["warc-refers-to-date"] == fields["warc-date"]
    assert warc.parse(conv["record"])[1].decode() == "A & B\nOne\ntwo <3\nl"
    about = warc.parse(meta["record"])[1].decode()
    assert "title: A & B\r\n" in about and "outlink: http://e.com/x?y=1#z\r\n" in about and "http-header-content-type: text/html" in about
    assert warc.derive(source) == warc.derive(source)
    assert [r["record_type"] for r in warc.derive(warc.response(None, None))] == ["metadata", "conversion"]
    for broken in (None, b"", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", source[:200]):
        assert warc.derive(broken) == [{"record_type": "invalid"}]


ODD = ["", "a", " a", "a ", "  a  b   c", " \n\n x", "x\n y\t\tz  ", "don't we'll 's", "é  ü x 　 y", "<|endoftext|> a <|endoftext|>b", "1 22  333 , . !! $$", "a\x1cb \x1c c \x85 d",
       "ab éß. Àx, ªa ºb µx aª. x.. y,. 3a a3 a.b ÿ×÷ .,", "x's don't, it'll. A'"]


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abzAZ éÉñß.,!'19 \n\t  ªµ÷", max_size=40))
def test_ids_equal_the_library(encoder, text):
    for t in (text, *ODD):
        assert np.frombuffer(encoder([t])[0], encoder.kind).tolist() == encoder.library.encode(t, add_special_tokens=False).ids


def test_encoder_forgets_and_still_agrees(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    for t in ODD * 2:
        assert np.frombuffer(encoder([t])[0], encoder.kind).tolist() == encoder.library.encode(t, add_special_tokens=False).ids


def test_beginnings_and_lines_are_encoded_once(monkeypatch):
    import public_tokenizers

    fresh, calls = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    library, model = fresh.library, fresh.model

    class Counting:
        def encode(self, text, **how):
            calls.append(text)
            return library.encode(text, **how)

    monkeypatch.setattr(fresh, "library", Counting())
    monkeypatch.setattr(fresh, "model", lambda part: calls.append(part) or model(part))
    names = [a + b for a in ("Ann", "Bob", "Ché", "Dörte", "Ed's") for b in ("", "ia", "on", "ów")]
    texts = [f"{a} met {b}.\n{b} left;\n{a}!!" for a in names for b in names]
    got = fresh(texts)
    assert len(calls) < len(texts)  # each text's beginning and each pair of words at a line end took calls of its own
    assert [np.frombuffer(x, fresh.kind).tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(ODD), st.text(alphabet="abzAZ éÉñß.,!'19 \n\r\t\x0b\x1c\x85\xa0\u2003\u3000ªµ÷日\U0001f600", max_size=30)), max_size=12), st.sampled_from([3, 600_000]))
def test_ids_of_mixed_rows_equal_the_library(encoder, texts, remembered):
    import pyarrow as pa

    texts += ["<|endoftext|>", "a\uffffb <|endoftext|>c\uffff\nd", "\uffff x\n\uffff", "\n\n日本" * 30, "a\n<|endoftext|>", "a  \n <|endoftext|>\n\nb", "plain text\nof two lines."]
    want = [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "REMEMBERED", remembered)
        for column in (pa.array(texts, pa.string()), pa.array(["before", *texts, "after"], pa.large_string()).slice(1, len(texts))):
            ids, counts = encoder.encode(column)
            assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
        if remembered == 3:
            assert len(encoder.number) <= 3 and len(encoder.store) <= 3 * tokens.PIECE_CHARS * 4


def test_fold_of_an_id():
    assert zlib.crc32(b"17") % 4 == zlib.crc32(str(17).encode()) % 4


def _response(payload, *headers):
    http = "\r\n".join(["HTTP/1.1 200 OK", *headers]).encode() + b"\r\n\r\n"
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a.example/"), ("Content-Type", "application/http; msgtype=response")], http + payload)


@pytest.mark.parametrize("charset", ["idna", "undefined", "no-such", "base64", "utf-16"])
def test_a_bad_charset_kills_nothing(charset):
    rows = warc.derive(_response(b"<p>plain words</p>", f"Content-Type: text/html; charset={charset}"))
    assert [r["record_type"] for r in rows] == ["metadata", "conversion"]


def test_transfer_and_content_encodings_are_undone():
    import gzip

    page = b"<title>T</title><p>packed words</p>"
    packed = gzip.compress(page)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(packed[i:i + 9]), packed[i:i + 9]) for i in range(0, len(packed), 9)) + b"0\r\n\r\n"
    for body, headers in ((packed, ["Content-Encoding: gzip"]), (chunked, ["Content-Encoding: gzip", "Transfer-Encoding: chunked"]), (page, ["Content-Encoding: gzip"]),
                          (page, ["Transfer-Encoding: chunked"]), (page, [])):
        assert b"T\npacked words" in warc.derive(_response(body, "Content-Type: text/html", *headers))[1]["record"]


@pytest.mark.parametrize("markup", ["<!--", "<script>", "<style", "<a <", "<a href", "<title", "<html ", "<p<", "</", "<a href='"])
def test_unclosed_markup_takes_linear_time(markup):
    import time

    page = markup * 20_000
    start = time.perf_counter()
    warc.plain_text(page), warc.title_of(page), warc.language_of(page), warc.hrefs(page)
    assert time.perf_counter() - start < 2  # the old patterns took minutes


def plain_page(page):
    """Text, title and links by the parser of the standard library."""
    import html.parser

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.links, self.title, self.inside = [], "", None

        def handle_starttag(self, tag, attrs):
            self.inside = tag if tag in ("title", "script", "style") else self.inside
            self.links += [v for k, v in attrs if tag == "a" and k == "href" and v is not None]

        def handle_endtag(self, tag):
            self.inside = None if tag == self.inside else self.inside

        def handle_data(self, data):
            self.title += data if self.inside == "title" else ""

    reader = Reader()
    reader.feed(page)
    return " ".join(reader.title.split()), reader.links


def test_titles_and_links_are_those_of_a_parser(data_dir):
    import pyarrow.parquet as pq

    pages = [p.decode("utf-8", "replace") if isinstance(p, bytes) else p or "" for p in pq.read_table(f"{data_dir}/pages.parquet", columns=["html"]).column(0).to_pylist()]
    wrong = [p for p in pages if (warc.title_of(p), warc.hrefs(p)) != plain_page(p)]
    assert len(pages) > 10 and not wrong


def _labelled(spark, n, share, term):
    import random

    rnd = random.Random(6)
    words = ["word%s" % "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    rows = []
    for i in range(n):
        toxic = rnd.random() < share
        body = [rnd.choice(words) for _ in range(30)]
        if toxic:
            body.insert(rnd.randrange(30), term)
        rows.append((i, " ".join(body), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return rows, docs, spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("share, term", [(0.2, "zug"), (0.2, "qx"), (0.75, "zugarben"), (0.85, "zugarben")])
def test_short_terms_and_mostly_toxic_labels(spark, share, term):
    from pyspark.sql import functions as F

    rows, docs, labels = _labelled(spark, 600, share, term)
    model = toxicity.fit(docs, labels, F.col("doc_id") >= 0)
    assert model.terms
    got = {r.doc_id: r.s for r in toxicity.with_score(docs, model, column="s").collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows)


def test_licence_paragraphs_and_tables_of_licences(spark):
    docs = spark.createDataFrame([
        (1, "code " * 9 + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software. " + "code " * 9),
        (2, "x THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY y"),
        (3, "You may paint the fence green on any day of the week but a holiday, if the neighbours agree."), (4, None)], "doc_id long, text string")
    assert [r.labels for r in licences.scan_licences(docs).orderBy("doc_id").collect()] == ["bsd", "mit", "", ""]
    own = spark.createDataFrame([("fence", "Fence licence\n\nYou may paint the fence green on any day of the week but a holiday.\n\nshort"), (None, "x"), ("none", None)], "label string, text string")
    templates = licences.templates_of(own)
    assert len(templates) == 1
    assert [r.labels for r in licences.scan_licences(docs, templates).orderBy("doc_id").collect()] == ["", "", "fence", ""]
    assert [(r.doc_id, r.label) for r in licences.covered_spans(docs, templates).where("share > 0.9").collect()] == [(3, "fence")]


def plain_share(text, template):
    """The best chain by trying all chains of all maximal matches."""
    words, other = licences.words_of(text), licences.words_of(template)
    runs = [(i, j, next(k for k in range(len(words) + 1) if i + k >= len(words) or j + k >= len(other) or words[i + k] != other[j + k])) for i in range(len(words)) for j in range(len(other))]
    runs = [(i, j, n) for i, j, n in runs if n >= licences.LEAST and not (i and j and words[i - 1] == other[j - 1])]
    return max([n for _, _, n in runs], default=0) / len(other), runs


def test_a_chain_is_no_shorter_than_its_longest_match_and_no_longer_than_all():
    rnd = __import__("random").Random(3)
    for label, template in licences.TEMPLATES[:6]:
        for _ in range(12):
            words = template.split()
            del words[rnd.randrange(len(words))]
            words.insert(rnd.randrange(len(words)), "other")
            text = " ".join(["before"] * 3 + words + ["after"])
            automaton = licences.Automaton(templates=((label, template),))
            spans = automaton.spans(automaton.scan(licences.words_of(text))[1])
            least, runs = plain_share(text, template)
            covered = {j + k for _, j, n in runs for k in range(n)}
            share = max([s for t, s, _, _ in spans if t >= automaton.n_phrases], default=0.0)
            assert least - 1e-9 <= share <= len(covered) / len(licences.words_of(template)) + 1e-9
