"""Toxicity by a learned lexicon, misspellings included, and the words around each hit.

Terms (whole words and stems) that mark toxic text are mined from labelled rows and kept in a trie. A word
of a text is looked up by running the Levenshtein automaton of the trie over it: the states of the product
are sets of (trie node, edits so far), built only when a word first needs them. Each hit is then judged by
its window: within quotation marks, or after a word of reporting, it counts as quoted, else as direct abuse.
The weights of direct, quoted, exact and misspelled hits are fitted on the labelled rows.

Defined results: a null or empty text has no hits and gets the score of a clean text; repeated rows score
alike; an empty table gives an empty result; without toxic rows to learn from the lexicon is empty and every
text scores as clean. Other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.common import free_name, map_arrow
from barframe.llm.fitting import Logistic, labelled_sample
from barframe.session import cut

#: The fit reads at most so many labelled documents, whole ones.
SAMPLE_ROWS = 8000
#: A term has so many letters at least, is toxic so often at least, and the lexicon holds so many at most.
MIN_LETTERS, PURITY, LEXICON = 4, 0.9, 2000
#: Words from so many letters on can be terms, too, but as whole words without edits.
SHORT_LETTERS = 2
MAX_LETTERS = 24
#: One in so many unrelated prefixes may look toxic by chance.
SURPRISE = 1e8
THRESHOLD = 0.5
WINDOW = 8
END = "\0"
#: Log-odds before any data: nothing found, then log(1 + hits) of exact direct, exact quoted, misspelled direct, misspelled quoted.
PRIOR = (-4.0, 6.0, 2.0, 6.0, 2.0)
#: Words that report speech or name a word, in the languages of the corpus.
REPORTING = frozenset(
    "said says say wrote writes quote quoted quoting quotes called calls term word phrase insult slur citation "
    "dit dite écrit mot terme citation insulte cite cité sagt sagte schrieb wort begriff zitat zitiert nannte "
    "dijo dice escribió palabra término cita citado insulto llamó".split())
_OPENING, _CLOSING, _EITHER = frozenset("“«„‹"), frozenset("”»›"), '"'
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_TOKEN = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def edits_for(term: str) -> int:
    letters = len(term.rstrip(END))
    return 0 if letters < 5 else 1 if letters < 8 else 2


def tokens(text: str) -> list[bytes]:
    """Lower-case runs of letters and digits; every character above 127 counts as a letter."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).split()


class Automaton:
    """The Levenshtein automaton of a lexicon trie. A term ending in ``END`` is a whole word, any other a stem."""

    LIMIT = 100_000

    def __init__(self, terms: dict[str, int]):
        self.terms = sorted(terms)
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]  # edits that any term below the node allows
        self.whole: dict[int, tuple[int, int]] = {}
        self.stem: dict[int, tuple[int, int]] = {}
        for i, term in enumerate(self.terms):
            node, edits = 0, terms[term]
            self.most[0] = max(self.most[0], edits)
            for c in term.rstrip(END):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            (self.whole if term.endswith(END) else self.stem)[node] = (i, edits)
        self.alphabet = {c for x in self.children for c in x}
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.start = self._number(self._close({0: 0}), None)

    def _close(self, cost: dict[int, int]) -> dict[int, int]:
        """Letters of a term that the word leaves out; the last letter of a stem must be there."""
        todo = list(cost)
        while todo:
            node = todo.pop()
            e = cost[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and child not in self.stem and e < cost.get(child, 99):
                    cost[child] = e
                    todo.append(child)
        return cost

    def _number(self, cost: dict[int, int], best: tuple[int, int] | None) -> int:
        key = (frozenset(cost.items()), best)
        if key not in self.numbers:
            found = [(e, self.whole[n][0]) for n, e in cost.items() if n in self.whole and e <= self.whole[n][1]]
            self.numbers[key] = len(self.sets)
            self.sets.append((cost, best))
            self.moves.append({})
            self.ends.append(min([*found, *([best] if best else [])], default=None))
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        cost, best = self.sets[state]
        after: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and e < after.get(node, 99):
                after[node] = e

        for node, e in cost.items():
            reach(node, e + 1)  # the word has a letter more
            for c, child in self.children[node].items():
                reach(child, e + (c != letter))
        for node, e in after.items():
            if node in self.stem and e <= self.stem[node][1]:
                best = min(best or (99, 0), (e, self.stem[node][0]))
        return self._number(self._close(after), best)

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term that the word matches, or None."""
        state, moves, alphabet = self.start, self.moves, self.alphabet
        for letter in word:
            if letter not in alphabet:
                letter = ""
            after = moves[state].get(letter)
            if after is None:
                after = moves[state][letter] = self._step(state, letter)
            state = after
            if not self.sets[state][0]:  # nothing can follow but what is found already
                break
        found = self.ends[state]
        if len(self.sets) > self.LIMIT:
            self._forget()
            self.moves = self.moves
        return found


@dataclass
class Model:
    terms: dict[str, int]
    fit: Logistic


class Reader:
    """Finds the hits of texts; remembers the words it has looked up."""

    REMEMBERED = 400_000

    def __init__(self, terms: dict[str, int]):
        self.automaton = Automaton(terms)
        self.clean: set[bytes] = set()
        self.hits: dict[bytes, tuple[int, int]] = {}

    def words(self, text: str) -> list[bytes]:
        """The distinct words of the text that match a term."""
        distinct = set(tokens(text))
        if len(self.clean) > self.REMEMBERED:
            self.clean = set()
        for w in distinct - self.clean:
            if w in self.hits:
                continue
            found = self.automaton.find(w.decode())
            if found is None:
                self.clean.add(w)
            else:
                self.hits[w] = found
        return [w for w in distinct if w in self.hits] if self.hits else []

    def features(self, text: str) -> tuple[float, float, float, float]:
        """log(1 + hits): exact direct, exact quoted, misspelled direct, misspelled quoted."""
        if not self.words(text):
            return 0.0, 0.0, 0.0, 0.0
        counts = [0, 0, 0, 0]
        lower = text.lower()
        spans = [(m.start(), m[0]) for m in _TOKEN.finditer(lower)]
        for i, (at, word) in enumerate(spans):
            found = self.hits.get(word.encode("utf-8", "replace"))
            if found:
                counts[2 * (found[0] > 0) + self._quoted(lower, spans, i, at)] += 1
        return tuple(math.log1p(c) for c in counts)

    @staticmethod
    def _quoted(lower: str, spans: list[tuple[int, str]], i: int, at: int) -> int:
        """1 if a quotation is open at the hit, judged within its window, or a reporting word stands shortly before it."""
        first, last = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)]
        before, after = lower[first:at], lower[at : last[0] + len(last[1]) + 1]
        opened = sum(c in _OPENING for c in before) > sum(c in _CLOSING for c in before) and any(c in _CLOSING or c == "“" for c in after)
        straight = before.count(_EITHER) % 2 == 1 and _EITHER in after
        return int(opened or straight or any(w in REPORTING for _, w in spans[max(0, i - 4) : i]))


def _prefixes(text: str) -> set[str]:
    """What may be a term: stems and whole words, of short words the whole word alone."""
    out = set()
    for w in {w.decode() for w in tokens(text)}:
        if len(w) >= MIN_LETTERS:
            # A word that is longer than any term has stems only.
            w = w + END if len(w) <= MAX_LETTERS else w[:MAX_LETTERS]
            out.update(w[:k] for k in range(MIN_LETTERS, len(w) + 1))
        elif len(w) >= SHORT_LETTERS:
            out.add(w + END)
    return out


def _mine(batches):
    """Documents, toxic or not, that have a word with each prefix; added up a partition of the sample at a time."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            (toxic if label else other).update(_prefixes(text))
    keys = list(toxic.keys() | other.keys())
    for i in range(0, len(keys), 20_000):
        part = keys[i : i + 20_000]
        yield pa.record_batch([pa.array(part), pa.array([toxic[k] for k in part]), pa.array([other[k] for k in part])], names=["prefix", "toxic", "other"])


def lexicon(counts: dict[str, tuple[int, int]]) -> list[str]:
    """Terms from (toxic, other) counts of pure prefixes: the shallowest pure trie nodes, each lengthened as long as nine in ten of its documents follow."""
    below = defaultdict(list)
    for p in counts:
        below[p[:-1]].append(p)
    terms = []
    for root in (p for p in counts if p[:-1] not in counts):
        node, enough = root, 0.9 * counts[root][0]
        while True:
            further = [p for p in below[node] if counts[p][0] >= enough]
            if not further:
                break
            node = max(further, key=lambda p: (counts[p][0], p))
        terms.append((counts[root][0], node))
    return [t for _, t in sorted(terms, key=lambda x: (-x[0], x[1]))[:LEXICON]]


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """One row of each family of copies: words that only copies share must not look like terms.

    Copies have the same least hash of their long words, unrelated texts seldom do; a text without long words stands for itself.
    """
    long_words = F.filter(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: F.length(w) >= 8)
    family = F.coalesce(F.array_min(F.transform(long_words, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    return sample.groupBy("label", family.alias("family")).agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select("text", "label")


def fit(documents: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Learn terms, their edits and the weights from labelled rows for which ``training`` (a condition on doc_id) holds."""
    sample = cut(labelled_sample(labels.where(training), documents, label, rows), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    empty = Logistic(scale=False, prior=PRIOR).fit(np.zeros((0, 4)), np.zeros(0))
    if not n_toxic or not n_other:
        return Model({}, empty)
    base = n_toxic / (n_toxic + n_other)
    purity = F.col("toxic") / (F.col("toxic") + F.col("other"))
    mined = map_arrow(_one_of_copies(sample), _mine, "prefix string, toxic long, other long").groupBy("prefix").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    # Surprise: the chance of so pure a prefix among unrelated words, against the number of prefixes that are looked at.
    strong = mined.where((purity >= max(PURITY, base + (1 - base) / 2)) & (F.col("toxic") * F.log(purity / base) >= math.log(SURPRISE)))
    counts = {r["prefix"]: (r["toxic"], r["other"]) for r in strong.orderBy(F.desc("toxic"), "prefix").limit(20 * LEXICON).collect()}
    terms = {t: edits_for(t) for t in lexicon(counts)}
    terms = _settle(sample, terms)
    rows_ = _features_of(sample, terms).collect()  # four numbers for each row of the bounded sample
    x, y = np.array([r["x"] for r in rows_]).reshape(-1, 4), np.array([float(r["label"]) for r in rows_])
    return Model(terms, Logistic(ridge=1.0, scale=False, prior=PRIOR).fit(x, y))


def _settle(sample: DataFrame, terms: dict[str, int]) -> dict[str, int]:
    """Leave each term as many edits as do not find clean rows too."""
    order = sorted(terms)

    def count(batches):
        reader, seen = Reader(terms), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen.update({(reader.hits[w][1], reader.hits[w][0], label) for w in reader.words(text) if reader.hits[w][0]})
        if seen:
            keys = list(seen)
            yield pa.record_batch([*[pa.array([k[i] for k in keys], pa.int64()) for i in range(3)], pa.array([seen[k] for k in keys], pa.int64())], names=["term", "edits", "label", "n"])

    found = defaultdict(int)
    for r in map_arrow(sample, count, "term long, edits long, label long, n long").groupBy("term", "edits", "label").agg(F.sum("n").alias("n")).collect():
        found[order[r["term"]], r["edits"], r["label"]] = r["n"]
    settled = {}
    for term, most in terms.items():
        spoilt = (e for e in range(1, most + 1) if found[term, e, 0] > 0.05 * found[term, e, 1])
        settled[term] = next(spoilt, most + 1) - 1
    return settled


def _features_of(sample: DataFrame, terms: dict[str, int]) -> DataFrame:
    def run(batches):
        reader = Reader(terms)
        for batch in batches:
            yield pa.record_batch([batch.column("label"), pa.array([list(reader.features(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], names=["label", "x"])

    return map_arrow(sample.select("label", "text"), run, "label int, x array<double>")


def with_score(documents: DataFrame, model: Model, text: str = "text", column: str = "toxicity_score") -> DataFrame:
    """All columns and rows, and the probability that the text is toxic. One pass, no shuffle."""
    column = free_name(documents, column)
    schema = T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        known = shared.value
        reader = Reader(known.terms)
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                x = np.array([reader.features(t or "") for t in texts])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.fit.predict(x))], names=[*batch.schema.names, column])

    return map_arrow(documents, score, schema)
