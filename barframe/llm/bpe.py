"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is exactly one token with which the encoding of the prefix ends. A suffix
automaton over the bytes of the vocabulary is fed the pre-token and names, at every place, all tokens that end
there, longest first. One of them is the prefix's last token if it fits the last token of what lies before it: two
tokens fit if merging the bytes of both by rank leaves the seam between them open. Following last tokens back from
the end gives the ids; no merge is ever carried out.

Texts are cut into pre-tokens as the tokenizer file says, and pre-tokens of one word are remembered.

Defined results: a null or empty text has no ids and decodes to the empty text; the string of a special token in a
text is that token, as the library has it, or plain text if ``special`` is false; ids out of the vocabulary decode
to nothing; bytes that are not UTF-8 decode to replacement characters. Rows are independent: repeated rows, nulls in
other columns and columns of any name are kept as they are. Long texts need about twenty bytes a byte of their longest
pre-token.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barframe.llm.common import chunks, map_arrow

#: Fixed value: the pre-tokens of byte-level tokenizers, for letters L, numbers N and what is neither X.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{X}+|\s+(?!\S)|\s+"
#: A word of letters that every Unicode version knows, and stops after it: a pre-token each.
LATIN = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªº")
_WORD = re.compile(f"([{LATIN}]+)([.,;:!?]+)")
_LETTERS = re.compile(f" ?[{LATIN}]+").fullmatch
#: A space before a visible character always begins a new pre-token.
_SEAM = re.compile(r" (?=\S)")
#: Remembered words a generation, words of one chunk that may be remembered at all, and remembered pairs.
REMEMBERED, MOST_WORDS, PAIRS = 200_000, 300_000, 400_000
#: Other remembered pre-tokens are no longer than this, and remembered steps of the automaton no more.
PIECE_CHARS, MOST_STEPS = 16, 1_000_000
#: The end of a spine that no merge ends.
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies spell a byte by its own character if that is visible, and by the next free one from 256 on if not."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def pretoken_pattern(library: Callable[[str], list]) -> str:
    """``PRETOKENS`` for the characters that ``library`` (a text to its pre-tokens) takes for letters and numbers.

    Its Unicode version may be older than that of ``regex``; what was assigned since is a symbol to it.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    newer = [c for kind, one in (("L", "a"), ("N", "1")) for c in regex.findall(rf"\p{{{kind}}}", every) if len(library(one + c)) > 1]
    if not newer:
        return PRETOKENS.format(L=r"\p{L}", N=r"\p{N}", X=r"[^\s\p{L}\p{N}]")
    points = sorted(map(ord, newer))
    starts = [p for k, p in enumerate(points) if not k or points[k - 1] != p - 1]
    ends = [p for k, p in enumerate(points) if k + 1 == len(points) or points[k + 1] != p + 1]
    odd = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))
    return PRETOKENS.format(L=rf"[\p{{L}}--[{odd}]]", N=rf"[\p{{N}}--[{odd}]]", X=rf"[[^\s\p{{L}}\p{{N}}]||[{odd}]]")


class SuffixAutomaton:
    """All substrings of the given byte strings; a state is a class of substrings that end at the same places.

    A string itself begins at its string's first byte, so it is the longest of its class, and the state tells it.
    """

    def __init__(self, strings: list[bytes]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.state_of = {s: self._add(s) for s in strings}

    def _new(self, length: int, link: int, go: dict[int, int]) -> int:
        self.go.append(go)
        self.length.append(length)
        self.link.append(link)
        return len(self.go) - 1

    def _split(self, p: int, b: int, q: int) -> int:
        """The state of the strings of ``q`` that are no longer than a step by ``b`` from ``p``."""
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = twin
        while p >= 0 and self.go[p].get(b) == q:
            self.go[p][b] = twin
            p = self.link[p]
        return twin

    def _add(self, string: bytes) -> int:
        last = 0
        for b in string:
            q = self.go[last].get(b)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, b, q)
                continue
            fresh, p = self._new(self.length[last] + 1, 0, {}), last
            while p >= 0 and b not in self.go[p]:
                self.go[p][b] = fresh
                p = self.link[p]
            if p >= 0:
                q = self.go[p][b]
                self.link[fresh] = q if self.length[q] == self.length[p] + 1 else self._split(p, b, q)
            last = fresh
        return last


class Tables:
    """What encoding needs of a tokenizer file, as arrays bounded by its vocabulary; made once, sent to all workers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model, kind = given["model"], given["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and given["normalizer"] is None and not any(
            model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        from tokenizers import pre_tokenizers

        self.pattern = pretoken_pattern(pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str)
        byte = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in given["added_tokens"]):
            raise ValueError(f"{path}: added tokens with conditions")
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        # A token's rank is that of the merge that makes it; single bytes come before all.
        self.rank, self.left, self.right = np.full((3, self.size), -1, np.int64)
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            i = vocab[a + b]
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = r, vocab[a], vocab[b]
        self.merge = {vocab[a] * self.size + vocab[b]: r for r, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"])}
        # Tokens that merging their own bytes does not give never stand in an encoding.
        fits = Fit(self)
        own = [i for i in vocab.values() if len(self.bytes[i]) == 1 or (self.rank[i] >= 0 and fits.open_until(int(self.left[i]), int(self.right[i]), int(self.rank[i])))]
        self.widths = [len(x) for x in self.bytes]
        automaton = SuffixAutomaton([self.bytes[i] for i in own])
        self.link, self.length = np.array(automaton.link), np.array(automaton.length)
        token = np.full(len(self.link), -1)
        for i in own:
            token[automaton.state_of[self.bytes[i]]] = i
        self.token = token
        # The nearest token that is a proper suffix: states in order of length, so that a state's link is known before it.
        up = np.zeros(len(self.link), np.int64)
        for s in np.argsort(self.length, kind="stable")[1:].tolist():
            link = automaton.link[s]
            up[s] = link if token[link] >= 0 else up[link]
        self.up = up
        self.step_keys = np.array([s << 8 | b for s, go in enumerate(automaton.go) for b in go])
        self.step_to = np.array([to for go in automaton.go for to in go.values()])


class Fit:
    """Whether two tokens can follow each other; answers are remembered in a row a left token."""

    def __init__(self, tables: Tables):
        self.merge, self.size = tables.merge, tables.size
        self.rank, self.left, self.right = tables.rank.tolist(), tables.left.tolist(), tables.right.tolist()
        self.rows: list[dict[int, bool]] = [{} for _ in range(self.size)]
        self.known = 0

    def open_until(self, u: int, v: int, until: int = NEVER) -> bool:
        """Does the seam of u and v stay open for all merges before rank ``until``?

        Undoing merges, latest first, shows the tokens that faced each other across the seam, and when the one of
        them that went first was merged away. Their own merge must not come earlier; at equal rank the left place
        goes first, so the seam loses to u's own merge and wins over v's.
        """
        merge, size, rank, end = self.merge, self.size, self.rank, until
        while True:
            r = merge.get(u * size + v)
            if r is not None and r < end:
                return False
            if rank[u] > rank[v]:
                end = rank[u]
                u = self.right[u]
            elif rank[v] >= 0:
                end = rank[v] + 1
                v = self.left[v]
            else:
                return True

    def add(self, u: int, v: int) -> bool:
        if self.known > PAIRS:
            self.known = 0
            for row in self.rows:
                row.clear()
        self.known += 1
        self.rows[u][v] = fits = self.open_until(u, v)
        return fits


class Encoder(dict):
    """Ids of whole texts, as bytes of little-endian 32-bit integers. As a dictionary: a word to the ids of a space and it.

    Two generations of words are kept: when the younger is full it becomes the older, so frequent words stay.
    """

    def __init__(self, tables: Tables, special: bool = True):
        super().__init__()
        self.tables, self.fit, self.old, self.pieces = tables, Fit(tables), {}, {}
        self.step = {k: (to, 0) for k, to in zip(tables.step_keys.tolist(), tables.step_to.tolist(), strict=True)}
        self.link, self.length = tables.link.tolist(), tables.length.tolist()
        # Per state: the length of the token that it is, and the tokens that end where it ends, with and without that one.
        token, up = tables.token.tolist(), tables.up.tolist()
        self.whole = [n if t >= 0 else -1 for n, t in zip(self.length, token, strict=True)]
        self.ends: list[tuple] = [()] * len(token)
        for s in np.argsort(tables.length, kind="stable")[1:].tolist():
            self.ends[s] = ((self.length[s], token[s]), *self.ends[up[s]]) if token[s] >= 0 else self.ends[up[s]]
        self.inner = [self.ends[u] for u in up]
        self.pretokens = regex.compile(tables.pattern, regex.V1).findall
        added = sorted(tables.added, key=len, reverse=True) if special else []
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def _fall_back(self, state: int, b: int) -> tuple[int, int]:
        """The state after ``b`` where the match must be shortened first, and the match's new length; remembered."""
        at = state
        while (to := self.step.get(at << 8 | b)) is None or to[1]:
            at = self.link[at]
        hop = (to[0], self.length[at] + 1)
        if len(self.step) < MOST_STEPS:
            self.step[state << 8 | b] = hop
        return hop

    def prefixes(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """For each piece the last token of every prefix of it (-1 for the empty one); good until the next is asked for.

        Prefixes that a piece shares with the piece before it are not worked out again, so pieces best come sorted.
        """
        step, whole, ends, inner, rows, add = self.step, self.whole, self.ends, self.inner, self.fit.rows, self.fit.add
        last, states, matched, known = [-1], [0], [0], b""
        for piece in pieces:
            i, shared = 0, min(len(known), len(piece))
            while i < shared and known[i] == piece[i]:
                i += 1
            del last[i + 1 :], states[i + 1 :], matched[i + 1 :]
            state, n = states[i], matched[i]
            for b in piece[i:]:
                i += 1
                hop = step.get(state << 8 | b) or self._fall_back(state, b)
                state = hop[0]
                n = hop[1] or n + 1
                for width, token in ends[state] if n == whole[state] else inner[state]:
                    before = last[i - width]
                    if before < 0:
                        break
                    fits = rows[before].get(token)
                    if fits or fits is None and add(before, token):
                        break
                last.append(token)
                states.append(state)
                matched.append(n)
            known = piece
            yield last

    def ids_of(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """The ids of each piece: last tokens, followed back from the end."""
        width = self.tables.widths
        for last in self.prefixes(pieces):
            ids, at = [], len(last) - 1
            while at:
                ids.append(last[at])
                at -= width[last[at]]
            ids.reverse()
            yield ids

    def _text_ids(self, text: str) -> bytes:
        return b"".join([self.get(p[1:]) or self._piece(p) if p[0] == " " else self._piece(p) for p in self.pretokens(text)])

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array("I", next(self.ids_of([piece.encode()]))).tobytes()
            if len(piece) <= PIECE_CHARS:
                if len(self.pieces) > REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        """Enter all words that are not known yet."""
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        new, letters, stopped = words.difference(self), [], []
        for word in new:
            ids = self.old.get(word)
            if ids is not None:
                self[word] = ids
            elif _LETTERS(word):
                letters.append(word)
            elif spelt := _WORD.fullmatch(word):
                stopped.append((word, *spelt.groups()))
                if spelt[1] not in self and spelt[1] not in new:
                    letters.append(spelt[1])
            else:
                self[word] = self._text_ids(" " + word)
        letters = sorted(set(letters))
        for word, ids in zip(letters, self.ids_of((" " + w).encode() for w in letters), strict=True):
            self[word] = array("I", ids).tobytes()
        for word, own, stops in stopped:
            self[word] = self[own] + self._piece(stops)

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts: list[list[tuple[str, list[str]]]] = []
        words: set[str] = set()
        for text in texts:
            cut = []
            for part in self.added.split(text) if self.added else [text]:
                first, *rest = _SEAM.split(part)
                words.update(rest)
                cut.append((first, rest))
            parts.append(cut)
        self.learn(words)
        out = []
        for cut in parts:
            ids = []
            for k, (first, rest) in enumerate(cut):
                if k % 2:  # a special token: it has no seam, or is taken whole all the same
                    ids.append(self.tables.added[" ".join([first, *rest])].to_bytes(4, "little"))
                else:
                    ids.append(self._text_ids(first))
                    ids.extend(map(self.__getitem__, rest))
            out.append(b"".join(ids))
        if len(words) > MOST_WORDS:  # a chunk of very many words is not kept
            self.clear()
        return out


def decoded(ids: bytes, tokens: list[bytes]) -> str:
    """The text of ids given as bytes of little-endian 32-bit integers."""
    numbers = np.frombuffer(ids, "<u4")
    if len(numbers) and int(numbers.max()) >= len(tokens):
        numbers = numbers[numbers < len(tokens)]
    return b"".join(map(tokens.__getitem__, numbers.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tables(path: str) -> Tables:
    return Tables(path)


_WORKER: dict[tuple[int, bool], Encoder] = {}


def _worker_encoder(sent, special: bool) -> Encoder:
    """One encoder a worker process, also over several tasks."""
    key = (id(sent.value), special)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(sent.value, special)
    return _WORKER[key]


def with_ids(documents: DataFrame, tokenizer: str, text: str = "text", column: str = "ids", special: bool = True) -> DataFrame:
    """``documents`` and a binary column of ids: four bytes each, little-endian."""
    sent = documents.sparkSession.sparkContext.broadcast(tables(tokenizer))  # bounded by the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(sent, special)
        for batch in chunks(batches, text):
            ids = pa.array(encoder([t or "" for t in batch.column(text).to_pylist()]), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, column])

    return map_arrow(documents, encode, T.StructType([*documents.schema.fields, T.StructField(column, T.BinaryType())]))


def with_text(encoded: DataFrame, tokenizer: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``encoded`` and the text of its column ``ids``, special tokens included."""
    sent = encoded.sparkSession.sparkContext.broadcast(tables(tokenizer).bytes)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decoded(x or b"", sent.value) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, column])

    return map_arrow(encoded, decode, T.StructType([*encoded.schema.fields, T.StructField(column, T.StringType())]))
