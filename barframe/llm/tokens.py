"""Token ids in Arrow files of fixed-size lists.

Documents in ascending id order become one stream of token ids, an end id after each. A shard is one
range of ids; it is written as an Arrow file whose batches hold ``BATCH_ROWS`` sequences of exactly
``SEQUENCE`` ids and a mask, a bit each (0: padding after the shard's last id). All batches but
the last are equal, so sequence i lies in batch i // BATCH_ROWS at row i % BATCH_ROWS, and a memory map
gives its ids and its mask without a copy. A second file of the shard lists its documents: id, first token, length.
Ids fit 16 bits if the vocabulary does, else they take 32.

Defined results: a null or empty text is the end id alone; rows of one id follow each other by text;
rows without id come first; an empty table has no shards; other columns are not read. A lost task writes
its shard anew: files get their name in one rename.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.llm.common import chunks, map_arrow, text_bytes
from barframe.session import cut, scratch_path

SEQUENCE = 2048
BATCH_ROWS = 64
#: Text a shard, about; and the characters of a text that order it among texts of one id before shards are cut.
SHARD_BYTES, KEY_CHARS = 256 << 20, 32
END = 2
#: Pieces that a worker remembers, about; one longer than PIECE_CHARS is forgotten first. Ids of all of them, a piece.
REMEMBERED, PIECE_CHARS, PIECE_IDS = 600_000, 40, 8
#: Text whose different pieces are looked up at once (a longer document is a lot of its own), and runs of ids copied at once.
LOT_BYTES, RUNS = 4 << 20, 1 << 20
#: Latin letters, and a piece of them, digits and ASCII's signs, of which the pre-tokens are known.
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªº")
_PLAIN = re.compile(f"\n?[!-~{_LETTERS}]+").fullmatch
_PRETOKENS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n0-9{_LETTERS}]+|\n").findall
_SPACES = "".join(c for c in map(chr, range(0xD800)) if c.isspace())
#: First bytes of white space.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[*{c.encode()[0] for c in _SPACES}]] = True
#: Before a visible character a space always begins a new pre-token, and a line end is one: a text may be cut before both,
#: at a mark that takes the space's place.
_SEAM, _MARK = f"(?: |(\n))([^{_SPACES}])", "\uffff"


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library; pieces between seams are encoded once and remembered.

    A piece goes without its leading space; one that begins with a line end, as every line does, keeps that. Arrow cuts the
    texts and finds the different pieces of a lot, which get numbers; the ids of all texts are then taken from one
    array by the numbers. Of very many pieces the more used half stays, so memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        # The library's model can be asked for a pre-token straight away, spelt as the library's byte-level step spells it.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {ord(c): spell.pre_tokenize_str(c)[0][0] for c in _LETTERS + " \n"}
        self.space, self.model, self.parts = self.spelt[ord(" ")], self.library.model.tokenize, self.library.pre_tokenizer and self.library.pre_tokenizer.pre_tokenize_str
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        # Another tokenizer may have no seams there; then texts are encoded whole.
        self.direct = repr(self.library.pre_tokenizer) == repr(pre_tokenizers.ByteLevel(add_prefix_space=False)) and self.library.normalizer is None and not any(
            t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.parts_known = lru_cache(1 << 16)(self._part)
        self.number: dict[str, int] = defaultdict(count().__next__)  # a new piece gets the next number
        self.store, self.lengths, self.uses = np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces by the library's own steps, which spares it all but the ids; and how many each has."""
        model, space, known, ids, ends = self.model, self.space, self.parts_known, [], []
        for piece in pieces:
            if piece.isascii() and piece.isalpha():
                ids += [t.id for t in model(space + piece)]
            else:
                text = " " + piece if piece[:1].strip() else piece
                if _PLAIN(piece):
                    ids += [t.id for t in model(text.translate(self.spelt))] if piece.isalpha() else chain.from_iterable(map(known, _PRETOKENS(text)))
                elif len(piece) > PIECE_CHARS:
                    ids += self.library.encode(text, add_special_tokens=False).ids
                else:
                    ids += [t.id for part, _ in self.parts(text) for t in model(part)]
            ends.append(len(ids))
        return np.array(ids, self.kind), np.diff(np.array(ends, np.int64), prepend=0)

    def _part(self, part: str) -> tuple[int, ...]:
        return tuple([t.id for t in self.model(part.translate(self.spelt))])

    def _look_up(self, pieces: list[str], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text cut into ``pieces[places]``, and how many each of these has. The pieces are different and all used."""
        known = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        if len(self.number) > known:
            ids, lengths = self._pieces([pieces[k] for k in np.flatnonzero(numbers >= known).tolist()])
            self.store, self.lengths = np.concatenate((self.store, ids)), np.concatenate((self.lengths, lengths))
            self.uses = np.concatenate((self.uses, np.zeros_like(lengths)))
        self.uses[numbers] += np.bincount(places, minlength=len(pieces))
        found = _taken(self.store, self.lengths, numbers[places])
        if len(self.number) > REMEMBERED or len(self.store) > PIECE_IDS * REMEMBERED:
            self._forget()
        return found

    def _forget(self) -> None:
        names = list(self.number)
        kept = [k for k in np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2].tolist() if len(names[k]) <= PIECE_CHARS]
        self.number = defaultdict(count(len(kept)).__next__, {names[k]: n for n, k in enumerate(kept)})
        self.store, self.lengths = _taken(self.store, self.lengths, np.array(kept, np.int64))
        self.uses = self.uses[kept] // 2

    def _between(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts with added tokens: what lies between these is encoded as a text is."""
        parts = [self.at_added(t) for t in texts.to_pylist()]
        flat, sizes = list(chain.from_iterable(parts)), np.array([len(p) for p in parts], np.int64)
        token = np.concatenate([np.arange(n) % 2 == 1 for n in [0, *sizes.tolist()]])
        counts = np.ones(len(flat), np.int64)
        ids, counts[~token] = self._lot(pa.array([p for p, t in zip(flat, token.tolist(), strict=True) if not t], pa.large_string()))
        ids = np.insert(ids, np.cumsum(counts * ~token)[token], [self.added[p] for p, t in zip(flat, token.tolist(), strict=True) if t])
        return _lines(ids, counts, sizes, np.zeros(len(texts), bool))

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.library.encode(t, add_special_tokens=False).ids, self.kind) for t in texts.to_pylist()]
        return np.concatenate([self.store[:0], *ids]), np.array([len(x) for x in ids], np.int64)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, by a pattern: for texts with several spaces or line ends on end, or at an end."""
        begun = np.array([c.strip() != "" for c in pc.utf8_slice_codeunits(texts, 0, 1).to_pylist()], bool)
        marked = pc.replace_substring_regex(texts, _SEAM, _MARK + r"\1\2")
        pieces, places, sizes, _ = _split(pa.array(np.where(begun, "\n", ""), texts.type), marked, _MARK)
        return _lines(*self._look_up(pieces, places), sizes, begun)

    def _lot(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole, apart = np.full(len(texts), not self.direct), np.zeros(len(texts), bool)
        for token in self.added:
            apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        apart &= ~whole
        whole |= pc.match_substring(texts, _MARK).to_numpy(zero_copy_only=False) & ~apart
        pieces, places, sizes, different = _split(pa.scalar("\n", texts.type), pc.replace_substring(texts, "\n", " \n"), " ")
        # A piece that does not begin with a visible character, but for the line end, was cut off at no seam.
        data, bounds = text_bytes(different)
        loose = np.diff(bounds) == 0
        loose |= _MAY_BE_SPACE[np.append(data, 0)[bounds[:-1]]]
        for k in np.flatnonzero(loose).tolist():
            loose[k] = not (pieces[k][1:2] if pieces[k][:1] == "\n" else pieces[k][:1]).strip()
        odd = np.logical_or.reduceat(loose[places], np.cumsum(sizes) - sizes) & ~whole & ~apart
        plain = ~(odd | whole | apart)
        if not plain.all():
            places = places[np.repeat(plain, sizes)]
            used = np.bincount(places, minlength=len(pieces)) > 0
            pieces, places = [p for p, u in zip(pieces, used.tolist(), strict=True) if u], (np.cumsum(used) - 1)[places]
        ids, counts = _lines(*self._look_up(pieces, places), sizes[plain], np.ones(int(plain.sum()), bool))
        if plain.all():
            return ids, counts
        rows = np.empty(len(texts), object)
        for mask, encode in ((plain, None), (odd, self._cut), (apart, self._between), (whole, self._whole)):
            if not mask.any():
                continue
            if encode:
                ids, counts = encode(texts.filter(pa.array(mask)))
            for k, end, n in zip(np.flatnonzero(mask).tolist(), np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                rows[k] = ids[end - n : end]
        return np.concatenate(rows), np.array([len(x) for x in rows], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each; null is empty."""
        if not len(texts):
            return self.store[:0], np.empty(0, np.int64)
        return self._lot(pc.fill_null(texts.cast(pa.large_string()), ""))  # line ends make a text longer

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``kind``."""
        ids, counts = self.encode(pa.array(texts, pa.string()))
        return [ids[end - n : end].tobytes() for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)]


def _taken(store: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``store`` with these numbers, one after the other, and their lengths."""
    counts, starts, runs = lengths[numbers], (np.cumsum(lengths) - lengths)[numbers], [store[:0]]
    for a in range(0, len(numbers), RUNS):
        n = counts[a : a + RUNS]
        at = np.repeat(starts[a : a + RUNS] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        runs.append(store[at])
    return np.concatenate(runs), counts


def _split(before: pa.Array | pa.Scalar, texts: pa.Array, mark: str) -> tuple[list[str], np.ndarray, np.ndarray, pa.Array]:
    """The different pieces of ``before`` and the texts cut at ``mark``, which of them follow each other, how many a text has, and the pieces in Arrow."""
    lists = pc.split_pattern(pc.binary_join_element_wise(before, texts, pa.scalar("", texts.type)), mark)
    coded = lists.flatten().dictionary_encode()
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), sizes, coded.dictionary


def _lines(ids: np.ndarray, counts: np.ndarray, pieces: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From ids a piece to ids a text of so many ``pieces``; those that were ``begun`` by a line end, an id of its own, lose it."""
    ends = np.concatenate(([0], np.cumsum(counts)))[np.cumsum(pieces)]
    totals = np.diff(ends, prepend=0)
    return np.delete(ids, (ends - totals)[begun]), totals - begun


_WORKER: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """One encoder a worker process: what a task has learnt serves the next one."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in order, in tables of about ``LOT_BYTES``."""
    lot, size = [], 0
    for batch in chunks(batches):
        if lot and size + batch.nbytes > LOT_BYTES:
            yield pa.Table.from_batches(lot)
            lot, size = [], 0
        lot.append(batch)
        size += batch.nbytes
    if lot:
        yield pa.Table.from_batches(lot)


def _schema(kind: type) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), SEQUENCE)), ("mask", pa.list_(pa.uint8(), SEQUENCE // 8))])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _batch(ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    rows = -(-len(ids) // SEQUENCE)
    padded = np.zeros(rows * SEQUENCE, ids.dtype)
    padded[: len(ids)] = ids
    mask = np.packbits(np.arange(len(padded)) < len(ids), bitorder="little")
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((padded, SEQUENCE), (mask, SEQUENCE // 8))], schema=schema)


class _Shard:
    """Writes one shard: full batches as soon as there are ids for them, the rest at the end."""

    def __init__(self, folder: str, number: int, kind: type):
        self.system, path = pafs.FileSystem.from_uri(folder)
        self.final = f"{path}/shard-{number:06d}"
        self.own = f"{path}/_{uuid.uuid4().hex}"
        self.system.create_dir(path, recursive=True)
        self.schema, self.kind, self.total, self.held, self.waiting = _schema(kind), kind, 0, [], 0
        self.files = [self.system.open_output_stream(f"{self.own}.{x}") for x in ("arrow", "docs")]
        self.writers = [pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, _DOCS), strict=True)]

    def add(self, ids: pa.Array, tokens: np.ndarray, counts: np.ndarray) -> None:
        starts = self.total + np.cumsum(counts) - counts
        self.writers[1].write_batch(pa.record_batch([ids, pa.array(starts), pa.array(counts)], schema=_DOCS))
        self.total += len(tokens)
        self.held.append(tokens)
        self.waiting += len(tokens)
        full = SEQUENCE * BATCH_ROWS
        if self.waiting >= full:
            stream = np.concatenate(self.held)
            for a in range(0, len(stream) - full + 1, full):
                self.writers[0].write_batch(_batch(stream[a : a + full], self.schema))
            self.held = [stream[len(stream) // full * full :].copy()]
            self.waiting = len(self.held[0])

    def close(self) -> str:
        if self.waiting:
            self.writers[0].write_batch(_batch(np.concatenate(self.held), self.schema))
        for w, f in zip(self.writers, self.files, strict=True):
            w.close()
            f.close()
        for x in ("docs", "arrow"):
            self.system.move(f"{self.own}.{x}", f"{self.final}.{x}")
        return self.final


def as_uri(path: str) -> str:
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path


def write(documents: DataFrame, folder: str, tokenizer: str, end: int = END) -> DataFrame:
    """Encode every text and write the shards under ``folder`` (a shared one). Returns the manifest: (shard, tokens, base).

    Shards follow the ids because documents are range-partitioned by id; ``base`` (tokens in all earlier
    shards) needs one number a shard.
    """
    target = as_uri(folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = worker_encoder(tokenizer), None, TaskContext.get().partitionId()
        for batch in _lots(batches):
            shard = shard or _Shard(target, number, encoder.kind)
            ids, counts = encoder.encode(batch["text"].combine_chunks())
            shard.add(batch["doc_id"].combine_chunks(), np.insert(ids, np.cumsum(counts), end), counts + 1)
        if shard:
            shard.close()
            yield pa.record_batch([pa.array([number], pa.int64()), pa.array([shard.total], pa.int64())], names=["shard", "tokens"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # Of many rows without id or with one id, the beginning of the text deals them to several shards.
    keys = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, KEY_CHARS).asc_nulls_first()]
    ordered = texts.repartitionByRange(max(_partitions(documents.sparkSession), -(-size // SHARD_BYTES)), *keys).sortWithinPartitions(keys[0], F.col("text").asc_nulls_first())
    manifest = cut(map_arrow(ordered, encode, "shard long, tokens long"), "token-manifest")
    bases, total = [], 0
    for r in manifest.orderBy("shard").collect():  # one short row a shard
        bases.append((r["shard"], r["tokens"], total))
        total += r["tokens"]
    return documents.sparkSession.createDataFrame(bases, "shard long, tokens long, base long")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_shard(folder: str, shard: int) -> tuple[pa.ipc.RecordBatchFileReader, pa.ipc.RecordBatchFileReader]:
    """The shard's sequences and its documents. Local files are mapped, so that reading a sequence copies nothing."""
    system, path = pafs.FileSystem.from_uri(as_uri(folder))
    name = f"{path}/shard-{shard:06d}"
    local = isinstance(system, pafs.LocalFileSystem)
    return tuple(pa.ipc.open_file(pa.memory_map(f"{name}.{x}") if local else system.open_input_file(f"{name}.{x}")) for x in ("arrow", "docs"))


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and packed mask of one sequence of a shard, by its number alone: views of the file, nothing is copied."""
    batch, row = reader.get_batch(number // BATCH_ROWS), number % BATCH_ROWS
    return tuple(batch.column(name).values.to_numpy()[row * n : (row + 1) * n] for name, n in (("ids", SEQUENCE), ("mask", SEQUENCE // 8)))


def unpacked(mask: np.ndarray) -> np.ndarray:
    """A packed mask (or several, one after the other) as booleans."""
    return np.unpackbits(mask, bitorder="little").view(bool)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, a shard a task and a batch at a time."""
    target = as_uri(folder)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for shard, base in zip(given.column("shard").to_pylist(), given.column("base").to_pylist(), strict=True):
                sequences, documents = open_shard(target, shard)
                stream, at, begins = _stream(sequences), np.empty(0, np.uint32), 0
                for k in range(documents.num_record_batches):
                    docs = documents.get_batch(k)
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                        parts = [at]
                        while begins + sum(map(len, parts)) < start + n:
                            parts.append(next(stream))
                        at = np.concatenate(parts)
                        at, begins = at[start - begins :], start
                        sums.append(zlib.crc32(at[:n].astype("<u4").tobytes()))
                    start = pa.array(docs.column("start").to_numpy() + base)
                    yield pa.record_batch([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, _partitions(manifest.sparkSession))
    return map_arrow(manifest.select("shard", "base").repartition(n, "shard"), load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _stream(reader: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        yield batch.column("ids").values.to_numpy()[unpacked(batch.column("mask").values.to_numpy())]


def round_trip(documents: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write all documents to a folder of their own in the shared scratch space, and read the files back."""
    folder = scratch_path(documents.sparkSession, "tokens")
    return read(write(documents, folder, tokenizer, end), folder)
