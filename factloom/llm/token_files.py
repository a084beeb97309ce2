"""Token-id output: documents are encoded, written as Simple-8b files in id order and read back from the files.

Documents are range-partitioned by id, so file k holds lower ids than file k + 1 and an id's documents may spread over
files only where one id has very many rows. Each task encodes its documents in bounded groups and writes numbered files
under a name of its own, then renames: a task that runs again, or twice, leaves the same files. A manifest with one row
per file gives every file its global start.

Texts are cut where the pre-tokenizer always cuts: before a run of white space that follows something else, and after a
run of letters that other ASCII follows. Distinct cuts are encoded once by the tokenizers library and remembered by the
worker (bounded). A text that holds one of the tokenizer's added tokens, such as <|endoftext|>, is encoded whole, since the
library takes those out first; it gives such a token its own id.

Defined results: null text is empty and has the end id alone; null ids come first; rows that repeat an id are ordered by
text and have one result each; an empty table gives no files and no rows; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .support import file_system, fresh_dir, prepare, table, written

END_ID = 2
#: White space as Unicode's property White_Space has it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters by Unicode, all of these, for a quick rule: such a run, if other ASCII or nothing follows it, is one match.
LETTERS = r"A-Za-zÀ-ÖØ-öø-ɏ"
CUT = re.compile(rf" ?[{LETTERS}]++(?=[\x00-\x7f]|\Z)|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
WORD = re.compile(rf" [{LETTERS}]+\Z").match
#: Bytes of distinct cuts that a worker remembers, and ids in a file at most (one longer document is a file of its own).
REMEMBERED = 288 << 20
IDS_A_FILE = 4 << 20


class Encoder:
    """Ids of texts by a tokenizer file of the tokenizers library, distinct cuts encoded once."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: tokens that the library finds in any text, wherever the pre-tokenizer would cut
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.store = Store()

    def _ids(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of cuts in the order of the rest, ids, number of ids of each). Spaced words go to the library joined,
        1000 a text: each is one word to its pre-tokenizer, and the word numbers it reports divide the ids again."""
        single = np.fromiter((WORD(c) is not None for c in cuts), bool, len(cuts))
        order = np.concatenate([np.flatnonzero(single), np.flatnonzero(~single)])
        words, other = [cuts[k] for k in order[: single.sum()].tolist()], [cuts[k] for k in order[single.sum() :].tolist()]
        texts = ["".join(words[k : k + 1000]) for k in range(0, len(words), 1000)]
        ids, sizes = [], []
        for k, e in enumerate(self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            size = np.bincount(np.array(e.word_ids, np.int64), minlength=1)
            if len(size) != len(words[1000 * k : 1000 * (k + 1)]):
                raise ValueError("the tokenizer doesn't split text as this module does")
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(size)
        got = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        return order, np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if self.store.bytes() > REMEMBERED:
            self.forget()
        index, cuts, first, new = self.store.number([t] if any(a in t for a in self.added) else CUT.findall(t) for t in texts)
        for k in range(0, len(new), 50_000):
            order, ids, sizes = self._ids(new[k : k + 50_000])
            self.store.fill(first + k + order, ids, sizes)
        ids, size = self.store.gather(index)
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(cuts)])])


class Store:
    """The ids of numbered texts: those of text k are ids[at[k] : at[k] + size[k]]."""

    def __init__(self):
        self.known: defaultdict = defaultdict(count().__next__)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.chars = 0

    def number(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, int, list[str]]:
        """(numbers of the cuts of all texts, how many each text has, first new number, the new cuts in order), which the
        caller has to fill. Texts may be given one at a time: only new cuts are held on to."""
        before = len(self.known)
        parts = [np.fromiter(map(self.known.__getitem__, x), np.int64, len(x)) for x in texts]
        return np.concatenate([np.zeros(0, np.int64), *parts]), np.fromiter(map(len, parts), np.int64, len(parts)), before, self._since(before)

    def number_all(self, cuts: list[str]) -> tuple[np.ndarray, int, list[str]]:
        """The same of one list of cuts, without their number."""
        before = len(self.known)
        index = np.fromiter(map(self.known.__getitem__, cuts), np.int64, len(cuts))
        return index, before, self._since(before)

    def _since(self, before: int) -> list[str]:
        new = list(islice(reversed(self.known), len(self.known) - before))[::-1]
        self.chars += sum(map(len, new))
        return new

    def bytes(self) -> int:
        """What the store takes, about: a text of up to four bytes a character, its entry and its number, and the arrays."""
        return 4 * self.chars + 150 * len(self.known) + self.ids.nbytes + self.at.nbytes + self.size.nbytes

    def fill(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Set the ids of texts by number; ids follow one another."""
        while self.used + len(ids) > len(self.ids):
            self.ids.resize(len(self.ids) * 3 // 2, refcheck=False)
        while len(self.known) > len(self.at):
            for x in (self.at, self.size):
                x.resize(len(x) * 3 // 2, refcheck=False)
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[numbers], self.size[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts by number, one after another; the number of ids of each)."""
        size = self.size[index].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.at[index] - (ends - size), size)], size


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _groups(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


MANIFEST = "part int, piece int, file string, documents long, ids long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, partitions: int | None = None) -> DataFrame:
    """Write docs' ids into folder in ascending id order; the manifest of the files, in order, with each file's start.

    folder also gets, beside each file, the documents' ids as a column file (name.doc), since doc ids may be of any type.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(tokenizer)
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        pending: list = []  # (document ids, lengths, ids)
        piece = 0

        def put(name: str, data: bytes) -> None:
            own = f"{base}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as out:
                out.write(data)
            fs.move(own, f"{base}/{name}")

        def flush() -> pa.RecordBatch:
            nonlocal piece
            lengths, values = np.concatenate([p[1] for p in pending]), np.concatenate([p[2] for p in pending])
            name = f"part-{part:06d}-{piece:06d}.s8b"
            sink = pa.BufferOutputStream()
            keys = pa.concat_arrays([p[0] for p in pending])
            with pa.ipc.new_file(sink, pa.schema([("id", keys.type)])) as w:
                w.write_batch(pa.record_batch([keys], names=["id"]))
            put(f"{name}.doc", sink.getvalue().to_pybytes())
            put(name, simple8b.dump(lengths, values))
            piece += 1
            pending.clear()
            return pa.RecordBatch.from_pylist([{"part": part, "piece": piece - 1, "file": name, "documents": len(lengths), "ids": int(lengths.sum())}], schema=pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

        def typed(batches):
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        kind = None
        size = 0
        for keys, texts in _groups(typed(batches), 2_000_000):
            ids, lengths = encoder.encode(texts)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                lengths = lengths + 1
            pending.append((pa.array(keys, kind), lengths, ids))
            size += len(ids)
            if size >= IDS_A_FILE:
                yield flush()
                size = 0
        if pending:
            yield flush()

    manifest = written(ordered.mapInArrow(run, MANIFEST), "manifest")
    # a number for each partition; files are as many as the corpus asks for and stay a table
    sums, start = sorted(manifest.groupBy("part").agg(F.sum("ids").alias("n")).collect()), 0
    starts = []
    for r in sums:
        starts.append((r.part, start))
        start += r.n
    starts = F.broadcast(spark.createDataFrame(starts, "part int, first long"))
    before = F.sum("ids").over(Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.join(starts, "part").select(*manifest.columns, (F.col("first") + F.coalesce(before, F.lit(0))).alias("start"))


def read_token_files(manifest: DataFrame, folder: str, id_type: str, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document, from the files: id, start, n_tokens, ids_crc32 and, if asked for, the ids. A task reads whole files."""
    spark = manifest.sparkSession
    prepare(spark)
    files = manifest.count()
    schema = f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{base}/{row['file']}") as f:
                    data = simple8b.TokenFile(f.read())
                with fs.open_input_stream(f"{base}/{row['file']}.doc") as f:
                    keys = pa.ipc.open_file(f.read()).read_all().column(0).combine_chunks()
                crcs, ids = [], []
                for x in data.each():
                    crcs.append(simple8b.crc32(x))
                    if with_ids:
                        ids.append(pa.array(x.astype(np.int64)))
                columns = [keys, pa.array(data.starts[:-1] + row["start"]), pa.array(data.lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.to_numpy() for x in ids], pa.list_(pa.int64())))
                out = pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                for k in range(0, out.num_rows, 10_000):
                    yield out.slice(k, 10_000)

    return manifest.repartitionByRange(max(1, files), "part", "piece").mapInArrow(run, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, folder = table(spark, sf_dir, "documents"), fresh_dir(spark, "token-files")
    manifest = write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest, folder, docs.schema["doc_id"].dataType.simpleString())
