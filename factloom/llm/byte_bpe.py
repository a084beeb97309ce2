r"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Texts are split by the vocabulary's pattern; a worker merges each distinct piece once. Pieces become rows (piece,
position, token). A recursive query joins neighbours with the merge table and contracts each piece's leftmost pair of
minimum rank, round after round, until no piece has a pair left. A piece that is itself in the vocabulary is that token.
Decoding joins (document, position, id) rows with the vocabulary and aggregates their bytes in order of position.

The rounds of a piece and the rows of each are at most its bytes, so the rows of a piece grow with the square of its
length. Pieces of over LONG bytes (a run of letters without any space) are contracted by the same rule with a heap
instead, in n log n; pieces go to the query in batches of bounded total rows.

Whole texts are first cut where the pattern always cuts: before a run of white space that follows something else, and
after a run of letters that other ASCII follows. So the pattern runs once per distinct cut. A worker forgets its pieces
and cuts when they take more than REMEMBERED bytes, whatever their lengths.

Defined results: null text is empty: no ids, and it decodes to the empty text; repeated documents are encoded one by one;
an empty table gives no rows; only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import prepare, table, tidied
from .token_files import CUT, Store, _groups

LONG = 200
#: Bytes of pieces and cuts that a worker remembers.
REMEMBERED = 128 << 20
#: Rows of a recursive query at most, about.
QUERY_ROWS = 1_000_000
#: Ids that a decoding query takes, about.
DECODED = 250_000

_MERGE = """
WITH RECURSIVE step(w, pos, tok, done) AS (
    SELECT w, pos, tok, false FROM start
    UNION ALL
    (WITH pair AS MATERIALIZED (
        SELECT s.w, s.pos, s.tok, s.npos, m.merged, m.merged::BIGINT * 65536 + s.pos AS here
        FROM (SELECT w, pos, tok, lead(tok) OVER piece AS nxt, lead(pos) OVER piece AS npos FROM step WHERE NOT done WINDOW piece AS (PARTITION BY w ORDER BY pos)) s
        LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt
    ), least AS (
        SELECT w, min(here) AS best, arg_min(npos, here) AS gone FROM pair GROUP BY w
    )
    SELECT p.w, p.pos, CASE WHEN p.here = l.best THEN p.merged ELSE p.tok END, l.best IS NULL
    FROM pair p JOIN least l ON p.w = l.w WHERE l.gone IS DISTINCT FROM p.pos)
)
SELECT w, tok FROM step WHERE done ORDER BY w, pos
"""

_DECODE = "SELECT d, string_agg(v.text, '' ORDER BY pos) AS text FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY d"


class Codec:
    """One vocabulary: ranks (a file of base64 token and rank per line) and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # \s of the pattern is Unicode's White_Space, which regex's own \s isn't quite
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
        merges = pa.table({"a": a, "b": b, "merged": r})  # noqa: F841  (a rank is the merged token's id)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        # a byte b stands as the character 256 + b, so that any bytes are text to the query
        names = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "text": ["".join(chr(256 + b) for b in t) for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM names")
        self.remembered = REMEMBERED
        self.forget()

    def forget(self) -> None:
        #: ids of known cuts and pieces; a piece by itself is a cut of one piece
        self.store = Store()

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same contraction with a heap: leftmost pair of minimum rank first."""
        tokens: list[bytes | None] = [piece[k : k + 1] for k in range(len(piece))]
        after, before = [*range(1, len(tokens)), -1], [*range(-1, len(tokens) - 1)]
        heap: list[tuple[int, int, bytes]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (r := self.ranks.get(both := tokens[k] + tokens[after[k]])) is not None:
                heapq.heappush(heap, (r, k, both))

        for k in range(len(tokens)):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            if tokens[k] is None or after[k] < 0 or tokens[k] + tokens[after[k]] != both:
                continue
            gone = after[k]
            tokens[k], tokens[gone], after[k] = both, None, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return tuple(self.ranks[t] for t in tokens if t is not None)

    def _merge(self, pieces: list[tuple[int, str]]) -> None:
        """Fill in pieces, given with their numbers."""
        direct, batch, rows = [], [], 0
        for k, piece in pieces:
            data = piece.encode()
            if (rank := self.ranks.get(data)) is not None:
                direct.append((k, rank))
            elif len(data) > LONG:
                ids = self.merge_long(data)
                self.store.fill(np.array([k]), np.array(ids), np.array([len(ids)]))
            else:
                batch.append((k, data))
                rows += len(data) * (len(data) + 1) // 2
                if rows > QUERY_ROWS:
                    self._query(batch)
                    batch, rows = [], 0
        if direct:
            numbers, ids = np.array(direct).T
            self.store.fill(numbers, ids, np.ones(len(ids), np.int64))
        if batch:
            self._query(batch)

    def _query(self, batch: list[tuple[int, bytes]]) -> None:
        sizes = np.array([len(d) for _, d in batch])
        which = np.repeat(np.arange(len(batch), dtype=np.int32), sizes)
        pos = (np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.db.register("start", pa.table({"w": which, "pos": pos, "tok": self.byte[np.frombuffer(b"".join(d for _, d in batch), np.uint8)]}))
        got = self.db.execute(_MERGE).fetchnumpy()
        self.db.unregister("start")
        self.store.fill(np.array([k for k, _ in batch]), got["tok"], np.bincount(got["w"], minlength=len(batch)))

    def _learn(self, first: int, cuts: list[str]) -> None:
        """Fill in cuts, numbered from first on."""
        split = [self.split(c) for c in cuts]
        several = [(first + k, parts) for k, parts in enumerate(split) if len(parts) > 1]
        index, more, pieces = self.store.number_all([x for _, parts in several for x in parts])
        self._merge([*((first + k, c) for k, (c, parts) in enumerate(zip(cuts, split, strict=True)) if len(parts) == 1), *enumerate(pieces, more)])
        if several:
            ids, size = self.store.gather(index)
            starts = np.cumsum([0, *(len(parts) for _, parts in several[:-1])])
            self.store.fill(np.array([k for k, _ in several]), ids, np.add.reduceat(size, starts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if self.store.bytes() > self.remembered:
            self.forget()
        index, cuts, first, new = self.store.number(map(CUT.findall, texts))
        if new:
            self._learn(first, new)
        ids, size = self.store.gather(index)
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(cuts)])])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of documents whose ids follow one another; an id outside the vocabulary is an error."""
        out = [b""] * len(lengths)
        if len(ids):
            if ids.min() < 0 or ids.max() >= len(self.ranks):
                raise ValueError("an id isn't in the vocabulary")
            upto = np.concatenate([[0], np.cumsum(lengths)])
            first = 0
            while first < len(lengths):
                # documents of DECODED ids together, or one of more
                end = max(first + 1, int(np.searchsorted(upto, upto[first] + DECODED, side="right")) - 1)
                doc = np.repeat(np.arange(first, end, dtype=np.int32), lengths[first:end])
                self.db.register("tokens", pa.table({"d": doc, "pos": np.arange(len(doc), dtype=np.int32), "id": ids[upto[first] : upto[end]].astype(np.int32)}))
                for d, text in self.db.execute(_DECODE).fetchall():
                    out[d] = text.encode("utf-16-le")[::2]
                self.db.unregister("tokens")
                first = end
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _ids_array(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of each document."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for keys, texts in _groups([batch], 2_000_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), _ids_array(*codec.encode(texts))], names=["_id", "ids"])

    return source.mapInArrow(lambda b: tidied(run(b)), f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and data (binary) of each document; null ids decode to nothing."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(ids_col).cast("array<bigint>"), F.array().cast("array<bigint>")).alias("_ids"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.decode(ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False)), pa.binary())], names=["_id", "data"])

    return source.mapInArrow(lambda b: tidied(run(b)), f"_id {kind}, data binary").withColumnRenamed("_id", id_col)


_DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Encode and decode again in one pass, with so many bytes of pieces remembered by a worker: id, n_tokens, digests of the ids (little-endian unsigned 32-bit) and of the decoded bytes, and the ids if asked for."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        codec.remembered = remembered
        for batch in batches:
            for keys, texts in _groups([batch], 1_000_000):
                ids, lengths = codec.encode(texts)
                raw, upto = ids.astype("<u4"), np.cumsum([0, *lengths]).tolist()
                columns = [
                    pa.array(keys, batch.schema.field(0).type),
                    pa.array(lengths, pa.int64()),
                    pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(upto, upto[1:], strict=False)]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode(ids, lengths)]),
                ]
                if with_ids:
                    columns.append(_ids_array(ids, lengths))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", *_DIGESTS.names, "ids"][: len(columns)])

    return source.mapInArrow(lambda b: tidied(run(b)), f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids).withColumnRenamed("_id", id_col)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
