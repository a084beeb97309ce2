"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by training token windows.

Every benchmark item gives its windows of `window` consecutive normalised words (an item with fewer words, but not
none, is one window). Workers hold the windows twice: as 64-bit hashes behind a bitmap, which a vectorised pass over a
whole document consults, and as the words themselves, by which every hash hit is verified.

The benchmark is broadcast if its text has at most `block_bytes`, so what a worker holds is bounded; it builds the index
once, and no documents are shuffled. A larger benchmark is joined instead: windows of documents and items meet by two
64-bit hashes of their words, and the places found go back to the documents by two hashes of the text.

Defined results: null or empty text has no words and no hits; a null item text has no windows; an item with a null id
marks words but is not listed; repeated documents are scanned one by one, repeated items count once by id; result columns
replace input columns of the same name; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .support import alnum_words, prepare, tidied

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Documents whose words a worker holds at once.
SLICE = 256
_BITS = 22
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


class WindowIndex:
    """The windows of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.tables: dict[int, dict[bytes, set]] = {}
        codes: dict[bytes, int] = {}
        for item, text in items:
            words = alnum_words(text.encode())
            if not words:
                continue
            codes.update((w, xxh64_intdigest(w) | 1) for w in words)
            size = min(window, len(words))
            at = self.tables.setdefault(size, {})
            for i in range(len(words) - size + 1):
                at.setdefault(b" ".join(words[i : i + size]), set()).add(item)
        self.code = codes.get
        self.factors = np.array([xxh64_intdigest(b"place%d" % k) | 1 for k in range(window)], np.uint64)
        self.filters = {}
        for size, at in self.tables.items():
            hashes = np.array([self._hashes(np.array([codes[w] for w in key.split()], np.uint64), size)[0] for key in at], np.uint64)
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[hashes >> np.uint64(64 - _BITS)] = True
            self.filters[size] = bitmap, np.sort(hashes)

    def _hashes(self, codes: np.ndarray, size: int) -> np.ndarray:
        n = len(codes) - size + 1
        h = codes[:n] * self.factors[0]
        for k in range(1, size):
            h += codes[k : k + n] * self.factors[k]
        return h ^ (h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)

    def scan(self, words: list[bytes], hit: np.ndarray, found: set) -> None:
        """Mark in hit the words inside occurrences of windows; add the items to found."""
        codes = np.fromiter(map(self.code, words, repeat(0)), np.uint64, len(words))
        for size, (bitmap, hashes) in self.filters.items():
            if len(words) < size:
                continue
            h = self._hashes(codes, size)
            maybe = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)])
            if len(maybe):
                near = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
                for i in maybe[hashes[near] == h[maybe]].tolist():
                    items = self.tables[size].get(b" ".join(words[i : i + size]))
                    if items:
                        hit[i : i + size] = True
                        found |= items


_last: list = [None, None]


def _index(items, window: int) -> WindowIndex:
    """The index of broadcast items; a worker holds that of the last benchmark."""
    key = (items.value[0], window)
    if _last[0] != key:
        _last[0] = _last[1] = None
        _last[1] = WindowIndex(items.value[1], window)
        _last[0] = key
    return _last[1]


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Code point spans of maximal runs of hit words, as [start, end)."""
    data, out = text.encode(), []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    firsts, lasts = edges[::2], edges[1::2] - 1
    places = [m.span() for m in _WORD.finditer(data.lower())]
    at_byte = at_char = 0
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        start = at_char + len(data[at_byte : places[a][0]].decode())
        end = start + len(data[places[a][0] : places[b][1]].decode())
        out.append({"start": start, "end": end})
        at_byte, at_char = places[b][1], end
    return out


_RUN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _result(batch: pa.RecordBatch, text_at: str, drop: list[str], texts: list, words: list, hits: list[np.ndarray], found: list) -> pa.RecordBatch:
    rest = batch.drop_columns([text_at, *drop])
    columns = [
        pa.array([len(w) for w in words], pa.int64()),
        pa.array([int(h.sum()) for h in hits], pa.int64()),
        pa.array([sorted(x for x in f if x is not None) for f in found], pa.list_(pa.string())),
        pa.array([_spans(t, h) if h.any() else [] for t, h in zip(texts, hits, strict=True)], _RUN_TYPE),
    ]
    return pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, *(f.name for f in RESULT)])


def _sliced(batches: Iterator[pa.RecordBatch], text_at: str) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Slices of batches with their texts and words."""
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
        texts = batch.column(text_at).to_pylist()
        yield batch, texts, [alnum_words(t.encode()) if t else [] for t in texts]


def _windows(rows: DataFrame, window: int, sizes: list[int] | None) -> DataFrame:
    """Of rows (k: anything, t: text): k, size, at and two hashes of the windows of each size (sizes None: each text's own)."""
    prepare(rows.sparkSession)
    factors = [np.array([xxh64_intdigest(b"%d place %d" % (f, k)) | 1 for k in range(window)], np.uint64) for f in range(2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, words in _sliced(batches, "t"):
            for row, w in enumerate(words):
                codes = np.fromiter((xxh64_intdigest(x) for x in w), np.uint64, len(w))
                for size in ([min(window, len(w))] if w else []) if sizes is None else [s for s in sizes if s <= len(w)]:
                    n = len(w) - size + 1
                    hashes = [sum((codes[k : k + n] * f[k] for k in range(size)), np.zeros(n, np.uint64)) for f in factors]
                    hashes = [(h ^ (h >> np.uint64(29))).view(np.int64) for h in hashes]
                    key = batch.column(0).take(pa.array(np.full(n, row)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.full(n, size, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, hashes)], names=["k", "size", "at", "a", "b"])

    return rows.mapInArrow(lambda b: tidied(run(b)), f"k {rows.schema['k'].dataType.simpleString()}, size int, at int, a long, b long")


def _scan_by_join(source: DataFrame, items: DataFrame, text_at: str, window: int, schema: T.StructType) -> DataFrame:
    """source with RESULT where the benchmark is too large to broadcast."""
    own = _windows(items.select(F.struct("i").alias("k"), "t"), window, None).select("k", "size", "a", "b").distinct()
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())
    key = F.struct(F.xxhash64(text_at).alias("x"), F.xxhash64(F.lit(1), text_at).alias("y"))
    found = _windows(source.where(F.col(text_at) != "").select(key.alias("k"), F.col(text_at).alias("t")), window, sizes)
    hits = found.withColumnRenamed("k", "_text_key").join(own, ["size", "a", "b"])
    hits = hits.groupBy("_text_key").agg(F.collect_set(F.struct("at", "size")).alias("_places"), F.collect_set("k.i").alias("_items"))
    rows = source.withColumn("_text_key", key).join(hits, "_text_key", "left").drop("_text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, words in _sliced(batches, text_at):
            hits = [np.zeros(len(w), bool) for w in words]
            for h, places in zip(hits, batch.column("_places").to_pylist(), strict=True):
                for p in places or ():
                    h[p["at"] : p["at"] + p["size"]] = True
            yield _result(batch, text_at, ["_places", "_items"], texts, words, hits, [x or () for x in batch.column("_items").to_pylist()])

    return rows.mapInArrow(lambda b: tidied(run(b)), schema)


def scan(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None
) -> DataFrame:
    """docs (the columns in keep, default all) with n_words, n_hit, items (ids as strings, sorted) and spans (code points of hit runs)."""
    prepare(docs.sparkSession)
    names = {f.name for f in RESULT}
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in names]
    text_at = "_scan_text"
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(text_at))
    schema = T.StructType([f for f in source.schema if f.name != text_at] + RESULT.fields)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    if (items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0) > block_bytes:
        return _scan_by_join(source, items, text_at, window, schema)
    rows = sorted({(r.i, r.t) for r in items.collect()}, key=lambda x: (x[0] or "", x[1]))
    # workers outlive a query, so the key tells this benchmark from any other
    block = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, words in _sliced(batches, text_at):
            index = _index(block, window)
            hits = [np.zeros(len(w), bool) for w in words]
            found: list[set] = [set() for _ in words]
            for w, h, f in zip(words, hits, found, strict=True):
                if w:
                    index.scan(w, h, f)
            yield _result(batch, text_at, [], texts, words, hits, found)

    return source.mapInArrow(lambda b: tidied(run(b)), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """docs without what the benchmark contaminates: whole documents, or (remove="spans") the runs of hit words in them."""
    columns = docs.columns
    if remove == "documents":
        marked = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(text_col).alias("_t")), benchmark, text_col="_t", keep=["_doc"], **options)
        return marked.where("n_hit = 0").select("_doc.*")
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    marked = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(text_col).alias("_t")), benchmark, text_col="_t", keep=["_doc"], **options)
    text = F.col(f"_doc.`{text_col}`")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda k: F.substring(
            text,
            F.when(k == 0, F.lit(1)).otherwise(F.get("spans", k - 1)["end"] + 1),
            F.when(k == F.size("spans"), F.length(text)).otherwise(F.get("spans", k)["start"]) - F.when(k == 0, F.lit(0)).otherwise(F.get("spans", k - 1)["end"]),
        ),
    )
    cut = F.when(F.size("spans") == 0, text).otherwise(F.concat_ws("", pieces))
    return marked.select(*[(cut.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c)) for c in columns])


def digest(items: list[str]) -> str:
    """The digest of a sorted list of item ids (for tests; the query computes it JVM side)."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .support import table

    marked = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
