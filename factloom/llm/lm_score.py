r"""Language-model scoring with a weighted backoff automaton, learnt from the documents themselves.

Tokens are words `[^\x20\x09-\x0D]+` with A-Z lowered, then one end per document. Documents whose crc32(id as text) mod 10
is not 0 train. The automaton has

  * a root, whose arcs are all training words: P(w) = (c(w) - D) / N;
  * a state for each training word u and for the end. Its arcs are all words seen after u: (c(uw) - D) / c(u) + b(u) P(w);
    its failure arc leads to the root with weight b(u) = D * T(u) / c(u), what the T(u) arcs leave of u's mass;
  * from order 3 on, a state for each training sequence s of order - 1 or fewer words (a document's first may start with the
    end). Its arcs are all words seen after s: (c(sw) + M P(w | s without its first word)) / (c(s) + M); its failure arc
    leads to the state of s without its first word with weight M / (c(s) + M);
  * one arc from the root for any unseen word, with the mass D * V / N that discounting has freed.

A document is traversed once from left to right: the state is that of the longest sequence seen in training that the last
words end with; an arc is followed if there is one, else failure arcs until there is.

Nothing of the model is broadcast or collected, and nothing is left out: every word and every sequence of up to `order`
words that occurs in a training document counts. Documents are dealt to blocks by hash; a block sorts the keys of its
distinct sequences and sends them, packed, to the buckets of the ranges they fall in. A bucket adds up what all blocks sent
and returns the totals in the order they came in. So a sequence takes a few bytes a block, however often it occurs, and no
sequence, however common, weighs more than any other. Of a bigram that several blocks have, one is told that it is its own
to count, so T(u) is a sum over blocks, which goes with the words' counts.

A word is known by the upper 63 bits of its xxh64, a longer sequence by MARGIN bits more than the logarithm of all
characters (63 at most): the probability that it shares its key with any other is under 2 to the -MARGIN.

Defined results: null text is empty: its end alone; a null id counts as the empty text (crc32 0, held out); repeated rows
each count and are scored (those with equal id and text in one block); an empty table gives no rows; with no training document at all every word is unseen and
has probability 1; only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .support import prepare, release, spaced_words, table, written

#: Scoring has no threshold: test_operators.py reads this where every word of its fixture reaches it.
STATES = 2000
SEED = 42
DISCOUNT = 0.5
#: What a state of two words or more gives to the shorter one, in occurrences.
MASS = 2.0
#: The end of a document, as a word; no word is empty.
END = b""
#: Characters of a block, and of the documents whose sequences of one length a bucket counts, about.
BLOCK_CHARS, BUCKET_CHARS = 16_000_000, 32_000_000
LEAST_BUCKETS = 8
WORD_BITS, LEAST_BITS, MARGIN = 63, 40, 16


def held_out(key) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of sequences of hashed contexts and words (the finaliser of splitmix64)."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them."""
    order = np.argsort(keys)
    starts = _starts(keys[order])
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    return keys[order[starts]], place


def _planes(x: np.ndarray) -> np.ndarray:
    """64-bit numbers byte by byte, the low bytes of all first: what is small or alike compresses."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def _packed(counts: list[np.ndarray], keys: np.ndarray | None = None) -> bytes:
    """Columns of as many 64-bit numbers each: counts, mostly a few bits, by Huffman's code, and differences of keys."""
    import zstandard

    wide, low = [] if keys is None else [_planes(np.diff(keys, prepend=np.uint64(0))).tobytes()], []
    for c in map(_planes, counts):
        low.append(c[0].tobytes())
        wide.append(c[1:].tobytes())
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    short = coder.compress(b"".join(low)) + coder.flush()
    return len(short).to_bytes(8, "little") + short + zstandard.ZstdCompressor(level=1).compress(b"".join(wide))


def _unpacked(data: bytes, counts: int, keys: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The counts that _packed was given, a row for each, and the keys."""
    import zstandard

    size = 8 + int.from_bytes(data[:8], "little")
    low = np.frombuffer(zlib.decompress(data[8:size], -15), np.uint8).reshape(counts, -1)
    n = low.shape[1]
    wide = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[size:]), np.uint8)
    planes = np.concatenate([low[:, None], wide[8 * n * keys :].reshape(counts, 7, n)], axis=1)

    def numbers(x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x.swapaxes(-1, -2)).view("<i8")[..., 0]

    return numbers(planes), np.cumsum(numbers(wide[: 8 * n].reshape(8, n))) if keys else None


class Block:
    """The tokens of some documents, one after another: word numbers, each document's length and whether it trains."""

    def __init__(self, keys: list, texts: list[str | None], bits: int):
        number: defaultdict = defaultdict(count().__next__)
        number[END]
        parts = []
        for text in texts:
            found = spaced_words(text.encode()) if text else []
            parts += [np.fromiter(map(number.__getitem__, found), np.int32, len(found)), np.zeros(1, np.int32)]
        tokens = np.concatenate(parts)
        h = np.fromiter((xxh64_intdigest(w, SEED) for w in number), np.uint64, len(number))
        # words are renumbered by hash, so that sorted words are sorted keys
        order = np.argsort(h)
        rank = np.empty(len(h), np.int32)
        rank[order] = np.arange(len(h), dtype=np.int32)
        self.hashes, self.tokens, self.end, self.bits = h[order], rank[tokens], int(rank[0]), bits
        self.lengths = np.fromiter((len(x) + 1 for x in parts[::2]), np.int64, len(texts))
        self.first = np.cumsum(self.lengths) - self.lengths
        self.out = np.fromiter(map(held_out, keys), bool, len(texts))
        self.train = np.repeat(~self.out, self.lengths)

    def before(self) -> np.ndarray:
        """The word before each token: the end, where a document starts, since documents follow one another."""
        return np.concatenate([np.full(1, self.end, np.int32), self.tokens[:-1]])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and training counts of the distinct words."""
        return self.hashes >> np.uint64(64 - WORD_BITS), np.bincount(self.tokens[self.train], minlength=len(self.hashes))

    def sequences(self, order: int):
        """For each order from 2 on: the key of the sequence that ends at each token that has so many before it (a document
        starts with the end of another), and where those tokens are."""
        words = self.hashes[self.tokens]
        full, at = _joined(self.hashes[self.before()], words), np.arange(len(words))
        place = at - np.repeat(self.first, self.lengths)
        for k in range(2, order + 1):
            if k > 2:
                full = np.concatenate([np.zeros(1, np.uint64), _joined(full[:-1], words[1:])])
                at = np.flatnonzero(place >= k - 2)
            yield k, full[at] >> np.uint64(64 - self.bits), at

    def distinct(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order and their training counts."""
        codes = keys << np.uint64(1) | self.train[at]
        codes.sort()
        starts = _starts(codes >> np.uint64(1))
        return codes[starts] >> np.uint64(1), np.add.reduceat((codes & np.uint64(1)).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the distinct bigrams in order, and their first words."""
        code = self.before().astype(np.uint64) << np.uint64(32) | self.tokens.astype(np.uint64)
        code.sort()
        code = code[_starts(code)]
        first = (code >> np.uint64(32)).astype(np.int64)
        keys = _joined(self.hashes[first], self.hashes[(code & np.uint64(0xFFFFFFFF)).astype(np.int64)]) >> np.uint64(64 - self.bits)
        order = np.argsort(keys)
        order = order[_starts(keys[order])]
        return keys[order], first[order]


def _messages(block: int, order: int, bits: int, buckets: int, keys: np.ndarray, *counts: np.ndarray) -> list[tuple]:
    """Rows (block, length, bucket, data) of ascending keys and their counts."""
    bucket = (keys >> np.uint64(bits - 20)) * np.uint64(buckets) >> np.uint64(20)
    ends = np.searchsorted(bucket, np.arange(buckets, dtype=np.uint64), side="right").tolist()
    return [(block, order, k, _packed([c[a:b] for c in counts], keys[a:b])) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]


_SENT = "block long, length int, bucket int, data binary"
_SENT_ARROW = pa.schema([("block", pa.int64()), ("length", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])


def _sent(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SENT_ARROW, strict=True)], schema=_SENT_ARROW) if rows else _SENT_ARROW.empty_table()


def _added(group: pa.Table, columns: int) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of what blocks sent to a bucket: the blocks, the columns of totals to return to each, whether each of its keys is its
    own to count, and the totals of the distinct keys."""
    group = group.sort_by("block")
    parts = [_unpacked(x, columns, True) for x in group.column("data").to_pylist()]
    keys = np.concatenate([x for _, x in parts])
    order = np.argsort(keys)
    starts = _starts(keys[order])
    sums = np.stack([np.add.reduceat(np.concatenate([x[c] for x, _ in parts])[order], starts) for c in range(columns)])
    back = np.empty((columns, len(keys)), np.int64)
    back[:, order] = np.repeat(sums, np.diff(np.append(starts, len(keys))), axis=1)
    own = np.zeros(len(keys), np.int64)
    own[order[starts]] = 1
    cuts = np.cumsum([len(x) for _, x in parts])[:-1]
    return group.column("block").to_pylist(), np.split(back, cuts, axis=1), np.split(own, cuts), sums


def _returned(answers: pa.Table, length: int, columns: int) -> np.ndarray:
    """The totals of a block's keys of a length, in order."""
    rows = answers.filter(pc.equal(answers.column("length"), length)).sort_by("bucket").column("data").to_pylist()
    return np.concatenate([np.zeros((columns, 0), np.int64), *(_unpacked(x, columns)[0] for x in rows)], axis=1)


class Automaton:
    """States, arcs and failure weights over word numbers, as dense arrays; the root is the last state. Scoring takes the root
    from it, and the other states' arcs from arcs()."""

    def __init__(self, n: int, v: int, states: dict[bytes, int], counts: np.ndarray, pairs: np.ndarray):
        self.n, self.v, self.root = n, v, len(states)
        size = len(states)
        self.arcs = np.full((size + 1, size + 1), np.nan)
        self.failure = np.zeros(size + 1)
        if size:
            own = np.maximum(pairs - DISCOUNT, 0) / counts[:, None]
            left = 1 - own.sum(1)
            self.failure[:size] = np.log10(left)
            seen = own + left[:, None] * (counts - DISCOUNT)[None, :] / n
            self.arcs[:size, :size] = np.where(pairs > 0, np.log10(seen), np.nan)
        self.unseen = math.log10(DISCOUNT * v / n) if n else 0.0

    def at_root(self, c: np.ndarray) -> np.ndarray:
        """log10 of the root's arcs of words with training counts c."""
        return np.where(c > 0, np.log10(np.maximum(c - DISCOUNT, DISCOUNT) / max(self.n, 1)), self.unseen)


def arcs(root: np.ndarray, own: np.ndarray, followers: np.ndarray, seen: np.ndarray, longer: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each token: root: log10 at the root; own and followers: training count of the word before it and
    how many different words follow that; seen: count of the bigram; longer, for each order from 3 on: the places of tokens
    with so long a context, the counts of the contexts and of the sequences."""
    p = 10.0**root
    p = np.where(followers > 0, (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * followers * p) / np.maximum(own, 1), p)
    for at, context, c in longer:
        p[at] = (c + MASS * p[at]) / (context + MASS)
    return np.log10(p)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams) and score (the automaton with
    sequences of up to `order` words)."""
    if order < 2:
        raise ValueError("the automaton's order is 2 or more")
    spark = docs.sparkSession
    prepare(spark)
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks, buckets = max(1, -(-chars // block_chars)), max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    bits = max(LEAST_BITS, min(WORD_BITS, MARGIN + chars.bit_length()))
    source = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).alias("block"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).groupBy("block")

    def read(group: pa.Table) -> tuple[int, Block]:
        return group.column("block")[0].as_py(), Block(group.column("_id").to_pylist(), group.column("_text").to_pylist(), bits)

    def send(group: pa.Table) -> pa.Table:
        at, block = read(group)
        return _sent([m for k, keys, where in block.sequences(order) for m in _messages(at, k, bits, buckets, *block.distinct(keys, where))])

    def count_sequences(group: pa.Table) -> pa.Table:
        length, bucket = (group.column(c)[0].as_py() for c in ("length", "bucket"))
        of, totals, own, _ = _added(group, 1)
        return _sent([(b, length, bucket, _packed([x[0], o] if length == 2 else [x[0]])) for b, x, o in zip(of, totals, own, strict=True)])

    counted = written(source.applyInArrow(send, _SENT).groupBy("length", "bucket").applyInArrow(count_sequences, _SENT), "lm-sequences")
    release(spark)

    def send_words(group: pa.Table, answers: pa.Table) -> pa.Table:
        at, block = read(group)
        keys, c = block.words()
        _, first = block.bigrams()
        total, own = _returned(answers, 2, 2)
        followers = np.bincount(first[(own > 0) & (total > 0)], minlength=len(keys))
        return _sent(_messages(at, 1, WORD_BITS, buckets, keys, c, followers))

    def count_words(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        of, totals, _, (c, _) = _added(group, 2)
        rows = _sent([(b, 1, bucket, _packed(list(x))) for b, x in zip(of, totals, strict=True)])
        return rows.append_column("n", pa.array([int(c.sum())] + [0] * (len(of) - 1), pa.int64())).append_column("v", pa.array([int((c > 0).sum())] + [0] * (len(of) - 1), pa.int64()))

    words = written(
        source.cogroup(counted.where("length = 2").withColumnRenamed("block", "of_block").groupBy("of_block")).applyInArrow(send_words, _SENT).groupBy("bucket").applyInArrow(count_words, _SENT + ", n long, v long"),
        "lm-words",
    )
    release(spark)
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    model = Automaton(n, v, {}, np.zeros(0), np.zeros((0, 0)))
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def traverse(group: pa.Table, answers: pa.Table) -> pa.Table:
        _, block = read(group)
        c, t = _returned(answers, 1, 2)
        before, longer, seen, last = block.before(), [], None, np.zeros(0, np.int64)
        for k, keys, at in block.sequences(order):
            totals = _returned(answers, k, 2 if k == 2 else 1)[0]
            found = totals[_distinct(keys)[1]]
            if k == 2:
                seen = found
            else:
                longer.append((at, last[at - 1], found))
            last = np.zeros(len(block.tokens), np.int64)
            last[at] = found
        p = arcs(model.at_root(c)[block.tokens], c[before], t[before], seen, longer)
        base = np.log10((c + 0.1) / (model.n + 0.1 * (model.v + 1)))[block.tokens]
        columns = [
            group.column("_id"),
            pa.array(block.out),
            pa.array(block.lengths),
            pa.array(np.add.reduceat((c > 0)[block.tokens].astype(np.int64), block.first)),
            pa.array(np.full(len(block.out), model.n, np.int64)),
            pa.array(np.add.reduceat(base, block.first)),
            pa.array(np.add.reduceat(p, block.first)),
        ]
        return pa.table(columns, names=["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = counted.unionByName(words.drop("n", "v")).withColumnRenamed("block", "of_block").groupBy("of_block")
    out_schema = f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return source.cogroup(answers).applyInArrow(traverse, out_schema).withColumnRenamed("_id", id_col)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), order=3)
