r"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into five segments. Four differing bits leave two segments intact, or one while each other
segment differs in exactly one bit. So a fingerprint is indexed by its ten pairs of segments and by each segment with the
next one's one-wildcard variants (64 keys). Fingerprints that meet by a wildcard only need comparing if they differ in that
bit, and then they differ in the parity of every segment but the intact one; whether two such parities are equal is the same
for both, which gives the key three bits more. Equal keys are joined and the fingerprints verified, exactly and without a
cap; keys have 24 to 29 bits besides their number.

Copies cost nothing: equal fingerprints are one class before anything is joined. Large groups of near copies would still
give all their pairs, so links are made in steps that reach the same components. First every key links its members to one
of them, where that link holds, several times with another one each; components are taken over these links. That is done
with the ten pairs of segments as keys, which are few and bring most linked fingerprints together, and then with those of
the signatures that different components share. Only then members of a key that are still in different components are
joined and verified.

`deduplicate` finds documents whose sets of five-word shingles have a similarity of 0.8 or more, which may differ in far
more than four of 64 bits: see there.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; a text of fewer words than a
shingle is one shingle; a null id belongs to the class of its text but is never a component's id unless the component has
no other; repeated rows keep their own rows; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components
from .support import bounded, kept, prepare, release, spaced_words, table, tidied, written

#: (first bit, bits) of the segments, and the most bits by which linked fingerprints differ.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
DISTANCE = 4
#: How often keys link their members to one of them before pairs are joined.
ROUNDS = 2
SEED = 42
_CHUNK = 1 << 14
#: Rows of ids that may be broadcast; for similar(), whose dozens of joins follow other stages in one driver: each passes
#: through its heap as rows, as a table and as blocks, and stays there for a while.
BROADCAST_ROWS, SIMILAR_ROWS = 500_000, 50_000


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in parts; a text without words has none."""
    words = spaced_words(text.encode()) if text else []
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= size:
        yield np.array([xxh64_intdigest(joined, SEED)], "<u8")
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[size - 1 :].tolist()
    first = [0, *(ends[: len(words) - size] + 1).tolist()]
    for k in range(0, len(last), _CHUNK):
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[k : k + _CHUNK], last[k : k + _CHUNK], strict=True)], "<u8")


def _majority(parts: list[np.ndarray]) -> int:
    """The bits that over half of the hashes have."""
    total, seen = sum(map(len, parts)), np.zeros(64, np.int64)
    for h in parts:
        seen += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return sum(1 << b for b in np.flatnonzero(2 * seen > total).tolist())


def fingerprint(text: str | None, size: int) -> int:
    """The fingerprint of a whole text: a bit is set if over half the shingles' hashes set it."""
    return _majority(list(shingle_hashes(text, size)))


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another independent hash of hashed shingles (the finaliser of splitmix64)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """_id and fp (the fingerprint as a signed long) of each document."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, size) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["_id", "fp"])

    return source.mapInArrow(lambda b: tidied(run(b)), f"_id {source.schema['_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_BITS = [((1 << n) - 1) << first for first, n in SEGMENTS]


def _bits_of(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long"))


def _wildcards() -> list[tuple[int, int]]:
    """(segment, bit of the next segment) of each key with a wildcard."""
    follows = [SEGMENTS[(a + 1) % len(SEGMENTS)] for a in range(len(SEGMENTS))]
    return [(a, first + b) for a, (first, n) in enumerate(follows) for b in range(n)]


def signatures() -> list[Column]:
    """The keys of a fingerprint fp, as hashes of the key's number and the bits it holds."""
    count, keys = len(SEGMENTS), []
    for k, (a, bit) in enumerate(_wildcards()):
        others = [_BITS[c] for c in range(count) if c != a]
        parities = [F.bit_count(_bits_of(x | y)) % 2 for x, y in zip(others, others[1:], strict=False)]
        keys.append(F.xxhash64(F.lit(k), _bits_of(_BITS[a] | _BITS[(a + 1) % count] & ~(1 << bit)), *parities))
    return keys + segment_pairs()


def sides() -> list[Column]:
    """For each of the signatures, what two fingerprints have to differ in to be compared: the wildcard's bit, or nothing."""
    return [(_bits_of(1 << bit) != 0).cast("tinyint") for _, bit in _wildcards()] + [F.lit(None).cast("tinyint") for _ in segment_pairs()]


def signature_keys(rows: DataFrame) -> DataFrame:
    """fp, root, key and side of rows with fp and root."""
    pairs = F.explode(F.array(*[F.struct(k.alias("key"), x.alias("side")) for k, x in zip(signatures(), sides(), strict=True)]))
    return rows.select("fp", "root", pairs.alias("k")).select("fp", "root", "k.key", "k.side")


def segment_pairs() -> list[Column]:
    """Cheap keys of a fingerprint fp that bring most linked ones together: every pair of segments, without wildcards."""
    return [F.xxhash64(F.lit(-1 - k), _bits_of(a | b)) for k, (a, b) in enumerate(combinations(_BITS, 2))]


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows (fp, key) whose key several fingerprints have."""
    several = kept(keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("key"))
    return keyed.join(bounded(several, BROADCAST_ROWS), "key", "left_semi")


def within_distance(a: str, b: str) -> Column:
    """Whether the fingerprints <a>fp and <b>fp are linked."""
    return F.expr(f"bit_count({a}fp ^ {b}fp) <= {DISTANCE}")


def _facing(a: str, b: str) -> Column:
    """Whether rows of a key are to be compared under it: sides a and b differ, or the key has none."""
    return F.col(a).isNull() | (F.col(a) != F.col(b))


def links(fps: DataFrame, keys: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column], hints: DataFrame, verified: Callable[[DataFrame, str], DataFrame] | None = None, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Components of distinct fingerprints: fp and root, for those that have a link to another one.

    fps: fp (distinct longs) and whatever else near reads; keys: gives fp, root, key and side (null, or a byte that has to
    differ) of rows of fps with root; near: whether two rows are linked, given prefixes of their
    columns; hints: (key, fp) rows whose keys are cheap and bring many linked fingerprints together, so that what they
    merge needn't be found by the many keys; verified: of rows with fp and another named column of fingerprints, those that
    are linked, where near only bounds that; most_rows: rows that may be broadcast. The other columns join those rows of keys that have anything to be compared with.
    """
    spark, more_columns = fps.sparkSession, [c for c in fps.columns if c != "fp"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = bounded(fps, most_rows // 4) if more_columns else None

    def full(df: DataFrame) -> DataFrame:
        """df with the other columns of its fp."""
        return df if wide is None else df.join(wide, "fp")

    def pivoted(shared: DataFrame, roots: DataFrame | None, rounds: int) -> DataFrame | None:
        """roots after every key has linked its members to one of them, so many times with another one each. shared has each
        member's root."""
        for r in range(rounds):
            rooted = written(_rooted(shared.drop("root"), roots, most_rows), "rooted") if r else shared
            held = ("fp", "root", "side", *more_columns)
            pivot = rooted.groupBy("key").agg(F.min_by(F.struct(*held), F.xxhash64("fp", F.lit(r))).alias("p"))
            pivot = pivot.select("key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in held])
            pairs = rooted.join(pivot, "key").where((F.col("root") != F.col("p_root")) & _facing("side", "p_side") & near("", "p_")).select("fp", "root", "p_fp", "p_root")
            if verified is not None:
                pairs = verified(pairs.distinct(), "p_fp")
            # edges are few; as many files as partitions would take more room than they
            edges = kept(pairs.select(F.col("root").alias("a"), F.col("p_root").alias("b")).distinct().coalesce(max(1, partitions // 8)))
            if edges.isEmpty():
                break
            roots = _merged(roots, edges)
            del rooted, pivot, pairs, edges
            release(spark)
        return roots

    roots = pivoted(kept(full(hints.withColumns({"root": F.col("fp"), "side": F.lit(None).cast("tinyint")}))), None, ROUNDS)
    # as many tasks as shuffles have: fingerprints are few and small, their keys many
    keyed = keys(_rooted(fps, roots, most_rows).repartition(partitions))
    # keys that bring different components together; most have one member
    facing = keyed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("side").alias("s0"), F.max("side").alias("s1"))
    several = kept(facing.where("lo <> hi and (s0 is null or s0 <> s1)").select("key"))
    shared = written(full(keyed.join(bounded(several, most_rows), "key").select("key", "fp", "root", "side")), "signatures")
    release(spark)
    # what is left to merge by pivots is little; the exact step below takes it from there
    roots = pivoted(shared, roots, 1)
    # Members that are in different components by now. Of such a pair one at least is outside the component that most of
    # the key's members are in, so only those are paired with all
    rooted = written(_rooted(shared.drop("root"), roots, most_rows), "rooted")
    main = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    main = main.select(F.col("key").alias("m_key"), "main")
    other = rooted.join(main, (F.col("key") == F.col("m_key")) & (F.col("root") != F.col("main")))
    other = other.select(*[F.col(c).alias(f"o_{c}") for c in ("key", "fp", "root", "side", *more_columns)])
    more = rooted.join(other, (F.col("key") == F.col("o_key")) & (F.col("root") != F.col("o_root")) & _facing("side", "o_side") & near("", "o_"))
    if verified is not None:
        more = verified(more.select("fp", "root", "o_fp", "o_root").distinct(), "o_fp")
    more = kept(more.select(F.col("root").alias("a"), F.col("o_root").alias("b")).distinct().coalesce(max(1, partitions // 8)))
    release(spark)
    roots = _merged(roots, more)
    return roots.select("fp", "root")


def _rooted(shared: DataFrame, roots: DataFrame | None, most_rows: int) -> DataFrame:
    """shared with the root of each fp, itself where it has none."""
    if roots is None:
        return shared.withColumn("root", F.col("fp"))
    return shared.join(bounded(roots, most_rows), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _merged(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """fp and root after more edges between roots."""
    files = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    new = components(edges).select(F.col("node").alias("old"), F.col("root").alias("new")).coalesce(files)
    if roots is None:
        return kept(new.select(F.col("old").alias("fp"), F.col("new").alias("root")))
    new = kept(new)
    moved = roots.join(new, F.col("root") == F.col("old"), "left").select("fp", F.coalesce("new", "root").alias("root"))
    fresh = new.join(roots.select("root").distinct(), F.col("old") == F.col("root"), "left_anti").select(F.col("old").alias("fp"), F.col("new").alias("root"))
    return kept(moved.unionByName(fresh).coalesce(files))


def _placed(classes: DataFrame, roots: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """classes (fp, class_id) with component_id, the least class_id of all that have its root; most have none."""
    least = kept(classes.select("fp", "class_id").join(roots, "fp").groupBy("root").agg(F.min("class_id").alias("component_id")))
    linked = kept(roots.join(bounded(least, most_rows), "root").select("fp", "component_id"))
    return classes.join(bounded(linked, most_rows), "fp", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """Per document: id, fp (signed long), class_id (least id with its fingerprint) and component_id (least id reachable)."""
    prints = kept(fingerprints(docs, id_col=id_col, text_col=text_col, size=size))
    classes = kept(prints.groupBy("fp").agg(F.min("_id").alias("class_id")))
    cheap = shared_keys(classes.select("fp", F.explode(F.array(*segment_pairs())).alias("key")))
    placed = kept(_placed(classes, links(classes.select("fp"), signature_keys, within_distance, cheap)).select("fp", "class_id", "component_id"))
    return prints.join(placed, "fp").select(F.col("_id").alias(id_col), "fp", "class_id", "component_id")


# near copies of a given similarity

#: 64-bit words of a wide fingerprint; least shingle hashes that tell whether a document can have a near copy at all, and how
#: many of them others have to have; the share of pairs at the threshold that signatures should find.
WIDE, LEAST, MET, RECALL = 8, 16, 8, 0.97
#: How often documents are left out of which others don't have enough shingles.
GATES = 2


def bit_rate(similarity: float) -> float:
    """The expected share of differing bits of two sets of equal size with a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float) -> int:
    """Differing bits of wide fingerprints up to which the sets of documents are compared: all but some 3 of 100,000 pairs
    at the threshold have no more."""
    p, n = bit_rate(similarity), 64 * WIDE
    return int(n * p + 4 * math.sqrt(n * p * (1 - p)))


def plan_segments(similarity: float, documents: int) -> list[tuple[int, ...]]:
    """Bit positions (of 64 * WIDE) of segments: six bits more than the logarithm of the documents, so that keys hold hardly
    any strangers, and fewer of those that are alike but not enough; as many as find RECALL of the pairs at the threshold by a segment of at most one differing bit.

    Each run of 64 * WIDE // bits segments is cut from another order of all positions, so that segments of a run share none
    and those of different runs few.
    """
    bits = min(32, max(10, math.ceil(math.log2(max(2, documents))) + 6))
    p, n = bit_rate(similarity), 64 * WIDE
    # by the number d of differing bits: how likely it is, and that a segment has at most one of them
    rows = []
    for d in range(n - bits + 1):
        likely = math.exp(math.lgamma(n + 1) - math.lgamma(d + 1) - math.lgamma(n - d + 1) + d * math.log(p) + (n - d) * math.log1p(-p))
        rows.append((likely, (math.comb(n - d, bits) + d * math.comb(n - d, bits - 1)) / math.comb(n, bits)))
    wanted = 1
    while sum(x * (1 - (1 - each) ** wanted) for x, each in rows) < RECALL:
        wanted += 1
    order, places = np.random.default_rng(SEED), []
    while len(places) < wanted:
        at = order.permutation(64 * WIDE).tolist()
        places += [tuple(sorted(at[k : k + bits])) for k in range(0, 64 * WIDE - bits + 1, bits)]
    return places[:wanted]


def segment_keys(rows: DataFrame, segments: list[tuple[int, ...]]) -> DataFrame:
    """fp, root, key and side of rows with a wide fingerprint w0 ...: of each segment, all its bits, and its bits with one of
    them left out, for each of them, which is the side. By numpy, since as expressions so many keys of so many words would
    fill the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                wide = np.stack([batch.column(2 + w).to_numpy(zero_copy_only=False).astype(np.int64) for w in range(WIDE)], axis=1).astype("<i8")
                bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").astype(np.uint64)
                keys, sides = [], []
                for k, segment in enumerate(segments):
                    places = np.arange(len(segment), dtype=np.uint64)
                    own = bits[:, list(segment)]
                    value = (own << places).sum(1, dtype=np.uint64)
                    # value has 32 bits at most, the place left out 6 (63: none) and the segment the rest, so keys are distinct
                    keys += [value & ~(np.uint64(1) << b) | b << np.uint64(32) | np.uint64(k << 38) for b in places]
                    sides += [own[:, b].astype(np.int8) for b in range(len(segment))]
                    keys.append(value | np.uint64(63 << 32 | k << 38))
                    sides.append(np.full(len(value), -1, np.int8))
                columns = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), len(keys))) for c in (0, 1)]
                side = np.stack(sides, axis=1).ravel()
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.stack(keys, axis=1).ravel().view(np.int64)), pa.array(side, mask=side < 0)], names=["fp", "root", "key", "side"])

    return rows.select("fp", "root", *[f"w{w}" for w in range(WIDE)]).mapInArrow(lambda b: tidied(run(b)), "fp long, root long, key long, side byte")


def sketches(docs: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """_id, th (hash of the text), w0 ... (wide fingerprint over the set of shingles) and least (the LEAST smallest hashes) of
    each document."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, least = np.zeros((batch.num_rows, WIDE), np.uint64), []
            for row, text in enumerate(batch.column(1).to_pylist()):
                parts = list(shingle_hashes(text, size))
                h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                least.append(h[:LEAST].view(np.int64))
                for k in range(WIDE if len(h) else 0):
                    wide[row, k] = _majority([_remixed(h[a : a + _CHUNK], k) for a in range(0, len(h), _CHUNK)])
            columns = [batch.column(0), batch.column(2), *(pa.array(wide[:, k].copy().view(np.int64)) for k in range(WIDE)), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "th", *(f"w{k}" for k in range(WIDE)), "least"])

    return source.mapInArrow(lambda b: tidied(run(b)), f"_id {source.schema['_id'].dataType.simpleString()}, th long, " + ", ".join(f"w{k} long" for k in range(WIDE)) + ", least array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """fp and shingles (the hashes of all its shingles, each once) of wanted documents (fp, th: the hash of a text, at_id: the
    id of a row that has it, by which copies of a text are dealt over tasks where the join shuffles)."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_th"))
    met = (F.col("_th") == F.col("th")) & F.col("_id").eqNullSafe(F.col("at_id"))
    source = texts.join(bounded(wanted, SIMILAR_ROWS), met).dropDuplicates(["fp"]).select("fp", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t, size)])).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["fp", "shingles"])

    return source.mapInArrow(lambda b: tidied(run(b)), "fp long, shingles array<long>")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per document: id and component_id, the least id reachable over pairs whose shingle sets are similar.

    Pairs are proposed by wide fingerprints (512 bits over the set of shingles) and linked if the sets of their shingles'
    hashes have that similarity; documents whose wide fingerprints are equal count as alike. Only documents of whose LEAST
    smallest shingle hashes others have MET or more among theirs are indexed (all they have, if that is fewer): of two
    documents with a similarity of 0.8, each hash is shared with probability 0.8, so fewer than 8 of 16 are in 2 of 1000
    such pairs. Of these, only documents are that have 0.8 of their shingles in common with any others, which loses none.
    """
    words = [f"w{k}" for k in range(WIDE)]
    prints = kept(sketches(docs, id_col=id_col, text_col=text_col, size=size).withColumn("fp", F.xxhash64(*words)))
    classes = kept(prints.groupBy("fp").agg(F.min("_id").alias("class_id"), F.min(F.struct("th", "_id")).alias("at"), *[F.first(c).alias(c) for c in (*words, "least")]))
    least = classes.select("fp", F.explode("least").alias("h"))
    met = least.groupBy("h").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("h")
    some = least.join(met, "h", "left_semi").groupBy("fp").agg(F.count("*").alias("_met"))
    candidates = classes.join(some, "fp").where(F.col("_met") >= F.least(F.lit(MET), F.ceil(F.size("least") * MET / LEAST)))
    candidates = kept(candidates.select("fp", F.col("at.th").alias("th"), F.col("at._id").alias("at_id"), *words))
    sets = written(shingle_sets(docs, candidates.select("fp", "th", "at_id"), id_col=id_col, text_col=text_col, size=size), "shingles")
    # two sets of that similarity share it of each: a document with more shingles than the rest that no other has is alone
    for _ in range(GATES):
        own = sets.select("fp", F.explode("shingles").alias("h")).groupBy("h").agg(F.min("fp").alias("fp"), F.count("*").alias("n")).where("n = 1")
        alone = own.groupBy("fp").agg(F.count("*").alias("alone"))
        stay = kept(sets.join(alone, "fp", "left").where(F.coalesce("alone", F.lit(0)) <= (1 - similarity) * F.size("shingles") + 1e-9).select("fp"))
        sets = written(sets.join(bounded(stay, SIMILAR_ROWS), "fp", "left_semi"), "shingles")
        release(docs.sparkSession)
    candidates = kept(candidates.drop("th", "at_id").join(bounded(sets.select("fp"), SIMILAR_ROWS), "fp", "left_semi"))
    hints = least.join(met, "h", "left_semi").join(candidates.select("fp"), "fp", "left_semi").select(F.col("h").alias("key"), "fp")
    segments, most = plan_segments(similarity, candidates.count()), most_bits(similarity)

    def near(a: str, b: str) -> Column:
        return F.expr(" + ".join(f"bit_count({a}{w} ^ {b}{w})" for w in words) + f" <= {most}")

    few = bounded(sets, SIMILAR_ROWS // 4, 8 * F.size("shingles"))

    def verified(pairs: DataFrame, other: str) -> DataFrame:
        rows = pairs.join(few.select("fp", F.col("shingles").alias("_a")), "fp").join(few.select(F.col("fp").alias(other), F.col("shingles").alias("_b")), other)
        both = F.size(F.array_intersect("_a", "_b"))
        return rows.where(both / (F.size("_a") + F.size("_b") - both) >= similarity).drop("_a", "_b")

    placed = kept(_placed(classes.select("fp", "class_id"), links(candidates, lambda rows: segment_keys(rows, segments), near, hints, verified, SIMILAR_ROWS), SIMILAR_ROWS).select("fp", "component_id"))
    return prints.join(placed, "fp").select(F.col("_id").alias(id_col), "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all their columns, with one document of each component of similar documents: the one whose id is least (of
    rows that repeat both id and text, one)."""
    columns = docs.columns
    packed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"))
    found = similar(packed, id_col="_id", text_col="_text", size=size, similarity=similarity).select(F.col("_id").alias("_own"), "component_id")
    own = F.col("_own").eqNullSafe(F.col("component_id"))
    # an id that is the least of one component may be in another one too, by a row that repeats it
    stays = found.where(own).select(F.col("_own").alias("_stay")).distinct()
    gone = kept(found.where(~own).select("_own").distinct().join(stays, F.col("_own").eqNullSafe(F.col("_stay")), "left_anti"))
    left = packed.join(bounded(gone, SIMILAR_ROWS), F.col("_id").eqNullSafe(F.col("_own")), "left_anti")
    unique = packed.groupBy("_id").count().where("count > 1").isEmpty()
    left = left if unique else left.dropDuplicates(["_id", "_text"])
    return left.select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
