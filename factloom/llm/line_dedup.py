r"""Line dedup by deletion neighbourhoods, by DataFrame functions only.

A line with a word goes if an earlier line equals it or is within one edit of it; the earliest stays. Lines are compared as
their words (`[^\x20\x09-\x0D]+`). Lines of any length can be equal (by a 64-bit hash and the length of their words); an edit
puts in, takes out or replaces one word, and only counts between lines of at least MIN_WORDS = 5 words, so that two lines
within an edit agree in four fifths of their words or more. Earlier means by id, then a hash of the text (for rows that
share an id), then line number. The rule looks at each line by itself: whether the earlier line goes too makes no difference.

Every line within the bound of another shares with it a line with one word deleted. Emitting all such variants for every
line would multiply the corpus by its words, so lines are first grouped by hash, and only those that share a half with a
different line can have a partner: of two lines, the shorter of m words, an edit leaves the first m/2 or the last m/2
words alone. Those candidates emit their variants as hashed keys. Two lines with the same word number deleted and the same
rest differ by one replaced word, and all lines of such a key are within the bound of each other, so the earliest of them
is their witness; a variant that equals a whole line is one word longer than it. So no key ever emits pairs of its members.
Each line's earliest witness is verified word by word.

Hashes of variants combine by exclusive or over (word, place), so a line of n words gives its n variants in n steps.

Defined results: null and empty texts have no lines compared and stay as they are; a document may lose all its lines and
then has the empty text; rows that repeat an id and its text count as one place and get the same result; an empty table
gives an empty table; columns of any names pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import bounded, kept, release, table, written

MIN_WORDS = 5
#: Rows of candidate lines, or of documents to change, that may be broadcast (a few dozen bytes each).
BROADCAST_ROWS = 500_000


def _exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, th (hash of the text), no and raw of every line."""
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("no", "raw"))


def _normal(rows: DataFrame) -> DataFrame:
    """rows with norm, the words of raw joined by single spaces; most lines are so already and cost a few byte searches."""
    odd = F.contains("raw", F.lit("\t")) | F.contains("raw", F.lit("\r")) | F.contains("raw", F.lit("\x0b")) | F.contains("raw", F.lit("\f"))
    rows = rows.withColumn("raw", F.trim(F.when(odd, F.translate("raw", "\t\x0b\f\r", "    ")).otherwise(F.col("raw"))))
    return rows.withColumn("norm", F.when(F.contains("raw", F.lit("  ")), F.regexp_replace("raw", " +", " ")).otherwise(F.col("raw"))).drop("raw")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with a word: at (their place), n, h and h2 (hash and length of the line), and keys of their halves if they have
    MIN_WORDS words.

    A line of n words may be the shorter of a pair (m = n) or the longer (m = n - 1); its keys are m with its first m/2
    words, and m with its last m - m/2 words. Two prefixes give all four: one of n/2 words, and one of a word more (n odd)
    or less (n even).
    """
    rows = _normal(_exploded(docs, id_col, text_col))
    rows = rows.withColumn("n", F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).where("norm <> ''")
    half, odd = (F.col("n") / 2).cast("int"), F.col("n") % 2 == 1
    rows = rows.withColumns({"p": F.call_function("substring_index", "norm", F.lit(" "), half), "q": F.call_function("substring_index", "norm", F.lit(" "), half + F.when(odd, 1).otherwise(-1))})

    def after(prefix: str):
        return F.substring("norm", F.length(prefix) + 2, F.lit(1 << 30))

    n, m = F.col("n"), F.col("n") - 1
    keys = [
        F.xxhash64(F.lit(0), n, "p"),
        F.xxhash64(F.lit(1), n, after("p")),
        F.xxhash64(F.lit(0), m, F.when(odd, F.col("p")).otherwise(F.col("q"))),
        F.xxhash64(F.lit(1), m, F.when(odd, after("q")).otherwise(after("p"))),
    ]
    return rows.select(F.struct("_id", "th", "no").alias("at"), "n", F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("h2"), F.when(n >= MIN_WORDS, F.array(*keys)).otherwise(F.array().cast("array<bigint>")).alias("keys"))


def _candidates(distinct: DataFrame) -> DataFrame:
    """h and at of lines that share a half with a different line."""
    halves = distinct.select("h", F.explode("keys").alias("key"))
    shared = kept(halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key"))
    return halves.join(bounded(shared, BROADCAST_ROWS), "key", "left_semi").select("h").distinct()


def _witnesses(lines: DataFrame) -> DataFrame:
    """For each of distinct lines (h, at, words): w, the h of the earliest line that shares a variant and is earlier, if any."""
    spot = Window.partitionBy("h")
    upto = spot.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.select("h", "at", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    rows = rows.select("h", "at", "n", "i", F.xxhash64("word", "i").alias("g"), F.xxhash64("word", F.col("i") - 1).alias("s"))
    rows = rows.select("h", "at", "n", "i", F.bit_xor("g").over(spot).alias("x"), "g", F.bit_xor("g").over(upto).alias("gu"), F.bit_xor("s").over(upto).alias("su"), F.bit_xor("s").over(spot).alias("sx"))
    variants = written(
        rows.select(
            "h",
            "at",
            "n",
            "i",
            "x",
            F.xxhash64("n", "i", F.col("x").bitwiseXOR(F.col("g"))).alias("replaced"),
            F.col("gu").bitwiseXOR(F.col("g")).bitwiseXOR(F.col("su")).bitwiseXOR(F.col("sx")).alias("deleted"),
        ),
        "variants",
    )
    # one word replaced: the earliest line of a key is within an edit of all others
    first = variants.groupBy("replaced").agg(F.min(F.struct("at", "h")).alias("e"), F.count("*").alias("c")).where("c > 1").select("replaced", "e")
    replaced = variants.select("replaced", "h", "at").join(first, "replaced").where("e.at < at").select("h", "e")
    # one word more: a variant that is a whole line
    whole = variants.where("i = 0").select(F.col("x").alias("deleted"), F.col("n").alias("n_short"), F.struct("at", "h").alias("short"))
    pairs = variants.join(whole, "deleted").where("n = n_short + 1").select(F.struct("at", "h").alias("long"), "short")
    longer = pairs.select(F.greatest("long", "short").alias("l"), F.least("long", "short").alias("e")).select(F.col("l.h").alias("h"), "e")
    return replaced.unionByName(longer).groupBy("h").agg(F.min("e").alias("e")).select("h", F.col("e.h").alias("w"))


#: Whether arrays a and b, a as long as b or one longer, are within one edit.
_WITHIN = (
    "if(size(a) = size(b), size(filter(zip_with(a, b, (x, y) -> x = y), z -> not z)) <= 1, "
    "size(a) = size(b) + 1 and array_compact(transform(a, (x, i) -> if(i = cut, null, x))) = b)"
)


def _verified(found: DataFrame, lines: DataFrame) -> DataFrame:
    """The h of lines whose witness is within one edit, checked on the words."""
    own, other = lines.select("h", F.col("words").alias("wa")), lines.select(F.col("h").alias("w"), F.col("words").alias("wb"))
    rows = found.join(own, "h").join(other, "w")
    longer = F.size("wa") >= F.size("wb")
    rows = rows.select("h", F.when(longer, F.col("wa")).otherwise(F.col("wb")).alias("a"), F.when(longer, F.col("wb")).otherwise(F.col("wa")).alias("b"))
    # the first place where the longer differs; the shorter's end if nowhere
    cut = "coalesce(nullif(array_position(zip_with(slice(a, 1, size(b)), b, (x, y) -> x = y), false), 0) - 1, size(b))"
    return rows.withColumn("cut", F.expr(cut)).where(F.expr(_WITHIN)).select("h").distinct()


def duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses lines: _id, th, gone (line numbers from 0) and n_near (those that equal no earlier line)."""
    lines = written(_hashed(docs, id_col, text_col), "lines")
    distinct = kept(lines.groupBy("h", "h2").agg(F.min("at").alias("first"), F.count("*").alias("c"), F.first("keys").alias("keys")))
    release(docs.sparkSession)
    wanted = kept(_candidates(distinct).join(distinct.select("h", F.col("first").alias("at")), "h"))
    # the words of candidates, from their first place
    places = bounded(wanted.select("h", F.col("at._id").alias("p_id"), F.col("at.th").alias("p_th"), F.col("at.no").alias("p_no"), "at"), BROADCAST_ROWS)
    texts = _exploded(docs, id_col, text_col).join(places, F.col("_id").eqNullSafe(F.col("p_id")) & F.col("th").eqNullSafe(F.col("p_th")) & (F.col("no") == F.col("p_no")))
    words = kept(_normal(texts).select("h", "at", F.split("norm", " ").alias("words")).dropDuplicates(["h"]))
    release(docs.sparkSession)
    near = kept(_verified(_witnesses(words), words).withColumn("near", F.lit(True)))
    release(docs.sparkSession)
    marked = distinct.join(near, "h", "left").where("c > 1 or near").select("h", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.join(bounded(kept(marked), BROADCAST_ROWS), ["h", "h2"]).where("near or at <> first")
    by = gone.groupBy(F.col("at._id").alias("_id"), F.col("at.th").alias("th"))
    return by.agg(F.collect_set("at.no").alias("gone"), F.collect_set(F.when(F.col("at") == F.col("first"), F.col("at.no"))).alias("near"))


def mark(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs packed as _doc, with n_lines, n_dropped, n_near (of those) and left (the text without the dropped lines)."""
    found = kept(duplicate_lines(docs, id_col=id_col, text_col=text_col))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_own"), F.col(text_col).alias("_t"), F.xxhash64(F.col(text_col)).alias("_th"))
    rows = packed.join(bounded(found, BROADCAST_ROWS, 4 * (F.size("gone") + F.size("near"))), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("th")), "left").withColumn("_l", F.split("_t", "\n"))
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("gone")), lambda i: F.get("_l", i))
    return rows.select(
        "_doc",
        F.coalesce(F.size("_l"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("gone").isNull(), F.col("_t")).otherwise(F.array_join(stays, "\n")).alias("left"),
    )


def deduplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all their columns, without the lines that an earlier line equals or nearly equals."""
    rows = mark(docs, id_col=id_col, text_col=text_col)
    return rows.select(*[F.col("left").alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mark(table(spark, sf_dir, "documents"))
    return rows.select(F.col("_doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", "n_near", F.sha2(F.coalesce("left", F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
x AS (SELECT doc_id, no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
d AS (SELECT array_to_string(w, ' ') AS k, w, len(w) AS n, min((doc_id, no)) AS pl FROM x WHERE len(w) > 0 GROUP BY ALL),
v AS (SELECT k, pl, n, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 5)),
r AS (SELECT k, pl, min(pl) OVER (PARTITION BY n, i, rest) AS e FROM v),
p AS (SELECT v.k AS ka, v.pl AS aa, d.k AS kb, d.pl AS ab FROM v JOIN d ON v.rest = d.k WHERE d.n >= 5),
near AS (SELECT k FROM r WHERE e < pl UNION SELECT ka FROM p WHERE ab < aa UNION SELECT kb FROM p WHERE aa < ab),
j AS (SELECT x.doc_id, x.no, x.line, d.k IS NOT NULL AND ((x.doc_id, x.no) <> d.pl OR d.k IN (FROM near)) AS gone, d.k IS NOT NULL AND (x.doc_id, x.no) = d.pl AND d.k IN (FROM near) AS near
      FROM x LEFT JOIN d ON len(x.w) > 0 AND array_to_string(x.w, ' ') = d.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, count(*) FILTER (near)::BIGINT AS n_near,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS text_sha256
FROM j GROUP BY doc_id
"""
