r"""Quality rules as a bitmask ledger, by DataFrame functions only.

`ledger` measures every document and evaluates every rule once: a rule that fails sets its bit in failure_bits. Policies
are named, versioned masks over those bits, so a new policy or an ablation never reads a text again: `verdicts` ands the
bits with a policy's mask, `ablation` counts by one bitwise aggregation what each rule rejects, what it alone rejects and
what would go without it.

All measures are per document, in the row: nothing is shuffled, grouped or sent to Python. Repeated windows are found by
the 64-bit hashes of a document's own windows (sorted with their places), so a count could be off only if two different
windows of one document had equal hashes.

Defined results: null text is empty (0 words, fails the base rules); an empty table gives an empty ledger and an ablation
of zeros; repeated rows are measured one by one; the ledger has the id and its own columns only, so others can't clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import SPACE_CLASS, table, words_column

#: Words of a window for n_repeat_words, and the characters that count as symbols.
WINDOW = 5
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bullet_lines", "n_ellipsis_lines", "n_wordless", "has_long_word")


class Rule(NamedTuple):
    """A rule fails where its condition over the measures holds; bits are never reused."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "many_words", "n_words > 1000000"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 14 * n_words"),
    Rule(5, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(6, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(7, "bullets", "n_lines >= 3 AND 100 * n_bullet_lines > 90 * n_lines"),
    Rule(8, "ellipses", "n_lines >= 3 AND 100 * n_ellipsis_lines > 30 * n_lines"),
    Rule(9, "wordless", "100 * n_wordless > 40 * n_words"),
    Rule(10, "overlong_word", "has_long_word = 1"),
)
BITS = {r.name: 1 << r.bit for r in RULES}
#: Policies by version: the names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
    "lenient": ("few_words", "repeated_windows", "symbols", "wordless"),
}
POLICY = "v1"


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(BITS[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and MEASURES of every document."""
    t, w, h = F.col("t"), F.col("w"), F.col("h")
    spaced = f"[^{SPACE_CLASS}]"
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select(
        "_id",
        words_column(t).alias("w"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).alias("word_chars"),
        _removed(t, SYMBOLS).alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(spaced)).alias("l"),
        F.regexp_count(t, F.lit(f"(?<!{spaced})[^{SPACE_CLASS}\\p{{L}}]+(?!{spaced})")).alias("n_wordless"),
        t.rlike(f"(?<!{spaced}){spaced}{{1001}}").cast("int").alias("has_long_word"),
    )
    keys = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
    line = F.col("l")
    rows = rows.select(
        "_id",
        F.size(w).alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size(line).alias("n_lines"),
        (F.size(line) - F.size(F.array_distinct(line))).alias("n_dup_lines"),
        F.size(F.filter(line, lambda x: x.rlike(r"^[\x20\t]*(?:[*•‣·-]|[0-9]+[.)])[\x20\t]"))).alias("n_bullet_lines"),
        F.size(F.filter(line, lambda x: x.rlike(r"(?:…|\.\.\.)[\x20\t]*$"))).alias("n_ellipsis_lines"),
        "n_wordless",
        "has_long_word",
        keys.alias("h"),
    )
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("s", placed).drop("h")
    s = F.col("s")
    twice = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
    rows = rows.withColumn("q", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    q = F.col("q")
    covered = F.aggregate(F.transform(q, lambda x, k: F.least(F.coalesce(F.get(q, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("n_repeat_words", covered)
    return rows.select("_id", *[F.col(m).cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, the measures and failure_bits."""
    bits = None
    for r in RULES:
        bit = F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, id_col=id_col, text_col=text_col).withColumn("failure_bits", bits).withColumnRenamed("_id", id_col)


def passes(policy: str | tuple[str, ...] = POLICY, bits: str = "failure_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def verdicts(entries: DataFrame, policy: str | tuple[str, ...] = POLICY) -> DataFrame:
    """The ledger with base_failed and kept under a policy; what the base rules reject is never kept."""
    return entries.withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy)})


def ablation(entries: DataFrame, policy: str | tuple[str, ...] = POLICY) -> DataFrame:
    """Per rule of a policy: documents it fails, documents only it rejects, documents rejected without it. One aggregation for all rules."""
    whole = mask(policy)
    names = [r.name for r in RULES if whole & BITS[r.name]]
    bits = F.col("failure_bits").bitwiseAND(F.lit(whole).cast("long"))
    aggregates = [F.count("*").alias("n")]
    for name in names:
        own, rest = F.lit(BITS[name]).cast("long"), F.lit(whole & ~BITS[name]).cast("long")
        aggregates += [F.count_if(bits.bitwiseAND(own) != 0).alias(f"{name}_a"), F.count_if(bits == own).alias(f"{name}_b"), F.count_if(bits.bitwiseAND(rest) != 0).alias(f"{name}_c")]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_a").alias("n_failed"), F.col(f"{n}_b").alias("n_only"), F.col(f"{n}_c").alias("n_rejected_without"), F.col("n").alias("n_documents")) for n in names]))
    return entries.agg(*aggregates).select(rows.alias("r")).select("r.*")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy does to the documents, alone and among the others."""
    return ablation(ledger(table(spark, sf_dir, "documents")))


def filter_documents(docs: DataFrame, policy: str | tuple[str, ...] = POLICY, *, text_col: str = "text") -> DataFrame:
    """docs, all their columns, without what the base rules or the policy reject; each row is judged by its own text."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(text_col).alias("_t"))
    judged = verdicts(ledger(packed, id_col="_doc", text_col="_t"), policy)
    # not a filter: it would be pushed below the measures and evaluate them once for each use
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_doc")))).select("col.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdicts(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS x, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT doc_id, i, concat_ws(' ', x, lead(x) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v, lead(x, 4) OVER v) AS k, lead(x, 4) OVER v AS z FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g WHERE z IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS j) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
u AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup,
        count(*) FILTER (regexp_matches(x, '^[\x20\t]*(?:[*•‣·-]|[0-9]+[.)])[\x20\t]')) AS n_bullet, count(*) FILTER (regexp_matches(x, '(?:…|\.\.\.)[\x20\t]*$')) AS n_ellipsis
      FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_words, sum(length(x)) AS word_chars, count(*) FILTER (NOT regexp_matches(x, '\p{L}')) AS n_wordless, max(length(x)) AS longest FROM w GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(n_bullet, 0) AS n_bullet, coalesce(n_ellipsis, 0) AS n_ellipsis,
        coalesce(n_wordless, 0) AS n_wordless, coalesce(longest, 0) AS longest
      FROM d LEFT JOIN m USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (n_words > 1000000)::BIGINT + 8 * (word_chars < 2 * n_words)::BIGINT
        + 16 * (word_chars > 14 * n_words)::BIGINT + 32 * (10 * n_symbols > 3 * n_words)::BIGINT + 64 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
        + 128 * (n_lines >= 3 AND 100 * n_bullet > 90 * n_lines)::BIGINT + 256 * (n_lines >= 3 AND 100 * n_ellipsis > 30 * n_lines)::BIGINT
        + 512 * (100 * n_wordless > 40 * n_words)::BIGINT + 1024 * (longest > 1000)::BIGINT AS failure_bits FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failure_bits = 0 AS kept, failure_bits FROM f
"""
