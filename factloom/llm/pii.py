r"""Personal data: regular expressions propose spans, checksums and ranges confirm them, context words adjust the score.

DataFrame functions only. A kind's matches and the text between them come from two passes of the same expression (extract
and split); adding up their lengths gives every match its place in code points. A text is only taken apart for a kind if
a cheap test says that a confirmed match is possible. Everything happens in the row: no shuffle, no Python.

Expressions use possessive repeats and a look-behind that starts only where a run starts (or where the last match ended),
so long runs take linear time and no deep recursion; they match what the plain forms in KINDS match.

Score: `base` of the kind, and CONTEXT_BONUS more if one of its context words stands within 40 characters before or after the
match (on either side at most one other match of the kind is looked past).
Spans of at least THRESHOLD are returned; the first four kinds always are.

Defined results: null text is empty: no spans; an empty table gives no rows; repeated rows are scanned one by one; spans of
different kinds may overlap and all are returned; only the id and text columns are read, so others can't clash.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import table

THRESHOLD = 0.5
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


class Kind(NamedTuple):
    """possible: cheap test of a text; valid: SQL condition on m, the match; context: words that add to the score."""

    name: str
    pattern: str
    possible: str
    valid: str
    base: float
    context: str


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: Luhn over the digits of m: from the right, every second digit doubled, 9 less if over 9.
_LUHN = f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> if(i % 2 = 1, int(c) * 2 - if(int(c) > 4, 9, 0), int(c))), 0, (a, x) -> a + x) % 10 = 0"
#: Mod 97 over the letters and digits of m, the first four moved to the end, A = 10 ... Z = 35.
_MOD97 = (
    "aggregate(split(concat(substring(regexp_replace(m, ' ', ''), 5), substring(regexp_replace(m, ' ', ''), 1, 4)), ''), 0, "
    "(a, c) -> if(c between '0' and '9', a * 10 + int(c), a * 100 + ascii(c) - 55) % 97) = 1"
)

KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true", 0.9, "mail|contact|address"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"t rlike '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'", "forall(split(m, '[.]'), p -> p rlike '^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')", 0.7, "ip|host|server|address"),
    # [0-9]([\x20-]?[0-9])+, 12 to 19 digits, Luhn
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "t rlike '[0-9](?:[ -]?[0-9]){11}'", f"length({_DIGITS}) between 12 and 19 and {_LUHN}", 0.7, "card|visa|credit|account|payment"),
    # \+[0-9][\x20().0-9-]+[0-9], 9 to 15 digits
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+') and t rlike '[+][0-9][ ().0-9-]'", f"length({_DIGITS}) between 9 and 15", 0.7, "phone|tel|call|mobile|fax"),
    # added by the method
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "t rlike '(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'", f"length(regexp_replace(m, ' ', '')) between 15 and 34 and {_MOD97}", 0.8, "iban|bank|account"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "t rlike '[0-9]-[0-9]{2}-[0-9]{4}'", "m rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)'", 0.4, "ssn|social security|tax"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])", "t rlike '[0-9a-f]{32}|AKIA|gh[pousr]_'", "m rlike '[0-9]' and m rlike '[A-Za-z]'", 0.3, "token|secret|key|password|passwd|credential"),
)
BASE_KINDS = ("email", "ip", "card", "phone")
#: What a context word adds.
CONTEXT_BONUS = 0.3


def _sql(text: str) -> str:
    """A string as a SQL literal that keeps backslashes."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: Kind, match: str) -> str:
    return re.sub(r"\bm\b(?!')", match, kind.valid)


def _spans(kind: Kind, rank: int) -> Column:
    """The confirmed spans of a kind, from columns p_<kind> (pieces) and m_<kind> (matches)."""
    p, ms = f"p_{kind.name}", f"m_{kind.name}"
    context = _sql(rf"(?<![a-z])(?:{kind.context})")
    earlier = f"right(concat(if(i > 0, concat(right(get({p}, i - 1), 40), get({ms}, i - 1)), ''), right({p}[i], 40)), 40)"
    later = f"left(concat(left({p}[i + 1], 40), coalesce(get({ms}, i + 1), ''), left(coalesce(get({p}, i + 2), ''), 40)), 40)"
    span = f"named_struct('start', a.pos + length({p}[i]), 'rank', {rank}, 'end', a.pos + length({p}[i]) + length({ms}[i]), 'kind', '{kind.name}', 'score', least(1D, {kind.base}D + if(lower({earlier}) rlike {context} or lower({later}) rlike {context}, {CONTEXT_BONUS}D, 0D)))"
    found = f"if({_valid(kind, f'{ms}[i]')}, concat(a.found, array({span})), a.found)"
    start = f"named_struct('pos', 0, 'found', cast(array() as {_SPANS}))"
    return F.expr(
        f"if(coalesce(size({ms}), 0) < 1, cast(array() as {_SPANS}), aggregate(sequence(0, size({ms}) - 1), {start}, "
        f"(a, i) -> named_struct('pos', a.pos + length({p}[i]) + length({ms}[i]), 'found', {found}), a -> a.found))"
    )


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """id and spans (start, end, kind, score; code points, end exclusive; by start, then kind as listed) of each document."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    taken = []
    for k in KINDS:
        possible = F.expr(k.possible)
        taken += [F.when(possible, F.split("t", k.pattern, -1)).alias(f"p_{k.name}"), F.when(possible, F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))).alias(f"m_{k.name}")]
    rows = rows.select("_id", *["t"] * keep_text, *taken)
    found = F.filter(F.flatten(F.array(*[_spans(k, i) for i, k in enumerate(KINDS)])), lambda s: (s["rank"] < len(BASE_KINDS)) | (s["score"] >= THRESHOLD))
    return rows.select(F.col("_id").alias(id_col), *["t"] * keep_text, F.sort_array(found).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; of overlapping spans the first is named, and all are cut."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(text_col).alias("_t"))
    rows = find(packed, id_col="_doc", text_col="_t", keep_text=True)
    cut = F.expr(
        "aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, s) -> if(s.start < a.at, "
        "named_struct('at', greatest(a.at, s.end), 'out', a.out), "
        "named_struct('at', s.end, 'out', concat(a.out, array(substring(t, a.at + 1, s.start - a.at), concat('<', s.kind, '>'))))), "
        "a -> concat(array_join(a.out, ''), substring(t, a.at + 1)))"
    )
    text = F.when(F.size("spans") == 0, F.col(f"_doc.`{text_col}`")).otherwise(cut)
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
