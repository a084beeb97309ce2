"""Scalar functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, scale: int) -> Column:
    """Half away from zero; a negative scale rounds to tens, hundreds and so on."""
    return F.round(x, scale)


def clock() -> Column:
    """Now, as ISO 8601 text in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def slug(x: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def strip_prefix(x: Column, prefix: str) -> Column:
    return F.when(x.startswith(prefix), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def quoted(x: Column) -> Column:
    """As a JSON string."""
    return F.substring(F.to_json(F.struct(x.alias("v"))), len('{"v":') + 1, F.length(F.to_json(F.struct(x.alias("v")))) - len('{"v":}'))


def number_text(x: Column) -> Column:
    return x.cast("string")


def is_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}$")


def is_lower(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}$")


def is_digit(c: Column) -> Column:
    return c.rlike("^[0-9]$")


_FILTERS = {"lower": F.lower, "upper": F.upper, "quoted": quoted, "present": lambda x: F.isnotnull(x).cast("string"), "slug": slug}


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template's text: {name} and {name|filter} stand for values; a missing value is empty."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)(?:\|(\w+))?\}", template):
        parts.append(F.lit(template[at : m.start()]))
        value = values[m[1]]
        value = _FILTERS[m[2]](value.cast("string") if m[2] != "present" else value) if m[2] else value.cast("string")
        parts.append(F.coalesce(value, F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def json_path(document: Column, path: str) -> Column:
    """The text at a path of names, places and *; * is the first element that holds the rest of the path."""
    if "*" not in path.split("."):
        return F.get_json_object(document, "$." + re.sub(r"\.(\d+)(?=\.|$)", r"[\1]", path))
    head, _, rest = path.partition("*")
    head, rest = head.strip("."), rest.strip(".")
    inner = F.get_json_object(document, f"$.{head}") if head else document
    elements = F.from_json(inner, "array<string>")
    return F.get(F.filter(F.transform(elements, lambda e: json_path(e, rest) if rest else e), lambda v: v.isNotNull()), F.lit(0))


#: Endings of English nouns and what they become in the plural; the first that fits is used.
PLURALS = (
    ("child$", "children"),
    ("person$", "people"),
    ("([aeiou])y$", "$1ys"),
    ("ss$", "sses"),
    ("sh$", "shes"),
    ("ch$", "ches"),
    ("x$", "xes"),
    ("s$", "ses"),
    ("z$", "zzes"),
    ("y$", "ies"),
    ("$", "s"),
)


def plural(noun: Column) -> Column:
    out = None
    for ending, becomes in PLURALS:
        value = F.regexp_replace(noun, ending, becomes) if ending != "$" else F.concat(noun, F.lit(becomes))
        out = F.when(noun.rlike(ending), value) if out is None else out.when(noun.rlike(ending), value)
    return out


def text_holds(text: Column, operator: str, value) -> Column:
    """starts with, ends with or contains, or one of them after `not`, whatever the case of letters."""
    negated, name = operator.startswith("not "), operator.removeprefix("not ")
    holds = {"starts with": F.startswith, "ends with": F.endswith, "contains": F.contains}[name](F.lower(text), F.lower(F.lit(value) if isinstance(value, str) else value))
    return ~holds if negated else holds


def bare_comparison(x: Column, words: str) -> Column:
    """`10 or more`, `5 or fewer` and the like of a number."""
    m = re.fullmatch(r"(-?\d+(?:\.\d+)?) or (more|greater|less|fewer)", words)
    if m is None:
        raise ValueError(f"not a comparison: {words!r}")
    value = F.lit(float(m[1]) if "." in m[1] else int(m[1]))
    return x >= value if m[2] in ("more", "greater") else x <= value


def within(x: Column, low, high) -> Column:
    return x.between(low, high)


def before(a: Column, b: Column) -> Column:
    return a < b


def after(a: Column, b: Column) -> Column:
    return a > b


def is_past(t: Column) -> Column:
    return t < F.current_timestamp()


def is_future(t: Column) -> Column:
    return t > F.current_timestamp()


def is_current(start: Column, end: Column) -> Column:
    """Now lies in [start, end); an open end is current."""
    now = F.current_timestamp()
    return (start <= now) & (end.isNull() | (now < end))


def is_fresh(t: Column, interval: str) -> Column:
    return t >= F.current_timestamp() - F.expr(f"INTERVAL {interval}")


def address(ip: Column) -> Column:
    """An IPv4 address as an integer; null if it isn't one."""
    parts = F.split(ip, r"\.")
    numbers = [F.get(parts, k).try_cast("bigint") for k in range(4)]
    ok = reduce(lambda a, b: a & b, [n.between(0, 255) for n in numbers]) & (F.size(parts) == 4)
    return F.when(ok, reduce(lambda a, b: a * 256 + b, numbers))


def cidr_range(block: str) -> tuple[int, int]:
    base, _, bits = block.partition("/")
    n = reduce(lambda a, b: a * 256 + int(b), base.split("."), 0)
    size = 1 << (32 - int(bits or 32))
    low = n // size * size
    return low, low + size - 1


def in_cidr(ip: Column, block: str) -> Column:
    low, high = cidr_range(block)
    return F.coalesce(address(ip).between(low, high), F.lit(False))


# encryption: base64 of iv, tag and ciphertext, AES-256-GCM with the SHA-256 of the key text


def encrypt(text: Column, key: str, iv: Column | None = None) -> Column:
    hashed = F.unhex(F.sha2(F.lit(key), 256))
    sealed = F.aes_encrypt(text, hashed, F.lit("GCM"), F.lit("DEFAULT"), iv) if iv is not None else F.aes_encrypt(text, hashed, F.lit("GCM"))
    # bound once: without a given iv every mention would seal again, with another one

    def ordered(x: Column) -> Column:  # Spark has iv, ciphertext, tag
        n = F.octet_length(x)
        return F.base64(F.concat(F.substring(x, 1, 12), F.substring(x, n - 15, F.lit(16)), F.substring(x, F.lit(13), n - 28)))

    return F.element_at(F.transform(F.array(sealed), ordered), 1)


def decrypt(sealed: Column, key: str) -> Column:
    def opened(raw: Column) -> Column:
        spark_order = F.concat(F.substring(raw, 1, 12), F.substring(raw, F.lit(29), F.octet_length(raw) - 28), F.substring(raw, 13, 16))
        return F.aes_decrypt(spark_order, F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM")).cast("string")

    return F.element_at(F.transform(F.array(F.unbase64(sealed)), opened), 1)
