"""Column functions over text: trimming, slugs, search predicates, path parts, extracted references, ordered rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(text: Column, most: int = 400) -> Column:
    """White space as single spaces, none at either end, at most so many characters; null stays null."""
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(most))


def blank(x: Column) -> Column:
    return x.isNull() | (x == "")


def filled(x: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(x, F.lit(""))


def slug(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def tokens(query: str) -> list[str]:
    return query.lower().split()


def matches(text: Column, query: str) -> Column:
    """All words of the query occur in the text, whatever the case."""
    return reduce(lambda a, b: a & b, (F.contains(F.lower(text), F.lit(t)) for t in tokens(query)), F.lit(True))


def haystack(*fields: Column) -> Column:
    """What a search looks through: the fields in lower case, two spaces between."""
    return F.lower(F.concat_ws("  ", *fields))


def basename(path: Column, ext: str = "") -> Column:
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, ext.replace(".", r"\.") + "$", "") if ext else name


def dirname(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def extension(path: Column) -> Column:
    """The last dot of the name and what follows; empty if the name has none but the first."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first rule that holds."""
    out = None
    for test, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def mentions(text: Column, pattern: str) -> Column:
    """What the pattern's group captures, each once, in order; none of a null text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1))


#: References within expressions and texts (fixed values).
NODE_REFERENCE = r"\$context\.\$nodes\.([A-Za-z0-9_]+)\."
CONTEXT_REFERENCE = r"\$context\.\$app\.\$([A-Za-z0-9_]+)"
CAPITAL_TOKEN = r"\b([A-Z][A-Z0-9_]{2,})\b"
QUOTED_TOKEN = r"`([a-z][a-z0-9-]+)`"
QUOTED_NOTE = r"`([a-z0-9-]+(?:/[a-z0-9-]+)?\.md)`"
DECLARED_TYPE = r"`([A-Z][A-Z0-9_]*)`"


def significant(x: Column, digits: int) -> Column:
    """A number of so many significant digits, rounded by its exact binary value, ties away from zero; beyond the usual range by its decimal form. Null stays null."""
    a = F.abs(x.cast("double"))
    k = F.floor(F.log10(a)) - (digits - 1)
    low, high = F.pow(F.lit(10.0), F.greatest(-k, F.lit(0))), F.pow(F.lit(10.0), F.greatest(k, F.lit(0)))
    y = a * low / high
    tie = F.floor(y) + F.lit(0.5)
    # What rounding hid of the product decides where it looks like a tie.
    head = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    tail = lambda v: v - head(v)
    hidden = head(a) * head(low) - a * low + head(a) * tail(low) + tail(a) * head(low) + tail(a) * tail(low)
    less = (y < tie) | ((y == tie) & F.when(k > 0, a < tie * high).otherwise(hidden < 0))
    n = F.floor(y) + F.when(less, 0).otherwise(1)
    return F.when(a.between(1e-15, 1e15), F.signum(x.cast("double")) * n * high / low).when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x).cast("double"))


def short_number(x: Column) -> Column:
    """As text; small positive numbers with an exponent."""
    return F.when((x > 0) & (x < 0.01), F.regexp_replace(F.format_string("%.2e", x), "e([+-])0", "e$1")).otherwise(x.cast("string"))


def front_matter(text: Column) -> Column:
    """The map between the first two lines of dashes: each line up to its first colon and what follows it."""
    lines = F.split(F.regexp_extract(text, r"^---\n([\s\S]*?)\n---", 1), "\n")
    at = F.filter(lines, lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(at, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def spans(text: Column, query: str) -> Column:
    """Array of (lo, hi): where the query's words stand in the text, whatever the case; a span that begins within an earlier one is left out."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))

    def of(word: str) -> Column:
        at = F.transform(places, lambda i: F.when(F.substr(low, i, F.lit(len(word))) == word, F.struct((i - 1).alias("lo"), (i - 1 + len(word)).alias("hi"))))
        return F.filter(at, lambda x: x.isNotNull())

    found = [of(t) for t in tokens(query)]
    if not found:
        return F.array().cast("array<struct<lo:int,hi:int>>")
    every = F.array_sort(F.concat(*found))
    start = F.array().cast("array<struct<lo:int,hi:int>>")
    return F.aggregate(every, start, lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(x["lo"] >= F.element_at(acc, -1)["hi"], F.concat(acc, F.array(x))).otherwise(acc))
