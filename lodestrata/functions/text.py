"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code identifiers (calls, scoped packages, PascalCase, camelCase), phrases of a refusal, and the passage
# that stands between the two copies of an expanded query.
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_]*\(\)|@[\w-]+/[\w-]+|\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b|\b[a-z]+(?:[A-Z][a-z0-9]*)+\b"
REFUSALS = ("i can't", "i cannot", "i won't", "as an ai", "i'm not able to")
PASSAGE = "A correct implementation honours the relevant team decisions and the constraints they impose."


def tokens(text: Column) -> Column:
    """Lower-case ASCII words, digits and underscores, in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def cased_tokens(text: Column) -> Column:
    """ASCII words, digits and underscores as they are written, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0))


def wide_tokens(text: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def token_cost(text: Column) -> Column:
    """A text's cost against a budget: a quarter of its characters, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def identifiers(text: Column) -> Column:
    """Distinct code identifiers; calls also without their brackets."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){IDENTIFIER}"), F.lit(0))
    return F.array_distinct(F.concat(found, F.transform(F.filter(found, lambda x: x.endswith("()")), lambda x: F.regexp_replace(x, r"\(\)$", ""))))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def title_of(text: Column) -> Column:
    return F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)


def body_of(text: Column) -> Column:
    """What follows the first line feed; empty without one."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.locate("\n", t) > 0, F.substring(t, F.locate("\n", t) + 1, F.length(t))).otherwise("")


def expanded(query: Column) -> Column:
    """A query as a likely answer: the query, a blank line, the fixed passage and the query again."""
    return F.concat(query, F.lit(f"\n\n{PASSAGE} "), query)


def stripped(text: Column) -> Column:
    """text without white space at either end; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def refuses(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for r in REFUSALS:
        out = out | low.contains(r)
    return out


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def honoured(decision: Column, decision_id: Column, response: Column) -> Column:
    """Whether a response keeps a decision: it has one of the identifiers that the decision's text names; if that names none,
    or there is no such decision, it has the decision's id."""
    names = identifiers(decision)
    return F.when(F.size(names) > 0, F.exists(names, lambda k: F.contains(response, k))).otherwise(F.contains(response, decision_id))


def session_of(dia_id: Column) -> Column:
    """The session number in D<session>:<turn>; anything else is an error."""
    n = F.regexp_extract(dia_id, r"^D(\d+):\d+$", 1)
    return F.when(n != "", n.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a turn id: "), F.coalesce(dia_id, F.lit("null")))).cast("int"))


def corpus_fingerprint(rows: DataFrame, by: str, order: str = "pos", item: str = "item_id", text: str = "text") -> DataFrame:
    """(by, fingerprint): SHA-256 over each group's items in order, id and text closed by a 0 and a 1 byte."""
    one = F.concat(F.encode(F.col(item).cast("string"), "UTF-8"), F.lit(b"\x00"), F.encode(F.coalesce(text, F.lit("")), "UTF-8"), F.lit(b"\x01"))
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("b"))))
    whole = F.aggregate(F.transform(lines, lambda x: x["b"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return rows.groupBy(by).agg(F.sha2(whole, 256).alias("fingerprint"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = add(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = F.sqrt(add(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(add(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def cache_key(fingerprint: Column, budget: Column, query: Column) -> Column:
    """The key of a request: corpus, budget and query."""
    return F.sha2(F.concat_ws("|", fingerprint, budget.cast("string"), query), 256)


def price(tokens_in: Column, tokens_out: Column, per_million_in: Column, per_million_out: Column) -> Column:
    return (tokens_in * per_million_in + tokens_out * per_million_out) / 1_000_000


def request_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
