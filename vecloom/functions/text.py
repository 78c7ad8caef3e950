"""Text columns: blankness, tokens, hashed lexical terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a string strip removes (Unicode white space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# A token is a run of letters, digits and underscores; terms live in a 31-bit space.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
HASH_SPACE = 2**31 - 1


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only strings; never null."""
    return F.coalesce(strip(text) == "", F.lit(True))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    Catalyst may copy an expression into every lambda that mentions it; a lambda variable cannot be copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """All tokens in order, lower-cased; null has none.

    Lower-casing the whole text first is several times cheaper than token by token, and the same unless the
    text holds one of the two letters whose lower case depends on, or changes, what stands around them.
    """
    text = F.coalesce(text, F.lit(""))

    def found(source: Column) -> Column:
        return F.regexp_extract_all(source, F.lit(TOKEN_PATTERN), F.lit(0))

    special = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u03a3"))
    return F.when(special, F.transform(found(text), F.lower)).otherwise(found(F.lower(text)))


def term_index(token: Column) -> Column:
    """The first 32 bits of the token's MD5, folded into the term space."""
    head = F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10)
    return (head.cast("bigint") % F.lit(HASH_SPACE)).cast("int")


def term_weight(tf: Column, length: Column) -> Column:
    return F.floor(tf / length * (1 + F.log1p(tf)) * 1e6 + 0.5) / 1e6


def sparse_terms(text: Column) -> Column:
    """The sparse vector of a text: ``struct<indices array<int>, values array<double>>``.

    Everything happens inside the row: indices are sorted once and equal ones form runs, so no
    token is ever exploded or shuffled.  Tokens that share an index add up.  A text without tokens
    has two empty arrays.
    """

    def from_sorted(ordered: Column) -> Column:
        length = F.size(ordered)
        starts = F.filter(
            # ``sequence(0, -1)`` would count down, so an empty list is kept away from it.
            F.when(length > 0, F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )

        def from_runs(first: Column) -> Column:
            ends = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(length))
            counts = F.zip_with(first, ends, lambda a, b: b - a)
            counts = F.when(length > 0, counts).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.transform(first, lambda p: F.get(ordered, p)).alias("indices"),
                F.transform(counts, lambda tf: term_weight(tf.cast("double"), length)).alias("values"),
            )

        return bind(starts, from_runs)

    return bind(F.sort_array(F.transform(tokens(text), term_index)), from_sorted)


def sparse_or_null(text: Column) -> Column:
    """Sparse vector of a text; null where the text is blank or has no token."""
    return bind(sparse_terms(text), lambda s: F.when(F.size(s.getField("indices")) > 0, s))
