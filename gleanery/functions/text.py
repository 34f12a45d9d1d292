"""Text functions as Column expressions; all run inside the JVM but ``nfkc``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no meaning for matching.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "which", "with"]
BLANK = r"[\x00-\x20\x7f]+"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no built-in; ASCII texts don't need it."""
    return texts.str.normalize("NFKC")


def normalize(text: Column) -> Column:
    """Lower case, white space and control characters to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), BLANK, " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


#: For texts as UTF-8: lower-case letters and digits, and a blank for every other byte; the second one keeps hyphens and line ends too.
WORD_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
LINE_BYTES = bytes(c if c in b"-\n" else WORD_BYTES[c] for c in range(256))
#: The two characters beyond ASCII whose lower case has an ASCII letter.
ODD_CAPITALS = [("\u212a".encode(), b"k"), ("\u0130".encode(), b"i ")]


def content_tokens(text: Column) -> Column:
    """Tokens longer than one character that are no stop words, or all tokens if none is left."""
    kept = F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens(text))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def jaccard(left: Column, right: Column) -> Column:
    either = F.size(F.array_union(left, right))
    return F.when(either > 0, F.size(F.array_intersect(left, right)) / either).otherwise(0.0)


def containment(left: Column, right: Column) -> Column:
    own = F.size(F.array_distinct(left))
    return F.when(own > 0, F.size(F.array_intersect(left, right)) / own).otherwise(0.0)


def around(text: Column, place: Column, reach: int) -> Column:
    """Characters up to ``reach`` on both sides of a 1-based place."""
    first = F.greatest(place - reach, F.lit(1))
    return F.substring(text, first, place + reach - first + 1)


def flexible_pattern(text: Column, n: int) -> Column:
    """A pattern of the first ``n`` tokens with anything but letters and digits between them."""
    return F.concat(F.lit("(?i)"), F.array_join(F.slice(tokens(text), 1, n), "[^a-zA-Z0-9]+"))


def strip_heading_number(text: Column) -> Column:
    return F.regexp_replace(text, r"^[0-9.]+\s+", "")


def base_object_id(object_id: Column) -> Column:
    return F.regexp_replace(object_id, r"_s[0-9]+$", "")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(left: Column, right: Column) -> Column:
    """0 for lengths that differ or a zero norm."""
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when((F.size(left) != F.size(right)) | (norm == 0), 0.0).otherwise(dot(left, right) / norm)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def saturate(x: Column, half: float) -> Column:
    return x / (x + half)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    union = area(a) + area(b) - width * height
    return F.when(union > 0, width * height / union).otherwise(0.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; (0, 1) for none."""
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), middle + half))
