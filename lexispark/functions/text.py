"""Text functions as column expressions: tokens, sentences, windows, cleaning, keys, distances, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that part words. Fixed value.
SPLIT = r"""[,.:;?!(){}\[\]"'\s]+"""
FRAGMENT = r"""[,.:;?!(){}\[\]"']"""


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Words of a text in lower case, in order."""
    return F.filter(F.split(F.lower(col(text)), SPLIT), lambda w: w != "")


def token_fragments(text) -> Column:
    """Words by fragment between punctuation marks."""
    return F.transform(F.split(F.lower(col(text)), FRAGMENT), lambda s: F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != ""))


def split_punctuation(text) -> Column:
    """Runs of punctuation and runs of anything else, in order."""
    return F.regexp_extract_all(col(text), F.lit(r"(\p{Punct}+|[^\p{Punct}]+)"), F.lit(1))


def sentences(text) -> Column:
    """Sentences, parted after . ! or ? and white space."""
    return F.filter(F.split(col(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def sentence_parts(text) -> Column:
    """Text between sentence marks."""
    return F.split(col(text), r"[.?!]")


def term_size(term) -> Column:
    """Words of a term: one more than its spaces."""
    return F.length(col(term)) - F.length(F.replace(col(term), F.lit(" "), F.lit(""))) + 1


def clip_term(term) -> Column:
    return F.substring(col(term), 1, 255)


def text_and_count(term) -> Column:
    t = F.trim(col(term))
    return F.struct(t.alias("term"), term_size(t).alias("n"))


def letters_only(text) -> Column:
    return F.lower(F.regexp_replace(col(text), r"[^\p{L}]", ""))


def identity_hash(*parts) -> Column:
    """sha256 of the parts' letters in lower case; null parts count as empty."""
    return F.sha2(F.concat(*[F.coalesce(letters_only(p), F.lit("")) for p in parts]), 256)


def text_hash(text) -> Column:
    return F.sha2(col(text), 256)


def set_hash(items) -> Column:
    """A hash that doesn't depend on the order of the items: of the sorted items' own hashes."""
    return F.sha2(F.array_join(F.array_sort(F.transform(col(items), lambda x: F.sha2(x, 256))), ""), 256)


def clean_bytes(text) -> Column:
    """Typographic apostrophes straight; carriage returns and tabs as spaces; semicolons as full stops."""
    return F.translate(col(text), "’\r\t;", "'  .")


def clean_for_tagging(text) -> Column:
    """Without addresses of the web and digit-hyphen-digit runs; white space collapsed."""
    x = F.regexp_replace(col(text), r"(https?://|www\.)\S+", "")
    x = F.regexp_replace(x, r"\d+(-\d+)+", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def drop_long_words(text, longest: int = 25) -> Column:
    return F.array_join(F.filter(F.split(col(text), r"\s+"), lambda w: F.length(w) < longest), " ")


def paragraphs(text) -> Column:
    """Lines merged until a blank line."""
    return F.transform(F.filter(F.split(col(text), r"\n\s*\n"), lambda p: F.trim(p) != ""), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))


def blocks_of(items, size: int) -> Column:
    """Consecutive blocks of `size` items; the last can be shorter."""
    x = col(items)
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x), F.lit(size)), lambda i: F.slice(x, i, size))).otherwise(F.array().cast("array<array<string>>"))


def windows_of(items, size: int, step: int) -> Column:
    """Windows of `size` items that begin every `step` items; those at the end can be shorter."""
    x = col(items)
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x), F.lit(step)), lambda i: F.slice(x, i, size))).otherwise(F.array().cast("array<array<string>>"))


def titled_paragraphs(text, n: int = 7) -> Column:
    """Windows of n and half of n sentences at a step of n; the first sentence is the title."""
    return F.transform(windows_of(sentences(text), n + round(n / 2), n), lambda w: F.struct(F.get(w, F.lit(0)).alias("title"), F.array_join(F.slice(w, 2, n * 2), " ").alias("text")))


def char_windows(text, n: int) -> Column:
    """All runs of n + 1 characters."""
    t = col(text)
    return F.when(F.length(t) > n, F.transform(F.sequence(F.lit(1), F.length(t) - n), lambda i: F.substring(t, i, F.lit(n + 1)))).otherwise(F.array().cast("array<string>"))


def ngrams_of(words, n: int) -> Column:
    """All runs of n words as arrays."""
    x = col(words)
    return F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - (n - 1)), lambda i: F.slice(x, i, n))).otherwise(F.array().cast("array<array<string>>"))


def levenshtein_norm(a, b) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    a, b = col(a), col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def hamming(a, b) -> Column:
    """Places that differ; null for texts of unequal length."""
    a, b = col(a), col(b)
    return F.when(F.length(a) == F.length(b), F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d)))


def _shared_chars(a: Column, b: Column) -> Column:
    """Size of the multiset of shared characters."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0), lambda acc, c: acc + F.least(count(a, c), count(b, c)))


def overlap_coefficient(a, b) -> Column:
    """Shared characters (with repeats) over the shorter length; 1 where that is 0."""
    a, b = col(a), col(b)
    shortest = F.least(F.length(a), F.length(b))
    return F.when(shortest == 0, 1.0).otherwise(_shared_chars(a, b) / shortest)


def char_jaccard(a, b) -> Column:
    """Shared characters over all characters, with repeats; 1 for two empty texts."""
    a, b = col(a), col(b)
    shared = _shared_chars(a, b)
    union = F.length(a) + F.length(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def author_split(text, source) -> Column:
    """Authors or institutes of a field: parted by "; " in records of WOS, else by ", "."""
    return F.when(col(source) == "WOS", F.split(col(text), "; ")).otherwise(F.split(col(text), ", "))


def contact_name(first, last) -> Column:
    return F.concat_ws(" ", F.initcap(col(first)), F.initcap(col(last)))


def int_or_decimal(text) -> Column:
    """An integer, or the floor of a decimal number; null for anything else."""
    return F.floor(col(text).try_cast("double")).cast("int")


def file_date(text) -> Column:
    """The first token as an ISO date, or the first of January of a year; null otherwise."""
    t = F.trim(col(text))
    return F.coalesce(F.to_timestamp(F.split(t, " ")[0].try_cast("date")), F.to_timestamp(F.concat(F.regexp_extract(t, r"^(\d{4})$", 1), F.lit("-01-01")).try_cast("date")))
