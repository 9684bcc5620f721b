"""Tokenizer and padding as JVM-side column expressions. Bytes above ASCII are left alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = "[!-/:-@\\[-`{-~]"
_MARKS = "".join(chr(k) for k in range(33, 127) if not chr(k).isalnum())
SPACE = "[ \\t\\n\\x0B\\f\\r]+"

#: 127 English stopwords
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can did do does doing don down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will with
you your yours yourself yourselves
""".split()


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION, " ")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column) -> Column:
    """Words between ASCII white space, without empty ones."""
    return F.array_remove(F.split(c, SPACE), "")


def tokens(c: Column) -> Column:
    """As split_words(ascii_lower(strip_punctuation(c))), in one pass over the characters."""
    return split_words(F.translate(c, _MARKS + UPPER, " " * len(_MARKS) + LOWER))


def pad(content: Column, width: Column) -> Column:
    return F.rpad(content, width, F.lit(" "))


def unpad(content: Column) -> Column:
    """Up to the first space."""
    return F.substring_index(content, " ", 1)


def strip_id(line: Column) -> Column:
    """A line without its first word, the others joined by one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), "^\\S+\\s*", ""), "\\s+", " "))
