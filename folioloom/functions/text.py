"""Content columns: classification, decoding, counting, cleaning, line numbering.

Everything is a built-in expression. Whitespace means Unicode White_Space; plain `\\s` is ASCII-only in Java.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters.
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
                    + "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regex; several times faster than the characters spelled out in a class.
_WORD = r"(?U)\S++"

HEAD_BYTES = 1024          # what a dry run looks at, and how far a NUL byte is searched for
MIN_NUMBER_WIDTH = 5

# Kept as group 1: a run without quotes or slashes, a string or character literal, a lone slash. Dropped: a line comment,
# a block comment. Some branch matches at every position and the quantifiers are possessive, so the pass is linear and
# needs no backtracking stack, even for megabyte-long literals.
_KEPT_OR_COMMENT = (
    r'''(?s)([^"'/]++|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z)|/(?![/*]))'''
    r'''|//[^\n]*+|/\*.*?(?:\*/|\z)'''
)


def is_text(content: Column) -> Column:
    """UTF-8 text test on raw bytes: a BOM is trusted; else no NUL early on, no PDF mark, and valid UTF-8."""
    def test(raw: Column) -> Column:
        return F.startswith(raw, F.lit(b"\xef\xbb\xbf")) | (
            ~F.contains(F.substring(raw, 1, HEAD_BYTES), F.lit(b"\x00"))
            & ~F.startswith(raw, F.lit(b"%PDF"))
            & F.is_valid_utf8(raw.cast("string"))
        )

    # Bound once: a pushed-down filter would otherwise repeat the expression behind the content in each of the tests.
    return F.exists(F.array(content.cast("binary")), test)


def is_text_head(content: Column) -> Column:
    """`is_text` of the first 1024 bytes only, as a dry run sees the file."""
    return is_text(F.substring(content.cast("binary"), 1, HEAD_BYTES))


def decode(content: Column) -> Column:
    """Lossy UTF-8: every maximal bad run becomes U+FFFD, a BOM stays."""
    return F.make_valid_utf8(content.cast("string"))


def newlines(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def line_count(text: Column) -> Column:
    """A final line without newline counts too."""
    open_end = (text != "") & ~F.endswith(text, F.lit("\n"))
    return (newlines(text) + open_end.cast("int")).cast("bigint")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD)).cast("bigint")


def begins_with_word(text: Column) -> Column:
    return text.rlike(r"(?U)\A\S")


def ends_in_word(text: Column) -> Column:
    return text.rlike(r"(?U)\S\z")


def counts(text: Column) -> Column:
    """Lines, bytes (named `characters`) and words of text."""
    return F.struct(
        line_count(text).alias("lines"),
        F.octet_length(text).cast("bigint").alias("characters"),
        word_count(text).alias("words"),
    )


def binary_counts(content: Column) -> Column:
    return F.struct(
        F.lit(0).cast("bigint").alias("lines"),
        F.octet_length(content).cast("bigint").alias("characters"),
        F.lit(0).cast("bigint").alias("words"),
    )


def remove_comments(text: Column) -> Column:
    """Drop `//` and `/* */` comments outside literals, right-trim lines, trim outer newlines."""
    # Without a comment mark the first pass would only put everything back, so plain prose skips it.
    marked = F.contains(text, F.lit("//")) | F.contains(text, F.lit("/*"))
    bare = F.when(marked, F.regexp_replace(text, F.lit(_KEPT_OR_COMMENT), F.lit("$1"))).otherwise(text)
    trimmed = F.transform(F.split(bare, "\n", -1), lambda line: F.rtrim(line, F.lit(WHITESPACE_CHARS)))
    return F.btrim(F.array_join(trimmed, "\n"), F.lit("\r\n"))


def remove_empty_lines(text: Column) -> Column:
    """Drop whitespace-only lines; the rest is joined by `\\n` without a final newline."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.array_join(F.filter(lines, lambda line: F.btrim(line, F.lit(WHITESPACE_CHARS)) != ""), "\n")


def lines(text: Column) -> Column:
    """Lines without their ends; no empty last line."""
    unified = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    body = F.when(F.endswith(unified, F.lit("\n")), F.substr(unified, F.lit(1), F.length(unified) - 1)).otherwise(unified)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def terminated(text: Column) -> Column:
    """The lines of the text, each ended by one newline (`''` stays `''`)."""
    ended = (text == "") | F.endswith(text, F.lit("\n"))
    return F.concat(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.when(ended, "").otherwise("\n"))


def numbered(text: Column) -> Column:
    """`terminated` with right-aligned line numbers; the width grows past five digits with the line count."""
    parts = lines(text)

    def joined(lines_: Column, width) -> Column:
        each = F.transform(lines_, lambda line, i: F.concat(
            F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(" | "), line, F.lit("\n")))
        return F.array_join(each, "")

    # Wider numbers: lines and width are bound once through a one-element array; inside the lambda over the lines they
    # would be evaluated for each of them.
    wide = F.array(F.struct(parts.alias("parts"), F.length(F.size(parts).cast("string")).alias("width")))
    wide = F.element_at(F.transform(wide, lambda b: joined(b["parts"], b["width"])), 1)
    return F.when(line_count(text) < 10**MIN_NUMBER_WIDTH, joined(parts, F.lit(MIN_NUMBER_WIDTH))).otherwise(wide)
