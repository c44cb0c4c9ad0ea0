"""Fill-in-middle by escaped marker injection, in SQL functions alone [operator 11].

A delimiter that cannot occur in the escaped text is put after each unit; its count is the number of units, and
``substring_index`` takes the parts up to a rank. The parts are freed of delimiters, unescaped and put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: the markers of the three parts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: the delimiter after each unit, and the character that begins an escape
_END, _ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """The text without delimiters: each escape character and delimiter becomes a pair of characters."""
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_END), F.lit(_ESCAPE + "d"))


def unescaped(part: Column) -> Column:
    """Text of a stretch of units: delimiters go, then the pairs become characters again."""
    bare = F.replace(part, F.lit(_END), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + "d"), F.lit(_END)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with the delimiter after each code point (an escaped one counts as one)."""
    return F.regexp_replace(escaped(text), F.lit(f"(?s){_ESCAPE}?."), F.lit(f"$0{_END}"))


def n_units(units: Column) -> Column:
    return F.length(units) - F.length(F.replace(units, F.lit(_END), F.lit("")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from its markers; they cannot arise across the borders of parts."""
    # of prefix, suffix and middle, in the order in which they stand behind their markers
    body = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    last = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(body(PREFIX, SUFFIX), last, body(SUFFIX, MIDDLE))
    spm = F.concat(body(PREFIX, MIDDLE), last, body(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, rate: int = 90, suffix_first: int = 20) -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars, output`` of each document.

    Numbers h1 to h4 are the first four 8-digit groups of the hex SHA-256 of ``1:`` and the id. ``rate`` of a hundred
    documents are transformed, ``suffix_first`` of a hundred of those with the suffix first (``spm``). The prefix ends
    after the smaller of h1 % (n + 1) and h2 % (n + 1) code points, the middle after the larger. Empty and null texts, texts that hold
    a marker, and rows without an id (they have no numbers) stay plain, with null lengths of the parts. Repeated rows each give a row,
    extra columns go, an empty table gives no rows. A text is held about three times while it is cut, whatever its length.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    h = lambda k: F.conv(F.substring(F.col("digest"), 8 * k - 7, 8), 16, 10).cast("long")
    holds = F.contains(F.col("text"), F.lit(PREFIX)) | F.contains(F.col("text"), F.lit(SUFFIX)) | F.contains(F.col("text"), F.lit(MIDDLE))
    plain = (F.col("text") == "") | holds | F.col("doc_id").isNull() | (h(3) % 100 >= rate)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", digest).withColumn("form", F.when(plain, "plain").when(h(4) % 100 < suffix_first, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    rows = rows.withColumn("units", F.when(cut, marked(F.col("text")))).withColumn("n", F.when(cut, n_units(F.col("units"))).otherwise(F.length("text")).cast("long"))
    one, two = h(1) % (F.col("n") + 1), h(2) % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "form", "units", "n", F.when(cut, F.least(one, two)).alias("a"), F.when(cut, F.greatest(one, two)).alias("b"))
    index = lambda text, count: F.call_function("substring_index", text, F.lit(_END), count.cast("int"))
    head = index(F.col("units"), F.col("b"))
    parts = rows.select(
        "doc_id", "text", "form", "n", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"),
        unescaped(index(F.col("units"), F.col("a"))).alias("prefix"),
        unescaped(index(head, F.col("a") - F.col("b"))).alias("middle"),
        unescaped(index(F.col("units"), F.col("b") - F.col("n") - 1)).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return parts.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))


def fim_digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with SHA-256 of each output and of the text restored from it, in their places."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
