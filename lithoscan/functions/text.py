"""Name matching as column expressions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators, and the gaps inside camel case.
WORD_GAPS = r"(?U)[_.\-\s]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def split_words(text: Column) -> Column:
    """Words of an identifier: ``JobDriver_WaitXMLNode`` has Job, Driver, Wait, XML and Node."""
    return F.filter(F.split(text, WORD_GAPS), lambda w: w != "")


def initials(text: Column) -> Column:
    return F.array_join(F.transform(split_words(text), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def ngrams(text: Column, n: int = 2, most: int = 50) -> Column:
    """Lower-cased n-grams at the first ``most`` positions; none if the text is shorter than ``n``."""
    low, last = F.lower(text), F.length(text) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.least(last, F.lit(most)), F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def marked_words(text: Column) -> Column:
    """The words of an identifier, each behind a NUL: what word rules search, without arrays."""
    return F.concat(F.lit("\0"), F.regexp_replace(text, WORD_GAPS, "\0"))


def with_fuzzy_score(rows: DataFrame, text: Column, query: Column | str, name: str = "score", words: Column | None = None) -> DataFrame:
    """``rows`` and how well ``query`` matches ``text``, 0 to 100; the first rule that holds counts.

    Exact 100; prefix 90; a typo or two 85 to 95; initials 85 or 75; start of a
    word 80; similar at 0.75 or 0.6; part of the text 30 to 50.

    What several rules ask for is projected first, so each row computes it once;
    ``words`` are those of :func:`marked_words`, where they are known already."""
    columns = rows.columns
    rows = rows.withColumns({"_fz_text": text, "_fz_query": as_column(query), "_fz_words": marked_words(text) if words is None else words})
    rows = rows.withColumns({"_fz_low": F.lower("_fz_text"), "_fz_asked": F.lower("_fz_query")})
    rows = rows.withColumns({"_fz_d": F.levenshtein(F.col("_fz_low"), F.col("_fz_asked")), "_fz_at": F.instr(F.col("_fz_low"), F.col("_fz_asked")) - 1})
    low, lowq, words, d, at = (F.col(f"_fz_{c}") for c in ("low", "asked", "words", "d", "at"))
    n, m = F.length("_fz_query"), F.length("_fz_text")
    alike = F.lit(1.0) - d / F.greatest(m, n)
    typo = F.least(F.lit(95.0), 95.0 - 5.0 * d + F.when(F.abs(m - n) <= 1, 3.0).otherwise(0.0))
    part = F.greatest(F.lit(30.0), F.least(F.lit(50.0), 50.0 - at * 2.0 / m * 10.0 + n * 1.0 / m * 10.0))
    firsts = F.lower(F.upper(F.regexp_replace(words, "\0+([^\0]?)[^\0]*", "$1")))
    score = (
        F.when(low.isNull() | lowq.isNull() | (m == 0) | (n == 0), 0.0)
        .when(low == lowq, 100.0)
        .when(F.startswith(low, lowq), 90.0)
        .when((d <= 2) & (d <= n * F.when(n <= 4, 0.5).otherwise(0.3)), typo)
        .when(F.startswith(firsts, lowq), F.when(n <= 5, 85.0).otherwise(75.0))
        .when(F.contains(F.lower(words), F.concat(F.lit("\0"), lowq)), 80.0)
        .when((d <= 3) & (alike >= 0.75), 70.0 * alike)
        .when(alike >= 0.6, 55.0 * alike)
        .when(at >= 0, part)
        .otherwise(0.0)
    )
    return rows.select(*columns, score.alias(name))


def clipped(text: Column, most: int = 100) -> Column:
    """Trimmed; longer than ``most`` characters: the first ``most - 3`` and ``...``."""
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def lines_of(content: Column) -> Column:
    """Lines without a last empty one."""
    lines = F.split(content, r"\r\n|\n|\r")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def whole_word(symbol: str) -> str:
    """A Java pattern of the symbol as a whole word, in any case."""
    return r"(?iU)\b" + "".join(c if c.isalnum() or c == "_" else "\\" + c for c in symbol) + r"\b"
