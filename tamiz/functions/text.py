"""Text columns: Unicode trim, normalisation, tokens with bigrams, category values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a class that Java and RE2 read alike.
SPACE = r"[\t\n\x0B\f\r \x{85}\p{Z}]"

# Accented letters that tokens and categories fold to plain lower-case ones.
ACCENTED = "áéíóúÁÉÍÓÚàèìòùÀÈÌÒÙäëïöüÄËÏÖÜñÑ"
PLAIN = "aeiouaeiouaeiouaeiouaeiouaeiounn"


def trim_unicode(c: Column) -> Column:
    """Without white space of any kind at the ends (the built-in trim only takes blanks)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def cell(c: Column) -> Column:
    """A trimmed cell; a missing one is empty."""
    return F.coalesce(trim_unicode(c.cast("string")), F.lit(""))


def normalize(c: Column) -> Column:
    """Accents folded, lower case, everything but letters and digits one blank. Null stays null."""
    folded = F.lower(F.translate(c, ACCENTED, PLAIN))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{Nd}]+", " "))


def tokens(c: Column, bigrams: bool = False) -> Column:
    """Words of the normalised text; with ``bigrams``, the pairs of neighbours follow all words. Null gives no tokens."""
    words = F.filter(F.split(F.coalesce(normalize(c), F.lit("")), " "), lambda x: x != "")
    if not bigrams:
        return words
    # the words are bound to a name: an expression inside a lambda would be worked out again per element
    both = lambda w: F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit("_"), y)))
    return F.element_at(F.transform(F.array(words), both), 1)


def category(c: Column) -> Column:
    """Trimmed, lower case, accents folded, inner white space one blank; missing is empty."""
    folded = F.translate(F.lower(cell(c)), ACCENTED, PLAIN)
    return F.regexp_replace(folded, f"{SPACE}+", " ")
