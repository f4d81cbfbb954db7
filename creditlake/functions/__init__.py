"""Column functions of the credit domain; all stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIRS = [(chr(k), d[0]) for k in range(0xC0, 0x2000) if len(d := "".join(c for c in unicodedata.normalize("NFD", chr(k)) if unicodedata.category(c) != "Mn")) == 1 and d != chr(k)]
# Particles that names drop.
PARTICLES = ["DE", "DU", "DES", "LA", "LE", "EL", "BEN", "BINTI", "BIN", "AL"]


def strip_accents(x: Column) -> Column:
    """Letters without their marks, by a table made from Unicode's canonical decompositions; loose marks go too."""
    return F.regexp_replace(F.translate(x, "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)), r"\p{Mn}", "")


def normal_name(x: Column, particles: list[str] = PARTICLES) -> Column:
    words = F.split(F.regexp_replace(F.upper(strip_accents(x)), r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(particles)), " ")


def full_name(first: Column, second: Column) -> Column:
    """Two names, each in normal form, of which empty ones leave no blank: words are told by blanks, so both at once."""
    return normal_name(F.concat_ws(" ", first, second))


def normal_identifier(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"(?U)[\s-]", "")


def phonetic_key(x: Column) -> Column:
    """PH as F, Q and C as K; the first letter stays, later vowels go and repeats among the rest collapse."""
    k = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "PH", "F"), "Q", "K"), "C", "K")
    return F.concat(F.substring(k, 1, 1), F.regexp_replace(F.regexp_replace(F.substring(k, 2, 1 << 30), "[AEIOUY]", ""), r"(.)\1+", "$1"))


def strict_date(x: Column) -> Column:
    """A date written year-month-day, with or without its hyphens; else null."""
    dashed = F.when(x.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(x, "yyyy-MM-dd"))
    return F.coalesce(dashed, F.when(x.rlike(r"\A\d{8}\z"), F.try_to_date(x, "yyyyMMdd")))


def _bare(x: Column) -> Column:
    """Without blanks around it and without single underscores between digits."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\A\s+|\s+\z", ""), r"(?<=\d)_(?=\d)", "")


def strict_number(x: Column) -> Column:
    """A decimal number, with an exponent or not, infinite or NaN; else null."""
    v = F.lower(_bare(x))
    return F.when(v.rlike(r"\A[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\z"), F.regexp_replace(v, r"\A[+-](?=nan)", "").try_cast("double"))


def strict_int(x: Column) -> Column:
    v = _bare(x)
    return F.when(v.rlike(r"\A[+-]?\d+\z"), v.try_cast("long"))


def blank(x: Column) -> Column:
    return ~F.coalesce(x, F.lit("")).rlike(r"(?U)\S")


def arrears_class(days: Column) -> Column:
    return F.when(days == 0, "sain").when(days <= 30, "sensible").when(days <= 90, "douteux").when(days > 90, "contentieux")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def block_keys(identifier: Column, name: Column, birth: Column) -> Column:
    """The different keys under which a record is compared: its identifier, birth date and initial, sound and birth year."""
    word = F.split_part(name, F.lit(" "), F.lit(1))
    full = (word != "") & (birth != "")
    keys = F.array(F.when(identifier != "", F.concat(F.lit("PIECE:"), identifier)), F.when(full, F.concat(F.lit("NAISS:"), birth, F.lit(":"), F.substring(word, 1, 1))), F.when(full, F.concat(F.lit("PHON:"), phonetic_key(word), F.lit(":"), F.substring(birth, 1, 4))))
    return F.array_distinct(F.array_compact(keys))


def token_sort_similarity(a: Column, b: Column) -> Column:
    """Indel similarity, 0 to 100, of two names with their words sorted: 200 * LCS / (length + length), by rows of the LCS
    table, each of which is one array that is made once."""
    a, b = (F.array_join(F.array_sort(F.split(x, " ")), " ") for x in (a, b))
    letters = F.split(b, "")

    def row(before: Column, letter: Column) -> Column:
        def cell(out: Column, j: Column) -> Column:
            here = F.when(F.get(letters, j) == letter, F.get(before, j) + 1).otherwise(F.get(before, j + 1))
            return F.concat(out, F.array(F.greatest(F.element_at(out, -1), here)))

        return F.aggregate(F.sequence(F.lit(0), F.length(b) - 1), F.array(F.lit(0)), cell)

    lcs = F.element_at(F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), F.length(b) + 1), row), -1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 100.0).otherwise(F.lit(200.0) * lcs / (F.length(a) + F.length(b)))


def letter_bag(x: Column) -> Column:
    """(mask, over): two bits for each of 32 classes of letters, that one and that two are there, and how many more letters."""

    def add(bag: Column, letter: Column) -> Column:
        one = F.element_at(bits, F.pmod(F.ascii(letter), F.lit(32)) + 1)
        two = F.element_at(bits, F.pmod(F.ascii(letter), F.lit(32)) + 33)
        mask, over = bag["mask"], bag["over"]
        free = F.when(mask.bitwiseAND(one) == 0, one).when(mask.bitwiseAND(two) == 0, two).otherwise(F.lit(0).cast("long"))
        return F.struct(mask.bitwiseOR(free).alias("mask"), (over + F.when(free == 0, 1).otherwise(0)).alias("over"))

    bits = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    return F.aggregate(F.split(x, ""), F.struct(F.lit(0).cast("long").alias("mask"), F.lit(0).alias("over")), add)


def most_alike(a: Column, bag_a: Column, b: Column, bag_b: Column, least: int) -> Column:
    """Whether two names that aren't empty can have a token_sort_similarity of `least`: no common subsequence has more
    letters than both bags share."""
    shared = F.bit_count(bag_a["mask"].bitwiseAND(bag_b["mask"])) + F.least(bag_a["over"], bag_b["over"])
    return (F.length(a) > 0) & (F.length(b) > 0) & (200 * shared >= least * (F.length(a) + F.length(b)))
