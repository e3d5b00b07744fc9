"""Rewards of written answers as column functions: how they are built, and how well their points are supported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of a header line (its name in a group), a bullet (its text in a group), a quotation, a source.
HEADER = r"(?m)^[^\S\n]*#{1,6}[^\S\n]+([^\n]*)$"
BULLET = r"(?s)^\s*[-*○•]\s+(.*)"
QUOTE = r"(^|[^*])\*[^*]+\*([^*]|$)"
SOURCE = r"`[^`]+`"
WORD = r"[^\x09-\x0D\x20]+"


def sections(text: Column) -> Column:
    """The sections of a text in order as structs (name, body): what follows a header, up to the next one. Null: none.

    Sections named think and those with conclusion or decision in their names are left out.
    """
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "??"), HEADER, "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01", -1), lambda x, i: i > 0)
    named = F.transform(parts, lambda x: F.struct(F.lower(F.btrim(F.substring_index(x, "\x02", 1))).alias("name"), F.get(F.split(x, "\x02", 2), F.lit(1)).alias("body")))
    return F.filter(named, lambda s: (s["name"] != "think") & ~s["name"].contains("conclusion") & ~s["name"].contains("decision"))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def once(x: Column, f) -> Column:
    """f(x), with x evaluated once however often f names it."""
    return F.transform(F.array(x), f)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def harmonic(values: Column) -> Column:
    """The harmonic mean, with values under 0.01 taken as that; 0 of nothing."""
    return once(values, lambda v: F.when(F.size(v) > 0, F.size(v) / total(F.transform(v, lambda x: 1 / F.greatest(x, F.lit(0.01))))).otherwise(0.0))


def structure_reward(text: Column) -> Column:
    """0.6 for the number of sections, best from 5 to 7, and 0.4 for what a mean section of 50 words or more holds."""

    def built(s: Column) -> Column:
        has = ((0.3, s["body"].rlike(r"(?m)^\s*#{1,6}\s")), (0.4, s["body"].rlike(r"(?m)^\s*[-*○•]\s")), (0.2, s["body"].contains("**")), (0.1, s["body"].contains("|")))
        return F.when(words(s["body"]) < 50, 0.2).otherwise(sum(F.lit(v) * c.cast("double") for v, c in has))

    def score(found: Column) -> Column:
        n = F.size(found)
        count = F.when(n < 5, F.greatest(F.lit(0.3), n / 5 * 0.7)).when(n <= 7, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - 0.15 * (n - 7)))
        return F.when(n > 0, 0.6 * count + 0.4 * total(F.transform(found, built)) / n).otherwise(0.0)

    return once(sections(text), score)


def evidence_reward(text: Column) -> Column:
    """The harmonic mean over sections with bullets: their number, best from 4 to 7, and each one's opinion, quotation and source."""

    def bullet(b: Column) -> Column:
        return once(F.struct(b.rlike(QUOTE).alias("quote"), b.rlike(SOURCE).alias("source"), words(F.substring_index(b, "*", 1)).alias("n")), marks)

    def marks(m: Column) -> Column:
        quote, source, n = m["quote"], m["source"], m["n"]
        grounded = F.when(n < 15, n / 15).when(n <= 90, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - 0.02 * (n - 90)))
        opinion = F.when(quote & source, grounded).otherwise(F.least(F.lit(0.3), n / 15 * 0.3))
        return 0.4 * opinion + 0.35 * quote.cast("double") + 0.25 * source.cast("double")

    def section(found: Column) -> Column:
        n = F.size(found)
        count = F.when(n < 4, n / 4).when(n <= 7, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - 0.1 * (n - 7)))
        return F.when(n > 0, 0.3 * count + 0.7 * harmonic(F.transform(found, bullet))).otherwise(0.0)

    def bullets(s: Column) -> Column:
        return F.transform(F.filter(F.split(s["body"], "\n", -1), lambda x: x.rlike(BULLET)), lambda x: F.regexp_extract(x, BULLET, 1))

    scores = F.transform(sections(text), lambda s: once(bullets(s), section))
    return harmonic(F.filter(scores, lambda x: x > 0))
