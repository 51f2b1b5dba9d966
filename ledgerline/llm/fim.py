"""Fill-in-the-middle transformation of documents, without a shuffle.

A unit grammar says between which neighbouring characters a unit ends. It is
translated to one zero-width regular expression of lookarounds, so that Spark's
split cuts a text there and keeps every character; the pieces are the units. Cut
points and form are drawn from a hash of the document's id."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of prefix, suffix and middle (fixed values).
MARKERS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class UnitGrammar:
    """Pairs (before, after) of character classes, written as inside brackets: a
    unit ends between a character of `before` and one of `after` next to it."""

    pairs: tuple[tuple[str, str], ...]

    def boundary(self) -> str:
        """The zero-width regular expression of the boundaries. Classes match
        whole code points, so no boundary lies inside a surrogate pair."""
        return "|".join(f"(?<=[{before}])(?=[{after}])" for before, after in self.pairs)


_ANY, _SPACE, _NO_SPACE = r"\s\S", r"\x20\x09-\x0D", r"^\x20\x09-\x0D"
#: Code points; lines with their \n; words with the white space after them;
#: sentences, up to the white space after . ! or ?; runs of letters, digits,
#: white space and each other character.
GRAMMARS = {
    "char": UnitGrammar(((_ANY, _ANY),)),
    "line": UnitGrammar(((r"\n", _ANY),)),
    "word": UnitGrammar(((_SPACE, _NO_SPACE),)),
    "sentence": UnitGrammar(((r".!?", _SPACE),)),
    "kind": UnitGrammar(
        (
            (r"\p{L}\p{M}", r"^\p{L}\p{M}"),
            (r"\p{N}", r"^\p{N}"),
            (_SPACE, _NO_SPACE),
            (r"^\p{L}\p{M}\p{N}\x20\x09-\x0D", _ANY),
        )
    ),
}


def units(text: Column, grammar: UnitGrammar) -> Column:
    """Array of the units of a text: joined they are the text. An empty or null
    text has none (split alone would give it one empty unit)."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, none).otherwise(F.split(text, grammar.boundary()))


def draws(id_: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit draws: the first 8-digit groups of the hex SHA-256
    of `seed:` followed by the decimal id (nothing for a null id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, grammar: UnitGrammar = GRAMMARS["char"], id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10, spm_percent: int = 20, seed: str = "1", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(id_col, n, form, prefix, middle, suffix, output), row by row.

    The prefix ends after the smaller of two drawn numbers of units, the middle
    after the larger. form is psm (markers P prefix S suffix M middle), spm (S
    suffix P prefix M middle) in spm_percent of 100 draws, or plain, the text as
    it is: in plain_percent of 100 draws, for an empty text and for one that
    holds a marker, so that no output can be read two ways.

    A null text is an empty one, a null id draws as an empty one; repeated rows
    and ids are changed alike and all stay; a text of any length is cut whole;
    extra columns are ignored; no documents give no rows. Parts are null where
    the form is plain."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = draws(F.col(id_col), seed)
    base = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), units(text, grammar).alias("__units"), *[x.alias(f"__h{i}") for i, x in enumerate(h)])
    n = F.size("__units")
    cuts = [F.col(f"__h{i}") % (n + 1) for i in (0, 1)]
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains("__text", F.lit(m))
    plain = (n == 0) | marked | (F.col("__h2") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("__h3") % 100 < spm_percent, "spm").otherwise("psm")
    cut = base.select("__id", "__text", "__units", n.cast("long").alias("n"), form.alias("form"), F.least(*cuts).cast("int").alias("__a"), F.greatest(*cuts).cast("int").alias("__b"))

    def part(start: Column, end: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("__units", start + 1, end - start), ""))

    a, b, end = F.col("__a"), F.col("__b"), F.col("n").cast("int")
    parts = cut.select("__id", "__text", "n", "form", part(F.lit(0), a).alias("prefix"), part(a, b).alias("middle"), part(b, end).alias("suffix"))
    p, s, m = (F.lit(x) for x in markers)
    psm = F.concat(p, "prefix", s, "suffix", m, "middle")
    spm = F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("__text"))
    return parts.select(F.col("__id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text again, from the output and its form alone. The parts hold no
    marker and no marker can arise where a part meets one, so each is found at
    its first place."""
    p, s, m = (re.escape(x) for x in markers)
    psm = F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
