"""Vietnamese syllables: onset, glide, nucleus, coda and tone, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import text as T

# Onsets in the order in which they are tried, codas likewise, nuclei from long to short, vowel letters.
ONSETS = "ngh ng nh ch gh gi kh ph th tr qu b c d đ g h k l m n p r s t v x".split()
CODAS = "ng nh ch c m n p t i y o u".split()
NUCLEI = "iê yê uô ươ ia ya ua ưa uơ a ă â e ê i o ô ơ u ư y".split()
VOWELS = "aăâeêioôơuưy"


def onset(base: Column) -> Column:
    """First onset in order that a vowel follows, '' before a bare vowel, null for anything else."""
    alternatives = "|".join(f"{o}(?=[{VOWELS}])" for o in ONSETS)
    found = F.regexp_extract(base, f"^({alternatives})", 1)
    return F.when(found != "", found).when(base.rlike(f"^[{VOWELS}]"), F.lit(""))


def rime(rest: Column) -> Column:
    """(glide, nucleus, coda) of what follows the onset, null where it is no rime.

    Codas are tried from none on, and for each the nuclei in order; the first fit counts, so `oi` is a glide and i.
    The fits are a table of all rimes (codas by nuclei by glides), made once as a literal map.
    """
    table: dict[str, tuple[str, str, str]] = {}
    for coda in ["", *CODAS]:
        for nucleus in NUCLEI:
            for glide in ("", "o", "u"):
                table.setdefault(glide + nucleus + coda, (glide, nucleus, coda))
    # A spelling that several cuts give keeps the first cut in the order coda, nucleus.
    pairs = [x for spelled, parts in table.items() for x in (F.lit(spelled), F.struct(*(F.lit(p).alias(n) for p, n in zip(parts, ("glide", "nucleus", "coda")))))]
    return F.element_at(F.create_map(*pairs), rest)


def parsed(df: DataFrame, syllable: str) -> DataFrame:
    """Rows with base, onset, glide, nucleus, coda and tone of a composed lower-case syllable; null where it is none."""
    based = df.withColumn("base", T.toneless(syllable)).withColumn("onset", onset(F.col("base")))
    cut = based.withColumn("__r", rime(F.substring("base", F.length("onset") + 1, F.length("base"))))
    whole = F.col("__r").isNotNull()
    return cut.select(*df.columns, *(F.when(whole, c).alias(n) for n, c in (("base", F.col("base")), ("onset", F.col("onset")), ("glide", F.col("__r.glide")), ("nucleus", F.col("__r.nucleus")), ("coda", F.col("__r.coda")), ("tone", T.tone(syllable)))))


def contrast(a: Column, b: Column, empty: str = "–") -> Column:
    """Unordered contrast label of two values, an empty one shown as a dash."""
    x, y = F.when(a == "", F.lit(empty)).otherwise(a), F.when(b == "", F.lit(empty)).otherwise(b)
    return F.concat(F.least(x, y), F.lit(" / "), F.greatest(x, y))
