"""Case folding as Python's ``str.casefold`` does it, by built-in functions.

Lower case alone keeps ``ß``, maps a capital sigma by its place in the word, and leaves some two hundred other characters. The
characters that ``lower`` and ``casefold`` treat differently are found by that rule. Spark's collations are not used: ``UTF8_LCASE``
keeps ``ß``, and ``UNICODE_CI`` leaves control characters out of comparisons.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _special() -> tuple[dict[str, str], dict[str, str]]:
    """What lower-case characters fold to where that is another character, or several."""
    every = [c for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c and c.casefold() != c]
    return {c: c.casefold() for c in every if len(c.casefold()) == 1}, {c: c.casefold() for c in every if len(c.casefold()) > 1}


def casefold(text: Column) -> Column:
    """Folded text: lower case, then what differs. Texts within Latin-1 need two replacements; only others go through a translation,
    and of these only those with one of the rare characters that fold to several through a replacement of each."""
    single, several = _special()
    low = F.lower(text)
    latin = F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    folded = F.translate(latin, "".join(single), "".join(single.values()))
    rare = [c for c in several if c != "ß"]
    each = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(several[c])), rare, folded)
    return F.when(~low.rlike(r"[^\x00-\xff]"), latin).when(folded.rlike("[" + "".join(rare) + "]"), each).otherwise(folded)
