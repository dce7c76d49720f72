"""Open answers: clean, split into words, form word triples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions.scalars import _col

# Words without content in an open answer.
FILLER_WORDS = [
    "nope", "to", "the", "none", "nothing", "nome", "a", "in", "for", "it", "of", "do", "they", "them",
    "is", "with", "so", "i", "and", "also", "on", "because", "or", "has", "im", "we", "that", "need",
    "who", "are", "about",
]
# Fixed value: the mark of an empty export cell.
EMPTY_MARK = "##N/A##"
# Those filler words the historic report removed anywhere, also
# inside longer words, and the one it missed through a faulty escape.
UNBOUNDED = ["nope", "none", "nothing", "nome"]
MISSED = "that"

# Further words left out of the word list of a report.
EXTRA_STOP_WORDS = ["to", "the", "a", "an", "nope", "for", "in", "none", "nome"]

# Letters with their accents, digits and the underscore make words; an
# apostrophe does between them.
_IN_WORD = r"[\p{L}\p{M}\p{N}_]"
WORD = rf"[\p{{L}}\p{{N}}]{_IN_WORD}*(?:['’]{_IN_WORD}+)*"
_BEFORE = rf"(?<!{_IN_WORD})"
_AFTER = rf"(?!{_IN_WORD})"


def cleaning_pattern(fillers: Sequence[str] = FILLER_WORDS, compat: bool = False) -> str:
    """Pattern of what to delete.

    By default every filler is a whole word, and ``no`` goes only at the end of
    an answer. ``compat`` reproduces the historic pattern: some fillers are cut
    out of longer words too, as is a trailing ``no``.
    """
    if not compat:
        whole = "|".join(_by_first_letter(fillers))
        return f"(?i){_BEFORE}(?:(?:{whole}){_AFTER}|no$)|{EMPTY_MARK}"
    bounded = [w for w in fillers if w not in UNBOUNDED and w != MISSED]
    return "(?i)no$|" + "|".join([*UNBOUNDED, EMPTY_MARK, *[rf"\b{w}\b" for w in bounded]])


def _by_first_letter(fillers: Sequence[str]) -> list[str]:
    """One alternative per first letter: fewer to try at each place of a text.

    The long s counts as an s, as it does in any case-blind match.
    """
    tails: dict[str, list[str]] = {}
    for w in fillers:
        tails.setdefault(w[0], []).append(w[1:])
    return [f"{first}(?:{'|'.join(rest)})".replace("s", "[sſ]") for first, rest in tails.items()]


def clean_answer(c: Column | str, fillers: Sequence[str] = FILLER_WORDS, compat: bool = False) -> Column:
    """Delete fillers, the empty mark and a closing ``no``."""
    return F.regexp_replace(_col(c), cleaning_pattern(fillers, compat), "")


def words(c: Column | str) -> Column:
    """Lower-case words of a text, in order, as an array.

    Give it a column of its own before taking several things from it.
    """
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))


def kept_words(c: Column | str, fillers: Sequence[str] = FILLER_WORDS, compat: bool = False) -> Column:
    """The words of a cleaned text: ``words(clean_answer(c))`` in one pass over the text.

    A word is not taken up where a filler stands. Only texts with an empty
    mark, whose deletion can join letters, and the historic pattern, which cuts
    into words, are cleaned first.
    """
    cleaned_first = words(clean_answer(c, fillers, compat))
    if compat:
        return cleaned_first
    whole = "|".join(_by_first_letter(fillers))
    no_filler = rf"(?!(?:{whole}){_AFTER}|no$)"
    start = rf"{_BEFORE}{no_filler}[\p{{M}}_]*"
    word = rf"[\p{{L}}\p{{N}}]{_IN_WORD}*(?:['’]{no_filler}{_IN_WORD}+)*"
    at_once = F.regexp_extract_all(F.lower(_col(c)), F.lit(f"(?i){start}({word})"), F.lit(1))
    return F.when(F.contains(_col(c), F.lit("##")), cleaned_first).otherwise(at_once)


def trigrams(tokens: Column | str) -> Column:
    """Neighbouring word triples of an array; none when it has fewer than three."""
    t = _col(tokens)
    starts = F.sequence(F.lit(1), F.size(t) - 2)
    triples = F.transform(starts, lambda i: F.array_join(F.slice(t, i, 3), " "))
    return F.when(F.size(t) >= 3, triples).otherwise(F.array().cast("array<string>"))
