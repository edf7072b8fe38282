"""Text expressions: tokens, sentences, and the rates that describe fluency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filler words.
FILLERS = ("uh", "um", "er", "ah", "erm", "hmm", "mm", "uhm")
#: Words that open a subordinate clause.
SUBORDINATORS = (
    "because", "although", "though", "which", "that", "when", "while", "if", "since", "unless", "whereas", "who", "whom", "whose", "where", "whether",
    "however", "therefore", "moreover", "until", "before", "after",
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Parts that end in ``.``, ``!`` or ``?`` before white space; none for blank texts."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), stripped), lambda s: s != "")


def chunks(words: Column, size: int = 15) -> Column:
    """Runs of ``size`` words joined by spaces; one empty string without words."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(n > 0, cut).otherwise(F.array(F.lit("")))

    # the array of one binds the words, which are then made once a text and not once a run
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def joined(words: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(words, " "), r"\s+", " "))


def bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(
        F.array().cast("array<struct<a:string,b:string>>")
    )


def distinct_bigrams(words: Column) -> Column:
    """The number of different pairs of neighbours. A word has no space, so a pair is one string, which is hashed; structs would be compared all with all."""
    ahead = F.greatest(F.size(words) - 1, F.lit(0))
    return F.size(F.array_distinct(F.zip_with(F.slice(words, 1, ahead), F.slice(words, 2, ahead), lambda a, b: F.concat(a, F.lit(" "), b))))


def adjacent_repeats(words: Column) -> Column:
    return F.size(F.filter(bigrams(words), lambda b: b["a"] == b["b"]))


def mattr(words: Column, window: int = 25) -> Column:
    """Mean share of distinct words over full windows; over the whole text where it is shorter.

    A window's distinct words are the occurrences in it that no equal word in it
    precedes. So each occurrence counts for the windows that reach it and start
    after the equal word before it, which sorted words have as their neighbour.
    """
    n = F.size(words)
    ranked = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def first_in(s: Column, x: Column, k: Column) -> Column:
        before = F.get(s, k - 1)
        after = F.when((k > 0) & (before["w"] == x["w"]), before["i"] + 1).otherwise(0)
        return F.greatest(F.least(x["i"], n - window) - F.greatest(x["i"] - (window - 1), after) + 1, F.lit(0))

    # the array of one binds the sorted words, which are then made once
    total = F.get(F.transform(F.array(ranked), lambda s: F.aggregate(F.transform(s, lambda x, k: first_in(s, x, k)), F.lit(0), lambda a, c: a + c)), F.lit(0))
    return F.when(n >= window, total / (n - window + 1) / float(window)).otherwise(F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)))


def share_in(words: Column, listed: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*listed))) / F.greatest(F.size(words), F.lit(1))


def text_rates(text: Column, seconds: Column, words: Column) -> dict[str, Column]:
    """The rates that need no word times. ``words`` are the text's tokens, as a column of their own so they are made once."""
    minutes = F.greatest(seconds, F.lit(1.0)) / 60
    n = F.greatest(F.size(words), F.lit(1))
    parts = sentences(text)
    lengths = F.transform(parts, lambda s: F.size(tokens(s)))
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    two = bigrams(words)
    return {
        "words_per_min": F.size(words) / minutes,
        "filler_rate": share_in(words, FILLERS),
        "repeat_rate": adjacent_repeats(words) / n,
        "bigram_repeat_rate": (F.size(two) - distinct_bigrams(words)) / F.greatest(F.size(two), F.lit(1)),
        "mattr": mattr(words),
        "mean_word_len": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n,
        "long_word_rate": F.size(F.filter(words, lambda w: F.length(w) > 6)) / n,
        "subordinator_rate": share_in(words, SUBORDINATORS),
        "mean_sent_len": total / F.greatest(F.size(parts), F.lit(1)),
        "max_sent_len": F.coalesce(F.array_max(lengths), F.lit(0)).cast("double"),
        "sent_per_min": F.size(parts) / minutes,
    }


#: The first of the characters that stand for words: above it are enough for a million different ones.
FIRST_CODE = 0x10000


def word_levenshtein(a: Column, b: Column) -> Column:
    """Word-level edit distance of two array columns.

    Each different word of the two becomes one character, so the built-in
    distance of characters counts words.
    """

    def coded(words: Column, kinds: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(kinds, w) + FIRST_CODE), 8, "0")), "UTF-32")), "")

    kinds = F.array_distinct(F.concat(a, b))
    return F.get(F.transform(F.array(kinds), lambda k: F.levenshtein(coded(a, k), coded(b, k))), F.lit(0))


def word_error_rate(reference: Column, other: Column, most: float = 2.0) -> Column:
    """Edits a reference word, capped; an empty side counts as the one word ``x``."""
    r = F.when(F.size(reference) > 0, reference).otherwise(F.array(F.lit("x")))
    o = F.when(F.size(other) > 0, other).otherwise(F.array(F.lit("x")))
    return F.least(word_levenshtein(r, o) / F.size(r), F.lit(most))
