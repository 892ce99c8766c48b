"""Text functions: the token rule of the ranking operators, and a dictionary stemmer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: ASCII characters that part tokens, but for the blank.
_PARTING = "".join(chr(i) for i in range(128) if not chr(i).isalnum() and chr(i) != " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits.

    Signs become blanks by a table and all else that isn't ASCII by one range: Java matches a class of several ranges ten times slower.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), _PARTING, " " * len(_PARTING))
    cleaned = F.lower(F.regexp_replace(plain, "[^\\x00-\\x7F]+", " "))
    return F.filter(F.split(cleaned, " "), lambda x: x != "")


def counts(toks: Column) -> Column:
    """array<struct(term, tf)> of the different tokens of an array, by term: lengths of the runs of the sorted array."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        first = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        ends = lambda at: F.slice(F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(n)), F.lit(1), F.size(at))
        return _let(first, lambda at: F.zip_with(at, ends(at), lambda i, end: F.struct(F.get(words, i).alias("term"), (end - i).cast("double").alias("tf"))))

    return _let(F.sort_array(toks), runs)


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once however often the body reads it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def markup_tokens(text: Column) -> Column:
    """The variant for topic-model input: lower-case, tags removed, then split."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "<[^>]*>", " "), "[^a-z0-9 ]", " "), " "), lambda x: x != "")


# Families of endings in the order in which they are taken off, each (ending, what may stand instead, in order of preference). A
# family of inflections is taken off even if no result is a known word; one of derivations only if one is.
INFLECTIONS = [
    [("ies", ["y", "ie"]), ("es", ["e", ""]), ("s", [""])],
    [("ied", ["y", "ie"]), ("ed", ["e", ""])],
    [("ing", ["e", ""])],
]
DERIVATIONS = [
    [("ability", ["able"]), ("ibility", ["ible"]), ("ivity", ["ive", ""]), ("ality", ["al", ""]), ("ity", ["e", "", "ous"])],
    [("iness", ["y"]), ("ness", [""])],
    [("ization", ["ize"]), ("ication", ["y"]), ("ation", ["ate", "e", ""]), ("ition", ["e", ""]), ("ion", ["e", ""])],
    [("ier", ["y"]), ("izer", ["ize"]), ("er", ["e", ""]), ("or", ["e", ""])],
    [("ically", ["ic", "ical"]), ("ably", ["able"]), ("ibly", ["ible"]), ("ily", ["y"]), ("ly", ["", "le"])],
    [("ical", ["ic", "y"]), ("ial", ["e", "y", ""]), ("al", ["", "e"])],
    [("ative", ["ate", "e", ""]), ("ive", ["e", ""])],
    [("ize", ["", "e"]), ("ise", ["", "e"])],
    [("iment", ["y"]), ("ment", ["", "e"])],
    [("able", ["", "e"]), ("ible", ["", "e"])],
    [("ism", ["", "e", "y"])],
    [("ic", ["", "e", "y"])],
    [("ency", ["ent"]), ("ancy", ["ant"])],
    [("ence", ["ent", "e", ""]), ("ance", ["ant", "e", ""])],
]
SHORTEST, LONGEST = 3, 100
VOWELS = "aeiouy"


class Stemmer:
    """A dictionary stemmer: endings come off until a known word is reached.

    lexicon: known words, such as the frequent words of a collection, which are not taken further; exceptions: words with their stems.
    """

    def __init__(self, lexicon: set[str] | frozenset[str] = frozenset(), exceptions: dict[str, str] | None = None) -> None:
        self.lexicon, self.exceptions = lexicon, exceptions or {}

    def _taken(self, word: str, family: list[tuple[str, list[str]]], sure: bool) -> str:
        """The word without its ending of a family; the word itself if it has none or, unless `sure`, no result is known."""
        for ending, instead in family:
            if not word.endswith(ending) or ending == "s" and word.endswith("ss"):
                continue
            root = word[: -len(ending)]
            if len(root) < 2 or not any(c in VOWELS for c in root):
                continue
            single = [root[:-1]] if len(root) > 3 and root[-1] == root[-2] and instead[-1] == "" else []
            options = [root + x for x in instead]
            for option in [*options, *single]:
                if option in self.lexicon:
                    return option
            if sure:
                if single and root[-1] not in "lsz":
                    return single[0]
                return options[0] if ending.startswith("i") and ending != "ing" else options[-1]
            return word
        return word

    def stem(self, word: str) -> str:
        """Words of up to two or from a hundred letters, and those with other signs than letters, stay as they are."""
        word = word.lower()
        if not SHORTEST <= len(word) < LONGEST or not (word.isascii() and word.isalpha()):
            return word
        if word in self.exceptions:
            return self.exceptions[word]
        for family in INFLECTIONS:
            if word in self.lexicon:
                return word
            word = self._taken(word, family, not word.endswith(("us", "is")))
        for family in DERIVATIONS:
            if word in self.lexicon:
                return word
            word = self._taken(word, family, False)
        return word


def stemmer(spark: SparkSession, lexicon: set[str] | None = None, exceptions: dict[str, str] | None = None):
    """A function from a column of words to their stems, by Arrow batch; each distinct word of a batch once. The lexicon is sent to every executor: it must be a bounded list."""
    sent = spark.sparkContext.broadcast(Stemmer(frozenset(lexicon or ()), exceptions))

    @F.pandas_udf(T.StringType())
    def stemmed(words: pd.Series) -> pd.Series:
        known = {w: sent.value.stem(w) for w in words.dropna().unique()}
        return words.map(known)

    return stemmed


def stemmed_tokens(docs: DataFrame, stem, stop: list[str] = (), text: str = "text") -> DataFrame:
    """docs with toks: the tokens' stems, in order, without the tokens that are stop words before they are stemmed."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def apart(lists: pd.Series) -> pd.Series:
        each = {w: w for ws in lists for w in ws}
        made = stem.func(pd.Series(list(each), dtype=object))
        by = dict(zip(each, made, strict=True))
        return lists.map(lambda ws: [by[w] for w in ws])

    kept = F.filter(tokens(F.col(text)), lambda w: ~w.isin(list(stop))) if stop else tokens(F.col(text))
    return docs.withColumn("toks", apart(kept))
