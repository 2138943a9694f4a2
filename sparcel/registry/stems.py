"""Word stems as column expressions: stop words go, suffixes are stripped by the published rules of Porter's algorithm.

Only words of ASCII letters are stripped; others stand for themselves. Every step is one higher-order function over the words of
a text, so a word is worked out once a step, and its rules run only for words with one of the step's endings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"

# The usual English stop words.
STOP = frozenset("""
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split())

CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Beginnings of a stem that has a vowel, one vowel and consonant after another, and two of these.
VOWEL, ONE, TWO = f"(?:{CONSONANTS})?[aeiouy]", f"(?:{CONSONANTS})?{VOWELS}{CONSONANTS}", f"(?:{CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
SHORT = f"^({CONSONANTS}[aeiouy][^aeiouwxy])"
CUT = "\x02"

# Endings of the second and third step and what stands for them, and endings of the fourth that go.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _replaced(word: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        word = F.regexp_replace(word, pattern, by)
    return word


def _endings(begins: str, endings: dict[str, str]) -> list[tuple[str, str]]:
    """Longest first; what an ending leaves behind is no other ending of the same step."""
    return [(f"^({begins}.*){e}$", f"$1{by}") for e, by in sorted(endings.items(), key=lambda x: -len(x[0]))]


#: (words it is for, rules in order) of each step.
STEPS: list[tuple[str, list[tuple[str, str]]]] = [
    ("s$", [("^(.+?)(ss|i)es$", "$1$2"), ("^(.+?)([^s])s$", "$1$2")]),
    ("(?:ed|ing)$", [
        (f"^({ONE}.*)eed$", "$1ee"), (f"^({VOWEL}.*?)(?:(?<!e)ed|ing)$", f"$1{CUT}"), (f"(at|bl|iz){CUT}$", "$1e"),
        (rf"([^aeiouylsz])\1{CUT}$", "$1"), (f"{SHORT}{CUT}$", "$1e"), (f"{CUT}$", ""),
    ]),
    ("y$", [("^(.+[^aeiouy])y$", "$1i")]),
    (f"(?:{'|'.join(SECOND)})$", _endings(ONE, SECOND)),
    (f"(?:{'|'.join(THIRD)})$", _endings(ONE, THIRD)),
    (f"(?:{'|'.join(FOURTH)}|[st]ion)$", [
        *[(f"^({TWO}.*){e}$", f"$1{CUT}") for e in sorted(FOURTH, key=len, reverse=True)], (f"^({TWO}.*(?<=[st]))ion$", "$1"), (f"{CUT}$", ""),
    ]),
    ("e$", [(f"^({TWO}.*)e$", "$1"), (f"{SHORT}e$", f"$1e{CUT}"), (f"^({ONE}(?:{VOWELS})?)e$", "$1"), (f"{CUT}$", "")]),
    ("ll$", [(f"^({TWO}.*(?<=l))l$", "$1")]),
]


def _step(wanted: str, rules: list[tuple[str, str]]) -> Callable[[Column], Column]:
    return lambda w: F.when(w.rlike(wanted), _replaced(w, *rules)).otherwise(w)


def stems(text: Column) -> Column:
    """The stems of a text's words in order, without stop words."""
    words = F.filter(F.split(F.lower(text), NOT_WORD), lambda w: (w != "") & ~w.isin(*sorted(STOP)))
    for ending, rules in STEPS:
        words = F.transform(words, _step(f"^[a-z]{{2,}}(?:{ending})", rules))
    return words


def stems_of(spark: SparkSession, texts: list[str]) -> list[list[str]]:
    """The stems of a few texts, by the same expression."""
    if not texts:
        return []
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", stems(F.col("t")).alias("s")).collect()
    return [r["s"] for r in sorted(rows, key=lambda r: r["i"])]
