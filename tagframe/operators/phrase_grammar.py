"""N6 with a wide label set: a small grammar over token classes.

Each token has a class letter; a text becomes one string of units (class letter,
token number, mark), and the grammar is an automaton over those units: per label
a pattern of classes, the first label in order that matches at a place wins. The
units carry the token numbers, so a match names its tokens and nothing has to be
counted; everything stays in the document's row and is linear in the text.

A token is a run without white space, its core the run without brackets and
quotes before it and marks after it. A comma between day and year belongs to a date, any
other mark ends a phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagframe.operators.entities import let

TOKEN = r"[^ \t\n\r\x0b\x0c]+"
CORE = r"""(?s)^["'(\[{]*(.*?)[.,;:!?)"'\]}]*\z"""
TAIL = r"""[.,;:!?)"'\]}]*\z"""

# Word lists of the token classes.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SCALES = ("hundred", "thousand", "million", "billion", "trillion")
CURRENCIES = ("dollar", "dollars", "euro", "euros", "pound", "pounds", "cents", "USD", "EUR", "GBP")
UNITS = ("km", "kg", "miles", "meters", "feet", "inches", "acres", "tons", "degrees", "litres", "gallons")
PEOPLES = ("American", "Americans", "British", "French", "German", "Germans", "Russian", "Russians", "Chinese", "Spanish", "Mexican",
           "Republican", "Republicans", "Democrat", "Democrats", "Democratic", "Muslim", "Muslims", "Christian", "Christians", "Jewish")
PLACES = ("America", "China", "Russia", "France", "Germany", "Spain", "Mexico", "Iraq", "Iran", "Texas", "Florida", "Ohio", "Wisconsin",
          "Virginia", "Washington", "London", "Paris", "Berlin", "Madrid", "Chicago", "Austin", "Atlanta")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Sen", "Gov", "President", "Senator", "Governor")
SUFFIXES = ("Inc", "Corp", "Ltd", "LLC", "GmbH", "Company", "University", "Department", "Committee")

# Token classes in order; a tuple is a word list, a string a pattern.
CLASSES = (
    ("E", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\z"),
    ("L", r"^(https?://|www\.)[^ ]+\z"),
    ("I", r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})\z"),
    ("T", r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\z"),
    ("C", r"^[$€£][0-9][0-9.,]*[kKmMbB]?\z"),
    ("P", r"^[0-9][0-9.,]*%\z"),
    ("O", r"^([0-9]+(st|nd|rd|th)|first|second|third)\z"),
    ("D", r"^([1-9]|[12][0-9]|3[01])\z"),
    ("Y", r"^(1[0-9]{3}|20[0-9]{2})\z"),
    ("N", r"^[0-9][0-9.,]*\z"),
    ("M", MONTHS), ("W", WEEKDAYS), ("S", SCALES), ("U", CURRENCIES), ("Z", ("percent",)), ("Q", UNITS), ("A", ("am", "pm", "AM", "PM")),
    ("R", PEOPLES), ("G", PLACES), ("H", TITLES), ("X", SUFFIXES),
    ("B", r"^[A-Z]{2,}\z"),
    ("K", r"^[A-Z][a-z]+\z"),
)
OTHER = "o"

# The grammar, over units such as ``K12`` or ``D3,``; the first label that matches at a place wins.
GRAMMAR = (
    ("DATE", r"W\d+(?:,? M\d+ [DO]\d+(?:,? Y\d+)?)?|[DO]\d+ M\d+(?: Y\d+)?|M\d+ [DO]\d+(?:,? Y\d+)?|M\d+ Y\d+|M\d+|I\d+"),
    ("TIME", r"T\d+(?: A\d+)?|D\d+ A\d+"),
    ("MONEY", r"C\d+(?: S\d+)?|[DYN]\d+(?: S\d+)? U\d+"),
    ("PERCENT", r"P\d+|[DYN]\d+ Z\d+"),
    ("QUANTITY", r"[DYN]\d+(?: S\d+)? Q\d+"),
    ("ORDINAL", r"O\d+"),
    ("ORG", r"[KB]\d+(?: [KB]\d+)* X\d+|B\d+"),
    ("PERSON", r"H\d+;? [KG]\d+(?: K\d+)?|K\d+ K\d+"),
    ("GPE", r"G\d+"),
    ("NORP", r"R\d+"),
    ("EMAIL", r"E\d+"),
    ("URL", r"L\d+"),
    ("CARDINAL", r"[DYN]\d+(?: S\d+)?"),
)
LABELS = tuple(name for name, _ in GRAMMAR)
#: Every class needs a capital, a digit, a currency sign, an ``@``, a link or a listed lower-case word.
LISTED = "|".join(w for _, rule in CLASSES if not isinstance(rule, str) for w in rule if w[0].islower()) + "|first|second|third"
MAY = rf"^[A-Z0-9$€£]|@|^https?:|^www\.|^(?:{LISTED})\z"
#: Words that are their own core and of no class; most tokens, told by one pattern, the same with a comma after them.
PLAIN = rf"""^(?!(?:{LISTED})\z)[^A-Z0-9$€£@"'(\[{{.,;:!?)\]}}]+\z"""
PLAIN_COMMA = rf"""^(?!(?:{LISTED}),\z)[^A-Z0-9$€£@"'(\[{{.,;:!?)\]}}]+,\z"""


def phrase_pattern() -> str:
    return "|".join(f"(?:{pattern})" for _, pattern in GRAMMAR)


def token_class(core: Column) -> Column:
    got = F.when(~core.rlike(MAY), F.lit(OTHER))
    for letter, rule in CLASSES:
        got = got.when(core.rlike(rule) if isinstance(rule, str) else core.isin(*rule), F.lit(letter))
    return got.otherwise(F.lit(OTHER))


def grammar_entities(text) -> Column:
    """``array<struct<pos, entity, word, first_token, n_tokens>>`` in text order; null for a null text."""
    t = F.col(text) if isinstance(text, str) else text

    def core(x):
        return F.regexp_extract(x, CORE, 1)

    def unit(x, i):
        tail = F.regexp_extract(x, TAIL, 0)
        mark = F.when(tail == "", F.lit("")).when(tail == ",", F.lit(",")).otherwise(F.lit(";"))
        letter = let(core(x), token_class)
        full = F.concat(letter, F.when(letter == OTHER, F.lit("")).otherwise(i.cast("string")), mark)
        return F.when(x.rlike(PLAIN), F.lit(OTHER)).when(x.rlike(PLAIN_COMMA), F.lit(OTHER + ",")).otherwise(full)

    def label(m):
        got = None
        for name, pattern in GRAMMAR:
            hit = m.rlike(f"^(?:{pattern})\\z")
            got = F.when(hit, F.lit(name)) if got is None else got.when(hit, F.lit(name))
        return got

    def phrases(tokens):
        units = F.array_join(F.transform(tokens, lambda x, i: unit(x, i)), " ")

        def phrase(m, j):
            first = F.regexp_extract(m, "[0-9]+", 0).cast("int")
            n = F.regexp_extract(m, r"[0-9]+\z", 0).cast("int") - first + 1
            word = F.array_join(F.transform(F.slice(tokens, first + 1, n), core), " ")
            return F.struct(j.cast("int").alias("pos"), label(m).alias("entity"), word.alias("word"), first.alias("first_token"),
                            n.alias("n_tokens"))
        return F.transform(F.regexp_extract_all(units, F.lit(phrase_pattern()), F.lit(0)), phrase)

    return let(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), phrases)


def tag_grammar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """N6, wide: one row a phrase; local to the document's row."""
    return docs.select(key, F.inline(grammar_entities(text))).select(key, F.lit("W").alias("tagger"), "pos", "entity", "word",
                                                                    "first_token", "n_tokens")
