"""Text functions: Column -> Column, all inside the JVM.

Nulls: a null text gives a null (or an empty list where a list is returned). Empty and blank texts
give empty results. Patterns name ASCII classes, so that other engines read them alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no content of a phrase.
STOPWORDS = """a about above after again against all am an and any are as at be because been before being below between both but by can cannot could
did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself me
more most my myself no nor not of off on once only or other ought our ours ourselves out over own same she should so some such than that the their theirs
them themselves then there these they this those through to too under until up very was we were what when where which while who whom why with would you
your yours yourself yourselves""".split()
# General words of scientific texts that are no content of a phrase.
GENERAL = """paper study studies result results finding findings conclusion conclusions approach method methods analysis analyses data present presents
presented article use used using based show shows shown also well high new different various important significant potential respectively due within among
across including et al""".split()
# Patterns of copyright and publisher notices, each to the end of its sentence.
NOTICES = [
    r"copyright\s+(?:©|\(c\))?\s*\d{4}[^\n.]*",
    r"©\s*\d{4}[^\n.]*",
    r"all rights reserved[^\n.]*",
    r"published by\s+[^\n.]*",
    r"elsevier\s+(?:b\.v\.|inc\.|ltd\.)[^\n.]*",
    r"springer(?:\s+nature)?[^\n.]*",
    r"ieee[^\n.]*",
    r"wiley[^\n.]*",
]
# Headings of structured abstracts.
HEADINGS = "BACKGROUND|OBJECTIVES?|METHODS?|DESIGN|SETTING|PARTICIPANTS|INTERVENTIONS?|MAIN OUTCOMES?|RESULTS?|CONCLUSIONS?|SIGNIFICANCE|SUMMARY|PURPOSE|RATIONALE|MATERIALS? AND METHODS?"
# Irregular plurals.
IRREGULAR = {
    "analyses": "analysis", "hypotheses": "hypothesis", "theses": "thesis", "crises": "crisis", "criteria": "criterion", "phenomena": "phenomenon",
    "indices": "index", "matrices": "matrix", "vertices": "vertex", "bacteria": "bacterium", "fungi": "fungus", "nuclei": "nucleus", "radii": "radius",
    "stimuli": "stimulus", "data": "data", "species": "species",
}

#: White space of all scripts, as a class that Java and RE2 read alike.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_HEADING = rf"(?i)(^|[^A-Za-z0-9_])(?:{HEADINGS})\s*:\s*"
_TOKEN = r"[0-9_À-ÿ][A-Za-z0-9_À-ÿ]*|((?:[a-zA-Z][a-zA-Z0-9_\-]*[a-zA-Z0-9_]|[a-zA-Z])(?:/[a-zA-Z0-9_\-]*[a-zA-Z0-9_])?)"


def split_list(c: Column, sep: str = ";", lower: bool = True) -> Column:
    """Delimited list: split, trimmed, lower-cased, empty values dropped."""
    return F.filter(F.transform(F.split(F.lower(c) if lower else c, sep), lambda x: F.trim(x)), lambda x: x != "")


def countries(affiliations: Column) -> Column:
    """Distinct lower-case last comma parts of each affiliation, longer than two letters."""
    last = F.transform(F.split(affiliations, ";"), lambda a: F.lower(F.trim(F.element_at(F.split(a, ","), -1))))
    return F.array_distinct(F.filter(last, lambda c: F.length(c) > 2))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS, " "))


def strip_markup(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def clean_scientific(c: Column, notices: bool = True, headings: bool = True) -> Column:
    """Headings of structured abstracts and publisher notices taken out, white space collapsed."""
    if headings:
        c = F.regexp_replace(c, _HEADING, "$1 ")
    if notices:
        c = reduce(lambda x, p: F.regexp_replace(x, f"(?i){p}", " "), NOTICES, c)
    return collapse(c)


def singular(term: Column) -> Column:
    """The last word of a lower-case term in the singular, by irregular forms, then endings."""
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])

    def one(w: Column) -> Column:
        ends = lambda *e: reduce(lambda x, y: x | y, [F.endswith(w, F.lit(v)) for v in e])
        cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
        return (
            F.when(w.isin(list(IRREGULAR)), F.try_element_at(irregular, w))
            .when((F.length(w) <= 4) | ~ends("s"), w)
            .when(ends("ies") & ~ends("eies"), F.concat(cut(3), F.lit("y")))
            .when(ends("ses") & ~ends("sses"), cut(2))
            .when(ends("ches", "shes", "xes", "zes"), cut(2))
            .when(~ends("ss", "us", "is", "as"), cut(1))
            .otherwise(w)
        )

    # a one-element array binds the last word, which is then evaluated once
    last = F.substring_index(term, " ", -1)
    return F.transform(F.array(last), lambda w: F.concat(F.substring(term, F.lit(1), F.length(term) - F.length(w)), one(w)))[0]


def noun_phrases(text: Column) -> Column:
    """Runs of up to three content words of each sentence, singular, longer than two letters."""
    is_stop = lambda w: w.isin(STOPWORDS + GENERAL)  # noqa: E731  a hash set once optimised
    sentences = F.split(clean_scientific(text), r"[.!?;\n]+")

    def chunks(sentence: Column) -> Column:
        tokens = F.filter(F.regexp_extract_all(sentence, F.lit(_TOKEN), 1), lambda t: t != "")
        none = F.array().cast("array<string>")

        def step(s: Column, t: Column) -> Column:
            low, cur = F.lower(t), s["cur"]
            out = F.when(F.size(cur) > 0, F.array_append(s["out"], F.array_join(cur, " "))).otherwise(s["out"])
            skip = is_stop(low) | ((F.length(t) == 1) & (t == low))
            grows = (F.size(cur) > 0) & (F.size(cur) < 3) & (F.length(t) > 1)
            return (
                F.when(skip, F.struct(out.alias("out"), none.alias("cur")))
                .when(grows, F.struct(s["out"].alias("out"), F.array_append(cur, low).alias("cur")))
                .otherwise(F.struct(F.when(F.size(cur) > 0, out).otherwise(s["out"]).alias("out"), F.array(low).alias("cur")))
            )

        done = F.aggregate(tokens, F.struct(none.alias("out"), none.alias("cur")), step, lambda s: F.when(F.size(s["cur"]) > 0, F.array_append(s["out"], F.array_join(s["cur"], " "))).otherwise(s["out"]))
        return F.filter(F.transform(done, singular), lambda p: (F.length(p) > 2) & ~is_stop(p))

    return F.flatten(F.transform(sentences, chunks))


def topic_code(name: Column) -> Column:
    """struct(macro, meso, micro, short) of 'M.m.u name'; null where the code has fewer than three parts."""
    code, rest = F.substring_index(name, " ", 1), F.regexp_extract(name, r"^[^ ]* (.*)$", 1)
    parts = F.split(code, r"\.")
    short = F.when(F.instr(name, " ") > 0, F.trim(rest)).otherwise(code)
    return F.when(F.size(parts) >= 3, F.struct(parts[0].alias("macro"), parts[1].alias("meso"), parts[2].alias("micro"), short.alias("short")))


def safe_number(c: Column) -> Column:
    """Number of a text without % and thousands commas; 0 where there is none."""
    return F.coalesce(F.trim(F.regexp_replace(c, "[%,]", "")).try_cast("double"), F.lit(0.0))


def year4(c: Column) -> Column:
    """The first four characters as a year, null where they are no four digits."""
    return F.when(F.trim(c).rlike(r"^\d{4}"), F.substring(F.trim(c), 1, 4).cast("int"))


def title_case(c: Column) -> Column:
    """Every letter after a non-letter upper-case, the others lower-case (unlike initcap)."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([^a-zA-ZÀ-ÿ]*[a-zA-ZÀ-ÿ]*)"), 1)
    up = lambda w: F.concat(F.regexp_extract(w, r"^([^a-zA-ZÀ-ÿ]*)", 1), F.upper(F.regexp_extract(w, r"^[^a-zA-ZÀ-ÿ]*([a-zA-ZÀ-ÿ]?)", 1)), F.regexp_extract(w, r"^[^a-zA-ZÀ-ÿ]*[a-zA-ZÀ-ÿ]?(.*)$", 1))
    return F.array_join(F.transform(words, up), "")


def trajectory(label: Column) -> Column:
    """struct(entity, time, temporal) of year_entity, entity_year or prefix_entity labels."""
    parts, number = F.split(label, "_"), r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    n = F.size(parts)
    is_number = lambda p: p.rlike(number) | (F.trim(p) == "")
    at_end = is_number(F.element_at(parts, -1)) & ~is_number(parts[0])
    after, before = F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), "_"), F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "_")
    plain = F.struct(label.alias("entity"), F.lit("").alias("time"), F.lit(False).alias("temporal"))
    return F.when(n < 2, plain).otherwise(F.struct(F.when(at_end, before).otherwise(after).alias("entity"), F.when(at_end, F.element_at(parts, -1)).otherwise(parts[0]).alias("time"), F.lit(True).alias("temporal")))


def ui_number(c: Column) -> Column:
    """Number at the start of a text as the user interface reads it: the first % goes, the first comma is a decimal point; 0
    where there is none, and for nulls."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, "^([^%]*)%", "$1"), "^([^,]*),", "$1."))
    return F.coalesce(F.regexp_extract(plain, r"^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
