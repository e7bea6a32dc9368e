"""Variant spellings of personal names: sparse cosine joins, then average linkage.

1. Each name is read into family-name keys (accents, particles and hyphens folded; both halves of
   a double name) and given names. Distinct family names become character 3-gram vectors weighted
   by rarity; all pairs a slip of the pen apart meet by what is left of them without two or three
   letters, and those with cosine >= COSINE are linked (no cap on partners).
2. Rows meet where their family names are linked and they share a context token (a word of the
   affiliation, the keyword, a full given name), so that a family name which a third of all rows
   bears is split by context before any pair is made. Rows with neither affiliation nor keyword meet
   all rows of their linked family names and first two initials.
3. Each pair gets a similarity from given names, initials, affiliation, keyword and years;
   contradicting initials give 0. Reciprocal-nearest-neighbour average linkage over these pairs
   groups the rows of one person.

Defined results: null and blank names are no one's variant; null affiliations, keywords and years
neither link nor part; rows without them link by an equal family name and two equal initials; equal rows are variants of each other; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, spread
from . import linkage

#: Cosine of family names, evidence at which two rows are one person, mean similarity of a group.
COSINE, EVIDENCE, LINK = 0.33, 2.5, 0.5
#: Words that open a family name, name suffixes, and words of no use in affiliations.
PARTICLES = frozenset("de la da di del dos du van von der den el al bin ter ten le las los".split())
SUFFIXES = frozenset("jr sr ii iii iv".split())
GENERIC = frozenset("university univ institute inst national natl centre center academy acad state technology tech science sciences sci medical school of the and for college department dept".split())
#: Usual short forms of given names.
SHORT_FORMS = """alexander sasha alex xander; alexandra sasha alex; anthony tony; benjamin ben benny; catherine kate cathy; charles charlie chuck;
christopher chris kit; daniel dan danny; david dave; deborah debbie; dmitri dima mitya; dolores lola; edward ed eddie ted ned; ekaterina katya;
elena lena; elizabeth liz beth lizzie betty eliza; francisco paco pancho; frederik fred freddy; friedrich fritz; gabriela gabi; george georgie;
giuseppe beppe peppe; gregory greg; guadalupe lupe; heinrich heinz; helen nell; henry harry hank; ignacio nacho; isabella bella isa; james jim jimmy jamie;
jennifer jen jenny; johannes hans; john jack johnny; jonathan jon; jose pepe; joseph joe joey; katherine kate kathy katie kathryn; leonardo leo;
margaret peggy maggie meg; maria masha; matthew matt; michael mike mick micky; natalia natasha; nicholas nick; nikolai kolya; patricia pat patty tricia;
rebecca becky; richard dick rick rich; robert bob bobby rob; rosa rosie; samuel sam sammy; sofia sonya; stephen steve; susanne sue susie susi;
theodore ted theo; thomas tom tommy; timothy tim; victoria vicky; viktor vitya; vladimir volodya vova; wilhelmina mina minna; william bill billy will liam; zoran zoki"""
_FORMS: dict[str, set[int]] = {}
for _i, _g in enumerate(SHORT_FORMS.replace("\n", " ").split(";")):
    for _w in _g.split():
        _FORMS.setdefault(_w, set()).add(_i)
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "‐": "-", "–": "-"})
_LOOKS = str.maketrans("105", "los")


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.lower().translate(_PLAIN))
    return "".join(c for c in s if not unicodedata.combining(c))


def _key(words: list[str]) -> str:
    k = "".join(re.sub(r"[^a-z0-9]", "", w) for w in words).translate(_LOOKS)
    return re.sub(r"([aou])e", r"\1", k)


def read_name(name: str | None) -> tuple[list[str], list[str], str]:
    """(family keys, the whole one first; given names or initials in order; folded name)."""
    if not name or not name.strip():
        return [], [], ""
    flat = " ".join(fold(name).split())
    upper = name.upper() == name
    if "," in flat:
        left, right = flat.split(",", 1)
        family = left.split()
        given = re.findall(r"[a-z0-9'-]+", right.replace(".", ". ").replace(",", " "))
        raw = re.findall(r"[^\W_]+\.?", name.split(",", 1)[1])
        if len(raw) == 1 and raw[0].rstrip(".").isupper() and len(raw[0].rstrip(".")) <= 3 and (not upper or len(raw[0].rstrip(".")) <= 2):
            given = list(fold(raw[0].rstrip(".")))
    else:
        raw = name.replace(".", ". ").split()
        words = [fold(w).strip(".") for w in raw]
        initial = [w not in PARTICLES and (len(w) == 1 or r.endswith(".") and len(w) <= 2 or r.rstrip(".").isupper() and len(w) <= (2 if upper else 3)) for w, r in zip(words, raw)]
        if len(words) > 1 and initial[-1] and not all(initial):
            k = len(words)
            while k and initial[k - 1]:
                k -= 1
            family, given = words[:k], [c for w in words[k:] for c in w]
        elif len(words) > 1 and initial[0] and not all(initial):
            k = 0
            while initial[k]:
                k += 1
            family, given = words[k:], [c for w in words[:k] for c in w]
            if len(family) > 1 and not set(family) & PARTICLES and all("-" not in w for w in family):
                pass
        else:
            k = next((i for i, w in enumerate(words) if i and w in PARTICLES), max(1, len(words) - 1))
            family, given = words[k:] or words, words[:k] if len(words) > 1 else []
            while len(given) > 1 and initial[len(given) - 1] is False and len(given) > 2:
                family = [given[-1], *family]  # three words before the last: a double family name
                given = given[:-1]
    family = [w for w in family if w.strip(".") not in SUFFIXES]
    given = [w for w in given if w not in SUFFIXES and w.strip("'-")]
    halves = [h for w in family for h in w.split("-") if h and h not in PARTICLES]
    keys = [_key(halves)] + [_key([h]) for h in halves if len(halves) > 1 and len(h) > 3]
    if "," not in flat and len(given) == 2 and len(given[1]) > 3 and len(given[0]) > 1:
        keys.append(_key([given[1], *halves]))  # "Given Half Half"
    if len(halves) == 1:
        keys += [keys[0][len(p) :] for p in ("vander", "dela", "van", "von", "dos", "di", "el") if keys[0].startswith(p) and len(keys[0]) - len(p) > 5]
    return list(dict.fromkeys(k for k in keys if len(k) > 1)), given, flat


def near_words(a: str, b: str) -> bool:
    """At most one letter or one swap apart, two for long words."""
    if a == b:
        return True
    most = 1 if min(len(a), len(b)) < 11 else 2
    if abs(len(a) - len(b)) > most:
        return False
    before, last = list(range(len(b) + 1)), None
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if last and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
        if min(row) > most:
            return False
        before, last = row, before
    return before[-1] <= most


def given_evidence(a: list[str], b: list[str]) -> float | None:
    """Agreement of given names; None where they contradict each other."""
    if not a or not b:
        return 0.2
    x, y = a[0], b[0]
    if len(x) > 1 and len(y) > 1:
        if x == y:
            score = 2.0
        elif _FORMS.get(x, set()) & _FORMS.get(y, {-1}) or near_words(x, y):
            score = 1.6
        else:
            return None
    else:
        forms = lambda w: {w[0]} | {v[0] for v, g in _FORMS.items() if g & _FORMS.get(w, {-1})}
        if not forms(x) & forms(y):
            return None
        score = 1.0 if x[0] == y[0] else 0.6
    if len(a) > 1 and len(b) > 1:
        if a[1][0] != b[1][0]:
            return None
        score += 0.7 if len(a[1]) == 1 or len(b[1]) == 1 or near_words(a[1], b[1]) else -2.0
    return score


def affiliation_words(s: str | None) -> list[str]:
    """Telling words of an affiliation: not the generic ones, nor the country after the last comma."""
    if not s:
        return []
    words = [w for w in re.findall(r"[a-z0-9]+", fold(re.split(r"[,(][^,(]*$", s)[0] if re.search(r"[,(]", s) else s)) if w not in GENERIC and len(w) > 3]
    return list(dict.fromkeys(words))


def pair_similarity(a: dict, b: dict) -> float:
    given = given_evidence(a["given"], b["given"])
    if given is None:
        return 0.0
    e = given
    if a["keys"][0] == b["keys"][0]:
        e += 1.0
    elif near_words(a["keys"][0], b["keys"][0]):
        e += 0.5
    else:
        e += 0.2
    aw, bw = a["words"], b["words"]
    same_place = any(near_words(x, y) for x in aw for y in bw) if aw and bw else None
    e += 0.0 if same_place is None else 2.0 if same_place else -1.0 if a["keyword"] and a["keyword"] == b["keyword"] else -2.0
    ak, bk = a["keyword"], b["keyword"]
    if ak and bk:
        e += 2.6 if ak == bk else 0.0 if same_place else -0.6
    if a["first"] and b["first"] and a["last"] and b["last"]:
        gap = max(a["first"], b["first"]) - min(a["last"], b["last"])
        if gap > 15 and a["first"] <= a["last"] and b["first"] <= b["last"]:
            e -= 0.7
    return 1.0 / (1.0 + math.exp(-2.0 * (e - EVIDENCE)))


def _read(df: DataFrame, id_col: str, name: str, place: str, keyword: str, first: str, last: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, places, words, f, l = (b.column(i).to_pylist() for i in range(6))
            read = [read_name(n) for n in names]
            kw = [" ".join(fold(w).split()) if w else None for w in words]
            pl = [affiliation_words(p) for p in places]
            ctx = [list(dict.fromkeys([*(f"p:{w}" for w in p), *([f"k:{k}"] if k else []), *([f"g:{g[0]}"] if g and len(g[0]) > 1 else [])])) for p, k, (_, g, _) in zip(pl, kw, read)]
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[0] for r in read], strings), pa.array([r[1] for r in read], strings), pa.array(pl, strings), pa.array(kw, pa.string()), pa.array(f, pa.int32()), pa.array(l, pa.int32()), pa.array(ctx, strings)], ["id", "keys", "given", "words", "keyword", "first", "last", "ctx"])

    cols = [F.col(id_col).cast("long").alias("id"), F.col(name), F.col(place), F.col(keyword), F.col(first).cast("int"), F.col(last).cast("int")]
    return spread(df.select(*cols)).mapInArrow(read, "id long, keys array<string>, given array<string>, words array<string>, keyword string, first int, last int, ctx array<string>").where(F.size("keys") > 0)


def _letters_left(key: str) -> list[str]:
    """key with up to 2 letters left out, 3 from 11 letters on: keys so many edits apart have one of these in common."""
    out = {key}
    last = out
    for _ in range(2 if len(key) < 11 else 3):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return list(out)


def _close_keys(keys: DataFrame) -> DataFrame:
    """x < y: all pairs of distinct keys that near spelling allows, met by what is left of them without some letters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_letters_left(k) for k in b.column(0).to_pylist()], pa.list_(pa.string()))], ["key", "left"])

    # hashes that fall together only add candidates
    each = keys.select("key").mapInArrow(cut, "key string, left array<string>").select("key", F.explode("left").alias("h")).select("key", F.xxhash64("h").alias("h"))
    lists = each.groupBy("h").agg(F.array_sort(F.collect_list("key")).alias("k")).where(F.size("k") > 1)
    met = lists.select(F.posexplode("k").alias("i", "x"), "k").select("x", F.explode(F.slice("k", F.col("i") + 2, F.size("k"))).alias("y")).where("x < y")
    shorter = F.least(F.length("x"), F.length("y"))
    return met.where((F.abs(F.length("x") - F.length("y")) <= 2) & (F.levenshtein("x", "y") <= F.when(shorter < 11, 2).otherwise(3))).distinct()


def family_links(keys: DataFrame, cosine: float = COSINE) -> DataFrame:
    """x, y (both ways, x = y included) of distinct family keys (column key) by 3-gram cosine, and near in edit distance."""
    padded = F.concat(F.lit("__"), F.col("key"), F.lit("_"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))
    each = keys.select("key", F.explode(grams).alias("gram"))
    n = keys.count()
    df = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    weighed = each.join(df, "gram").withColumn("w", F.log(F.lit(float(n + 1)) / F.col("df")) + 0.05)
    own = Window.partitionBy("key")
    unit = weighed.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own)))
    vector = materialize(unit.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("v")), "grams")
    both = _close_keys(vector).join(vector.withColumnsRenamed({"key": "x", "v": "vx"}), "x").join(vector.withColumnsRenamed({"key": "y", "v": "vy"}), "y")
    dot = F.aggregate(F.map_keys("vx"), F.lit(0.0), lambda s, g: s + F.coalesce(F.col("vx")[g] * F.try_element_at("vy", g), F.lit(0.0)))
    good = both.where(dot >= cosine).select("x", "y")
    return good.union(good.select("y", "x")).union(keys.select("key", "key"))


def link_names(df: DataFrame, id_col: str, name: str, place: str, keyword: str, first: str, last: str) -> DataFrame:
    """id, person (an id of the group): every row with a readable name."""
    people = materialize(_read(df, id_col, name, place, keyword, first, last), "people")
    keyed = people.select("id", F.explode("keys").alias("key"), "ctx")
    links = materialize(family_links(keyed.select("key").distinct()), "links")
    spots = keyed.select("key", F.explode("ctx").alias("c"), "id")
    near = lambda rows: rows.join(links, F.col("key") == F.col("x")).select(F.col("y").alias("key"), "c", F.col("id").alias("a")).distinct()
    pairs = near(spots).join(spots.withColumnRenamed("id", "b"), ["key", "c"]).select("a", "b")
    # rows with neither place nor keyword have only their names to meet by: all first two initials of theirs
    initials = F.concat(F.substring(F.col("given")[0], 1, 1), F.substring(F.col("given")[1], 1, 1))
    named = people.where(F.size("given") > 1).select("id", F.explode("keys").alias("key"), initials.alias("c"), ((F.size("words") == 0) & F.col("keyword").isNull()).alias("bare"))
    pairs = pairs.union(near(named.where("bare").select("key", "c", "id")).join(named.select("key", "c", F.col("id").alias("b")), ["key", "c"]).select("a", "b"))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    facts = F.struct("keys", "given", "words", "keyword", "first", "last")
    wide = pairs.join(people.select(F.col("id").alias("a"), facts.alias("fa")), "a").join(people.select(F.col("id").alias("b"), facts.alias("fb")), "b")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = [pair_similarity(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim, pa.float64())], ["a", "b", "sim"])

    edges = wide.select("a", "b", "fa", "fb").mapInArrow(score, "a long, b long, sim double")
    found = linkage.average_linkage(edges, LINK)
    return people.select("id").join(found, "id", "left").select("id", F.coalesce("cluster", "id").alias("person"))


def person_pairs(linked: DataFrame) -> DataFrame:
    """name_id_a < name_id_b for all pairs within a person (a person's spellings are few)."""
    a, b = linked.select("person", F.col("id").alias("name_id_a")), linked.select("person", F.col("id").alias("name_id_b"))
    return a.join(b, "person").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
