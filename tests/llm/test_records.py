import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.llm import matching, names

PEOPLE = [("Ravenholt", "Katherine", "B"), ("Ostrander", "William", "J"), ("Quillfeather", "Nikolai", "R"), ("Marlowski", "Elizabeth", "T"), ("Ravenholt", "Thomas", "K")]
PLACES = ["Univ of Brennick, Hollmark, Norway", "Institute of Tarvos, Elmhollow, Chile", "Pelham Academy of Sciences, Dunwick, Peru", "Corvale Medical School, Astermere, Kenya", "National Centre of Ilvermoor, Saltfen, Egypt"]

NUMBERS = "amber basil cedar delta ember fjord grove haven inlet jetty knoll lagoon marsh narrow oasis pearl quartz ridge shoal tidal".split()


def test_reading():
    assert names.read_name("Smith, J.R.")[:2] == (["smith"], ["j", "r"])
    assert names.read_name("J. R. van der Smith")[:2] == (["smith"], ["j", "r"])
    assert names.read_name("Smith GR")[1] == ["g", "r"]
    assert names.read_name("Smith-Jones, Ann")[0] == ["smithjones", "smith", "jones"]
    assert names.read_name("Noritrøt, N")[0] == names.read_name("Noritroet, N")[0]
    assert names.read_name(None)[0] == [] and names.read_name("  ")[0] == []
    assert names.near_words("branuasak", "branuask") and names.near_words("zoran", "zorna") and not names.near_words("zoran", "zenan")


def test_variants(spark):
    rows, truth, k = [], {}, 0
    short = {"Katherine": "Kate", "William": "Bill", "Nikolai": "Kolya", "Elizabeth": "Liz", "Thomas": "Tom"}
    for p, (family, given, middle) in enumerate(PEOPLE):
        typo = family[:4] + family[5] + family[4] + family[6:]
        for form in (f"{family}, {given} {middle}.", f"{given} {family}", f"{family} {given[0]}{middle}", f"{family.upper()}, {given.upper()}", f"{family}, {short[given]}", f"{given} {typo}"):
            rows.append((k, form, PLACES[p] if k % 4 else None, f"field {p}", 2000, 2005))
            truth[k] = p
            k += 1
    # the same name elsewhere in another line of work is another person
    for extra in range(2):
        rows.append((k, "Ravenholt, Katherine", "Zimbrook State University, Farrow, Japan", "other work", 2001, 2004))
        truth[k] = 99
        k += 1
    rows += [(500, None, None, None, None, None), (501, " ", None, None, None, None), (502, "Solo, Han", None, None, None, None)]
    df = spark.createDataFrame([r + ("a", 1) for r in rows], "name_id long, author_name string, affiliation string, top_keyword string, first_year int, last_year int, id string, key int")
    link = lambda x: names.link_names(x, "name_id", "author_name", "affiliation", "top_keyword", "first_year", "last_year")
    got = {(r.name_id_a, r.name_id_b) for r in names.person_pairs(link(df)).collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert got == want
    assert link(df.limit(0)).count() == 0
    twice = df.where("name_id < 6").union(df.where("name_id = 0").withColumn("name_id", F.lit(77).cast("long")))
    assert {(r.name_id_a, r.name_id_b) for r in names.person_pairs(link(twice)).collect()} >= {(0, 77), (0, 1)}


def test_close_family_names_meet_without_all_pairs(spark):
    """The links are those of all pairs compared; keys that share grams but are no slip of the pen apart never meet."""
    rng = random.Random(9)
    words = {"".join(rng.choice(["ra", "ven", "holt", "mar", "lo", "ski", "qu", "il"]) for _ in range(rng.randrange(2, 6))) for _ in range(160)}
    words |= {w[:2] + w[3:] for w in list(words)[:40]} | {w[:3] + "x" + w[4:-1] + "z" for w in list(words)[40:80]}
    keys = spark.createDataFrame([(w,) for w in sorted(words)], "key string").cache()
    close = keys.alias("a").join(keys.alias("b"), F.col("a.key") < F.col("b.key")).select(F.col("a.key").alias("x"), F.col("b.key").alias("y"))
    close = close.where((F.abs(F.length("x") - F.length("y")) <= 2) & (F.levenshtein("x", "y") <= F.when(F.least(F.length("x"), F.length("y")) < 11, 2).otherwise(3)))
    want = {tuple(r) for r in close.collect()}
    got = [tuple(r) for r in names._close_keys(keys).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    links = {tuple(r) for r in names.family_links(keys).collect() if r.x < r.y}
    assert links and links <= want


def _works(n, rng):
    topics = [a + " " + b for a in ("coral", "solar", "tensile", "wage", "jury", "neural", "forest", "vaccine") for b in ("growth", "cells", "strength", "gap", "selection", "response")]
    out = []
    for i in range(n):
        t = rng.sample(topics, 2)
        place = "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(4))
        out.append({"title": f"On the link between {t[0]} and {t[1]}: the {place.title()} study", "doi": f"10.9999/{i * 7919:06d}", "year": rng.randrange(1990, 2020), "authors": f"{place[:5].title()}son, A.; {place[2:].title()}berg, C.", "source": f"Journal of {t[0].split()[0].title()} {place[:4]}", "kw": ";".join(rng.sample(topics, 3))})
    return out


def test_matching(spark):
    rng = random.Random(2)
    works = _works(150, rng)
    left, right, want = [], [], set()
    for i, w in enumerate(works):
        left.append((i, w["title"], w["doi"] if i % 3 else f"ID_{i}", str(w["year"]), w["authors"], w["source"], w["kw"]))
        for copy in range(1 + (i % 10 == 0)):
            j = 1000 + i * 10 + copy
            t = w["title"]
            t = [t.upper(), t.replace("On the", "<i>On</i> the"), t.split(":")[0], t[:20] + t[21:], t + "."][i % 5]
            right.append((j, t, None if i % 4 == 0 else "https://doi.example/" + w["doi"], f"{w['year'] + (i % 7 == 0)}", w["authors"] if i % 6 else None, w["source"], w["kw"].upper()))
            want.add((i, j))
    for i in range(0, 150, 15):  # works of their own
        w = works[i]
        right.append((5000 + i, "Correction to: " + w["title"], f"10.9999/c{i}", str(w["year"] + 1), w["authors"], w["source"], w["kw"]))
        right.append((6000 + i, "Editorial", f"10.9999/e{i}", "2001", f"Head{i}, X.", f"J{i}", None))
        left.append((7000 + i, "Editorial", f"10.9999/x{i}", "2003", f"Other{i}, Y.", f"K{i}", None))
    left += [(8000, None, None, None, None, None, None), (8001, "", "", "", "", "", "")]
    right += [(8002, None, None, None, None, None, None)]
    schema = "k long, t string, d string, y string, au string, so string, kw string"
    c = F.col
    make = lambda rows, side: matching.fields(spark.createDataFrame(rows, schema), "k", side, c("t"), c("d"), c("y"), c("au"), c("so"), c("kw"))
    rows = matching.match_records(make(left, 0), make(right, 1)).collect()
    got = {(r.a, r.b) for r in rows}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) == 0
    assert all(0 <= r.confidence <= 1 for r in rows)
    assert matching.match_records(make(left, 0).limit(0), make(right, 1).limit(0)).count() == 0
    assert matching.match_records(make(left, 0), make(right, 1).limit(0)).count() == 0


@pytest.mark.parametrize("tile", [500, 7])
def test_no_key_is_cut(spark, tile, monkeypatch):
    monkeypatch.setattr(matching, "TILE", tile)
    left, right, want = [], [], set()
    for i in range(20):  # one heading; only year, source and a keyword are shared
        left.append((i, "Editorial", None, str(1990 + i), f"{NUMBERS[i]}son, A.", f"Journal {i}", NUMBERS[i]))
        right.append((100 + i, "Editorial", None, str(1990 + i), None, f"Journal {i}", f"{NUMBERS[i]}; {NUMBERS[i - 1]} {NUMBERS[i - 2]} of long lists and other things {i}"))
        want.add((i, 100 + i))
    for i in range(20):  # titles that begin alike; one side breaks off, its other fields are null
        head = "On the slow growth of coral reefs near "
        left.append((200 + i, f"{head}{NUMBERS[i]} islands", None, str(1990 + i), f"Author{i}son, A.", f"Annals {i}", "coral"))
        right.append((300 + i, f"{head}{NUMBERS[i]} islands: a survey of {NUMBERS[-i]} sites by divers and boats over many long years", None, str(1990 + i), None, None, None))
        want.add((200 + i, 300 + i))
    few = [{k: dict(zip(("title", "doi", "year", "makers", "source", "words"), matching.features(*r)[:6])) | {"doi": "", "stock": r[0] == "Editorial"} for k, *r in rows} for rows in (left, right)]
    passes = {(a, b) for a, x in few[0].items() for b, y in few[1].items() if matching.pair_evidence(x, y) >= matching.EVIDENCE}
    for i, w in enumerate(_works(300, random.Random(8))):  # others, for the fit
        left.append((1000 + i, w["title"], w["doi"], str(w["year"]), w["authors"], w["source"], w["kw"]))
    schema = "k long, t string, d string, y string, au string, so string, kw string"
    c = F.col
    make = lambda rows, side: matching.fields(spark.createDataFrame(rows, schema), "k", side, c("t"), c("d"), c("y"), c("au"), c("so"), c("kw"))
    rows = matching.match_records(make(left, 0), make(right, 1)).collect()
    got = [(r.a, r.b) for r in rows]
    assert len(got) == len(set(got))
    assert want <= passes and set(got) == passes


def test_bounds_lose_no_pair():
    rng = random.Random(4)
    titles = ["editorial", "letetr to the editor", "letter to the editor", "on the slow growth of coral reefs near amber", "on the slow growth of coral reefs near amber islands", "on the slow growth of wages", ""]
    pick = lambda names, k: rng.sample(names, rng.randrange(k))
    row = lambda: {"title": rng.choice(titles), "doi": rng.choice(["", "109999ab", "109999abc", "109999xyz"]), "year": rng.choice([0, 1990, 1991, 1993]), "makers": pick(["anderson", "andersen", "brook", "clarke"], 3), "source": rng.choice(["", "j maps", "j mapss", "annals"]), "words": pick(NUMBERS[:5], 4)}
    x, y = [[r | {"stock": r["title"] in titles[:3:2]} for r in (row() for _ in range(120))] for _ in range(2)]
    u, v = (a.ravel() for a in np.indices((120, 120)))
    passes = {(i, j) for i in range(120) for j in range(120) if matching.pair_evidence(x[i], y[j]) >= matching.EVIDENCE}
    possible = set(matching._possible(x, y, u, v))
    assert passes and passes <= possible and len(possible) < 0.5 * len(u)


def test_a_tile_is_bounded_as_a_whole(monkeypatch):
    """Titles that begin alike over unlike makers: few pairs of a tile are compared one by one, and none that passes is lost."""
    rng = random.Random(6)
    row = lambda: {"title": f"on the slow growth of coral reefs near {rng.choice(NUMBERS)} {rng.choice(NUMBERS)}", "doi": f"109999{rng.randrange(10**6):06d}", "year": rng.randrange(1990, 2020), "makers": sorted("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3)), "source": rng.choice(NUMBERS), "words": rng.sample(NUMBERS, 4), "stock": False}
    x = [row() for _ in range(120)]
    y = [r | {"title": r["title"].replace("coral", "corla"), "makers": [w[:3] + w[4] + w[3] + w[5:] for w in r["makers"]]} for r in x[:60]] + [row() for _ in range(60)]
    u, v = (a.ravel() for a in np.indices((120, 120)))
    passes = {(i, j) for i in range(120) for j in range(120) if matching.pair_evidence(x[i], y[j]) >= matching.EVIDENCE}
    calls, plain = [], matching.title_evidence
    monkeypatch.setattr(matching, "title_evidence", lambda *a: calls.append(a) or plain(*a))
    assert len(passes) >= 60 and passes <= set(matching._possible(x, y, u, v)) and len(calls) < 0.05 * len(u)


def test_titles():
    same = matching.title_evidence
    p = matching.plain
    assert same(p("Mapping wage gap research in Oslo, 1990-2000"), p("MAPPING WAGE GAP RES. IN OSLO, 1990–2000")) > 0
    assert same(p("Wage gap in Oslo. Part I"), p("Wage gap in Oslo. Part II")) == -9
    assert same(p("Reply to: Wage gap in Oslo"), p("Wage gap in Oslo")) == -9
    assert same(p("Wage gap in Oslo: a study"), p("Trade balance in Rome: a study")) < 0
    assert same(p("Editorial"), p("Editorial")) == 0


def test_slips_in_headings():
    p = matching.plain
    assert matching.title_evidence(p("Letetr to the editor"), p("Letter to the editor"), True) == 0
    assert matching.title_evidence(p("Letter to the author"), p("Letter to the editor"), True) == -9
    same = {"title": p("Letetr to the editor"), "doi": "109999x", "year": 2018, "makers": ["doe"], "source": "", "words": [], "stock": False}
    assert matching.pair_evidence(same, same | {"title": p("Letter to the editor"), "stock": True}) >= matching.EVIDENCE


def test_headings_are_found_and_copies_are_not(spark):
    """A title over unlike makers is a heading; copies of a work, whose makers are alike, make none."""
    rows = [("editorial", f"maker{i}") for i in range(matching.UNLIKE)] + [("on coral reefs", "doe smith")] * 40 + [("", f"maker{i}") for i in range(9)] + [("notes", "")] * 9
    signed = spark.createDataFrame([("\x1f".join((t, "", "", m, "", "")),) for t, m in rows], "fact string")
    assert [r.title for r in matching.stock_headings(signed).collect()] == ["editorial"]


def test_vectors_come_from_the_walks():
    """Tokens that walks join come nearer; without walks the vectors are random."""
    works = [matching.features(w["title"], w["doi"], str(w["year"]), w["authors"], w["source"], w["kw"])[6] for w in _works(200, random.Random(3))]
    plain, trained = matching.Model(works, walks=0), matching.Model(works, walks=20_000)
    same = lambda m: (m.vec * plain.vec).sum(1) / (np.linalg.norm(m.vec, axis=1) * np.linalg.norm(plain.vec, axis=1))
    assert np.allclose(same(plain), 1, atol=1e-4) and np.median(same(trained)[np.unique(matching._tokens([w[0] for w in works])[0])]) < 0.9


def _fact_rows(works):
    """Facts as matching writes them, and the views of each."""
    rows = [matching.features(w["title"], w["doi"], str(w["year"]), w["authors"], w["source"], w["kw"]) for w in works]
    return ["\x1f".join((r[0], r[1] or "", str(r[2] or ""), " ".join(r[3]), r[4], " ".join(r[5]))) for r in rows], [r[6] for r in rows]


def test_the_model_is_of_all_records(spark, monkeypatch):
    """Beyond 12,000 records too, rarity, centre and width are those of every record."""
    works = _works(7000, random.Random(12))
    models, plain = [], matching._sign
    monkeypatch.setattr(matching, "_sign", lambda rows, model: models.append(model) or plain(rows, model))
    rows = spark.createDataFrame([(i, w["title"], w["doi"], str(w["year"]), w["authors"], w["source"], w["kw"]) for i, w in enumerate(works)], "k long, t string, d string, y string, au string, so string, kw string")
    left, right = (matching.fields(x, "k", side, *(F.col(c) for c in ("t", "d", "y", "au", "so", "kw"))) for side, x in ((0, rows), (1, rows)))
    assert {(r.a, r.b) for r in matching.match_records(left, right).collect()} >= {(i, i) for i in range(7000)}
    views = _fact_rows(works)[1] * 2
    want = np.zeros(matching.BUCKETS)
    for v in views:
        want[np.unique(matching._tokens(list(v[:4]))[0])] += 1
    assert np.allclose(models[0].weight, np.maximum(np.log((len(views) + 2) / (want + 1)), 0.05), atol=1e-5)
    for v in range(len(matching.VIEWS)):
        assert np.allclose(models[0].mean[v], models[0]._units([r[v] for r in views]).mean(0), atol=1e-4)


def test_every_record_walks_whatever_the_parts(spark, monkeypatch):
    """Each record starts a walk; walks go on at records with the token; division of the rows into tasks doesn't change the model."""
    facts, views = _fact_rows(_works(600, random.Random(5)))
    h = np.arange(600, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tokens, hashes = matching.draws(views, h, 2, 6)
    assert tokens.shape == (1200, 6) and (tokens >= 0).all()
    own = [set(matching._tokens(list(v[:4]))[0].tolist()) for v in views]
    assert all(set(t) <= own[i // 2] for i, t in enumerate(tokens.tolist()))
    crossed = matching.cross(tokens, hashes)
    step = lambda x: sorted(zip(x[:, :-1].ravel().tolist(), x[:, 1:].ravel().tolist()))
    assert (np.sort(crossed, 0) == np.sort(tokens, 0)).all() and step(crossed) == step(tokens) and (crossed != tokens).any(1).mean() > 0.5
    monkeypatch.setattr(matching, "PART_ROWS", 300)
    rows = spark.createDataFrame([(i, i % 2, f) for i, f in enumerate(facts)], matching.FACTS)
    one, many = (matching.fit_model(rows.repartition(k), 600, 16, walks=20_000) for k in (1, 5))
    assert np.allclose(one.vec, many.vec, atol=1e-5) and all(np.allclose(a, b, atol=1e-2) for a, b in zip(one.planes, many.planes))
    still = matching.fit_model(rows, 600, 16, walks=0)
    cosine = (one.vec * still.vec).sum(1) / (np.linalg.norm(one.vec, axis=1) * np.linalg.norm(still.vec, axis=1))
    assert np.median(cosine[sorted(set().union(*own))]) < 0.95


def test_confidence_is_of_all_pairs(spark):
    """The curve over a table is that over all its rows in memory, none held out."""
    rng = np.random.default_rng(7)
    x = np.stack([rng.uniform(-0.2, 1, 3000), rng.uniform(-6, 7, 3000), np.ones(3000)], 1)
    same = (rng.random(3000) < 1 / (1 + np.exp(-(6 * x[:, 0] + x[:, 1] - 5)))).astype(float)
    known = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b, _), c in zip(x, same)], "cosine double, rest double, same double")
    assert np.allclose(matching._logistic(matching._table_sums(known)), matching._logistic(matching._array_sums(x, same)), atol=1e-6)
    assert np.allclose(matching._logistic(matching._table_sums(known.limit(0))), matching.PRIOR)
    assert matching.match_pairs(*(matching.fields(known.limit(0).selectExpr("1 id", "'' s"), "id", k, *[F.col("s")] * 6) for k in (0, 1))).columns == ["a", "b"]


def test_calibration_holds_on_held_out_pairs():
    rng = np.random.default_rng(1)
    cosine, rest = rng.uniform(-0.2, 1, 4000), rng.uniform(-6, 7, 4000)
    same = (rng.random(4000) < 1 / (1 + np.exp(-(6 * cosine + rest - 5)))).astype(float)
    held = rng.random(4000) < 0.5
    w, error = matching.calibrate(cosine, rest, same, held)
    assert error < 0.12 and np.allclose(w, (6, 1, -5), atol=1.2)
    assert np.isfinite(matching.calibrate(cosine[:0], rest[:0], same[:0], held[:0])[0]).all()


def test_rows_without_context(spark):
    """Neither affiliation nor keyword, and no full given name: two equal initials link, one doesn't."""
    rows = [(1, "Ravenholt, K. B.", None, None), (2, "Ravenholt, K. B.", "", None), (3, "Ravenholt, K. T.", None, None), (4, "Marlowski, E.", None, None), (5, "Ravenholt, K.B.", "Univ of Brennick, Hollmark, Norway", "maps")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "i long, n string, a string, k string, f int, l int")
    got = {(r.name_id_a, r.name_id_b) for r in names.person_pairs(names.link_names(df, "i", "n", "a", "k", "f", "l")).collect()}
    assert got == {(1, 2), (1, 5), (2, 5)}
