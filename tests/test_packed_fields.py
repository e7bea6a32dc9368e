"""Segmentation of packed fields: micro cases, planted lists, edge rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.operators import packed_fields as P

CASES = [
    ("a b; c d", False, ["a b", "c d"]),
    ("；x y；；z w； ", False, ["x y", "z w"]),
    ('"law; sources of"; wage gap', False, ["law; sources of", "wage gap"]),
    ('"""grey"" literature" | x', False, ['"grey" literature', "x"]),
    ('so-called "hot" papers;x', False, ['so-called "hot" papers', "x"]),
    ('["a b", "c, d"]', False, ["a b", "c, d"]),
    ("research &amp; development;census  roll", False, ["research &amp; development", "census  roll"]),
    ("growth &#38; decay / x", False, ["growth &#38; decay", "x"]),
    ("time/space trade-off / x", False, ["time/space trade-off", "x"]),
    ("maps, cognitive; x", False, ["maps, cognitive", "x"]),
    ("a b, c d,e f", False, ["a b", "c d", "e f"]),
    ("a\r\nb\r\n", False, ["a", "b"]),
    ("x • y；z", False, ["x", "y", "z"]),
    ("  ", False, []),
    (None, False, []),
    ("", True, []),
    (";;;", True, []),
    ("Doe, Jane", True, ["Doe, Jane"]),
    ("Doe, J.H., Roe, B.", True, ["Doe, J.H.", "Roe, B."]),
    ("de la Cruz, Ana Maria", True, ["de la Cruz, Ana Maria"]),
    ('"Doe, Jane","Roe, R."', True, ["Doe, Jane", "Roe, R."]),
    ("Jane Doe and Roe R", True, ["Jane Doe", "Roe R"]),
    ("DOE J., and Rex Roe", True, ["DOE J.", "Rex Roe"]),
    ("Doe LR,J. A. Roe", True, ["Doe LR", "J. A. Roe"]),
    ("Doe Jr, Jane; Roe, R.", True, ["Doe Jr, Jane", "Roe, R."]),
]


@pytest.mark.parametrize("cell,names,want", CASES)
def test_cells(cell, names, want):
    assert P.segment(cell, (), names) == want


def test_dictionary_protects_commas():
    known = {"maps, cognitive", "supply, demand and price"}
    assert P.segment("coral reef, maps, cognitive, wage gap", known) == ["coral reef", "maps, cognitive", "wage gap"]
    assert P.segment("supply, demand and price", known) == ["supply, demand and price"]
    assert P.segment("coral reef, wage gap", known) == ["coral reef", "wage gap"]


words = st.text("abcdefghijklmnop", min_size=2, max_size=8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words).map(" ".join), min_size=1, max_size=8), st.sampled_from(["; ", " | ", "\n", "\t", " • ", "；"]))
def test_round_trip(values, mark):
    assert P.segment(mark.join(values)) == values
    assert P.segment(mark.join(f'"{v}"' for v in values)) == values


def test_operator(spark):
    rows = [(1, "Doe, J.; Roe, R.", "a b;a b", "x, y"), (2, None, "", "  "), (3, "Doe, J.", '"x, y"; c d', "x, y; k"), (3, "Doe, J.", '"x, y"; c d', "x, y; k"), (4, "; ".join(f"N{i}ame, A." for i in range(3000)), None, "w v, x, y")]
    df = spark.createDataFrame([r + ("z", 9) for r in rows], "rec_id long, authors string, author_keywords string, index_keywords string, item string, pos int")
    got = sorted((r.rec_id, r.field_name, r.pos, r.item) for r in P.split_packed_scopus(df).collect())
    assert (1, "author_keywords", 2, "a b") in got and (1, "index_keywords", 1, "x, y") in got and (4, "index_keywords", 2, "x, y") in got
    assert sum(r[0] == 4 and r[1] == "authors" for r in got) == 3000 and got.count((3, "authors", 1, "Doe, J.")) == 2
    # blocks of one entry give the same
    assert sorted((r.rec_id, r.field_name, r.pos, r.item) for r in P.split_packed(df, "rec_id", ["authors", "author_keywords", "index_keywords"], block_chars=1).collect()) == got
    assert P.split_packed_scopus(df.limit(0)).count() == 0


def test_large_cell_is_whole():
    random.seed(1)
    values = [f"w{random.randrange(10**6)} v" for _ in range(20_000)]
    assert P.segment(";".join(values)) == values


def test_names_by_the_dictionary(spark):
    """A name that stands whole between strong marks elsewhere stays whole in a comma cell; without it the form of names decides."""
    whole = "Garcia Marquez, Gabriel Jose"
    rows = [(1, f"{whole}; Doe, Jane"), (2, f"Roe, Rex; {whole}"), (3, f"{whole}, Doe, J.")]
    cut = lambda r: {x.rec_id: x["items"] for x in P.packed_names(spark.createDataFrame(r, "rec_id long, authors string"), "rec_id", "authors").collect()}
    assert cut(rows)[3] == [whole, "Doe, J."]
    assert cut(rows[2:])[3] == ["Garcia Marquez", "Gabriel Jose", "Doe, J."]


def test_long_values_with_many_commas(spark):
    long = "effects, of a, on b, on c, on d, on e, and on " + "f" * 300
    rows = [(1, f"{long}; maps"), (2, f"{long}; nets"), (3, f"maps, {long}, nets")]
    got = [r.item for r in P.split_packed(spark.createDataFrame(rows, "rec_id long, kw string"), "rec_id", ["kw"]).where("rec_id = 3").orderBy("pos").collect()]
    assert got == ["maps", long, "nets"]
