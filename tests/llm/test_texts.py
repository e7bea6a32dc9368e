import random

import pytest

from quillmap.llm import leakage, subjects
from quillmap.llm import tokenization as tok

TEXTS = [None, "", " ", "Hello world", "Hello world", "l'été — ça va?\n\n  tabs\tand  blanks ", "中文字符 と 日本語", "<|endoftext|> is text", "a" * 5000, "x y " * 30_000, "\u0000​﻿ ok", "1234567890 3.14e-10", "don't we'll I'd"]


@pytest.mark.parametrize("head", [0, 3, 50_000])
def test_ids_against_direct_encoding(spark, head):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(0, None, "x", 1)], "doc_id long, text string, word string, row int")
    t = tok._tokenizer("/opt/tokenizers/byte_bpe_50k.json")
    rows = tok.encode(df, "doc_id", "text", head_words=head).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want = TEXTS[r.doc_id] and t.encode(TEXTS[r.doc_id], add_special_tokens=False).ids
        assert r.ids == (want or [])
    assert tok.encode(df.limit(0), "doc_id", "text").count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in tok.decode(tok.encode(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


NAMES = "Varo Mirle Kestin Ombra Tulsek Pradi Helmor Quista Zendar Luvin Orpek Sadira Timol Brexa Corvin Delpho".split()


def item(rng):
    a, b, c, d = rng.sample(NAMES, 4)
    n = [rng.randrange(100, 999) for _ in range(5)]
    return f"Read the passage below and choose the best answer. When the {a}holm commission counted {n[0]} records in {n[1]}, its clerk {b}ta noted that {c.lower()} growth had outrun {d.lower()} rate by {n[2]} points. Three letters from {d}burg to {a}dorf quarrel over {b.lower()} tax: {n[3]}, {n[4]} or none at all? Who but {c}ford kept the ledger of {a}mont and {b}wick together?"


def test_leaks(spark, monkeypatch):
    rng = random.Random(1)
    items = [(i, item(rng)) for i in range(40)] + [(90, None), (91, ""), (92, "Read the passage below and choose the best answer.")]
    filler = lambda: " ".join(f"Data on {rng.choice(NAMES).lower()} yield were collected at {rng.randrange(100, 999)} sites near {rng.choice(NAMES)}ton." for _ in range(6))
    w = [x.split() for _, x in items[:40]]
    cyr = str.maketrans({"a": "а", "e": "е", "o": "о", "c": "с"})
    cases = {
        1: (0, items[0][1]),
        2: (1, items[1][1].upper().replace(",", "")),
        3: (2, " ".join(f"<b>{x}</b>" if i % 5 == 0 else x for i, x in enumerate(w[2]))),
        4: (3, " ".join(w[3][10:50])),
        5: (4, " ".join(w[4][30:58]) + " " + filler() + " " + " ".join(w[4][8:30])),
        6: (5, "\n> ".join(" ".join(w[5][i : i + 6]) for i in range(0, len(w[5]), 6))),
        7: (6, items[6][1].translate(cyr)),
        8: (7, " ".join(x for i, x in enumerate(w[7]) if i % 9 != 4)),
        9: (8, items[8][1].replace("commission", "com-\nmission").replace("quarrel", "quarr​el")),
    }
    docs = [(k, f"{filler()} {t} {filler()}") for k, (_, t) in cases.items()]
    docs += [(20, filler()), (21, None), (22, ""), (23, filler() + " Read the passage below and choose the best answer. " + filler()), (24, filler() + " " + item(random.Random(99))), (25, filler() + " " + " ".join(w[9][12:22]) + " " + filler()), (26, filler() * 200 + items[10][1])]
    d = spark.createDataFrame([r + (5, "q") for r in docs], "doc_id long, text string, item_id int, covered string")
    i = spark.createDataFrame(items, "item_id long, item_text string")
    want = {(k, n) for k, (n, _) in cases.items()} | {(26, 10)}
    for sent in (2_000_000, 3):  # small sides sent, or joined by shuffles: the same rows
        monkeypatch.setattr(leakage, "SENT_ROWS", sent)
        assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", i, "item_id", "item_text").collect()} == want
    assert leakage.find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "item_text").count() == 0


def test_short_and_repeated_items(spark):
    """Items of three or four words need all of them in order; items of equal words are found alike; a sentence of many items is stock."""
    shared = "All clerks of the northern office signed the ledger twice."
    items = [(1, "Quista zendar luvin orpek"), (2, "Brexa corvin delpho"), (3, "two words"), (4, shared), (5, shared + " Sadira timol found the luvin orpek helmor notes."), (6, "varo Mirle, kestin ombra tulsek pradi helmor!"), (7, "Varo mirle kestin ombra tulsek pradi helmor")]
    docs = [(1, "On quista zendar luvin orpek it says"), (2, "quista zendar it luvin says orpek"), (3, "a brexa corvin delpho b"), (4, "two words"), (5, "x " + shared), (6, "So varo mirle kestin ombra tulsek pradi helmor ended"), (6, "other text of that id")]
    i, d = spark.createDataFrame(items, "item_id long, item_text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", i, "item_id", "item_text").collect()}
    assert got == {(1, 1), (3, 2), (6, 6), (6, 7)}


def test_subjects(spark):
    rng = random.Random(3)
    areas = {s: [f"{s[:2]}{a} {s[-2:]}{b}" for a, b in (("vore", "lin"), ("mata", "sorn"), ("kile", "pand"), ("rumo", "tisk"))] for s in ("law", "sport", "physics", "history", "medicine")}
    meta = ["The map holds {} items in clusters.", "A healthy network shows few isolated nodes after {} steps.", "Each school of thought in the corpus forms clusters of {} nodes."]
    sentence = lambda s: f"Results for {rng.randrange(9, 99)} units suggest that {rng.choice(areas[s])} limits {rng.choice(areas[s])} on average."
    docs, labels, truth = [], [], {}
    for k in range(600):
        own = rng.sample(sorted(areas), rng.choice([0, 1, 1, 2]))
        parts = [sentence(s) for s in own for _ in range(4)] + [rng.choice(meta).format(rng.randrange(9, 99)) for _ in range(4)]
        if len(own) == 1:  # a lone passing sentence of another area in a longer text
            parts += [sentence(own[0]) for _ in range(4)] + [sentence(rng.choice(sorted(areas)))]
        docs.append((k, " ".join(rng.sample(parts, len(parts))), "law", 0.5))
        truth[k] = set(own)
        if k % 3 == 0:
            labels += [(k, s.upper() if k % 2 else s + " ") for s in own]
    docs += [(900, None, "", 0.0), (901, "", "", 0.0), (902, "!!!", "", 0.0)]
    labels += [(1, None), (2, "zzz"), (0, "histry" if "history" in truth[0] else "zz")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string, share double")
    l = spark.createDataFrame(labels, "doc_id long, subject string")
    s = spark.createDataFrame([(a,) for a in areas], "subject string")
    got = {}
    for r in subjects.assign(d, "doc_id", "text", l, s).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(k, set()) == v for k, v in truth.items()) >= 585 and not set(got) & {900, 901, 902}
    assert subjects.assign(d, "doc_id", "text", l.limit(0), s).count() == 0 and subjects.assign(d.limit(0), "doc_id", "text", l, s).count() == 0


def test_terms_of_unlabelled_documents(spark, monkeypatch):
    """Terms that no labelled document holds are learnt from assigned ones, however few documents the fit takes."""
    rng = random.Random(5)
    first = {s: [f"{s[:2]}{a} {s[-2:]}{b}" for a, b in (("vore", "lin"), ("mata", "sorn"), ("kile", "pand"))] for s in ("law", "sport", "physics", "history")}
    second = {s: [f"{s[:2]}{a} {s[-2:]}{b}" for a, b in (("zuno", "quer"), ("wexa", "durn"), ("jipo", "gelt"))] for s in first}
    say = lambda a, b: f"Results for {rng.randrange(9, 99)} units suggest that {rng.choice(a)} limits {rng.choice(b)} on average."
    docs, labels = [], []
    for k in range(480):
        s = sorted(first)[k % 4]
        a, b = (first, first) if k < 160 else (first, second) if k < 400 else (second, second)  # labelled, between, without any term of the labels
        docs.append((k, " ".join(say(a[s], b[s]) for _ in range(6))))
        if k < 160:
            labels.append((k, s))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    monkeypatch.setattr(subjects, "FIT_DOCS", 160)
    got = {(r.doc_id, r.subject) for r in subjects.assign(d, "doc_id", "text", l, spark.createDataFrame([(a,) for a in first], "subject string")).collect()}
    assert len(got & {(k, sorted(first)[k % 4]) for k in range(400, 480)}) >= 76


def test_thresholds_by_subject():
    """A subject with many held-out labels gets its own threshold, one with few that of all."""
    last = len(subjects.TRIED) - 1
    rows = [(i, "a", "hit", 100) for i in range(last + 1)] + [(i, "a", "wrong", 60 if i < last else 0) for i in range(last + 1)]
    rows += [(i, "b", "hit", 900 if i == 0 else 500) for i in range(last + 1)] + [(i, "b", "missed", 0 if i == 0 else 400) for i in range(last + 1)]
    rows += [(i, "c", "hit", 1) for i in range(last + 1)]
    whole, own = subjects.thresholds(rows)
    assert whole == own["b"] == own["c"] == subjects.TRIED[0] and own["a"] == subjects.TRIED[last]
