"""Hand-checked fixtures of the record, network, series, matrix, map and source operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.functions import graphs, som_math
from quillmap.functions import text as T
from quillmap.operators import indicators as I
from quillmap.operators import matrices as M
from quillmap.operators import network as N
from quillmap.operators import relevance as R
from quillmap.operators import semantic as S
from quillmap.operators import series as W
from quillmap.operators import som
from quillmap.operators import thesaurus as th
from quillmap.plans import registry
from quillmap.sources import router, tables, tagged, units, works


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("plural,singular", [("studies", "study"), ("analyses", "analysis"), ("boxes", "box"), ("process", "process"), ("species", "species"), ("models", "model"), ("classes", "classe"), ("diseases", "diseas"), ("deep models", "deep model")])
def test_singular(spark, plural, singular):
    assert one(spark, plural, T.singular) == singular


def test_noun_phrases(spark):
    assert one(spark, "Deep neural network models of the brain", T.noun_phrases) == ["deep neural network", "model", "brain"]
    assert one(spark, "", T.noun_phrases) == [] and one(spark, None, T.noun_phrases) is None


def test_text_functions(spark):
    assert one(spark, "self-organizing map (som) o'neil 3d", T.title_case) == "Self-Organizing Map (Som) O'Neil 3D"
    assert one(spark, "RESULTS: We saw x. © 2020 Someone Ltd. Done", T.clean_scientific) == "We saw x. . Done"
    assert one(spark, "Univ A, Paris, France; Univ B, Lima, Peru", T.countries) == ["france", "peru"]
    assert one(spark, "1,234%", T.safe_number) == 1234.0 and one(spark, "x", T.safe_number) == 0.0
    assert tuple(one(spark, "1.23.456 Quantum Chemistry", T.topic_code)) == ("1", "23", "456", "Quantum Chemistry")
    assert [tuple(one(spark, x, T.trajectory))[:2] for x in ("2025_A_B", "A_2025", "x_y")] == [("A_B", "2025"), ("A", "2025"), ("y", "x")]


def docs(spark, rows):
    return N.doc_terms(spark.createDataFrame(rows, "d long, t array<string>"), "d", F.col("t"))


def edges(df):
    return {(r.src, r.dst): r.weight for r in df.collect()}


def test_cooccurrence(spark):
    d = docs(spark, [(1, ["a", "B ", "c", None, "a"]), (2, ["a", "b"]), (3, None), (4, []), (5, [" "])])
    assert edges(N.cooccurrence(d)) == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert edges(N.cooccurrence(d, fractional=True)) == {("a", "b"): 1.5, ("a", "c"): 0.5, ("b", "c"): 0.5}
    assert {r.term: r["count"] for r in N.node_counts(d).collect()} == {"a": 2, "b": 2, "c": 1}
    assert N.cooccurrence(docs(spark, [(1, None)])).count() == 0


def test_bipartite(spark):
    df = spark.createDataFrame([(1, ["x"], ["p", "q"]), (2, [], ["p"])], "d long, l array<string>, r array<string>")
    nodes, e = N.bipartite(df, "d", F.col("l"), F.col("r"), fractional=True)
    assert edges(e) == {("x", "p"): 0.5, ("x", "q"): 0.5}
    assert {(r.type, r.term): r["count"] for r in nodes.collect()} == {("left", "x"): 1.0, ("right", "p"): 0.5, ("right", "q"): 0.5}


def test_components_and_communities(spark):
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 1.0) for i in range(70)] + [("x", "y", 1.0)], "src string, dst string, weight double")
    label = N.components(e)
    assert {r.component for r in label.collect()} == {"n000", "x"} and N.largest_component(label).count() == 71
    a = np.zeros((6, 6))
    for i, j in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]:
        a[i, j] = a[j, i] = 1
    assert graphs.louvain(a).tolist() == [0, 0, 0, 1, 1, 1] and np.isfinite(graphs.spring(a)).all()


def test_thesaurus(spark):
    t = th.prepare(spark.createDataFrame([("som", "self-organizing map"), ("paper", "<ignore>"), (None, "x")], "label string, replace_by string"))
    terms = spark.createDataFrame([(1, i, x) for i, x in enumerate(["SOM", "paper", "Networks", "som", None])], "rec long, pos int, term string")
    assert [r.term for r in th.apply_terms(terms, "rec", "pos", "term", t).orderBy("pos").collect()] == ["self-organizing map", "Networks"]


def test_series(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([3.0, 1.0, 4.0, 1.0, 5.0])], "e string, t int, v double")
    assert [r.ecma3 for r in W.smoothed(df, ["e"], "t", "v").orderBy("t").collect()] == [3, 2, 3, 2, 3.5]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 10.0])], "e string, t int, v double")
    got = [r.mean for r in W.moving(df, ["e"], "t", "v", 5).orderBy("t").collect()]
    assert got == [1, 2, 4, pytest.approx(17 / 3, abs=1e-6), 10]


def test_indicators(spark):
    g = I.growth(spark.createDataFrame([("A", 1, 100.0), ("A", 2, 110.0), ("A", 3, 121.0), ("B", 1, 5.0)], "e string, t int, v double"), "e", "t", "v")
    assert {r.e: r.cagr for r in g.collect()} == {"A": 10.0, "B": 0.0}
    df = spark.createDataFrame([("A", 10, 40.0), ("B", 0, 3.0), (None, 5, 1.0)], "entity string, docs long, cited double")
    base = spark.createDataFrame([(1, 100)], "k int, docs long")
    out = I.derive(df.withColumn("k", F.lit(1)), "docs", "cited", "cited", base, "k")
    assert {r.entity: (r.share, r.impact) for r in out.collect()} == {"A": (10.0, 4.0), "B": (0.0, 0.0), None: (5.0, 0.2)}
    assert [r.entity for r in I.profile(df, "entity", "docs", ["docs", "cited"]).collect()] == ["A", "B"]
    b = M.box(spark.createDataFrame([("k", float(i)) for i in range(1, 9)], "k string, v double"), "k", "v").first()
    assert (b.q1, b.median, b.q3) == (3, 5, 7)


def test_normalizations(spark):
    df = spark.createDataFrame([("a", "a", 4.0), ("a", "b", 2.0), ("b", "a", 2.0), ("b", "b", 9.0)], "row string, feature string, value double")
    cell = lambda how: {(r.row, r.feature): r.value for r in M.normalize(df, how).collect()}
    assert cell("cooc_cosine")["a", "b"] == pytest.approx(1 / 3, abs=1e-6) and cell("cooc_cosine")["a", "a"] == 1
    assert cell("unknown")["b", "b"] == 9 and cell("bipartite_row")["a", "b"] == pytest.approx(1 / 3, abs=1e-6)
    for how in ("div_max", "min_max", "z_score"):
        assert {(r.row, r.feature): r.value for r in M.revert(M.normalize(df, how), how).collect()} == {("a", "a"): 4, ("a", "b"): 2, ("b", "a"): 2, ("b", "b"): 9}
    zero = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 5.0)], "row string, feature string, value double")
    assert {r.value for r in M.normalize(zero, "cooc_association").collect()} == {0.0, 1.0}


def test_som(spark):
    pos = [(r.x, r.y) for r in som.hex_grid(spark, 2, 2).orderBy("idx").collect()]
    assert pos == [(0, 0), (1.5, pytest.approx(0.866025, abs=1e-5)), (0, pytest.approx(1.732051, abs=1e-5)), (1.5, pytest.approx(2.598076, abs=1e-5))]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) + np.repeat(np.eye(3, 5) * 9, 100, 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 5)], "id long, vec array<double>")
    data = som.clean(df, "id", "vec", 5)
    w, errors = som.train_batch(data, 4, 5, 6)
    assert errors[-1] < errors[0] and w.shape == (20, 5)
    # one epoch against the plain formula over all rows
    s, c, _ = som.epoch_sums(data, w)
    h = som_math.kernel(som_math.grid(4, 5), 1.0)
    bmu = som_math.distances(x, w).argmin(1)
    want = (h[bmu].T @ x) / h[bmu].sum(0)[:, None]
    assert np.allclose(som_math.batch_update(w, s, c, h), want)
    assert som.assign(data, w).count() == 300 and som.train_online(data, 3, 3, 2).count() == 9
    assert som_math.suggest_size(100, 2.0)[0] * som_math.suggest_size(100, 2.0)[1] == pytest.approx(1000, rel=0.1)


def test_local_clusters():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    truth = np.repeat([0, 1, 2], 40)
    for label in (som_math.ward(x, 3), S.hdbscan(x, 8), S.lloyd(x, 3), som_math.dbscan(x, 0.5, 3)):
        for t in range(3):
            own = label[(truth == t) & (label >= 0)]
            assert len(own) > 30 and len(np.unique(own)) == 1
    s, db, ch = som_math.cluster_scores(x, truth)
    assert s > 0.8 and db < 0.3 and ch > 1000
    assert math.isnan(som_math.cluster_scores(x, np.zeros(120, int))[0])


def test_relevance_and_labels(spark):
    d = docs(spark, [(i, ["x", f"y{i}"]) for i in range(5)] + [(9, ["alone"])])
    scores = {r.term: r.score for r in R.relevance(d).collect()}
    assert scores["alone"] == 0 and scores["y1"] > scores["x"] - 5
    k = spark.createDataFrame([(1, "map", 1), (1, "maps", 2), (1, "graph", 3), (-1, "z", 1)], "g int, term string, rank int")
    assert {r.g: r.label for r in R.labels(k, "g").collect()} == {1: "map / graph", -1: "Noise"}


def test_neighbours_brute(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {r.id: [n.id for n in r.near] for r in S.neighbours(df, 5).collect()}
    d = som_math.distances(x, x)
    np.fill_diagonal(d, np.inf)
    assert all(got[i] == d[i].argsort()[:5].tolist() for i in range(150))
    est = {r.estimator: r.dim for r in S.dimensions(S.neighbours(df, 20)).collect()}
    assert set(est) == {"TwoNN", "MADA", "MOM", "MLE", "KNN", "CorrInt"} and 2 < est["MLE"] < 6
    assert S.target_dimension(5, 9.6) == 4 and S.target_dimension(100, None) == 10 and S.target_dimension(100, None, 1) == 2


def test_dimension_rows(spark, tmp_path):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(80, 3)) @ np.linalg.qr(rng.normal(size=(24, 3)))[0].T
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, intrinsic_data array<double>").write.parquet(f"{tmp_path}/intrinsic_vectors.parquet")
    rows = {r.estimator: r.dim for r in registry.queries()["dimension_estimates"](spark, str(tmp_path)).collect()}
    assert set(rows) == {"TwoNN", "MADA", "MOM", "MLE", "KNN", "CorrInt", "PCA"} and rows["PCA"] == 3
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert S.global_pca(none).collect() == [("PCA", None)]


def test_density_and_layout_at_any_size(spark, monkeypatch):
    """The same clusters and the same layout whether or not the rows are more than a task takes."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 1, (n, 3)) for c, n in ((0, 90), (15, 70), (40, 40), (-30, 60), (70, 50), (-60, 45), (110, 45))] + [rng.uniform(-200, 200, (40, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    near = S.neighbours(df, 15)

    def parts():
        by = {}
        for r in S.density_clusters(df, 10).collect():
            by.setdefault(r.cluster, set()).add(r.id)
        return by.pop(-1), sorted(map(sorted, by.values()))

    def places():
        return np.array(S.manifold(df, near, epochs=20).orderBy("id").select("x", "y").collect())

    noise, whole = parts()
    laid = places()
    monkeypatch.setattr(S, "MOST_LOCAL", 100)
    for tile in (300, 60):
        monkeypatch.setattr(S, "TILE", tile)
        assert parts() == (noise, whole) and len(whole) == 7 and len(noise) > 20
    assert np.allclose(places(), laid) and not np.allclose(laid, np.array(S.reduce_linear(df, 2).orderBy("id").select("coords").collect())[:, 0])
    monkeypatch.setattr(S, "MOST_LAYOUT", 100)
    with pytest.raises(ValueError):
        S.manifold(df, near)


RIS = "TY  - JOUR\nTI  - Mapping science\nAU  - Doe, J.\nAU  - Roe, R.\nKW  - SOM\nKW  - Clustering\nPY  - 2021///\nJO  - J Maps\nAB  - Text\n  goes on.\nDO  - 10.1/x\nER  - \nTY  - CONF\nTI  - Last without end\n"


def test_tagged(spark):
    df = spark.createDataFrame([(1, RIS), (2, None), (3, ""), (4, "no tags here")], "k long, text string")
    a, b = tagged.parse_ris(df, ["k"], "text").orderBy("record_no").collect()
    assert (a.title, a.year, a.authors, a.keywords, a.abstract) == ("Mapping science", "2021", ["Doe, J.", "Roe, R."], ["SOM", "Clustering"], "Text") and b.title == "Last without end"
    wos = "PT J\nAU Doe, J\n   Roe, R\nTI A long\n   title\nDE som; maps\nPY 2020\nER\n"
    r = tagged.parse_two_letter(spark.createDataFrame([(wos,)], "t string"), [], "t").first()
    assert r.title == "A long title" and r.authors == ["Doe, J", "Roe, R"] and r.keywords == ["som", "maps"] and r.year == "2020"
    med = "PMID- 1\nDP  - 2019 Mar 4\nTI  - One\nMH  - Maps\n\nPMID- 2\nTI  - Two\n"
    rows = tagged.parse_four_column(spark.createDataFrame([(med,)], "t string"), [], "t").orderBy("record_no").collect()
    assert [(x.record_id, x.title, x.year) for x in rows] == [("1", "One", "2019"), ("2", "Two", None)]


def test_delimited(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text('﻿Authors,Title,Year,Source title,Author Keywords,Index Keywords,Abstract,DOI,Cited by,EID,Affiliations\n"Doe J.; Roe R.","Mapping science",2021,"J. Maps","SOM; Clustering","clustering; networks","a, b",10.1/x,5,2-s2.0-1,"Univ A, Paris, France"\n', encoding="utf-8")
    kind, df = router.read(spark, str(p))
    r = df.first()
    assert kind == "scopus" and r.authors == ["doe j.", "roe r."] and r.citations == 5 and r.countries == ["france"]
    p = tmp_path / "d.csv"
    p.write_text('About this export\n\nTitle,Abstract,Publication Year,Times cited,Authors,MeSH terms,Fields of Research (ANZSRC 2020),Source title,DOI\n"One",x,2020,"1,234","A; B",m,f,J,d\n,x,2020,1,,,,,\n')
    kind, df = router.read(spark, str(p))
    assert kind == "dimensions" and [(x.title, x.citations, x.keywords) for x in df.collect()] == [("One", 1234.0, ["m", "f"])]
    p = tmp_path / "l.csv"
    p.write_text("Lens ID,Title,Abstract,Publication Year,Citing Works Count,Authors,Keywords,Mesh Terms,Source Title,DOI\n1,T,a,2020,3,A; B,k; m,m; n,S,d\n")
    kind, df = router.read(spark, str(p))
    assert kind == "lens" and df.first().keywords == ["k", "m", "n"]
    p = tmp_path / "t.txt"
    p.write_text("label\treplace by\nsom\tmap\n")
    assert [tuple(r) for r in tables.read_thesaurus(spark, str(p)).collect()] == [("som", "map")]
    p = tmp_path / "m.csv"
    p.write_text("name,a,b\nx,1,oops\n")
    assert {(r.label, r.feature): r.value for r in tables.read_matrix(spark, str(p)).collect()} == {("x", "a"): 1.0, ("x", "b"): 0.0}


def test_json(spark):
    text = '{"results":[{"title":"T","abstract_inverted_index":{"b":[1],"a":[0,2]},"publication_year":2020,"cited_by_count":3,"authorships":[{"author":{"display_name":"A"}}],"concepts":[{"display_name":"c","score":0.5},{"display_name":"d","score":0.1}],"keywords":[{"display_name":"c"},{"display_name":"k"}],"primary_location":{"source":{"display_name":"S"}},"doi":"d"}]}'
    r = works.open_works(spark.createDataFrame([(text,)], "j string"), "j").first()
    assert r.abstract == "a b a" and r.keywords == ["c", "k"] and r.source == "S"
    text = '{"message":{"items":[{"title":["T"],"abstract":"<jats:p>x</jats:p>","created":{"date-parts":[[2019,1]]},"is-referenced-by-count":2,"author":[{"given":"J","family":"Doe"}],"container-title":["S"],"DOI":"d"}]}}'
    r = works.cross_works(spark.createDataFrame([(text,)], "j string"), "j").first()
    assert (r.abstract, r.year, r.authors, r.keywords) == ("x", 2019, ["Doe, J"], [])
    net = '{"network":{"items":[{"label":"A"},{"id":7,"label":"B","weights":{"Occurrences":3}}],"links":[{"source_id":1,"target_id":7}]}}'
    df = spark.createDataFrame([(net,)], "j string")
    assert [(r.id, r.cluster, r["count"]) for r in works.network_items(df, "j").collect()] == [(1, 1, 1.0), (7, 1, 3.0)]
    assert works.network_links(df, "j").first().weight == 1.0


def test_units(spark, tmp_path):
    inv = units.inventory(spark, ["/a/Locations Trend.csv", "/b/Locations Trend.csv", "/c/readme.md"])
    assert [tuple(r) for r in inv.collect()] == [("Locations", "Trend", "/b/Locations Trend.csv")]
    import zipfile

    p = tmp_path / "x.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Name</t></si><si><t>Docs</t></si><si><t>A</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    rows = units.read_workbook(spark, str(p)).collect()
    assert {(r.column, r.value) for r in rows} == {("Name", "A"), ("Docs", "5")}
    files = units.expand(spark, str(p), str(tmp_path / "out"))
    assert sorted(f.rsplit("/", 1)[1] for f in files) == ["sharedStrings.xml", "sheet1.xml"]
    df = spark.createDataFrame([("1,000", "x", None), ("5%", "y", None), (None, None, None)], "a string, b string, c string")
    out = M.coerce_numbers(M.drop_empty(df), ["a", "b"])
    assert out.columns == ["a", "b"] and sorted(r.a for r in out.collect()) == [5.0, 1000.0]


def test_streaming(spark, tmp_path):
    from quillmap.streaming.term_counts import term_counts

    spark.createDataFrame([(["a", "B"],), (["b"],), (None,)], "t array<string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t array<string>").parquet(str(tmp_path / "in"))
    q = term_counts(stream, F.col("t")).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r.term: r["count"] for r in spark.sql("select * from counts").collect()} == {"a": 1, "b": 2}


def test_records_of_a_file_are_rows_of_the_scan(spark, tmp_path):
    """Record ends split the scan, in either form of line ends; lines that go on, further authors and references are kept."""
    ris = "TY  - JOUR\nTI  - One\nER  - \nTY  - JOUR\nTI  - Two\nER  - \n"
    wos = "PT J\nAU Doe, J\n   Roe, R\nTI One\nCR Doe J, 2001, J MAPS\n   Roe R, 2002, ANN NETS, V1, DOI 10.1234/x\nER\n\nPT J\nTI Two\nER\n"
    med = "PMID- 1\nTI  - One\n      more\nMH  - Maps\n\nPMID- 2\nTI  - Two\n"
    for name, text, want in (("a", ris, {"One", "Two"}), ("b", ris.replace("\n", "\r\n"), {"One", "Two"}), ("c", wos, {"One", "Two"}), ("d", med, {"One more", "Two"})):
        (tmp_path / name).write_bytes(text.encode())
        kind, df = router.read(spark, str(tmp_path / name))
        assert {r.title for r in df.collect()} == want and router.records(spark, str(tmp_path / name), kind).count() >= 2
    r = tagged.parse_two_letter(spark.createDataFrame([(wos,)], "t string"), [], "t").orderBy("record_no").first()
    assert r.references == ["Doe J, 2001, J MAPS", "Roe R, 2002, ANN NETS, V1, DOI 10.1234/x"]


def test_references(spark):
    refs = N.references(spark.createDataFrame([(1, ["Doe J, 2001, J MAPS, V1", "ROE R, 2002, ANN NETS, DOI 10.1234/X", "doe j, 2001, J. Maps", "rubbish", None]), (2, ["Doe J, 2001, J MAPS"]), (3, None)], "id long, cr array<string>"), "id", F.col("cr"))
    assert {(r.record, r.key, r.doi) for r in refs.collect()} == {(1, "doe j|2001|j maps", None), (1, "roe r|2002|ann nets", "10.1234/x"), (2, "doe j|2001|j maps", None)}
    own = [(2, "Roe, R", "2002", "x", "10.1234/x"), (7, "Doe, J", "2001", "J MAPS", None), (1, "Doe J", "2001", "J MAPS", None)]
    own = spark.createDataFrame(own, "record long, a string, y string, s string, doi string").select("record", N.work_key(F.col("a"), F.col("y"), F.col("s")).alias("key"), "doi")
    assert sorted(map(tuple, N.citations(refs, own).collect())) == [(1, 2), (1, 7), (2, 1), (2, 7)]
    assert [tuple(r) for r in N.shared(N.cited(refs), "record", "node").collect()] == [(1, 2, 1)]
    assert [tuple(r) for r in N.shared(N.cited(refs, "source"), "node", "record").collect()] == [("ann nets", "j maps", 1)]


def test_shared_keys_of_many_documents(spark):
    """A key that all documents hold is cut into lists; the counts are those of all pairs."""
    rows = [(d, "all") for d in range(40)] + [(d, d % 5) for d in range(40)]
    df = spark.createDataFrame([(a, str(b)) for a, b in rows] + [(None, "all"), (3, None)], "d long, k string")
    want = {(a, b): 1 + (a % 5 == b % 5) for a in range(40) for b in range(a + 1, 40)}
    for block in (512, 7):
        assert {(r.a, r.b): r.weight for r in N.shared(df, "d", "k", block).collect()} == want


def test_shared_by_blocks(spark, monkeypatch):
    """Where pairs are many for the rows, no pair is a row: blocks multiplied give the same counts, for texts and numbers."""
    rows = [(d, f"k{k}") for d in range(90) for k in range(60) if (d * 7 + k * k) % 3] * 2
    df = spark.createDataFrame([*rows, (None, "k1"), (3, None)], "d long, k string")
    have = {d: {k for x, k in rows if x == d} for d in range(90)}
    want = {(a, b): len(have[a] & have[b]) for a in range(90) for b in range(a + 1, 90) if have[a] & have[b]}
    monkeypatch.setattr(N, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(N, "OUT_ROWS", 100)
    for rows_of_block in (2000, 10**6):
        monkeypatch.setattr(N, "BLOCK_ROWS", rows_of_block)
        got = N.shared(df, "d", "k", dense=True)
        assert got.dtypes == N.shared(df, "d", "k", dense=False).dtypes
        got = got.collect()
        assert len(got) == len(want) and {(r.a, r.b): r.weight for r in got} == want
    text = N.shared(df.withColumn("d", F.format_string("%03d", "d")).where("k is not null"), "d", "k", dense=True)
    assert {(int(r.a), int(r.b)): r.weight for r in text.where("a <> 'null' and b <> 'null'").collect()} == want
    assert N.shared(df.limit(0), "d", "k", dense=True).count() == N.shared(df.limit(0), "d", "k").count() == 0
    plan = []
    monkeypatch.setattr(N, "_multiplied", lambda d, keys, blocks: plan.append(blocks) or d)
    many = spark.range(800).selectExpr("id d").crossJoin(spark.range(3).selectExpr("id k"))
    N.shared(many, "d", "k")
    assert plan


def test_semantic_records(spark):
    from quillmap.sources.semantic_records import semantic_records

    med = "PMID- 17\nTI  - One\n      <i>more</i>\nMH  - Maps\nOT  - own\nAU  - Doe J\nAU  - Roe R\nDP  - 2019 Mar\nJT  - J Maps\n\nPMID- 18\nAB  - see 10.1234/ab.c, there\n"
    a, b = semantic_records(spark.createDataFrame([(med,), (None,), ("",)], "t string"), [], "t", "four_column").orderBy("record_no").collect()
    assert (a.record_key, a.title, a.keywords, a.extras) == ("PMID_17", "One more", ["Maps"], {"AU": "Doe J, Roe R", "PY": "2019", "SO": "J Maps"})
    assert a.concatenated_text == "Title: One more | Keywords: Maps | Journal: J Maps" and b.record_key == "10.1234/ab.c"
    plain = semantic_records(spark.createDataFrame([(med,)], "t string"), [], "t", "four_column", use_mesh=False).orderBy("record_no").first()
    assert plain.keywords == ["own"]
    r = semantic_records(spark.createDataFrame([("PT J\nZZ x\nER\n",)], "t string"), [], "t", "two_letter").first()
    assert (r.record_key, r.concatenated_text, r.extras) == ("ID_1", "Unknown document content", {})


def test_number_files_and_encodings(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b\n1,2\n\n3,oops\n ,4\n")
    assert [r.vec for r in tables.read_numbers(spark, str(tmp_path / "n.csv")).orderBy("row").collect()] == [[1.0, 2.0], [3.0, 0.0], [0.0, 4.0]]
    (tmp_path / "w.csv").write_bytes("Updated\nname,docs,x,y\nMünchen,\"1000\",y,z\nbad,1,2\n".encode("latin-1"))
    assert [tuple(r) for r in tables.read_indicators(spark, str(tmp_path / "w.csv")).collect()] == [("München", "1000", "y", "z")]


def test_one_unit_of_an_inventory(spark, tmp_path):
    (tmp_path / "Locations.csv").write_text("name,docs,x\nA,5,\n")
    (tmp_path / "Locations Trend.csv").write_text("Updated\nname,year,docs\nA,2020,2\n")
    found = units.inventory(spark, [*(str(tmp_path / n) for n in ("Locations.csv", "Locations Trend.csv")), "/nowhere/Researchers.csv"])
    got = {(r.period, r.column, r.value) for r in units.scan_unit(spark, found, "Locations").collect()}
    assert got == {("Whole", "name", "A"), ("Whole", "docs", "5"), ("Trend", "name", "A"), ("Trend", "year", "2020"), ("Trend", "docs", "2")}
    with pytest.raises(ValueError):
        units.scan_unit(spark, found, "Funding Agencies")


def test_json_result(spark):
    import json

    from quillmap.sources import sinks

    df = spark.createDataFrame([("b", None), ("a", 1)], "k string, n int")
    got = json.loads(sinks.result_json(df, "rows", unit="x").first()["json"])
    assert got == {"success": True, "unit": "x", "rows": [{"k": "a", "n": 1}, {"k": "b", "n": None}]}
    assert json.loads(sinks.result_json(df.limit(0), "rows").first()["json"]) == {"success": True, "rows": []}


def test_tables_are_removed(spark):
    import os

    from quillmap import runtime

    path = runtime.materialize(spark.range(3)).inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert os.path.exists(path)
    runtime.release(spark)
    assert not os.path.exists(path)


def test_sub_clusters_of_groups_of_any_size(spark, monkeypatch):
    """Groups beyond a task's rows are clustered too, by the same means; the other groups as before."""
    rng = np.random.default_rng(4)
    spots = {(1, 0): (0, 0), (1, 1): (50, 0), (1, 2): (0, 50), (1, 3): (50, 50), (2, 0): (0, 0)}
    rows = [(g, s, *(np.array(c) + rng.normal(0, 1, 2)).round(2).tolist()) for (g, s), c in spots.items() for _ in range(30 if g == 1 else 9)]
    df = spark.createDataFrame([(g, i, x, y) for i, (g, _, x, y) in enumerate(rows)] + [(3, 900 + i, 1.0, 1.0) for i in range(60)], "grp int, id long, x double, y double")

    def parts():
        by = {}
        for r in S.sub_clusters(df, "grp").collect():
            by.setdefault((r.grp, r.sub), set()).add(r.id)
        return sorted((g, sorted(v)) for (g, _), v in by.items())

    whole = parts()
    monkeypatch.setattr(S, "MOST_LOCAL", 50)
    assert parts() == whole and len(whole) == 6 and sum(len(v) for _, v in whole) == df.count()


def test_layout_of_more_rows_than_a_task_takes(spark, monkeypatch):
    """Beyond the rows of a task every row is laid out too, next to its neighbours; blocks of rows move as the whole does."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1, (60, 4)) for c in (0, 30, 60)])
    df = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    near = S.neighbours(df, 15)

    def kept():
        rows = S.manifold(df, near, epochs=20).orderBy("id").collect()
        assert [r.id for r in rows] == [7 * i for i in range(180)]
        p = np.array([(r.x, r.y) for r in rows])
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        return np.mean(np.argsort(d, 1)[:, :5] // 60 == np.arange(180)[:, None] // 60)

    whole = kept()
    monkeypatch.setattr(S, "TASK_LAYOUT", 100)
    monkeypatch.setattr(S, "TILE", 50)
    assert whole > 0.95 and kept() > 0.95
