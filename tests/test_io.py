"""Readers and writers on small files."""

import io
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import images, rules_engine
from folioscope.rules import CAPTION_RULES
from folioscope.schemas import ARTICLE, label_dimension
from folioscope.sources import articles as art
from folioscope.sources import files, sinks
from folioscope.streaming import rules_stream

JOURNAL = """<articles><article id="a1"><front><journal-meta><journal-id journal-id-type="nlm-ta">J</journal-id><publisher><publisher-name>P</publisher-name></publisher></journal-meta>
<article-meta><article-id pub-id-type="pmid">12</article-id><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>T</article-title></title-group></article-meta></front>
<body><sec><fig id="f1"><label> Figure 1 </label><caption><title>CT</title><p> of the <i>lung</i></p></caption><graphic href="g1"/><graphic href="g2"/></fig></sec><fig id="f2"><caption>zzzzzzzz</caption></fig></body></article>
<article id="a2"><front/></article></articles>"""


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_journal_and_flat_round_trip(spark, tmp_path):
    put(tmp_path, "j.xml", JOURNAL)
    a = art.read_journal(spark, str(tmp_path / "j.xml")).cache()
    r = {x.id: x for x in a.collect()}
    assert r["a1"].pmid == 12 and r["a1"].pmcid is None and r["a1"].journal == "J" and [f.caption for f in r["a1"].figures] == ["CT of the lung", "zzzzzzzz"] and r["a2"].figures == []
    p = rules_engine.predict_articles(a)
    art.write_flat(p, str(tmp_path / "flat"))
    back = {x.doi: x for x in art.read_flat(spark, str(tmp_path / "flat")).collect()}
    g = back["10.1/x"].figures[0].graphics
    assert [x.id for x in g] == ["g1", "g2"] and g[0].predictions["CT"] == pytest.approx(0.92) and back["10.1/x"].pmid == 12
    assert sorted(map(tuple, art.captions(a).collect())) == [("g1", "CT of the lung"), ("g2", "CT of the lung")]
    kinds = {x.kind for x in rules_engine.hit_listing(a).collect()}
    assert kinds == {"CAP", "GRAPHIC", "???"}
    truth = spark.createDataFrame([("g1", "CT")], "graphic_id string, code string")
    sinks.write_training_tree(a, truth, label_dimension(spark), str(tmp_path / "tree"))
    assert spark.read.text(str(tmp_path / "tree/label/label=CT")).first()[0].startswith("g1\t")
    assert spark.read.text(str(tmp_path / "tree/group/group=RADIOLOGY")).count() == 1


def test_record_lists(spark, tmp_path):
    put(tmp_path, "a.xml", '<articles><article fulltext-filename="d" url="u"><figures><figure iri="i1"><caption>one</caption></figure><figure iri="i2"><caption>two</caption></figure></figures></article></articles>')
    r = art.read_articles_2011(spark, str(tmp_path / "a.xml")).first()
    assert (r.dir, r.id, [f.graphics[0].id for f in r.figures], r.figures[1].caption) == ("d", "u", ["i1", "i2"], "two")
    put(tmp_path, "b.xml", "<imageclef><record><pmid>x</pmid><articleURL>u</articleURL><imageLocalName>n</imageLocalName><figureID>f</figureID><caption>c</caption></record></imageclef>")
    r = art.read_records_2010(spark, str(tmp_path / "b.xml")).first()
    assert (r.pmid, r.dir, r.figures[0].id, r.figures[0].caption) == (None, "n", "f", "c")


def test_text_tables(spark, tmp_path):
    m = put(tmp_path, "m.txt", "head=1\n# note\na=1\nb=2=3\na=9\n")
    assert sorted(map(tuple, files.delimited_map(spark, m, "=", skip=1).collect())) == [("a", "9"), ("b", "2")]
    with pytest.raises(Exception, match="a line without a value"):
        files.delimited_map(spark, put(tmp_path, "m2.txt", "alone\n"), "=").collect()
    g = put(tmp_path, "gt.txt", "x1.jpg, CT\nx2.jpg,XR\nx1.jpg, MR\n")
    assert sorted(map(tuple, files.ground_truth(spark, g, ["CT", "XR", "MR"]).collect())) == [("x1", "MR"), ("x2", "XR")]
    for bad in ("x1.jpg, ZZ\n", "x1.jpg CT\n", "x1xjpg, CT\n"):
        with pytest.raises(Exception, match="unknown code|not a line of ground truth"):
            files.ground_truth(spark, put(tmp_path, "bad.txt", bad), ["CT"]).collect()
    assert [r.id for r in files.id_list(spark, put(tmp_path, "l.txt", " a \n\nb\n")).collect()] == ["a", "b"]
    assert sorted(map(tuple, files.class_map(spark, put(tmp_path, "c.txt", "CT 4\nXR 5\n")).collect())) == [("CT", 4), ("XR", 5)]
    assert sorted(map(tuple, files.caption_lines(spark, put(tmp_path, "cap.tsv", "1\tCT\textra\n\n2\tx\n")).collect())) == [("1", "CT"), ("2", "x")]


def test_typed_csv(spark, tmp_path):
    p = put(tmp_path, "t.csv", '% note\nid,a,b,c\n"1",1,x,?\n2,2,1,\n3,3D,2,?\n')
    df = files.typed_csv(spark, p)
    assert dict(df.dtypes) == {"id": "double", "a": "string", "b": "string", "c": "double"} and df.schema["a"].metadata["kind"] == "nominal"
    assert dict(files.typed_csv(spark, p, nominal="first").dtypes)["id"] == "string"
    assert sorted(map(tuple, files.codes_by_appearance(df, "b", "id").collect())) == [("1", 1), ("2", 2), ("x", 0)]
    with pytest.raises(Exception):
        files.typed_csv(spark, put(tmp_path, "bad.csv", "a,b\n1\n")).collect()
    assert dict(files.typed_csv(spark, put(tmp_path, "t.tsv", "a\tb\n1\t2\n")).dtypes) == {"a": "double", "b": "double"}


def test_files_and_archives(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    put(d, "one.txt", "é".encode("latin-1"))
    put(d, "two.bin", b"\x00\x01")
    assert [tuple(r) for r in files.whole_texts(spark, str(d), "ISO-8859-1", "*.txt").collect()] == [("one", "é")]
    assert sorted(r.key for r in files.binary_files(spark, str(d), files_per_task=1).collect()) == ["one", "two"]
    for name, mode in (("a.tar", "w"), ("a.tgz", "w:gz"), ("a.tbz2", "w:bz2")):
        with tarfile.open(tmp_path / name, mode) as t:
            e = tarfile.TarInfo("folder")
            e.type = tarfile.DIRTYPE
            t.addfile(e)
            e = tarfile.TarInfo("folder/x.jpg")
            e.size = 3
            t.addfile(e, io.BytesIO(b"abc"))
        assert [tuple(r) for r in files.tar_entries(spark, str(tmp_path / name)).collect()] == [("folder/x.jpg", bytearray(b"abc"))]
    cut = put(tmp_path, "cut.tar", (tmp_path / "a.tar").read_bytes()[:1030])
    with pytest.raises(Exception):
        files.tar_entries(spark, cut).collect()
    v = put(tmp_path, "img.txt", "1 2\n3 4\n")
    assert [(r.name, r.vector) for r in files.descriptors(spark, v, 2).collect()] == [("img:1", [1.0, 2.0]), ("img:2", [3.0, 4.0])]
    with pytest.raises(Exception, match="wrong number"):
        files.descriptors(spark, v).collect()


def test_citations(spark):
    df = spark.createDataFrame([("PMID- 1\nMH  - One\nXX  - no\nMH  - Two",), ("nothing",)], "body string")
    assert [r.terms for r in files.medline_terms(df).collect()] == [["One", "Two"], []]
    xml = "<r><MeshHeading><DescriptorName>D</DescriptorName><QualifierName>Q1</QualifierName></MeshHeading></r>"
    assert files.headings(spark.createDataFrame([(xml,)], "xml string")).first().terms == ["D", "D:Q1", ":Q1"]
    full = "<r><ArticleTitle>T</ArticleTitle><Journal><ISOAbbreviation>J</ISOAbbreviation><JournalIssue><Volume>1</Volume><Issue>2</Issue><PubDate><Year>2010</Year></PubDate></JournalIssue></Journal><Pagination><MedlinePgn>3-4</MedlinePgn></Pagination><AbstractText>A</AbstractText><AuthorList><Author><LastName>L</LastName><Initials>I</Initials></Author></AuthorList></r>"
    r = files.citation(spark.createDataFrame([(full,)], "xml string")).first()
    assert (r.title, r.authors, r.source_text) == ("T", "L, I", "J 2010;1(2):3-4")


def test_citations_equal_xpath_from_one_parse(spark):
    """What XPath functions give, on odd texts, but from one call for each text."""
    last = "<Author><LastName>{}</LastName><Initials>{}</Initials></Author>"
    whole = '<?xml version="1.0" encoding="ISO-8859-1"?>{}<r{}><ArticleTitle>{}</ArticleTitle><Journal><ISOAbbreviation>J</ISOAbbreviation><JournalIssue><Volume>1</Volume><Issue>2</Issue><PubDate><Year>2010</Year></PubDate></JournalIssue></Journal><Pagination><MedlinePgn>3-4</MedlinePgn></Pagination><AbstractText>A</AbstractText><AuthorList>{}</AuthorList></r>'
    titles = ["a<i>b</i>c", "<i>b</i>c", " \r\n<b/>x", "a<!-- no -->b", "a<?p i?>b", "x<![CDATA[<y>]]>z", "&#xe9;&amp;\U0001f600 é", "q" * 9000 + "&lt;" + "r" * 9000, "T</ArticleTitle><ArticleTitle>second", "<ArticleTitle>in</ArticleTitle>out", "<Year>1</Year>t"]
    texts = [whole.format("", "", t, last.format("L", "I") + last.format("M<!-- -->N", "K")) for t in titles]
    texts += [whole.format("", "", "t", a) for a in ("", "<Author><LastName>L</LastName></Author>", "<x>" + last.format("no", "no") + "</x>", "<Author><Initials>I</Initials></Author>" + last.format("L", "K"))]
    texts += [whole.format('<!DOCTYPE r [<!ENTITY e "ent">]>', "", "a&e;b", ""), whole.format("", ' xmlns="urn:x"', "t", last.format("L", "I"))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, xml string")
    x = lambda p: F.xpath_string("xml", F.lit(p))
    both = F.zip_with(*[F.xpath("xml", F.lit(p)) for p in files.AUTHOR.values()], lambda a, b: F.concat_ws(", ", a, b))
    own = {k: x(p) for k, p in files.CITATION.items()}
    source = F.format_string("%s %s;%s(%s):%s", *[own[k] for k in ("journal", "year", "volume", "issue", "pages")])
    want = df.select("id", own["title"], F.array_join(both, "; "), source, own["abstract"])
    got = files.citation(df)
    assert got.columns == ["id", "xml", "title", "authors", "source_text", "abstract"]
    assert sorted(map(tuple, got.drop("xml").collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "xpath" not in plan and plan.count("ArrowEvalPython") == 1
    for text, message in ((None, "no title"), ("", "no title"), (texts[0].replace("2010", ""), "no year"), ("<r><ArticleTitle>", "no element found")):
        with pytest.raises(Exception, match=message):
            files.citation(spark.createDataFrame([(text,)], "xml string")).collect()


def test_export_lines(spark, tmp_path):
    df = spark.createDataFrame([('"i1"', 0.5, 0.0, 2.0, "CT"), ("i2", 1.0, 1.0, 1.0, "ZZ")], "id string, a double, b double, c double, label string")
    classes = spark.createDataFrame([("CT", 4)], "label string, id int")
    assert sorted(r.line for r in sinks.libsvm_lines(df, ["a", "b", "c"], "label", classes).collect()) == ["-1 1:1 2:1 3:1", "4 1:0.5 2:0 3:2"]
    assert sorted(r.line for r in sinks.smlr_lines(df, ["a", "b", "c"], "label", classes).collect()) == ["0.5 0 2 4", "1 1 1 ZZ"]
    assert sinks.trec_lines(df.limit(1), "label", "label").first().line == "CT CT 1.0"
    p = spark.createDataFrame([("x", [1e-6, 0.5])], "id string, p array<double>")
    assert tuple(sinks.distribution(p, "id", "p", ['a"', "b"]).first()) == ("x", 0.0, 0.5)
    head, body = sinks.arff_lines(df.select("a", "label"), "r", ["CT", "ZZ"])
    assert "@ATTRIBUTE a NUMERIC" in head and "{CT,ZZ}" in head and sorted(r.line for r in body.collect()) == ["0.5,CT", "1,ZZ"]
    assert sinks.write_counted(p, str(tmp_path / "v")) == 1
    sinks.write_vectors(p, str(tmp_path / "w"), "p", single=True)
    assert dict(spark.read.parquet(str(tmp_path / "w")).dtypes)["p"] == "array<float>"
    ds = files.vector_dataset(p, "id", "p")
    assert ds.columns == ["id", "attr_0", "attr_1", "label"]
    with pytest.raises(Exception, match="another width"):
        files.vector_dataset(p, "id", "p", 3).collect()


def png(a):
    h, w, c = a.shape
    raw = b"".join(b"\0" + a[i].tobytes() for i in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    white, black, red = (np.full((40, 40, 3), 255, np.uint8), np.zeros((40, 40, 3), np.uint8), np.zeros((40, 40, 3), np.uint8))
    red[..., 0] = 255
    for name, a in (("white", white), ("black", black), ("red", red), ("grey", np.zeros((40, 40, 1), np.uint8))):
        put(tmp_path, f"{name}.png", png(a))
    put(tmp_path, "broken.png", b"no image")
    loaded = images.load_images(spark, str(tmp_path / "*.png")).cache()
    one = lambda n: {r.key: r.vector for r in images.extract(loaded, n).collect()}
    mean = one("mean")
    assert mean["white"] == [255.0, 1.0] and mean["black"] == [0.0, 0.0] and "broken" not in mean
    hist = one("histogram")
    assert sum(hist["red"]) == 1.0 and len(hist["red"]) == 100 == len(images.histogram_names()) and len(one("histogram48")["red"]) == 48
    assert one("lines")["white"] == [0.0, 0.0] and one("skin")["grey"] == [0.0]
    both = images.extract(loaded, "mean,edgehistogram,tamura").collect()
    assert all(len(r.vector) == 2 + 80 + 18 for r in both)
    sift = images.extract(loaded, "dsift").filter("key = 'red'").collect()
    assert len(sift) == 9 and all(len(r.vector) == 128 for r in sift)
    drawn = np.full((60, 60, 3), 255, np.uint8)
    drawn[30, 8:52] = 0
    drawn[8:52, 30] = 0
    assert images.lines(drawn)[0][1] == 1.0
    for f in (images.gabor, images.autocorrelogram, images.entropy_ratio, images.skin_ratio):
        assert np.isfinite(f(drawn)[0]).all()


def test_streams(spark, tmp_path, sf_dir):
    src = tmp_path / "in"
    src.mkdir()
    put(src, "a.tsv", "1\tAxial CT\n\n2\tnothing\n")
    q = rules_stream.rule_lines(rules_stream.caption_stream(spark, str(src))).writeStream.format("memory").queryName("rule_lines").start()
    q.processAllAvailable()
    q.stop()
    got = {r.value.split("\t")[0]: r.value.split("\t")[1:] for r in spark.sql("select * from rule_lines").collect()}
    assert len(got["1"]) == len(CAPTION_RULES) and "1" in got["1"] and set(got["2"]) == {"0"}
    batch = rules_stream.rule_lines(files.caption_lines(spark, str(src)))
    assert {r.value for r in batch.collect()} == {"\t".join([k, *v]) for k, v in got.items()}
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    q = rules_stream.event_windows(stream, late="40 days").writeStream.outputMode("complete").format("memory").queryName("event_windows").start()
    q.processAllAvailable()
    q.stop()
    want = rules_stream.event_windows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert sorted(map(tuple, spark.sql("select window_start, event_type, n from event_windows").collect())) == sorted(map(tuple, want.select("window_start", "event_type", "n").collect()))


def test_long_terms_stay_whole(spark):
    long = "x" * 150_000
    df = spark.createDataFrame([(f"PMID- 1\nMH  - {long}\n",)], "body string")
    assert files.medline_terms(df).first().terms == [long]


def test_articles_without_identity_stay_apart(spark):
    graphic = lambda i: [(str(i), None, None, [], [(f"g{i}", {})])]
    rows = [(None, None, None, None, None, None, "same", None, None, graphic(i)) for i in (1, 2)]
    out = art.with_labelled_graphic(spark.createDataFrame(rows, ARTICLE), spark.createDataFrame([("g2", "CT")], "graphic_id string, code string"))
    assert [r.figures[0].graphics[0].id for r in out.collect()] == ["g2"]
