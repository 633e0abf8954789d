import io
import json
import zipfile

from biblink.plans import fixtures
from biblink.sources.docx import read_docx
from biblink.sources.providers import candidates_from_json
from biblink.streaming.incremental import resolve_stream
from pyspark.sql import functions as F

RECORDS = {
    "crossref": (
        {"title": ["A paper"], "DOI": "10.1/X", "author": [{"given": "Ludwig", "family": "van Dam"}, {"name": "The Group"}], "issued": {"date-parts": [[2001, 5]]}, "page": "10-19", "container-title": ["Book of Rings"], "type": "book-chapter", "volume": "3"},
        dict(title="A paper", doi="10.1/X", authors=["van dam"], corporate="The Group", year=2001, first_page="10", last_page="19", item_type="bookSection", book_title="Book of Rings", volume="3", arrival=1),
    ),
    "europepmc": (
        {"title": "A paper.", "pubYear": "1999", "pageInfo": "e12", "authorList": {"author": [{"lastName": "Öz"}, {"collectiveName": "Team"}]}, "journalInfo": {"volume": "", "journal": {"title": "Ring", "isoabbreviation": "R"}}},
        dict(title="A paper", year=1999, first_page="e12", last_page=None, authors=["öz"], corporate="Team", journal_abbrev="R", volume=None),
    ),
    "openalex": (
        {"display_name": "A paper", "ids": {"pmid": "https://x.org/123/"}, "authorships": [{"author": {"display_name": "Ann Roe"}}, {"raw_author_name": "Ring Consortium"}], "type": "Monograph", "primary_location": {"source": {"host_organization_name": "Wiley"}}},
        dict(title="A paper", pmid="123", authors=["roe"], corporate="Ring Consortium", item_type="book", publisher="Wiley"),
    ),
    "pubmed": ({"uid": 77, "title": "A paper.", "authors": [{"name": "Murray CJL"}], "articleids": [{"idtype": "doi", "value": "10.1/y"}], "pubdate": "2003 Jan", "pages": "1-2", "source": "Ring"}, dict(pmid="77", authors=["cjl"], doi="10.1/y", year=2003, journal="Ring", journal_abbrev="Ring")),
    "semanticscholar": ({"title": "A paper", "externalIds": {"PubMed": 5}, "authors": [{"name": "A Roe"}], "publicationTypes": ["Review", "Book"], "journal": {"pages": "4-6", "volume": " 9 "}, "venue": "V"}, dict(pmid="5", authors=["roe"], item_type="book", volume="9", last_page="6", journal="V")),
}


def test_adapters(spark):
    for provider, (record, want) in RECORDS.items():
        df = spark.createDataFrame([(1, json.dumps(record)), (2, "{broken"), (3, "{}")], "id int, json string")
        rows = {r.id: r for r in candidates_from_json(df, provider).collect()}
        assert {k: rows[1][k] for k in want} == want, provider
        assert rows[2].title == rows[3].title == "" and rows[3].authors == [] and rows[3].providers == [provider]


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:r><w:t>See</w:t><w:tab/></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>1,2</w:t></w:r></w:p><w:tbl/><w:p><w:pPr><w:sectPr/></w:pPr><w:r><w:drawing/></w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows, errors = read_docx(spark, str(tmp_path))
    got = rows.orderBy("para_idx").collect()
    assert [(r.text, [x.superscript for x in r.runs], r.prev_is_table, r.has_image, r.has_sect) for r in got] == [("See\t1,2", [False, True], False, False, False), ("", [False], True, True, True)]
    assert [r.doc_id.endswith("b.docx") for r in errors.collect()] == [True]


def test_streamed_references_resolve_like_a_batch(spark, sf_dir, tmp_path):
    refs = fixtures.refs(spark, sf_dir).where("n < 20").select(F.lit(1).alias("doc_id"), "n", "raw")
    refs.write.parquet(str(tmp_path / "in"))
    cands = fixtures.candidates(spark, sf_dir).withColumn("cid", F.col("paper_id") * 10 + F.col("arrival"))
    got = []
    stream = spark.readStream.schema(refs.schema).parquet(str(tmp_path / "in"))
    resolve_stream(stream, cands, lambda df, _: got.extend(df.collect()), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert sorted((r.n, r.tier) for r in got if r.n < 10)[3:8] == [(3, "from-reference-text"), (4, "fingerprint"), (5, "title+journal+author"), (6, "identifier"), (7, "identifier")]


def test_reference_arrays_of_many_manuscripts_in_a_file(spark, tmp_path):
    from biblink.sources import bibliography

    refs = {"7": ['Roe "A".\nOne', "Doe é", None], "8": [], "9": ["Poe"]}
    (tmp_path / "one").mkdir()
    for k, v in refs.items():
        (tmp_path / "one" / f"{k}.txt").write_text(json.dumps(v))
    (tmp_path / "many.json").write_text("\n".join(json.dumps({"doc_id": k, "refs": v}) for k, v in refs.items()))
    one = {(r.doc_id.rsplit("/", 1)[1][:-4], r.n, r.raw) for r in bibliography.read_reference_array(spark, str(tmp_path / "one")).collect()}
    many = bibliography.read_reference_arrays(spark, str(tmp_path / "many.json"))
    assert {tuple(r) for r in many.collect()} == one == {("7", 1, refs["7"][0]), ("7", 2, "Doe é"), ("7", 3, None), ("9", 1, "Poe")}


def test_the_arrays_query_writes_few_files(spark, sf_dir):
    from biblink.plans.more_queries import reference_array

    assert len(reference_array(spark, sf_dir).inputFiles()) <= 4
