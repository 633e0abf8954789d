from biblink.operators.parse import parse_references
from biblink.sources import bibliography as bib

CASES = [
    ("1. Vos T, Lim SS, et al. Global burden of things. Lancet 2017;390(10111):2437-60.", dict(authors=["Vos", "Lim"], title="Global burden of things", journal="Lancet", year=2017, volume="390", issue="10111", first_page="2437", last_page="2460")),
    ("[2] Roe A. On supplements. J Bone. 2011;63 Suppl 11:S240-52.", dict(volume="63", first_page="S240", last_page="S252", journal="J Bone")),
    ("Poe B. Lettered volumes. Bone Joint J. 2018;100-B(8):991-1001.", dict(volume="100-B", issue="8", last_page="1001")),
    ("Doe C. Two letters. J Clin. 2016;10(9):UC05-7.", dict(first_page="UC05", last_page="UC07")),
    ("Fox D. Electronic pages. BMJ. 2012;10:e1339-51.", dict(first_page="e1339", last_page="e1351", issue=None)),
    ("GBD 2021 Low Back Pain Collaborators. A study. Lancet Rheumatol. 2023;5:316-29.", dict(authors=[], corporate="GBD 2021 Low Back Pain Collaborators", title="A study", last_page="329")),
    ("Ng E. Not yet printed. Lancet. 2024.", dict(title="Not yet printed", journal="Lancet", year=2024, volume=None)),
    ("Orr F. Methods of rings. 3rd edn. Amsterdam: North-Holland; 1967.", dict(is_book=True, edition="3rd", place="Amsterdam", publisher="North-Holland", year=1967, title="Methods of rings")),
    ("Pym G. A chapter. In: Quy H, Rex I, eds. The big book, 2nd edn. Oxford: OUP, 2013: 1113-36.", dict(is_chapter=True, title="A chapter", book_title="The big book", edition="2nd", publisher="OUP", year=2013, first_page="1113", last_page="1136")),
    ("Sky J. Linked. Ring. 2001;1:1. doi:10.1234/AbC.", dict(doi="10.1234/abc", journal="Ring")),
    ("Tee K. Numbered. PMID: 12345678 PMC7654321", dict(pmid="12345678", pmcid="PMC7654321")),
    ("Uhl L, Vox M. Is it so? Ann Gear Sci. 1999;4(1–2):7–9.", dict(title="Is it so?", journal="Ann Gear Sci", issue="1-2", last_page="9")),
    ("World Health Organization. Plans for 1990 and 2030", dict(corporate="World Health Organization", year=2030)),
    ("", dict(title="", year=None)),
]


def test_reference_shapes(spark):
    df = spark.createDataFrame([(i, raw, "x") for i, (raw, _) in enumerate(CASES)], "n int, raw string, title string")
    got = {r.n: r for r in parse_references(df).collect()}
    for i, (raw, want) in enumerate(CASES):
        assert {k: got[i][k] for k in want} == want, raw


def test_bibliography_of_a_manuscript(spark):
    lines = ["Body", "References :", "intro that is dropped", "1. First entry", "   goes on", "", "[2] Second entry", "2) Second again", "3 Third by em space", "Figure 1. A caption", "Tables", "4. Not reached"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, text string")
    assert [tuple(r) for r in bib.bounds(df).collect()] == [(1, 1, 9)]
    rows = {r.n: r.raw for r in bib.segment(df.where("line_no between 2 and 8")).collect()}
    assert rows == {1: "First entry goes on", 2: "Second again", 3: "Third by em space"}
    plain = spark.createDataFrame([(2, 0, "Alpha"), (2, 1, ""), (2, 2, "Beta"), (2, 3, "Appendix"), (2, 4, "Gamma")], "doc_id int, line_no int, text string")
    assert {r.n: r.raw for r in bib.segment(plain).collect()} == {1: "Alpha", 2: "Beta"}
