"""A bibliography, candidate records and manuscripts derived from the star-schema tables.

The SQL runs unchanged in Spark and in the oracle's engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..cuts import materialize

PAPERS = """
SELECT p_partkey AS paper_id,
 concat(upper(substring(p_name,1,1)), substring(p_name,2), ' ', lower(p_type), ' outcomes in cohort ', CAST(p_partkey AS VARCHAR(20))) AS title,
 CASE p_partkey % 8 WHEN 0 THEN 'Alder' WHEN 1 THEN 'Birch' WHEN 2 THEN 'Cedar' WHEN 3 THEN 'Dogwood' WHEN 4 THEN 'Elmer' WHEN 5 THEN 'Firth' WHEN 6 THEN 'Gorse' ELSE 'Hazel' END AS surname,
 CASE p_partkey % 4 WHEN 0 THEN 'J Appl Widget' WHEN 1 THEN 'Ann Gear Sci' WHEN 2 THEN 'Int J Bolt Res' ELSE 'Ring' END AS jabbr,
 CASE p_partkey % 4 WHEN 0 THEN 'Journal of Applied Widgetry' WHEN 1 THEN 'Annals of Gear Science' WHEN 2 THEN 'International Journal of Bolt Research' ELSE 'The Ring' END AS jfull,
 CAST(1980 + p_partkey % 40 AS INT) AS year, CAST(1 + p_partkey % 97 AS VARCHAR(9)) AS vol, CAST(1 + p_size % 12 AS VARCHAR(9)) AS issue,
 CAST(1 + (p_partkey*7) % 1500 AS VARCHAR(9)) AS fp, CAST(1 + (p_partkey*7) % 1500 + p_size % 15 AS VARCHAR(9)) AS lp,
 concat('10.5555/w.', CAST(p_partkey AS VARCHAR(20))) AS doi, CAST(30000000 + p_partkey AS VARCHAR(20)) AS pmid
FROM part
"""

REFS = f"""
SELECT o.o_orderkey AS n, o.o_orderkey % 10 AS variant, p.paper_id AS truth,
 concat(p.surname, ' AB. ',
  CASE WHEN o.o_orderkey % 10 = 4 THEN regexp_replace(p.title, ' [0-9]+$', '') ELSE p.title END, '. ',
  CASE WHEN o.o_orderkey % 10 = 8 THEN 'Other Letters' ELSE p.jabbr END, '. ',
  CAST(CASE WHEN o.o_orderkey % 10 = 2 THEN p.year+1 WHEN o.o_orderkey % 10 = 3 THEN p.year+2 ELSE p.year END AS VARCHAR(9)),
  CASE WHEN o.o_orderkey % 10 = 5 THEN '.' ELSE concat(';', CASE WHEN o.o_orderkey % 10 = 1 THEN '999' ELSE p.vol END, '(', p.issue, '):', p.fp, '-', p.lp, '.') END,
  CASE WHEN o.o_orderkey % 10 = 6 THEN concat(' doi:', p.doi, '.') WHEN o.o_orderkey % 10 = 7 THEN concat(' PMID: ', p.pmid, '.') ELSE '' END) AS raw
FROM (SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM part) AS cited FROM orders) o JOIN ({PAPERS}) p ON p.paper_id = o.cited
"""

#: The same papers with titles that have no near neighbour.
UNLIKE_PAPERS = PAPERS.replace("CAST(p_partkey AS VARCHAR(20))) AS title", "CAST(p_partkey AS VARCHAR(20)), ' ', md5(CAST(p_partkey AS VARCHAR(20)))) AS title")

CANDIDATES = f"""
SELECT 1 AS arrival, 'crossref' AS provider, paper_id, title, doi, CAST(NULL AS VARCHAR(20)) AS pmid, lower(surname) AS author, year, jfull AS journal, '' AS journal_abbrev, vol AS volume, issue, fp AS first_page, lp AS last_page FROM ({PAPERS}) p1
UNION ALL
SELECT 2, 'europepmc', paper_id, title, upper(doi), pmid, lower(surname), year, jfull, jabbr, vol, issue, fp, lp FROM ({PAPERS}) p2 WHERE paper_id % 3 = 0
UNION ALL
SELECT 3, 'pubmed', paper_id, title, NULL, pmid, 'ab', year, jfull, jabbr, vol, issue, fp, lp FROM ({PAPERS}) p3 WHERE paper_id % 5 IN (0, 2)
UNION ALL
SELECT 4, 'openalex', paper_id, upper(title), NULL, NULL, lower(surname), year, jfull, '', NULL, NULL, NULL, NULL FROM ({PAPERS}) p4 WHERE paper_id % 4 = 0
"""

UNLIKE_CANDIDATES = CANDIDATES.replace(PAPERS, UNLIKE_PAPERS)

#: Twenty references to a manuscript: body, heading, wrapped entries, caption.
LINES = f"""
SELECT n // 20 AS doc_id, CAST(100 + 2 * (n % 20) AS INT) AS line_no,
 CASE WHEN n % 3 = 0 THEN concat('[', CAST(n % 20 + 1 AS VARCHAR(9)), '] ') WHEN n % 3 = 1 THEN concat(CAST(n % 20 + 1 AS VARCHAR(9)), '. ') ELSE concat(CAST(n % 20 + 1 AS VARCHAR(9)), ' ') END || CASE WHEN n % 7 = 0 THEN substring(raw, 1, 30) ELSE raw END AS text
 FROM ({REFS}) r1
UNION ALL SELECT n // 20, CAST(101 + 2 * (n % 20) AS INT), CASE WHEN n % 7 = 0 THEN concat('  ', substring(raw, 31)) ELSE '' END FROM ({REFS}) r2
UNION ALL SELECT DISTINCT n // 20, 1, 'Body text of the manuscript.' FROM ({REFS}) r3
UNION ALL SELECT DISTINCT n // 20, 2, CASE WHEN n // 20 % 2 = 0 THEN 'References' ELSE ' BIBLIOGRAPHY : ' END FROM ({REFS}) r4
UNION ALL SELECT DISTINCT n // 20, 900, 'Figures' FROM ({REFS}) r5 WHERE n // 20 % 3 > 0
UNION ALL SELECT DISTINCT n // 20, 901, 'Figure 1. Trailing matter' FROM ({REFS}) r6
"""

_FORM = "o_orderkey % 14"
SENTENCES = f"""
SELECT o_orderkey AS doc_id, CASE
 WHEN {_FORM} = 0 THEN concat('As shown before [', CAST(1 + o_orderkey % 9 AS VARCHAR(9)), '] and (', CAST(2 + o_orderkey % 5 AS VARCHAR(9)), ', 9) later.')
 WHEN {_FORM} = 1 THEN concat('In better systems.', CAST(1 + o_orderkey % 12 AS VARCHAR(9)), '-', CAST(14 + o_orderkey % 5 AS VARCHAR(9)), ' The rest follows.')
 WHEN {_FORM} = 2 THEN concat('Pain fell in knee OA ', CAST(1 + o_orderkey % 12 AS VARCHAR(9)), '.')
 WHEN {_FORM} = 3 THEN concat('We enrolled ', CAST(1 + o_orderkey % 12 AS VARCHAR(9)), ' patients, group ', CAST(1 + o_orderkey % 3 AS VARCHAR(9)), '.')
 WHEN {_FORM} = 4 THEN 'Relief was short-lived 6,7. After 3 months 6,8. By month 1, none.'
 WHEN {_FORM} = 5 THEN 'Growth was steady²⁻⁴ but R²=0.3 and 10³ remain;¹·³'
 WHEN {_FORM} = 6 THEN 'Scores (0-10) rose (1990-2023) in both [14-49].'
 WHEN {_FORM} = 7 THEN 'Adults aged 45 years. 1 According to 2, 3, 1 losses'
 WHEN {_FORM} = 8 THEN 'Counted 4,326 cases 3,4 overall [5, 6] . Done'
 WHEN {_FORM} = 9 THEN concat('No markers, p=0.05 in ', CAST(o_orderkey AS VARCHAR(20)), 'x')
 WHEN {_FORM} = 10 THEN 'End of clause 12; next (3, 2-5)'
 WHEN {_FORM} = 11 THEN 'x² then word,7,9 and more [ 3 – 5 ]'
 WHEN {_FORM} = 12 THEN 'alpha 3.5 beta 4 % gamma 5 mL delta 0. eps 11'
 ELSE 'See [1], [30] and [2-3].' END AS text
FROM orders
"""

LIBRARY = f"""
SELECT concat('K', CAST(paper_id AS VARCHAR(20))) AS key, CASE WHEN paper_id % 7 = 0 THEN doi END AS doi, title, CAST(year AS VARCHAR(9)) AS date
FROM ({PAPERS}) p WHERE paper_id % 7 = 0 OR paper_id % 11 = 0
"""


#: A reference for each paper, of eight kinds that other layers than the plain ones decide.
#: Titles that only two indexes together raise over their neighbours are left to those papers.
ODD_FORM = "CASE WHEN paper_id % 8 = 3 AND paper_id % 3 > 0 THEN 2 ELSE paper_id % 8 END"
ODD_REFS = f"""
SELECT paper_id AS n, form, concat(
 CASE form WHEN 5 THEN 'World Health Group' WHEN 6 THEN 'Quux AB' ELSE concat(surname, ' AB') END, '. ',
 CASE form WHEN 1 THEN 'Qzx vvk jjw zzq' WHEN 2 THEN 'Kkq wwz xjj vvq' WHEN 7 THEN replace(title, 'outcomes', 'outcome') ELSE title END, '. ',
 CASE form WHEN 0 THEN concat('2nd edn. New York, NY: Wiley; ', CAST(year AS VARCHAR(9)), '.')
  WHEN 1 THEN concat(jabbr, '. ', CAST(year AS VARCHAR(9)), ';', vol, '(', issue, '):', fp, '-', lp, '.')
  WHEN 2 THEN 'Vvx Qkj. 1971.'
  WHEN 3 THEN concat('Other Letters. ', CAST(year + 5 AS VARCHAR(9)), '.')
  WHEN 4 THEN concat('Other Letters. ', CAST(year AS VARCHAR(9)), '.')
  WHEN 5 THEN concat(jabbr, '. ', CAST(year AS VARCHAR(9)), ';', vol, '(', issue, '):', fp, '-', lp, '.')
  WHEN 6 THEN concat('Other Letters. ', CAST(year + 5 AS VARCHAR(9)), ';999(1):3-4.')
  ELSE concat(jabbr, '. ', CAST(year AS VARCHAR(9)), '.') END) AS raw
FROM (SELECT *, {ODD_FORM} AS form FROM ({UNLIKE_PAPERS}) p) o
"""


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture's rows; the base tables are passed by name, no view is left behind."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders")}
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"FROM {t})", f"FROM {{{t}}})")
    return spark.sql(text.replace("n // 20", "n div 20"), **tables)


def papers(spark, sf_dir):
    return fixture(spark, sf_dir, PAPERS)


def refs(spark, sf_dir):
    return fixture(spark, sf_dir, REFS)


def lines(spark, sf_dir):
    """The manuscripts' lines, written once: a reference list reads them several times."""
    return materialize(fixture(spark, sf_dir, LINES), "lines")


def candidates(spark, sf_dir, sql=CANDIDATES):
    """Candidate rows in the library's schema."""
    from pyspark.sql import functions as F

    return fixture(spark, sf_dir, sql).select(
        "arrival", "provider", "paper_id", "title", "doi", "pmid", F.array("author").alias("authors"), F.lit(None).cast("string").alias("corporate"), "year", "journal", "journal_abbrev",
        "volume", "issue", "first_page", "last_page", F.lit("journalArticle").alias("item_type"), F.array("provider").alias("providers"),
    )
