"""The queries' equivalents in the oracle's SQL dialect."""

from __future__ import annotations

from ..functions.text import CONSORTIUM_TAILS, JOURNAL_STOPWORDS, SUPERSCRIPTS, TITLE_STOPWORDS
from ..sources.bibliography import LEAD
from . import citation_oracles
from . import fixtures as fx
from .queries import KNOWN


def _words(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def tokens(x: str, drop=()) -> str:
    test = f"t <> '' AND t NOT IN ({_words(drop)})" if drop else "t <> ''"
    return f"list_filter(string_split({x}, ' '), lambda t: {test})"


def norm(x: str) -> str:
    s = f"lower(strip_accents(coalesce({x}, '')))"
    s = f"regexp_replace(regexp_replace({s}, '<[^>]+>', ' ', 'g'), '&(amp|lt|gt|quot|apos);', ' ', 'g')"
    return f"array_to_string({tokens(f'''regexp_replace({s}, '[^a-z0-9]+', ' ', 'g')''', TITLE_STOPWORDS)}, ' ')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def surname(x: str) -> str:
    return squeeze(f"regexp_replace(lower(strip_accents({x})), '[^a-z\\s-]', '', 'g')")


def lcs(a: str, b: str) -> str:
    """Dynamic programming, a row at a time."""
    return (
        f"list_extract(list_reduce(list_transform(string_split({a}, ''), lambda c: [CAST(ord(c) AS BIGINT)]), "
        f"lambda p, e: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), "
        f"lambda r, k: list_append(r, CASE WHEN ord(substring({b}, CAST(k[1] AS BIGINT), 1)) = e[1] THEN p[k[1]] + 1 ELSE greatest(p[k[1] + 1], r[k[1]]) END), [CAST(0 AS BIGINT)]), "
        f"list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT))), length({b}) + 1)"
    )


def ratio(a: str, b: str) -> str:
    both = f"CAST(length({a}) + length({b}) AS DOUBLE)"
    return f"CASE WHEN {both} = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE (1.0::DOUBLE - ({both} - 2 * {lcs(a, b)}) / {both}) * 100.0::DOUBLE END"


PAIRS = "(SELECT a.p_partkey AS id, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) pairs"
SORTED_PAIRS = f"(SELECT id, array_to_string(list_sort(string_split(a, ' ')), ' ') AS a, array_to_string(list_sort(string_split(b, ' ')), ' ') AS b FROM {PAIRS}) sorted"
_JOIN = lambda x: f"array_to_string(list_sort({x}), ' ')"
SETS = f"""(SELECT id, ta, tb, shared, {_JOIN("list_filter(ta, lambda t: NOT list_contains(tb, t))")} AS a, {_JOIN("list_filter(tb, lambda t: NOT list_contains(ta, t))")} AS b,
  length({_JOIN("shared")}) AS ls, CASE WHEN len(shared) > 0 THEN 1 ELSE 0 END AS gap
  FROM (SELECT id, ta, tb, list_filter(ta, lambda t: list_contains(tb, t)) AS shared FROM (SELECT id, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM {PAIRS}) s0) s1) sets"""
_A, _B = "(ls + gap + length(a))", "(ls + gap + length(b))"
_COMMON = f"(CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0 ELSE {lcs('a', 'b')} END)"
SET_RATIO = f"""CASE WHEN len(shared) > 0 AND (a = '' OR b = '') THEN 100.0
  WHEN ls = 0 THEN 100.0 - 100.0 * (length(a) + length(b) - 2 * {_COMMON})::DOUBLE / (length(a) + length(b))
  ELSE greatest(100.0 - 100.0 * (length(a) + length(b) - 2 * {_COMMON})::DOUBLE / ({_A} + {_B}), 100.0 - 100.0 * (gap + length(a))::DOUBLE / (ls + {_A}), 100.0 - 100.0 * (gap + length(b))::DOUBLE / (ls + {_B})) END"""

NAMES = f"""(SELECT paper_id, CASE paper_id % 5 WHEN 0 THEN concat(surname, ', Ann B') WHEN 1 THEN concat('Ann B ', surname) WHEN 2 THEN concat('Ludwig van der ', surname)
 WHEN 3 THEN concat('Müller-', surname) ELSE concat('  ', surname, ' É.B.  ') END AS name FROM ({fx.PAPERS}) p) names"""
LOCATOR = r"((?:19|20)\d{2});(\d+)\((\d+)\):(\d+)-(\d+)\."
CANDS = f"(SELECT *, paper_id * 10 + arrival AS cid FROM ({fx.CANDIDATES}) c0)"

#: Which fields a reference has by its variant, told from how the fixture is made.
FACTS = f"""(SELECT r.n, r.variant, p.*, CASE r.variant WHEN 4 THEN regexp_replace(p.title, ' [0-9]+$', '') ELSE p.title END AS r_title,
 CASE r.variant WHEN 8 THEN 'Other Letters' ELSE p.jabbr END AS r_journal, p.year + CASE r.variant WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS r_year,
 CASE r.variant WHEN 5 THEN NULL WHEN 1 THEN '999' ELSE p.vol END AS r_vol, CASE r.variant WHEN 5 THEN NULL ELSE p.issue END AS r_issue, CASE r.variant WHEN 5 THEN NULL ELSE p.fp END AS r_fp, CASE r.variant WHEN 5 THEN NULL ELSE p.lp END AS r_lp
 FROM ({fx.REFS}) r JOIN ({fx.PAPERS}) p ON p.paper_id = r.truth) facts"""

#: Merged candidates of a paper: those with its DOI, and the ones without a DOI by title and year.
MERGED = f"""(SELECT paper_id, k, min(arrival) AS arrival, arg_min(provider, (-rich, arrival)) AS provider, arg_min(pmid, (-rich, arrival)) AS pmid, arg_min(CASE WHEN has_doi = 1 THEN k END, (-rich, arrival)) AS doi,
  string_agg(provider, ',' ORDER BY provider) AS providers, count(*) AS votes, arg_min(author, (-rich, arrival)) AS author, arg_min(jfull, (-rich, arrival)) AS jfull, arg_min(volume, (-rich, arrival)) AS volume, arg_min(first_page, (-rich, arrival)) AS first_page, arg_min(last_page, (-rich, arrival)) AS last_page, arg_min(has_pmid, (-rich, arrival)) AS has_pmid, max(has_doi) AS has_doi
 FROM (SELECT paper_id, arrival, provider, pmid, author, journal AS jfull, volume, first_page, last_page, coalesce(lower(doi), concat(lower(title), '|', year)) AS k, CASE WHEN doi IS NULL THEN 0 ELSE 1 END AS has_doi, CASE WHEN pmid IS NULL THEN 0 ELSE 1 END AS has_pmid,
   CASE WHEN doi IS NULL THEN 0 ELSE 1 END + CASE WHEN pmid IS NULL THEN 0 ELSE 1 END + CASE WHEN volume IS NULL THEN 0 ELSE 1 END + CASE WHEN first_page IS NULL THEN 0 ELSE 1 END + 3 AS rich FROM ({fx.CANDIDATES}) c1) c2 GROUP BY paper_id, k) merged"""

#: Signals of references and the merged candidates that bear their title.
SIGNALS = f"""(SELECT f.n, f.variant, m.arrival, 1.0::DOUBLE AS title_sim, CAST(abs(f.r_year - f.year) AS INT) AS year_delta, lower(f.surname) = m.author AS author_ok, CASE WHEN lower(f.surname) = m.author THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS author_overlap,
  FALSE AS corporate_ok, f.variant <> 8 AS journal_ok, coalesce(f.r_vol = m.volume, FALSE) AS volume_ok, coalesce(f.r_fp = m.first_page, FALSE) AS first_page_ok, coalesce(f.r_lp = m.last_page, FALSE) AS last_page_ok,
  TRUE AS type_ok, CAST(m.votes AS INT) AS n_providers, FALSE AS ecitmatch, m.has_doi, m.has_pmid
 FROM {FACTS.replace(") facts", ") f")} JOIN {MERGED.replace(") merged", ") m")} ON m.paper_id = f.paper_id WHERE f.variant <> 4) signals"""
CONFIDENCE = """greatest(0.0, least(1.0, 0.42::DOUBLE * title_sim + CASE year_delta WHEN 0 THEN 0.14::DOUBLE WHEN 1 THEN 0.07::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN author_ok THEN 0.10::DOUBLE ELSE 0.06::DOUBLE * author_overlap END
  + CASE WHEN journal_ok THEN 0.09::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN volume_ok AND first_page_ok THEN 0.09::DOUBLE WHEN volume_ok OR first_page_ok THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN last_page_ok THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END + least(0.05::DOUBLE, 0.025::DOUBLE * (n_providers - 1))))"""

#: PubMed has a record of the paper; it answers PMIDs and the citation match.
_IN_PUBMED = "truth % 5 IN (0, 2)"
#: Outcomes of the cascade by variant: the year is two off, the volume is wrong, no locator, a
#: DOI, a PMID, another journal; the others agree in all.
OUTCOME = f"""CASE variant WHEN 3 THEN 'FROM_TEXT' ELSE 'ACCEPTED' END AS status,
 CASE WHEN variant = 3 THEN 'from-reference-text' WHEN variant IN (1, 5) THEN 'title+journal+author' WHEN variant = 6 OR variant = 7 AND {_IN_PUBMED} THEN 'identifier' WHEN variant IN (0, 4, 9) AND {_IN_PUBMED} THEN 'ecitmatch' ELSE 'fingerprint' END AS tier,
 CAST(CASE WHEN variant = 3 THEN 0.80 WHEN variant IN (1, 5) THEN 0.93 WHEN variant = 6 OR variant = 7 AND {_IN_PUBMED} THEN 1.0 WHEN variant IN (0, 4, 9) AND {_IN_PUBMED} THEN 0.99 ELSE 0.97 END AS DOUBLE) AS confidence"""
#: The richer of the records with the paper's DOI.
_RICH = "CASE WHEN {0} % 3 = 0 THEN 2 ELSE 1 END"
#: Told where a place or an identifier decides; by title alone a neighbour may rank first.
CHOSEN = f"""CASE WHEN variant = 6 THEN CAST(truth * 10 + 1 AS VARCHAR) WHEN variant IN (0, 4, 7, 9) AND {_IN_PUBMED} THEN CAST(truth * 10 + 3 AS VARCHAR) WHEN variant NOT IN (1, 3, 5) THEN CAST(truth * 10 + {_RICH.format('truth')} AS VARCHAR) END AS candidate"""
_TEXT_REASON = "'no index holds this {0}; item built from the reference text (no external corroboration)'"
#: The eight kinds of odd references: a book; a place without the title; nothing; a journal and a
#: year that are off; another journal; a corporate author; wrong authors and journal; a slip.
ODD = f"""SELECT paper_id AS n,
  CASE form WHEN 0 THEN 'FROM_TEXT' WHEN 1 THEN 'FROM_TEXT' WHEN 6 THEN 'FROM_TEXT' WHEN 2 THEN 'REVIEW' WHEN 3 THEN 'REVIEW' ELSE 'ACCEPTED' END AS status,
  CASE WHEN form IN (0, 1, 6) THEN 'from-reference-text' WHEN form IN (2, 3) THEN 'none' WHEN form = 4 AND paper_id % 3 = 0 THEN 'provider-agreement' WHEN form = 4 THEN 'exact-title'
   WHEN form = 5 AND paper_id % 5 IN (0, 2) THEN 'ecitmatch' WHEN form = 5 THEN 'fingerprint' ELSE 'title+journal+author' END AS tier,
  CAST(CASE WHEN form IN (0, 1, 6) THEN 0.8 WHEN form = 2 THEN 0.0 WHEN form = 3 THEN 0.545 WHEN form = 4 AND paper_id % 3 = 0 THEN 0.9 WHEN form = 4 THEN 0.88 WHEN form = 5 AND paper_id % 5 IN (0, 2) THEN 0.99 WHEN form = 5 THEN 0.97 ELSE 0.93 END AS DOUBLE) AS confidence,
  CASE WHEN form IN (0, 1, 2, 3, 6) THEN NULL WHEN form = 5 AND paper_id % 5 IN (0, 2) THEN CAST(paper_id * 10 + 3 AS VARCHAR) ELSE CAST(paper_id * 10 + {_RICH.format('paper_id')} AS VARCHAR) END AS candidate,
  CASE WHEN form = 0 THEN {_TEXT_REASON.format('book')} WHEN form IN (1, 6) THEN {_TEXT_REASON.format('article')} WHEN form = 2 THEN 'no candidates returned by any provider'
   WHEN form = 3 THEN 'best candidate rejected: year differs by 5; no volume/first page match; journal mismatch' ELSE '' END AS reason,
  CASE WHEN form = 1 AND paper_id % 5 IN (0, 2) THEN concat('nothing at ', jabbr, ' ', year, ';', vol, ':', fp, ' matches this title — check the journal name and volume/page numbers.')
   WHEN form = 6 THEN concat('VERIFY THIS ENTRY: the title matches a real paper (', doi, ', ', jfull, ' ', year, ') whose authors (', surname, ') and journal differ entirely from this reference (Quux, Other Letters). Confirm the reference exists as cited.')
   ELSE '' END AS notes FROM (SELECT *, {fx.ODD_FORM} AS form FROM ({fx.UNLIKE_PAPERS}) p) o"""

_LINE = f"(SELECT doc_id, line_no, text AS t FROM ({fx.LINES}) l0 WHERE line_no > 2)"
_SENT = f"({fx.SENTENCES}) s"
_GROUP = r"[\[(]\s*([\d\s,\-–—]+?)\s*[\])]"
_NUMBERS = r"\d{1,3}(?:\s*[-–—]\s*\d{1,3})?(?:\s*,\s*\d{1,3}(?:\s*[-–—]\s*\d{1,3})?)*"
_ITEMS = f"(SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN upper(doi) END AS doi, lower(title) AS t, CAST(year AS VARCHAR) AS date FROM ({fx.PAPERS}) p)"
_SHELF = f"(SELECT key, doi, concat(lower(title), '|', date) AS t FROM ({fx.LIBRARY}) l)"
_REUSE = f"""SELECT i.paper_id, coalesce(min(d.key), min(t.key)) AS key FROM {_ITEMS} i LEFT JOIN {_SHELF} d ON d.doi = lower(i.doi) LEFT JOIN {_SHELF} t ON t.t = concat(i.t, '|', i.date) GROUP BY i.paper_id"""
_RANGE = "list_transform(range({0}, {1} + 1), lambda x: CAST(x AS VARCHAR))"

SQL = {
    "norm_text_documents": f"SELECT doc_id, CAST(length(x) AS BIGINT) AS norm_chars, sha1(x) AS norm_sha1 FROM (SELECT doc_id, {norm('text')} AS x FROM documents) d",
    "strip_accents_documents": "SELECT doc_id, sha1(strip_accents(text)) AS plain_sha1 FROM documents",
    "equal_after_norm": f"SELECT sha1(x) AS ref_key, count(*) AS copies, min(doc_id) AS first_id FROM (SELECT doc_id, {norm('text')} AS x FROM documents) d GROUP BY x HAVING count(*) > 1",
    "ref_key_sha1": f"SELECT n, sha1({norm('raw')}) AS ref_key FROM ({fx.REFS}) r",
    "norm_doi": f"SELECT cid, CASE WHEN doi IS NULL THEN NULL ELSE lower(doi) END AS doi, CASE WHEN doi IS NULL THEN NULL WHEN paper_id % 3 = 0 THEN NULL ELSE lower(doi) END AS typed_doi FROM {CANDS} c",
    "norm_surname": f"SELECT paper_id, {surname('name')} AS surname FROM {NAMES}",
    "surname_of": f"""SELECT paper_id, CASE paper_id % 5 WHEN 2 THEN concat('van der ', lower(surname)) WHEN 3 THEN concat('muller-', lower(surname)) WHEN 4 THEN 'eb' ELSE lower(surname) END AS surname FROM ({fx.PAPERS}) p""",
    "journal_tokens": f"SELECT paper_id, array_to_string({tokens('lower(jfull)', JOURNAL_STOPWORDS)}, '|') AS tokens FROM ({fx.PAPERS}) p",
    "consortium_key": "SELECT paper_id, " + squeeze("".join(["replace("] * len(CONSORTIUM_TAILS)) + norm("concat('The ', title, ' Study Group Collaborators')") + "".join(f", '{t}', ' ')" for t in CONSORTIUM_TAILS)) + f" AS key FROM ({fx.PAPERS}) p",
    "fold_superscripts": f"SELECT doc_id, translate(text, '{SUPERSCRIPTS}', '0123456789-,') AS folded FROM {_SENT}",
    "fmt2_half_even": "SELECT p_partkey, printf('%.2f', p_retailprice / 8.0::DOUBLE) AS shown FROM part",
    "search_values": f"SELECT paper_id, concat(title, ' a new old trial none x y') AS phrase, concat(title, ' a new AND old trial OR none x y') AS filter FROM ({fx.PAPERS}) p",
    "biblio_bounds": f"SELECT doc_id, 2 AS start, CAST(max(line_no) + 1 AS INT) AS stop FROM ({fx.LINES}) l WHERE line_no BETWEEN 3 AND 899 AND trim(text) <> '' GROUP BY doc_id",
    "biblio_segment": f"""WITH used AS (SELECT doc_id, line_no, t, regexp_matches(t, '{LEAD}') AS lead FROM {_LINE} x WHERE trim(t) <> '' AND line_no < 900
   UNION ALL SELECT doc_id, line_no, t, FALSE FROM {_LINE} y WHERE line_no >= 901 AND doc_id % 3 = 0),
  marked AS (SELECT *, sum(CASE WHEN lead THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS entry FROM used),
  entries AS (SELECT doc_id, entry, max(CASE WHEN lead THEN CAST(regexp_extract(t, '{LEAD}', 1) AS INT) END) AS n, trim(string_agg(CASE WHEN lead THEN regexp_extract(t, '{LEAD}', 2) ELSE trim(t) END, ' ' ORDER BY line_no)) AS raw FROM marked WHERE entry > 0 GROUP BY doc_id, entry)
  SELECT doc_id, n, arg_max(raw, entry) AS raw FROM entries GROUP BY doc_id, n""",
    "parse_identifiers": f"SELECT n, CASE WHEN variant = 6 THEN doi END AS doi, CASE WHEN variant = 7 THEN pmid END AS pmid, CAST(NULL AS VARCHAR) AS pmcid FROM {FACTS}",
    "parse_locator": f"""SELECT n, CASE WHEN m THEN CAST(regexp_extract(raw, '{LOCATOR}', 1) AS INT) ELSE y END AS year, nullif(regexp_extract(raw, '{LOCATOR}', 2), '') AS volume, nullif(regexp_extract(raw, '{LOCATOR}', 3), '') AS issue, nullif(regexp_extract(raw, '{LOCATOR}', 4), '') AS first_page,
   CASE WHEN m THEN concat(substring(regexp_extract(raw, '{LOCATOR}', 4), 1, greatest(0, CAST(length(regexp_extract(raw, '{LOCATOR}', 4)) - length(regexp_extract(raw, '{LOCATOR}', 5)) AS INT))), regexp_extract(raw, '{LOCATOR}', 5)) END AS last_page
   FROM (SELECT n, raw, regexp_matches(raw, '{LOCATOR}') AS m, CAST(regexp_extract(raw, '((?:19|20)\\d\\d)\\.$', 1) AS INT) AS y FROM (SELECT n, raw, variant FROM ({fx.REFS}) r0) r1 WHERE variant = 5 UNION ALL SELECT n, raw, TRUE, NULL FROM ({fx.REFS}) r2 WHERE variant <> 5) r""",
    "parse_title_journal": f"SELECT n, surname AS authors, CAST(NULL AS VARCHAR) AS corporate, r_title AS title, r_journal AS journal, FALSE AS is_book FROM {FACTS}",
    "parse_books": f"""SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN concat(surname, '|Roe') ELSE surname END AS authors, title, CASE WHEN paper_id % 2 = 0 THEN concat('Book of ', jfull) ELSE '' END AS book_title, CASE WHEN paper_id % 2 = 0 THEN '4th' ELSE '2nd' END AS edition,
   CASE WHEN paper_id % 2 = 0 THEN 'Berlin' ELSE 'New York, NY' END AS place, CASE WHEN paper_id % 2 = 0 THEN 'Springer' ELSE 'Wiley' END AS publisher, year, CASE WHEN paper_id % 2 = 0 THEN '1113' END AS first_page, CASE WHEN paper_id % 2 = 0 THEN '1136' END AS last_page, TRUE AS is_book, paper_id % 2 = 0 AS is_chapter FROM ({fx.PAPERS}) p""",
    "parse_year_fallback": f"SELECT paper_id, year, 'World Health Group' AS corporate, '' AS journal FROM ({fx.PAPERS}) p",
    "expand_page": f"SELECT paper_id, concat('e', substring(CAST(paper_id + 1000 AS VARCHAR), 1, length(CAST(paper_id + 1000 AS VARCHAR)) - 2), CAST(paper_id % 90 + 10 AS VARCHAR)) AS last_page FROM ({fx.PAPERS}) p",
    "split_segments": f"""SELECT n, CAST(len(s) AS BIGINT) AS n_segments, array_to_string(s, '|') AS segments FROM (SELECT n, list_filter(string_split(regexp_replace(raw, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM ({fx.REFS}) r) q""",
    "lcs_pairs": f"SELECT id, CAST({lcs('a', 'b')} AS INT) AS lcs FROM {PAIRS}",
    "ratio": f"SELECT id, round({ratio('a', 'b')}, 9) AS ratio FROM {PAIRS}",
    "token_sort_ratio": f"SELECT id, round({ratio('a', 'b')}, 9) AS ratio FROM {SORTED_PAIRS}",
    "token_set_ratio": f"SELECT id, round(CAST({SET_RATIO} AS DOUBLE), 9) AS ratio FROM {SETS}",
    "title_similarity": f"""SELECT x.id, round(CASE WHEN p.a = p.b THEN 1.0 ELSE greatest(s.r, x.r) / 100.0 END, 9) AS similarity, round(CAST(least(na, nb + 1) AS DOUBLE) / greatest(na, nb + 1), 9) AS length_ratio
   FROM (SELECT id, CAST({SET_RATIO} AS DOUBLE) AS r FROM {SETS}) x JOIN (SELECT id, CAST({ratio('a', 'b')} AS DOUBLE) AS r FROM {SORTED_PAIRS}) s ON s.id = x.id
   JOIN (SELECT id, a, b, len(string_split(a, ' ')) AS na, len(string_split(b, ' ')) AS nb FROM {PAIRS}) p ON p.id = x.id""",
    "journal_match": f"SELECT p.paper_id, q.paper_id AS other_id, p.paper_id % 4 = q.paper_id % 4 AS ok FROM ({fx.PAPERS}) p JOIN ({fx.PAPERS}) q ON q.paper_id - q.paper_id % 2 = p.paper_id",
    "page_volume_equal": f"SELECT paper_id, TRUE AS same, vol = issue AS other, FALSE AS blank FROM ({fx.PAPERS}) p",
    "dedupe_candidates": f"SELECT paper_id, doi, provider, pmid, providers, CAST(votes AS INT) AS votes, arrival FROM {MERGED}",
    "identifier_join": f"""SELECT n, CASE variant WHEN 6 THEN 'doi' ELSE 'pmid' END AS by, paper_id * 10 + CASE WHEN variant = 6 THEN 1 ELSE 3 END AS cid, CASE WHEN variant = 6 THEN 'crossref' ELSE 'pubmed' END AS provider FROM {FACTS} WHERE variant = 6 OR variant = 7 AND paper_id % 5 IN (0, 2)""",
    "locator_match": f"SELECT f.n, c.cid FROM {FACTS.replace(') facts', ') f')} JOIN {CANDS} c ON c.volume = f.r_vol AND c.first_page = f.r_fp AND abs(c.year - f.r_year) <= 1",
    "title_match": f"SELECT f.n, c.cid FROM {FACTS.replace(') facts', ') f')} JOIN {CANDS} c ON lower(c.title) = lower(f.r_title)",
    "token_block_topk": f"""WITH t AS (SELECT DISTINCT paper_id, unnest({tokens(norm('title'))}) AS token FROM ({fx.PAPERS}) p), total AS (SELECT count(*) AS c FROM part),
  rare AS (SELECT token, count(*) AS df FROM t GROUP BY token HAVING count(*) <= greatest(1.0, 0.02 * (SELECT c FROM total))),
  met AS (SELECT a.paper_id AS n, b.paper_id, round(sum(ln((SELECT c FROM total)::DOUBLE / df)), 6) AS idf FROM t a JOIN t b ON a.token = b.token JOIN rare r ON r.token = a.token GROUP BY 1, 2)
  SELECT n, paper_id, idf, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY idf DESC, paper_id) AS place FROM met) m WHERE place <= 3""",
    "fallback_pass": f"""WITH first_pass AS (SELECT f.n, c.cid FROM {FACTS.replace(') facts', ') f')} JOIN {CANDS} c ON c.volume = f.r_vol AND c.first_page = f.r_fp AND abs(c.year - f.r_year) <= 1),
  second_pass AS (SELECT f.n, c.cid FROM {FACTS.replace(') facts', ') f')} JOIN {CANDS} c ON lower(c.title) = lower(f.r_title) WHERE f.n NOT IN (SELECT n FROM first_pass))
  SELECT n, count(*) AS candidates, min(cid) AS first_cid FROM (SELECT * FROM first_pass UNION ALL SELECT * FROM second_pass) x GROUP BY n""",
    "signals": f"SELECT n, arrival, title_sim, year_delta, author_ok, author_overlap, corporate_ok, journal_ok, volume_ok, first_page_ok, last_page_ok, type_ok, n_providers, ecitmatch FROM {SIGNALS}",
    "confidence": f"""SELECT n, arrival, round(conf, 9) AS confidence, CAST(row_number() OVER (PARTITION BY n ORDER BY conf DESC, last_page_ok DESC, journal_ok DESC, n_providers DESC, has_doi DESC, has_pmid DESC, arrival) AS INT) AS rank FROM (SELECT *, {CONFIDENCE} AS conf FROM {SIGNALS}) x""",
    "accept_gate": f"""SELECT n, arrival, tier <> 'none' AS ok, tier FROM (SELECT n, arrival, CASE WHEN year_delta > 1 THEN 'none' WHEN volume_ok AND first_page_ok THEN 'fingerprint' WHEN journal_ok AND author_ok THEN 'title+journal+author' WHEN n_providers >= 2 AND (journal_ok OR author_ok) THEN 'provider-agreement' WHEN author_ok THEN 'exact-title' ELSE 'none' END AS tier FROM {SIGNALS}) x""",
    "failing_reasons": f"""SELECT n, arrival, concat_ws('; ', CASE WHEN year_delta > 1 THEN concat('year differs by ', year_delta) END, CASE WHEN NOT (volume_ok AND first_page_ok) THEN concat('no ', concat_ws('/', CASE WHEN NOT volume_ok THEN 'volume' END, CASE WHEN NOT first_page_ok THEN 'first page' END), ' match') END,
   CASE WHEN NOT journal_ok THEN 'journal mismatch' END, CASE WHEN NOT author_ok THEN 'author mismatch' END) AS reasons FROM {SIGNALS}""",
    "cascade_status": f"SELECT n, {OUTCOME}, {CHOSEN}, CASE variant WHEN 3 THEN {_TEXT_REASON.format('article')} ELSE '' END AS reason FROM ({fx.REFS}) r",
    "cascade_layers": ODD,
    "status_counts": f"SELECT status, tier, count(*) AS n_refs FROM (SELECT {OUTCOME} FROM ({fx.REFS}) r) x GROUP BY status, tier",
    "correction_override": f"""WITH o AS (SELECT n, raw, {OUTCOME} FROM ({fx.REFS}) r), k8 AS (SELECT DISTINCT raw FROM o WHERE n % 20 = 8), kc AS (SELECT DISTINCT raw FROM o WHERE n % 20 IN (3, 6))
  SELECT n, CASE WHEN fixed OR cached THEN 'ACCEPTED' ELSE status END AS status, CASE WHEN fixed THEN 'correction' WHEN cached THEN 'fingerprint' ELSE tier END AS tier, CASE WHEN fixed THEN 1.0 WHEN cached THEN 0.97 ELSE confidence END AS confidence, CASE WHEN status = 'FROM_TEXT' AND NOT cached THEN NULL ELSE fixed OR cached END AS settled
  FROM (SELECT *, raw IN (SELECT raw FROM k8) AS fixed, raw IN (SELECT raw FROM kc) AND tier <> 'identifier' AS cached FROM o) x""",
    "cache_upsert": f"""WITH r AS (SELECT n, variant, truth FROM ({fx.REFS}) r0), old AS (SELECT DISTINCT truth FROM r WHERE variant < 3), new AS (SELECT truth, max(n) AS n FROM r WHERE variant = 2 GROUP BY truth)
  SELECT tier, 'ACCEPTED' AS status, count(*) AS n_keys, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT 'fingerprint' AS tier, length(CAST(n AS VARCHAR)) AS chars FROM new UNION ALL SELECT 'old', 1 FROM old WHERE truth NOT IN (SELECT truth FROM new)) x GROUP BY tier""",
    "correction_upsert": f"""WITH r AS (SELECT n, variant, concat('k', truth) AS ref_key FROM ({fx.REFS}) r0), new AS (SELECT ref_key, max(n) AS n FROM r WHERE variant IN (2, 3) GROUP BY ref_key)
  SELECT ref_key, CAST(n AS VARCHAR) AS candidate, CAST(n AS BIGINT) AS decided_at FROM new UNION ALL SELECT DISTINCT ref_key, 'old', CAST(0 AS BIGINT) FROM r WHERE variant < 3 AND ref_key NOT IN (SELECT ref_key FROM new)""",
    "library_reuse": _REUSE,
    "create_batches": f"""SELECT paper_id, manuscript, CAST((rn - 1) // 50 AS INT) AS batch, printf('DRYRUN%03d', rn - 1) AS dry_key FROM (SELECT paper_id, CAST(paper_id // 100 AS BIGINT) AS manuscript, row_number() OVER (PARTITION BY paper_id // 100 ORDER BY paper_id) AS rn FROM ({_REUSE}) x WHERE key IS NULL) y""",
    "creators": f"SELECT paper_id, concat_ws('|', CASE WHEN paper_id % 3 = 0 THEN jfull END, lower(surname), 'roe') AS names FROM ({fx.PAPERS}) p",
    "item_fields": f"SELECT n, 'journalArticle' AS itemType, title, CAST(year AS VARCHAR) AS date, doi AS DOI, jfull AS publicationTitle, jabbr AS journalAbbreviation, vol AS volume, issue, concat(fp, '-', lp) AS pages FROM {FACTS} WHERE variant = 6",
    "csl_item_json": f"""SELECT n, concat('{{"id":"K', n, '","type":"article-journal","title":"', title, '","container-title":"', jfull, '","journalAbbreviation":"', jabbr, '","volume":"', vol, '","issue":"', issue, '","page":"', fp, '-', lp, '","DOI":"', doi, '","author":[{{"family":"', lower(surname), '"}}],"issued":{{"date-parts":[["', year, '"]]}}}}') AS csl FROM {FACTS} WHERE variant = 6""",
    "complete_enough": f"SELECT n, variant <> 5 AS complete FROM ({fx.REFS}) r",
    "review_apply": f"""SELECT n, CASE k WHEN 1 THEN 'DROPPED' WHEN 2 THEN 'FROM_TEXT' WHEN 3 THEN 'ACCEPTED' WHEN 4 THEN CASE WHEN n % 3 < 2 THEN 'ACCEPTED' ELSE 'REVIEW' END ELSE 'REVIEW' END AS status, CASE WHEN k = 2 THEN 'book-from-text' WHEN k = 3 OR (k = 4 AND n % 3 < 2) THEN 'manual' ELSE 'none' END AS tier,
   CAST(CASE WHEN k = 2 THEN 0.8 WHEN k = 3 OR (k = 4 AND n % 3 < 2) THEN 1.0 ELSE 0.4 END AS DOUBLE) AS confidence, CASE WHEN k = 3 THEN '10.1/x' WHEN k = 4 AND n % 3 = 0 THEN 'a' WHEN k = 4 AND n % 3 = 1 THEN 'b' END AS candidate FROM (SELECT n, CASE WHEN n % 7 = 0 THEN -1 ELSE n % 5 END AS k FROM ({fx.REFS}) r) x""",
    "report_rows": f"""SELECT n, CASE n % 3 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'FROM_TEXT' ELSE 'REVIEW' END AS status, 'none' AS tier, CAST(0.125 AS DOUBLE) AS confidence, CASE WHEN n % 3 = 0 OR n % 3 = 1 AND variant = 6 THEN doi ELSE '' END AS doi,
   CASE WHEN n % 3 = 1 AND variant = 7 THEN pmid ELSE '' END AS pmid, CASE WHEN n % 3 < 2 THEN concat('K', n) ELSE '' END AS zotero_key, CASE n % 3 WHEN 0 THEN title WHEN 1 THEN r_title ELSE '' END AS resolved_title, 'r' AS reason, 'x | y' AS advisory, raw AS raw_reference
   FROM (SELECT f.*, r.raw FROM ({fx.REFS}) r JOIN {FACTS.replace(') facts', ') f')} ON f.n = r.n) x""",
    "bracket_citations": f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{_GROUP}', 1), '|') AS specs FROM {_SENT}",
    "bracket_citations_documents": f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{_GROUP}', 1), '|') AS specs FROM documents",
    "attached_citations": f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z][.;,!?]{_NUMBERS}'), lambda m: substring(m, 3)), '|') AS specs FROM {_SENT}",
    "expand_spec": f"""SELECT n, CASE n % 8 WHEN 0 THEN '1' WHEN 1 THEN '2,3' WHEN 2 THEN '4,5,6' WHEN 3 THEN '' WHEN 6 THEN array_to_string({_RANGE.format(3, 32)}, ',') WHEN 7 THEN concat(CASE WHEN n % 50 BETWEEN 1 AND {KNOWN} THEN concat(n % 50, ',') ELSE '' END, '7') ELSE '' END AS numbers FROM (SELECT o_orderkey AS n FROM orders) o""",
    "deletion_span": f"""SELECT doc_id, CAST(CASE WHEN i > 0 AND substring(text, i, 1) = ' ' AND (length(text) <= i + 3 OR contains(' .,;:!?)]', substring(text, i + 4, 1))) THEN i - 1 ELSE i END AS INT) AS start, CAST(i + 3 AS INT) AS "end"
   FROM (SELECT doc_id, text, CASE WHEN strpos(substring(text, 8), ' ') > 0 THEN strpos(substring(text, 8), ' ') + 7 ELSE 0 END AS i FROM {_SENT}) x""",
}

SQL |= citation_oracles.SQL
