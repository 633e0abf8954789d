"""SQL of the further queries."""

from __future__ import annotations

from . import fixtures as fx
from .more_queries import OLD_TEXTS, RECORDS, SPECS
from .oracles import FACTS

_PROVIDERS = list(RECORDS)
_P = f"({fx.PAPERS}) p"
_WIDE = "concat('range ''', {0}, '-', {1}, ''' {2} ', {1} - {0} + 1, ' references — {3}')"
_TAKEN = lambda a, b: _WIDE.format(a, b, "expands to", "bracketed, so taken as written; check it is not a typo")
_LEFT = _WIDE.format(3, 32, "spans", "likely a dropped digit in the manuscript; left unchanged")
_WARNED = f"CASE n % 8 WHEN 3 THEN [{_LEFT}] WHEN 6 THEN [{_TAKEN(3, 32)}, {_TAKEN(2, 20)}] ELSE [] END"
_OLD = "CASE WHEN {0} % 3 = 0 THEN concat('NEEDS REVIEW: ref ', {0}) WHEN {0} % 2 = 0 THEN concat('W', {0}, ', \"T\", 2000') ELSE concat('W', {0}, ', 2000') END"
_A = "(1 + n % 9)"
_OLD_TEXT = f"""CASE n % 4 WHEN 0 THEN concat('Seen {{', {_OLD.format(_A)}, '}} here.') WHEN 1 THEN concat('Seen {{', {_OLD.format(_A)}, '; ', {_OLD.format(3)}, '; ', {_OLD.format(4)}, '; ', {_OLD.format(5)}, '}} {{here}}.')
  WHEN 2 THEN concat('Seen word{{', {_OLD.format(23)}, '}} here.') ELSE text END"""
_STATUS = "CASE n % 4 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'FROM_TEXT' WHEN 2 THEN 'REVIEW' ELSE 'DROPPED' END"
_R = f"({fx.REFS}) r"
_CANDS = f"(SELECT *, paper_id * 10 + arrival AS cid FROM ({fx.CANDIDATES}) c0) c"
_TITLE_CASE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')"

SQL = {
    "provider_adapters": " UNION ALL ".join(
        f"SELECT paper_id, '{name}' AS provider, {i} AS arrival, title, doi, {'NULL' if name == 'crossref' else 'pmid'} AS pmid, lower(surname) AS authors, year, jfull AS journal, vol AS volume, fp AS first_page, lp AS last_page, 'journalArticle' AS item_type FROM {_P}"
        for i, name in enumerate(_PROVIDERS, 1)
    ),
    "candidate_codec": f"SELECT cid, TRUE AS keeps_nulls, provider, title, doi, pmid, author AS authors, year, volume, provider AS providers FROM {_CANDS}",
    "light_candidates": f"SELECT paper_id, 'crossref' AS provider, surname AS author, year, title, doi FROM {_P} UNION ALL SELECT paper_id, 'pubmed', surname, year, concat(title, '.'), doi FROM {_P}",
    "query_terms": f"SELECT n, r_title AS title, surname AS author FROM {FACTS}",
    "item_from_text": f"SELECT n, r_title AS title, CASE WHEN variant = 6 THEN doi END AS doi, CASE WHEN variant = 7 THEN pmid END AS pmid, r_journal AS journal, r_journal AS journal_abbrev, CAST(r_year AS INT) AS year, r_vol AS volume, 'journalArticle' AS item_type, 'reference-text' AS provider FROM {FACTS}",
    "merged_ids": "SELECT p_partkey AS n, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 0 THEN '5' WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN '5,1,2,3,4,6,7,8,9,10' ELSE '1,2,3,4,5,6,7,8,9,10' END AS ids FROM part",
    "first_passes": """SELECT n, work, pass, place FROM (SELECT *, row_number() OVER (PARTITION BY n, work ORDER BY pass, place) AS rn FROM (SELECT l_orderkey AS n, l_partkey % 3 AS work, l_suppkey % 2 AS pass, l_linenumber AS place FROM lineitem) x) y WHERE rn = 1""",
    "authors_related": f"SELECT paper_id, paper_id % 3 = 0 AS related FROM {_P}",
    "enrich_by_doi": f"""SELECT cid, title, CASE WHEN better THEN NULL ELSE pmid END AS pmid, CASE WHEN paper_id % 4 = 0 THEN 'book' ELSE 'journalArticle' END AS item_type, CASE WHEN better THEN concat('crossref:canonical|', provider) ELSE provider END AS providers
   FROM (SELECT *, arrival > 1 AND doi IS NOT NULL AND paper_id % 9 > 0 AS better FROM {_CANDS}) x""",
    "creators_from_raw": f"""SELECT paper_id, CASE paper_id % 4 WHEN 0 THEN 'Roe,Ann|Ring Group' WHEN 1 THEN 'Öz,K|Team' WHEN 2 THEN 'Murray,CJL|van Dam jan|A B' ELSE concat(CASE WHEN paper_id % 8 = 3 THEN concat(jfull, '|') ELSE '' END, lower(surname), ',') END AS names FROM {_P}""",
    "pending_review": f"""WITH s AS (SELECT {_STATUS} AS status FROM {_R}) SELECT status, count(*) AS n_refs, FALSE AS only_review FROM s WHERE status <> 'ACCEPTED' GROUP BY status UNION ALL SELECT status, count(*), TRUE FROM s WHERE status = 'REVIEW' GROUP BY status""",
    "review_skip_resets": f"SELECT n, CASE n % 3 WHEN 0 THEN 'REVIEW' WHEN 1 THEN 'DROPPED' ELSE 'ACCEPTED' END AS status, CASE n % 3 WHEN 2 THEN 'fingerprint' ELSE 'none' END AS tier, CAST(0.97 AS DOUBLE) AS confidence, CASE n % 3 WHEN 2 THEN 'a' END AS candidate FROM {_R}",
    "run_summary": f"""SELECT CAST(n // 20 AS BIGINT) AS doc_id, sum(CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS accepted, sum(CASE WHEN n % 4 = 1 THEN 1 ELSE 0 END)::BIGINT AS from_text, coalesce(string_agg(CASE WHEN n % 4 = 3 THEN CAST(n AS VARCHAR) END, ',' ORDER BY n), '') AS dropped,
   coalesce(string_agg(CASE WHEN n % 4 = 2 THEN CAST(n AS VARCHAR) END, ',' ORDER BY n), '') AS unresolved, max(CASE WHEN n % 4 = 2 THEN 1 ELSE 0 END) AS exit_code FROM {_R} GROUP BY n // 20""",
    "describe_candidates": f"""SELECT cid, title, concat(upper(author[1]), author[2:]) AS who, journal AS "where", CAST(year AS VARCHAR) AS year, concat('v', coalesce(volume, '?'), '(', coalesce(issue, '?'), '):', coalesce(first_page, '?')) AS locator, CASE WHEN doi IS NOT NULL THEN doi WHEN pmid IS NOT NULL THEN concat('PMID:', pmid) ELSE 'no identifier' END AS ident FROM {_CANDS}""",
    "first_of_each": f"""SELECT n, min(n) OVER (PARTITION BY doc_id, same) AS first_n FROM (SELECT r.n, r.n // 20 AS doc_id, CASE WHEN p.paper_id % 2 = 0 THEN p.doi WHEN p.paper_id % 3 > 0 THEN concat(p.title, p.year) ELSE concat('#', r.n) END AS same FROM {_R} JOIN ({fx.PAPERS}) p ON p.paper_id = r.truth % 7) x""",
    "create_batches_all": "SELECT paper_id, CAST((rn - 1) // 50 AS INT) AS batch, printf('DRYRUN%03d', rn - 1) AS dry_key FROM (SELECT p_partkey AS paper_id, row_number() OVER (ORDER BY p_partkey) AS rn FROM part) x",
    "range_warnings": f"SELECT n, array_to_string({_WARNED}, '|') AS warnings FROM ({SPECS}) s",
    "distinct_warnings": f"""SELECT doc_id, string_agg(w, '|' ORDER BY first_n, i) AS warnings FROM (SELECT doc_id, w, min(n) AS first_n, min(i) AS i FROM (SELECT n, CAST(n // 20 AS BIGINT) AS doc_id, unnest({_WARNED}) AS w, unnest(range(len({_WARNED}))) AS i FROM ({SPECS}) s) x GROUP BY doc_id, w) y GROUP BY doc_id""",
    "legacy_markers": f"""SELECT n, concat('{{\\rtf1\\ansi\\deff0', chr(10), replace(replace({_OLD_TEXT}, '{{', '\\{{'), '}}', '\\}}'), chr(10), '}}', chr(10)) AS rtf FROM ({OLD_TEXTS}) t""",
    "legacy_split": f"""SELECT doc_id, sum(CASE WHEN line_no > 2 THEN 1 ELSE 0 END)::BIGINT AS n_listed, sum(CASE WHEN line_no < 2 THEN 1 ELSE 0 END)::BIGINT AS n_body FROM ({fx.LINES}) l GROUP BY doc_id""",
    "legacy_segment": f"""WITH used AS (SELECT doc_id, line_no, text AS t, line_no % 2 = 0 AND (line_no - 100) // 2 % 20 >= 0 AND regexp_matches(text, '^\\s*[\\[(]?(\\d{{1,3}})[\\]).]\\s+(.*)$') AS lead FROM ({fx.LINES}) l0 WHERE line_no BETWEEN 3 AND 899 AND trim(text) <> ''),
  marked AS (SELECT *, sum(CASE WHEN lead THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS entry FROM used),
  entries AS (SELECT doc_id, entry, max(CASE WHEN lead THEN CAST(regexp_extract(t, '^\\s*[\\[(]?(\\d{{1,3}})[\\]).]\\s+(.*)$', 1) AS INT) END) AS n, trim(string_agg(CASE WHEN lead THEN regexp_extract(t, '^\\s*[\\[(]?(\\d{{1,3}})[\\]).]\\s+(.*)$', 2) ELSE trim(t) END, ' ' ORDER BY line_no)) AS raw FROM marked WHERE entry > 0 GROUP BY doc_id, entry)
  SELECT doc_id, n, arg_max(raw, entry) AS raw FROM entries GROUP BY doc_id, n""",
    "legacy_doi_list": f"""SELECT r.n // 20 AS doc_id, coalesce(string_agg(CASE WHEN r.n % 3 > 0 AND r.n % 4 > 0 THEN concat(p.doi, chr(10)) END, '' ORDER BY r.n), '') AS dois FROM {_R} JOIN ({fx.PAPERS}) p ON p.paper_id = r.truth GROUP BY r.n // 20""",
    "title_case": f"SELECT paper_id, concat('O''Neil-', {_TITLE_CASE.format('title')}, ' X2Y') AS shown FROM {_P}",
    "reference_array": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INT) AS n, sha1(raw) AS raw_sha1 FROM (SELECT n, CAST(n // 20 AS BIGINT) AS doc_id, raw FROM {_R}) x",
}
