"""SQL of the citation queries, told from how the fixture's sentences are made."""

from __future__ import annotations

from . import fixtures as fx

_KNOWN = 40
_FORM = "doc_id % 14"


def marker(i: str) -> str:
    """Each fifth reference was dropped, each third waits for review."""
    return f"CASE WHEN {i} % 5 = 0 THEN '' WHEN {i} % 3 = 0 THEN concat('{{NEEDS REVIEW: ref ', {i}, '}}') ELSE concat('{{ | W', {i}, ', (2000) | | |zu:0:K', {i}, '}}') END"


def _text(x: str) -> str:
    return "'" + x + "'"


_A0, _B0, _A1, _B1 = "(1 + doc_id % 9)", "(2 + doc_id % 5)", "(1 + doc_id % 12)", "(14 + doc_id % 5)"
#: By form of sentence: kind (bracket, superscript, attached, detached), what stands before the
#: marker, the marker, its specification and the numbers that it is expanded to.
FOUND = {
    0: [("b", "'before '", f"concat('[', {_A0}, ']')", f"concat({_A0})", f"[{_A0}]"), ("b", "'and '", f"concat('(', {_B0}, ', 9)')", f"concat({_B0}, ', 9')", f"[{_B0}, 9]")],
    1: [("a", "'systems.'", f"concat({_A1}, '-', {_B1})", f"concat({_A1}, '-', {_B1})", f"CASE WHEN {_B1} - {_A1} <= 8 THEN range({_A1}, {_B1} + 1) END")],
    2: [("d", "'OA '", f"concat({_A1})", f"concat({_A1})", f"[{_A1}]")],
    4: [("d", "'lived '", "'6,7'", "'6,7'", "[6, 7]"), ("d", "'months '", "'6,8'", "'6,8'", "[6, 8]")],
    5: [("s", "'steady'", "'²⁻⁴'", "'2-4'", "[2, 3, 4]"), ("s", "'remain;'", "'¹·³'", "'1,3'", "[1, 3]")],
    6: [("b", "'Scores '", "'(0-10)'", "'0-10'", "NULL"), ("b", "'rose '", "'(1990-2023)'", "'1990-2023'", "NULL"), ("b", "'both '", "'[14-49]'", "'14-49'", f"range(14, {_KNOWN + 1})")],
    7: [("d", "'years. '", "'1'", "'1'", "[1]")],
    8: [("d", "'cases '", "'3,4'", "'3,4'", "[3, 4]"), ("b", "'overall '", "'[5, 6]'", "'5, 6'", "[5, 6]")],
    10: [("d", "'clause '", "'12'", "'12'", "[12]"), ("b", "'next '", "'(3, 2-5)'", "'3, 2-5'", "[3, 2, 3, 4, 5]")],
    11: [("a", "'word,'", "'7,9'", "'7,9'", "[7, 9]"), ("b", "'more '", "'[ 3 – 5 ]'", "'3 – 5'", "[3, 4, 5]")],
    12: [("d", "'eps '", "'11'", "'11'", "[11]")],
    13: [("b", "'See '", "'[1]'", "'1'", "[1]"), ("b", "', '", "'[30]'", "'30'", "[30]"), ("b", "'and '", "'[2-3]'", "'2-3'", "[2, 3]")],
}


def _spans(kinds: str) -> str:
    """The sentence's spans of some kinds, listed."""
    cases = []
    for form, spans in FOUND.items():
        shown = [f"concat(strpos(text, concat({before}, {mark})) - 1 + length({before}), ':', strpos(text, concat({before}, {mark})) - 1 + length({before}) + length({mark}), ':', {spec})" for kind, before, mark, spec, _ in spans if kind in kinds]
        if shown:
            cases.append(f"WHEN {form} THEN concat_ws('|', {', '.join(shown)})")
    return f"CASE {_FORM} {' '.join(cases)} ELSE '' END"


def _written(numbers: str) -> str:
    return f"array_to_string(list_transform({numbers}, lambda i: {marker('i')}), '')"


def _rendered() -> str:
    """The sentence with its markers replaced; a deleted one takes the space before it along."""
    cases = []
    for form, spans in FOUND.items():
        out = "text"
        for _, before, mark, _, numbers in spans:
            if numbers != "NULL":
                new = _written(numbers)
                out = f"replace({out}, concat({before}, {mark}), CASE WHEN {new} IS NULL THEN concat({before}, {mark}) WHEN {new} = '' THEN rtrim({before}) ELSE concat({before}, {new}) END)"
        cases.append(f"WHEN {form} THEN {out}")
    return f"CASE {_FORM} {' '.join(cases)} ELSE text END"


_SENT = f"({fx.SENTENCES}) s"
_N_SPANS = f"CASE {_FORM} {' '.join(f'WHEN {form} THEN {len(spans)}' for form, spans in FOUND.items())} ELSE 0 END"
_SCHEMA = "https://github.com/citation-style-language/schema/raw/master/csl-citation.json"
#: Four numbers in a row from ``k``; neighbours that are ready share a group.
_NUMBERS = "SELECT o_orderkey AS doc_id, unnest(range(0, 4)) AS i, 1 + o_orderkey % 30 + unnest(range(0, 4)) AS n FROM orders"
_GROUPS = f"""SELECT doc_id, n, i, n % 3 > 0 AS ready, sum(CASE WHEN n % 3 > 0 AND p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT *, coalesce(lag(n % 3 > 0) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS p FROM ({_NUMBERS}) x WHERE n % 5 > 0) y"""

SQL = {
    "superscript_citations": f"SELECT doc_id, {_spans('s')} AS spans FROM {_SENT}",
    "detached_guards": f"SELECT doc_id, {_spans('d')} AS spans FROM {_SENT}",
    "overlap_resolution": f"SELECT doc_id, {_spans('basd')} AS spans FROM {_SENT}",
    "render_scannable": f"SELECT doc_id, {_rendered()} AS text FROM {_SENT}",
    "count_citations": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST({_N_SPANS} AS BIGINT) AS n_citations FROM {_SENT}",
    "safety_stops": f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST({_N_SPANS} AS BIGINT) AS n_citations, doc_id % 4 > 0 AS has_list, FALSE AS has_images, {_N_SPANS} > 0 AND doc_id % 4 > 0 AS goes_on FROM {_SENT}""",
    "docx_scan": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INT) AS para_idx, text FROM ({fx.LINES}) l",
    "docx_rewrite": f"""SELECT doc_id, text, CASE WHEN text = old THEN 4 ELSE 1 END AS n_paragraphs FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS old, {_rendered()} AS text FROM {_SENT}) r""",
    "field_pieces": f"""SELECT doc_id, string_agg(CASE WHEN ready THEN shown ELSE concat('{{NEEDS REVIEW: ref ', n, '}}') END, '|' ORDER BY g) AS pieces FROM (SELECT doc_id, g, bool_or(ready) AS ready, min(n) AS n, string_agg(concat('W', n), '; ' ORDER BY i) AS shown FROM ({_GROUPS}) a GROUP BY doc_id, g) b GROUP BY doc_id""",
    "citation_json": f"""SELECT o_orderkey AS doc_id, concat('{{"citationID":"', o_orderkey % 1000, '","properties":{{"formattedCitation":"R\\"', o_orderkey % 7, '; é","plainCitation":"R\\"', o_orderkey % 7, '; é","noteIndex":0}},"citationItems":[{{"id":"K', o_orderkey % 7, '","uris":["http://zotero.org/users/9/items/K', o_orderkey % 7,
   '"],"itemData":{{"id":1}}}},{{"id":"L","uris":["http://zotero.org/users/9/items/L"]}}],"schema":"{_SCHEMA}"}}') AS json FROM orders""",
}
