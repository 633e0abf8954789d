"""Queries over the fixtures and the driver's tables, one for each operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cuts import materialize
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import citations as cite
from ..operators import library as lib
from ..operators import manuscript, match, parse, resolve
from ..sources import bibliography as bib
from ..sources import docx, docx_write
from . import fixtures as fx

KNOWN = 40


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _parsed(spark, sf_dir):
    # few bytes, but much to do for each row
    return parse.parse_references(fx.refs(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism))


def _stored(spark, sf_dir):
    """Parsed references, written once: joins and filters don't reach into the parser."""
    return materialize(_parsed(spark, sf_dir), "parsed")


def _cands(spark, sf_dir, sql=fx.CANDIDATES):
    return fx.candidates(spark, sf_dir, sql).withColumn("cid", F.col("paper_id") * 10 + F.col("arrival"))


def _names(spark, sf_dir):
    """Displayed author names of several forms."""
    sql = """SELECT paper_id, CASE paper_id % 5 WHEN 0 THEN concat(surname, ', Ann B') WHEN 1 THEN concat('Ann B ', surname) WHEN 2 THEN concat('Ludwig van der ', surname)
     WHEN 3 THEN concat('Müller-', surname) ELSE concat('  ', surname, ' É.B.  ') END AS name FROM (""" + fx.PAPERS + ") p"
    return fx.fixture(spark, sf_dir, sql)


def norm_text_documents(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", tx.norm_text(F.col("text")).alias("x"))
    return d.select("doc_id", F.length("x").cast("long").alias("norm_chars"), F.sha1(F.col("x").cast("binary")).alias("norm_sha1"))


def strip_accents_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha1(tx.strip_accents(F.col("text")).cast("binary")).alias("plain_sha1"))


def equal_after_norm(spark, sf_dir):
    keyed = _docs(spark, sf_dir).select("doc_id", tx.ref_key(F.col("text")).alias("ref_key"))
    return keyed.groupBy("ref_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def ref_key_sha1(spark, sf_dir):
    return fx.refs(spark, sf_dir).select("n", tx.ref_key(F.col("raw")).alias("ref_key"))


def norm_doi(spark, sf_dir):
    shown = F.when(F.col("paper_id") % 3 == 0, F.concat(F.lit(" HTTPS://doi.org/"), "doi", F.lit(". "))).when(F.col("paper_id") % 3 == 1, F.concat(F.lit("doi: "), "doi")).otherwise(F.col("doi"))
    return _cands(spark, sf_dir).select("cid", tx.norm_doi(shown).alias("doi"), tx.clean_doi(F.concat(shown, F.lit(".;"))).alias("typed_doi"))


def norm_surname(spark, sf_dir):
    return _names(spark, sf_dir).select("paper_id", tx.norm_surname(F.col("name")).alias("surname"))


def surname_of(spark, sf_dir):
    return _names(spark, sf_dir).select("paper_id", tx.surname_of(F.col("name")).alias("surname"))


def journal_tokens(spark, sf_dir):
    return fx.papers(spark, sf_dir).select("paper_id", F.array_join(tx.journal_tokens(F.col("jfull")), "|").alias("tokens"))


def consortium_key(spark, sf_dir):
    return fx.papers(spark, sf_dir).select("paper_id", tx.consortium_key(F.concat(F.lit("The "), "title", F.lit(" Study Group Collaborators"))).alias("key"))


def fold_superscripts(spark, sf_dir):
    return fx.fixture(spark, sf_dir, fx.SENTENCES).select("doc_id", tx.fold_superscripts(F.col("text")).alias("folded"))


def fmt2_half_even(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.fixed2(F.col("p_retailprice") / 8.0).alias("shown"))


def search_values(spark, sf_dir):
    title = F.concat("title", F.lit(": a (new) AND old, [trial] OR {none}|x+y"))
    return fx.papers(spark, sf_dir).select("paper_id", tx.search_phrase(title).alias("phrase"), tx.filter_value(title).alias("filter"))


def biblio_bounds(spark, sf_dir):
    return bib.bounds(fx.lines(spark, sf_dir))


def biblio_segment(spark, sf_dir):
    return bib.segment(fx.lines(spark, sf_dir).where("line_no > 2"))


def parse_identifiers(spark, sf_dir):
    return _parsed(spark, sf_dir).select("n", "doi", "pmid", "pmcid")


def parse_locator(spark, sf_dir):
    return _parsed(spark, sf_dir).select("n", "year", "volume", "issue", "first_page", "last_page")


def parse_title_journal(spark, sf_dir):
    return _parsed(spark, sf_dir).select("n", F.array_join("authors", "|").alias("authors"), "corporate", "title", "journal", "is_book")


def parse_books(spark, sf_dir):
    """Books and chapters made of the papers' fields."""
    c = F.col
    chapter = F.concat("surname", F.lit(" AB, Roe CD. "), "title", F.lit(". In: Poe E, Doe F, eds. Book of "), "jfull", F.lit(", 4th edn. Berlin: Springer, "), c("year").cast("string"), F.lit(": 1113-36."))
    book = F.concat("surname", F.lit(" AB. "), "title", F.lit(". 2nd edn. New York, NY: Wiley; "), c("year").cast("string"), F.lit("."))
    raw = fx.papers(spark, sf_dir).select("paper_id", F.when(c("paper_id") % 2 == 0, chapter).otherwise(book).alias("raw"))
    out = parse.parse_references(raw)
    return out.select("paper_id", F.array_join("authors", "|").alias("authors"), "title", "book_title", "edition", "place", "publisher", "year", "first_page", "last_page", "is_book", "is_chapter")


def parse_year_fallback(spark, sf_dir):
    raw = F.concat(F.lit("World Health Group. "), "title", F.lit(" seen in 1971. Report "), F.col("year").cast("string"))
    return parse.parse_references(fx.papers(spark, sf_dir).select("paper_id", raw.alias("raw"))).select("paper_id", "year", "corporate", "journal")


def expand_page(spark, sf_dir):
    p = fx.papers(spark, sf_dir).select("paper_id", F.concat(F.lit("e"), (F.col("paper_id") + 1000).cast("string")).alias("fp"), (F.col("paper_id") % 90 + 10).cast("string").alias("lp"))
    return p.select("paper_id", parse.expand_page(F.col("fp"), F.col("lp")).alias("last_page"))


def split_segments(spark, sf_dir):
    s = parse.segments(F.col("raw"))
    return fx.refs(spark, sf_dir).select("n", F.size(s).cast("long").alias("n_segments"), F.array_join(s, "|").alias("segments"))


def _pairs(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    a = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    return a.join(part.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("b")), "id")


def lcs_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", sim.lcs_length(F.col("a"), F.col("b")).alias("lcs"))


def ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(sim.ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


def token_sort_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(sim.token_sort_ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


def token_set_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(sim.token_set_ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


def title_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("id", F.round(sim.title_similarity(F.col("a"), F.col("b")), 9).alias("similarity"), F.round(sim.length_ratio(F.col("a"), F.concat("b", F.lit(" x"))), 9).alias("length_ratio"))


def journal_match(spark, sf_dir):
    p = fx.papers(spark, sf_dir)
    other = p.select((F.col("paper_id") - F.col("paper_id") % 2).alias("paper_id"), F.col("paper_id").alias("other_id"), "jfull")
    return p.select("paper_id", "jabbr").join(other, "paper_id").select("paper_id", "other_id", match.journal_match(F.col("jabbr"), F.col("jfull")).alias("ok"))


def page_volume_equal(spark, sf_dir):
    p = fx.papers(spark, sf_dir)
    return p.select("paper_id", match.locator_equal(F.concat(F.lit("E-"), "fp"), F.concat(F.lit("e"), "fp")).alias("same"), match.locator_equal(F.col("vol"), F.col("issue")).alias("other"), match.locator_equal(F.col("vol"), F.lit("")).alias("blank"))


def dedupe_candidates(spark, sf_dir):
    out = match.dedupe_candidates(_cands(spark, sf_dir), ["paper_id"])
    return out.select("paper_id", "doi", "provider", "pmid", F.array_join("providers", ",").alias("providers"), match.provider_votes(F.col("providers")).alias("votes"), "arrival")


def identifier_join(spark, sf_dir):
    return resolve.identifier_hits(_stored(spark, sf_dir), _cands(spark, sf_dir), ["n"], "cid")


def locator_match(spark, sf_dir):
    return resolve.locator_blocks(_stored(spark, sf_dir), _cands(spark, sf_dir), ["n"], "cid")


def title_match(spark, sf_dir):
    return resolve.title_blocks(_stored(spark, sf_dir), _cands(spark, sf_dir), ["n"], "cid")


def token_block_topk(spark, sf_dir):
    """Its SQL leaves tokens of over 2% of the papers out; the cascade counts all."""
    p = fx.papers(spark, sf_dir)
    asked = p.select("paper_id", "title").withColumnRenamed("paper_id", "n")
    return resolve.token_blocks(asked, p, ["n"], "paper_id", k=3, max_share=0.02).select("n", "paper_id", "idf", "place")


def fallback_pass(spark, sf_dir):
    refs, cands = _stored(spark, sf_dir), _cands(spark, sf_dir)
    pairs = resolve.fallback(resolve.locator_blocks(refs, cands, ["n"], "cid"), resolve.title_blocks(refs, cands, ["n"], "cid"), refs, ["n"])
    return pairs.groupBy("n").agg(F.count("*").alias("candidates"), F.min("cid").alias("first_cid"))


def _title_pairs(spark, sf_dir):
    """Each reference with the merged candidates that bear its title."""
    refs, cands = _stored(spark, sf_dir), _cands(spark, sf_dir)
    rows = resolve.title_blocks(refs, cands, ["n"], "cid").join(cands, "cid")
    merged = materialize(match.dedupe_candidates(rows, ["n"]), "merged")
    return materialize(match.score_pairs(resolve.as_pairs(refs, merged, ["n"]), ["n"]), "scored")


def signals(spark, sf_dir):
    return _title_pairs(spark, sf_dir).select("n", "arrival", "title_sim", "year_delta", "author_ok", "author_overlap", "corporate_ok", "journal_ok", "volume_ok", "first_page_ok", "last_page_ok", "type_ok", "n_providers", "ecitmatch")


def confidence(spark, sf_dir):
    return _title_pairs(spark, sf_dir).select("n", "arrival", F.round("confidence", 9).alias("confidence"), "rank")


def accept_gate(spark, sf_dir):
    return _title_pairs(spark, sf_dir).select("n", "arrival", F.col("gate.ok").alias("ok"), F.col("gate.tier").alias("tier"))


def failing_reasons(spark, sf_dir):
    return _title_pairs(spark, sf_dir).select("n", "arrival", match.failing_reasons().alias("reasons"))


def _resolved(spark, sf_dir, **layers):
    return resolve.resolve_texts(fx.refs(spark, sf_dir).select("n", "raw"), _cands(spark, sf_dir), ["n"], "cid", **layers)


def cascade_status(spark, sf_dir):
    """The chosen record is told where a place or an identifier decides."""
    told = F.when(F.col("tier").isin("identifier", "ecitmatch", "fingerprint"), F.col("candidate")).alias("candidate")
    return _resolved(spark, sf_dir).select("n", "status", "tier", "confidence", told, "reason")


def cascade_layers(spark, sf_dir):
    """Books, corporate authors, contradictions, doubtful entries, weaker tiers and review."""
    refs = parse.parse_references(fx.fixture(spark, sf_dir, fx.ODD_REFS))
    out = resolve.resolve(refs, _cands(spark, sf_dir, fx.UNLIKE_CANDIDATES), ["n"], "cid")
    return out.select("n", "status", "tier", F.round("confidence", 9).alias("confidence"), "candidate", "reason", F.array_join("notes", " | ").alias("notes"))


def status_counts(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("status", "tier").agg(F.count("*").alias("n_refs"))


def correction_override(spark, sf_dir):
    """Corrections and a cache in front of the other layers."""
    keyed = fx.refs(spark, sf_dir).select("n", tx.ref_key(F.col("raw")).alias("ref_key"))
    fixes = keyed.where("n % 20 = 8").groupBy("ref_key").agg(F.max(F.concat(F.lit("fix-"), (F.col("n") % 20).cast("string"))).alias("candidate"))
    cache = keyed.where("n % 20 in (3, 6)").groupBy("ref_key").agg(F.lit("ACCEPTED").alias("status"), F.lit("fingerprint").alias("tier"), F.lit(0.97).alias("confidence"), F.lit("cached").alias("candidate"))
    return _resolved(spark, sf_dir, corrections=fixes, cache=cache).select("n", "status", "tier", "confidence", F.col("candidate").isin("fix-8", "cached").alias("settled"))


def cache_upsert(spark, sf_dir):
    rows = fx.refs(spark, sf_dir).select("n", "variant", F.concat(F.lit("k"), F.col("truth").cast("string")).alias("ref_key"))
    old = rows.where("variant < 3").groupBy("ref_key").agg(F.lit("ACCEPTED").alias("status"), F.lit("old").alias("tier"), F.lit(0.5).alias("confidence"), F.lit("c").alias("candidate"))
    status, tier = F.when(F.col("variant") == 4, "REVIEW").when(F.col("variant") == 5, "FROM_TEXT").otherwise("ACCEPTED"), F.when(F.col("variant") == 3, "identifier").otherwise("fingerprint")
    new = rows.where("variant in (2, 3, 4, 5)").select("n", "ref_key", status.alias("status"), tier.alias("tier"), F.lit(0.9).alias("confidence"), F.col("n").cast("string").alias("candidate"))
    return resolve.cache_upsert(old, new).groupBy("tier", "status").agg(F.count("*").alias("n_keys"), F.sum(F.length("candidate")).alias("chars"))


def correction_upsert(spark, sf_dir):
    rows = fx.refs(spark, sf_dir).select("n", "variant", F.concat(F.lit("k"), F.col("truth").cast("string")).alias("ref_key"))
    old = rows.where("variant < 3").groupBy("ref_key").agg(F.lit("old").alias("candidate"), F.lit(0).cast("long").alias("decided_at"))
    new = rows.where("variant in (2, 3)").select("ref_key", F.col("n").cast("string").alias("candidate"), F.col("n").cast("long").alias("decided_at"))
    return resolve.correction_upsert(old, new)


def _items(spark, sf_dir):
    p = fx.papers(spark, sf_dir)
    return p.select("paper_id", F.when(F.col("paper_id") % 2 == 0, F.upper("doi")).alias("DOI"), F.upper("title").alias("title"), F.col("year").cast("string").alias("date"))


def library_reuse(spark, sf_dir):
    return lib.library_matches(_items(spark, sf_dir), fx.fixture(spark, sf_dir, fx.LIBRARY), ["paper_id"])


def create_batches(spark, sf_dir):
    items, shelf = _items(spark, sf_dir), fx.fixture(spark, sf_dir, fx.LIBRARY)
    pending = lib.library_matches(items, shelf, ["paper_id"]).where("key is null").select("paper_id", F.floor(F.col("paper_id") / 100).alias("manuscript"))
    return lib.creation_batches(pending, ["paper_id"], group=["manuscript"])


def creators(spark, sf_dir):
    p = fx.papers(spark, sf_dir)
    made = lib.creators(F.array(F.lower("surname"), F.lit(""), F.lit("roe")), F.when(F.col("paper_id") % 3 == 0, F.col("jfull")))
    return p.select("paper_id", F.array_join(F.transform(made, lambda x: F.coalesce(x["name"], x["lastName"])), "|").alias("names"))


def _items_of_refs(spark, sf_dir):
    refs = _stored(spark, sf_dir)
    left = refs.select("n", *[F.col(f).alias(f"r_{f}") for f in parse.FIELDS])
    cands = _cands(spark, sf_dir).where("arrival = 1").select(F.col("doi").alias("r_doi"), *[F.col(f).alias(f"c_{f}") for f in resolve.CANDIDATE_FIELDS], *[F.lit(None).cast("string").alias(f"c_{f}") for f in ("publisher", "place", "book_title")])
    return left.join(cands, "r_doi").select("n", *[v.alias(k) for k, v in lib.item_columns().items()])


def item_fields(spark, sf_dir):
    return _items_of_refs(spark, sf_dir).select("n", "itemType", "title", "date", "DOI", "publicationTitle", "journalAbbreviation", "volume", "issue", "pages")


def csl_item_json(spark, sf_dir):
    return _items_of_refs(spark, sf_dir).select("n", lib.csl_json(F.concat(F.lit("K"), F.col("n").cast("string"))).alias("csl"))


def complete_enough(spark, sf_dir):
    return _parsed(spark, sf_dir).select("n", parse.complete_for_text_item().alias("complete"))


def review_apply(spark, sf_dir):
    resolved = fx.refs(spark, sf_dir).select("n", F.lit("REVIEW").alias("status"), F.lit("none").alias("tier"), F.lit(0.4).alias("confidence"), F.lit(None).cast("string").alias("candidate"), F.array(F.lit("a"), F.lit("b")).alias("alternatives"))
    kinds = ["skip", "drop", "from-text", "doi", "pick"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("n") % 5 + 1).cast("int"))
    decisions = resolved.where("n % 7 > 0").select("n", kind.alias("kind"), F.when(kind == "doi", "10.1/x").otherwise((F.col("n") % 3 + 1).cast("string")).alias("payload"))
    return lib.apply_decisions(resolved, decisions, ["n"])


def report_rows(spark, sf_dir):
    """A chosen record, an item of the reference's own text, and nothing, by turns."""
    refs, third = _stored(spark, sf_dir), F.col("n") % 3
    status = F.when(third == 0, "ACCEPTED").when(third == 1, "FROM_TEXT").otherwise("REVIEW")
    verdict = refs.select(
        "n", status.alias("status"), F.lit("none").alias("tier"), F.lit(0.125).alias("confidence"), F.when(third == 0, (F.col("truth") * 10 + 1).cast("string")).alias("candidate"),
        F.lit("r").alias("reason"), F.array(F.lit("x"), F.lit("y")).alias("notes"),
    )
    records = _cands(spark, sf_dir).select(F.col("cid").cast("string").alias("candidate"), "doi", "pmid", "title")
    made = refs.where("n % 3 < 2").select("n", F.concat(F.lit("K"), F.col("n").cast("string")).alias("key"))
    return lib.report_rows(verdict, refs, records, ["n"], made)


def _sentences(spark, sf_dir):
    return fx.fixture(spark, sf_dir, fx.SENTENCES)


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"], s["spec"])), "|")


def bracket_citations(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", F.array_join(F.transform(cite.bracket_spans(F.col("text")), lambda s: s["spec"]), "|").alias("specs"))


def bracket_citations_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(cite.bracket_spans(F.col("text")), lambda s: s["spec"]), "|").alias("specs"))


def attached_citations(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", F.array_join(F.transform(cite.attached_spans(F.col("text")), lambda s: s["spec"]), "|").alias("specs"))


def detached_guards(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", _listed(cite.detached_spans(F.col("text"))).alias("spans"))


def superscript_citations(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", _listed(cite.superscript_spans(F.col("text"))).alias("spans"))


def overlap_resolution(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", _listed(cite.citation_spans(F.col("text"))).alias("spans"))


def expand_spec(spark, sf_dir):
    sql = """SELECT o_orderkey AS n, o_orderkey % 2 = 0 AS bracketed, CASE o_orderkey % 8 WHEN 0 THEN '1' WHEN 1 THEN '2, 3' WHEN 2 THEN '4-6' WHEN 3 THEN '3-32' WHEN 4 THEN '0-5' WHEN 5 THEN '1990-2023' WHEN 6 THEN '3-32'
      ELSE concat(CAST(o_orderkey % 50 AS VARCHAR(9)), ',5–3,7') END AS spec FROM orders """
    known = F.sequence(F.lit(1), F.lit(KNOWN))
    d = fx.fixture(spark, sf_dir, sql)
    return d.select("n", F.array_join(F.transform(cite.expand(F.col("spec"), F.col("bracketed"), known), lambda x: x.cast("string")), ",").alias("numbers"))


def _known_numbers():
    return F.sequence(F.lit(1), F.lit(KNOWN))


def _status(n):
    """Each fifth reference was dropped, each third waits for review."""
    return F.when(n % 5 == 0, "DROPPED").when(n % 3 == 0, "REVIEW").otherwise("ACCEPTED")


def _label(n):
    return F.concat(F.lit("W"), n.cast("string"), F.lit(", (2000)"))


def render_scannable(spark, sf_dir):
    """Sentences with their markers replaced."""
    key = lambda n: F.concat(F.lit("K"), n.cast("string"))
    markers = F.map_from_arrays(_known_numbers(), F.transform(_known_numbers(), lambda n: cite.render_one(n, _status(n), key(n), _label(n))))
    d = _sentences(spark, sf_dir).withColumns({"spans": cite.citation_spans(F.col("text")), "markers": markers})
    return d.select("doc_id", cite.rewrite(F.col("text"), F.col("spans"), _known_numbers(), F.col("markers")).alias("text"))


def _documents(paragraphs):
    """``(doc_id, content)`` of ``(doc_id, texts)``: a Word document of each."""
    import pyarrow as pa

    from ..sources.docx_write import plain_document

    def run(batches):
        for batch in batches:
            made = [plain_document(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    return paragraphs.select(F.col("doc_id").cast("string").alias("doc_id"), "texts").mapInArrow(run, "doc_id string, content binary")


def _bounds_of(rows):
    return bib.bounds(rows.select("doc_id", F.col("para_idx").alias("line_no"), "text", "prev_is_table", "has_image"), "prev_is_table", "has_image")


def _papers_with_citations(spark, sf_dir, listed):
    """A document for each sentence; a reference list after it where ``listed``."""
    head, rest = F.array("text"), F.array(*map(F.lit, ("References", "1. Roe A. One.", "2. Doe B. Two.")))
    texts = _sentences(spark, sf_dir).select("doc_id", F.when(listed, F.concat(head, rest)).otherwise(head).alias("texts"))
    # few bytes, but much to do for each row
    return materialize(_documents(texts.repartition(4 * spark.sparkContext.defaultParallelism)), "documents")


def docx_scan(spark, sf_dir):
    lines = fx.lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    rows, _ = docx.scan(_documents(lines.select("doc_id", F.transform("l", lambda x: x["text"]).alias("texts"))))
    return rows.select("doc_id", "para_idx", "text")


def docx_rewrite(spark, sf_dir):
    """Documents read, their markers replaced and lists taken out, and read again."""
    files = _papers_with_citations(spark, sf_dir, F.lit(True))
    rows = materialize(docx.scan(files)[0], "paragraphs")
    bounds = materialize(_bounds_of(rows), "bounds")
    n = F.explode(_known_numbers()).alias("n")
    refs = rows.select("doc_id").distinct().select("doc_id", n).select("doc_id", "n", _status(F.col("n")).alias("status"), F.concat(F.lit("K"), F.col("n").cast("string")).alias("key"), _label(F.col("n")).alias("label"), F.lit(None).cast("string").alias("item"))
    made = materialize(manuscript.edits(manuscript.body(rows, bounds), manuscript.known_references(refs), "scannable"), "edits")
    again, _ = docx.scan(docx_write.rewritten(files, made, manuscript.removals(bounds, made)).select("doc_id", "content"))
    return again.groupBy("doc_id").agg(F.min_by("text", "para_idx").alias("text"), F.count("*").cast("int").alias("n_paragraphs"))


def count_citations(spark, sf_dir):
    rows = materialize(docx.scan(_papers_with_citations(spark, sf_dir, F.lit(True)))[0], "paragraphs")
    return manuscript.count_citations(manuscript.body(rows, _bounds_of(rows)))


def safety_stops(spark, sf_dir):
    rows = materialize(docx.scan(_papers_with_citations(spark, sf_dir, F.col("doc_id") % 4 > 0))[0], "paragraphs")
    return manuscript.stops(rows, _bounds_of(rows))


def field_pieces(spark, sf_dir):
    """Four numbers in a row: neighbours with items share a field, dropped ones leave nothing."""
    n = F.col("n")
    none = F.lit(None).cast("string").alias("item")
    known = spark.range(1, KNOWN + 1).select(F.lit(0).alias("doc_id"), F.col("id").cast("int").alias("n")).select("doc_id", "n", _status(n).alias("status"), F.concat(F.lit("K"), n.cast("string")).alias("key"), F.concat(F.lit("W"), n.cast("string")).alias("label"), none)
    numbers = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 30).cast("int").alias("k")).select("doc_id", F.lit(0).alias("one"), F.sequence(F.col("k") + 1, F.col("k") + 4).alias("numbers"))
    # one row of 40 references
    joined = numbers.join(F.broadcast(manuscript.known_references(known).withColumnRenamed("doc_id", "one")), "one")
    pieces = manuscript.field_pieces(F.col("numbers"), F.col("known"), "0", F.col("doc_id").cast("string"))
    return joined.select("doc_id", F.array_join(F.transform(pieces, lambda p: p["value"]), "|").alias("pieces")).where("pieces <> ''")


def citation_json(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    seventh = (F.col("doc_id") % 7).cast("string")
    item = lambda key, label, data: F.struct(key.alias("key"), label.alias("label"), data.cast("string").alias("item"))
    items = F.array(item(F.concat(F.lit("K"), seventh), F.concat(F.lit('R"'), seventh), F.lit('{"id":1}')), item(F.lit("L"), F.lit("é"), F.lit(None)))
    return o.select("doc_id", manuscript.citation_json(items, "9", (F.col("doc_id") % 1000).cast("string")).alias("json"))


def deletion_span(spark, sf_dir):
    s = _sentences(spark, sf_dir).select("doc_id", "text", (F.locate(" ", F.col("text"), 8)).alias("at"))
    gone = cite.deletion_span(F.col("text"), F.col("at"), F.col("at") + 3)
    return s.select("doc_id", gone["start"].cast("int").alias("start"), gone["end"].cast("int").alias("end"))


QUERIES = {
    f.__name__: f
    for f in (
        norm_text_documents, strip_accents_documents, equal_after_norm, ref_key_sha1, norm_doi, norm_surname, surname_of, journal_tokens, consortium_key,
        fold_superscripts, fmt2_half_even, search_values, biblio_bounds, biblio_segment, parse_identifiers, parse_locator, parse_title_journal, parse_books,
        parse_year_fallback, expand_page, split_segments, lcs_pairs, ratio, token_sort_ratio, token_set_ratio, title_similarity, journal_match,
        page_volume_equal, dedupe_candidates, identifier_join, locator_match, title_match, token_block_topk, fallback_pass, signals, confidence, accept_gate,
        failing_reasons, cascade_status, cascade_layers, status_counts, correction_override, cache_upsert, correction_upsert, library_reuse, create_batches, creators, item_fields, csl_item_json,
        complete_enough, review_apply, report_rows, bracket_citations, bracket_citations_documents, attached_citations, detached_guards, superscript_citations,
        overlap_resolution, expand_spec, render_scannable, deletion_span, docx_scan, docx_rewrite, count_citations, safety_stops, field_pieces, citation_json,
    )
}
