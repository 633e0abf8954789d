"""Signals of a (reference, candidate) pair, confidence, gates, ranking and merging.

Pairs are rows whose reference fields are prefixed ``r_`` and whose candidate
fields are prefixed ``c_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import norm_length_ratio, normalised_similarity
from ..functions.text import consortium_key, empty_to_null, fixed2, journal_tokens, locator_key, norm_doi, norm_text

# Thresholds of the gates and the prefix of records that mirror another publisher's.
SECONDARY_DOI_PREFIX = "10.2307/"
CITATION_MATCH = "pubmed:ecitmatch"
CITATION_MATCH_TITLE = 0.92


def present(c: Column) -> Column:
    return F.coalesce(c.cast("string") != "", F.lit(False))


def journal_forms(*names: Column) -> Column:
    """Token lists of a journal's names: as they are, without brackets, and before their colon."""
    shapes = []
    for name in names:
        shapes += [name, F.regexp_replace(name, r"\([^)]*\)", " "), F.when(F.contains(name, F.lit(":")), F.split_part(name, F.lit(":"), F.lit(1)))]
    return F.filter(F.transform(F.filter(F.array(*shapes), present), journal_tokens), lambda t: F.size(t) > 0)


def journal_alike(ours: Column, forms: Column) -> Column:
    """Each token of one side begins the token in its place of the other, for some form of a name."""

    def alike(theirs):
        pairs = F.zip_with(ours, theirs, lambda a, b: F.startswith(a, b) | F.startswith(b, a))
        return (F.size(ours) == F.size(theirs)) & F.forall(pairs, lambda x: x)

    return F.coalesce((F.size(ours) > 0) & F.exists(forms, alike), F.lit(False))


def journal_match(reference: Column, *names: Column) -> Column:
    # a list of one, so that the reference's tokens are made once
    return F.coalesce(F.exists(F.array(journal_tokens(reference)), lambda ours: journal_alike(ours, journal_forms(*names))), F.lit(False))


def locator_equal(a: Column, b: Column) -> Column:
    """Both given, and equal in their letters and digits."""
    return present(a) & present(b) & F.coalesce(locator_key(a) == locator_key(b), F.lit(False))


def provider_votes(providers: Column) -> Column:
    """Distinct providers; what follows a colon only tells how one found the record."""
    return F.size(F.array_distinct(F.transform(providers, lambda p: F.split_part(p, F.lit(":"), F.lit(1)))))


def richness(c: str = "") -> Column:
    given = [F.when(present(F.col(c + f)), 1).otherwise(0) for f in ("doi", "pmid", "volume", "first_page", "journal", "year")]
    return sum(given, F.when(F.size(c + "authors") > 0, 1).otherwise(0))


def paper_key(norm: Column) -> Column:
    """What records of one paper have in common: the DOI, or else the normalised title and the year."""
    return F.coalesce(norm_doi(F.col("doi")), F.concat(norm, F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit("None"))))


def united(providers: str = "providers") -> Column:
    """All providers of a group's rows, each once."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(providers))))


def dedupe_candidates(cands: DataFrame, ref_keys: list[str]) -> DataFrame:
    """One row for each paper of a reference, by DOI or else by title and year.

    Providers are united; the richest record stays, the earliest of equals; it
    takes the place of the first.  Needs ``arrival``, the order of the fan-out.
    """
    fields = [c for c in cands.columns if c not in ref_keys and c not in ("arrival", "providers")]
    keyed = cands.withColumn("doi", norm_doi(F.col("doi"))).withColumn("_key", paper_key(norm_text(F.col("title"))))
    best = F.max_by(F.struct(*fields), F.struct(richness(), -F.col("arrival")))
    merged = keyed.groupBy(*ref_keys, "_key").agg(best.alias("_best"), united().alias("providers"), F.min("arrival").alias("arrival"))
    return merged.select(*ref_keys, "_best.*", "providers", "arrival")


def reference_norms(c: str = "") -> dict[str, Column]:
    """What pairs read many times, normalised once for each reference."""
    return {"norm": norm_text(F.col(c + "title")), "journal_tokens": journal_tokens(F.col(c + "journal")), "body_norm": norm_text(F.col(c + "corporate")), "body_key": consortium_key(F.col(c + "corporate"))}


def candidate_norms(c: str = "") -> dict[str, Column]:
    """The same of each candidate."""
    pool = norm_text(F.concat_ws(" ", empty_to_null(F.col(c + "corporate")), empty_to_null(F.col(c + "title"))))
    return {"norm": norm_text(F.col(c + "title")), "journal_forms": journal_forms(F.col(c + "journal"), F.col(c + "journal_abbrev")), "body_norm": norm_text(F.col(c + "corporate")), "pool_norm": pool}


def _with_norms(pairs: DataFrame) -> DataFrame:
    """Pairs with their norms, made here where they weren't carried along."""
    ours, theirs = {f"r_{k}": v for k, v in reference_norms("r_").items()}, {f"c_{k}": v for k, v in candidate_norms("c_").items()}
    missing = {k: v for k, v in (ours | theirs).items() if k not in pairs.columns}
    return pairs.withColumns(missing) if missing else pairs


def _similarity(a: Column, b: Column, undecided: Column) -> Column:
    """Only undecided pairs carry texts to the Python function."""
    return normalised_similarity(F.when(undecided, a), F.when(undecided, b))


def with_similarity(pairs: DataFrame) -> DataFrame:
    """Adds the similarity of the normalised titles; equal and empty ones are decided without Python."""
    ready = _with_norms(pairs)
    blank, same = (F.col("r_norm") == "") | (F.col("c_norm") == ""), F.col("r_norm") == F.col("c_norm")
    sim = F.when(blank, 0.0).when(same, 1.0).otherwise(_similarity(F.col("r_norm"), F.col("c_norm"), ~(blank | same)))
    return ready.withColumn("title_sim", sim)


def with_signals(pairs: DataFrame) -> DataFrame:
    """Adds the independent signals of each pair."""
    c = F.col
    ours = F.array_distinct(F.transform("r_authors", F.lower))
    theirs = F.array_distinct(F.transform("c_authors", F.lower))
    lead = F.lower(F.get("r_authors", F.lit(0)))
    shared = F.size(F.array_intersect(ours, theirs))
    named = (c("r_body_norm") != "") & (c("c_body_norm") != "")
    same_body = F.coalesce(named & (_similarity(c("r_body_norm"), c("c_body_norm"), named) >= 0.80), F.lit(False)) | F.contains(c("c_pool_norm"), c("r_body_key"))
    years = (F.coalesce(c("r_year"), F.lit(0)) != 0) & (F.coalesce(c("c_year"), F.lit(0)) != 0)
    return with_similarity(pairs).withColumns(
        {
            "year_delta": F.when(years, F.abs(c("r_year") - c("c_year"))),
            "author_overlap": F.when((F.size(ours) > 0) & (F.size(theirs) > 0), shared / F.size(ours).cast("double")).otherwise(0.0),
            "author_ok": F.coalesce((F.size(theirs) > 0) & (lead != "") & F.array_contains(theirs, lead), F.lit(False)),
            "corporate_ok": present(c("r_corporate")) & F.coalesce(same_body, F.lit(False)),
            "journal_ok": present(c("r_journal")) & journal_alike(c("r_journal_tokens"), c("c_journal_forms")),
            "volume_ok": locator_equal(c("r_volume"), c("c_volume")),
            "first_page_ok": locator_equal(c("r_first_page"), c("c_first_page")),
            "last_page_ok": locator_equal(c("r_last_page"), c("c_last_page")),
            "type_ok": ~c("r_is_book") | c("c_item_type").isin("book", "bookSection"),
            "n_providers": provider_votes(c("c_providers")),
            "ecitmatch": F.array_contains("c_providers", CITATION_MATCH),
        }
    )


def locator_ok() -> Column:
    return F.col("volume_ok") & F.col("first_page_ok")


def year_ok() -> Column:
    return F.coalesce(F.col("year_delta") <= 1, F.lit(False))


def confidence() -> Column:
    """For ranking only; summed in a fixed order, in doubles."""
    c = F.col
    score = F.lit(0.42) * c("title_sim")
    score = score + F.when(c("year_delta") == 0, 0.14).when(c("year_delta") == 1, 0.07).otherwise(0.0)
    score = score + F.when(c("author_ok"), 0.10).otherwise(F.lit(0.06) * c("author_overlap"))
    score = score + F.when(c("corporate_ok"), 0.04).otherwise(0.0)
    score = score + F.when(c("journal_ok"), 0.09).otherwise(0.0)
    score = score + F.when(locator_ok(), 0.09).when(c("volume_ok") | c("first_page_ok"), 0.04).otherwise(0.0)
    score = score + F.when(c("last_page_ok"), 0.04).otherwise(0.0)
    score = score + F.least(F.lit(0.05), F.lit(0.025) * (c("n_providers") - 1))
    score = score + F.when(c("ecitmatch"), 0.03).otherwise(0.0)
    score = score - F.when(c("type_ok"), 0.0).otherwise(0.15)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def gate() -> Column:
    """``struct(ok, tier, confidence)``: the strongest conjunction that a pair passes."""
    c = F.col
    who = c("author_ok") | c("corporate_ok")
    sound = year_ok() & c("type_ok")
    tier = lambda ok, name, conf: F.struct(F.lit(ok).alias("ok"), F.lit(name).alias("tier"), conf.alias("confidence"))
    return (
        F.when(c("ecitmatch") & (c("title_sim") >= CITATION_MATCH_TITLE), tier(True, "ecitmatch", F.lit(0.99)))
        .when((c("title_sim") >= 0.90) & sound & locator_ok(), tier(True, "fingerprint", F.lit(0.97)))
        .when((c("title_sim") >= 0.93) & sound & c("journal_ok") & who, tier(True, "title+journal+author", F.lit(0.93)))
        .when((c("n_providers") >= 2) & (c("title_sim") >= 0.88) & sound & (c("journal_ok") | who), tier(True, "provider-agreement", F.lit(0.90)))
        .when((c("r_norm") != "") & (c("r_norm") == c("c_norm")) & sound & who, tier(True, "exact-title", F.lit(0.88)))
        .otherwise(tier(False, "none", c("confidence")))
    )


def rank_order() -> list[Column]:
    c = F.col
    return [
        c("confidence").desc(),
        c("last_page_ok").desc(),
        c("journal_ok").desc(),
        (~F.startswith(F.coalesce("c_doi", F.lit("")), F.lit(SECONDARY_DOI_PREFIX))).desc(),
        c("n_providers").desc(),
        present(c("c_doi")).desc(),
        present(c("c_pmid")).desc(),
        c("arrival").asc(),
    ]


def score_pairs(pairs: DataFrame, ref_keys: list[str]) -> DataFrame:
    """Signals, confidence, gate and rank of every pair."""
    scored = with_signals(pairs).withColumn("confidence", confidence()).withColumn("gate", gate())
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*ref_keys).orderBy(*rank_order())))


def failing_reasons() -> Column:
    """Why a pair is rejected, in a fixed order, joined by ``; ``."""
    c = F.col
    contradiction = (
        "THE REFERENCE CONTRADICTS ITSELF: its journal/year/volume/pages identify a different paper than its title. "
        "Check the bibliography entry — the volume or page numbers were likely copied from a neighbouring reference"
    )
    missing = F.concat_ws("/", F.when(~c("volume_ok"), F.lit("volume")), F.when(~c("first_page_ok"), F.lit("first page")))
    reasons = F.array(
        F.when(c("ecitmatch") & (c("title_sim") < CITATION_MATCH_TITLE), F.lit(contradiction)),
        F.when(c("title_sim") < 0.90, F.concat(F.lit("title similarity "), fixed2(c("title_sim")))),
        F.when(c("year_delta").isNull(), F.lit("candidate has no year")).when(c("year_delta") > 1, F.concat(F.lit("year differs by "), c("year_delta").cast("string"))),
        F.when(~locator_ok(), F.concat(F.lit("no "), missing, F.lit(" match"))),
        F.when(~c("journal_ok"), F.lit("journal mismatch")),
        F.when(~(c("author_ok") | c("corporate_ok")), F.lit("author mismatch")),
    )
    return F.array_join(F.array_compact(reasons), "; ")


def authors_related() -> Column:
    """Some surname of one side begins one of the other."""
    a, b = F.transform("r_authors", F.lower), F.transform("c_authors", F.lower)
    return F.exists(a, lambda x: (x != "") & F.exists(b, lambda y: (y != "") & (F.startswith(x, y) | F.startswith(y, x))))


def suspicious_entry() -> Column:
    """A title that is right on a record whose authors and journal are all different; of scored pairs."""
    c = F.col
    return (
        (c("title_sim") >= 0.95)
        & (norm_length_ratio(c("r_norm"), c("c_norm")) >= 0.70)
        & ~c("author_ok")
        & (c("author_overlap") == 0.0)
        & ~authors_related()
        & ~c("journal_ok")
        & present(c("c_doi"))
    )
