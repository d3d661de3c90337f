"""Scores of candidates, gates, groups of ambiguous rows, final decisions, review and learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.functions import normalize as N
from ledgerlink.functions import similarity as S
from ledgerlink.session import cut, drop

# Fixed values of the decision rules.
WEIGHTS = {"identifier": 0.52, "name": 0.23, "geo": 0.13, "address": 0.05, "temporal": 0.04, "legal_form": 0.02, "lucene": 0.01}
STRICT = {"auto": 0.88, "margin": 0.08, "ambiguous": 0.72, "review": 0.55}
RELAXED = {"auto": 0.74, "margin": 0.04, "ambiguous": 0.60, "review": 0.42}
SEVERE = ["NAME_STRONG_MISMATCH", "CP_CONTRADICTION", "CITY_STRONG_MISMATCH"]
TIER_BASE = {"siret": 0.55, "siren": 0.45, "tier2": 0.33, "tier3": 0.27, "tier4": 0.20, "tier5": 0.12}


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean over the parts that are not null, weights made to add up again; null without parts."""
    top = sum(F.coalesce(v * w, F.lit(0.0)) for v, w in parts)
    below = sum(F.when(v.isNotNull(), w).otherwise(0.0) for v, w in parts)
    return F.when(below > 0, top / below)


def row_side(rows: DataFrame) -> DataFrame:
    """Rows with their texts in normal form, as pairs need them; done once a row, not once a pair."""
    c = F.col
    return rows.withColumns({"n_name": N.core_name(c("name")), "n_city": N.city(c("city")), "n_street": N.address(c("street")), "n_dept": N.department(c("postal"), "score"), "n_legal": S.legal_family(c("legal"))})


def candidate_side(candidates: DataFrame) -> DataFrame:
    """Candidates with their texts in normal form."""
    c = F.col
    return candidates.withColumns({"n_names": F.transform("c_names", N.core_name), "m_city": N.city(c("c_city")), "m_street": N.address(c("c_street")), "m_dept": N.department(c("c_postal"), "score"), "m_legal": S.legal_family(c("c_legal"))})


def candidate_features(pairs: DataFrame, vetoed_too: bool = True) -> DataFrame:
    """``pairs`` of score_candidates, with features (``f_*``), ``hard_veto``, ``_raw`` and ``score``.

    A vetoed pair scores 0 whatever its texts say; they are left uncompared unless ``vetoed_too``.
    """
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    col = F.col
    p = pairs if "n_name" in pairs.columns else row_side(pairs)
    p = p if "n_names" in p.columns else candidate_side(p)
    same_siret, same_siren = col("siret") == col("c_siret"), col("siren") == col("c_siren")
    siret_off = ~blank(col("siret")) & ~F.coalesce(same_siret, F.lit(False))
    siren_off = blank(col("siret")) & ~blank(col("siren")) & ~F.coalesce(same_siren, F.lit(False))
    p = p.withColumns({"siret_off": siret_off, "siren_off": siren_off, "hard_veto": siret_off | siren_off & (F.coalesce("siren_confidence", F.lit(0.0)) >= 0.9)})
    texts = [col(c) for c in ("n_name", "n_names", "n_city", "m_city", "n_street", "m_street")]
    p = p.withColumn("_rates", S.candidate_rates(*(texts if vetoed_too else [F.when(~col("hard_veto"), c) for c in texts])))

    identifier = F.when(~blank(col("siret")), F.when(same_siret, 1.0).otherwise(0.0)).when(~blank(col("siren")), F.when(same_siren, F.when(col("c_head"), 0.98).otherwise(0.96)).otherwise(0.0))
    postal = F.when(blank(col("postal")) | blank(col("c_postal")), None).when(col("postal") == col("c_postal"), 1.0).when(col("n_dept") == col("m_dept"), 0.72).otherwise(0.1)
    number = F.when(blank(col("number")) | blank(col("c_number")), None).when(col("number") == col("c_number"), 1.0).otherwise(0.2)
    temporal = F.when(col("c_status") == "A", 1.0).when(col("c_status") == "F", F.when(~blank(col("day")), 0.55).otherwise(0.4)).otherwise(0.7)
    of, other = col("n_legal"), col("m_legal")
    firms = ["SAS_FAMILY", "SARL_FAMILY", "SA"]
    legal = F.when(of == "", None).when(other == "", 0.3).when(of == other, 1.0).when(of.isin(firms) & other.isin(firms), 0.7).otherwise(0.3)
    p = p.withColumns({"f_name": col("_rates.name"), "f_city": col("_rates.city"), "f_street": col("_rates.street"), "f_identifier": identifier, "f_postal": postal, "f_number": number, "f_temporal": temporal, "f_legal_form": legal})
    ranks = pairs.where("c_rank is not null").groupBy("row_id").agg(F.min("c_rank").alias("_low"), F.max("c_rank").alias("_high"))
    p = p.join(ranks, "row_id", "left").withColumn("f_lucene", F.when(col("c_rank").isNull(), None).when(col("_high") == col("_low"), 1.0).otherwise((col("c_rank") - col("_low")) / (col("_high") - col("_low"))))
    p = p.withColumns({"f_geo": weighted_mean([(col("f_postal"), 0.55), (col("f_city"), 0.45)]), "f_address": weighted_mean([(col("f_number"), 0.35), (col("f_street"), 0.65)])})
    minus = lambda test, v: F.when(test, v).otherwise(0.0)
    penalty = minus((col("f_postal") == 0.1) & (col("f_city") < 0.45), 0.10) + minus(col("f_number") == 0.2, 0.04) + minus(col("f_name") < 0.35, 0.15)
    raw = F.when(col("hard_veto"), 0.0).otherwise(N.clamp01(F.coalesce(weighted_mean([(col(f"f_{k}"), w) for k, w in WEIGHTS.items()]), F.lit(0.0)) - penalty))
    return p.withColumn("_raw", raw).withColumn("score", F.round("_raw", 4))


def candidate_reasons(p: DataFrame) -> DataFrame:
    """``candidate_features`` with ``flags``, ``reasons`` and ``decision``."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    col = F.col
    flag = lambda test, name: F.when(test, F.lit(name))
    flags = F.array_compact(F.array(
        flag(col("siret_off"), "SIRET_CONTRADICTION"), flag(col("siren_off"), "SIREN_CONTRADICTION"), flag(col("f_name") < 0.35, "NAME_STRONG_MISMATCH"), flag(col("f_postal") == 0.1, "CP_CONTRADICTION"), flag(col("f_city") < 0.45, "CITY_STRONG_MISMATCH"),
        flag(col("f_number") == 0.2, "STREET_NUMBER_CONTRADICTION"), flag(col("f_street") < 0.35, "STREET_STRONG_MISMATCH"), flag((col("c_status") == "F") & ~blank(col("day")), "ESTABLISHMENT_CLOSED_AT_REFERENCE_DATE_OR_NEAR"), flag((col("c_status") == "F") & blank(col("day")), "ESTABLISHMENT_CLOSED_CURRENTLY"),
        flag((col("n_legal") != "") & (col("m_legal") != "") & (col("f_legal_form") == 0.3), "LEGAL_FORM_WEAK_MISMATCH")))
    good = F.array_compact(F.array(flag((col("siret") == col("c_siret")) & ~blank(col("siret")), "EXACT_SIRET"), flag((col("siren") == col("c_siren")) & ~blank(col("siren")), "EXACT_SIREN"), flag(col("f_name") >= 0.9, "NAME_STRONG_MATCH"), flag(col("f_postal") == 1.0, "POSTAL_EXACT"), flag(col("f_city") >= 0.9, "CITY_STRONG_MATCH")))
    decision = F.when(col("hard_veto"), "REJECT").when(col("_raw") >= 0.88, "BEST").when(col("_raw") >= 0.72, "PLAUSIBLE").otherwise("REJECT")
    return p.withColumn("flags", flags).withColumns({"reasons": F.concat(good, "flags"), "decision": decision})


def score_candidates(pairs: DataFrame) -> DataFrame:
    """Features, flags, score and decision of each (row_id, candidate_id).

    ``pairs`` has row_id, candidate_id, the row's siret, siren, name, city, postal, number, street, legal,
    day ('' or null where absent), ``siren_confidence``, and the candidate's c_siret, c_siren, c_head,
    c_names (array), c_city, c_postal, c_number, c_street, c_legal, c_status, c_rank (its score by the
    search engine, may be null). Absent features are left out and the weights made to add up; a
    contradicting SIRET vetoes. Where ``row_side`` and ``candidate_side`` went before the join that made the
    pairs, nothing is normalised again. Pairs stay where they are.
    """
    p = candidate_reasons(candidate_features(pairs))
    return p.select("row_id", "candidate_id", *[f"f_{k}" for k in WEIGHTS], "f_postal", "f_city", "hard_veto", "flags", "reasons", "score", "decision")


def minmax(value: Column, key: str) -> Column:
    """Scaled to 0..1 among the key's rows; 1 where all are equal."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(value.isNull(), None).when(high == low, 1.0).otherwise((value - low) / (high - low))


def ranked(scores: DataFrame, order: str = "candidate_id") -> DataFrame:
    """Rank within the row, best first, and what the best is ahead of the second by (0 without a second)."""
    w = Window.partitionBy("row_id").orderBy(F.col("score").desc(), order)
    ahead = F.when(F.lead("score").over(w).isNull(), 0.0).otherwise(F.round(F.col("score") - F.lead("score").over(w), 4))
    return scores.withColumns({"rank": F.row_number().over(w), "margin": ahead})


def first(scores: DataFrame, n: int, order: str = "candidate_id") -> DataFrame:
    """``ranked``, the first ``n`` (two at least) of each row only: what is behind them is left out before it is moved."""
    w = Window.partitionBy("row_id").orderBy(F.col("score").desc(), order)
    kept = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(2, n))
    return kept.withColumn("margin", F.when(F.lead("score").over(w).isNull(), 0.0).otherwise(F.round(F.col("score") - F.lead("score").over(w), 4))).where(F.col("rank") <= n)


def gate(tops: DataFrame) -> DataFrame:
    """The nine rules, first that applies, on each row's best candidate.

    ``tops`` has row_id, n_candidates, all_vetoed, score, margin, hard_veto, flags, c_siret, siret, siren,
    contaminated, empty.
    """
    c = F.col
    given = (F.coalesce("siret", F.lit("")) != "") | (F.coalesce("siren", F.lit("")) != "")
    t = lambda k: F.when(given, STRICT[k]).otherwise(RELAXED[k])
    severe = F.arrays_overlap("flags", F.array(*[F.lit(x) for x in SEVERE]))
    exact = (F.coalesce("siret", F.lit("")) != "") & (c("siret") == c("c_siret")) & ~c("hard_veto")
    auto = (c("score") >= t("auto")) & (c("margin") >= t("margin")) & ~severe
    decision = (
        F.when(c("contaminated") | c("empty"), "DEAD_LETTER").when(c("n_candidates") == 0, "NO_MATCH").when(c("all_vetoed"), "NO_MATCH").when(exact, "AUTO_RESOLVED").when(auto, "AUTO_RESOLVED")
        .when((c("score") >= t("ambiguous")) & (c("margin") < t("margin")), "AMBIGUOUS_EOD").when(c("score") >= t("review"), "REVIEW_QUEUE").otherwise("NO_MATCH")
    )
    legacy = F.when(c("gate") == "AUTO_RESOLVED", "AUTO_ACCEPT").when(c("gate").isin("AMBIGUOUS_EOD", "REVIEW_QUEUE"), "REVIEW_REQUIRED").otherwise("NO_MATCH")
    return tops.withColumn("gate", decision).withColumn("legacy", legacy)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.8, "HIGH").when(c >= 0.55, "MEDIUM").otherwise("LOW")


def resolution_confidence(r: DataFrame) -> DataFrame:
    """Confidence of a resolution from its tier and agreements; ``r`` has tier, name, postal, city, department, c_name, c_postal, c_city, api_score, n_candidates."""
    c = F.col
    tier = F.lower(F.coalesce("tier", F.lit("")))
    base = F.lit(0.0)
    for k, v in reversed(TIER_BASE.items()):
        base = F.when(F.contains(tier, F.lit(k)), v).otherwise(base)
    yes = lambda test, v: F.when(F.coalesce(test, F.lit(False)), v).otherwise(0.0)
    full = lambda x: F.coalesce(c(x), F.lit("")) != ""
    score = base + yes(full("postal") & (c("postal") == c("c_postal")), 0.14) + yes(full("city") & full("c_city") & (N.alnum(c("city")) == N.alnum(c("c_city"))), 0.11) + yes(full("department") & full("c_postal") & (c("department") == F.substring("c_postal", 1, 2)), 0.06)
    score = score + F.when(full("name"), 0.18 * S.jaccard(N.alnum(c("name")), N.alnum(c("c_name")))).otherwise(0.0) + F.coalesce(0.12 * N.clamp01(c("api_score") / 100), F.lit(0.0)) - yes(c("n_candidates") > 1, 0.08)
    score = N.clamp01(score)
    return r.withColumns({"confidence": F.round(score, 4), "band": confidence_band(score), "needs_review": score < 0.45})


def mode_first(df: DataFrame, key: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value of each key; of equals, the one seen first, then the least."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"), F.min(seq).alias("_first"))
    best = counted.groupBy(*key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("_first"), F.col(value))).alias("x"))
    return best.select(*key, f"x.{value}", "x.n")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of undirected ``a, b``: the least id reached. Each round stars are pulled to their least neighbour.

    Large and small stars in turn, so that the rounds grow with the logarithm of the size; no component is
    gathered anywhere.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null").distinct())
    nodes = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
    e = first = e.where("a <> b")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        new = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        changed = new.exceptAll(e).limit(1).count() + e.exceptAll(new).limit(1).count()
        if e is not first:  # the nodes are read from the first
            drop(e)
        e = new
        if not changed:
            break
    return nodes.join(e.groupBy("a").agg(F.min("b").alias("c")), F.col("id") == F.col("a"), "left").select("id", F.coalesce("c", "id").alias("component"))


def chain_edges(df: DataFrame, node: str, key: str) -> DataFrame:
    """Edges that hold the rows of each key together: every row to the key's least, not all pairs."""
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(node).alias("b"))
    return df.join(least, key).select(F.col(node).alias("a"), "b").where("a <> b").distinct()


def upsert(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last write of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.col(seq)).alias("x")).select(*key, "x.*")


def final_status(api: Column, gate_: Column, eod: Column) -> Column:
    s, g = F.upper(F.coalesce(api, F.lit(""))), F.upper(F.coalesce(gate_, F.lit("")))
    return (
        F.when(eod == "AUTO_ACCEPT", "EOD_RESOLVED").when(s == "EOD_RESOLVED", "EOD_RESOLVED").when(s == "SUCCESS", "AUTO_RESOLVED").when(s.isin("AMBIGUOUS_EOD", "REVIEW_QUEUE"), "REVIEW_REQUIRED").when(s == "NOT_FOUND", "NO_MATCH").when(s.isin("DEAD_LETTER", "ERROR"), "ERROR")
        .when(g == "AUTO_RESOLVED", "AUTO_RESOLVED").when(g.isin("AMBIGUOUS_EOD", "REVIEW_QUEUE"), "REVIEW_REQUIRED").when(g == "DEAD_LETTER", "ERROR").otherwise("NO_MATCH")
    )


def decision_source(status: Column, eod: Column) -> Column:
    return F.when((eod == "AUTO_ACCEPT") | (status == "EOD_RESOLVED"), "PHASE6").when(status == "ERROR", "PIPELINE").otherwise("PHASE5")


def default_reason(status: Column) -> Column:
    return F.when(status == "AUTO_RESOLVED", "HIGH_MARGIN").when(status == "EOD_RESOLVED", "GLOBAL_TIEBREAK").when(status == "REVIEW_REQUIRED", "NEEDS_REVIEW").when(status == "NO_MATCH", "NO_CANDIDATE").otherwise("PIPELINE_ERROR")


def run_metrics(decisions: DataFrame) -> DataFrame:
    s = F.col("status")
    n = lambda *v: F.count_if(s.isin(*v))
    rate = lambda x: F.when(F.count("*") == 0, 0.0).otherwise(F.round(x / F.count("*"), 4))
    return decisions.agg(F.count("*").alias("total"), n("AUTO_RESOLVED").alias("auto_resolved"), n("EOD_RESOLVED").alias("eod_resolved"), n("REVIEW_REQUIRED").alias("review_required"), n("NO_MATCH").alias("no_match"), n("ERROR").alias("errors"), rate(n("REVIEW_REQUIRED", "NO_MATCH", "ERROR")).alias("unresolved_rate"))


def needs_person(status: Column, confidence: Column) -> Column:
    return status.isin("REVIEW_REQUIRED", "ERROR") | (status == "NO_MATCH") & (F.coalesce(confidence, F.lit(0.0)) >= 0.55)


def review_flags(status: Column, confidence: Column, margin: Column, reasons: Column) -> Column:
    """In order, without repeats."""
    flag = lambda test, name: F.when(test, F.lit(name))
    fixed = F.array_compact(F.array(flag(status == "REVIEW_REQUIRED", "PHASE5_OR_EOD_MARKED_REVIEW_REQUIRED"), flag(status == "ERROR", "PIPELINE_ERROR_OR_DEAD_LETTER"), flag(F.coalesce(confidence, F.lit(0.0)) < STRICT["auto"], "CONFIDENCE_BELOW_AUTO_THRESHOLD"), flag(F.coalesce(margin, F.lit(0.0)) < STRICT["margin"], "TOP2_MARGIN_TOO_SMALL")))
    return F.array_distinct(F.concat(fixed, reasons))


def aliases(changes: DataFrame) -> DataFrame:
    """How often a form was corrected into another, with a confidence that reaches 1 at 20 times."""
    return changes.groupBy("from_name", "to_name").agg(F.count("*").alias("n")).withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 20))
