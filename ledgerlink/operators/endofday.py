"""Candidates of ambiguous rows ranked again by what the rows around them say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.functions import normalize as N
from ledgerlink.functions import similarity as S
from ledgerlink.operators.decisions import chain_edges, components, mode_first
from ledgerlink.session import cut

# Fixed values of the rules.
POOL, WINDOW, NEAR_TOP = 5, 0.10, 0.05
ACCEPT, MARGIN = 0.70, 0.05
LOCK_PENALTY, LOCK_HARD = 0.7, 0.8


def cluster_key(name: Column, postal: Column, city: Column) -> Column:
    """Name, department and commune in normal form. Rows without any of them share a key as well."""
    return F.concat_ws("::", N.alnum(name), N.department(postal, "score"), N.city(city))


def with_keys(rows: DataFrame) -> DataFrame:
    """Rows with ``key, n_name, n_city, n_postal, dept, n_address`` from name, city, postal, address."""
    c = F.col
    return rows.withColumns({"key": cluster_key(c("name"), c("postal"), c("city")), "n_name": N.alnum(c("name")), "n_city": N.city(c("city")), "n_postal": N.fixed_digits(c("postal"), 5), "dept": N.department(c("postal"), "score"), "n_address": N.address(c("address"))})


def contexts(rows: DataFrame, candidates: DataFrame, resolved: DataFrame, same: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``row_id, component``, and by component the dominant name, city, department and SIREN and how strongly that locks.

    Rows hang together by equal keys and by common SIRENs of their candidates. A resolved row belongs to a
    component with whose rows it shares the key or with whose candidates the SIREN. The most frequent value
    of the resolved rows dominates, of the component's own rows where none is resolved; of equals the one of
    the least row_id. The lock is the share of the dominant SIREN among the resolved rows. Where ``same``
    (row_id, like) says which row has the same candidates, ``candidates`` need hold those of that row only.
    """
    sirens = cut(candidates.where("siren <> ''").select("row_id", "siren").distinct())
    alone = rows.select(F.col("row_id").alias("a"), F.col("row_id").alias("b"))
    edges = chain_edges(rows.select("row_id", "key"), "row_id", "key").unionByName(chain_edges(sirens, "row_id", "siren")).unionByName(alone)
    if same is not None:
        edges = edges.unionByName(same.select(F.col("row_id").alias("a"), F.col("like").alias("b")))
    member = cut(components(edges).withColumnRenamed("id", "row_id"))
    keys = rows.select("row_id", "key").join(member, "row_id").select("component", "key").distinct()
    known = sirens.join(member, "row_id").select("component", "siren").distinct()
    shared = resolved.join(keys, "key").select("component", "row_id").unionByName(resolved.join(known, "siren").select("component", "row_id")).distinct()
    linked = cut(shared.join(resolved.select("row_id", "n_name", "n_city", "dept", "siren"), "row_id"))
    own = rows.join(member, "row_id")
    out = member.select("component").distinct()
    for value, name in (("n_name", "top_name"), ("n_city", "top_city"), ("dept", "top_dept")):
        first, second = (mode_first(df.where(F.col(value) != ""), ["component"], value, "row_id").select("component", F.col(value).alias(a)) for df, a in ((linked, "_l"), (own, "_o")))
        out = out.join(first, "component", "left").join(second, "component", "left").withColumn(name, F.coalesce("_l", "_o", F.lit(""))).drop("_l", "_o")
    total = linked.groupBy("component").agg(F.count("*").alias("_t"))
    top = mode_first(linked.where("siren <> ''"), ["component"], "siren", "row_id").select("component", F.col("siren").alias("top_siren"), "n")
    out = out.join(top, "component", "left").join(total, "component", "left")
    return member, out.select("component", "top_name", "top_city", "top_dept", F.coalesce("top_siren", F.lit("")).alias("top_siren"), F.coalesce(F.col("n") / F.col("_t"), F.lit(0.0)).alias("lock"))


def geo_prior(postal: Column, dept: Column, city: Column, c_postal: Column, c_dept: Column, c_city: Column, top_city: Column, top_dept: Column) -> Column:
    """How near a candidate lies to its row and to where the rows around it lie."""
    near = F.when((postal != "") & (postal == c_postal), 0.45).when((dept != "") & (dept == c_dept), 0.25).otherwise(0.0)
    town = F.when((city != "") & (city == c_city), 0.35).when((top_city != "") & (top_city == c_city), 0.2).otherwise(0.0)
    return N.clamp01(near + town + F.when((top_dept != "") & (top_dept == c_dept), 0.1).otherwise(0.0))


def reranked(rows: DataFrame, candidates: DataFrame, resolved: DataFrame, memory: DataFrame | None = None, sirens: DataFrame | None = None, same: DataFrame | None = None) -> DataFrame:
    """Each viable candidate of each ambiguous row with priors, scores, place and the row's decision.

    ``rows``: row_id, name, city, postal, address, has_date. ``candidates``: row_id, pos, candidate_id,
    siren, score, hard_veto, c_name, c_city, c_postal, c_address, active, head. ``resolved``: row_id, name,
    city, postal, address, candidate_id, siren. ``memory``: candidate_id, confidence. Nulls count as ''
    or false, repeated row_ids are one row. Rows without a viable candidate are left out. Where ``candidates``
    holds only the first five of a row, ``sirens`` (row_id, siren) has those of all; with ``same`` (row_id, like),
    of the rows that stand for others with the same candidates.

    The first five of a row in the given order, less vetoed ones, are looked at. Where the best two are
    within a tenth, the priors add to the score; a SIREN that dominates strongly takes from all others, or
    rules them out. Where the best two are branches of one SIREN within MARGIN, the branch that suits the row best
    goes first; its margin is then negative or nothing, and the row is not accepted.
    """
    c, lit = F.col, F.lit
    text = lambda df, *names: df.withColumns({n: F.coalesce(c(n), lit("")) for n in names})
    rows = cut(with_keys(text(rows.dropDuplicates(["row_id"]), "name", "city", "postal", "address")))
    resolved = cut(with_keys(text(resolved.dropDuplicates(["row_id"]), "name", "city", "postal", "address", "candidate_id", "siren")))
    pool = text(candidates, "candidate_id", "siren", "c_name", "c_city", "c_postal", "c_address").withColumn("score", N.clamp01(F.coalesce("score", lit(0.0))))
    member, around = contexts(rows, pool if sirens is None else text(sirens, "siren"), resolved, same)
    by_row = Window.partitionBy("row_id")
    pool = pool.withColumn("_n", F.row_number().over(by_row.orderBy("pos"))).where((c("_n") <= POOL) & ~F.coalesce("hard_veto", lit(False)))
    local = by_row.orderBy(c("score").desc(), "pos")
    pool = pool.withColumns({"_local": F.row_number().over(local), "_viable": F.count("*").over(by_row)})
    second = F.max(F.when(c("_local") == 2, c("score"))).over(by_row)
    pool = pool.withColumn("local_margin", F.max("score").over(by_row) - F.coalesce(second, lit(0.0)))
    seen = resolved.where("candidate_id <> ''").groupBy("candidate_id").agg(F.count("*").alias("_seen"))
    seen_siren = resolved.where("siren <> ''").groupBy("siren").agg(F.count("*").alias("_seen_siren"))
    x = pool.join(rows.select("row_id", "n_name", "n_city", "n_postal", "dept", "n_address", "has_date"), "row_id").join(member, "row_id").join(around, "component")
    x = x.join(seen, "candidate_id", "left").join(seen_siren, "siren", "left")
    x = x.join(memory.select("candidate_id", c("confidence").alias("_memory")), "candidate_id", "left") if memory is not None else x.withColumn("_memory", lit(0.0))
    x = x.withColumns({"m_name": N.alnum(c("c_name")), "m_city": N.city(c("c_city")), "m_postal": N.fixed_digits(c("c_postal"), 5), "m_dept": N.department(c("c_postal"), "score"), "m_address": N.address(c("c_address"))})
    target = F.when(c("top_name") != "", c("top_name")).otherwise(c("n_name"))
    share = lambda n: F.least(lit(1.0), F.coalesce(c(n), lit(0)) / 5)
    active, dated = F.coalesce("active", lit(False)), F.coalesce("has_date", lit(False))
    x = x.withColumns({
        "prior_name": N.clamp01(0.65 * S.jaro_winkler(c("m_name"), target) + 0.2 * share("_seen") + 0.15 * N.clamp01(F.coalesce("_memory", lit(0.0)))),
        "prior_city": N.clamp01(0.7 * F.when((c("top_city") != "") & (c("top_city") == c("m_city")), 1.0).otherwise(0.0) + 0.3 * F.when(c("siren") != "", share("_seen_siren")).otherwise(0.0)),
        "prior_geo": geo_prior(c("n_postal"), c("dept"), c("n_city"), c("m_postal"), c("m_dept"), c("m_city"), c("top_city"), c("top_dept")),
        "prior_time": F.when(dated, F.when(active, 1.0).otherwise(0.25)).otherwise(F.when(active, 0.75).otherwise(0.45)),
    })
    other = (c("top_siren") != "") & (c("siren") != "") & (c("siren") != c("top_siren"))
    tie = (c("_viable") > 1) & (c("local_margin") <= WINDOW)
    added = N.clamp01(c("score") + 0.04 * c("prior_name") + 0.03 * c("prior_city") + 0.03 * c("prior_geo") + 0.02 * c("prior_time") - F.when(other & (c("lock") >= LOCK_PENALTY), 0.06).otherwise(0.0))
    eod = F.when(other & (c("lock") >= LOCK_HARD), 0.0).when(tie, added).otherwise(c("score"))
    x = x.withColumns({"eod_score": F.round(eod, 4), "local_margin": F.round("local_margin", 4)})

    geo = geo_prior(c("n_postal"), c("dept"), c("n_city"), c("m_postal"), c("m_dept"), c("m_city"), c("n_city"), c("dept"))
    close = S.overlap(c("n_address"), c("m_address"))
    head = F.coalesce("head", lit(False))
    evidence = (geo >= 0.6) | (close >= 0.45)
    office = F.when(evidence, F.when(head, 0.0).otherwise(1.0)).otherwise(F.when(head, 1.0).otherwise(0.5))
    branch = N.clamp01(0.5 * F.when(active, 1.0).otherwise(F.when(dated, 0.15).otherwise(0.4)) + 0.25 * geo + 0.2 * close + 0.05 * office)
    place = by_row.orderBy(c("eod_score").desc(), "_local")
    x = x.withColumns({"branch_score": F.round(branch, 6), "place": F.row_number().over(place)})
    of = lambda k, n: F.max(F.when(c("place") == k, c(n))).over(by_row)
    x = x.withColumns({"_top": of(1, "eod_score"), "_top_siren": of(1, "siren"), "_next": F.coalesce(of(2, "eod_score"), lit(0.0)), "_next_siren": of(2, "siren")})
    same = (c("_top_siren") != "") & (c("_top_siren") == c("_next_siren")) & (F.round(c("_top") - c("_next"), 10) < MARGIN)
    rival = same & (c("siren") == c("_top_siren")) & (F.round(c("_top") - c("eod_score"), 10) <= NEAR_TOP)
    best = F.min(F.when(rival, F.struct((-c("branch_score")).alias("b"), c("place").alias("p")))).over(by_row)
    x = x.withColumn("_chosen", F.coalesce(best["p"], lit(1)))
    x = x.withColumn("_score", F.max(F.when(c("place") == c("_chosen"), c("eod_score"))).over(by_row))
    margin = F.round(c("_score") - F.when(c("_chosen") == 1, c("_next")).otherwise(c("_top")), 4)
    x = x.withColumns({"chosen": c("place") == c("_chosen"), "margin": margin})
    accept = (c("_score") >= ACCEPT) & (c("margin") >= MARGIN)
    reason = F.when(accept, "GLOBAL_TIEBREAK").when(c("margin") < MARGIN, "MARGIN_TOO_SMALL").otherwise("SCORE_TOO_LOW")
    out = x.withColumns({"decision": F.when(accept, "AUTO_ACCEPT").otherwise("REVIEW_REQUIRED"), "reason": reason})
    return out.select("row_id", "component", "candidate_id", "siren", c("score").alias("local_score"), "eod_score", "prior_name", "prior_city", "prior_geo", "prior_time", "branch_score", "place", "chosen", "local_margin", "margin", "decision", "reason", "top_siren", "lock")
