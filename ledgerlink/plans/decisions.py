"""Scoring, gates, groups and reviews as queries. Rows and candidates are orders and suppliers, or ERP rows and the registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlink.functions import normalize as N
from ledgerlink.operators import decisions as D
from ledgerlink.operators import registry as R
from ledgerlink.plans.lookups import latest
from ledgerlink.plans.registry import query
from ledgerlink.plans.scalars import alnum
from ledgerlink.session import cut, table

C = F.col
SCORES = "s as (select l_orderkey as row_id, l_suppkey as candidate_id, min((l_partkey * 37 + l_linenumber * 13) % 1000) / 1000 as score, bool_and(l_returnflag = 'R') as hard_veto from lineitem group by all)"
RANKED = f"{SCORES}, r as (select *, row_number() over (partition by row_id order by score desc, candidate_id) as rank, coalesce(round(score - lead(score) over (partition by row_id order by score desc, candidate_id), 4), 0) as margin from s)"


def scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(C("l_orderkey").alias("row_id"), C("l_suppkey").alias("candidate_id")).agg((F.min((C("l_partkey") * 37 + C("l_linenumber") * 13) % 1000) / 1000).alias("score"), F.bool_and(C("l_returnflag") == "R").alias("hard_veto"))


def ranked(spark, sf_dir):
    return D.ranked(scores(spark, sf_dir))


query("candidate_ranks", f"with {RANKED} select row_id, candidate_id, score, rank, margin from r")(lambda s, d: ranked(s, d).select("row_id", "candidate_id", "score", "rank", "margin"))
query("candidate_topk", f"with {RANKED} select row_id, candidate_id, score from r where rank <= 3")(lambda s, d: ranked(s, d).where("rank <= 3").select("row_id", "candidate_id", "score"))
query("margin_top2", f"with {RANKED} select row_id, score, margin from r where rank = 1")(lambda s, d: ranked(s, d).where("rank = 1").select("row_id", "score", "margin"))
query("minmax_prior", f"with {SCORES}, m as (select *, min(score) over (partition by row_id) as lo, max(score) over (partition by row_id) as hi from s) select row_id, candidate_id, (case when hi = lo then 1 else (score - lo) / (hi - lo) end)::double as prior from m")(
    lambda s, d: scores(s, d).select("row_id", "candidate_id", D.minmax(C("score"), "row_id").alias("prior")))
query("weighted_mean", "select l_orderkey, l_linenumber, round((coalesce(case when l_returnflag <> 'R' then l_discount * 10 end * 0.55, 0) + coalesce(case when l_linestatus = 'O' then l_tax * 10 end * 0.45, 0)) / nullif((case when l_returnflag <> 'R' then 0.55 else 0 end) + (case when l_linestatus = 'O' then 0.45 else 0 end), 0), 6) as mean from lineitem")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(D.weighted_mean([(F.when(C("l_returnflag") != "R", C("l_discount") * 10), 0.55), (F.when(C("l_linestatus") == "O", C("l_tax") * 10), 0.45)]), 6).alias("mean")))

GATE = f"""with {RANKED}, a as (select row_id, count(*) as n, bool_and(hard_veto) as all_vetoed, max_by(score, -rank) as score, max_by(margin, -rank) as margin, max_by(hard_veto, -rank) as hv, max_by(candidate_id, -rank) as c from r group by row_id),
g as (select row_id, score, margin, case when row_id % 97 = 0 then 'DEAD_LETTER' when all_vetoed then 'NO_MATCH' when row_id % 10 = 3 and not hv then 'AUTO_RESOLVED'
    when score >= case when row_id % 10 < 5 then 0.88 else 0.74 end and margin >= case when row_id % 10 < 5 then 0.08 else 0.04 end and row_id % 7 <> 0 then 'AUTO_RESOLVED'
    when score >= case when row_id % 10 < 5 then 0.72 else 0.60 end and margin < case when row_id % 10 < 5 then 0.08 else 0.04 end then 'AMBIGUOUS_EOD'
    when score >= case when row_id % 10 < 5 then 0.55 else 0.42 end then 'REVIEW_QUEUE' else 'NO_MATCH' end as gate, c from a)"""


def gated(spark, sf_dir):
    """Best candidates through the gate: a tenth of the orders knows the best one's SIRET, half of them a SIREN, some flags are severe."""
    tops = ranked(spark, sf_dir).groupBy("row_id").agg(F.count("*").alias("n_candidates"), F.bool_and("hard_veto").alias("all_vetoed"), F.min_by(F.struct("candidate_id", "score", "margin", "hard_veto"), "rank").alias("t")).select("row_id", "n_candidates", "all_vetoed", "t.*")
    c_siret = C("candidate_id").cast("string")
    tops = tops.withColumns({"c_siret": c_siret, "siret": F.when(C("row_id") % 10 == 3, c_siret).otherwise(""), "siren": F.when(C("row_id") % 10 < 5, "known").otherwise(""), "flags": F.when(C("row_id") % 7 == 0, F.array(F.lit("CP_CONTRADICTION"))).otherwise(F.expr("cast(array() as array<string>)")), "contaminated": C("row_id") % 97 == 0, "empty": F.lit(False)})
    return D.gate(tops)


query("gate_routing", GATE + " select row_id, score, margin, gate, case when gate = 'AUTO_RESOLVED' then 'AUTO_ACCEPT' when gate in ('AMBIGUOUS_EOD', 'REVIEW_QUEUE') then 'REVIEW_REQUIRED' else 'NO_MATCH' end as legacy from g")(lambda s, d: gated(s, d).select("row_id", "score", "margin", "gate", "legacy"))

STATUS = GATE + ", f as (select row_id, score, margin, gate, case when gate = 'AMBIGUOUS_EOD' and score >= 0.9 then 'AUTO_ACCEPT' end as eod, case when gate = 'DEAD_LETTER' then 'DEAD_LETTER' when row_id % 11 = 0 then 'NOT_FOUND' else '' end as api from g), d as (select *, case when eod = 'AUTO_ACCEPT' then 'EOD_RESOLVED' when api = 'NOT_FOUND' then 'NO_MATCH' when api = 'DEAD_LETTER' then 'ERROR' when gate = 'AUTO_RESOLVED' then 'AUTO_RESOLVED' when gate in ('AMBIGUOUS_EOD', 'REVIEW_QUEUE') then 'REVIEW_REQUIRED' else 'NO_MATCH' end as status from f)"


def decided(spark, sf_dir):
    g = gated(spark, sf_dir)
    eod = F.when((C("gate") == "AMBIGUOUS_EOD") & (C("score") >= 0.9), "AUTO_ACCEPT")
    api = F.when(C("gate") == "DEAD_LETTER", "DEAD_LETTER").when(C("row_id") % 11 == 0, "NOT_FOUND").otherwise("")
    return g.withColumns({"eod": eod, "api": api}).withColumn("status", D.final_status(C("api"), C("gate"), C("eod")))


query("finalize_status", STATUS + " select row_id, status, case when coalesce(eod, '') = 'AUTO_ACCEPT' or status = 'EOD_RESOLVED' then 'PHASE6' when status = 'ERROR' then 'PIPELINE' else 'PHASE5' end as source, case status when 'AUTO_RESOLVED' then 'HIGH_MARGIN' when 'EOD_RESOLVED' then 'GLOBAL_TIEBREAK' when 'REVIEW_REQUIRED' then 'NEEDS_REVIEW' when 'NO_MATCH' then 'NO_CANDIDATE' else 'PIPELINE_ERROR' end as reason from d")(
    lambda s, d: decided(s, d).select("row_id", "status", D.decision_source(C("status"), C("eod")).alias("source"), D.default_reason(C("status")).alias("reason")))
query("run_metrics", STATUS + " select count(*) as total, count(*) filter (status = 'AUTO_RESOLVED') as auto_resolved, count(*) filter (status = 'EOD_RESOLVED') as eod_resolved, count(*) filter (status = 'REVIEW_REQUIRED') as review_required, count(*) filter (status = 'NO_MATCH') as no_match, count(*) filter (status = 'ERROR') as errors, round(count(*) filter (status in ('REVIEW_REQUIRED', 'NO_MATCH', 'ERROR')) / count(*), 4) as unresolved_rate from d")(
    lambda s, d: D.run_metrics(decided(s, d)))
query("review_queue", STATUS + " select row_id, status, score from d where status in ('REVIEW_REQUIRED', 'ERROR') or status = 'NO_MATCH' and score >= 0.55")(lambda s, d: decided(s, d).where(D.needs_person(C("status"), C("score"))).select("row_id", "status", "score"))
query("review_flags", STATUS + " select row_id, array_to_string(list_filter([case when status = 'REVIEW_REQUIRED' then 'PHASE5_OR_EOD_MARKED_REVIEW_REQUIRED' end, case when status = 'ERROR' then 'PIPELINE_ERROR_OR_DEAD_LETTER' end, case when score < 0.88 then 'CONFIDENCE_BELOW_AUTO_THRESHOLD' end, case when margin < 0.08 then 'TOP2_MARGIN_TOO_SMALL' end, case when row_id % 7 = 0 then 'CP_CONTRADICTION' end], lambda x: x is not null), '|') as flags from d")(
    lambda s, d: decided(s, d).select("row_id", F.concat_ws("|", D.review_flags(C("status"), C("score"), C("margin"), C("flags"))).alias("flags")))
query("failure_patterns", STATUS + ", x as (select case when row_id % 7 = 0 then 'CP_CONTRADICTION' end as p from d where status in ('REVIEW_REQUIRED', 'NO_MATCH', 'ERROR') union all select status from d where status in ('REVIEW_REQUIRED', 'NO_MATCH', 'ERROR')) select p as pattern, count(*) as n from x where p is not null group by p")(
    lambda s, d: decided(s, d).where(C("status").isin("REVIEW_REQUIRED", "NO_MATCH", "ERROR")).select(F.explode(F.concat("flags", F.array("status"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")))
query("scoring_evaluation", STATUS + ", o as (select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'P') select round(count(*) filter (o_orderstatus = 'F') / count(*), 4) as select_rate, round(count(*) filter (o_orderstatus = 'F' and status = 'NO_MATCH') / count(*), 4) as override_rate, round(avg(score), 4) as mean_confidence from o left join d on d.row_id = o.o_orderkey")(
    lambda s, d: _evaluation(s, d))


def _evaluation(spark, sf_dir):
    """Orders that are not pending are the labels: F selects a candidate."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(C("o_orderkey").alias("row_id"), "o_orderstatus")
    j = o.join(decided(spark, sf_dir), "row_id", "left")
    rate = lambda test: F.round(F.count_if(test) / F.count("*"), 4)
    return j.agg(rate(C("o_orderstatus") == "F").alias("select_rate"), rate((C("o_orderstatus") == "F") & (C("status") == "NO_MATCH")).alias("override_rate"), F.round(F.avg("score"), 4).alias("mean_confidence"))


query("finalize_join", STATUS + ", e as (select user_id, max_by(event_type, (ts, event_id)) as last_event from events group by user_id) select o_orderkey as row_id, status, last_event from orders left join d on d.row_id = o_orderkey left join e on e.user_id = o_orderkey")(lambda s, d: _finalize_join(s, d))


def _finalize_join(spark, sf_dir):
    """Inputs with decisions and side tables; of repeated side rows the last counts."""
    e = D.upsert(table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("seq")), ["user_id"], "seq")
    o = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("row_id"))
    return o.join(decided(spark, sf_dir).select("row_id", "status"), "row_id", "left").join(e.select(C("user_id").alias("row_id"), C("event_type").alias("last_event")), "row_id", "left")


query("upsert_last", "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")(
    lambda s, d: D.upsert(table(s, d, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("seq")), ["user_id", "event_type"], "seq").drop("seq"))
query("eod_mode", "with n as (select l_orderkey, l_suppkey, count(*) as n, min(l_linenumber) as f from lineitem group by all) select l_orderkey, l_suppkey, n from n qualify row_number() over (partition by l_orderkey order by n desc, f, l_suppkey) = 1")(lambda s, d: D.mode_first(table(s, d, "lineitem"), ["l_orderkey"], "l_suppkey", "l_linenumber"))
query("eod_lock", "with n as (select l_orderkey, l_suppkey, count(*) as n from lineitem group by all) select l_orderkey, round(max(n) / sum(n), 4) as lock from n group by l_orderkey")(
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")).groupBy("l_orderkey").agg(F.round(F.max("n") / F.sum("n"), 4).alias("lock")))
query("resolved_frequency", "select l_suppkey as candidate_id, count(*) as rows, count(distinct l_orderkey) as orders from lineitem group by 1")(lambda s, d: table(s, d, "lineitem").groupBy(C("l_suppkey").alias("candidate_id")).agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("orders")))
query("entity_memory", "select l_partkey % 50 as name_key, l_suppkey, count(*) as seen, round(sum(least(1, greatest(0, l_discount * 12))), 4) as confidence from lineitem group by all")(
    lambda s, d: table(s, d, "lineitem").groupBy((C("l_partkey") % 50).alias("name_key"), "l_suppkey").agg(F.count("*").alias("seen"), F.round(F.sum(N.clamp01(C("l_discount") * 12)), 4).alias("confidence")))



@query("eod_components")
def eod_components(spark, sf_dir):
    """Customers of one cluster key (nation and number), or of one balance step in their segment, belong together."""
    c = table(spark, sf_dir, "customer").withColumns({"k": F.concat_ws("::", "c_nationkey", C("c_custkey") % 40), "s": F.concat_ws("::", "c_mktsegment", F.floor(C("c_acctbal") / 40).cast("long"))})
    alone = c.select(C("c_custkey").alias("a"), C("c_custkey").alias("b"))
    return D.components(D.chain_edges(c, "c_custkey", "k").unionByName(D.chain_edges(c, "c_custkey", "s")).unionByName(alone))


EOD = f"""with {RANKED}, p as (select *, max(score) over (partition by row_id) - score as behind, count(*) over (partition by row_id) as n from r where rank <= 5), f as (select l_suppkey as candidate_id, count(*) as freq from lineitem group by 1),
q as (select row_id, candidate_id, score, round(score + case when behind <= 0.10 and n >= 2 then 0.04 * least(1, freq / 10000) else 0 end, 6) as eod from p join f using (candidate_id) where not hard_veto)"""


@query("eod_rerank", EOD + " select row_id, candidate_id, score, eod, row_number() over (partition by row_id order by eod desc, candidate_id) as place from q")
def eod_rerank(spark, sf_dir):
    """The first five, then those without veto, ranked again by what all rows say: the name prior, a frequency, counts among those within a tenth of the best."""
    w = Window.partitionBy("row_id")
    p = ranked(spark, sf_dir).where("rank <= 5").withColumns({"behind": F.max("score").over(w) - C("score"), "n": F.count("*").over(w)}).where(~C("hard_veto"))
    f = table(spark, sf_dir, "lineitem").groupBy(C("l_suppkey").alias("candidate_id")).agg(F.count("*").alias("freq"))
    add = F.when((C("behind") <= 0.10) & (C("n") >= 2), 0.04 * F.least(F.lit(1.0), C("freq") / 10000)).otherwise(0.0)
    q = p.join(f, "candidate_id").withColumn("eod", F.round(C("score") + add, 6))
    return q.select("row_id", "candidate_id", "score", "eod", F.row_number().over(w.orderBy(C("eod").desc(), "candidate_id")).alias("place"))


query("alias_mining", f"with p as (select distinct e.row_id, {alnum('e.Original_Name')} as f, {alnum('t.u')} as t from erp_row e join (select siret, max(uniteLegale.denominationUniteLegale) as u from etablissement group by 1) t on t.siret = regexp_replace(e.Original_SIRET, '[^0-9]', '', 'g') where t.u is not null) select f as from_name, t as to_name, count(*) as n, least(1.0, count(*) / 20)::double as confidence from p where f <> '' and f <> t group by all")(lambda s, d: _aliases(s, d))


def _aliases(spark, sf_dir):
    from ledgerlink.plans.scalars import named_pairs

    return D.aliases(named_pairs(spark, sf_dir).where("b <> '' and a <> '' and a <> b").select("row_id", C("a").alias("from_name"), C("b").alias("to_name")))


#: Pairs of one postal code and beginning of the name that one task makes.
BLOCK_PAIRS = 100_000


def sides(spark, sf_dir):
    """ERP rows and the registry, once a row and a SIRET, in normal form and with the keys by which they meet."""
    e = table(spark, sf_dir, "erp_row").where("row_id is not null").groupBy("row_id").agg(F.max(F.struct("Original_SIRET", "Original_SIREN", "Original_Name", "Original_City", "Original_CP", "Original_Address", "Transaction_Date")).alias("x")).select("row_id", "x.*")
    num = F.regexp_extract(N.text(C("Original_Address")), r"^\s*(\d+)", 1)
    e = e.select("row_id", N.fixed_digits(C("Original_SIRET"), 14).alias("siret"), N.fixed_digits(C("Original_SIREN"), 9).alias("siren"), N.text(C("Original_Name")).alias("name"), N.text(C("Original_City")).alias("city"), N.fixed_digits(C("Original_CP"), 5).alias("postal"), num.alias("number"), F.regexp_replace(N.text(C("Original_Address")), r"^\s*\d+\s*", "").alias("street"), N.text(C("Original_Name")).alias("legal"), N.iso_date(C("Transaction_Date")).alias("day"))
    u, a = C("uniteLegale"), C("adresseEtablissement")
    r = latest(spark, sf_dir).select(C("siret").alias("c_siret"), C("siren").alias("c_siren"), F.coalesce("etablissementSiege", F.lit(False)).alias("c_head"), F.filter(F.array(u["denominationUniteLegale"], u["denominationUsuelle1UniteLegale"]), lambda x: x.isNotNull()).alias("c_names"), N.text(a["libelleCommuneEtablissement"]).alias("c_city"), N.text(a["codePostalEtablissement"]).alias("c_postal"), N.text(a["numeroVoieEtablissement"]).alias("c_number"), F.concat_ws(" ", a["typeVoieEtablissement"], a["libelleVoieEtablissement"]).alias("c_street"), N.text(u["denominationUniteLegale"]).alias("c_legal"), C("etatAdministratifEtablissement").alias("c_status"))
    e = D.row_side(e).withColumn("h", F.when((C("postal") != "") & (C("name") != ""), F.substring("n_name", 1, 6)))
    r = D.candidate_side(r).withColumn("h", F.coalesce(F.substring(F.try_element_at("n_names", F.lit(1)), 1, 6), F.lit("")))
    return cut(e), cut(r)


def met(e, r):
    """The rows of ``e`` with the candidates of ``r``: the same SIREN, or else the same postal code and beginning of the name.

    Each pair comes once, made by one of two joins that bring all columns along. A block of many pairs is cut among tasks.
    """
    by_siren = e.where("siren <> ''").drop("h").join(r.drop("h"), C("siren") == C("c_siren"))
    left, right = e.where("h is not null"), r.withColumn("postal", C("c_postal"))
    sizes = left.groupBy("postal", "h").agg(F.count("*").alias("n")).join(right.groupBy("postal", "h").agg(F.count("*").alias("m")), ["postal", "h"])
    large = sizes.where(C("n") * C("m") > BLOCK_PAIRS).select("postal", "h", F.least(C("n"), F.ceil(C("n") * C("m") / BLOCK_PAIRS)).cast("int").alias("k"))
    left = left.join(large, ["postal", "h"], "left").withColumn("z", F.pmod(F.xxhash64("row_id"), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
    right = right.join(large, ["postal", "h"], "left").withColumn("z", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    by_name = left.join(right, ["postal", "h", "z"]).drop("h", "z").where(~F.coalesce((C("siren") != "") & (C("siren") == C("c_siren")), F.lit(False)))
    return by_siren.unionByName(by_name).withColumn("candidate_id", C("c_siret")).withColumns({"siren_confidence": F.lit(1.0), "c_rank": F.lit(None).cast("double")})


def scores_of_all(e, r, *more):
    """Row, candidate and score of all pairs; texts of vetoed pairs, which score 0, aren't compared."""
    return D.candidate_features(met(e, r), vetoed_too=False).select("row_id", "candidate_id", "score", *more)


def _best(spark, sf_dir):
    """The best of each row by scores alone; only that one is looked at in full."""
    e, r = sides(spark, sf_dir)
    best = D.first(scores_of_all(e, r), 1).select("row_id", C("candidate_id").alias("c_siret"), "margin")
    again = best.join(e, "row_id").join(r.drop("h"), "c_siret").withColumns({"candidate_id": C("c_siret"), "siren_confidence": F.lit(1.0), "c_rank": F.lit(None).cast("double")})
    return D.candidate_reasons(D.candidate_features(again)).select("row_id", "candidate_id", "score", "margin", "decision", F.concat_ws("|", "reasons").alias("reasons"))


query("candidate_score")(lambda s, d: D.score_candidates(met(*sides(s, d))))
query("candidate_best")(lambda s, d: _best(s, d))


@query("resolution_confidence")
def resolution_confidence(spark, sf_dir):
    t = R.tiers(table(spark, sf_dir, "extraction").groupBy(C("row_id").alias("id")).agg(F.min(C("fields").getItem("company_name_raw")["value"]).alias("name"), F.min(C("fields").getItem("postal_code")["value"]).alias("postal"), F.min(C("fields").getItem("city")["value"]).alias("city")), latest(spark, sf_dir))
    x = table(spark, sf_dir, "extraction").groupBy(C("row_id").alias("id")).agg(F.min(C("fields").getItem("company_name_raw")["value"]).alias("name"), F.min(C("fields").getItem("postal_code")["value"]).alias("postal"), F.min(C("fields").getItem("city")["value"]).alias("city"))
    first = t.groupBy("id").agg(F.min_by(F.struct("siret", "tier"), "rank").alias("b"), F.count("*").alias("n_candidates"))
    r = latest(spark, sf_dir).select("siret", C("uniteLegale.denominationUniteLegale").alias("c_name"), C("adresseEtablissement.codePostalEtablissement").alias("c_postal"), C("adresseEtablissement.libelleCommuneEtablissement").alias("c_city"))
    j = first.select("id", "b.siret", F.concat(F.lit("tier"), "b.tier").alias("tier"), "n_candidates").join(x, "id").join(r, "siret").withColumns({"department": N.department(C("postal"), "search"), "api_score": F.lit(None).cast("double")})
    return D.resolution_confidence(j).select("id", "siret", "tier", "n_candidates", "confidence", "band", "needs_review")
