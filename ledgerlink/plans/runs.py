"""Tables in and out, resumption and reconciliation as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlink.plans.registry import query
from ledgerlink.session import table
from ledgerlink.sources.tables import column_widths, html_rows
from ledgerlink.streaming.runs import seen_by_window, unprocessed

C = F.col
query("column_widths", "select " + ", ".join(f"least(greatest(coalesce(max(length({c})), 0) + 2, {len(c) + 2}, 12), 42)::int as {c}" for c in ("Original_Name", "Original_City", "Original_Address")) + " from erp_row")(lambda s, d: column_widths(table(s, d, "erp_row").select("Original_Name", "Original_City", "Original_Address")))
query("html_rows", "select '<tr><td>' || coalesce(Original_City, '') || '</td><td>' || coalesce(Original_CP, '') || '</td></tr>' as value from (select replace(replace(replace(replace(Original_City, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as Original_City, replace(replace(replace(replace(Original_CP, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as Original_CP from erp_row)")(lambda s, d: html_rows(table(s, d, "erp_row").select("Original_City", "Original_CP")))
query("resume_antijoin", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")(lambda s, d: unprocessed(table(s, d, "orders").select("o_orderkey"), table(s, d, "lineitem").where("l_returnflag = 'R'").select(C("l_orderkey").alias("o_orderkey")), "o_orderkey"))
query("window_counts", "select time_bucket(interval '1 hour', ts) as start, user_id, count(*) as n from events group by all")(lambda s, d: seen_by_window(table(s, d, "events").withColumn("ts", C("ts").cast("timestamp")), "user_id", "ts").select(C("window.start").cast("timestamp_ntz").alias("start"), "user_id", "n"))
query("extraction_reconcile", "with x as (select row_id, count(*) as n from extraction group by 1), e as (select distinct 'R' || lpad(cast(i as varchar), 10, '0') as row_id from (select unnest(range(1, 1 + (select max(try_cast(row_id[2:] as bigint)) from extraction where row_id like 'R%'))) as i)) select coalesce(e.row_id, x.row_id) as row_id, case when x.row_id is null then 'missing' when e.row_id is null then 'unknown' when n > 1 then 'duplicate' else 'ok' end as state from e full join x on e.row_id = x.row_id")(lambda s, d: _reconciled(s, d))
query("parse_status", "select row_id, case when length(coalesce(fields['company_name_raw'].value, '')) = 0 and length(coalesce(fields['city'].value, '')) = 0 then 'empty' when fields['company_name_raw'].evidence_text is not null and not contains(row_text, fields['company_name_raw'].evidence_text) then 'low_confidence' else 'parsed' end as status from extraction")(lambda s, d: _parse_status(s, d))
query("label_fold", "select l_orderkey as row_id, max_by(l_returnflag, l_linenumber) as last_label, max_by(case when l_returnflag = 'A' then l_suppkey end, case when l_returnflag = 'A' then l_linenumber end) as kept_candidate from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey) group by 1")(lambda s, d: _labels(s, d))


def _reconciled(spark, sf_dir):
    """Expected ids, all up to the greatest, against what came: missing, unknown, duplicate or ok."""
    x = table(spark, sf_dir, "extraction").groupBy("row_id").agg(F.count("*").alias("n"))
    last = F.max(F.expr("try_cast(substring(row_id, 2) as bigint)"))
    ids = table(spark, sf_dir, "extraction").where("row_id like 'R%'").agg(last.alias("n")).select(F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("id"))
    e = ids.select(F.concat(F.lit("R"), F.lpad(C("id").cast("string"), 10, "0")).alias("row_id"), F.lit(True).alias("expected"))
    state = F.when(C("n").isNull(), "missing").when(C("expected").isNull(), "unknown").when(C("n") > 1, "duplicate").otherwise("ok")
    return e.join(x, "row_id", "full").select("row_id", state.alias("state"))


def _parse_status(spark, sf_dir):
    f = lambda k, p: C("fields").getItem(k)[p]
    blank = lambda k: F.length(F.coalesce(f(k, "value"), F.lit(""))) == 0
    backed = F.contains("row_text", f("company_name_raw", "evidence_text"))
    return table(spark, sf_dir, "extraction").select("row_id", F.when(blank("company_name_raw") & blank("city"), "empty").when(f("company_name_raw", "evidence_text").isNotNull() & ~backed, "low_confidence").otherwise("parsed").alias("status"))


def _labels(spark, sf_dir):
    """Labels folded in their order: the last one counts, a candidate once chosen stays."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("x"))
    chosen = C("x.l_returnflag") == "A"
    return li.groupBy(C("l_orderkey").alias("row_id")).agg(F.max_by("x.l_returnflag", "l_linenumber").alias("last_label"), F.max_by(F.when(chosen, C("x.l_suppkey")), F.when(chosen, C("l_linenumber"))).alias("kept_candidate"))
