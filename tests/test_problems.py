"""The general problems against brute force, with nulls, repeats, hot keys and clashing columns."""

import datetime as dt
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlink.operators import asof, nested, rejects

DAY = dt.date(2024, 1, 1)


def brute_asof(events, versions):
    out = []
    for k, d, n in events:
        known = [(vd, o) for vk, vd, o in versions if k is not None and d is not None and vk == k and vd is not None and vd <= d]
        out.append((n, max(known)[1] if known else None))
    return sorted(out)


def test_known_at_equals_brute_force_for_any_shard_size(spark):
    events = [("hot", DAY + dt.timedelta(days=i % 60), i) for i in range(400)] + [("hot", DAY + dt.timedelta(days=7), 1000 + i) for i in range(100)]
    events += [("cold", DAY + dt.timedelta(days=i), 2000 + i) for i in range(5)] + [(None, DAY, 3000), ("hot", None, 3001), ("none", DAY, 3002)]
    versions = [("hot", DAY + dt.timedelta(days=9 * i - 20), i) for i in range(12)] + [("hot", DAY + dt.timedelta(days=7), 50), ("hot", DAY + dt.timedelta(days=7), 51), ("cold", DAY + dt.timedelta(days=2), 60), ("cold", None, 61), (None, DAY, 62)]
    e = spark.createDataFrame(events, "k string, d date, n int")
    v = spark.createDataFrame(versions, "k string, d date, n int")  # the columns bear the same names
    for rows in (7, 60, 10**6):
        got = asof.known_at(e, v, F.col("k"), F.col("d"), F.col("k"), F.col("d"), F.struct("n"), shard_rows=rows)
        assert sorted((r[0], r[1]) for r in got.select("event.n", "version.n").collect()) == brute_asof(events, versions), rows


def test_known_at_of_empty_tables(spark):
    e = spark.createDataFrame([("a", DAY)], "k string, d date")
    none = e.limit(0)
    args = (F.col("k"), F.col("d"), F.col("k"), F.col("d"), F.struct("d"))
    assert asof.known_at(e, none, *args).collect()[0]["version"] is None
    assert asof.known_at(none, e, *args).count() == 0


def test_real_day(spark):
    cases = {" 2024-02-29 ": "2024-02-29", "2023-02-29": None, "31/12/2023": "2023-12-31", "01-02-2023": "2023-02-01", "2023-05-06T07:08:09": "2023-05-06", "2023-05-06T27:08:09": None, "0000-00-00": None, "2021-6-7": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", asof.real_day(F.col("t")).cast("string").alias("d"))
    assert {r.t: r.d for r in df.collect()} == cases


UPLOAD = [
    (1, 1, 1, '﻿"FR_SIRET";"Transaction_Date";"Amount";"Supplier"'), (2, 1, 2, "12345678901234;2024-01-02;1,5;A"), (3, 1, 3, '12345678901234;2024-01-02;"1,5";"A;B"'), (4, 1, 4, '"x;2024-01-02;1;A'),
    (5, 1, 5, "12345678901234;2024-01-02;1"), (6, 1, 6, "123;2024-01-02;1;A"), (7, 1, 7, "123 456 789.01234;30/02/2024;1;A"), (8, 1, 8, ";;1e3;A"), (9, 1, 9, " \t "), (10, 1, 10, None), (11, 1, 11, '12345678901234;2024-01-02;1;"A\nB"'),
    (12, 1, 12, '12345678901234;2024-01-02;1;a"b"c'), (13, 1, 13, ";;;"), (14, 2, 2, "a;b"), (15, None, 2, "a;b"), (16, 1, 2, "12345678901234;2024-01-02;1,5;A"), (17, 1, 14, "1;" * 50_000),
]
EXPECTED = {1: "header", 2: "loaded", 3: "loaded", 4: "broken_quoting", 5: "column_count", 6: "invalid_siret", 7: "invalid_date", 8: "invalid_amount", 9: "blank", 10: "blank", 11: "loaded", 12: "broken_quoting", 13: "loaded", 14: "no_header", 15: "no_header", 16: "loaded", 17: "column_count"}


def test_uploads_are_split_with_reasons(spark):
    df = spark.createDataFrame(UPLOAD, "line_id bigint, file_id bigint, line_no int, raw string").withColumn("header", F.lit("clash"))
    for piece in (3, 10**6):
        rows = {r.line_id: r for r in rejects.split_uploads(df, piece=piece).collect()}
        assert {k: r.reason or r.state for k, r in rows.items()} == EXPECTED
        assert rows[2].amount == 1.5 and rows[2].day == dt.date(2024, 1, 2) and rows[3].fields["Supplier"] == "A;B" and rows[11].fields["Supplier"] == "A\nB"
    assert rejects.split_uploads(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='aé;"\n\r \ue000', min_size=1, max_size=9), min_size=1, max_size=9))
def test_reject_tables_tell_what_an_exact_parser_tells(records):
    import duckdb

    read, reasons, _ = rejects.read_records(duckdb.connect(), {0: list(range(len(records)))}, records, ";", 3)
    for i, r in enumerate(records):
        got = rejects.exact_fields(r, ";")
        assert reasons.get(i) == ("broken_quoting" if got is None else "column_count" if len(got) != 3 else None), r
        assert read.get(i) == (got if got is not None and len(got) == 3 else None)


def test_reasons_come_from_the_reject_tables(monkeypatch):
    import duckdb

    monkeypatch.setattr(rejects, "duckdb_pass", lambda *_: ({}, {}))
    read, reasons, _ = rejects.read_records(duckdb.connect(), {0: [0, 1, 2]}, ["a;b;c", "a;b", '"a";b;c'], ";", 3)
    assert not read and "column_count" not in reasons.values()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='a;"\n ', max_size=6), min_size=1, max_size=4))
def test_exact_fields_read_what_was_written(fields):
    line = ";".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert rejects.exact_fields(line, ";") == fields


def brute_children(bodies):
    out = []
    for b, body in enumerate(bodies):
        try:
            top = json.loads(body)
        except ValueError:
            continue
        h = top.get("etablissements", top.get("etablissement")) if isinstance(top, dict) else None
        for i, e in enumerate(h if isinstance(h, list) else [h]):
            for c in nested.CHILDREN if isinstance(e, dict) else []:
                v = e.get(c)
                out += [(b, i, c, k) for k, z in enumerate(v if isinstance(v, list) else [v]) if isinstance(z, dict)]
    return sorted(out)


values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(alphabet='a"\\{}[],:é', max_size=5)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from([*nested.CHILDREN, "siret", "x\\\"y"]), x, max_size=4)), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["etablissements", "etablissement"]), values, st.sampled_from([None, 1, 3])), min_size=1, max_size=4))
def test_structural_index_equals_a_parser(pages):
    bodies = [json.dumps({"header": {}, k: v}, indent=i, ensure_ascii=False) for k, v, i in pages]
    bodies = [*bodies, bodies[0][:-2], '{"a": "', "null", "<html>{}</html>"]
    got = sorted((b, i, c, k) for b, i, _, c, k, _ in nested.establishments(bodies) if c != "etablissement")
    assert got == brute_children(bodies)


def test_linked_rows_and_tables(spark):
    body = json.dumps({"etablissements": [None, {"siret": 12345678901234, "uniteLegale": {"siren": "1"}, "periodesEtablissement": [None, {"dateDebut": "2020-01-01"}]}]})
    df = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "{"), (1, body)], "page_id bigint, body string").withColumn("json", F.lit("clash"))
    rows = nested.linked_rows(df)
    assert sorted((r.page_id, r.etab_idx, r.siret, r.child, r.child_idx) for r in rows.collect()) == sorted(2 * [(1, 1, "12345678901234", c, k) for c, k in (("etablissement", 0), ("uniteLegale", 0), ("periodesEtablissement", 1))])
    assert nested.flat_table(rows, "periodesEtablissement").first().dateDebut == "2020-01-01"
    assert nested.linked_rows(df.limit(0)).count() == 0


def test_pages_are_read_in_small_blocks():
    """A worker holds a block of bodies at a time, and gives back what was asked for in pieces of about that size."""
    import json
    import tracemalloc

    import pyarrow as pa

    class Pages:
        select = lambda self, *_: self
        mapInArrow = lambda self, work, _: work

    etab = {"siret": "1" * 14, "uniteLegale": {"siren": "1" * 9}, "periodesEtablissement": [{"dateDebut": "2020-01-01", "activitePrincipaleEtablissement": "x" * 2000}] * 5}
    one, long = json.dumps({"etablissements": [etab]}), json.dumps({"etablissements": [etab] * 400})
    bodies = pa.array([one, None, "", *[one] * 2000, long, one])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bodies)), pa.int64()), bodies], names=["page_id", "body"])
    tracemalloc.start()
    sizes, n = [], 0
    for out in nested.linked_rows(Pages())([batch]):
        sizes.append(out.nbytes)
        n += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2402 * 7 and max(sizes) < 3_000_000 and peak < 40_000_000
    few = pa.Table.from_batches(list(nested.linked_rows(Pages(), ["uniteLegale"], with_json=False)([batch])))
    assert few.num_rows == 2402 and set(few["child"].to_pylist()) == {"uniteLegale"} and few["json"].null_count == 2402
