"""Loadable and faulty records of uploaded text files, with the reason of each fault (problem 2)."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.session import piece_rows

#: Delimiters that a file may have, in the order in which they are tried.
DELIMITERS = [",", ";", "\t", "|"]
#: Columns that every file has.
NEEDED = ["FR_SIRET", "Transaction_Date", "Amount"]
#: What the reader's kinds of error say of a record.
ERRORS = {"UNQUOTED VALUE": "broken_quoting", "MISSING COLUMNS": "column_count", "TOO MANY COLUMNS": "column_count"}

VALUES = r"""
with t as (select id,
        regexp_replace(coalesce(siret, ''), '[ \t\x{00A0}\x{202F}.\-]', '', 'g') as siret,
        regexp_replace(coalesce(day, ''), '^[\s\x{00A0}\x{202F}]+|[\s\x{00A0}\x{202F}]+$', '', 'g') as d,
        regexp_replace(coalesce(amount, ''), '^[\s\x{00A0}\x{202F}]+|[\s\x{00A0}\x{202F}]+$', '', 'g') as a
    from given),
u as (select *, case when regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then d
        when regexp_full_match(d, '[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}') then d[7:10] || '-' || d[4:5] || '-' || d[1:2] end as iso
    from t),
w as (select *, case when iso not like '0000%' then try_cast(iso as date) end as day from u)
select id, nullif(siret, '') as siret, day, try_cast(replace(a, ',', '.') as double) as amount,
    case when siret <> '' and not regexp_full_match(siret, '[0-9]{14}') then 'invalid_siret'
        when d <> '' and day is null then 'invalid_date'
        when a <> '' and not regexp_full_match(a, '-?[0-9]+([.,][0-9]+)?') then 'invalid_amount' end as reason
from w order by id
"""


def exact_fields(record: str, delimiter: str) -> list[str] | None:
    """The fields of one record, or None where a ``"`` stands elsewhere than around a field or doubled in one."""
    if '"' not in record:
        return record.split(delimiter)
    d = re.escape(delimiter)
    one = rf'(?:"(?:[^"]++|"")*+"|[^"{d}]*+)'
    if not re.fullmatch(rf"{one}(?:{d}{one})*+", record):
        return None
    fields = re.findall(rf"(?:^|{d})({one})", record)
    return [x[1:-1].replace('""', '"') if x.startswith('"') else x for x in fields]


def header_of(line: str | None) -> tuple[str, list[str]] | None:
    """Delimiter and column names of a header record; None if it isn't one."""
    for d in DELIMITERS if isinstance(line, str) else []:
        names = exact_fields(line.lstrip("\ufeff"), d)
        names = [x.strip() for x in names or []]
        if all(x in names for x in NEEDED):
            return d, names
    return None


def stand_ins(records: list[str], n: int) -> list[str]:
    """``n`` private characters that stand in none of the records."""
    used = {c for r in records if not r.isascii() for c in r}
    return [c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used][:n]


def duckdb_pass(con, files: list[tuple[list[int], list[str]]], delimiter: str, width: int) -> tuple[dict[int, list[str]], dict[int, str]]:
    """Reads the files, given as ordinals and records, with reject tables.

    Returns the fields of the rows read by ordinal, and the reason of those rejected. An ordinal in neither
    was lost with a quote that never closes.
    """
    lf, cr, null = stand_ins([r for _, records in files for r in records], 3)
    with tempfile.TemporaryDirectory() as scratch:  # lives no longer than this call, read by nobody else
        paths, longest, size = [], 0, 0
        for k, (ordinals, records) in enumerate(files):
            paths.append(os.path.join(scratch, f"{k}.csv"))
            lines = [f"{o}{delimiter}{r}\n" for o, r in zip(ordinals, (r.replace("\n", lf).replace("\r", cr) for r in records))]
            with open(paths[-1], "w", encoding="utf-8", errors="replace", newline="") as f:
                f.writelines(lines)
            size, longest = max(size, 4 * sum(map(len, lines))), max(longest, *map(len, lines))
        columns = {"ordinal": "BIGINT"} | {f"c{k}": "VARCHAR" for k in range(width)}
        line = min(size + 1024, max(2_000_000, 4 * longest + 1024))
        got = con.sql(
            f"select * from read_csv($files, delim=$delim, quote='\"', escape='\"', header=false, auto_detect=false, columns={columns!r}, store_rejects=true, strict_mode=true, new_line='\\n', nullstr=$null, parallel=false, max_line_size={line}, buffer_size={2 * line})",
            params={"files": paths, "delim": delimiter, "null": null},
        ).to_arrow_table()
        errors = con.execute("select csv_line, error_type from reject_errors").fetchall()
        con.execute("drop table reject_errors; drop table reject_scans")
    reasons: dict[int, str] = {}
    for text, kind in errors:
        first = (text or "").split(delimiter, 1)[0]
        if first.isdigit() and reasons.get(int(first)) != "broken_quoting":
            reasons[int(first)] = ERRORS.get(kind, "unreadable")
    back = lambda x: x.replace(lf, "\n").replace(cr, "\r") if x is not None else ""
    rows = zip(*(c.to_pylist() for c in got.columns))
    read = {o: list(map(back, fields)) for o, *fields in rows if o not in reasons and not any("\n" in f for f in fields if f)}  # a real line end in a field: the next records went with it
    return read, reasons


def read_records(con, by_file: dict[int, list[int]], raw: list[str], delimiter: str, width: int) -> tuple[dict[int, list[str]], dict[int, str], int]:
    """Fields by ordinal of the records that load, reasons of those that don't, and how many the exact check decided.

    Records with an odd number of quotes are read alone, each as a file of its own, for they would take
    those behind them along; so are any that another record took along. One that is lost even so has a
    quote that never closes. The reader lets quotes pass inside an unquoted field and blanks around a quoted
    one: only for what it read, or counted columns of, the exact check says whether the quoting is right.
    """
    odd = {i for ids in by_file.values() for i in ids if raw[i].count('"') % 2}
    files = [(ids, [raw[i] for i in ids]) for ids in ([i for i in x if i not in odd] for x in by_file.values()) if ids]
    read, reasons = duckdb_pass(con, files, delimiter, width) if files else ({}, {})
    alone = [i for ids in by_file.values() for i in ids if i not in read and i not in reasons]
    if alone:
        again, why = duckdb_pass(con, [([i], [raw[i]]) for i in alone], delimiter, width)
        read.update(again)
        reasons.update(why)
        reasons.update((i, "broken_quoting") for i in alone if i not in again and i not in why)
    decided = 0
    for i in [i for ids in by_file.values() for i in ids if '"' in raw[i] and reasons.get(i) != "broken_quoting"]:
        if exact_fields(raw[i], delimiter) is None:
            decided += 1
            reasons[i] = "broken_quoting"
            read.pop(i, None)
    return read, reasons, decided


def split_batch(con, pdf: pd.DataFrame, headers: dict, with_fields: bool) -> pd.DataFrame:
    """Every record of the batch with its state, reason, typed values and, if asked for, all its fields."""
    n = len(pdf)
    raw, lines = pdf["raw"].to_list(), pdf["header"].to_list()
    state, reason = np.full(n, "rejected", dtype=object), np.full(n, None, dtype=object)
    values = np.full((n, 3), None, dtype=object)
    fields: list = [None] * n
    head, groups = [None] * n, {}
    for i, (r, h) in enumerate(zip(raw, lines)):
        if h not in headers:
            headers[h] = header_of(h)
        head[i] = headers[h]
        if pdf["line_no"].iat[i] == 1:
            state[i] = "header"
        elif not isinstance(r, str) or not r.strip():
            state[i] = "blank"
        elif head[i] is None:
            reason[i] = "no_header"
        else:
            groups.setdefault((head[i][0], len(head[i][1])), {}).setdefault(pdf["file_id"].iat[i], []).append(i)
    good: list[int] = []
    for (delimiter, width), by_file in groups.items():
        read, reasons, _ = read_records(con, by_file, raw, delimiter, width)
        for i, why in reasons.items():
            reason[i] = why
        for i, got in read.items():
            d = dict(zip(head[i][1], got))
            values[i] = [d[x] for x in NEEDED]
            fields[i] = d if with_fields else None
            good.append(i)
    given = pd.DataFrame({"id": np.array(good, dtype="int64"), "siret": pd.Series(values[good, 0] if good else [], dtype="string"), "day": pd.Series(values[good, 1] if good else [], dtype="string"), "amount": pd.Series(values[good, 2] if good else [], dtype="string")})
    con.register("given", given)
    typed = con.sql(VALUES).to_arrow_table()
    con.unregister("given")
    siret, day, amount = (np.full(n, None, dtype=object) for _ in range(3))
    for i, s, d, a, why in zip(*(typed.column(k).to_pylist() for k in range(5))):
        reason[i], state[i] = why, "rejected" if why else "loaded"
        if not why:
            siret[i], day[i], amount[i] = s, d, a
    return pd.DataFrame({"line_id": pdf["line_id"], "file_id": pdf["file_id"], "line_no": pdf["line_no"], "raw": pdf["raw"], "state": state, "reason": reason, "siret": siret, "day": day, "amount": amount, "fields": [f if s == "loaded" else None for f, s in zip(fields, state)]})


def split_uploads(records: DataFrame, with_fields: bool = True, piece: int = 20_000) -> DataFrame:
    """Uploaded records with their state, and typed values or the first reason of fault that applies.

    ``records`` has line_id, file_id, line_no and raw; other columns are ignored. Adds ``state`` (header,
    blank, loaded, rejected), ``reason`` (no_header, broken_quoting, column_count, unreadable, invalid_siret,
    invalid_date, invalid_amount; with rejected only), ``siret``, ``day``, ``amount`` and ``fields`` (all
    columns by name; with loaded only). Null and white-space records are blank. A file's header is its
    record of line_no 1 with the least line_id; without one, or without a file_id, its records are
    rejected as no_header. A repeated record is judged each time. Long records are read whole.

    Each worker writes its share of a file as a CSV file, one record a line behind its ordinal, and reads
    it with DuckDB; the errors of the reject tables, joined to the records by that ordinal, are the
    reasons. See read_records for what the reader lets pass. A file with more than
    ``piece`` records isn't gathered: its header goes to wherever its records are.
    """
    r = records.select("line_id", "file_id", "line_no", "raw")
    first = F.col("line_no") == 1
    files = r.where("file_id is not null").groupBy("file_id").agg(F.count("*").alias("n"), F.min_by(F.when(first, F.col("raw")), F.when(first, F.col("line_id"))).alias("header"))
    target = piece_rows(records.count(), piece)
    hot = F.broadcast(files.where(F.col("n") > target).select("file_id", F.col("header").alias("hot_header"), F.lit(True).alias("is_hot")))  # fewer than HOT_KEYS
    r = r.join(hot, "file_id", "left")
    cold = r.where("is_hot is null").join(files.select("file_id", "header"), "file_id", "left")
    both = cold.select("line_id", "file_id", "line_no", "raw", "header").unionByName(r.where("is_hot").select("line_id", "file_id", "line_no", "raw", F.col("hot_header").alias("header")))

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
        headers: dict = {}
        for pdf in batches:
            if len(headers) > 10_000:
                headers.clear()
            if len(pdf):
                yield split_batch(con, pdf, headers, with_fields)

    return both.mapInPandas(work, "line_id bigint, file_id bigint, line_no int, raw string, state string, reason string, siret string, day date, amount double, fields map<string,string>")
