"""Nested JSON records as flat, linked tables, found by structural indexing (problem 4)."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of bodies that are indexed at a time, and of texts given back at a time; a longer body is indexed alone.
BLOCK_BYTES = 1_000_000
CHILDREN = ["uniteLegale", "adresseEtablissement", "adresse2Etablissement", "periodesEtablissement"]
QUOTE, SLASH, COLON, COMMA = b'"'[0], b"\\"[0], b":"[0], b","[0]
_KIND = np.zeros(256, dtype=np.int8)  # 1 opens, -1 closes, 2 other structure
for _b, _k in ((b"{[", 1), (b"}]", -1), (b'":,', 2)):
    _KIND[list(_b)] = _k


@dataclass
class Index:
    """What the bitmaps give: structural bytes in order, and one node for each bracket pair."""

    pos: np.ndarray  # place of each structural byte
    byte: np.ndarray
    depth: np.ndarray  # nesting depth after it
    open: np.ndarray  # of each node: which structural byte opens it,
    close: np.ndarray  # and which closes it (-1: none),
    level: np.ndarray  # its depth, from 1,
    parent: np.ndarray  # the node around it (-1: none),
    place: np.ndarray  # and how many commas of that node stand before it


#: Levels that are told apart: envelope, array, establishment, children and their elements; what is deeper is text.
DEEPEST = 6


def structural_index(buf: np.ndarray, starts: np.ndarray) -> Index:
    """Indexes bodies that follow each other in ``buf`` and are each ended by a line break."""
    pos = np.flatnonzero(_KIND[buf])
    byte = buf[pos]
    quote = byte == QUOTE
    if (slashes := np.flatnonzero(buf == SLASH)).size:  # a quote after an odd run of backslashes is text
        new_run = np.diff(slashes, prepend=-2) != 1
        first = slashes[new_run][np.cumsum(new_run) - 1]
        at = np.searchsorted(slashes, pos - 1).clip(max=slashes.size - 1)
        escaped = quote & (slashes[at] == pos - 1) & ((pos - first[at]) % 2 == 1)
        pos, byte, quote = pos[~escaped], byte[~escaped], quote[~escaped]
    body = np.searchsorted(starts, pos, side="right") - 1
    begins = np.searchsorted(pos, starts)
    before = np.concatenate([[0], np.cumsum(quote)])
    inside = (before[:-1] - before[begins[body]]) % 2 == 1  # a string is open before this byte
    keep = quote | ~inside
    pos, byte, body = pos[keep], byte[keep], body[keep]
    step = np.where(np.abs(_KIND[byte]) == 1, _KIND[byte], 0).astype(np.int32)
    begins = np.searchsorted(pos, starts)
    total = np.concatenate([[0], np.cumsum(step)])
    depth = total[1:] - total[begins[body]] if pos.size else total[1:]

    opens, closes = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    level = depth[opens]
    close, parent, place = (np.full(opens.size, -1, dtype=np.int64) for _ in range(3))
    place[:] = 0
    close_level, commas = depth[closes] + 1, np.flatnonzero(byte == COMMA)
    comma_depth = depth[commas]
    for lv in range(1, min(DEEPEST, int(level.max(initial=0))) + 1):
        mine = np.flatnonzero(level == lv)
        ends = closes[close_level == lv]
        at = np.searchsorted(ends, opens[mine])
        ok = at < ends.size
        close[mine[ok]] = ends[at[ok]]
        close[mine[ok & (body[close[mine]] != body[opens[mine]])]] = -1
        if lv > 1:
            above = np.flatnonzero(level == lv - 1)
            up = np.searchsorted(opens[above], opens[mine]) - 1
            ok = (up >= 0) & (body[opens[above[up]]] == body[opens[mine]])
            parent[mine[ok]] = above[up[ok]]
            here = commas[comma_depth == lv - 1]
            place[mine] = np.searchsorted(here, opens[mine]) - np.searchsorted(here, opens[parent[mine]])
    return Index(pos, byte, depth, opens, close, level, parent, place)


def key_of(ix: Index, buf: np.ndarray, k: int) -> str | None:
    """The key of the value that follows structural byte ``k - 1``, if that is a colon."""
    if k < 3 or ix.byte[k - 1] != COLON or ix.byte[k - 2] != QUOTE:
        return None
    text = buf[ix.pos[k - 3] + 1 : ix.pos[k - 2]].tobytes().decode("utf-8", "replace")
    if "\\" in text:
        try:
            text = json.loads(f'"{text}"')
        except ValueError:
            return None
    return text


def valid(body: str) -> bool:
    """The exact check: whether the whole body is JSON. Where it nests too deep to tell, balanced brackets suffice."""

    def no(name: str):
        raise ValueError(name)

    try:
        json.loads(body, parse_constant=no)
    except RecursionError:
        return True
    except ValueError:
        return False
    return True


def establishments(bodies: list[str], wanted: Sequence[str] = ("etablissement", *CHILDREN), with_json: bool = True) -> Iterator[tuple[int, int, str | None, str, int, str | None]]:
    """Body number, place of the establishment, siret, child, place of the child, and the child's JSON text, if asked for.

    The establishment itself comes as the child ``etablissement``. Only the ``wanted`` children come.
    """
    raw = [b.encode("utf-8", "surrogatepass") for b in bodies]
    buf = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    starts = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
    ix = structural_index(buf, starts)
    node_at = np.full(ix.pos.size + 1, -1, dtype=np.int64)
    node_at[ix.open] = np.arange(ix.open.size)
    is_object = ix.byte[ix.open] == b"{"[0]
    below: dict[int, list[int]] = {}
    for n in np.flatnonzero(ix.parent >= 0):
        if ix.level[n] <= 5:
            below.setdefault(int(ix.parent[n]), []).append(int(n))
    text = lambda n: None if not with_json else buf[ix.pos[ix.open[n]] : ix.pos[ix.close[n]] + 1].tobytes().decode("utf-8", "surrogatepass")

    def members(n: int) -> dict[str, int]:
        return {k: m for m in below.get(n, []) if (k := key_of(ix, buf, int(ix.open[m]))) is not None}  # of a key given twice, the last

    def objects(n: int) -> list[tuple[int, int]]:
        return [(0, n)] if is_object[n] else [(int(ix.place[m]), m) for m in below.get(n, []) if is_object[m]]

    sirets: dict[int, str] = {}
    colons = np.flatnonzero(ix.byte == COLON)
    colons = colons[colons >= 2]
    colons = colons[(ix.pos[colons - 1] - ix.pos[colons - 2] == 6) & (ix.byte[colons - 1] == QUOTE)]
    at = ix.pos[colons - 2][:, None] + np.arange(1, 6)
    colons = colons[(buf[at] == np.frombuffer(b"siret", dtype=np.uint8)).all(axis=1)] if colons.size else colons
    opener = np.full(ix.pos.size, -1, dtype=np.int64)
    for lv in (2, 3):
        mine = np.flatnonzero(ix.level == lv)
        here = colons[ix.depth[colons] == lv]
        if mine.size and here.size:
            opener[here] = mine[(np.searchsorted(ix.open[mine], here) - 1).clip(min=0)]
            for c in here:
                end = c + 2 if ix.byte[c + 1] == QUOTE else c + 1
                value = buf[ix.pos[c] + 1 : ix.pos[end] + (ix.byte[c + 1] == QUOTE)].tobytes().decode("utf-8", "replace").strip()
                try:
                    value = json.loads(value)
                except ValueError:
                    value = None
                sirets[int(opener[c])] = None if value is None else value if isinstance(value, str) else json.dumps(value)

    roots = np.flatnonzero((ix.level == 1) & is_object & (ix.close >= 0))
    body_of = np.searchsorted(starts, ix.pos[ix.open[roots]], side="right") - 1
    for root, b in zip(roots.tolist(), body_of.tolist()):
        top = members(root)
        holder = top.get("etablissements", top.get("etablissement"))
        if holder is None or not valid(bodies[b]):
            continue
        for place, etab in objects(holder):
            siret = sirets.get(etab)
            if "etablissement" in wanted:
                yield b, place, siret, "etablissement", 0, text(etab)
            inner = members(etab)
            for child in CHILDREN:
                if child in inner and child in wanted:
                    for k, node in objects(inner[child]):
                        yield b, place, siret, child, k, text(node)


def linked_rows(pages: DataFrame, wanted: Sequence[str] = ("etablissement", *CHILDREN), with_json: bool = True) -> DataFrame:
    """One row per establishment and child object of each page: ``page_id, etab_idx, siret, child, child_idx, json``.

    (page_id, etab_idx) ties a child to its establishment, the row whose child is ``etablissement``; null
    elements of an array keep their place but give no row, and so do null, absent and scalar children.
    Null, empty and invalid bodies and error answers give none. Repeated pages are read each time. Extra
    columns are ignored. No row leaves its partition, so that hot or very long pages need no shuffle. Only
    the ``wanted`` children come, and ``json`` is null unless ``with_json``. A worker holds one block of bodies
    as text, not the whole batch.
    """
    wanted = tuple(wanted)

    def batch_of(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[r[0]] for r in rows], pa.int64()), *(pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()), (4, pa.int32()), (5, pa.string())))],
            names=["page_id", "etab_idx", "siret", "child", "child_idx", "json"],
        )

    def block_rows(ids: list, bodies: list[str]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in establishments(bodies, wanted, with_json):
            rows.append(row)
            held += 100 + len(row[5] or "")
            if held > BLOCK_BYTES:
                yield batch_of(ids, rows)
                rows, held = [], 0
        yield batch_of(ids, rows)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.fill_null(pc.binary_length(batch.column(1)), 0), 0))
            ids, sizes = batch.column(0).to_pylist(), pc.binary_length(batch.column(1)).to_pylist()
            first, used = 0, 0
            for i, size in [*enumerate(sizes), (len(sizes), BLOCK_BYTES)]:
                if i > first and used + size > BLOCK_BYTES:
                    yield from block_rows(ids[first:i], batch.column(1).slice(first, i - first).to_pylist())
                    first, used = i, 0
                used += size

    return pages.select("page_id", "body").mapInArrow(work, "page_id bigint, etab_idx int, siret string, child string, child_idx int, json string")


ADDRESS = "complementAdresseEtablissement string, numeroVoieEtablissement string, typeVoieEtablissement string, libelleVoieEtablissement string, codePostalEtablissement string, libelleCommuneEtablissement string, codeCommuneEtablissement string"
#: Columns of the flat tables; whatever type a value had, it is text here.
TABLES = {
    "etablissement": "siren string, nic string, etablissementSiege string, etatAdministratifEtablissement string, dateCreationEtablissement string, trancheEffectifsEtablissement string, dateDernierTraitementEtablissement string, enseigne1Etablissement string, enseigne2Etablissement string, enseigne3Etablissement string, denominationUsuelleEtablissement string",
    "uniteLegale": "siren string, denominationUniteLegale string, denominationUsuelle1UniteLegale string, denominationUsuelle2UniteLegale string, denominationUsuelle3UniteLegale string, nomUniteLegale string, prenom1UniteLegale string, categorieJuridiqueUniteLegale string, etatAdministratifUniteLegale string",
    "adresseEtablissement": ADDRESS,
    "adresse2Etablissement": ADDRESS,
    "periodesEtablissement": "dateDebut string, dateFin string, etatAdministratifEtablissement string, enseigne1Etablissement string, enseigne2Etablissement string, enseigne3Etablissement string, denominationUsuelleEtablissement string, activitePrincipaleEtablissement string",
}


def flat_table(rows: DataFrame, child: str) -> DataFrame:
    """One of TABLES from ``linked_rows``, keyed by (page_id, etab_idx, child_idx)."""
    fields = F.from_json("json", TABLES[child])
    keys = ["page_id", "etab_idx", "siret"] if child == "etablissement" else ["page_id", "etab_idx", "siret", "child_idx"]
    return rows.where(F.col("child") == child).select(*keys, fields.alias("f")).select(*keys, "f.*")
