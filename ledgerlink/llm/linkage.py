"""Extraction rows matched to establishments without a common key, with a confidence (problem 5)."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.llm.names import Vocabulary, folded, learned, name_words, with_words
from ledgerlink.session import cut

# Words of French addresses.
STREET_TYPES = "ALL ALLEE AV AVE AVENUE BD BLD BLVD BOULEVARD BVD CH CHEM CHEMIN CHE COURS CRS IMP IMPASSE PL PLACE Q QU QUAI R ROUTE RTE RUE SQ SQUARE".split()
STREET_WORDS = "A AU AUX D DE DES DU L LA LE LES".split()

#: Levels of agreement of each comparison, best first. The level "missing" says nothing for or against.
LEVELS = {
    "name": ["equal", "near", "alike", "missing", "other"],
    "label": ["equal", "missing", "other"],
    "postal": ["equal", "missing", "department", "other"],
    "city": ["equal", "near", "missing", "other"],
    "number": ["equal", "missing", "other"],
    "street": ["equal", "missing", "other"],
}
#: Share of a name's letters that may be edited in one that is still alike.
ALIKE = 0.32
#: A distance beyond all that are measured.
FAR = 10**9
#: Least confidence of a match.
CONFIDENCE = 0.5
NAME = "struct<label:string,glued:string,turned:string>"
FIELDS = f"names array<{NAME}>, postal string, department string, city string, number string, street string, keys array<bigint>"
#: Names of a unit that are held in one record; a unit with more has several records.
NAMES = 64


@lru_cache(maxsize=100_000)
def city_name(text: str | None) -> str:
    """A commune's name, glued: saints, sous and sur written out, without CEDEX, district or country."""
    t = re.sub(r"\bS/S[A-Z]?\b", " SOUS ", folded(text or ""))
    t = re.sub(r"(\bS)?/", " SUR ", t)
    t = re.sub(r"[^A-Z0-9]+", " ", t)
    t = re.sub(r"\bCEDEX\b.*$|\b\d+ ?(ER|E|EME) ?(ARR\w*)?\b|\bFRANCE\b|\bARRONDISSEMENT\b|\d+", " ", t)
    t = re.sub(r"\bSTE\b", "SAINTE", re.sub(r"\bST\b", "SAINT", t))
    return re.sub(r"\b(S)\b", "SUR", t).replace(" ", "")


@lru_cache(maxsize=100_000)
def street_name(text: str) -> str:
    """The words that tell streets of a commune apart, glued."""
    return "".join(w for w in re.findall(r"[A-Z]+", folded(text)) if w not in STREET_TYPES and w not in STREET_WORDS and len(w) > 1)


@lru_cache(maxsize=100_000)
def city_stem(place: str) -> str:
    """The first letters of a city_name behind its article."""
    return re.sub(r"^(SAINTE?|LES|LE|LA)", "", place)[:4]


def digits_of(text: str | None) -> str:
    return text if text and text.isascii() and text.isdigit() else re.sub(r"\D", "", text or "")


def street_parts(text: str | None, number: str | None = None) -> tuple[str, str]:
    """House number and street name, the number from the text if it isn't given."""
    digits = digits_of(number) or ((m := re.search(r"\d+", text or "")) and m[0]) or ""
    return digits.lstrip("0"), street_name(text or "")


@lru_cache(maxsize=100_000)
def name_keys(word: str, held: bool) -> list[str]:
    """Parts of a word of which two near words share one: both ends, and the middle, held as others may see it shifted by a letter."""
    n = len(word)
    middle = (n - 4) // 2
    return ["f" + word[:4], "l" + word[-4:], *("m" + word[k : k + 4] for k in range(max(0, middle - held), min(n - 4, middle + held) + 1) if n >= 7)]


def record(vocabulary: Vocabulary, names: list[str | None], postal: str | None, city: str | None, number: str | None, street: str | None, cedex: dict[str, str], held: bool) -> tuple:
    """FIELDS of one record, of the registry if ``held``; its keys are those of all blocking passes.

    A street with a number meets the same number, or none; one without a number meets all of that street.
    """
    digits = digits_of(postal)
    digits = cedex.get(digits, digits)
    place = city_name(city)
    no, way = street_parts(street, number)
    code = digits if len(digits) == 5 else ""
    department = digits[:2] if len(digits) in (2, 4, 5) else ""
    stem = city_stem(place)
    wide = [x for x in (f"d{department}" if department else "", f"t{stem}" if len(stem) == 4 else "") if x]
    narrow = [x for x in (f"p{code}" if code else "", f"c{place}" if place else "") if x]
    parsed = [x for n in names if (x := vocabulary.parsed(name_words(n)))]
    keys = set()
    for w in {w for _, words in parsed for w in words if len(w) >= 3}:
        keys.update([x + k for k in name_keys(w, held) for x in narrow])
        if len(w) >= 6:
            keys.update([x + k for k in ("f" + w[:6], "l" + w[-6:]) for x in wide])
    if way:
        ways = [f"{no} {way}", f"- {way}" if held else f"+ {way}"] if no else [f"- {way}", f"+ {way}"]
        keys.update(x + k for k in ways for x in narrow)
    spelt = {(label, "".join(words), "".join(words[::-1]) if len(words) > 1 else "") for label, words in parsed}
    return sorted(spelt), code, department, place, no, way, list(map(xxhash.xxh3_64_intdigest, keys))


def records(df: DataFrame, vocabulary: Vocabulary, cedex: dict[str, str], held: bool) -> DataFrame:
    """FIELDS for rows with ``id, names, postal, city, number, street``."""

    def lists(rows: list[list], values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gc.disable()  # nothing here makes cycles, and searches for them go through all that the worker remembers
            try:
                got = [record(vocabulary, *row, cedex, held) for row in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            finally:
                gc.enable()
            every = list(chain.from_iterable(g[0] for g in got))
            names = pa.StructArray.from_arrays([pa.array([n[k] for n in every], pa.string()) for k in range(3)], names=["label", "glued", "turned"])
            keys = pa.array(np.fromiter(chain.from_iterable(g[6] for g in got), dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists([g[0] for g in got], names), *(pa.array([g[k] for g in got], pa.string()) for k in range(1, 6)), lists([g[6] for g in got], keys)],
                names=["id", "names", "postal", "department", "city", "number", "street", "keys"],
            )

    return df.select("id", "names", "postal", "city", "number", "street").mapInArrow(work, f"id bigint, {FIELDS}")


def taught(asked: DataFrame, etab: DataFrame) -> Vocabulary:
    """The Vocabulary of the names asked for and of the units' legal names."""
    u = F.col("uniteLegale")
    legal = etab.select(F.coalesce(u["denominationUniteLegale"], F.concat_ws(" ", u["prenom1UniteLegale"], u["nomUniteLegale"])).alias("name")).distinct()
    every = asked.select("name").distinct().withColumn("registered", F.lit(False)).unionByName(legal.withColumn("registered", F.lit(True)))
    every = every.where("name is not null").withColumn("key", F.concat(F.col("registered").cast("string"), "name"))
    forms = with_words(every, "key", "name").groupBy("words").agg(F.max(F.startswith("key", F.lit("true"))).alias("registered")).withColumn("id", F.monotonically_increasing_id())
    return learned(cut(forms))


def registry_units(etab: DataFrame) -> DataFrame:
    """``siret, names, postal, city, number, street, head``: each address that any delivery gives a siret, with all names that the siret has there, and whether it was ever a head office."""
    u, a = F.col("uniteLegale"), F.col("adresseEtablissement")
    signs = ["enseigne1Etablissement", "enseigne2Etablissement", "enseigne3Etablissement", "denominationUsuelleEtablissement"]
    person = F.when(u["nomUniteLegale"].isNotNull(), F.concat_ws(" ", u["prenom1UniteLegale"], u["nomUniteLegale"]))
    names = [u["denominationUniteLegale"], *[u[f"denominationUsuelle{k}UniteLegale"] for k in (1, 2, 3)], person, *[F.col(s) for s in signs]]
    old = [F.coalesce(F.col("periodesEtablissement")[x], F.array().cast("array<string>")) for x in signs]
    every = F.filter(F.array_distinct(F.concat(F.array(*names), *old)), lambda n: F.trim(n) != "")
    place = ["siret", "postal", "city", "number", "street"]
    each = etab.where("siret is not null").select("siret", a["codePostalEtablissement"].alias("postal"), a["libelleCommuneEtablissement"].alias("city"), a["numeroVoieEtablissement"].alias("number"), a["libelleVoieEtablissement"].alias("street"), every.alias("names"), F.coalesce("etablissementSiege", F.lit(False)).alias("head"))
    each = each.select(*place, "head", F.explode_outer("names").alias("name")).groupBy(*place, "name").agg(F.max("head").alias("head"))
    counted = each.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(*place).orderBy("name")) - 1) / NAMES))
    return counted.groupBy(*place, "part").agg(F.collect_list("name").alias("names"), F.max("head").alias("head"))


def levels(x: str, y: str) -> list[Column]:
    """The level of each comparison of LEVELS, as its place in the list; with the name, its label and distance, of the nearest name."""
    a, b = lambda c: F.col(f"{x}.{c}"), lambda c: F.col(f"{y}.{c}")
    none = lambda c: (a(c) == "") | (b(c) == "")

    m = F.get(a("names"), 0)
    size = lambda n: F.greatest(F.length(m["glued"]), F.length(n["glued"]))
    off = lambda p, q, most: F.pmod(F.call_function("levenshtein", p, q, most), F.lit(FAR))  # noqa: E731  a distance beyond the most is -1
    turned = lambda p, q, most: F.when(p["turned"] == "", FAR).otherwise(off(p["turned"], q["glued"], most))

    def measured(n: Column) -> Column:
        most = F.floor(F.greatest(F.lit(3), ALIKE * size(n))).cast("int")
        far = F.abs(F.length(m["glued"]) - F.length(n["glued"])) > most
        distance = F.when(far, FAR).otherwise(F.least(off(m["glued"], n["glued"], most), turned(m, n, most), turned(n, m, most)))
        label = F.when((m["label"] == "") | (n["label"] == ""), 1).when(F.startswith(m["label"], n["label"]) | F.startswith(n["label"], m["label"]), 0).otherwise(2)
        return F.struct(distance.alias("off"), label.alias("label"), size(n).alias("size"))

    def graded(d: Column) -> Column:
        near = F.when(d["size"] <= 5, 1).when(d["size"] <= 8, 2).otherwise(3)
        name = F.when(d["off"] == 0, 0).when(d["off"] <= near, 1).when(d["off"] <= ALIKE * d["size"], 2).otherwise(4)
        return F.struct(name.alias("name"), d["label"].alias("label"), d["off"].alias("off"))

    nothing = F.struct(F.lit(3).alias("name"), F.lit(1).alias("label"), F.lit(FAR).alias("off"))
    nearest = F.when((F.size(a("names")) == 0) | (F.size(b("names")) == 0), nothing).otherwise(F.array_min(F.transform(F.transform(b("names"), measured), graded)))
    postal = F.when((a("department") == "") | (b("department") == ""), 1).when((a("postal") != "") & (a("postal") == b("postal")), 0).when(none("postal") & (a("department") == b("department")), 2).when((a("department") == b("department")) & (F.levenshtein(a("postal"), b("postal")) <= 1), 2).otherwise(3)
    short = F.least(F.length(a("city")), F.length(b("city")))
    near = (F.levenshtein(a("city"), b("city")) <= F.when(short >= 6, 2).otherwise(1)) | ((short >= 6) & (F.startswith(a("city"), b("city")) | F.startswith(b("city"), a("city"))))
    city = F.when(none("city"), 2).when(a("city") == b("city"), 0).when(near, 1).otherwise(3)
    number = F.when(none("number"), 1).when(a("number") == b("number"), 0).otherwise(2)
    street = F.when(none("street"), 1).when((F.levenshtein(a("street"), b("street")) <= 2), 0).otherwise(2)
    return [nearest.alias("nearest"), *(c.alias(n) for c, n in zip((postal, city, number, street), list(LEVELS)[2:]))]


def match_weights(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], tuple[float, float]]:
    """The probability that a pair of each pattern is a match, and its log odds, by expectation and maximisation over counts of patterns.

    Comparisons count as independent; a missing one weighs nothing. Starts from levels that fall
    geometrically from best to worst among matches, and rise among others.
    """
    if not patterns:
        return {}
    names = list(LEVELS)
    counts = np.array([n for _, n in patterns], dtype=float)
    at = np.array([p for p, _ in patterns])
    known = [[i for i, lv in enumerate(LEVELS[n]) if lv != "missing"] for n in names]
    m, u = [], []
    for k, n in enumerate(names):
        p = np.ones(len(LEVELS[n]))
        p[known[k]] = 0.25 ** np.arange(len(known[k]))
        q = np.ones(len(LEVELS[n]))
        q[known[k]] = 0.5 ** np.arange(len(known[k]))[::-1]
        m.append(p), u.append(q)
    share = 0.2
    for _ in range(rounds):
        for p in (*m, *u):
            k = known[next(i for i, x in enumerate((*m, *u)) if x is p) % len(names)]
            p[k] /= p[k].sum()
        odds = np.log(share / (1 - share)) + sum(np.log(m[k][at[:, k]]) - np.log(u[k][at[:, k]]) for k in range(len(names)))
        post = 1 / (1 + np.exp(-odds.clip(-60, 60)))
        share = float(np.clip((post * counts).sum() / counts.sum(), 1e-4, 0.9))
        for k in range(len(names)):
            for lv in known[k]:
                hit = at[:, k] == lv
                m[k][lv] = (post * counts)[hit].sum() + 0.01
                u[k][lv] = ((1 - post) * counts)[hit].sum() + 0.01
    return {p: (float(x), float(o)) for (p, _), x, o in zip(patterns, post, odds)}


def matched_establishments(extraction: DataFrame, etab: DataFrame, commune: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """``row_id, siret, confidence``: the establishment that each extraction row speaks of, once per ``row_id``.

    Rows that match nothing with ``least`` confidence, or whose city and postal code both lie elsewhere,
    or the only one of them that they give (unless street and number are the same), are left out; so are null row_ids, and units none of whose names is alike, be their address the same. Names are compared with all names that the siret ever had. Of equal
    odds the nearest name counts, then the head office, then the least siret. Rows of equal
    content are matched once, however many they are; null, empty and repeated values are fine, and extra
    columns are ignored.

    Blocking in several passes: ends and middle of a word of the name within postal code and commune; its
    ends within department or beginning of the commune's name; and equal streets, with equal numbers or where one has none. Keys
    are hashed, and two that fall together only add a pair. All pairs of all passes are compared; their counts by pattern, of
    which there are fewer than 4,000, reach the driver.
    """
    cedex = {r.code_cedex: r.code_postal for r in commune.where("code_cedex is not null").select("code_cedex", "code_postal").collect()}  # a fixed table of communes
    field = lambda k: F.col("fields").getItem(k)["value"]
    raw = extraction.where("row_id is not null").select("row_id", field("company_name_raw").alias("name"), field("postal_code").alias("postal"), field("city").alias("city"), F.lit(None).cast("string").alias("number"), field("address_fragment").alias("street"))
    raw = raw.groupBy("row_id").agg(F.min(F.struct("name", "postal", "city", "number", "street")).alias("x")).select("row_id", "x.*")
    content = ["name", "postal", "city", "number", "street"]
    asked = cut(raw.where("coalesce(name, street) is not null").select(*content).distinct().withColumn("id", F.monotonically_increasing_id()))
    vocabulary = taught(asked, etab)
    left = cut(records(asked.withColumn("names", F.array("name")), vocabulary, cedex, False))
    units = cut(registry_units(etab).withColumn("id", F.monotonically_increasing_id()))
    right = cut(records(units, vocabulary, cedex, True))

    keys = lambda df, name: df.select(F.col("id").alias(name), F.explode("keys").alias("key"))
    pairs = keys(left, "l").join(keys(right, "r"), "key").select("l", "r").distinct()
    compared = pairs.join(left.drop("keys").alias("x"), F.col("l") == F.col("x.id")).join(right.drop("keys").alias("y"), F.col("r") == F.col("y.id")).select("l", "r", *levels("x", "y"))
    at_door = (F.col("number") == 0) & (F.col("street") == 0)
    elsewhere = (F.col("postal") == 3) & (F.col("city") == 3) | ((F.col("postal") == 3) & (F.col("city") == 2) | (F.col("postal") == 1) & (F.col("city") == 3)) & ~at_door
    compared = cut(compared.where(~elsewhere & (F.col("nearest.name") < 4)).select("l", "r", "nearest.name", "nearest.label", "nearest.off", *list(LEVELS)[2:]))

    names = list(LEVELS)
    counted = [(tuple(r[n] for n in names), r["count"]) for r in compared.groupBy(*names).count().collect()]  # fewer than 4,000 patterns
    weights = match_weights(counted)
    table = compared.sparkSession.createDataFrame([(*p, *x) for p, x in weights.items()], ", ".join(f"{n} int" for n in names) + ", confidence double, odds double")
    scored = compared.join(F.broadcast(table), names).where(F.col("confidence") >= least)
    scored = scored.join(units.select(F.col("id").alias("r"), "siret", "head"), "r").select("l", "siret", F.struct("odds", (-F.col("off")).alias("off"), "head", "confidence").alias("best"))
    first = Window.partitionBy("l").orderBy(F.col("best.odds").desc(), F.col("best.off").desc(), F.col("best.head").desc(), "siret")
    chosen = scored.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("l").alias("id"), "siret", F.col("best.confidence").alias("confidence"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in content]
    return raw.alias("r").join(asked.alias("a"), same).select("r.row_id", "a.id").join(chosen, "id").select("row_id", "siret", "confidence")
