"""Queries and searches that must do all of their job, against brute force."""

import itertools
import random
import re

import __spark_entry__
from ledgerlink.operators import registry as R

SF = "/root/testdata/sf0.001"
SCHEMA = "siret string, etablissementSiege boolean, uniteLegale struct<denominationUniteLegale:string>, adresseEtablissement struct<codePostalEtablissement:string,libelleCommuneEtablissement:string>, periodesEtablissement array<struct<enseigne1Etablissement:string,denominationUsuelleEtablissement:string>>"


def brute_tiers(asked, registry):
    split = lambda t: [w for w in re.split("[^A-Z0-9]+", (t or "").upper()) if w]
    begin = lambda words, of: all(any(t.startswith(w) for t in split(of)) for w in words)
    out = []
    for i, name, postal, city in asked:
        words = [w for w in split(name) if len(w) > 1]
        named = [x for x in registry if words and any(begin(words, f) for f in [x[2][0], *(f for p in x[4] or [] for f in p or [])])]
        near = [x for x in named if postal and x[3][0] == postal or split(city) and begin(split(city), x[3][1])]
        mover = [x for x in named if postal and (x[3][0] or "")[:2] == postal[:2]]
        for k, found, cap in ((2, near, 20), (3, mover, 50), (5, [x for x in named if x[1]], 20)):
            if found:
                out += [(i, s, rank, k) for rank, s in enumerate(sorted(x[0] for x in found)[:cap], 1)]
                break
    return sorted(out)


def test_tiers_equal_brute_force(spark):
    rng = random.Random(7)
    words, towns = ["GARAGE", "GARAGES", "DU", "LAC", "BLEU", "A", "TRANSPORTS"], ["LYON", "SAINT LOUP", "SAINT-LOUP SUR MER", "SAINTES", None]
    name = lambda: " ".join(rng.choices(words, k=rng.randint(1, 2))) if rng.random() < 0.6 else None
    registry = [(f"{k:014}", rng.random() < 0.3, (name(),), (rng.choice(["69001", "69002", "17100", None]), rng.choice(towns)), rng.choice([None, [], [None], [(name(), name()), (name(), name())]])) for k in range(400)]
    asked = [(f"r{k}", *x) for k, x in enumerate(itertools.product(["garage", "garage lac", "du bleu", "A", "transports lac bleu", None], ["69001", "17999", "75001", "", None], ["lyon", "saint", "saint-loup", "S", "Nulle part", None]))]
    got = R.tiers(spark.createDataFrame(asked, "id string, name string, postal string, city string"), spark.createDataFrame(registry, SCHEMA))
    want = brute_tiers(asked, registry)
    assert {x[3] for x in want} == {2, 3, 5}
    assert sorted((r.id, r.siret, r["rank"], r.tier) for r in got.collect()) == want


def test_upload_rows_have_their_record_and_all_columns(spark):
    rows = __spark_entry__.queries()["p2_rows"](spark, SF).collect()
    loaded = [r for r in rows if r.state == "loaded"]
    assert loaded and all({"FR_SIRET", "Transaction_Date", "Amount", "Supplier"} <= set(r.fields) for r in loaded)
    assert all(r.raw and r.fields is None for r in rows if r.state == "rejected")
