"""Operators of the llm subpackage against brute force, exact round trips and small cases."""

import base64
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlink.llm import linkage, names, packing, quality, tokens

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FILE = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


WORDS = tokens.WordIds(tokens.BytePairs(FILE))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aesL'tdmrlv \n\t 1é<|>"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4))
def test_ids_equal_the_library(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))} if not hasattr(test_ids_equal_the_library, "enc") else None
    if ranks:
        test_ids_equal_the_library.enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    counts, ids = tokens.encode_block(texts, WORDS)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [test_ids_equal_the_library.enc.encode_ordinary(t) for t in texts]


def test_token_ids_of_nulls_repeats_and_long_texts(spark, library):
    long = "ab cd'll 123 " * 20_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|>"), (4, long), (4, long), (None, "x")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in tokens.token_ids(df).collect()), key=lambda x: (x[0], len(x[1])))
    assert got == [(0, library.encode_ordinary("x")), (1, []), (2, []), (3, library.encode_ordinary("<|endoftext|>")), (4, library.encode_ordinary(long)), (4, library.encode_ordinary(long))]
    assert tokens.token_ids(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_holds_every_item_and_no_container_too_much(histogram):
    load, count = {}, dict.fromkeys(histogram, 0)
    rows = sorted(packing.plan(histogram, 64))
    for k, (size, first, container, each) in enumerate(rows):
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == size else histogram[size]
        assert first == count[size]
        for i in range(first, end):
            c = container + (i - first) // each
            load[c] = load.get(c, 0) + size
        count[size] = end
    assert count == histogram and max(load.values(), default=0) <= 64


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), min_size=1, max_size=40))
def test_patterns_never_cost_a_container(histogram):
    used = lambda rows: 1 + max(first + (n - 1) // each for (size, item, first, each), n in zip(rows, runs(rows)))

    def runs(rows):
        for size, item, _, _ in rows:
            later = [i for s, i, _, _ in rows if s == size and i > item]
            yield min(later, default=histogram[size]) - item

    assert used(packing.plan(histogram, 64)) <= used(packing.plan(histogram, 64, (0.0,)))


def test_least_squares():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert packing.non_negative_least_squares(a, np.array([2.0, 3.0])) @ a.T == pytest.approx([2, 3])
    assert (packing.non_negative_least_squares(a, np.array([-1.0, 3.0])) >= 0).all()


def test_packed_documents(spark):
    docs = spark.createDataFrame([(i, "mot " * (i % 50)) for i in range(300)] + [(900, "mot " * 5000), (901, None)], "doc_id bigint, text string")
    packs = spark.createDataFrame([(1, "byte_bpe_50k", 100), (2, "piece_bpe_32k", 64), (3, None, 5), (4, "byte_bpe_50k", 0)], "pack_id int, tokenizer string, capacity int")
    got = packing.packed_documents(docs, packs)
    full = got.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("pack_id").agg(F.max("n").alias("m")).collect()
    assert {r.pack_id: r.m for r in full} == {1: 100, 2: 64}
    rows = got.where("pack_id = 1").collect()
    assert len({r.doc_id for r in rows}) == 302 and all(r.piece == 0 for r in rows if r.doc_id < 900)
    assert sum(r.n_tokens for r in rows if r.doc_id == 900) == tokens.counter("byte_bpe_50k", tokens.TOKENIZERS)(["mot " * 5000])[0]


def test_names():
    roles = {w: r for r, all_ in {"BOULANGERIE": "BOULANGERIE BLGE", "CABINET": "CABINET CBT", "AGENCE": "AGENCE AG", "ALEXANDRE": "ALEXANDRE SACHA", "JEAN": "JEAN PIERRE JP"}.items() for w in all_.split()}
    vocabulary = names.Vocabulary(roles, frozenset(["COMPTA"]))
    parsed = lambda x: vocabulary.parsed(names.name_words(x))
    same = [("BOULANGERIE ZEBRAR-GUCLEX", "boulangerie zebrar et guclx sas"), ("ALEXANDRE VECHORFLETRARS", "alex vechorfletrars COMPTA"), ("ALEXANDRE VECHORFLETRARS", "Sacha Vechorfletrars - AGENCE"), ("CABINET VUSAIBEGRART", "Cbt Vusaibegrart (Sasu)"), ("AGENCE DREZUDECAN", "Ag.\xa0Drezu Decan"), ("BOULANGERIE TROFANCEL", "boulangreie trofancel"), ("JEAN-PIERRE ROCHOR", "J.P. Rochor")]
    for a, b in same:
        x, y = parsed(a), parsed(b)
        assert x[0].startswith(y[0]) and names.edits("".join(x[1]), "".join(y[1]), 4) <= 2, (a, b)
    assert parsed("BCZ - Cavrin Zelart")[1] == parsed("BOULANGERIE CAVRIN ZELART (BCZ)")[1]
    assert [parsed(x) for x in (None, "", "-", "divers fournisseurs", "N/A", "Monsieur")] == [None] * 6
    assert names.edits("abcd", "abdc", 3) == 1 and names.edits("abc", "xyz", 2) == 3


def proper(k: int) -> str:
    """A name of its own for each number."""
    return "".join("BA CE DI FO GU LA ME NI RO TU".split()[int(d)] for d in f"{k * 7919 % 100_000:05}")


def test_roles_and_their_spellings_are_learned(spark):
    roles = "GARAGE MENUISERIE ZOLTANE PEPINIERES".split()  # one of them no known word: nothing but the names teaches it
    rows = [(f"{roles[k % 4]} {proper(k)}", True) for k in range(40)]
    rows += [(f"{'GGE MEN ZTN PEP'.split()[k % 4]} {proper(k)}", False) for k in range(40)] + [(f"{roles[k % 4]} {proper(k)} COMPTA", False) for k in range(20)]
    forms = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, words string, registered boolean")
    got = names.learned(forms)
    assert got.roles == dict(zip(roles, roles)) | dict(zip("GGE MEN ZTN PEP".split(), roles)) and got.remarks == {"COMPTA"}
    assert names.learned(forms.limit(0)) == names.Vocabulary()


def test_similarity_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice("BA CE DI FO GU".split(), 4)) for _ in range(12)]
    words += [w[:i] + "X" + w[i + 1 :] for w in words for i in (2, 5)]
    rows = [(i, ["GARAGE", "CABINET", "G", ""][i % 4], [w] if i % 3 else [w[:4], w[4:]], None) for i, w in enumerate(words)]
    classes = spark.createDataFrame(rows, "id bigint, label string, proper array<string>, siren string")
    vectors = {}
    for r in names.gram_vectors(classes).collect():
        vectors.setdefault(r.id, {})[r.gram] = r.weight
    want = set()
    for (a, la, pa_, _), (b, lb, pb, _) in itertools.combinations(rows, 2):
        open_ = len(la) <= 1 or len(lb) <= 1
        cosine = sum(w * vectors[b].get(g, 0) for g, w in vectors[a].items())
        x, y = "".join(pa_), "".join(pb)
        most = max(1, (max(len(x), len(y)) + 1) // 3)
        plain = lambda s, t: names.edits(s, t, most) <= most
        near = plain(x, y) or plain(x, "".join(pb[::-1])) or plain("".join(sorted(pa_)), "".join(sorted(pb)))
        if (la.startswith(lb) or lb.startswith(la)) and near and cosine >= (0.45 if open_ else 0.2):
            want.add((a, b))
    for piece in (3, 10**6):
        assert {(r.a, r.b) for r in names.similar_spellings(classes, 0.2, 0.45, piece).collect()} == want


def test_cheap_tests_of_spellings_come_first_and_drop_no_partner(spark, monkeypatch):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("AABCDEIKNRTX"), rng.integers(4, 14))) for _ in range(60)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", names.letter_bits("w")).collect()
    for (x, p), (y, q) in itertools.combinations(rows, 2):
        assert max((p & ~q).bit_count(), (q & ~p).bit_count()) <= names.edits(x, y, 99)
    plans, cut = [], names.cut
    monkeypatch.setattr(names, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    classes = spark.createDataFrame([(i, "GARAGE" if i % 3 else "", [w]) for i, w in enumerate(words)], "id bigint, label string, proper array<string>").withColumn("siren", F.lit(None).cast("string"))
    names.similar_spellings(classes).count()
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "levenshtein" in line]
    assert joins and all("much" in line and -1 < line.find("bit_count") < line.find("levenshtein") for line in joins)


def brute_linkage(weights, edges, least):
    groups = {i: [i] for i in weights}
    sim = {frozenset(e[:2]): e[2] for e in edges}
    while True:
        best = max(((sum(sim.get(frozenset((x, y)), 0) * weights[x] * weights[y] for x in groups[a] for y in groups[b]) / (sum(weights[x] for x in groups[a]) * sum(weights[y] for y in groups[b])), -a, -b) for a, b in itertools.combinations(groups, 2)), default=(0, 0, 0))
        if best[0] < least:
            return {x: min(g) for g in groups.values() for x in g}
        groups[-best[1]] += groups.pop(-best[2])


def test_average_linkage_equals_one_merge_at_a_time(spark):
    rng = np.random.default_rng(3)
    weights = {i: int(rng.integers(1, 4)) for i in range(14)}
    edges = [(a, b, round(float(rng.random()), 6)) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.4]
    got = names.average_linkage(spark.createDataFrame(list(weights.items()), "id bigint, weight bigint"), spark.createDataFrame(edges, "a bigint, b bigint, s double"), 0.3)
    assert {r.id: r.cluster for r in got.collect()} == brute_linkage(weights, edges, 0.3)


def test_entity_pairs(spark):
    known = [(100 + k, f"{'AGENCE CLINIQUE BENJAMIN ANTOINE'.split()[k % 4]} {proper(k)}", f"{k:09}") for k in range(24)] + [(200 + k, f"{'AG CLIN BENJI TONIO'.split()[k % 4]} {proper(k)}", None) for k in range(24)]
    typed = [(1, "AGENCE CIFLOU JUBARD"), (2, "ag. ciflou & jubad"), (3, "AGENCE CIFLOU SORTRANT"), (4, "CLINIQUE CIFLOU JUBARD"), (5, "-"), (6, None), (7, "AGENCE CIFLOU JUBARD"), (8, "BENJAMIN PASARCOFLET"), (9, "Benji Pasarcoflet"), (9, "Benji Pasarcoflet"), (10, "ANTOINE PASARCOFLET"), (11, "JUBARD-CIFLOU AGENCE"), (None, "AGENCE CIFLOU JUBARD")]
    df = spark.createDataFrame([*((*t, None) for t in typed), *known], "entry_id bigint, company_name_raw string, siren string").withColumns({"label": F.lit("clash"), "words": F.lit("clash")})
    got = sorted(tuple(r) for r in names.entity_pairs(df).collect())
    assert [p for p in got if p[0] < 100] == [*((a, b) for a, b in itertools.combinations((1, 2, 7, 11), 2)), (8, 9)]
    assert [p for p in got if p[0] >= 100] == [(100 + k, 200 + k) for k in range(24)]
    assert names.entity_pairs(df.limit(0)).count() == 0


def test_near_words_share_a_key():
    rng = np.random.default_rng(7)
    for _ in range(300):
        word = "".join(rng.choice(list("ABCDEFGHILMNOPRSTU"), int(rng.integers(8, 14))))
        i = int(rng.integers(0, len(word)))
        other = word[:i] + str(rng.choice(["", "X", word[i] + "X"])) + word[i + 1 :]
        assert set(linkage.name_keys(word, True)) & set(linkage.name_keys(other, False)), (word, other)


def test_roles_are_found_as_by_trying_each():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("ABCDE34"), rng.integers(3, 9)))
    vocabulary = names.Vocabulary({w: w[:4] for w in (word() for _ in range(150))})
    for w in [*vocabulary.roles, *(word() for _ in range(400))]:
        begin = {r for x, r in vocabulary.roles.items() if x.startswith(w)}
        assert vocabulary.short_role(w) == (begin.pop() if len(begin) == 1 else None)
        most = 2 if len(w) >= 7 else 1 if len(w) >= 5 else 0
        best = min(((d, x) for x in vocabulary.roles if most and (d := names.edits(w, x, most)) <= most), default=None)
        assert vocabulary.near_role(w) == (vocabulary.roles[best[1]] if best else None)


def test_linkage_letters_and_bounded_distances(spark):
    words = ["ABBCCCDZ", "", "A3B", "EAEAEAEA", "X" * 70]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", names.letter_bits("w").alias("bits")).collect()
    assert [names.letters_of(r.w) for r in got] == [r.bits for r in got]
    name = "array<struct<label:string,glued:string,turned:string>>"
    pair = spark.createDataFrame([([("", "ABCDEFGHIJKL", "")], [("", a, b) for a, b in held]) for held in ([("ABCXEFGXIJKL", "")], [("XXXXXXXXXXXX", ""), ("GHIJKLABCDEF", "ABCDEFGHIJKL")], [("XXXXXXGHIJKL", "")], [])], f"a {name}, b {name}")
    rest = {c: F.lit("") for c in ("postal", "department", "city", "number", "street")}
    x, y = (pair.select(F.monotonically_increasing_id().alias("id"), F.col(c).alias("names")).withColumns(rest) for c in "ab")
    graded = x.alias("x").join(y.alias("y"), F.col("x.id") == F.col("y.id")).select("x.id", linkage.levels("x", "y")[0])
    assert [tuple(r.nearest)[:2] for r in graded.orderBy("id").collect()] == [(1, 1), (0, 1), (4, 1), (3, 1)]


def test_linkage_words_and_weights():
    assert linkage.city_name("St. Liigny Cedex 2") == linkage.city_name("SAINT-LIIGNY") == "SAINTLIIGNY"
    assert linkage.city_name("TAAC S/S PAIPLOR") == linkage.city_name("Taac-sous-Paiplor") and linkage.city_name("Neley/Nelje") == linkage.city_name("NELEY-SUR-NELJE")
    assert linkage.street_parts("56 rte du belvedere") == ("56", "BELVEDERE")
    counts = [((0, 0, 0, 0, 1, 1), 90), ((4, 2, 0, 0, 1, 1), 800), ((4, 0, 3, 0, 2, 2), 300), ((0, 0, 0, 1, 0, 0), 40)]
    w = linkage.match_weights(counts)
    assert w[counts[0][0]][0] > 0.9 and w[counts[3][0]][0] > 0.9 and w[counts[1][0]][0] < 0.1 and w[counts[2][0]][0] < 0.1
    assert w[counts[3][0]][1] > w[counts[2][0]][1]
    assert linkage.match_weights([]) == {}


def test_quality_kinds(spark):
    prose = "Le service achats a confirmé le relevé de compte sur le bon de commande, et il faudra donc reprendre le rapprochement. "
    docs = [(i, prose * (1 + i % 4)) for i in range(60)]
    docs += [(100, "\n".join(f"- Garage Dalou {i}" for i in range(12))), (101, "\n".join(f"nom;ville;{i}.5" for i in range(12))), (102, "qsdf wxwx mmlk " * 30), (103, ""), (104, None), (105, " \n"), (106, "x" * 300_000), (0, prose)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    common = spark.createDataFrame([("fr", w) for w in "le la les de du et il a sur un une en donc".split()], "lang string, word string")
    got = quality.text_quality(df, common)
    kinds = {r.doc_id: r.kind for r in got.collect()}
    assert (kinds[100], kinds[101], kinds[102], kinds[106]) == ("list", "table", "junk", "junk")
    assert [kinds[i] for i in (103, 104, 105)] == [None] * 3 and {kinds[i] for i in range(60)} == {"prose"}
    r = got.where("doc_id = 100").first()
    assert sum(r.contributions.values()) == pytest.approx(r.distance)
    assert quality.text_quality(df.limit(0), common).count() == 0


def test_quality_measures_repetition_in_the_whole_text():
    common = {"fr": frozenset("le la de".split())}
    usual = " ".join("le mot" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(100)) + " "


    def kind(t):
        stats = dict(zip(quality.STATS, quality.text_stats(t, common)[1]))
        shape = quality.in_logs([np.array([float(stats[c])]) for c in quality.SHAPE])
        return quality.SEEDS[quality.nearest_centre(shape, quality.seeds())[0]][0]

    late, early = usual + "le la " * 500, "le la " * 100 + usual * 10
    assert (kind(late), kind(early), kind("le la " * 500), kind(usual * 10)) == ("junk", "prose", "junk", "prose")
    share = lambda t: quality.text_stats(t, common)[1][quality.STATS.index("distinct_share")]
    assert share(usual * 10) == pytest.approx(share(usual)) and share(late) < 0.2 < 0.4 < share(early)


def test_a_rare_language_leans_on_all_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "fr" if i % 20 else "de", *(float(x) for x in rng.normal(5, 1, len(quality.STATS)))) for i in range(400)]
    stats = spark.createDataFrame(rows, "doc_id bigint, language string, " + ", ".join(f"{c} double" for c in quality.STATS))
    models = quality.prose_models(stats, ["de", "es", "fr"])
    shape = rng.normal(5, 1, (6, len(quality.SHAPE)))
    share = quality.contributions(shape, ["fr", "de", "es", None, "xx", "fr"], models)
    for k, lang in enumerate(["fr", "de", "es", None, None, "fr"]):
        mean, inverse = models[lang]
        assert share[k].sum() == pytest.approx((shape[k] - mean) @ inverse @ (shape[k] - mean))
    assert np.allclose(models["es"][1], models[None][1]) and not np.allclose(models["de"][0], models[None][0])
    assert quality.prose_models(stats.limit(0), ["de"]) == {}


def test_extraction_match(spark):
    unit = "struct<denominationUniteLegale:string,denominationUsuelle1UniteLegale:string,denominationUsuelle2UniteLegale:string,denominationUsuelle3UniteLegale:string,nomUniteLegale:string,prenom1UniteLegale:string>"
    place = "struct<numeroVoieEtablissement:string,libelleVoieEtablissement:string,codePostalEtablissement:string,libelleCommuneEtablissement:string>"
    sign = "enseigne1Etablissement:string,enseigne2Etablissement:string,enseigne3Etablissement:string,denominationUsuelleEtablissement:string"
    schema = f"siret string, uniteLegale {unit}, adresseEtablissement {place}, periodesEtablissement array<struct<{sign}>>, etablissementSiege boolean, {sign.replace(':', ' ')}"
    etab = [(f"{i:014}", (f"GARAGE {w}", None, None, None, None, None), (str(i), "DES LILAS", f"{75001 + i % 7}", f"VILLE{'ABCDEFG'[i % 7]}OURG"), None, True, None, None, None, None) for i, w in enumerate("BRIMANOU CORDELAT FLUVARIN GASTOMIR HELVANOR JORMICAL KASPILON LUDROVAN".split())]
    field = lambda v: (v, v, 0.9)
    rows = [(f"r{i}", {"company_name_raw": field(n), "postal_code": field(p), "city": field(c), "address_fragment": field(None)}) for i, (n, p, c) in enumerate([("Gge Brimanou", "75001", "villeaourg"), ("GARAGE CORDELAT", "13000", "AILLEURS"), (None, None, None), ("garage fluvarn", "75003", None)])]
    x = spark.createDataFrame([*rows, rows[0]], "row_id string, fields map<string,struct<value:string,evidence_text:string,confidence:double>>")
    commune = spark.createDataFrame([("75001", None)], "code_postal string, code_cedex string")
    got = {r.row_id: r.siret for r in linkage.matched_establishments(x, spark.createDataFrame(etab, schema), commune, 0.0).collect()}
    assert got.get("r0") == f"{0:014}" and got.get("r3") == f"{2:014}" and "r1" not in got and "r2" not in got


def test_extraction_match_with_both_ends_of_the_name_misspelt(spark):
    unit = ["denominationUniteLegale", "denominationUsuelle1UniteLegale", "denominationUsuelle2UniteLegale", "denominationUsuelle3UniteLegale", "nomUniteLegale", "prenom1UniteLegale"]
    place = ["numeroVoieEtablissement", "libelleVoieEtablissement", "codePostalEtablissement", "libelleCommuneEtablissement"]
    signs = ["enseigne1Etablissement", "enseigne2Etablissement", "enseigne3Etablissement", "denominationUsuelleEtablissement"]
    struct = lambda c: f"struct<{', '.join(x + ':string' for x in c)}>"
    schema = f"siret string, uniteLegale {struct(unit)}, adresseEtablissement {struct(place)}, periodesEtablissement array<{struct(signs)}>, etablissementSiege boolean, {', '.join(x + ' string' for x in signs)}"
    names_ = ["AGENCE JANBRIGINDE EURL", *(f"GARAGE {w}" for w in "BRIMANOU CORDELAT FLUVARIN GASTOMIR HELVANOR JORMICAL".split())]
    etab = [(f"{i:014}", (n, *[None] * 5), (None, "DES LILAS", "56220", "FAKARMONT"), None, True, *[None] * 4) for i, n in enumerate(names_)]
    field = lambda v: (v, v, 0.9)
    asked = [("r0", "AGENCE HENBRIGINE", None), *((f"r{i}", n, None) for i, n in enumerate(names_[1:], 1)), ("r9", None, "rue des Lilas")]
    rows = [(i, {"company_name_raw": field(n), "postal_code": field("56220"), "city": field("FAKARMONT"), "address_fragment": field(s)}) for i, n, s in asked]
    x = spark.createDataFrame(rows, "row_id string, fields map<string,struct<value:string,evidence_text:string,confidence:double>>")
    got = linkage.matched_establishments(x, spark.createDataFrame(etab, schema), spark.createDataFrame([("56220", None)], "code_postal string, code_cedex string"), 0.0)
    found = {r.row_id: r.siret for r in got.collect()}
    assert found.pop("r9", None)  # by its street alone
    assert found == {f"r{i}": f"{i:014}" for i in range(7)}
