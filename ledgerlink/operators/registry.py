"""The registry as a table: what is current, what a search gives, lookups by identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.functions import normalize as N


def latest(etab: DataFrame) -> DataFrame:
    """One row per siret, as last delivered; of equal times the greatest delivery."""
    row = F.struct(*[F.col(c) for c in etab.columns])
    return etab.where("siret is not null").groupBy("siret").agg(F.max_by(row, F.struct("dateDernierTraitementEtablissement", "delivery_id")).alias("_r")).select(*[F.col(c) if c == "siret" else F.col("_r")[c].alias(c) for c in etab.columns])


def current_period(periods: Column) -> Column:
    """The first open period, else the one that begins last; null where there is none."""
    real = F.filter(periods, lambda p: p.isNotNull())
    is_open = F.filter(real, lambda p: F.coalesce(p["dateFin"], F.lit("")) == "")
    begin = lambda p: F.coalesce(p["dateDebut"], F.lit(""))
    last = F.filter(real, lambda p: begin(p) == F.array_max(F.transform(real, begin)))
    return F.coalesce(F.try_element_at(is_open, F.lit(1)), F.try_element_at(last, F.lit(1)))


def period_at(periods: Column, day: Column) -> Column:
    """The first period that holds on the day, its ends included."""
    holds = lambda p: (p["dateDebut"] <= day) & ((F.coalesce(p["dateFin"], F.lit("")) == "") | (p["dateFin"] >= day))
    return F.try_element_at(F.filter(periods, holds), F.lit(1))


def search_row(etab: DataFrame) -> DataFrame:
    """The columns of a result grid, the current period before the top level, first name that is not blank."""
    p, u, a = F.col("_p"), F.col("uniteLegale"), F.col("adresseEtablissement")
    some = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c])
    person = F.nullif(F.concat_ws(" ", some(u["prenom1UniteLegale"]), some(u["nomUniteLegale"])), F.lit(""))
    street = F.concat_ws(" ", *[some(a[c]) for c in ("numeroVoieEtablissement", "typeVoieEtablissement", "libelleVoieEtablissement", "codePostalEtablissement", "libelleCommuneEtablissement")])
    return etab.withColumn("_p", current_period(F.col("periodesEtablissement"))).select(
        "siret", "siren",
        F.coalesce(some(u["denominationUniteLegale"], p["denominationUsuelleEtablissement"], F.col("denominationUsuelleEtablissement"), p["enseigne1Etablissement"], F.col("enseigne1Etablissement")), person).alias("name"),
        some(p["enseigne1Etablissement"], F.col("enseigne1Etablissement")).alias("sign"),
        some(p["etatAdministratifEtablissement"], F.col("etatAdministratifEtablissement")).alias("status"),
        some(p["activitePrincipaleEtablissement"]).alias("activity"),
        F.coalesce(F.nullif(street, F.lit("")), F.lit("N/A")).alias("address"),
        a["codePostalEtablissement"].alias("postal"), a["libelleCommuneEtablissement"].alias("city"),
        F.coalesce("etablissementSiege", F.lit(False)).alias("head"),
    )


def enriched(uploads: DataFrame, registry: DataFrame, key: Column) -> DataFrame:
    """Each upload with its establishment and a status; one join serves the first and the second chance.

    ``SKIPPED`` without digits, ``INVALID_SIRET`` unless there are 14, then ``OK`` or ``NOT_FOUND``. 12 or
    13 digits get a second chance with zeros in front: found, they are OK under the filled SIRET; else they
    stay INVALID_SIRET. The registry holds a siret once.
    """
    d = N.digits(key)
    exact = F.length(d) == 14
    lookup = F.when(exact, d).otherwise(N.padded_siret(key))
    r = registry.select(F.col("siret").alias("_siret"), F.struct(*[F.col(c) for c in registry.columns]).alias("etablissement"))
    keyed = uploads.withColumn("_digits", d).withColumn("_lookup", lookup)
    out = keyed.where("_lookup is not null").join(r, F.col("_lookup") == F.col("_siret"), "left").unionByName(keyed.where("_lookup is null"), allowMissingColumns=True)  # rows without key need no shuffle
    found = F.col("_siret").isNotNull()
    status = F.when(F.col("_digits") == "", "SKIPPED").when(found, "OK").when(F.length("_digits") == 14, "NOT_FOUND").otherwise("INVALID_SIRET")
    return out.withColumn("status", status).withColumn("used_siret", F.when(found, F.col("_siret")).otherwise(F.col("_digits"))).drop("_digits", "_lookup", "_siret")


def vat_enriched(requests: DataFrame, register: DataFrame) -> DataFrame:
    """Requests (country, number) with the register's answer, each pair looked up once, nulls as '': MISSING_VAT, INVALID_INPUT, NOT_FOUND, VALID, INVALID."""
    requests = requests.withColumns({c: F.coalesce(c, F.lit("")) for c in ("country", "number")})
    asked = requests.select("country", "number").distinct().join(register, ["country", "number"], "left")
    status = F.when(F.col("number") == "", "MISSING_VAT").when(~F.col("country").rlike("^[A-Z]{2}$") | ~F.col("number").rlike("^[A-Z0-9+*]+$"), "INVALID_INPUT").when(F.col("is_valid").isNull(), "NOT_FOUND").when(F.col("is_valid"), "VALID").otherwise("INVALID")
    return requests.join(asked, ["country", "number"], "left").withColumn("vat_status", status)


def word_prefixes(field: Column, phrase: str) -> Column:
    """All words of the phrase begin words of the field; one-letter words count only where there are no others."""
    every = [w for w in _folded(phrase).split() if w]
    wanted = [w for w in every if len(w) > 1] or every
    has = F.split(N.comparable(field), "[^A-Z0-9]+")
    out = F.lit(bool(wanted))
    for w in wanted:
        out = out & F.exists(has, _begins_with(w))
    return F.coalesce(out, F.lit(False))


def _begins_with(word: str):
    return lambda t: F.startswith(t, F.lit(word))


def _folded(phrase: str) -> str:
    import re
    import unicodedata

    t = "".join(c for c in unicodedata.normalize("NFKD", phrase.replace("œ", "oe").replace("Œ", "OE")) if not unicodedata.combining(c)).upper()
    return " ".join(re.findall("[A-Z0-9]+", t))


def named(phrase: str) -> Column:
    """The legal name, or in one period the sign or the usual name, has all words of the phrase."""
    legal = word_prefixes(F.col("uniteLegale.denominationUniteLegale"), phrase)
    period = lambda field: F.coalesce(F.exists("periodesEtablissement", lambda p: word_prefixes(p[field], phrase)), F.lit(False))
    return legal | period("enseigne1Etablissement") | period("denominationUsuelleEtablissement")


def criteria(name: str = "", commune: str = "", postal: str = "", department: str = "", activity: str = "", category: str = "", status: str = "", workforce: str = "", siret: str = "", address: str = "") -> Column:
    """One predicate for all filled criteria, each of which must hold."""
    out = F.lit(True)
    period = lambda f: current_period(F.col("periodesEtablissement"))[f]
    digits = "".join(c for c in siret if c.isdigit())
    if digits:
        out = out & (F.col("siret") == digits if len(digits) == 14 else F.startswith("siret", F.lit(digits)))
    if name:
        out = out & named(name)
    if postal:
        out = out & (F.col("adresseEtablissement.codePostalEtablissement") == postal)
    if department:
        out = out & F.startswith("adresseEtablissement.codePostalEtablissement", F.lit(department))
    if commune:
        out = out & word_prefixes(F.col("adresseEtablissement.libelleCommuneEtablissement"), commune)
    if activity:
        out = out & (period("activitePrincipaleEtablissement") == activity)
    if category:
        out = out & (F.col("uniteLegale.categorieJuridiqueUniteLegale") == category)
    if status:
        out = out & (period("etatAdministratifEtablissement") == status)
    if workforce:
        out = out & (F.col("trancheEffectifsEtablissement") == workforce)
    if address:
        out = out & (word_prefixes(F.col("adresseEtablissement.libelleVoieEtablissement"), address) | word_prefixes(F.col("adresseEtablissement.complementAdresseEtablissement"), address))
    return out


def strict_match(target: Column, phrase: str, prefix: bool = False) -> Column:
    """One word: equal to a word of the target, or its beginning if ``prefix``. More: in a row, the last may be a beginning."""
    wanted = N_words(phrase)
    if not wanted:
        return F.lit(False)
    has = F.filter(F.split(F.regexp_replace(N.comparable(target), r"\([^)]*\)", " "), r"[\s\-.'*/()\[\]]+"), lambda w: w != "")
    if len(wanted) == 1:
        return F.coalesce(F.exists(has, lambda w: F.startswith(w, F.lit(wanted[0])) if prefix else w == wanted[0]), F.lit(False))
    n = len(wanted)

    def begins(i: Column) -> Column:
        out = F.startswith(F.get(has, i + n - 1), F.lit(wanted[-1]))
        for k, w in enumerate(wanted[:-1]):
            out = out & (F.get(has, i + k) == w)
        return out

    return F.coalesce((F.size(has) >= n) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(has) - n, F.lit(0))), begins), F.lit(False))


def N_words(phrase: str) -> list[str]:
    import unicodedata

    t = "".join(c for c in unicodedata.normalize("NFKD", phrase.replace("œ", "oe").replace("Œ", "OE")) if not unicodedata.combining(c)).upper()
    return t.split()


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def after(df: DataFrame, key: str, last: str, size: int) -> DataFrame:
    """The next page behind a key."""
    return df.where(F.col(key) > last).orderBy(key).limit(size)


def clamp_paging(nombre, debut, least: int, most: int, furthest: int, default: int) -> tuple[int, int]:
    def whole(x, d, lo, hi):
        try:
            return min(hi, max(lo, int(float(x))))
        except (TypeError, ValueError):
            return d

    return whole(nombre, default, least, most), whole(debut, 0, 0, furthest)


def tiers(asked: DataFrame, registry: DataFrame, cap: int = 50, broad_cap: int = 20, near_cap: int = 20) -> DataFrame:
    """Candidates for names without identifier, from the narrowest tier that has any.

    ``asked`` has ``id, name, postal, city``; ``registry`` is one row per siret. All words begin words of
    one field: the legal name, or in one period the sign or the usual name. Tier 2: within the postal code,
    or a commune whose words all words of the city begin; tier 3: within the department; tier 5: anywhere,
    head offices only. Rows whose tier 2 found something are left out of tier 3 by an anti-join, and so on,
    so that the broad tier joins only what is left. Blocks are equal beginnings of two letters, and of six
    in the broad tier; each pair is then checked. The caps are part of the search: the least sirets are kept.
    """
    split = lambda c: F.filter(F.split(N.comparable(c), "[^A-Z0-9]+"), lambda w: w != "")
    n = asked.select("id", F.filter(split(F.col("name")), lambda w: F.length(w) > 1).alias("w"), F.trim(F.coalesce("postal", F.lit(""))).alias("cp"), split(F.col("city")).alias("c"))
    n = n.where(F.size("w") > 0).withColumn("first", F.element_at("w", 1))
    period = lambda field: F.coalesce(F.transform("periodesEtablissement", lambda p: split(p[field])), F.array().cast("array<array<string>>"))
    fields = F.array_distinct(F.concat(F.array(split(F.col("uniteLegale.denominationUniteLegale"))), period("enseigne1Etablissement"), period("denominationUsuelleEtablissement")))
    r = registry.select("siret", F.coalesce("etablissementSiege", F.lit(False)).alias("head"), F.explode(fields).alias("t"), F.col("adresseEtablissement.codePostalEtablissement").alias("rcp"), F.col("adresseEtablissement.libelleCommuneEtablissement").alias("commune"))
    r = r.withColumn("token", F.explode("t"))
    all_begin = lambda words, of: F.forall(words, lambda w: F.exists(of, lambda t: F.startswith(t, w)))
    dept = lambda c: N.department(F.col(c), "search")

    def pairs(left: DataFrame, right: DataFrame, on: list) -> DataFrame:
        return left.join(right, on).where(F.startswith("token", F.col("first")) & all_begin("w", "t")).select("id", "siret")

    def tier(found: DataFrame, k: int, limit: int) -> DataFrame:
        ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("siret"))).where(F.col("rank") <= limit)
        return ranked.withColumn("tier", F.lit(k))

    one, two, six = (lambda c, k=k: F.substring(c, 1, k) for k in (1, 2, 6))
    labels = registry.select(F.col("adresseEtablissement.libelleCommuneEtablissement").alias("label")).distinct().withColumn("ct", split(F.col("label"))).withColumn("ctoken", F.explode("ct"))
    cities = n.where(F.size("c") > 0).select("c").distinct().withColumn("cfirst", F.element_at("c", 1))
    cities = cities.join(labels, one("cfirst") == one("ctoken")).where(F.startswith("ctoken", F.col("cfirst")) & all_begin("c", "ct")).select("c", "label").distinct()
    by_code = pairs(n.where("cp <> ''"), r, [F.col("cp") == F.col("rcp"), two("first") == two("token")])
    by_city = pairs(n.join(cities, "c"), r, [F.col("label") == F.col("commune"), two("first") == two("token")])
    t2 = tier(by_code.unionByName(by_city), 2, near_cap)
    rest = n.join(t2.select("id").distinct(), "id", "left_anti")
    t3 = tier(pairs(rest.where("cp <> ''"), r, [dept("cp") == dept("rcp"), two("first") == two("token")]), 3, cap)
    rest = rest.join(t3.select("id").distinct(), "id", "left_anti")
    long, short = rest.where(F.length("first") >= 6), rest.where(F.length("first") < 6)
    t5 = tier(pairs(long, r.where("head"), [six("first") == six("token")]), 5, broad_cap)
    t5s = tier(pairs(short, r.where("head").withColumn("size", F.explode(F.sequence(F.lit(2), F.lit(5)))), [F.length("first") == F.col("size"), F.col("first") == F.expr("substring(token, 1, size)")]), 5, broad_cap)
    return t2.unionByName(t3).unionByName(t5).unionByName(t5s)
