"""Variant spellings of names typed by people, brought together by entity (problem 3)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.session import cut, drop, piece_rows

# Words that no register of names could teach, as lists in natural order.
LEGAL_FORMS = "EARL EI EIRL EURL GAEC GIE SA SARL SAS SASU SCA SCEA SCI SCOP SCP SELARL SNC".split()
TITLES = "M MADAME MADEMOISELLE MLLE MM MME MONSIEUR MR".split()
FUNCTION_WORDS = "AND AU AUX CHEZ D DE DES DU EN ET L LA LE LES OU PAR POUR SUR".split()
#: Names of nobody: what is typed where no name is known.
NOBODY = "A AUTRE AUTRES CLIENT CLIENTS COMPTE DIVERS FOURNISSEUR FOURNISSEURS INCONNU NA NC NEANT SANS NOM TEST X XX XXX".split()
NO_NAME = frozenset(LEGAL_FORMS + TITLES + FUNCTION_WORDS)

#: Least cosine of two spellings of one role, of two where the role of one is unknown, and least average similarity of two groups that are joined.
COSINE, ALONE, LINKAGE = 0.2, 0.45, 0.15
#: What rounding may take from a cosine.
CLOSE = 1e-6
#: Occurrences of each letter that letter_bits tells apart, 63 at most.
BITS = {c: 3 if c in "AEIOURN" else 1 if c in "KQWYZ" else 2 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: The first bit of each letter and their number.
PLACES = {c: (at, n) for (c, n), at in zip(BITS.items(), accumulate(BITS.values(), initial=0))}
#: Lengths of the character n-grams.
GRAMS = (3, 4)
#: Similarity of spellings that the registry gives to two different units.
APART = -5.0
#: A word is learned only if at least one in LEARNED of all words is it, so that no more than LEARNED are.
LEARNED = 20_000
#: Share of a word's companions that must bear one role for the word to be a way to write that role.
ALIAS = 0.4


def folded(text: str) -> str:
    """Upper case without accents; text that was decoded wrongly once is decoded again."""
    if text.isascii():
        return text.upper()
    if "Ã" in text or "Â" in text:
        try:
            text = re.sub("[ÃÂ][\u0080-¿Œ-Ÿ–-›€™]", lambda m: m[0].encode("cp1252").decode("utf-8"), text)
        except UnicodeError:
            pass
    text = unicodedata.normalize("NFKD", text.replace("œ", "oe").replace("Œ", "OE"))
    return "".join(c for c in text if not unicodedata.combining(c)).upper()


WORD = re.compile(r"[A-Z0-9]+")
LAST = re.compile(r"\s-\s*[A-Z]+\s*$")
DOTTED = re.compile(r"\b([A-Z])\.(?=[A-Z]\b)")
DIGIT = re.compile("[0-9]")
#: Digits taken for letters.
DIGITS = str.maketrans("01258", "OLZSB")


def name_words(raw: str | None) -> list[str]:
    """The words of a name in their order, numbers left out, digits within words read as letters.

    A last word behind a dash that stands alone is given in lower case: it may be a remark.
    """
    if not raw:
        return []
    text = folded(raw).replace("_", " ")
    if "." in text:
        text = DOTTED.sub(r"\1", text)  # S.A.R.L.
    words = WORD.findall(text)
    if DIGIT.search(text):
        words = [w.translate(DIGITS) for w in words if not w.isdigit()]
    if len(words) > 2 and "-" in text and LAST.search(text):
        words[-1] = words[-1].lower()
    return words


def edits(a: str, b: str, most: int) -> int:
    """Edit distance where swapping neighbours is one edit; ``most + 1`` if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    begin = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # what both begin or end with costs nothing
    a, b = a[begin:], b[begin:]
    end = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before2 = row, before
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before = last
    return row[-1]


#: Letters that sound alike, longest first.
SOUNDS = [("EAU", "O"), ("AU", "O"), ("AI", "E"), ("EI", "E"), ("PH", "F"), ("CH", "$"), ("QU", "C"), ("Q", "C"), ("K", "C"), ("$", "CH"), ("Y", "I"), ("Z", "S")]
DOUBLED = re.compile(r"(.)\1+")


def sound(word: str) -> str:
    """The word as it sounds: one letter for each sound, no letter doubled."""
    for a, b in SOUNDS:
        if a in word:
            word = word.replace(a, b)
    return DOUBLED.sub(r"\1", word)


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` begins as ``word`` does and has its letters in their order."""
    letters = iter(word)
    return len(short) < len(word) and short[:1] == word[:1] and all(c in letters for c in short)


def letters_of(word: str) -> int:
    """The letter_bits of a word."""
    bits, seen = 0, {}
    for c in word:
        at, most = PLACES.get(c, (0, 0))
        k = seen.get(c, 0)
        if k < most:
            bits |= 1 << at + k
            seen[c] = k + 1
    return bits


@dataclass
class Vocabulary:
    """What a corpus of names taught about its words: roles (trades, given names) with other ways to write them, and remarks."""

    roles: dict[str, str] = field(default_factory=dict)  # a word and the role it stands for
    remarks: frozenset[str] = frozenset()
    _near: dict = field(default_factory=dict, repr=False, compare=False)
    _begin: dict = field(default_factory=dict, repr=False, compare=False)
    _letters: list = field(default_factory=list, repr=False, compare=False)
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    def short_role(self, word: str) -> str | None:
        """The only role that the word, unknown itself, is the beginning of."""
        if not self._begin and self.roles:
            for w, role in self.roles.items():
                for n in range(3, len(w) + 1):
                    self._begin[w[:n]] = role if self._begin.get(w[:n], role) == role else ""
        return self._begin.get(word) or None

    def near_role(self, word: str) -> str | None:
        """The role that the word seems to be a misspelling of."""
        if word not in self._near:
            if len(self._near) > 200_000:
                self._near.clear()
            if not self._letters:
                self._letters.extend([list(self.roles), np.array([letters_of(w) for w in self.roles], dtype=np.uint64)])
            most = 2 if len(word) >= 7 else 1 if len(word) >= 5 else 0
            hopeful = []
            if most and self.roles:
                mine, theirs = np.uint64(letters_of(word)), self._letters[1]
                lacks = np.maximum(np.bitwise_count(theirs & ~mine), np.bitwise_count(mine & ~theirs))
                hopeful = [self._letters[0][k] for k in np.flatnonzero(lacks <= most)]  # an edit adds or takes one letter, or both
            best = min(((d, w) for w in hopeful if (d := edits(word, w, most)) <= most), default=None)
            self._near[word] = self.roles[best[1]] if best else None
        return self._near[word]

    def parsed(self, words: list[str]) -> tuple[str, list[str]] | None:
        """Label and the words of the name proper as they sound; None for blank and catch-all names.

        The label is the role, or its first letter, which must not differ; '' if the name bears none.
        """
        key = " ".join(words)
        if key not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[key] = self._parse(words)
        return self._known[key]

    def _parse(self, words: list[str]) -> tuple[str, list[str]] | None:
        if words and words[-1].islower():
            last = words[-1].upper()
            words = words[:-1] if last in self.roles or last in self.remarks else [*words[:-1], last]
        words = [w for w in words if w not in self.remarks or w in self.roles]
        if not [w for w in words if w not in NOBODY and w not in NO_NAME]:
            return None
        role = [None if w in NO_NAME else self.roles.get(w) or self.short_role(w) for w in words]
        if not any(role):
            role = [None if w in NO_NAME else self.near_role(w) for w in words]
            if all(r or w in NO_NAME or len(w) == 1 for r, w in zip(role, words)):
                role = [None] * len(words)
        label = next((r for r in role if r), "")
        rest = [w for w, r in zip(words, role) if not r and len(w) > 1 and w not in NO_NAME and (w not in NOBODY or len(w) < 3)]
        initial = next((w for k, (w, r) in enumerate(zip(words, role)) if not r and len(w) == 1 and (w not in NO_NAME or w in TITLES and k)), "")
        for w in [w for w in rest if 2 <= len(w) <= 4]:  # initials of the whole name
            others = [x for x in rest if x is not w]
            if others and w[-len(others) :] in ("".join(x[0] for x in others), "".join(x[0] for x in others[::-1])) and len(w) - len(others) in (0, 1):
                rest, initial = others, initial or (w[0] if len(w) > len(others) else "")
        if not rest:
            rest = [w for w, r in zip(words, role) if r][1:]
            if not rest:
                return None
        return label or initial, [sound(w) for w in rest]


def with_words(names: DataFrame, key: str, name: str) -> DataFrame:
    """``key, words``: the name_words of each name, joined by blanks; names without a word are left out."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, " ".join(w)) for i, n in zip(*(c.to_pylist() for c in batch.columns)) if (w := name_words(n))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], batch.schema.field(0).type), pa.array([w for _, w in got], pa.string())], names=[key, "words"])

    return names.select(key, name).mapInArrow(work, f"{key} {dict(names.dtypes)[key]}, words string")


def pairs_of(forms: DataFrame, of: Callable[[str], Iterator[tuple[str, str]]]) -> DataFrame:
    """``a, b``: the pairs that ``of`` gives for the words of each name."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [x for w in batch.column(0).to_pylist() for x in of(w)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.string())], names=["a", "b"])

    return forms.select("words").mapInArrow(work, "a string, b string")


def learned(forms: DataFrame) -> Vocabulary:
    """The Vocabulary of names ``id, words, registered``.

    A role is a word that most registered names which bear it know no commoner word than. Every other word
    of a typed name that stands beside names proper of the registry, and mostly beside such as bear one
    role there, is a way to write that role (abbreviation, nickname); if they bear many roles, it is a
    remark. Words always registered together are one role. All names count; no more than LEARNED words of
    each kind reach the driver, as each makes up that share of all words.
    """
    spark = forms.sparkSession
    usual = (F.length("word") > 1) & (F.col("word") == F.upper("word")) & ~F.col("word").isin(*NO_NAME, *NOBODY)
    known_names, typed_names = forms.where("registered"), forms.where("not registered")
    each = lambda df: df.select("id", F.explode(F.array_distinct(F.split("words", " "))).alias("word")).where(usual)
    counts = {r.registered: r.n for r in forms.groupBy("registered").agg(F.sum(F.size(F.split("words", " "))).alias("n")).collect()}
    least = max(2, math.ceil(counts.get(True, 0) / LEARNED))
    df = dict(each(known_names).groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= least).collect())  # fewer than LEARNED words

    def common_words(words: str) -> list[str]:
        return [w for w in dict.fromkeys(words.split(" ")) if w in df]

    def votes(words: str) -> Iterator[tuple[str, str]]:
        mine = common_words(words)
        ranked = sorted(mine, key=lambda w: (-df[w], w))
        if ranked and (len(ranked) == 1 or df[ranked[0]] > df[ranked[1]] or df[ranked[0]] >= 3):
            yield ranked[0], ""
        yield from ((a, b) for a in mine for b in mine if a < b)

    often = F.broadcast(spark.createDataFrame([*df.items(), ("", 0)], "w string, df bigint"))
    voted = pairs_of(known_names, votes).groupBy("a", "b").agg(F.count("*").alias("n"))
    voted = voted.join(often.select(F.col("w").alias("a"), F.col("df").alias("da")), "a").join(often.select(F.col("w").alias("b"), F.col("df").alias("db")), "b")
    inseparable = (F.col("b") != "") & (F.col("n") >= 3) & (F.col("n") >= 0.8 * F.greatest("da", "db"))
    kept = sorted(tuple(r) for r in voted.where((F.col("b") == "") & (2 * F.col("n") >= F.col("da")) | inseparable).select("a", "b").collect())  # a few for each word of df
    roles = {a: a for a, b in kept if not b}
    for a, b in kept:
        if b and (a in roles or b in roles):  # compound given names
            roles[b] = roles[a] = a

    def bearing(words: str) -> Iterator[tuple[str, str]]:
        mine = [w for w in dict.fromkeys(words.split(" ")) if len(w) > 1 and w.isupper() and w not in NO_NAME and w not in NOBODY]
        yield from ((p, roles[r]) for p in mine if p not in roles for r in mine if r in roles)

    bears = pairs_of(known_names, bearing).distinct().select(F.col("a").alias("p"), F.col("b").alias("role"))
    known = F.broadcast(spark.createDataFrame([(w,) for w in roles], "word string"))
    proper = each(known_names).select("word").distinct().withColumn("proper", F.lit(True))
    marked = each(typed_names).join(known, "word", "left_anti").join(proper, "word", "left")
    of_name = marked.groupBy("id").agg(F.collect_list(F.struct("word", "proper")).alias("w"))  # the words of one name
    beside = of_name.select(F.explode("w").alias("v"), "w").select("v", F.explode(F.filter("w", lambda x: x["proper"])).alias("p")).where("v.word <> p.word")
    beside = cut(beside.groupBy(F.col("v.word").alias("v"), F.col("p.word").alias("p")).agg(F.max("v.proper").alias("known")))
    least = max(2, math.ceil(counts.get(False, 0) / LEARNED))
    seen = beside.groupBy("v").agg(F.count("*").alias("c"), F.max("known").alias("known")).where(F.col("c") >= least)  # fewer than LEARNED
    shared = beside.select("v", "p").join(F.broadcast(seen), "v").join(bears, "p").groupBy("v", "c", "known", "role").count()
    best = shared.groupBy("v", "c", "known").agg(F.max(F.struct("count", "role")).alias("b")).collect()
    remarks = []
    for r in best:
        if r.b["count"] >= max(2 if shortens(r.v, r.b.role) else 3, ALIAS * r.c):
            roles[r.v] = r.b.role
        elif r.c >= 3 and not r.known:
            remarks.append(r.v)
    return Vocabulary(roles, frozenset(remarks))


def parse(forms: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``id, label, proper``: those of ``id, words`` that name somebody, parsed."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, p) for i, w in zip(*(c.to_pylist() for c in batch.columns)) if (p := vocabulary.parsed(w.split(" ")))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([p[0] for _, p in got], pa.string()), pa.array([p[1] for _, p in got], pa.list_(pa.string()))], names=["id", "label", "proper"])

    return forms.select("id", "words").mapInArrow(work, "id bigint, label string, proper array<string>")


def gram_vectors(classes: DataFrame) -> DataFrame:
    """``id, gram, weight, rank``: character n-grams of the words, weighted by rarity, of unit length for each id, rarest first."""
    padded = F.transform("proper", lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of = lambda n: F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, n))))
    each = classes.select("id", F.explode(F.concat(*[of(n) for n in GRAMS])).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    total = classes.count()
    rarity = each.groupBy("gram").agg(F.log(F.lit(1.0) + F.lit(float(total)) / F.count("*")).alias("idf"))
    w = each.join(rarity, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    mine = Window.partitionBy("id")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(mine))
    left = mine.orderBy(F.col("idf"), "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = w.withColumn("tail", F.sqrt(F.sum(F.col("w") * F.col("w")).over(left)) / norm)
    return w.select("id", F.xxhash64("gram").alias("gram"), (F.col("w") / norm).alias("weight"), "tail")


def edits_allowed(size: Column) -> Column:
    """Edits that two names of one entity may differ by, by the size of the longer one."""
    return F.greatest(F.lit(1), F.floor((size + 1) / 3)).cast("int")


def letter_bits(name: str) -> Column:
    """A bit for the first, second, third occurrence of each letter, up to its BITS; names within n edits lack at most n of each other's."""
    bits = F.lit(0).cast("bigint")
    for letter, (at, most) in PLACES.items():
        count = F.length(name) - F.length(F.replace(F.col(name), F.lit(letter), F.lit("")))
        for k in range(most):
            bits = bits.bitwiseOR(F.when(count > k, F.lit(1 << at + k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def similar_spellings(classes: DataFrame, cosine: float = COSINE, alone: float = ALONE, piece: int = 20_000) -> DataFrame:
    """Pairs ``a < b`` of ids whose names reach the cosine, with it as their similarity.

    Names of one label must reach ``cosine``; those of which one has no label, or an initial, must reach
    ``alone``, as only the name proper speaks for them, and meet all labels. The join is exact: vectors of
    some cosine share a gram among the rarest of both, namely those without which less than that cosine of
    the vector's length is left; so only these grams meet. A gram with more than ``piece`` of all such rows
    is split, and each part of it meets the whole in another task. Rows that keep less of their vector's
    length than the square root of that cosine from there on don't meet each other. Further conditions are
    tested as soon as two names meet, the cheap ones first: what their first common gram and the rest of
    both vectors behind it can reach at most; how many letters one has and the other has not; and that the
    glued names, in either order of their words or with the words sorted, differ by few edits for their
    length. The first two only leave out what the cosine or the edits would. No partner is dropped.
    """
    glue = lambda w: F.concat_ws("", w)
    other = lambda w: F.when(F.size("proper") > 1, glue(w))  # noqa: E731  null where it would be the glued name
    names = cut(classes.select("id", "label", "siren", (F.length("label") <= 1).alias("open"), glue("proper").alias("glued"), other(F.reverse("proper")).alias("turned"), other(F.array_sort("proper")).alias("sorted")).withColumns({"size": F.length("glued"), "bits": letter_bits("glued")}))
    vectors = cut(gram_vectors(classes))

    def met(left: DataFrame, right: DataFrame, least: float, keys: list[str], more: Column) -> DataFrame:
        rest = F.sqrt(F.greatest(F.col("tail") * F.col("tail") - F.col("weight") * F.col("weight"), F.lit(0.0)))
        leading = vectors.where(F.col("tail") >= least).select("id", "gram", "weight", rest.alias("rest"), (F.col("tail") >= math.sqrt(least) - CLOSE).alias("much"))
        x, y = leading.join(left, "id"), leading.join(right, "id")
        x = x.withColumn("much", F.explode(F.when(F.col("much"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))  # of the others
        keys = [*keys, "much"]
        total = y.count()
        target = piece_rows(total, piece)
        hot = F.broadcast(y.groupBy(*keys).count().where(F.col("count") > target).select(*keys, F.ceil(F.col("count") / target).cast("int").alias("shares")))  # fewer than HOT_KEYS
        shares = F.coalesce("shares", F.lit(1))
        x = x.join(hot, keys, "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).alias("x")
        y = y.join(hot, keys, "left").withColumn("share", F.pmod(F.xxhash64("id"), shares).cast("int")).alias("y")
        most = edits_allowed(F.greatest("x.size", "y.size"))
        near = lambda a, b: F.expr(f"levenshtein({a}, {b}, 1 + int(greatest(x.size, y.size) / 3))").between(F.lit(0), most)
        lacks = lambda a, b: F.bit_count(F.col(f"{a}.bits").bitwiseAND(F.bitwise_not(f"{b}.bits")))
        reached = F.col("x.weight") * F.col("y.weight") + F.col("x.rest") * F.col("y.rest") >= least - CLOSE
        glued, turned, in_order = near("x.glued", "y.glued"), near("x.glued", "y.turned"), near("coalesce(x.sorted, x.glued)", "coalesce(y.sorted, y.glued)")
        several = F.col("x.sorted").isNotNull() | F.col("y.sorted").isNotNull()
        same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (*keys, "share")]
        cheap = reached & (lacks("x", "y") <= most) & (lacks("y", "x") <= most) & (F.abs(F.col("x.size") - F.col("y.size")) <= most)
        pairs = x.join(y, [*same, cheap & more & (glued | F.col("y.turned").isNotNull() & turned | several & in_order)])
        apart = F.coalesce(F.col("x.siren") != F.col("y.siren"), F.lit(False))  # two units of the registry
        return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), apart.alias("apart"), F.lit(least).alias("least"))

    closed, lone = names.where("not open"), names.where("open")
    fits = F.startswith("x.label", "y.label") | F.startswith("y.label", "x.label")
    once = F.col("x.id") < F.col("y.id")
    pairs = met(closed, closed, cosine, ["gram", "label"], once).unionByName(met(lone, names, alone, ["gram"], fits & (once | ~F.col("y.open"))))
    pairs = cut(pairs.distinct())
    v = lambda n: vectors.select(F.col("id").alias(n), "gram", F.col("weight").alias(f"w{n}"))
    summed = pairs.join(v("a"), "a").join(v("b"), ["b", "gram"]).groupBy("a", "b", "apart", "least").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return summed.where(F.col("cosine") >= F.col("least")).select("a", "b", F.when(F.col("apart"), APART).otherwise(F.col("cosine")).alias("similarity"))


def average_linkage(weights: DataFrame, edges: DataFrame, least: float = LINKAGE) -> DataFrame:
    """``id, cluster``: ids joined while the average similarity of two groups is at least ``least``.

    ``weights`` has ``id, weight`` (how many items the id stands for), ``edges`` has ``a < b, s``; absent
    pairs have similarity 0. In each round all pairs of groups that are each other's nearest are joined at
    once, which for average linkage gives the same groups as joining the nearest pair again and again. No
    group is gathered in one task. Of equal similarities the lesser id counts.
    """
    group = cut(weights.select("id", F.col("id").alias("cluster"), "weight"))
    sums = cut(edges.join(weights.select(F.col("id").alias("a"), F.col("weight").alias("wa")), "a").join(weights.select(F.col("id").alias("b"), F.col("weight").alias("wb")), "b").select("a", "b", (F.col("s") * F.col("wa") * F.col("wb")).alias("t"), "wa", "wb"))
    while True:
        average = F.col("t") / (F.col("wa") * F.col("wb"))
        strong = sums.where(average >= least).withColumn("s", average)
        ends = strong.select("a", "b", "s").unionByName(strong.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
        best = ends.groupBy("a").agg(F.max(F.struct("s", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"))
        mutual = best.alias("p").join(best.alias("q"), (F.col("p.a") == F.col("q.b")) & (F.col("p.b") == F.col("q.a"))).where(F.col("p.a") < F.col("p.b")).select(F.col("p.a").alias("into"), F.col("p.b").alias("gone"))
        mutual = cut(mutual)
        if mutual.isEmpty():
            return group.select("id", "cluster")
        past = group, sums, mutual
        group = cut(group.join(mutual, F.col("cluster") == F.col("gone"), "left").select("id", F.coalesce("into", "cluster").alias("cluster"), "weight"))
        size = group.groupBy("cluster").agg(F.sum("weight").alias("w"))
        moved = sums.join(mutual, F.col("a") == F.col("gone"), "left").withColumn("a", F.coalesce("into", "a")).drop("into", "gone")
        moved = moved.join(mutual, F.col("b") == F.col("gone"), "left").withColumn("b", F.coalesce("into", "b")).drop("into", "gone")
        moved = moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("t").alias("t"))
        sums = cut(moved.join(size.select(F.col("cluster").alias("a"), F.col("w").alias("wa")), "a").join(size.select(F.col("cluster").alias("b"), F.col("w").alias("wb")), "b"))
        for table in past:
            drop(table)


def named_entities(names: DataFrame) -> DataFrame:
    """``entry_id, spelling, cluster``: the entity that each entry names, as the least entry_id of its group.

    Null, blank and catch-all names name nobody and are left out. Names that parse alike are one class however
    many entries bear them, so that a name of a third of all rows costs as much as any other. Extra columns
    are ignored; a repeated entry_id is one entry.
    """
    entries = names.where("entry_id is not null").groupBy("entry_id").agg(F.min(F.struct("company_name_raw", "siren")).alias("x")).select("entry_id", "x.*")
    entries = cut(with_words(entries, "entry_id", "company_name_raw").join(entries.select("entry_id", "siren"), "entry_id"))
    forms = cut(entries.groupBy("words").agg(F.min("entry_id").alias("id"), F.max(F.col("siren").isNotNull()).alias("registered"), F.min("siren").alias("siren"), F.max("siren").alias("siren2"), F.count("*").alias("weight")))
    spelt = cut(parse(forms, learned(forms)).withColumn("spelling", F.concat_ws("|", "label", F.concat_ws(" ", "proper"))))
    classes = cut(forms.join(spelt, "id").groupBy("spelling").agg(F.min("id").alias("id"), F.sum("weight").alias("weight"), F.first("label").alias("label"), F.first("proper").alias("proper"), F.when(F.min("siren") == F.max("siren2"), F.min("siren")).alias("siren")))
    edges = similar_spellings(classes).withColumnRenamed("similarity", "s")
    groups = average_linkage(classes.select("id", "weight"), edges)
    of = forms.join(spelt.select("id", "spelling"), "id").select("words", "spelling").join(classes.select("spelling", "id"), "spelling").join(groups, "id").select("words", "spelling", "cluster")
    return entries.select("entry_id", "words").join(of, "words").select("entry_id", "spelling", "cluster")


def entity_pairs(names: DataFrame) -> DataFrame:
    """``entry_id_a < entry_id_b``: all pairs of entries of one entity, as TESTDATA.md asks for."""
    e = named_entities(names).select("entry_id", "cluster")
    a, b = e.select(F.col("entry_id").alias("entry_id_a"), "cluster"), e.select(F.col("entry_id").alias("entry_id_b"), "cluster")
    return a.join(b, "cluster").where("entry_id_a < entry_id_b").select("entry_id_a", "entry_id_b")
