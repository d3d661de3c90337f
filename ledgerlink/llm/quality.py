"""Text statistics of documents, and from them a verdict: prose, list, table or junk (problem 8)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.session import cut

#: Statistics with the least spread that counts: differences below it say nothing of the kind of text. Counts are taken as logarithms.
SHAPE = {
    "prose_share": 0.12,  # characters in parts of seven words and more, with common words among them
    "common_share": 0.06,  # words that are common ones of the language
    "word_length": 0.6,
    "symbol_share": 0.04,
    "digit_share": 0.06,
    "end_punct_share": 0.5,  # lines that end in punctuation
    "words_per_part": 1.8,  # between punctuation, separators and lines that don't run on
    "table_share": 0.15,  # characters in rows of columns
    "list_share": 0.15,  # characters in short lines behind a bullet or number
    "vowel_share": 0.04,
    "distinct_share": 0.25,  # different words within blocks of the text
    "long_share": 0.1,  # characters in stretches of 30 and more without a blank
    "damage_share": 0.1,  # characters that betray a wrong encoding
    "lower_share": 0.15,  # words in lower case
    "repeated_share": 0.2,  # words in blocks of a handful of different ones
    "n_words": 2.0,
    "n_lines": 1.5,
}
LOGS = ["n_words", "n_lines"]
STATS = [*LOGS, *(c for c in SHAPE if c not in LOGS)]
#: A text is an outlier beyond this squared distance, the 0.9 quantile of chi squared with 17 degrees of freedom.
CUT = 24.8
#: A language's model counts as much as the model of all texts at so many usual texts.
PRIOR = 50
#: Statistics by which a text is compared with the centres of the kinds: all but those that every kind has in any amount.
TELLING = [c for c in SHAPE if c not in ("end_punct_share", *LOGS)]
#: A difference beyond this many spreads counts no further, and seeds weigh as this many texts in their centre.
FAR, SEED = 10.0, 20
ROUNDS = 2
#: Kinds of text as seeds of the centres, each by what sets it apart from a middling text.
MIDDLING = dict(prose_share=0.0, common_share=0.1, word_length=5.5, symbol_share=0.08, digit_share=0.03, words_per_part=2.5, table_share=0.0, list_share=0.0, vowel_share=0.42, distinct_share=0.75, long_share=0.0, damage_share=0.0, lower_share=0.5, repeated_share=0.0)
READABLE = dict(prose_share=0.8, common_share=0.42, word_length=4.9, symbol_share=0.04, words_per_part=7.8, lower_share=0.8)
SEEDS = [
    ("prose", READABLE),
    ("prose", READABLE | dict(lower_share=0.0)),  # in capitals
    ("prose", READABLE | dict(prose_share=0.64, common_share=0.24, word_length=1.8, words_per_part=8.5)),  # with letters apart
    ("prose", READABLE | dict(prose_share=0.6, common_share=0.3, damage_share=0.15)),  # wrongly decoded
    ("prose", READABLE | dict(prose_share=0.5, common_share=0.35, words_per_part=5.5, list_share=0.35)),  # with a list in it
    ("list", dict(list_share=1.0, words_per_part=1.8, lower_share=0.1, word_length=6.5)),  # of names behind bullets
    ("list", dict(list_share=1.0, words_per_part=3.1, lower_share=0.75, common_share=0.4)),  # of tasks behind bullets
    ("list", dict(words_per_part=1.9, lower_share=0.0, word_length=7.5)),  # of names
    ("list", dict(words_per_part=2.4, common_share=0.27)),  # of tasks
    ("table", dict(table_share=1.0, digit_share=0.34, words_per_part=1.5, lower_share=0.05, word_length=6.5)),
    ("table", dict(table_share=1.0, digit_share=0.55, words_per_part=0.7, lower_share=0.05, word_length=4.6)),
    ("table", dict(table_share=1.0, digit_share=0.75, words_per_part=0.5, lower_share=0.05, word_length=1.5, distinct_share=0.35)),  # of figures
    ("table", dict(table_share=1.0, digit_share=0.35, symbol_share=0.3, lower_share=0.05, long_share=0.8)),  # with cells that touch
    ("table", dict(table_share=1.0, digit_share=0.26, symbol_share=0.3, words_per_part=0.8, lower_share=0.05, long_share=0.15)),  # with drawn borders
    ("table", dict(table_share=1.0, digit_share=0.3, symbol_share=0.2, words_per_part=1.5, distinct_share=0.1, repeated_share=1.0)),  # of the same words in all rows
    ("list", dict(list_share=1.0, words_per_part=2.0, distinct_share=0.1, repeated_share=1.0)),
    ("junk", dict(common_share=0.0, repeated_share=1.0, distinct_share=0.05, lower_share=0.75)),  # one phrase again and again,
    ("junk", READABLE | dict(repeated_share=1.0, distinct_share=0.05, words_per_part=12.0)),  # a readable one,
    ("junk", dict(common_share=0.0, repeated_share=1.0, distinct_share=0.02, word_length=9.0, words_per_part=1.0, lower_share=0.0)),  # a stamp
    ("junk", dict(common_share=0.0, symbol_share=0.8, digit_share=0.15, vowel_share=0.0, word_length=1.0, words_per_part=0.5, distinct_share=0.1)),  # signs
    ("junk", dict(common_share=0.0, symbol_share=1.0, vowel_share=0.0, word_length=0.0, words_per_part=0.0, distinct_share=0.0, long_share=0.6, table_share=1.0, lower_share=0.0)),  # signs only
    ("junk", dict(common_share=0.0, vowel_share=0.05, word_length=3.3, lower_share=0.85)),  # keys at random
    ("junk", dict(common_share=0.0, digit_share=0.16, vowel_share=0.23, words_per_part=15.0, long_share=1.0, lower_share=0.0)),  # encoded bytes
    ("junk", dict(common_share=0.0, vowel_share=0.3, word_length=30.0, words_per_part=1.0, long_share=1.0, lower_share=1.0)),  # one endless word
    ("junk", dict(common_share=0.27, digit_share=0.62, vowel_share=0.34, word_length=1.2, words_per_part=15.0, distinct_share=0.2)),  # hexadecimal
    ("junk", dict(common_share=0.05, word_length=8.0, words_per_part=15.0, lower_share=0.8)),  # words without any sentence
    ("junk", dict(common_share=0.03, word_length=7.8, words_per_part=1.2, lower_share=0.8)),  # words without any line
]
#: Words of the blocks, all through a text, within which repetition is measured; a longer block would always repeat more.
DISTINCT_OF = 200

WORD = re.compile(r"[^\W\d_]+")
MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&[a-z]{2,8};")
BULLET = re.compile(r"(?:[-*•◦▪‣·–—]|\[[ xX]\]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|#+)\s+")
PART = re.compile(r"[.!?;:,)]+(?:\s|$)|[\n\t|│·•(]|\s[/–—-]\s")
QUOTED = re.compile(r"^[ \t]*>[ \t]?", re.M)
VOWELS = "aeiouyàâäéèêëíîïóôöúùûüæœ"
LONG = re.compile(r"\S{30,}")
GAP = re.compile(r"\t| {2,}")
DAMAGE = re.compile("[\ufffd□¿]|(?<=\\w)\\?(?=\\w)|Ã.|â€")
DAMAGED = ["\ufffd", "□", "¿", "Ã", "â€"]
BLANKS = ["\xa0", "\u202f", "\u2009", "\u3000"]


def is_row(line: str) -> bool:
    """Whether a line, without outer blanks, is laid out in columns."""
    if "|" in line or "│" in line:
        if line.count("|") + 2 * line.count("│") >= 2 and not re.search(r"[^\W\d_]{3,}[.!?] ", line):
            return True
    if line[0] == "<" and line[1:3].lower() in ("ta", "tr", "td", "th", "/t"):
        return True
    if line[0] == "+" and set(line) <= set("+-="):
        return True
    if line[0] == '"' and ('","' in line or '";"' in line):
        return True
    if "\t" in line or "  " in line:
        cells = GAP.split(line)
        if len(WORD.findall(line)) <= 4 * len(cells) and max(map(len, cells)) <= 60:
            return True
    if line.count(";") >= 2:
        cells = line.split(";")
        if "; " not in line and max(map(len, cells)) <= 60:
            return True
    return line.count(",") >= 2 and ", " not in line and max(map(len, line.split(","))) <= 60


def text_stats(text: str, common: dict[str, frozenset[str]]) -> tuple[str | None, list[float]]:
    """The language whose common words the text has most of, and its STATS."""
    text = text.replace("\r", "")
    if not text.isascii():
        for blank in BLANKS:
            text = text.replace(blank, " ")
    if ">" in text:
        text = QUOTED.sub("", text)
    rows = listed = ends = n_lines = length = 0
    joined, last, size = [], "", 0
    for line in text.split("\n"):
        size += len(line)
        if line := line.strip():
            n_lines += 1
            ends += line[-1] in ".!?…:;»\"”"
            if is_row(line):
                rows += len(line)
            elif len(line) <= 110 and BULLET.match(line) and ". " not in line[4:]:
                listed += len(line)
            length = len(last)
            joined.append(" " if length >= 55 and line[0].islower() and last[-1] not in ".!?:;" else "\n")  # a wrapped line runs on
            joined.append(line)
            last = line
    plain = "".join(joined)
    if "<" in plain or "&" in plain:
        plain = MARKUP.sub(" ", plain)
    low = plain.lower()
    words = WORD.findall(low)
    n = len(words)
    seen = Counter(words)
    lang, hits = max(((k, sum(map(seen.__getitem__, c & seen.keys()))) for k, c in sorted(common.items())), key=lambda x: x[1], default=(None, 0))
    frequent = common.get(lang, frozenset())
    letters = sum(map(len, words))
    blocks = plain.split()
    solid = max(1, sum(map(len, blocks)))
    digits = sum(map(plain.count, "0123456789"))
    damage = len(DAMAGE.findall(plain)) / solid if not plain.isascii() and any(map(plain.__contains__, DAMAGED)) else 0.0
    prose = whole = parts = 0
    for part in PART.split(low.replace("'", " ").replace("’", " ")):
        if w := part.split():
            parts += 1
            whole += len(part)
            if len(w) >= 7 and (damage > 0.1 or sum(map(frequent.__contains__, w)) >= 0.15 * len(w)):
                prose += len(part)
    different = [(len(b), len(set(b))) for b in (words[i : i + DISTINCT_OF] for i in range(0, n, DISTINCT_OF))]
    return lang if hits else None, [
        n,
        n_lines,
        prose / max(whole, 0.5 * solid),
        hits / n if n else 0.0,
        min(30.0, letters / n) if n else 0.0,
        max(0.0, 1 - letters / solid - digits / solid - damage),
        digits / solid,
        ends / n_lines if n_lines else 0.0,
        min(15.0, n / parts) if parts else 0.0,
        min(1.0, rows / max(1, size)),
        min(1.0, listed / max(1, size)),
        sum(map(low.count, VOWELS)) / letters if letters else 0.0,
        sum(d for _, d in different) / n if n else 0.0,
        sum(len(x) for x in blocks if len(x) >= 30) / solid,
        damage,
        sum(map(str.islower, blocks)) / len(blocks) if blocks else 0.0,
        sum(size for size, d in different if d < 4.5) / n if n else 0.0,
    ]


def in_logs(columns: list[np.ndarray]) -> np.ndarray:
    """One row of SHAPE for each text."""
    return np.stack([np.log1p(c) if n in LOGS else c for n, c in zip(SHAPE, columns)], axis=1)


def seeds() -> np.ndarray:
    return np.array([[(MIDDLING | d)[c] for c in TELLING] for _, d in SEEDS])


def nearest_centre(shape: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre that each text is least far from, in spreads."""
    at = [list(SHAPE).index(c) for c in TELLING]
    spread = np.array([SHAPE[c] for c in TELLING])
    off = np.abs(shape[:, None, at] - centres[None]) / spread
    return (np.minimum(off, FAR) ** 2).sum(axis=2).argmin(axis=1)


Models = dict[str | None, tuple[np.ndarray, np.ndarray]]


def contributions(shape: np.ndarray, languages: list[str | None], models: Models) -> np.ndarray:
    """What each statistic adds to the squared distance of each text from usual prose of its language."""
    out = np.full(shape.shape, np.nan)
    of = np.array([x if x in models else None for x in languages], dtype=object)
    for lang, (mean, inverse) in models.items():
        mine = of == lang
        off = shape[mine] - mean
        out[mine] = off * (off @ inverse)
    return out


def prose_models(stats: DataFrame, languages: list[str]) -> Models:
    """Mean and inverse covariance of the SHAPE of usual texts by language, and under None of all texts.

    Medians and median deviations, floored by SHAPE, tell which texts are usual; their mean and covariance,
    widened by the floors, make the model. All texts count. A language's model is drawn to that of all
    texts, the more the fewer usual texts it has.
    """
    names, floors = list(SHAPE), np.array(list(SHAPE.values()))
    logs = stats.select("language", *[F.log1p(c).alias(c) if c in LOGS else c for c in names], F.col("n_words").alias("_n"))
    both = logs.where("_n > 0").withColumn("of", F.explode(F.array(F.coalesce("language", F.lit("")), F.lit("*"))))
    middle = {r["of"]: [r[c] for c in names] for r in both.groupBy("of").agg(*[F.percentile_approx(c, 0.5, 1000).alias(c) for c in names]).collect()}  # a row for each language
    if not middle:
        return {}
    spark = stats.sparkSession
    centre = F.broadcast(spark.createDataFrame([(k, v) for k, v in middle.items()], "of string, m array<double>"))
    off = both.join(centre, "of").select("of", "m", *[(F.col(c) - F.col("m")[i]).alias(c) for i, c in enumerate(names)])
    spread = {r["of"]: [max(1.4826 * r[c], SHAPE[c]) for c in names] for r in off.groupBy("of").agg(*[F.percentile_approx(F.abs(c), 0.5, 1000).alias(c) for c in names]).collect()}
    scale = F.broadcast(spark.createDataFrame([(k, v) for k, v in spread.items()], "of string, s array<double>"))
    usual = off.join(scale, "of").where(sum((F.col(c) / F.col("s")[i]) ** 2 for i, c in enumerate(names)) < CUT)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]]
    found = {}
    for r in usual.groupBy("of").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names], *sums).collect():
        mean = np.array([r[c] for c in names]) / r["n"]
        second = np.array([[r[f"{a}*{b}"] if i <= j else r[f"{b}*{a}"] for j, b in enumerate(names)] for i, a in enumerate(names)]) / r["n"]
        found[r["of"]] = r["n"], mean + np.array(middle[r["of"]]), second - np.outer(mean, mean)
    if "*" not in found:
        return {}
    _, mean, cov = found["*"]
    models: Models = {None: (mean, np.linalg.inv(cov + np.diag(floors**2)))}
    for lang in languages:
        n, m, c = found.get(lang, (0, mean, cov))
        w = n / (n + PRIOR)
        models[lang] = w * m + (1 - w) * mean, np.linalg.inv(w * c + (1 - w) * cov + np.diag(floors**2))
    return models


def outliers(batch: pa.RecordBatch, models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a batch that have statistics: their rows, shape, contributions, and which are outliers."""
    at = np.flatnonzero(batch.column("n_words").is_valid().to_numpy(zero_copy_only=False))
    part = batch.take(pa.array(at))
    shape = in_logs([part.column(c).to_numpy(zero_copy_only=False) for c in SHAPE])
    share = contributions(shape, part.column("language").to_pylist(), models)
    return at, shape, share, ~(share.sum(axis=1) <= CUT)


def class_centres(stats: DataFrame, models: Models) -> np.ndarray:
    """The seeds, moved to the mean of the outliers nearest to them, twice over; seeds weigh as SEED texts.

    All texts count; sums by centre, as many rows as seeds, reach the driver.
    """
    centres = first = seeds()
    types = "centre int, n bigint, " + ", ".join(f"{c} double" for c in TELLING)
    at = [list(SHAPE).index(c) for c in TELLING]
    for _ in range(ROUNDS):

        def sums(batches: Iterable[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, shape, _, out = outliers(batch, models)
                shape = shape[out]
                near = nearest_centre(shape, centres)
                n = np.bincount(near, minlength=len(centres))
                total = [np.bincount(near, weights=shape[:, k], minlength=len(centres)) for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres)), pa.int32()), pa.array(n, pa.int64()), *(pa.array(t, pa.float64()) for t in total)], names=["centre", "n", *TELLING])

        moved = centres.copy()
        for r in stats.mapInArrow(sums, types).groupBy("centre").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in TELLING]).collect():
            moved[r.centre] = (np.array([r[c] for c in TELLING]) + SEED * first[r.centre]) / (r.n + SEED)
        centres = moved
    return centres


def text_quality(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Each document's statistics, distance from usual prose of its language, and kind.

    ``doc_id, language, kind, distance`` (squared), ``contributions`` (of each statistic to the distance;
    they add up to it) and STATS. The language is the one whose common words the text has most of, which
    need not be the stated one; null where it has none. A text within CUT of usual prose is prose; an
    outlier is of the kind whose centre is nearest, which may be prose of an unusual make. Null and blank
    texts have kind and distance null. A repeated doc_id is judged each time; a table without any words
    gives kinds without distance, as outliers. Extra columns are ignored. Whole texts and all documents
    count.
    """
    common: dict[str, set[str]] = {}
    for r in common_words.where("lang is not null and word is not null").select("lang", "word").collect():  # the word list, a parameter
        common.setdefault(r.lang, set()).add(r.word.lower())
    frozen = {k: frozenset(v) for k, v in common.items()}

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [text_stats(t, frozen) if t and t.strip() else None for t in batch.column(1).to_pylist()]
            columns = [pa.array([None if g is None else g[1][i] for g in got], pa.float64()) for i in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g and g[0] for g in got], pa.string()), *columns], names=["doc_id", "language", *STATS])

    types = ", ".join(f"{c} double" for c in STATS)
    stats = cut(documents.select("doc_id", "text").mapInArrow(measure, f"doc_id bigint, language string, {types}"))
    models = prose_models(stats, sorted(frozen))
    centres = class_centres(stats, models)
    kinds = np.array([k for k, _ in SEEDS], dtype=object)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shape, share, out = outliers(batch, models)
            n = batch.num_rows
            kind, far = np.full(n, None, dtype=object), np.full(n, np.nan)
            kind[at] = np.where(out, kinds[nearest_centre(shape, centres)], "prose")
            far[at] = share.sum(axis=1)
            full = np.zeros(n, dtype=bool)
            full[at] = ~np.isnan(far[at])
            offsets = np.concatenate([[0], np.cumsum(full * len(SHAPE))])
            values = share[~np.isnan(share).any(axis=1)].ravel()
            parts = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(list(SHAPE) * int(full.sum()), pa.string()), pa.array(values, pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kind, pa.string()), pa.array(far, pa.float64(), mask=~full), parts, *(batch.column(c) for c in STATS)],
                names=["doc_id", "language", "kind", "distance", "contributions", *STATS],
            )

    return stats.mapInArrow(judge, f"doc_id bigint, language string, kind string, distance double, contributions map<string,double>, {types}")
