"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding resolves compatibility forms, drops loose marks and invisible characters, lower-cases, maps look-alike
letters, digits and signs to the letters they stand for, closes up spelt-out words (i.d.i.o.t, i d i o t) and
turns all else into single spaces. Letters keep their accents there, as words differ by them; a text is matched
as it is and once more without accents, where only places that lose one count. The lexicon (whole words and word beginnings) is learned from labelled
rows: terms that toxic texts hold so much more often than clean ones that chance over all terms does not
explain it. A text's matched weight, whole and per length, enters a logistic curve; matches inside an
exception phrase do not count. Exceptions are a given list and pairs of words, one of the lexicon, that
labelled clean texts hold and toxic ones do not.

Learning takes at most ``LABELLED`` labelled rows, those of the least hashes of doc_id, and of near
copies among them one: a documented bound of the fit. Scoring covers every whole text.
Defined results: null and empty texts get the score of no match; repeated rows repeat; without labels of
both kinds the lexicon is empty and all scores are 0; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panolake.llm.common import table, text_of, written
from panolake.llm.units import slices

#: Look-alike characters that compatibility forms leave, and the letters that they are folded to.
LOOK_ALIKES = "01345789@$€£¢|" + "аеорсухіѕԁԛԝјһвкмнтгпьіϲ" + "αορνικτυηεωβγζχ" + "ıłøđħŧɑɡɩʏʀɪᴀᴇᴏᴜ"
LETTERS = "oieastbgaseeci" + "aeopcyxisdqwjhbkmhtrnbic" + "aopviktunewbyzx" + "ilodhtagiyriaeou"
#: Harmless phrases that hold a lexicon word, folded.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "idiot proof", "not an idiot", "not stupid", "not a loser", "pond scum")
LABELLED, MOST_TERMS = 20_000, 400


_TABLE = str.maketrans(LOOK_ALIKES, LETTERS)
_SPELT = re.compile(r"(?<!\w)\w(?:[.\-_*·]\w){2,}(?!\w)")
_APART = re.compile(r"(?<= )(?:[^ ] ){3,}[^ ](?= )")


class _Bare(dict):
    """Letters without accents, found as they are met."""

    def __missing__(self, code: int) -> str:
        self[code] = bare = unicodedata.normalize("NFD", chr(code))[0]
        return bare


_BARE = _Bare()


def fold(texts: pa.Array) -> pa.Array:
    """Texts as lower-case letters and single spaces, one at either end."""
    plain = pc.replace_substring_regex(pc.utf8_normalize(texts, form="NFKC"), r"[\p{M}\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]", "")
    plain = pc.replace_substring_regex(pc.utf8_lower(plain), r"!([\p{L}\p{N}])", r"i\1")
    letters = pa.array([t.translate(_TABLE) for t in plain.to_pylist()], pa.string())
    letters = _where(letters, r"\pL[.\-_*·]\pL[.\-_*·]\pL", lambda t: _SPELT.sub(lambda m: re.sub(r"[.\-_*·]", "", m[0]), t))
    spaced = pc.replace_substring_regex(pc.binary_join_element_wise(" ", letters, " ", ""), r"\PL+", " ")
    return _where(spaced, r" \pL \pL \pL \pL ", lambda t: _APART.sub(lambda m: m[0].replace(" ", ""), t))


def _where(texts: pa.Array, pattern: str, change) -> pa.Array:
    """Texts that match the pattern changed, all others as they are."""
    hit = pc.match_substring_regex(texts, pattern)
    if not pc.any(hit).as_py():
        return texts
    return pa.array([change(t) if h else t for t, h in zip(texts.to_pylist(), hit.to_pylist(), strict=True)], pa.string())


def _folder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([fold(batch.column("text")), batch.column("toxic")], ["folded", "toxic"])


@dataclass(frozen=True)
class Lexicon:
    terms: dict[str, float]
    curve: tuple[float, float, float]
    harmless: tuple[str, ...] = ()

    def automaton(self, exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in (*exceptions, *self.harmless):
            found.add_word(f" {phrase} ", (len(phrase) + 2, -1.0))
        found.make_automaton()
        return found


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], 1)


def matched(automaton: ahocorasick.Automaton, text: str) -> float:
    """Total weight of the matches, each place once, without those inside exceptions."""
    total = _weight(automaton, text, text)
    if not text.isascii() and (bare := text.translate(_BARE)) != text:
        total += _weight(automaton, bare, text)
    return total


def _weight(automaton: ahocorasick.Automaton, text: str, before: str) -> float:
    """Weight of the matches in ``text``; if it is not ``before`` itself, of those that differ there."""
    hits = [(end - n + 1, end, w) for end, (n, w) in automaton.iter(text)]
    if not hits:
        return 0.0
    spared = [(a, b) for a, b, w in hits if w < 0]
    own = text is before
    return sum(w for a, b, w in hits if w > 0 and (own or text[a : b + 1] != before[a : b + 1]) and not any(x <= a and b <= y for x, y in spared))


def training_rows(docs: DataFrame, labels: DataFrame, held_in: Column, most: int = LABELLED) -> DataFrame:
    """folded, toxic of at most ``most`` labelled rows, of each family of near copies the one of the least text."""
    chosen = labels.where(held_in & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = text_of(docs).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)
    rows = rows.select("text", "toxic").mapInArrow(_folder, "folded string, toxic int")
    words = F.filter(F.split("folded", " "), lambda w: w != "")
    family = [F.array_min(F.transform(words, lambda w, s=s: F.xxhash64(w, F.lit(s)))).alias(f"m{s}") for s in range(3)]
    return rows.select("folded", "toxic", *family).groupBy("m0", "m1", "m2").agg(F.min(F.struct("folded", "toxic")).alias("one")).select("one.folded", "one.toxic")


def _surprise(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """Log likelihood of the counts of toxic and clean rows at their own rate over that at the rate of all rows."""
    rate = toxic / (toxic + clean)
    own = t / (t + c)
    return t * F.log(own / rate) + F.when(c > 0, c * F.log((1 - own) / (1 - rate))).otherwise(0.0)


def learn(docs: DataFrame, labels: DataFrame, held_in: Column, purity: float = 0.75, share: float = 0.01) -> Lexicon:
    """Terms in at least ``share`` of the toxic rows of which ``purity`` of the rows with them are toxic, beyond chance."""
    rows = written(training_rows(docs, labels, held_in), "toxicity-rows")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, (0.0, 0.0, 0.0))
    words = F.array_distinct(F.filter(F.split("folded", " "), lambda w: F.length(w) >= 3))
    starts = F.flatten(F.transform(words, lambda w: F.transform(F.filter(F.array(*map(F.lit, range(3, 9))), lambda n: n <= F.length(w)), lambda n: F.concat(F.lit(" "), F.substr(w, F.lit(1), n)))))
    whole = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    terms = rows.select("toxic", F.explode(F.array_distinct(F.concat(whole, starts))).alias("term"))
    counts = written(terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t + c >= 3"), "toxicity-terms")
    t, c, chance = F.col("t"), F.col("c"), float(np.log(max(1, counts.count())))
    good = counts.where((t >= max(3, int(share * toxic))) & (t >= purity * (t + c)) & (_surprise(t, c, toxic, clean) >= chance))
    lexicon: dict[str, float] = {}
    for r in good.orderBy(F.desc("t"), F.desc(F.length("term")), "term").limit(20 * MOST_TERMS).collect():
        if len(lexicon) < MOST_TERMS and not any(r["term"].startswith(x) or x.startswith(r["term"]) for x in lexicon):
            lexicon[r["term"]] = float(np.log((r["t"] + 0.5) / (toxic + 1)) - np.log((r["c"] + 0.5) / (clean + 1)))
    if not lexicon:
        return Lexicon({}, (0.0, 0.0, 0.0))
    harmless = _harmless(rows, lexicon)
    bare = Lexicon(lexicon, (0.0, 0.0, 0.0), harmless)
    seen = rows.mapInArrow(_weigher(bare, ["toxic"], folded=True), "toxic int, weight double, words long").toArrow()
    weight, n, y = (seen[c].to_numpy() for c in ("weight", "words", "toxic"))
    x = np.column_stack([np.ones(len(weight)), _features(weight, n)])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * beta
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        beta += np.linalg.solve(bend, slope)
    return Lexicon(lexicon, tuple(float(b) for b in beta), harmless)


def _harmless(rows: DataFrame, lexicon: dict[str, float], least: int = 5) -> tuple[str, ...]:
    """Pairs of words, one of the lexicon, in ``least`` or more clean rows and in no toxic one."""
    held = F.filter(F.split("folded", " "), lambda w: w != "")
    listed = F.array(*map(F.lit, sorted(lexicon)))
    hit = lambda w: F.exists(listed, lambda term: F.startswith(F.concat(F.lit(" "), w, F.lit(" ")), term))
    pairs = rows.where(F.exists(listed, lambda term: F.contains("folded", term))).select("toxic", held.alias("ws"))
    pairs = pairs.select("toxic", F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", 2, F.size("ws")).alias("b")).alias("p"))
    pairs = pairs.select("toxic", F.explode(F.array_distinct(F.filter("p", lambda x: x["b"].isNotNull() & (hit(x["a"]) | hit(x["b"]))))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    return tuple(f"{r['a']} {r['b']}" for r in counts.where((F.col("t") == 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "a", "b").limit(MOST_TERMS).collect())


def _weigher(lexicon: Lexicon, kept: list[str], exceptions: tuple[str, ...] = EXCEPTIONS, folded: bool = False):
    """Adds a text's matched weight and number of words to the columns ``kept``; the column is ``text``, or ``folded`` if that is done."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton(exceptions)
        for batch in slices(batches, column="folded" if folded else "text"):
            texts = (batch.column("folded") if folded else fold(batch.column("text"))).to_pylist()
            weight = pa.array([matched(automaton, t) if lexicon.terms else 0.0 for t in texts], pa.float64())
            words = pa.array([max(0, t.count(" ") - 1) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), weight, words], [*kept, "weight", "words"])

    return weigh


def score(docs: DataFrame, lexicon: Lexicon, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text; other columns of ``docs`` are ignored."""
    weighed = text_of(docs).mapInArrow(_weigher(lexicon, ["doc_id"], exceptions), "doc_id long, weight double, words long")
    return weighed.select("doc_id", (_curve(lexicon) if lexicon.terms else F.lit(0.0)).alias("score"))


def _curve(lexicon: Lexicon) -> Column:
    a, b, c = lexicon.curve
    z = F.lit(a) + F.lit(b) * F.log1p("weight") + F.lit(c) * F.log1p(100 * F.col("weight") / F.greatest("words", F.lit(1)))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every row of ``documents``, learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels"), remainder() != 0))
    return scored.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, lexicon: Lexicon, below: float = 0.5, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """The rows of ``docs``, unchanged, that score under ``below``; no shuffle."""
    if not lexicon.terms:
        return docs
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([held.schema["doc"], T.StructField("weight", T.DoubleType()), T.StructField("words", T.LongType())])
    weighed = held.mapInArrow(_weigher(lexicon, ["doc"], exceptions), schema)
    return weighed.where(_curve(lexicon) < below).select("doc.*")
