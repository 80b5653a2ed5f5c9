"""Language identification by words first, with backoff to character n-grams.

A word that training saw is scored by its log frequency in each language.  An unseen word is covered from left to
right by the longest character n-gram that training saw at that place, then by shorter ones.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import ascii_lower, held_out, pick, slices, small_batches

#: Bounds of the model: at most so many documents a language, words and n-grams in all.
SAMPLE_DOCS, SAMPLE_CHARS, MAX_WORDS, MAX_GRAMS, LONGEST = 2000, 6_000_000, 120_000, 60_000, 4
#: A run of letters, and of signs that count as numbers without being digits.
_RUNS = re.compile(r"[^\W\d_]+")
#: Up to so many languages, a table of them is broadcast.
BROADCAST_LANGUAGES = 100_000
#: Words that a worker remembers.
MEMO = 50_000
UNDETERMINED = "und"


def words_of(text: str) -> Counter:
    """The runs of letters (Unicode's) of a text in lower case, with their numbers."""
    counts = Counter(_RUNS.findall(text.lower()))
    for w in [w for w in counts if not w.isalpha()]:
        n = counts.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            counts[part] += n
    return counts


@dataclass
class Model:
    languages: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]
    floor: tuple[float, ...]

    def word(self, w: str) -> tuple[float, ...]:
        """Log score of a lower-cased word in each language."""
        known = self.words.get(w)
        if known is not None:
            return known
        total, padded, at = [0.0] * len(self.languages), f"<{w}>", 0
        while at < len(padded):
            for n in range(min(LONGEST, len(padded) - at), 0, -1):
                part = self.grams.get(padded[at : at + n])
                if part is not None:
                    break
            else:
                n, part = 1, self.floor
            for i, x in enumerate(part):
                total[i] += x
            at += n
        return tuple(total)


def fit(texts: list[tuple[str, str]], max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """A model from (language, text) pairs; half-count smoothing over the words and over the n-grams of each length.

    Known words are those that occur twice, the ``max_words`` most frequent of them; n-grams are single characters and
    those that occur three times, the ``max_grams`` most frequent.  What is left out is backed off from.
    """
    languages = sorted({lang for lang, _ in texts})
    words = {lang: Counter() for lang in languages}
    for lang, text in texts:
        words[lang].update(words_of(text))
    everything = Counter()
    for c in words.values():
        everything.update(c)
    known = [w for w, n in sorted(everything.items(), key=lambda x: (-x[1], x[0])) if n > 1][:max_words]
    grams = {lang: Counter() for lang in languages}
    for lang in languages:
        for w, n in words[lang].items():
            padded = f"<{w}>"
            for size in range(1, LONGEST + 1):
                for i in range(len(padded) - size + 1):
                    grams[lang][padded[i : i + size]] += n
    all_grams = Counter()
    for c in grams.values():
        all_grams.update(c)
    chosen = [g for g, n in sorted(all_grams.items(), key=lambda x: (-x[1], x[0])) if n > 2 or len(g) == 1][:max_grams]
    n_words = [sum(words[lang].values()) + len(known) + 1 for lang in languages]
    by_size = [[sum(n for g, n in grams[lang].items() if len(g) == size) + len(chosen) + 1 for lang in languages] for size in range(LONGEST + 1)]
    return Model(
        languages,
        {w: tuple(np.log((words[lang][w] + 0.5) / n_words[i]) for i, lang in enumerate(languages)) for w in known},
        {g: tuple(np.log((grams[lang][g] + 0.5) / by_size[len(g)][i]) for i, lang in enumerate(languages)) for g in chosen},
        tuple(np.log(0.5 / x) for x in by_size[1]) if languages else (),
    )


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, doc_chars: int | None = None) -> Model:
    """A model from a bounded sample: of each language the ``sample_docs`` documents with the smallest hashed ids.

    ``docs`` needs doc_id, text, lang; rows without text or lang take no part.  Texts of a language beyond
    ``sample_chars`` characters together are left out, so the driver gets a bounded amount.  Texts longer than
    ``doc_chars`` (a hundredth of ``sample_chars`` if not given) come after all others, the shortest first, so that a
    language that has no shorter ones is learnt from them; of a text longer than ``sample_chars`` its beginning counts.
    """
    from pyspark.sql import Window

    rows = pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null")
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"), F.least(F.length("text"), F.lit(sample_chars)).alias("_n"))
    late = F.when(F.col("_n") > (sample_chars // 100 if doc_chars is None else doc_chars), F.col("_n")).otherwise(0)
    # cells in the same order, counted first: the windows then see the rows of the cells that hold the sample, not a language
    cell = F.when(late > 0, F.lit(1 << 16) + F.floor(F.log2(F.greatest(late, F.lit(1))) * 64)).otherwise(F.shiftright("_h", 48)).cast("int")
    ids = ids.withColumn("_cell", cell)
    cells = ids.groupBy("lang", "_cell").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("lang").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = cells.withColumn("_before", before).where(F.col("_before") < sample_docs).groupBy("lang").agg(F.max("_cell").alias("_reach"))
    many = reach.count() > BROADCAST_LANGUAGES
    ids = ids.join(reach if many else F.broadcast(reach), "lang").where("_cell <= _reach")
    order = Window.partitionBy("lang").orderBy(late, "_h", "doc_id")
    first = ids.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample_docs)
    first = first.withColumn("_sum", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= sample_chars)
    chosen = first.select("doc_id").distinct()
    got = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", F.substring("text", 1, sample_chars).alias("text"), "doc_id").collect()  # at most sample_chars a language
    return fit([(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["lang"], str(r["doc_id"]), r["text"]))])


class _Teller:
    """Tells the languages of texts; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def tell(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, words) of each text."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        return [self.one(t) for t in texts]

    def one(self, text: str | None) -> tuple[str, float, int]:
        counts = words_of(text) if text else {}
        if not counts or not self.model.languages:
            return UNDETERMINED, 0.0, 0
        rows = []
        for w in counts:
            x = self.memo.get(w)
            if x is None:
                x = self.memo[w] = self.model.word(w)
            rows.append(x)
        n = np.fromiter(counts.values(), float, len(counts))
        total = n @ np.array(rows)
        best, odds = int(np.argmax(total)), (total - total.max()) / n.sum()
        # per word evidence; at least e ** -odds, as if the text had a few words at most
        return self.model.languages[best], float(1 / np.exp(odds * min(n.sum(), 20.0)).sum()), int(n.sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, n_words for every row of ``docs`` (doc_id, text).

    The score is the posterior probability of the predicted language, with equal priors and the evidence taken
    per word (mean log odds), so that long texts do not all get 1.  ``und`` with score 0 is for null text and text
    without letters, and for everything if the model has no language.  Ties go to the first language in order.
    Nothing but the text is looked at; every row gives one row.
    """
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, MAX_WORDS and MAX_GRAMS

    def run(batches):
        teller = _Teller(held.value)
        out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64())])
        for whole in batches:
            for batch in slices(whole, "text"):
                told_ = teller.tell(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in told_], t) for i, t in enumerate(out.types[1:])]], schema=out)

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_words long")


def rejected(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """doc_id, digest of the rows whose language is not found with a score of ``least`` or more, as ``drop_rows`` takes
    them: the digest is that of the text with A-Z in lower case, its first 32 hex digits."""
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample, MAX_WORDS and MAX_GRAMS

    def run(batches):
        teller = _Teller(held.value)
        out = pa.schema([("doc_id", pa.int64()), ("digest", pa.string())])
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                texts = batch.column(1).to_pylist()
                bad = [i for i, (lang, score, _) in enumerate(teller.tell(texts)) if lang == UNDETERMINED or score < least]
                digests = [hashlib.sha256(ascii_lower(texts[i])).hexdigest()[:32] for i in bad]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(bad, pa.int64())), pa.array(digests, pa.string())], schema=out)

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, digest string").distinct()


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Predictions for all documents, learnt from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(4)))
    return predict(docs, model).select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")
