"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier over
hashed character n-grams tells the languages that have it from those that have
not. A text's language is the codeword with the least loss, every bit weighted
by how sure its classifier is; close losses are flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.tables import map_texts, table
from fieldtally.session import settle

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
# Training rows per language: bounds what the fit reads, not what is predicted.
ROWS_PER_LANGUAGE = 1000
HASHES = 1 << 30
# Values of lang that are learned: bounds the model, and what a column full of other things can do to it.
MAX_LANGUAGES = 512
# Chosen training keys up to this number are sent to every task (16 bytes and a language name each), more are joined.
BROADCAST_ROWS = 200_000
# Up to this many languages the code has every way to split them, beyond it random splits.
FULL_CODE = 7
SMOOTHING = 0.5
# A margin this near the next codeword's, in nats per text, is ambiguous.
AMBIGUOUS = 2.0
# A text's n-grams are not independent witnesses: their number counts to this power.
EVIDENCE = 0.5

_STEPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 / -1
    weights: np.ndarray  # buckets x bits, log odds of a bit given an n-gram


def hashed(text: str) -> np.ndarray:
    """Buckets of the n-grams of a text, lower-cased, digits left out, framed by spaces."""
    plain = " ".join(re.sub(r"\d+", " ", text).lower().split())
    chars = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in GRAMS:
        if len(chars) >= n:
            mixed = np.full(len(chars) - n + 1, n, np.uint32)
            for i in range(n):
                mixed = (mixed ^ chars[i : len(chars) - n + 1 + i]) * _STEPS[i]
                mixed ^= mixed >> np.uint32(15)
            out.append(mixed % np.uint32(BUCKETS))
    return np.concatenate(out)


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """Codewords of +1 and -1 for n languages: every split of them, or for many languages random ones.

    No bit is the same for all languages unless there is only one.
    """
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= FULL_CODE:
        return np.array([(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest], np.int8).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(12 * np.log2(n)))
    columns = []
    while len(columns) < bits:
        column = rng.permutation(np.where(np.arange(n) % 2, 1, -1))
        columns.append(column if rng.random() < 0.5 else -column)
    return np.array(columns, np.int8).T


def training_rows(docs: DataFrame, key: str = "doc_id", limit: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most ``limit`` keys per language, the first by a hash of the key.

    Of very many values of ``lang`` the MAX_LANGUAGES most frequent are learned
    (ties: the first in the alphabet). The keys are ranked without reading a
    text. Only hashes under a border that lets about twice the limit through
    are ranked, so a language that fills the table costs no more than another;
    the borders come from one count per language.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("lang").agg(F.count("*").alias("__rows")).orderBy(F.desc("__rows"), "lang").limit(MAX_LANGUAGES)
    # At most so many rows, a name and a number each.
    borders = F.broadcast(counts.select("lang", (F.lit(2 * limit * HASHES) / F.col("__rows")).cast("long").alias("__border")))
    low = F.pmod(F.col("__h"), F.lit(HASHES))
    ranked = known.select("lang", F.xxhash64(key).alias("__h")).join(borders, "lang").where(low <= F.col("__border"))
    ranked = ranked.select("lang", "__h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(low, "__h"))
    first = ranked.withColumn("__n", place).where(f"__n <= {limit}")
    first = settle(first.drop("__n"), "language-rows")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    hashed_key = known.withColumn("__h", F.xxhash64(key))
    return hashed_key.join(first, ["lang", "__h"], "left_semi").select("lang", "text")


def train(docs: DataFrame, key: str = "doc_id", limit: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit the classifiers on a bounded number of rows of ``docs`` (key, text, lang) per language.

    Tasks count n-grams, one vector per language and task; only the summed
    vectors come to the driver. Without a labelled row the model knows no
    language.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = hashed(text)
                held = np.bincount(grams, minlength=BUCKETS) / max(1, len(grams))
                sums[lang] = sums.get(lang, 0) + held
        for lang, vector in sums.items():
            at = np.flatnonzero(vector)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(vector[at], pa.float64())],
                names=["lang", "bucket", "n"],
            )

    counted = training_rows(docs, key, limit).mapInArrow(count, "lang string, bucket int, n double")
    rows = counted.groupBy("lang", "bucket").agg(F.round(F.sum("n"), 9).alias("n")).toArrow().combine_chunks()
    if not rows.num_rows:
        return Model([], codewords(0), np.zeros((BUCKETS, 1), np.float32))
    # One number a row; the names stay in a dictionary.
    named = rows.column("lang").combine_chunks().dictionary_encode()
    names = named.dictionary.to_pylist()
    languages = sorted(names)
    number = np.array([languages.index(x) for x in names])
    share = np.full((len(languages), BUCKETS), SMOOTHING / BUCKETS)
    share[number[named.indices.to_numpy()], rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    share /= share.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    if len(languages) > 1:
        for b in range(code.shape[1]):
            yes, no = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
            weights[:, b] = np.log(yes) - np.log(no)
    return Model(languages, code, weights)


def _chances(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each codeword and the shares that follow from them; a bit weighs as much as its margin is large."""
    weight = np.abs(margins) / max(np.abs(margins).sum(), 1e-12)
    losses = (np.logaddexp(0, -code * margins) * weight).sum(axis=1)
    shares = np.exp(losses.min() - losses)
    return losses, shares / shares.sum()


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) with lang_pred, score (0 to 1) and ambiguous.

    Null texts, texts without a letter (numerals of any kind are none) and all
    texts under a model without languages are ``und`` with score 0. Equal
    losses go to the language first in the alphabet and are ambiguous. Whole
    texts are read, however long. Repeated rows are told alike, and an empty
    table gives no rows. Columns called lang_pred, score or ambiguous are
    replaced, others may have any name.
    """
    # Lists and arrays only: what is broadcast must be readable where this package is not.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.code, model.weights))

    def begin():
        languages, code, weights = shared.value

        def one(t: str | None) -> tuple[str, float, bool]:
            if not languages or not t or not any(map(str.isalpha, t)):
                return "und", 0.0, False
            if len(languages) == 1:
                return languages[0], 1.0, False
            grams = hashed(t)
            margins = weights[grams].sum(axis=0, dtype=np.float64) * len(grams) ** (EVIDENCE - 1)
            losses, shares = _chances(margins, code)
            best, second = np.argsort(losses, kind="stable")[:2]
            return languages[best], float(shares[best]), bool(losses[second] - losses[best] < AMBIGUOUS)

        def work(texts: list, _) -> dict:
            rows = [one(t) for t in texts]
            return {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "ambiguous": [r[2] for r in rows]}

        return work

    added = T.StructType(
        [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    )
    return map_texts(docs, text, begin, added, docs.columns if keep is None else keep)


def held_out(key: str, parts: int, part: int):
    """Whether a row is kept from training: crc32 of its key as text leaves ``part``. A null key is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id", 3, 1)).select("doc_id", "text", "lang"))
    marked = docs.select("doc_id", "text", held_out("doc_id", 3, 1).alias("held_out"))
    return predict(marked, model, keep=["doc_id", "held_out"])
