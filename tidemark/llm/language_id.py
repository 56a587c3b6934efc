"""Language identification in two levels: the family first, then one-versus-one SVMs inside it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.common import fresh, own, session

#: Families of languages by code; a language that isn't listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "da": "germanic", "sv": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "sk": "slavic", "bg": "slavic", "hr": "slavic", "sr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
}
#: Buckets of hashed character n-grams (n = 1, 2, 3).
BUCKETS = 1 << 13
#: Labelled documents per language that the models are fitted on, at most.
SAMPLE = 500
#: Documents with a prediction scored lower are rejected by the filter.
REJECT_BELOW = 0.3
UNKNOWN = "und"

_CANDIDATE = re.compile(r"[^\W\d_]")  # letters, and numbers such as fractions and Roman numerals
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Each code point, or a space where it is no letter."""
    global _letters
    if _letters is None:
        _letters = np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], dtype=np.uint32)
    return _letters


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter: a character of Unicode's category L, which is what ``isalpha`` and ``\\p{L}`` say."""
    return bool(text) and any(m[0].isalpha() for m in _CANDIDATE.finditer(text))


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (positions x 3) of all 1-, 2- and 3-grams and the first position of each text.

    Texts are lower-cased and everything but letters becomes a space. Each text
    stands between spaces, so no gram crosses from one text to the next.
    """
    padded = [f" {t.lower()}  " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _letter_table()[codes]
    first = np.cumsum([0, *(len(p) for p in padded)])
    one = codes * _MULTIPLIERS[0]
    two = (one[:-1] ^ (codes[1:] + np.uint32(0x7F4A7C15))) * _MULTIPLIERS[1]
    three = (two[:-1] ^ (codes[2:] + np.uint32(0x1B873593))) * _MULTIPLIERS[2]
    n = len(three)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.stack([(one[1 : n + 1] * _MULTIPLIERS[2]) >> shift, two[:n] >> shift, three >> shift], axis=1), first


@dataclass(frozen=True)
class Model:
    """Linear classifiers as columns of one weight table; a text's margin is the mean weight of its grams."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]  # level ('' or family), positive, negative
    weights: np.ndarray  # BUCKETS x pairs, float32
    bias: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        """One row a text; texts of any length, some at a time."""
        out = np.empty((len(texts), len(self.pairs)))
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) < 1 << 18:
                size += len(texts[end])
                end += 1
            grams, first = gram_buckets(texts[at:end])
            # the last two positions of a text have no 3-gram of their own
            spans = np.stack([first[:-1], first[1:] - 2], axis=1).ravel()
            spans[-1] = min(spans[-1], len(grams))
            for k in range(len(self.pairs)):
                column = np.ascontiguousarray(self.weights[:, k])
                each = column[grams[:, 0]] + column[grams[:, 1]] + column[grams[:, 2]]
                run = np.add.reduceat(each, spans[:-1], dtype=np.float64)[::2]
                out[at:end, k] = run / (3 * (spans[1::2] - spans[::2])) + self.bias[k]
            at = end
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score (0 to 1) of texts that have letters."""
        margins = self.margins(texts)
        sure = 1 / (1 + np.exp(-np.clip(2 * margins, -30, 30)))
        by_level: dict[str, list[int]] = {}
        for k, (level, _, _) in enumerate(self.pairs):
            by_level.setdefault(level, []).append(k)

        def vote(row: int, level: str, names: list[str]) -> tuple[str, float]:
            if len(names) == 1:
                return names[0], 1.0
            won, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
            for k in by_level[level]:
                _, a, b = self.pairs[k]
                p = float(sure[row, k])
                won[a if margins[row, k] >= 0 else b] += 1
                least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
            best = max(names, key=lambda x: (won[x], least[x], x))
            return best, least[best]

        out = []
        for row in range(len(texts)):
            family, p = vote(row, "", sorted(self.families))
            lang, q = vote(row, family, sorted(self.families[family]))
            out.append((lang, p * q))
        return out


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by dual coordinate descent; the bias is a constant feature."""
    n = len(y)
    if not n:
        return np.zeros(x.shape[1], np.float32), 0.0
    w, b, alpha = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(n)
    each = cost * n / (2 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))  # classes weigh alike
    diagonal = (x * x).sum(axis=1) + 1 + 0.5 / each
    for k in range(rounds):
        largest = 0.0
        for i in np.random.default_rng(k).permutation(n):
            grad = y[i] * (x[i] @ w + b) - 1 + alpha[i] * 0.5 / each[i]
            new = max(0.0, alpha[i] - grad / diagonal[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w += np.float32(step) * x[i]
                b += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return w, b


def fit(texts_grams: Mapping[str, list[tuple[np.ndarray, np.ndarray]]], families: Mapping[str, str] = FAMILIES) -> Model:
    """Fit family and language classifiers on gram counts: {lang: [(buckets, counts), ...]}."""
    langs = sorted(texts_grams)
    of = {lang: families.get(lang, lang) for lang in langs}
    tree: dict[str, list[str]] = {}
    for lang in langs:
        tree.setdefault(of[lang], []).append(lang)
    rows = [(lang, b, c) for lang in langs for b, c in texts_grams[lang]]
    if not rows:
        return Model({}, [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, (_, b, c) in enumerate(rows):
        x[i, b] = c / max(1, c.sum())
    # grams are weighed by their spread, then all rows brought to a length of about one
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
    x *= scale
    size = float(np.sqrt((x * x).sum(axis=1).mean()))
    x *= np.float32(1 / size)
    name = np.array([r[0] for r in rows])
    group = np.array([of[r[0]] for r in rows])
    pairs, weights, bias = [], [], []
    for level, label, names in [("", group, sorted(tree)), *((f, name, sorted(ls)) for f, ls in sorted(tree.items()))]:
        for a, b in combinations(names, 2):
            at = (label == a) | (label == b)
            w, c = _svm(x[at], np.where(label[at] == a, 1.0, -1.0), cost=10.0)
            pairs.append((level, a, b))
            weights.append(w * scale / size)
            bias.append(c)
    table = np.stack(weights, axis=1).astype(np.float32) if weights else np.zeros((BUCKETS, 0), np.float32)
    return Model(tree, pairs, table, np.array(bias))


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE, families: Mapping[str, str] = FAMILIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``sample`` documents per language among the rows where ``learn`` holds.

    The sample is the rows whose id hashes smallest, so it is the same on every
    run. Each language first keeps a hash range that is expected to hold twice
    its share, so a language that most rows share is no large group. Whole texts
    are turned to gram counts on the executors; the driver gets ``sample``
    sparse rows of at most ``BUCKETS`` counts per language.
    """
    session(docs)
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    chance = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 40)) / float(1 << 40)
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    few = known.withColumn("chance", chance).join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").where(F.col("chance") * F.col("n") <= 2.0 * sample + 50)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "id", F.xxhash64("text")))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = [], []
            for text in batch.column(1).to_pylist():
                grams, first = gram_buckets([text])
                b, c = np.unique(grams[: int(first[1]) - 2], return_counts=True)
                buckets.append(b.astype(np.int32))
                counts.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["lang", "buckets", "counts"])

    rows: dict[str, list] = {}
    for r in chosen.mapInArrow(count, "lang string, buckets array<int>, counts array<int>").orderBy("lang", F.xxhash64("buckets", "counts")).collect():
        rows.setdefault(r["lang"], []).append((np.array(r["buckets"]), np.array(r["counts"])))
    return fit(rows, families)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score.

    A map over whole texts without a shuffle; the weights (32 kB a classifier)
    travel with the tasks. A text that is null or has no letter, or any text if
    no language was learned, gets 'und' with score 0. A caller's columns of
    these two names are replaced; :func:`reject` keeps them.
    """
    clash = [c for c in docs.columns if c.lower() in ("lang_pred", "score")]
    return _label(docs.drop(*clash), model, text_col, "lang_pred", "score")


def _label(docs: DataFrame, model: Model, text_col: str, pred_col: str, score_col: str) -> DataFrame:
    """``docs`` and two more columns, whose names it must not have."""
    session(docs)
    keep = [*docs.columns, pred_col, score_col]
    work = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't be handed to Python
    at = docs.columns.index(text_col)
    schema = StructType([*work.schema.fields, StructField("pred", StringType()), StructField("score", DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            good = [i for i, t in enumerate(texts) if model.families and has_letter(t)]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for i, (name, p) in zip(good, model.predict([texts[i] for i in good]), strict=True):
                lang[i], score[i] = name, p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return work.mapInArrow(label, schema).toDF(*keep)


def held_out(doc_id: Column) -> Column:
    """Rows the model never learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that aren't held out, predict every row: all columns, held_out, lang_pred, score.

    A caller's columns of these three names are replaced.
    """
    out = held_out(F.col(id_col))
    model = train(docs, ~out, sample, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs.drop(*[c for c in docs.columns if c.lower() == "held_out"]), model, text_col).withColumn("held_out", out)


def reject(docs: DataFrame, below: float = REJECT_BELOW, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents with a language, with their own columns: 'und' and scores under ``below`` go.

    The verdict's columns have names that ``docs`` hasn't, so a caller's own
    ``score``, ``lang_pred`` or ``held_out`` stay as they are.
    """
    model = train(docs, ~held_out(F.col(id_col)), sample, id_col=id_col, text_col=text_col, lang_col=lang_col)
    pred, score = fresh(docs, "lang_pred", "score")
    found = _label(docs, model, text_col, pred, score)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= below)).select(*own(docs))
