"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of words of a fixed lexicon and of learned lexicons of words and of word
beginnings, how many of those stand within NEAR words of a second-person word, the rate of second-person words,
of capitals, of exclamation and question marks, of other punctuation, of words written with digits or marks inside,
of such words that spell a lexicon word, and the logarithm of the length.

A sample of at most about TRAIN_ROWS labelled rows is learned by cross-fitting over FOLDS folds, so that each row serves every
step: the features of a fold's rows come from the lexicons (words and beginnings that stand in far more of the toxic texts
than of the others) of the other folds, and the margins that the isotonic curve turns into probabilities from trees (Spark ML) of
the other folds. Scores use the lexicons and trees of all rows.

Defined results: null and empty texts have zero features and get the score of such a text; null labels are not
learned, and of repeated labels the highest holds; without labelled rows of both kinds every score is the share of
toxic rows (0 without rows); repeated rows get equal scores; whole texts are read at any length; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm.shared import ALNUM_TABLE, free_name, slices, table, written

TRAIN_ROWS = 20_000
TREES = 20
DEPTH = 4
FOLDS = 3
NEAR = 5
BEGINNING = 4
LEXICON_MIN_DOCS = 4
LEXICON_SIZE = 5_000
THRESHOLD = 0.3
SEED = 29

# Insults, and words of the second person in several languages.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers pathetic worthless disgusting trash scum clown dumb jerk fool retard bastard bitch asshole shit fuck fucking crap freak pig vermin imbecile "
    "dumm dummkopf trottel arschloch abschaum connard salaud abruti imbécile idiota estúpido imbécil basura tonto".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú usted ustedes ti tuyo vosotros".split())

_LEET = str.maketrans("013457@$!", "oieastasi", "*.-_")
_INSIDE = re.compile(rb"[A-Za-z\x80-\xff]+(?:[0-9@$!*._-]+[A-Za-z\x80-\xff]+)+")
_UPPER = bytes(range(65, 91))
_OTHER_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "!?.,")
_LEXICON, _BEGINS, _SECOND = 1, 2, 4
_REMEMBERED = 300_000


class Lexicon(dict):
    """word -> its flags, remembered; words and beginnings are the learned lexicons."""

    def __init__(self, words: frozenset[bytes] = frozenset(), beginnings: frozenset[bytes] = frozenset()):
        self.words, self.beginnings = words, beginnings
        self.insults = frozenset(w.encode() for w in INSULTS) | words
        self.second = frozenset(w.encode() for w in SECOND_PERSON)

    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        flags = _LEXICON * (word in self.insults) | _SECOND * (word in self.second)
        flags |= _BEGINS * (beginning(word) in self.beginnings)
        self[word] = flags
        return flags


def beginning(word: bytes) -> bytes:
    """The first BEGINNING letters of a longer word, else b''."""
    start = word[: 4 * BEGINNING].decode("utf-8", "ignore")
    return start[:BEGINNING].encode() if len(start) > BEGINNING else b""


FEATURES = ("lexicon", "lexicon_count", "beginnings", "beginnings_count", "near_second", "second", "capitals", "exclamations", "questions", "marks", "obfuscated", "obfuscated_insults", "length")


def features(raw: bytes | None, lexicon: Lexicon) -> list[float]:
    """The FEATURES of a UTF-8 text."""
    if not raw:
        return [0.0] * len(FEATURES)
    words = raw.translate(ALNUM_TABLE).split()
    flags = np.frombuffer(bytes(map(lexicon.__getitem__, words)), np.uint8)
    n, chars = max(1, len(words)), len(raw)
    bad, second = flags & (_LEXICON | _BEGINS) > 0, flags & _SECOND > 0
    near = 0
    if bad.any() and second.any():
        at, you = np.flatnonzero(bad), np.flatnonzero(second)
        i = np.searchsorted(you, at)
        near = int((np.minimum(np.abs(you[np.minimum(i, len(you) - 1)] - at), np.abs(you[np.maximum(i - 1, 0)] - at)) <= NEAR).sum())
    inside = _INSIDE.findall(raw)
    spelled = sum(1 for w in inside if w.decode("utf-8", "ignore").lower().translate(_LEET).encode() in lexicon.insults) if inside else 0
    in_lexicon, begins = int((flags & _LEXICON > 0).sum()), int((flags & _BEGINS > 0).sum())
    upper = chars - len(raw.translate(None, _UPPER))
    marks = chars - len(raw.translate(None, _OTHER_MARKS))
    return [in_lexicon / n, math.log1p(in_lexicon), begins / n, math.log1p(begins), near / n, float(second.sum()) / n, upper / chars, raw.count(b"!") / chars, raw.count(b"?") / chars, marks / chars, len(inside) / n, math.log1p(spelled), math.log1p(n)]


@dataclass
class Model:
    lexicon: Lexicon | None
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    share: float


def _with_features(docs: DataFrame, text_col: str, lexicon: Lexicon, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.beginnings))
    held: list[Lexicon] = []

    @F.arrow_udf("array<double>")
    def featured(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Lexicon(*shared.value))
        return pa.array([features(x, held[0]) for some in slices(texts) for x in some.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))

    return docs.withColumn(name, array_to_vector(featured(F.col(text_col).cast("string"))))


def _lexicons(rows: DataFrame) -> list[Lexicon]:
    """Of rows (text, toxic, fold) the words and beginnings whose share of toxic texts is far above that of others: for each
    fold those of the other folds' rows, and last those of all rows. Texts are read once."""
    totals = {(r.fold, r.toxic): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, marks, folds = [], [], []
            for raw, mark, fold in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = set((raw or b"").translate(ALNUM_TABLE).split())
                got = {b"w" + w for w in words} | {b"b" + b for b in map(beginning, words) if b}
                out += got
                marks += [mark] * len(got)
                folds += [fold] * len(got)
            yield pa.RecordBatch.from_pydict({"part": pa.array(out, pa.binary()), "toxic": pa.array(marks, pa.int32()), "fold": pa.array(folds, pa.int32())})

    counts = rows.select("text", F.col("toxic").cast("int"), F.col("fold").cast("int")).mapInArrow(parts, "part binary, toxic int, fold int")
    each = [F.count_if((F.col("toxic") == t) & (F.col("fold") != k)).alias(f"n{t}_{k}") for k in range(FOLDS + 1) for t in (0, 1)]
    counts = written(counts.groupBy("part").agg(*each).where(F.greatest(*[F.col(f"n1_{k}") for k in range(FOLDS + 1)]) >= LEXICON_MIN_DOCS), "toxicity-parts")
    out = []
    for k in range(FOLDS + 1):
        clean, toxic = (sum(n for (fold, t), n in totals.items() if t == kind and fold != k) for kind in (0, 1))
        if not toxic or not clean:
            out.append(Lexicon())
            continue
        t, c = F.col(f"n1_{k}"), F.col(f"n0_{k}")
        # log-odds less two standard errors
        odds = F.log((t + 0.5) / toxic) - F.log((c + 0.5) / clean) - 2 * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        best = counts.where(t >= LEXICON_MIN_DOCS).select("part", odds.alias("odds")).where("odds > 0.7").orderBy(F.desc("odds"), "part").limit(LEXICON_SIZE).collect()
        found = [bytes(r.part) for r in best]
        out.append(Lexicon(frozenset(p[1:] for p in found if p[:1] == b"w"), frozenset(p[1:] for p in found if p[:1] == b"b")))
    return out


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """A model from docs joined with labels (id_col, label_col); labels holds the rows that may be learned."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id_")).agg(F.max(label_col).cast("int").alias("toxic"))
    n = rows.count()
    chance = F.pmod(F.xxhash64(F.col("id_").cast("string"), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    fold = F.pmod(F.xxhash64(F.col("id_").cast("string"), F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")
    rows = rows.where(chance < min(1.0, train_rows / max(n, 1))).withColumn("fold", fold)
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text")).join(rows, "id_").select("text", "toxic", "fold")
    rows = written(rows, "toxicity-train")
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    kinds = {(r.fold, r.toxic) for r in rows.select("fold", "toxic").distinct().collect()}
    if not all(any(f != k and t == toxic for f, t in kinds) for k in range(FOLDS) for toxic in (0, 1)):
        return Model(None, None, None, float(share))
    lexicons = _lexicons(rows)
    ready = [_with_features(rows.where(F.col("fold") == k), "text", lexicons[k], "features") for k in range(FOLDS)]
    ready = [r.select(vector_to_array("features").alias("f"), F.col("toxic").cast("double").alias("label"), "fold") for r in ready]
    ready = written(reduce(DataFrame.union, ready), "toxicity-features").withColumn("features", array_to_vector("f"))
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=SEED, maxMemoryInMB=64)
    # each fit is a row of small jobs over at most TRAIN_ROWS rows of numbers; together they leave no core waiting
    parts = [ready.where(F.col("fold") != k) for k in range(FOLDS)]
    with ThreadPoolExecutor(FOLDS + 1) as pool:
        *folds, trees = pool.map(inheritable_thread_target(docs.sparkSession)(lambda part: learner.fit(part.coalesce(2))), [*parts, ready])
    margins = [t.transform(ready.where(F.col("fold") == k)).select(vector_to_array("rawPrediction")[1].alias("margin"), "label") for k, t in enumerate(folds)]
    curve = IsotonicRegression(featuresCol="margin").fit(written(reduce(DataFrame.union, margins), "toxicity-margins"))
    return Model(lexicons[-1], trees, curve, float(share))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a column toxicity: the calibrated probability of label 1."""
    name = free_name(docs, "toxicity")
    if model.trees is None:
        return docs.withColumn(name, F.lit(model.share))
    row = free_name(docs, "row_")
    rows = docs.select(F.struct(*docs.columns).alias(row), F.col(text_col).alias("text"))
    rows = _with_features(rows, "text", model.lexicon, "features").drop("text")
    rows = model.trees.transform(rows).withColumn("margin", vector_to_array("rawPrediction")[1])
    rows = model.curve.setPredictionCol("calibrated").transform(rows.drop("prediction"))
    return rows.select(*[F.col(row)[c].alias(c) for c in docs.columns], F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")).alias(name))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
