"""Language identification by interpolated Kneser-Ney character models.

Texts are read as folded letters; every run of other characters is one space. Of each language the
5-gram counts of a bounded sample of labelled rows (about TRAIN_DOCS whole texts a language, chosen by a hash) give an
interpolated Kneser-Ney model: the highest order has counts, lower ones the number of distinct characters
that precede a gram, and the lowest falls back on equal chances. The models of all languages are stored
together: per order one sorted array of gram hashes and beside it each language's log-probability, and
one of context hashes with the logs of the back-off weights. A text is given the language of lowest cross-entropy per character.

Rejection is calibrated on sampled rows that were not counted: of each language the mean cross-entropy under
its own model and how far, scaled by the root of the length, the worst of them lies above it. A text further
above than REJECT_MARGIN times that is rejected, as is a text without letters. A language with fewer than 5 such rows that
are identified rightly has the mean of those it has, or of all languages' without any, and the largest distance of the other languages; only where no
language has a row to calibrate with is no text with letters rejected.

Defined results: null and empty texts and texts without letters are `und`, score 0 and rejected; null labels are
not learned; equal cross-entropies go to the first language by code point; repeated rows get equal results; without labelled rows
everything is `und`; whole texts are read at any length; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm.shared import free_name, slices, table, written

ORDER = 5
TRAIN_DOCS = 600
#: Characters of a language that are learned or calibrate, about, and of all languages together; of a longer text the first so many.
TRAIN_CHARS = 4_000_000
ALL_CHARS = 32_000_000
CALIBRATE_SHARE = 5  # one sampled row in so many calibrates
MAX_LANGUAGES = 256
REJECT_MARGIN = 4.0
SEED = 17
UNKNOWN = "und"
_EDGE = 1  # the symbol around texts; 0 is the space
_EDGE_CHAR = "\ue000"
_CHUNK = 1 << 17
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(2 * ORDER)], np.uint64)


@cache
def _folding() -> np.ndarray:
    """Code point -> symbol: the folded letter's code point, or 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    out[ord(_EDGE_CHAR)] = _EDGE
    return out


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, text numbers) of texts, one after another, each behind ORDER - 1 edges; runs of spaces are one."""
    edge = _EDGE_CHAR * (ORDER - 1)
    joined = "".join(edge + (t or "") for t in texts)
    codes = _folding()[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t or "") + ORDER - 1 for t in texts])
    keep = codes != 0
    keep[1:] |= codes[:-1] > 0
    return codes[keep], of[keep]


def _keys(codes: np.ndarray, at: np.ndarray | None, n: int, back: int = 0) -> np.ndarray:
    """Hashes of the n symbols that end `back` before each place of `at` (all places from ORDER - 1 on if None)."""
    total = np.full(len(codes) - ORDER + 1 if at is None else len(at), n, np.uint64)
    for j in range(back, back + n):
        part = codes[ORDER - 1 - j : len(codes) - j] if at is None else codes[at - j]
        total += (part.astype(np.uint64) + np.uint64(1)) * _POWERS[j - back]
    return total


@dataclass
class Model:
    """grams[n - 1], log_p[n - 1]: order n; contexts[n - 1], log_back[n - 1]: weights of leaving order n."""

    languages: list[str]
    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_back: list[np.ndarray]
    uniform: float
    centre: np.ndarray | None = None
    reach: np.ndarray | None = None

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats per symbol, texts x languages; symbols of each text). Without symbols: 0."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= _CHUNK):
                size += len(texts[hi] or "")
                hi += 1
            codes, of = symbols(texts[lo:hi])
            for a in range(0, len(codes), _CHUNK):  # a long text in pieces, each with what stands before it
                b = max(0, a - ORDER + 1)
                self._add(codes[b : a + _CHUNK], of[b : a + _CHUNK], a - b, sums[lo:hi], counts[lo:hi])
            lo = hi
        return -sums / np.maximum(counts, 1)[:, None], counts

    def _add(self, codes: np.ndarray, of: np.ndarray, first: int, sums: np.ndarray, counts: np.ndarray) -> None:
        if first < ORDER - 1:
            codes = np.concatenate([np.full(ORDER - 1 - first, _EDGE, codes.dtype), codes])
            of = np.concatenate([np.full(ORDER - 1 - first, of[0] if len(of) else 0, of.dtype), of])
        if len(codes) < ORDER:
            return
        keys = _keys(codes, None, ORDER)
        of = of[ORDER - 1 :]
        place, found = _lookup(self.grams[-1], keys)
        real = codes[ORDER - 1 :] != _EDGE
        score = self.log_p[-1][place]
        score[~found] = 0
        missing = np.flatnonzero(~found & real)
        for n in range(ORDER - 1, 0, -1):
            if not len(missing):
                break
            at = missing + ORDER - 1
            c, known = _lookup(self.contexts[n], _keys(codes, at, n, 1))
            score[missing[known]] += self.log_back[n][c[known]]
            g, known = _lookup(self.grams[n - 1], _keys(codes, at, n))
            score[missing[known]] += self.log_p[n - 1][g[known]]
            missing = missing[~known]
        score[missing] += self.log_back[0][0] + self.uniform
        score[~real] = 0
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        sums[of[starts]] += np.add.reduceat(score, starts, axis=0, dtype=np.float64)
        counts[of[starts]] += np.add.reduceat(real.astype(np.int64), starts)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted keys, whether each is there)."""
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """The same hashes as _keys for rows of symbols, oldest first."""
    n = rows.shape[1]
    total = np.full(len(rows), n, np.uint64)
    for j in range(n):
        total += (rows[:, n - 1 - j].astype(np.uint64) + np.uint64(1)) * _POWERS[j]
    return total


def build(languages: list[str], counted: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from each language's (grams x ORDER symbols, counts)."""
    alphabet = len(np.unique(np.concatenate([g[:, -1] for g, _ in counted]))) + 1
    uniform = -float(np.log(alphabet))
    union, orders = [], []
    for n in range(1, ORDER + 1):
        rows = np.concatenate([g[:, ORDER - n :] for g, _ in counted])
        keys, first = np.unique(_hash_rows(rows), return_index=True)
        union.append((keys, rows[first]))
    model = Model(languages, [k for k, _ in union], [], [], [], uniform)
    per_language = []
    for grams, counts in counted:
        tables: list = [None] * ORDER
        tables[-1] = (_hash_rows(grams), grams, counts.astype(np.float64))
        for n in range(ORDER - 1, 0, -1):  # how many distinct symbols stand before each shorter gram
            longer = tables[n][1][:, 1:]
            keys, first, times = np.unique(_hash_rows(longer), return_index=True, return_counts=True)
            tables[n - 1] = (keys, longer[first], times.astype(np.float64))
        per_language.append(tables)
    lower = np.full((1, len(languages)), uniform)
    for n in range(1, ORDER + 1):
        keys, rows = union[n - 1]
        contexts = np.unique(_hash_rows(rows[:, :-1])) if n > 1 else np.array([0], np.uint64)
        of = np.searchsorted(contexts, _hash_rows(rows[:, :-1])) if n > 1 else np.zeros(len(rows), np.int64)
        below = lower[np.searchsorted(model.grams[n - 2], _hash_rows(rows[:, 1:]))] if n > 1 else lower[np.zeros(len(rows), np.int64)]
        log_p, back = np.empty((len(rows), len(languages))), np.zeros((len(contexts), len(languages)))
        for i, tables in enumerate(per_language):
            own, own_rows, times = tables[n - 1]
            n1, n2 = (times == 1).sum(), (times == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            own_of = np.searchsorted(contexts, _hash_rows(own_rows[:, :-1])) if n > 1 else np.zeros(len(own_rows), np.int64)
            total, kinds = np.bincount(own_of, times, len(contexts)), np.bincount(own_of, minlength=len(contexts))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            mine = np.zeros(len(rows))
            mine[np.searchsorted(keys, own)] = times - discount
            p = mine / np.maximum(total[of], 1) + weight[of] * np.exp(below[:, i])
            log_p[:, i], back[:, i] = np.log(p), np.log(weight)
        model.log_p.append(log_p.astype(np.float32))
        model.contexts.append(contexts)
        model.log_back.append(back.astype(np.float32))
        lower = log_p
    return model


def _sampled(docs: DataFrame, text_col: str, label_col: str, id_col: str, share: int) -> DataFrame:
    """(text, label, calibrates), written, of about `share` different rows of each label and TRAIN_CHARS characters.

    Rows are drawn by a hash of id and text, so rows that share an id or have none are drawn one by one; equal rows are one."""
    rows = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null and text is not null")
    own = lambda k: F.xxhash64("i", "text", F.lit(SEED + k))
    counts = rows.groupBy("label").agg(F.approx_count_distinct(own(0)).alias("n"), F.avg(F.length("text")).alias("chars")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return rows.select("text", "label", F.lit(False).alias("calibrates")).limit(0)
    chars = min(TRAIN_CHARS, ALL_CHARS // len(counts))
    rates = {r.label: min(share, chars / max(r.chars, 1)) / max(r.n, 1) for r in counts}
    limit = F.create_map(*[F.lit(x) for k in sorted(rates) for x in (k, min(1.0, rates[k]))])
    draw = F.pmod(own(0), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(draw < F.element_at(limit, F.col("label"))).withColumn("calibrates", F.pmod(own(1), F.lit(CALIBRATE_SHARE)) == 0)
    return written(drawn.dropDuplicates(["i", "text", "label"]).select(F.substring("text", 1, chars).alias("text"), "label", "calibrates"), "language-sample")


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model | None:
    """The models and their rejection limits, from rows of docs with a label; None without such rows."""
    rows = _sampled(docs, text_col, label_col, id_col, train_docs)

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for label in sorted(set(labels)):
                codes, _ = symbols([t for t, x in zip(texts, labels, strict=True) if x == label])
                rows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
                rows = np.ascontiguousarray(rows[rows[:, -1] != _EDGE], "<u4")
                kinds, times = np.unique(rows.view(np.dtype((np.void, 4 * ORDER))).ravel(), return_counts=True)
                yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(kinds), pa.string()), "gram": pa.array([k.tobytes() for k in kinds], pa.binary()), "n": pa.array(times, pa.int64())})

    counted = rows.where("not calibrates").select("text", "label").mapInArrow(grams, "label string, gram binary, n long")
    found = counted.groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    labels = np.array(found["label"].to_pylist(), object)
    languages = sorted(set(labels.tolist()), key=str.encode)
    if not languages:
        return None
    symbols_of = np.frombuffer(b"".join(found["gram"].to_pylist()), "<u4").reshape(-1, ORDER)
    times = found["n"].to_numpy()
    order = np.lexsort([*symbols_of.T])
    symbols_of, times, labels = symbols_of[order], times[order], labels[order]
    model = build(languages, [(symbols_of[labels == x], times[labels == x]) for x in languages])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, n = shared.value.entropies(batch.column(0).to_pylist())
            own = np.array([languages.index(x) if x in languages else -1 for x in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_pydict({"own": pa.array(own, pa.int32()), "entropy": pa.array(entropy[np.arange(len(own)), own]), "best": pa.array(entropy.argmin(axis=1) == own), "n": pa.array(n)})

    held = rows.where("calibrates").select("text", "label").mapInArrow(measured, "own int, entropy double, best boolean, n long")
    held = held.where("own >= 0 and n > 0").toArrow()
    shared.destroy()
    model.centre, model.reach = limits(len(languages), *(held[c].to_numpy() for c in ("own", "entropy", "best", "n")))
    return model


def limits(languages: int, own: np.ndarray, entropy: np.ndarray, best: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and reach of each language from the rows that calibrate: language, cross-entropy under its model, whether that is the lowest, length."""
    centre, reach = np.zeros(languages), np.full(languages, np.inf)
    best = best.astype(bool)
    for i in range(languages):
        if (mine := (own == i) & best).sum() >= 5:
            long = mine & (n >= np.median(n[mine]))
            centre[i] = entropy[long].mean()
            reach[i] = max(0.05, float(((entropy[mine] - centre[i]) * _scale(n[mine])).max()))
    if not len(own):
        return centre, reach
    few = np.isinf(reach)
    # the pooled rows: of languages with enough, or all there are; a language's own rows tell at least where its centre is
    pool = best & ~few[own] if not few.all() else np.ones(len(own), bool)
    for i in np.flatnonzero(few):
        mine = own == i
        centre[i] = entropy[mine].mean() if mine.any() else entropy[pool].mean()
    if few.all():
        pooled = max(0.05, float(((entropy - centre[own]) * _scale(n)).max()))
    else:
        pooled = float(reach[~few].max())
    reach[few] = pooled
    return centre, reach


def _scale(n: np.ndarray) -> np.ndarray:
    """How much a cross-entropy over n symbols tells: its root, up to 400 symbols."""
    return np.sqrt(np.clip(n, 1, 400) / 400)


def _named(m: Model, values: list[str | None]) -> pa.StructArray:
    entropy, n = m.entropies(values)
    folded = _folding()
    some = np.array([bool(t) and bool((folded[np.frombuffer(t[:64].encode("utf-32-le", "replace"), "<u4")] > _EDGE).any() or any(map(str.isalpha, t))) for t in values], bool)
    best = entropy.argmin(axis=1)
    low = entropy[np.arange(len(best)), best]
    score = 1 / np.exp((low[:, None] - entropy) * np.minimum(n, 40)[:, None]).sum(axis=1)
    rejected = ~some | ((low - m.centre[best]) * _scale(n) > REJECT_MARGIN * m.reach[best])
    langs = [m.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(low, mask=~some), pa.array(rejected)], ["lang", "score", "entropy", "rejected"])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with a struct column language_id: lang, score (0 to 1), entropy (nats per character), rejected."""
    shape = "lang string, score double, entropy double, rejected boolean"
    name = free_name(docs, "language_id")
    if model is None:
        return docs.withColumn(name, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{shape.replace(' ', ':').replace(',:', ',')}>")
    def named(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_named(shared.value, some.to_pylist()) for some in slices(texts)] or [_named(shared.value, [])])

    return docs.withColumn(name, named(F.col(text_col).cast("string")))


def keep_identified(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that are not rejected, by models learned from their labels."""
    marked = identify(docs, train(docs, text_col, label_col, id_col), text_col)
    return marked.where(~F.col(f"{marked.columns[-1]}.rejected")).select(*docs.columns)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("language_id.lang").alias("lang_pred"), F.col("language_id.score").alias("score"), F.col("language_id.rejected").alias("rejected"))
