"""Hierarchical language identification: the family first, then linear support vector machines inside it.

Texts become frequencies of hashed byte trigrams, in lower case, with everything ASCII that is no letter read as a
space. One linear SVM per pair of families picks the family by votes; one per pair of its languages picks the
language. Models are fitted in parallel, one task per pair, on a bounded sample of labelled rows; prediction
streams whole texts through Arrow batches and adds up one weight per trigram and model.

Duels only compare languages. Whether a text is like any of them is told apart by its fit: the mean over its trigrams of
log2(frequency in the language / even chance), above a floor that is set on labelled rows the frequencies were not
taken from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windowlark.session import materialize

#: Labelled rows per language that a fit may use; the same rows on every run, by hash of their id.
FIT_ROWS = 1000
BUCKET_BITS = 13
#: Trigrams scored at once, and texts folded at once.
SLICE, TEXTS = 1 << 18, 256
UNDECIDED = "und"
#: Share of held-out labelled rows that may lie below a language's floor, and deviations of a mean that short texts are granted.
FLOOR_SHARE, SHORT_SIGMAS = 0.005, 2.0

# fixed values: language codes by family
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz ky tt tk",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn mr gu pa ur ne si",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ALL_SPACE = (32 << 16) | (32 << 8) | 32


def family_of(lang: str) -> str:
    """Family of a language code; codes outside the table are families of their own."""
    return _FAMILY.get(lang.lower().split("-")[0], f"only {lang}")


def _buckets(raw: bytes) -> np.ndarray:
    """Hash bucket of every byte trigram; all-space trigrams get the bucket past the last."""
    b = _FOLD[np.frombuffer(raw, dtype=np.uint8)]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    with np.errstate(over="ignore"):
        spread = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    spread[code == _ALL_SPACE] = 1 << BUCKET_BITS
    return spread


def _raw(text: str) -> bytes:
    """Lower-case bytes between spaces, so that short texts have trigrams and neighbours do not mix."""
    return b"  " + text.lower().encode("utf-8", "surrogatepass") + b"  "


@dataclass
class LanguageModel:
    """Duels over families and, by family, over its languages; column m of ``weights`` belongs to duel m.

    The columns after the duels are the log frequencies of the languages, each with a floor and a spread.
    """

    families: dict[str, list[str]]
    duels: dict[tuple[str, str, str], int]
    weights: np.ndarray
    bias: np.ndarray
    floors: np.ndarray
    spreads: np.ndarray

    def sums(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean trigram weight and bias of each text (texts, columns), and its trigrams."""
        joined = b"".join(raws)
        lengths = np.array([len(r) for r in raws], dtype=np.int64)
        ends = np.cumsum(lengths)
        totals = np.zeros((len(raws), len(self.bias)))
        counts = np.zeros(len(raws))
        # texts meet in spaces only; a trigram across two texts is all spaces and weighs nothing
        for start in range(0, max(len(joined) - 2, 0), SLICE):
            bucket = _buckets(joined[start : start + SLICE + 2])
            first = int(np.searchsorted(ends, start, side="right"))
            last = int(np.searchsorted(ends, start + len(bucket) - 1, side="right"))
            cuts = np.maximum(ends[first : last + 1] - lengths[first : last + 1] - start, 0)
            totals[first : last + 1] += np.add.reduceat(self.weights[bucket], cuts, axis=0)
            counts[first : last + 1] += np.add.reduceat((bucket < 1 << BUCKET_BITS).astype(np.int64), cuts)
        counts = np.maximum(counts, 1)
        return totals / counts[:, None] + self.bias, counts

    def _winner(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the name with most votes (then largest sum of margins), and its least sure duel as 0 to 1."""
        n = len(names)
        votes, total, sure = np.zeros((3, len(margins), n))
        sure += 1.0
        for i, j in combinations(range(n), 2):
            m = margins[:, self.duels[level, names[i], names[j]]]
            for k, side in ((i, m), (j, -m)):
                votes[:, k] += side > 0
                total[:, k] += side
                sure[:, k] = np.minimum(sure[:, k], 1 / (1 + np.exp(-np.clip(3 * side, -50, 50))))
        best = np.argmax(votes + 0.5 * np.tanh(total) / (n + 1), axis=1)
        return best, sure[np.arange(len(margins)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and fit; the fit is that of the best language, in bits a trigram above its floor."""
        langs, scores, fits = [UNDECIDED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and self.families and _LETTER.search(t)]
        if not rows:
            return langs, scores, fits
        margins, counts = self.sums([_raw(texts[i]) for i in rows])
        above = margins[:, len(self.duels) :] - self.floors + SHORT_SIGMAS * self.spreads / np.sqrt(counts)[:, None]
        for where, fit in zip(rows, above.max(axis=1), strict=True):
            fits[where] = float(fit)
        names = sorted(self.families)
        family, sure = self._winner("", names, margins)
        for k, name in enumerate(names):
            at = np.flatnonzero(family == k)
            if len(at):
                inner = self.families[name]
                lang, sure_lang = self._winner(name, inner, margins[at])
                for where, which, p in zip(at, lang, sure[at] * sure_lang, strict=True):
                    langs[rows[where]], scores[rows[where]] = inner[which], float(p)
        return langs, scores, fits


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 20) -> np.ndarray:
    """Linear SVM with squared hinge loss by dual coordinate descent; classes weigh alike; last entry is the bias."""
    share = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    slack = share / (2 * cost * len(y) / 2)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    q = np.einsum("ij,ij->i", x, x) + slack
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * slack[i]
            new = max(alpha[i] - gradient / q[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


#: Frequencies are small; this brings typical rows to about unit length.
_GAIN = 20.0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, langs, buckets, shares, sizes = [], [], [], [], []
        for h, lang, text in zip(batch.column("h").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            if text and _LETTER.search(text):
                found, count = np.unique(_buckets(_raw(text)), return_counts=True)
                inside = found < 1 << BUCKET_BITS
                hashes.append(h)
                langs.append(lang)
                buckets.append(found[inside].astype(np.int32))
                shares.append((count[inside] / count[inside].sum()).astype(np.float32))
                sizes.append(int(count[inside].sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes, pa.int64()), pa.array(langs, pa.string()), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32())), pa.array(sizes, pa.int64())],
            ["h", "lang", "buckets", "shares", "size"],
        )


def _log_frequency(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies smoothed by the chance of a new trigram, and their log2 over an even chance."""
    seen, total, even = (counts > 0).sum(), max(counts.sum(), 1), 1 / len(counts)
    new = seen / (seen + total) if seen else 1.0
    p = (1 - new) * counts / total + new * even
    return p, np.log2(p / even)


def _profile(group: pd.DataFrame) -> pd.DataFrame:
    """Log frequencies of a language; each half of its rows is held against the other half for the floor."""
    rows = [(np.asarray(b), np.asarray(s, dtype=float), n) for b, s, n in zip(group["buckets"], group["shares"], group["size"], strict=True)]
    counts = np.zeros((2, 1 << BUCKET_BITS))
    for i, (b, s, n) in enumerate(rows):
        counts[i % 2, b] += s * n
    p, logs = _log_frequency(counts.sum(axis=0))
    spread = float(np.sqrt((p * (logs - p @ logs) ** 2).sum()))
    held = [_log_frequency(c)[1] for c in counts[::-1]]
    fits = [held[i % 2][b] @ s + SHORT_SIGMAS * spread / np.sqrt(n) for i, (b, s, n) in enumerate(rows)]
    floor = min(0.0, float(np.quantile(fits, FLOOR_SHARE))) if len(rows) > 1 else 0.0
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "logs": [logs], "floor": [floor], "spread": [spread]})


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """One duel: weights of the pair in ``level``, ``a`` against ``b``."""
    x = np.zeros((len(group), (1 << BUCKET_BITS) + 1))
    for i, (buckets, shares) in enumerate(zip(group["buckets"], group["shares"], strict=True)):
        x[i, np.asarray(buckets)] = np.asarray(shares) * _GAIN
    x[:, -1] = 1.0
    w = _svm(x, np.where(group["side"].to_numpy(), 1.0, -1.0))
    head = group.iloc[0]
    return pd.DataFrame({"level": [head["level"]], "a": [head["a"]], "b": [head["b"]], "w": [w]})


def fit_languages(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS
) -> LanguageModel:
    """Fit on at most ``rows`` rows per language (whole texts), chosen by hash of the id and of nothing else.

    Rows without a language, or without a letter in their text, take no part. A family duel takes equal shares from
    the languages of a family, ``rows`` in all. With no usable row the model predicts ``und`` for every text. What
    comes to the driver is one weight vector per pair of languages in a family and per pair of families, and one of
    frequencies per language. The floor of a language is an even chance, or lower so that of the sampled rows held out
    no more than FLOOR_SHARE lie below it.
    """
    keyed = labelled.where(F.col(lang_col).isNotNull()).select(
        F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(3)), 1).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    # find the hash bounds on narrow rows first, so that only sampled texts move; a coarse bound by the language's
    # count leaves about four times the rows wanted to the exact one
    counts = keyed.groupBy("lang").agg(F.count("*").alias("total"))
    coarse = F.shiftright("h", 10) <= 4.0 * rows / F.col("total") * (1 << 53)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    narrow = keyed.select("lang", "h").join(F.broadcast(counts), "lang").where(coarse)  # a row per language
    narrow = narrow.select("lang", "h").withColumn("n", place).where(F.col("n") <= rows)
    bounds = narrow.groupBy("lang").agg(F.max("h").alias("bound"))
    chosen = keyed.join(F.broadcast(bounds), "lang").where("h <= bound").select("h", "lang", "text")  # a row per language
    ranked = Window.partitionBy("lang").orderBy("h", F.xxhash64("buckets"))
    sample = materialize(
        chosen.mapInArrow(_features, "h long, lang string, buckets array<int>, shares array<float>, size long")
        .withColumn("n", F.row_number().over(ranked))
        .where(F.col("n") <= rows)
    )
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    plan = []  # level, a, b, language, on the side of a, rows of that language
    for fa, fb in combinations(sorted(families), 2):
        for f in (fa, fb):
            plan += [("", fa, fb, lang, f == fa, -(-rows // len(families[f]))) for lang in families[f]]
    for family, inner in families.items():
        for a, b in combinations(inner, 2):
            plan += [(family, a, b, a, True, rows), (family, a, b, b, False, rows)]
    duels, columns = {}, []
    if plan:
        spark = labelled.sparkSession
        sides = spark.createDataFrame(plan, "level string, a string, b string, lang string, side boolean, upto int")
        fitted = (
            sample.join(F.broadcast(sides), "lang")
            .where("n <= upto")
            .groupBy("level", "a", "b")
            .applyInPandas(_fit, "level string, a string, b string, w array<double>")
        )
        for r in sorted(fitted.collect(), key=lambda r: (r.level, r.a, r.b)):
            duels[r.level, r.a, r.b] = len(columns)
            columns.append(np.array(r.w))
    matrix = np.array(columns).T if columns else np.zeros(((1 << BUCKET_BITS) + 1, 0))
    profiles = sorted(sample.groupBy("lang").applyInPandas(_profile, "lang string, logs array<double>, floor double, spread double").collect())
    logs = np.array([r.logs for r in profiles]).T if profiles else np.zeros((1 << BUCKET_BITS, 0))
    weights = np.vstack([np.hstack([matrix[:-1] * _GAIN, logs]), np.zeros((1, matrix.shape[1] + logs.shape[1]))]).astype(np.float32)
    bias = np.append(matrix[-1], np.zeros(logs.shape[1]))
    return LanguageModel(families, duels, weights, bias, np.array([r.floor for r in profiles]), np.array([r.spread for r in profiles]))


def predict_languages(
    df: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, ...] = ("lang_pred", "score")
) -> DataFrame:
    """Adds the language and its score, under ``names``, to every row; reads the whole text and no other column.

    ``und`` and 0 if the text is null, empty or has no letter. The score, 0 to 1, is the product of the least sure
    duels that the family and the language won. A third name adds the fit, in bits a trigram: below 0 the text is
    unlike every language of the model (0 for ``und``). Columns that have one of the names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    kinds = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("fit", T.DoubleType())]

    @F.pandas_udf(T.StructType([T.StructField(*k) for k in kinds]))
    def guess(texts: pd.Series) -> pd.DataFrame:
        columns = [], [], []
        for start in range(0, len(texts), TEXTS):
            part = [t if isinstance(t, str) else None for t in texts.iloc[start : start + TEXTS]]
            for out, found in zip(columns, shared.value.judge(part), strict=True):
                out += found
        return pd.DataFrame({name: out for (name, _), out in zip(kinds, columns, strict=True)})

    kept = [c for c in df.columns if c not in names]
    judged = df.select(*kept, guess(F.col(text_col)).alias("_guess"))
    return judged.select(*kept, *[F.col(f"_guess.{kind}").alias(name) for name, (kind, _) in zip(names, kinds)])
