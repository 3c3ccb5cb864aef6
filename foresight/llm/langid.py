"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of distinct character n-grams, of
one to three characters, that both hold, divided by the root of the product of their own numbers.
Nyström landmarks turn it into a finite feature map, and one-versus-rest kernel ridge regression is
fitted on these features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight.llm.arrow import slices

UNKNOWN = "und"
#: Symbols of the alphabet: 0 for what is no letter, 1-26 for a-z, the rest shared by other letters.
SYMBOLS = 64
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
#: Training texts and landmarks for each language, at most.
TEXTS_PER_LANGUAGE = 800
LANDMARKS_PER_LANGUAGE = 80
RIDGE = 1e-3
_BLOCK = 1 << 20
_LETTER = regex.compile(r"\p{L}")


#: No letter is assigned from here on; the last entry of the table is what is no letter.
_CODES = 0x32400


@cache
def _symbols() -> np.ndarray:
    """Symbol of each character up to the last letter of any plane, upper and lower case alike."""
    table = np.zeros(_CODES + 1, dtype=np.uint32)
    for code in range(_CODES):
        char = chr(code)
        if char.isalpha():
            low = ord(char.lower()[0])
            table[code] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (SYMBOLS - 27)
    return table


def grams(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted numbers of the distinct n-grams; ``seen`` is an all-false scratch array of ``GRAMS``."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    for start in range(0, len(codes), _BLOCK):
        block = codes[max(0, start - 2) : start + _BLOCK]
        s = _symbols()[np.minimum(block, _CODES)]
        seen[s] = True
        pairs = s[:-1] * SYMBOLS + s[1:]
        seen[SYMBOLS + pairs] = True
        seen[SYMBOLS + SYMBOLS**2 + pairs[:-1] * SYMBOLS + s[2:]] = True
    found = np.flatnonzero(seen).astype(np.int32)
    seen[found] = False
    return found


@dataclass(frozen=True)
class LanguageModel:
    """``weights[column[g]]`` are the scores that n-gram ``g`` adds for each language."""

    languages: list[str]
    column: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Batched product of the presence matrix with landmarks and ridge weights.

        The kernel matrix is X·Lᵀ and the scores are X·Lᵀ·A; Lᵀ·A is multiplied out once at fitting.
        """
        sizes = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.languages)))
        filled = np.flatnonzero(sizes)
        if len(filled) and self.languages:
            flat = self.weights[self.column[np.concatenate([texts[i] for i in filled])]]
            starts = np.concatenate(([0], np.cumsum(sizes[filled])[:-1]))
            out[filled] = np.add.reduceat(flat, starts, axis=0) / np.sqrt(sizes[filled])[:, None]
        return out


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(GRAMS, dtype=bool)
    for batch in slices(batches, "text"):
        packed = [grams(t, seen).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(packed, pa.binary())], names=["lang", "grams"]
        )


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    spread_cols: tuple[str, ...] = ("doc_id",),
    texts_per_language: int = TEXTS_PER_LANGUAGE,
    landmarks_per_language: int = LANDMARKS_PER_LANGUAGE,
    ridge: float = RIDGE,
) -> LanguageModel:
    """Fit on rows with a language and a letter; the hash of ``spread_cols`` picks the sample.

    About ``texts_per_language`` texts of each language are taken, by a hash threshold from its
    count, so nothing is shuffled but counts; the driver gets their n-gram sets (``GRAMS`` numbers
    each at most). Rows with null text or language teach nothing. Without any row to learn from,
    every text is predicted as unknown.
    """
    rows = docs.select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).cast("string").alias("text"),
        F.pmod(F.xxhash64(*[F.col(c) for c in spread_cols]), F.lit(1 << 30)).alias("place"),
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(GRAMS, np.int32), np.zeros((1, 0), np.float32))
    edge = F.create_map(
        *[
            F.lit(x)
            for lang in languages
            for x in (lang, int(min(1.0, texts_per_language / counts[lang]) * (1 << 30)) + 1)
        ]
    )
    picked = (
        rows.filter((F.col("place") < edge[F.col("lang")]) & F.col("text").rlike(r"\p{L}"))
        .select("lang", "text")
        .mapInArrow(_gram_batches, "lang string, grams binary")
        .toArrow()
    )
    texts = [np.frombuffer(g, np.int32) for g in picked.column("grams").to_pylist()]
    labels = np.array([languages.index(x) for x in picked.column("lang").to_pylist()])
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i].tobytes()))
    texts, labels = [texts[i] for i in order], labels[order]
    if not texts:
        return LanguageModel([], np.zeros(GRAMS, np.int32), np.zeros((1, 0), np.float32))
    landmarks = []
    for k in range(len(languages)):
        own = np.flatnonzero(labels == k)
        landmarks += own[np.linspace(0, len(own) - 1, min(landmarks_per_language, len(own))).astype(int)].tolist()
    vocabulary = np.unique(np.concatenate([texts[i] for i in landmarks]))
    column = np.zeros(GRAMS, np.int32)  # column 0 is what no landmark holds
    column[vocabulary] = np.arange(1, len(vocabulary) + 1)
    holds = np.zeros((len(vocabulary) + 1, len(landmarks)), np.float32)
    for j, i in enumerate(landmarks):
        holds[column[texts[i]], j] = 1 / np.sqrt(len(texts[i]))
    kernel = np.array([holds[column[t]].sum(axis=0, dtype=np.float64) / np.sqrt(len(t)) for t in texts])
    values, vectors = np.linalg.eigh(kernel[landmarks])
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    targets = np.eye(len(languages))[labels]
    balance = 1 / np.bincount(labels, minlength=len(languages))[labels]
    weighted = features * balance[:, None]
    inner = weighted.T @ features + ridge * np.eye(features.shape[1])
    solved = root @ np.linalg.solve(inner, weighted.T @ targets)
    return LanguageModel(languages, column, (holds @ solved).astype(np.float32))


def predict(
    docs: DataFrame,
    model: LanguageModel,
    text_col: str = "text",
    lang_out: str = "lang_pred",
    score_out: str = "lang_score",
) -> DataFrame:
    """Add the predicted language and its score, from the whole text and nothing else.

    A null text, or one without a letter, is ``und`` with score 0. The score is the winner's ridge
    output cut to 0..1; ties go to the language that sorts first. Equal texts get equal results,
    other columns pass through, and one that has the name of an added column is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (lang_out, score_out)])
    schema = kept.withColumn(lang_out, F.lit(None).cast("string")).withColumn(
        score_out, F.lit(None).cast("double")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        seen = np.zeros(GRAMS, dtype=bool)
        none = np.zeros(0, np.int32)
        for batch in slices(batches, text_col):
            texts = [
                grams(t, seen) if t and learned.languages and _LETTER.search(t) else none
                for t in batch.column(text_col).to_pylist()
            ]
            scores = learned.scores(texts)
            best = scores.argmax(axis=1) if learned.languages else []
            names = [learned.languages[k] if len(t) else UNKNOWN for t, k in zip(texts, best, strict=False)]
            names += [UNKNOWN] * (len(texts) - len(names))
            top = np.clip(scores.max(axis=1, initial=0), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(top, pa.float64())],
                names=[*batch.schema.names, lang_out, score_out],
            )

    return kept.mapInArrow(run, schema)


def held_out(id_col: str, folds: int, held: int) -> Column:
    """Whether the row is kept from learning; rows without an id always are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(True))
