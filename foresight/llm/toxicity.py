"""Toxicity scores from a learned lexicon, misspellings included, and the context of its hits.

The lexicon holds words, and beginnings shared by several words, that labelled toxic texts hold far
more often than clean ones. Words that miss the lexicon are tried for misspelled terms with a
Levenshtein automaton on the lexicon's trie. Hits count by kind, apart for quoted ones, together
with how the words around them lean, and a logistic regression weighs the counts.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresight.llm.arrow import slices
from foresight.llm.levenshtein import Trie
from foresight.llm.workspace import Workspace

#: Candidates whose contexts are counted in one pass over the texts; more take more passes.
CANDIDATES_PER_PASS = 100_000
#: About as many texts fit the regression.
FIT_ROWS = 20_000
#: Slots that all words share by hash; each holds how its words lean. The table has this size in every corpus.
CONTEXT_SLOTS = 1 << 18
#: Texts that a slot is taken to have seen at the labels' own rate before any is counted.
PRIOR_TEXTS = 10.0
#: How sure (G statistic) and how one-sided (share of toxic texts, at equal numbers) a term must be.
SURE_TERM, SURE_PREFIX, ONE_SIDED = 25.0, 40.0, 0.9
PREFIX_LENGTHS = (4, 5, 6, 7)
#: Words on either side of a hit that are its context.
WINDOW = 5
_CACHE = 500_000
_FLUSH = 200_000
_WORD = re.compile(r"[^\W\d_]+")
#: Which marks each mark closes; one that closes nothing opens.
_CLOSES = {'"': '"', "“": "„", "”": "“„”", "„": "", "«": "»", "»": "«»"}
_QUOTE = re.compile("[" + "".join(_CLOSES) + "\n]")
_WORDS_AT_ONCE = 1 << 18


def _words(text: str) -> Iterator[list[str]]:
    """The words of a text, in lists of bounded length."""
    if len(text) <= 1 << 21:
        yield _WORD.findall(text)
        return
    found = (m.group() for m in _WORD.finditer(text))
    while block := list(islice(found, _WORDS_AT_ONCE)):
        yield block


def allowed_edits(term: str) -> int:
    """Short terms must be spelled right; longer ones may have one or two letters wrong."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def quotations(text: str) -> list[tuple[int, int]]:
    """(opening, closing) places of the outermost quotations, in order; each lies on one line.

    A mark closes the latest open one that it fits, and what was opened in between; a mark that
    fits none opens, and one that is never closed quotes nothing.
    """
    found: list[tuple[int, int]] = []
    opened: dict[str, int] = {}
    for m in _QUOTE.finditer(text):
        mark, at = m.group(), m.start()
        if mark == "\n":
            opened.clear()
            continue
        fits = [opened[q] for q in _CLOSES[mark] if q in opened]
        if not fits:
            opened.setdefault(mark, at)
            continue
        start = max(fits)
        opened = {q: place for q, place in opened.items() if place < start}
        while found and found[-1][0] >= start:
            found.pop()
        found.append((start, at))
    return found


@dataclass(frozen=True)
class Leans:
    """How the words of each slot lean: above 0 where toxic texts hold them more often. Every word has a slot."""

    slots: np.ndarray

    def get(self, word: str) -> float:
        return float(self.slots[zlib.crc32(word.encode()) % len(self.slots)])


@dataclass
class ToxicModel:
    terms: set[str]
    prefixes: set[str]
    context: Leans | dict[str, float]
    weights: np.ndarray  # intercept first
    _trie: Trie | None = field(default=None, repr=False)
    _known: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trie": None, "_known": {}}

    def kind(self, word: str) -> int:
        """0: no hit, 1: term, 2: beginning, 3: misspelled term."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= _CACHE:
                self._known.clear()
            found = self._known[word] = self._kind(word)
        return found

    def _kind(self, word: str) -> int:
        if word in self.terms:
            return 1
        if any(word[:n] in self.prefixes for n in PREFIX_LENGTHS):
            return 2
        if self._trie is None:
            self._trie = Trie((t, allowed_edits(t)) for t in sorted(self.terms))
        if len(word) > self._trie.depth + self._trie.most:
            return 0  # no term is as near as that
        return 3 if self._trie.distance(word) is not None else 0

    def features(self, text: str | None) -> list[float]:
        """Logs of unquoted hits by kind and of quoted hits, whether there is any, context, density."""
        low = (text or "").lower()
        counts, quoted, lean, n_words = [0, 0, 0, 0], 0, [], 0
        for words in _words(low):
            n_words += len(words)
            hits = {w for w in set(words) if self.kind(w)}
            if not hits:
                continue
            for place, word in enumerate(words):
                if word in hits:
                    counts[self.kind(word)] += 1
                    around = words[max(0, place - WINDOW) : place] + words[place + 1 : place + 1 + WINDOW]
                    known = [self.context.get(w) for w in around if w not in hits]
                    known = [x for x in known if x is not None]
                    lean.append(sum(known) / len(known) if known else 0.0)
        quotes = quotations(low) if sum(counts) else []
        if quotes:
            for m in _WORD.finditer(low):
                kind = self.kind(m.group())
                if kind:
                    place = bisect_right(quotes, (m.start(), len(low))) - 1
                    if place >= 0 and m.start() < quotes[place][1]:
                        quoted += 1
                        counts[kind] -= 1
        plain = sum(counts[1:])
        return [
            *(math.log1p(c) for c in counts[1:]),
            math.log1p(quoted),
            float(counts[1] + counts[2] > 0),
            sum(lean) / len(lean) if lean else 0.0,
            math.log1p(100 * plain / n_words) if n_words else 0.0,
        ]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold a word, by label, folded before the shuffle."""
    tables: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        words = list(tables[0].keys() | tables[1].keys())
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.string()),
                pa.array([tables[1][w] for w in words], pa.int64()),
                pa.array([tables[0][w] for w in words], pa.int64()),
            ],
            names=["word", "toxic", "clean"],
        )
        tables[0].clear()
        tables[1].clear()
        return out

    for batch in slices(batches, "text"):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own: set[str] = set()
            for words in _words((text or "").lower()):
                own.update(words)
            tables[toxic].update(own)
            if len(tables[0]) + len(tables[1]) > _FLUSH:
                yield flush()
    yield flush()


def _count_contexts(candidates):
    """(key, context, toxic) of candidate words and beginnings; the context is the words on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, prefixes = candidates.value
        rows: set[tuple[str, int, int]] = set()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)],
                names=["key", "context", "toxic"],
            )

        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for words in _words((text or "").lower()):
                    keys = {w: [w] if w in terms else [] for w in set(words)}
                    for w, own in keys.items():
                        own += [f"{w[:n]}*" for n in PREFIX_LENGTHS if w[:n] in prefixes and len(w) > n]
                    for place, word in enumerate(words):
                        if keys[word]:
                            around = f"{words[place - 1] if place else ''} {words[place + 1] if place + 1 < len(words) else ''}"
                            mark = int.from_bytes(blake2b(around.encode(), digest_size=8).digest(), "little", signed=True)
                            rows.update((key, mark, toxic) for key in keys[word])
                            if len(rows) > _FLUSH:
                                yield flush()
        yield flush()

    return run


def _context_counts(rows: DataFrame, candidates: DataFrame, space: Workspace, at_once: int) -> DataFrame:
    """(key, toxic, clean): distinct contexts of every candidate; each pass ships one part of them."""
    spark = rows.sparkSession
    passes = max(1, math.ceil(candidates.count() / at_once))
    part = F.pmod(F.xxhash64("key", F.lit(9)), F.lit(passes))
    for turn in range(passes):
        keys = [r["key"] for r in candidates.filter(part == turn).collect()]
        shipped = spark.sparkContext.broadcast(
            ({k for k in keys if not k.endswith("*")}, {k[:-1] for k in keys if k.endswith("*")})
        )
        (
            rows.select("text", "toxic")
            .mapInArrow(_count_contexts(shipped), "key string, context bigint, toxic int")
            .distinct()
            .groupBy("key")
            .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
            .write.mode("append")
            .parquet(f"{space.root}/contexts")
        )
        shipped.destroy()
    return spark.read.schema("key string, toxic bigint, clean bigint").parquet(f"{space.root}/contexts")


def _evidence(n_toxic: int, n_clean: int) -> tuple[Column, Column]:
    """G statistic against equal rates, and the toxic share had both labels equally many texts."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    base = n_toxic / (n_toxic + n_clean)

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    g = 2 * (part(a, (a + b) * base) + part(b, (a + b) * (1 - base)))
    toxic_rate, clean_rate = a / n_toxic, b / n_clean
    return g, toxic_rate / (toxic_rate + clean_rate)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, toxic): labelled texts; an id with several labels is toxic if at least half say so.

    Texts and labels meet by id in one merge join at every size, so nothing is broadcast and the work is one
    shuffle of the texts; AQE splits an id that many texts carry, since each id has one label row.
    """
    marks = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("toxic"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(marks.hint("merge"), "id")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
    candidates_per_pass: int = CANDIDATES_PER_PASS,
) -> ToxicModel:
    """Learn lexicon and weights from the labelled rows given.

    Word counts cover all of them, in two rounds: words and beginnings that many more toxic texts hold
    are candidates, and they are proved by the number of different neighbouring words. A text that is
    copied a thousand times brings each word in one context only. Every candidate is tried, in as many
    passes as they take, and every proved one is kept. Context is how words of all kinds lean, by slots
    that words share by hash. The regression takes about ``fit_rows`` texts, picked by the hash of id and
    text; equal ones count together. Null and empty texts count as texts without words. With one label only, or none at all, every
    score is that label's rate (0 without labels).
    """
    space = Workspace(docs.sparkSession, "toxicity")
    train = training_rows(docs, labels, id_col, text_col, label_col)
    rows = space.put(train, "train")
    sums = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n_toxic, n_clean = sums["t"] or 0, sums["n"] - (sums["t"] or 0)
    if not n_toxic or not n_clean:
        edge = 30.0 if n_toxic else -30.0
        return ToxicModel(set(), set(), {}, np.array([edge] + [0.0] * 7))
    counted = rows.select("text", "toxic").mapInArrow(_count_words, "word string, toxic bigint, clean bigint")
    words = space.put(
        counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words"
    )
    g, share = _evidence(n_toxic, n_clean)
    sure = words.filter((share >= ONE_SIDED) & (g >= SURE_TERM))
    starts = F.array(
        *[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in PREFIX_LENGTHS]
    )
    families = (
        words.select(F.explode(F.array_compact(starts)).alias("prefix"), "toxic", "clean")
        .groupBy("prefix")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("n"))
        .filter((F.col("n") >= 3) & (share >= ONE_SIDED) & (g >= SURE_PREFIX))
    )
    candidates = space.put(
        sure.select(F.col("word").alias("key")).union(families.select(F.concat("prefix", F.lit("*")))), "candidates"
    )
    contexts = _context_counts(rows, candidates, space, candidates_per_pass)
    is_prefix = F.col("key").endswith("*")
    enough = g >= F.when(is_prefix, SURE_PREFIX).otherwise(SURE_TERM)
    proved = space.put(contexts.filter((share >= ONE_SIDED) & enough), "proved")
    keys = [r["key"] for r in proved.collect()]
    terms = {k for k in keys if not k.endswith("*")}
    found = {k[:-1] for k in keys if k.endswith("*")}
    prefixes = {p for p in found if not any(p[:n] in found for n in PREFIX_LENGTHS if n < len(p))}
    terms = {t for t in terms if not any(t[:n] in prefixes for n in PREFIX_LENGTHS)}
    model = ToxicModel(terms, prefixes, _leans(words, proved, n_toxic, n_clean), np.zeros(8))
    share_taken = min(1.0, fit_rows / sums["n"])
    sample = rows.filter(
        F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(1 << 30)) < int(share_taken * (1 << 30)) + 1
    )
    table = with_features(sample, model, "text").groupBy("features", "toxic").agg(F.count("*").alias("n")).toArrow()
    space.drop("train", "words", "candidates", "contexts", "proved")
    features = np.array(table.column("features").to_pylist(), dtype=np.float64).reshape(-1, 7)
    order = np.lexsort(features.T)
    model.weights = _logistic(features[order], table.column("toxic").to_numpy()[order], table.column("n").to_numpy()[order])
    return model


def _leans(words: DataFrame, proved: DataFrame, n_toxic: int, n_clean: int) -> Leans:
    """Log odds of each slot against the labels' own, drawn to 0 where few texts are counted; terms take no part."""
    counts = (
        words.join(proved.select(F.col("key").alias("word")), "word", "left_anti")
        .groupBy((F.crc32("word") % CONTEXT_SLOTS).cast("int").alias("slot"))
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .toArrow()
    )
    toxic, clean = np.zeros(CONTEXT_SLOTS), np.zeros(CONTEXT_SLOTS)
    slots = counts.column("slot").to_numpy()
    toxic[slots], clean[slots] = counts.column("toxic").to_numpy(), counts.column("clean").to_numpy()
    rate = n_toxic / (n_toxic + n_clean)
    odds = (toxic + PRIOR_TEXTS * rate) / (clean + PRIOR_TEXTS * (1 - rate))
    return Leans(np.log(odds * (1 - rate) / rate).astype(np.float32))


def _logistic(features: np.ndarray, labels: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a small ridge on all but the intercept; a row counts as often as it occurs."""
    x = np.column_stack([np.ones(len(features)), features])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - labels)) + penalty @ w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def with_features(docs: DataFrame, model: ToxicModel, text_col: str) -> DataFrame:
    """Replace the text column by the array ``features``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the lexicon that was proved
    rest = [c for c in docs.columns if c not in (text_col, "features")]
    kept = docs.select(*[F.col(f"`{c}`") for c in [*rest, text_col]])
    schema = kept.withColumn("features", F.array(F.lit(0.0))).drop(text_col).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in slices(batches, text_col):
            rows = [learned.features(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(rows, pa.list_(pa.float64()))],
                names=[*rest, "features"],
            )

    return kept.mapInArrow(run, schema)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Replace the text column by ``score``, from the whole text and nothing else.

    Null and empty texts get the score of a text without hits. Equal texts score alike, an empty
    table gives an empty result, and a column with the name of the score is replaced.
    """
    w = [float(x) for x in model.weights]
    line = F.lit(w[0])
    for place, weight in enumerate(w[1:]):
        line = line + F.get("features", F.lit(place)) * weight
    line = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))
    rows = with_features(docs.drop(score_col), model, text_col)
    return rows.withColumn(score_col, 1 / (1 + F.exp(-line))).drop("features")


