"""Language identification by words first, backing off to shorter and shorter character n-grams.

Training counts words and, with a mark at either end of the word, character n-grams of up to ``longest``
letters by language. A known word adds its log frequency in each language. An unseen word is scored by the
longest n-grams of which the model knows any, else by the next shorter, down to single letters; nothing is
added if no letter is known. The language with the largest sum wins, the first in alphabetical order on a tie;
its share under a softmax of the mean per word, times at most ``evidence`` words, is the score.

The model is fitted on a bounded sample of labelled rows, ``max_training_rows``, taken by a hash of the id, and
holds at most ``max_entries`` words and as many n-grams of each length; it is broadcast, as its size does
not grow with the data. Prediction reads whole texts, in one pass and without a shuffle.

Cases: null text, or text without a letter, is ``und`` with score 0, as is any text if nothing was learned;
rows with a null language or text are not learned from; a null id counts as the empty string for the fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def ngrams(word: str, n: int) -> list[str]:
    """Character n-grams of the marked word; n = 1 gives its letters."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counts(rows: DataFrame, longest: int) -> DataFrame:
    """(order, gram, lang, n), order 0 for words, summed in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
            total: Counter = Counter()
            for lang, found in words.items():
                for word, n in found.items():
                    total[0, word, lang] += n
                    for k in range(1, longest + 1):
                        for g in ngrams(word, k):
                            total[k, g, lang] += n
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(total.values(), pa.int64())],
                names=["level", "gram", "lang", "n"],
            )

    return rows.mapInArrow(run, "level int, gram string, lang string, n long").groupBy("level", "gram", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies by language, with add-``alpha`` smoothing."""

    def __init__(self, rows: list[tuple[int, str, dict[str, int]]], totals: dict[tuple[int, str], int], longest: int, alpha: float = 0.5):
        self.languages = sorted({lang for _, _, by in rows for lang in by})
        self.longest = longest
        size: Counter = Counter(level for level, _, _ in rows)
        self.tables: list[dict[str, tuple[float, ...]]] = [{} for _ in range(longest + 1)]
        for level, gram, by in rows:
            self.tables[level][gram] = tuple(math.log((by.get(x, 0) + alpha) / (totals.get((level, x), 0) + alpha * size[level])) for x in self.languages)

    def word(self, word: str) -> tuple[float, ...] | None:
        """Scores of one word by language; None if no letter of it is known."""
        if (known := self.tables[0].get(word)) is not None:
            return known
        for n in range(min(self.longest, len(word) + 2), 0, -1):
            table = self.tables[n]
            if found := [s for g in ngrams(word, n) if (s := table.get(g)) is not None]:
                return tuple(sum(x) / len(found) for x in zip(*found, strict=True))
        return None


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, max_training_rows: int = 6_000, max_entries: int = 60_000, longest: int = 4) -> Model:
    """Fit on rows outside the held-out fold. The sample is bounded; its rows are those with the smallest hashes, near enough."""
    labelled = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, folds) != held_out))
    rows = labelled.select(lang_col).count()
    if rows > max_training_rows:
        share = max_training_rows / rows
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit("train"), id_col), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = written(_counts(labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), longest), "gram-counts")
    totals = {(r.level, r.lang): r.n for r in counts.groupBy("level", "lang").agg(F.sum("n").alias("n")).collect()}
    grams = counts.groupBy("level", "gram").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    kept: list[tuple[int, str, dict[str, int]]] = []
    for level in range(longest + 1):
        top = grams.filter(F.col("level") == level).orderBy(F.desc("total"), "gram").limit(max_entries)
        kept += [(level, r.gram, r.by) for r in top.collect()]
    return Model(kept, totals, longest)


class Predictor:
    def __init__(self, model: Model, evidence: int = 20, memo_entries: int = 300_000):
        self.model, self.evidence, self._entries = model, evidence, memo_entries
        self._memo: dict[str, tuple[float, ...] | None] = {}

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(_WORD.findall((text or "").lower()))
        # numerals such as fractions are word characters, too, but no letters
        if not self.model.languages or not any(w.isalpha() or any(map(str.isalpha, w)) for w in found):
            return UNDETERMINED, 0.0
        if len(self._memo) > self._entries:
            self._memo = {}
        memo, word = self._memo, self.model.word
        sums, seen = [0.0] * len(self.model.languages), 0
        for w, n in found.items():
            try:
                scores = memo[w]
            except KeyError:
                scores = memo[w] = word(w)
            if scores is not None:
                seen += n
                for i, s in enumerate(scores):
                    sums[i] += n * s
        scale = min(seen, self.evidence) / seen if seen else 0.0
        best = max(range(len(sums)), key=lambda i: sums[i])
        return self.model.languages[best], 1.0 / sum(math.exp((s - sums[best]) * scale) for s in sums)


def with_language(df: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the predicted language and its score, in columns named by ``into``, which ``df`` must not have."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            said = [predictor.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], names=[*names, *into])

    return df.mapInArrow(run, f"{schema}, `{into[0]}` string, `{into[1]}` double")


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training: int) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, lang_pred, score."""
    model = train(df, id_col, text_col, lang_col, **training)
    held = (fold(id_col) == 2).alias("held_out")
    rows = df.select(F.col(id_col).alias("doc_id"), held, F.col(text_col).cast("string").alias("text"))
    return with_language(rows, model).drop("text")
