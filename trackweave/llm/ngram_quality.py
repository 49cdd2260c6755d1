"""Quality by the perplexity of an interpolated modified Kneser-Ney model over characters, trained on trusted text.

Grams are packed into one number, ``CODE_BITS`` bits a character, so that a gram's context and its shorter grams are
shifts and masks, and all counts are aggregations and joins on numbers, dealt by the gram. Lower orders count the
different characters in front of a gram. Only grams that occur in the corpus are scored, each once: order by order, a
join adds the discounted count, one the weight of the context, and one the probability of the next lower order.

Models that each leave out one fold of the trusted text are trained together: the bits above a gram name the model, at
every order, so that counts, contexts and scores of different models never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import join_hot, located, stored
from trackweave.session import ship_package

ORDER = 5
CODE_BITS = 12
CODES = 1 << CODE_BITS
# Folds of the trusted documents, as many as models. Model 0, which judges, is trained without fold 0; each other one
# scores the fold that it is trained without, so that every trusted document counts for its language's threshold.
HELD_OUT = 5
MODEL_SHIFT = CODE_BITS * ORDER
MODEL_BITS = 7 << MODEL_SHIFT
QUANTILE = 0.995
MARGIN = 1.1
# Scored grams up to this number (12 bytes each) travel to the tasks; more are sent to the blocks that ask for them.
TRAVELLING_GRAMS = 4_000_000
TRAVELLING_IDS = 1_000_000
BLOCK_BYTES = 16 << 20
# Grams that a task holds before it counts them, and distinct ones before it passes them on.
PENDING_GRAMS, KNOWN_GRAMS = 2_000_000, 1_000_000


def codes(text: str | None) -> np.ndarray:
    """A number from 1 to 4095 per character; white space is one space however long, code points from 2048 on share numbers."""
    points = np.frombuffer(" ".join((text or "").split()).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return np.where(points < 2048, np.maximum(points, 1), 2048 + points % 2039)


def grams(text: str | None) -> np.ndarray:
    """For each character the packed gram that it ends, with zeros before the start."""
    own = codes(text)
    packed = own.copy()
    for back in range(1, min(ORDER, len(own) + 1)):
        packed[back:] |= own[:-back] << (CODE_BITS * back)
    return packed


class _Gathered:
    """Distinct grams with their counts, in bounded memory: ``add`` gives back what must be passed on."""

    def __init__(self) -> None:
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.known = pd.Series(dtype=np.int64)

    def add(self, some: np.ndarray) -> pa.RecordBatch | None:
        self.pending.append(some)
        self.waiting += len(some)
        if self.waiting < PENDING_GRAMS:
            return None
        self.merge()
        return self.rows() if len(self.known) >= KNOWN_GRAMS else None

    def merge(self) -> None:
        if self.pending:
            counts = pd.Series(np.concatenate(self.pending)).value_counts(sort=False)
            both = pd.concat([self.known, counts]) if len(self.known) else counts
            self.known = both.groupby(level=0, sort=False).sum()
            self.pending, self.waiting = [], 0

    def rows(self) -> pa.RecordBatch:
        self.merge()
        gram, n = self.known.index.to_numpy(dtype=np.int64), self.known.to_numpy(dtype=np.int64)
        self.known = pd.Series(dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])


def _grams_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Per row its text's grams, marked with the row's model if it has one."""
    models = batch.column("_model").to_pylist() if "_model" in batch.schema.names else [0] * batch.num_rows
    for text, model in zip(batch.column("_text"), models, strict=True):
        yield grams(text.as_py()) | (model << MODEL_SHIFT)


def _mapped(rows: DataFrame) -> DataFrame:
    """``gram, n``: marked grams of the texts, counted within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered()
        for batch in batches:
            for own in _grams_of(batch):
                full = gathered.add(own)
                if full is not None:
                    yield full
        yield gathered.rows()

    return rows.select(*_text_columns(rows)).mapInArrow(run, "gram long, n long")


def _text_columns(rows: DataFrame) -> list[str]:
    return [name for name in ("_model", "_text") if name in rows.columns]


def model_of(gram: str) -> Column:
    return F.shiftright(gram, MODEL_SHIFT)


def suffix(gram: str, order: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit(MODEL_BITS | ((1 << (CODE_BITS * order)) - 1)))


def context(gram: str) -> Column:
    own = F.shiftright(F.col(gram).bitwiseAND(F.lit((1 << MODEL_SHIFT) - 1)), CODE_BITS)
    return own.bitwiseOR(F.col(gram).bitwiseAND(F.lit(MODEL_BITS)))


@dataclass(frozen=True)
class KneserNey:
    """Per order 1 to ``ORDER``: ``gram, share`` (discounted count over the context's), and ``context, weight``."""

    shares: dict[int, DataFrame]
    weights: dict[int, DataFrame]

    @staticmethod
    def train(by_fold: DataFrame) -> KneserNey:
        """From ``gram, n`` with the fold in the place of the model: model k is trained on all folds but k.

        A model without texts finds every character equally likely.
        """
        fold = model_of("gram")
        own = [F.sum(F.when(fold == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(HELD_OUT)]
        bare = F.col("gram").bitwiseAND(F.lit((1 << MODEL_SHIFT) - 1))
        summed = by_fold.groupBy(bare.alias("_gram")).agg(*own, F.sum("n").alias("total"))
        marked = [
            F.struct(F.col("_gram").bitwiseOR(F.lit(k << MODEL_SHIFT)).alias("gram"), (F.col("total") - F.col(f"n{k}")).alias("n"))
            for k in range(HELD_OUT)
        ]
        counts = stored(summed.select(F.inline(F.array(*marked))).filter("n > 0"), "gram-counts")
        shares, weights = {}, {}
        for order in range(ORDER, 0, -1):
            discounts = _discounts(counts)
            limits = F.lit(None).cast("double")
            for model, (one, two, more) in discounts.items():
                limit = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
                limits = F.when(model_of("gram") == model, limit).otherwise(limits)
            of_context = counts.groupBy(context("gram").alias("context")).agg(
                F.sum("n").alias("total"),
                F.sum(limits).alias("taken"),
            )
            of_context = stored(of_context, "contexts")
            named = counts.withColumn("context", context("gram")).join(of_context, "context")
            shares[order] = named.select("gram", (F.greatest(F.col("n") - limits, F.lit(0.0)) / F.col("total")).alias("share"))
            weights[order] = of_context.select("context", (F.col("taken") / F.col("total")).alias("weight"))
            if order > 1:
                # Different characters in front.
                counts = counts.groupBy(suffix("gram", order - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
                counts = stored(counts, "continuations")
        return KneserNey(shares, weights)

    def scored(self, asked: DataFrame) -> DataFrame:
        """``gram, score`` (natural logarithm of the probability) for each distinct ``gram`` of ``asked``."""
        wanted = {ORDER: asked}
        for order in range(ORDER - 1, 0, -1):
            wanted[order] = stored(wanted[order + 1].select(suffix("gram", order).alias("gram")).distinct(), "wanted")
        lower = None
        for order in range(1, ORDER + 1):
            rows = wanted[order].withColumn("context", context("gram"))
            rows = rows.join(self.shares[order], "gram", "left").join(self.weights[order], "context", "left")
            if lower is None:
                rows = rows.withColumn("below", F.lit(1.0 / CODES))
            else:
                rows = rows.withColumn("shorter", suffix("gram", order - 1)).join(
                    lower.select(F.col("gram").alias("shorter"), F.col("p").alias("below")), "shorter"
                )
            # A context never seen leaves all to the lower order.
            p = F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("below")
            lower = stored(rows.select("gram", p.alias("p")), "probabilities")
        return lower.select("gram", F.ln("p").cast("float").alias("score"))


def _discounts(counts: DataFrame) -> dict[int, list[float]]:
    """Per model the discounts of counts of 1, 2 and more, from how many grams were counted once to four times."""
    counted = [F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    found: dict[int, list[float]] = {}
    for model, *n in counts.groupBy(model_of("gram").alias("model")).agg(*counted).collect():  # a row a model
        found[model] = []
        for i in (1, 2, 3):
            if n[i - 1] and n[0]:
                y = n[0] / (n[0] + 2 * n[1])
                found[model].append(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05))
            else:
                found[model].append(0.5 * i)
    return found


def _sums(rows, index: pd.Index, score: np.ndarray) -> tuple[list[int], list[float]]:
    """Per row its text's characters and the sum of their scores; ``index`` holds all their grams."""
    counts, sums = [], []
    for own in _grams_of(rows):
        counts.append(len(own))
        sums.append(float(score[index.get_indexer(own)].sum(dtype=np.float64)) if len(own) else 0.0)
    return counts, sums


def perplexities(content: DataFrame, scores: DataFrame, travelling: int = TRAVELLING_GRAMS) -> DataFrame:
    """``_id, lang, n_symbols, perplexity`` per row of ``content``, by its ``_model`` or by model 0."""
    spark = content.sparkSession
    fields = [content.schema["_id"], content.schema["_lang"], T.StructField("n", T.LongType()), T.StructField("sum", T.DoubleType())]
    schema = T.StructType(fields)

    def out(rows, counts, sums) -> list:
        return [rows.column("_id"), rows.column("_lang"), pa.array(counts, pa.int64()), pa.array(sums, pa.float64())]

    if scores.count() <= travelling:
        table = scores.toArrow()
        shared = spark.sparkContext.broadcast((table.column("gram").to_numpy(), table.column("score").to_numpy()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gram, score = shared.value
            index = pd.Index(gram)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(out(batch, *_sums(batch, index, score)), schema.names)

        summed = content.select("_id", "_lang", *_text_columns(content)).mapInArrow(scan, schema)
    else:

        def look_up(texts, answers):
            index = pd.Index(answers.column("gram").to_numpy())
            found = _sums(texts, index, answers.column("score").to_numpy())
            return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out(texts, *found)], names=schema.names)

        pairs = stored(_block_grams(content), "block-grams")
        frequent = pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("blocks")).join(scores, "gram")
        answers = join_hot(pairs, frequent, ["gram"], "blocks", pairs.count(), "inner").drop("blocks")
        summed = content.select("block", "_id", "_lang", *_text_columns(content)).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(look_up, schema)
    perplexity = F.when(F.col("n") > 0, F.exp(-F.col("sum") / F.col("n")))
    return summed.select("_id", F.col("_lang").alias("lang"), F.col("n").alias("n_symbols"), perplexity.alias("perplexity"))


def _block_grams(content: DataFrame) -> DataFrame:
    """``block, gram``: the distinct grams of each block of neighbouring rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for block in np.unique(blocks):
                gram = pd.unique(np.concatenate(list(_grams_of(batch.filter(pa.array(blocks == block))))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), block)), pa.array(gram)], ["block", "gram"])

    return content.select("block", *_text_columns(content)).mapInArrow(run, "block long, gram long").distinct()


def _trusted(content: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """Rows of ``content`` that a label calls good and none calls bad or toxic."""
    told = labels.groupBy(F.col(id_column).alias("_id")).agg(F.min("quality").alias("good"), F.max("toxic").alias("toxic"))
    ids = stored(told.filter("good = 1 AND coalesce(toxic, 0) = 0").select("_id"), "trusted-ids")
    few = ids.count() <= TRAVELLING_IDS
    return content.join(F.broadcast(ids) if few else ids, "_id", "left_semi")


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    travelling: int = TRAVELLING_GRAMS,
) -> DataFrame:
    """``doc_id, lang, n_symbols, perplexity, threshold, kept``: one row per row of ``docs``.

    Trusted documents are those that ``labels`` (id, quality, toxic) call good and not toxic, dealt to ``HELD_OUT`` folds by the
    hash of the id. The model is trained on all of them but fold 0. The threshold of a language is ``margin`` times the
    quantile of the perplexities of all its own trusted documents, each scored by a model trained without its fold, however
    few they are. A language without a trusted document that has symbols has no threshold, and all its texts with symbols
    are kept; it is not judged by other languages. Null languages are one language. A null or empty text has no symbols and no
    perplexity and is not kept. Repeated rows are judged alike; an empty table gives no rows; of the other columns none is read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    named = {"_id": F.col(id_column), "_lang": F.col(lang_column), "_text": F.coalesce(F.col(text_column), F.lit(""))}
    content = located(docs, named)
    rows, size = content.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    block = F.xxhash64("_file", F.floor(F.col("_row") / max(1, int(BLOCK_BYTES * rows / max(1, size)))))
    content = content.withColumn("block", block)
    trusted = _trusted(content, labels, id_column).withColumn("_model", F.pmod(F.xxhash64("_id"), F.lit(HELD_OUT)).cast("int"))
    trusted = stored(trusted.filter(F.length("_text") > 0), "trusted")
    by_fold = stored(_mapped(trusted).groupBy("gram").agg(F.sum("n").alias("n")), "fold-counts")
    asked = stored(_mapped(content).select("gram").union(by_fold.select("gram")).distinct(), "asked-grams")
    scores = KneserNey.train(by_fold).scored(asked)
    scored = perplexities(content, scores.filter(model_of("gram") == 0), travelling)
    of_trusted = perplexities(trusted, scores.join(by_fold, "gram", "left_semi"), travelling)
    value = F.percentile_approx("perplexity", quantile, 10_000)
    by_language = of_trusted.filter(F.col("perplexity").isNotNull()).groupBy(F.col("lang").alias("_lang")).agg(value.alias("own"))
    by_language = stored(by_language, "thresholds")
    # A row per language; Spark chooses the join.
    joined = scored.join(by_language, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.col("own") * margin
    judged_rows = joined.select(F.col("_id").alias(id_column), "lang", "n_symbols", "perplexity", threshold.alias("threshold"))
    fine = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("threshold").isNull() & (F.col("n_symbols") > 0))
    return judged_rows.withColumn("kept", fine)
