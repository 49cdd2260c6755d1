"""Fuzzy name matching by the Ratcliff-Obershelp ratio."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.operators import blocks, metric_blocks
from trackweave.operators.ranking import keep_first
from trackweave.session import materialize, ship_package

THRESHOLD = 0.8
NAME_WEIGHT = 0.7
ARTIST_WEIGHT = 0.3
# Allowance for rounding when candidates are ruled out by an upper bound.
EPSILON = 1e-9
# Bits of a text's characters, and pairs whose bounds are held at once in a task.
MAX_BITS = 256
PAIRS = 2_000_000
# Names in one band differ in length by a quarter at most.
BAND = 1.25


def match_names(
    queries: DataFrame,
    catalogue: DataFrame,
    threshold: float = THRESHOLD,
    key: str = "track_id",
    name: str = "track_name",
    artist: str = "artist_name",
    broadcast_rows: int = blocks.BROADCAST_ROWS,
    block_rows: int = blocks.CATALOGUE_BLOCK_ROWS,
    autojunk: bool = False,
) -> DataFrame:
    """``query_id, matched_id, score``: the best catalogue row at or above the threshold.

    With an artist the score is 0.7 name + 0.3 artist. Equal scores: lowest id. The catalogue is first
    reduced to distinct (name, artist) pairs with their lowest id, so copies are scored once, and to
    names whose length can reach the threshold at all; many queries meet only the bands of lengths that can reach
    theirs. The characters that two names share bound their ratio, and only pairs whose bound reaches the threshold are
    compared. Equal queries are answered once; every task returns one row per distinct query. ``autojunk`` leaves frequent characters of candidates of 200 or more
    characters out of the comparison, as difflib does by default.
    """
    asked = queries.select(
        "query_id", F.lower(F.col(name)).alias("_name"), F.coalesce(F.lower(F.col(artist)), F.lit("")).alias("_artist")
    ).filter(F.col("_name") != "")
    wanted = asked.select(F.col("_name").alias("asked_name"), F.col("_artist").alias("asked_artist")).distinct()
    pairs = (
        catalogue.select(
            F.col(key).alias("matched_id"),
            F.lower(F.col(name)).alias("_name"),
            F.coalesce(F.lower(F.col(artist)), F.lit("")).alias("_artist"),
        )
        .filter(F.col("_name").isNotNull())
        .groupBy("_name", "_artist")
        .agg(F.min("matched_id").alias("matched_id"))
    )
    schema = T.StructType(
        [
            T.StructField("asked_name", T.StringType()),
            T.StructField("asked_artist", T.StringType()),
            T.StructField("matched_id", catalogue.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    ship_package(queries.sparkSession)
    small, wanted = blocks.small_or_stored(wanted, broadcast_rows)
    if small is not None:
        # Comparing is long work on few bytes, so the number of tasks is stated.
        reachable = _reachable_length(small, threshold) if small.num_rows else F.lit(False)
        shared = catalogue.sparkSession.sparkContext.broadcast(small)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _best(shared.value, (pa.Table.from_batches([b]) for b in batches), threshold, autojunk).to_batches()

        partial = pairs.filter(reachable).repartition(_tasks(queries.sparkSession)).mapInArrow(scan, schema)
    else:
        pairs = materialize(pairs)
        wanted, pairs = _by_length(wanted, pairs, threshold, block_rows)
        cell = lambda left, right: _best(left, [right], threshold, autojunk)
        partial, _ = metric_blocks.meet(wanted, pairs, F.struct("asked_name", "asked_artist"), broadcast_rows, cell, schema)
    found = keep_first(partial, ["asked_name", "asked_artist"], [F.col("score").desc(), F.col("matched_id")])
    same = (F.col("_name") == F.col("asked_name")) & (F.col("_artist") == F.col("asked_artist"))
    return asked.join(found, same).select("query_id", "matched_id", "score")


def _tasks(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _reachable_length(queries: pa.Table, threshold: float):
    """Candidate lengths that can still score: the ratio is at most 2 min(a, b) / (a + b)."""
    with_artist = any(queries.column("asked_artist").to_pylist())
    least = (threshold - ARTIST_WEIGHT) / NAME_WEIGHT if with_artist else threshold
    lengths = [len(text) for text in queries.column("asked_name").to_pylist()]
    if least <= 0:
        return F.lit(True)
    return F.length("_name").between(
        int(min(lengths) * least / (2 - least)), int(max(lengths) * (2 - least) / least) + 1
    )


def _band(length: Column) -> Column:
    """Number of the band of lengths; empty names have a band of their own."""
    return F.when(length > 0, F.floor(F.log(length) / math.log(BAND)) + 1).otherwise(0).cast("long")


def _by_length(wanted: DataFrame, pairs: DataFrame, threshold: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the ``_block`` they meet in: parts of bounded size of every band of lengths that a query can reach."""
    pairs = pairs.withColumn("_band", _band(F.length("_name")))
    bands = pairs.groupBy("_band").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_parts"))
    # A row per band: some sixty for names of a million characters.
    bands = F.broadcast(materialize(bands.withColumn("_first", F.col("_band") * (1 << 40))))
    # One popular name with many artists is dealt to many parts.
    part = F.pmod(F.xxhash64("_name", "_artist"), F.col("_parts"))
    pairs = pairs.join(bands, "_band").withColumn("_block", F.col("_first") + part).drop("_band", "_parts", "_first")
    length = F.length("asked_name")
    least = F.when(F.col("asked_artist") != "", (threshold - ARTIST_WEIGHT) / NAME_WEIGHT).otherwise(threshold)
    shortest = F.when(least > 0, F.floor(length * least / (2 - least))).otherwise(0)
    longest = F.when(least > 0, F.ceil(length * (2 - least) / least) + 1).otherwise(1 << 31)
    reach = F.sequence(_band(shortest), _band(longest))
    wanted = wanted.withColumn("_band", F.explode(reach)).join(bands, "_band")
    block = F.explode(F.sequence("_first", F.col("_first") + F.col("_parts") - 1))
    return wanted.withColumn("_block", block).drop("_band", "_parts", "_first"), pairs


class _Tokens:
    """Texts as sets of (character, occurrence): two texts share as many of them as a matching of their characters can have.

    The tokens that most queries have get a bit each, so shared ones are counted on whole words; those beyond the bits
    count as shared as far as both texts have any. So the count is never too low.
    """

    def __init__(self, texts: Sequence[str]):
        counts = Counter(token for text in texts for token in self.of(text))
        common = [token for token, _ in counts.most_common()]
        self.bits = {token: place for place, token in enumerate(common[:MAX_BITS])}
        self.beyond = set(common[MAX_BITS:])
        self.words = max(1, -(-len(self.bits) // 64))

    @staticmethod
    def of(text: str) -> Iterator[tuple[str, int]]:
        seen: dict[str, int] = {}
        for character in text:
            seen[character] = seen.get(character, 0) + 1
            yield character, seen[character]

    def coded(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits, tokens beyond them, lengths. Tokens that no query has cannot be shared and need neither."""
        rows, places, beyond = [], [], np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts):
            for token in self.of(text):
                place = self.bits.get(token)
                if place is not None:
                    rows.append(row)
                    places.append(place)
                elif token in self.beyond:
                    beyond[row] += 1
        set_bits = np.zeros((len(texts), 64 * self.words), np.uint8)
        set_bits[rows, places] = 1
        packed = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(len(texts), self.words)
        return packed, beyond, np.array([len(text) for text in texts], np.int64)


def _highest_ratios(left, right) -> np.ndarray:
    """Upper bounds of the ratio for all pairs of two coded lists of texts."""
    (a, over_a, len_a), (b, over_b, len_b) = left, right
    shared = np.minimum(over_a[:, None], over_b[None, :])
    for word in range(a.shape[1]):
        shared = shared + np.bitwise_count(a[:, None, word] & b[None, :, word])
    total = len_a[:, None] + len_b[None, :]
    # Two empty texts are equal.
    return np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)


class _Chunk:
    """Candidates of one batch: distinct names and artists, coded, and the rows of each name."""

    def __init__(self, chunk: pa.Table, names: _Tokens, artists: _Tokens):
        self.ids = chunk.column("matched_id").to_pylist()
        coded = chunk.column("_name").combine_chunks().dictionary_encode()
        self.names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.coded_names = names.coded(self.names)
        order = np.argsort(codes, kind="stable")
        self.rows = np.split(order, np.searchsorted(codes[order], np.arange(1, len(self.names))))
        coded = chunk.column("_artist").combine_chunks().dictionary_encode()
        self.artists, self.artist_of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.artist_tokens = artists
        self._coded_artists = None
        self._known: dict[str, np.ndarray] = {}

    def highest_artist_ratios(self, artist: str) -> np.ndarray:
        """Bounds for all rows; once per artist that is asked for."""
        if artist not in self._known:
            if self._coded_artists is None:
                self._coded_artists = self.artist_tokens.coded(self.artists)
            bounds = _highest_ratios(self.artist_tokens.coded([artist]), self._coded_artists)[0]
            if len(self._known) > 1000:
                self._known.clear()
            self._known[artist] = bounds[self.artist_of]
        return self._known[artist]


def _ratio(text: str, candidate: str, autojunk: bool) -> float:
    return SequenceMatcher(None, text, candidate, autojunk).ratio()


def _best(queries: pa.Table, chunks, threshold: float, autojunk: bool) -> pa.Table:
    """Best pair per query of this task.

    Shared characters bound the ratio of every pair of names; texts are compared only where the bound reaches the threshold,
    highest bound first, until no bound left can beat the best score found.
    """
    asked: dict[str, list[tuple[int, str | None]]] = {}
    for place, (name, artist) in enumerate(
        zip(queries.column("asked_name").to_pylist(), queries.column("asked_artist").to_pylist())
    ):
        asked.setdefault(name, []).append((place, artist))
    texts = list(asked)
    names = _Tokens(texts)
    artists = _Tokens(sorted({artist for group in asked.values() for _, artist in group if artist}))
    coded = names.coded(texts)
    best: dict[int, tuple[float, object]] = {}
    id_type = pa.null()
    for table in chunks:
        id_type = table.column("matched_id").type
        if not table.num_rows or not texts:
            continue
        chunk = _Chunk(table, names, artists)
        step = max(1, PAIRS // len(chunk.names))
        for start in range(0, len(texts), step):
            bounds = _highest_ratios([part[start : start + step] for part in coded], chunk.coded_names)
            for row, name in enumerate(texts[start : start + step]):
                _answer(name, asked[name], bounds[row], chunk, best, threshold, autojunk)
    hits = sorted(best)
    return pa.table(
        [
            *queries.select(["asked_name", "asked_artist"]).take(pa.array(hits, pa.int64())).columns,
            pa.array([best[place][1] for place in hits], id_type),
            pa.array([best[place][0] for place in hits], pa.float64()),
        ],
        names=["asked_name", "asked_artist", "matched_id", "score"],
    )


def _answer(name, group, bounds, chunk: _Chunk, best: dict, threshold: float, autojunk: bool) -> None:
    """Put into ``best`` what the chunk has for one name and the artists asked for with it."""

    def needed(place: int) -> float:
        return max(threshold, best[place][0] if place in best else 0.0) - EPSILON

    def keep(place: int, score: float, found) -> None:
        if score >= threshold and (place not in best or score > best[place][0] or (score == best[place][0] and found < best[place][1])):
            best[place] = (score, found)

    plain = [place for place, artist in group if not artist]
    with_artist = [(place, artist) for place, artist in group if artist]
    least = threshold if not with_artist else (threshold - ARTIST_WEIGHT) / NAME_WEIGHT
    likely = np.flatnonzero(bounds >= least - EPSILON)
    for candidate in likely[np.argsort(-bounds[likely], kind="stable")]:
        bound = bounds[candidate]
        open_plain = [place for place in plain if bound >= needed(place)]
        open_artist = [(place, a) for place, a in with_artist if bound * NAME_WEIGHT + ARTIST_WEIGHT >= needed(place)]
        if not open_plain and not open_artist:
            break
        rows = chunk.rows[candidate]
        score = _ratio(name, chunk.names[candidate], autojunk)
        if open_plain:
            first = min(chunk.ids[i] for i in rows)
            for place in open_plain:
                keep(place, score, first)
        for place, artist in open_artist:
            highest = score * NAME_WEIGHT + chunk.highest_artist_ratios(artist)[rows] * ARTIST_WEIGHT
            # Falling bounds, so the first that cannot win ends it; the artist's exact ratio once per artist.
            known: dict[int, float] = {}
            for at in np.argsort(-highest, kind="stable"):
                if highest[at] < needed(place):
                    break
                partner = int(chunk.artist_of[rows[at]])
                if partner not in known:
                    known[partner] = _ratio(artist, chunk.artists[partner], autojunk)
                keep(place, score * NAME_WEIGHT + known[partner] * ARTIST_WEIGHT, chunk.ids[rows[at]])
