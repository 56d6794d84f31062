"""Phrase collocation mining with compressed position bitmaps (operator 11).

Texts are cut into shards of about SHARD_BYTES, one language each, while they are read. In a shard every word has a bitmap of
the positions at which it stands, compressed as it is denser or sparser: packed bits, or a sorted list of set bits. A bitmap of
piece starts keeps phrases within pieces. A phrase's bitmap is shifted by one place, cleared at piece starts, and joined by AND
with the bitmaps of the words that may follow; the bits left are the longer phrase's occurrences, which are extended depth-first.
Popcounts are summed over shards.

A phrase of `least` occurrences needs not be frequent in any one shard, so shards learn first which word pairs can be: each
sums its pairs' popcounts in hash cells, cells are summed over shards, and cells below `least` are cut. Cells travel packed, those of one range
in a row: there are as many rows as shards times ranges at most, and never more than pairs. Phrases are extended by
pairs of the other cells only; what has hashed by chance into one of these is counted, and dropped by its own count.

Words are told apart in a shard by their text, and between shards by a 64-bit hash, which is made with another seed if two words
share one. Scores are integer quotients of exact decimal products.

Defined results: a null text counts as empty, a null lang as `und`; texts without words and empty tables give no rows; repeated
rows and null ids count as rows; other columns are ignored. Phrases of equal score and count are ranked by their bytes. A text
longer than a shard is one shard, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, U64, Rolling, give_back, mix, seeds, small_batches, spare2, stored, texts_of, trimmed, words_of

#: Bytes of text in a shard, and of all languages that a task has open.
SHARD_BYTES, OPEN_BYTES = 4 << 20, 8 << 20
#: Pairs are counted first in hash cells: ranges of about so many pairs, a task each, and in a range 2**CELL_BITS cells (32 at most).
RANGE_PAIRS, CELL_BITS = 1 << 21, 32
#: A bitmap that sets more than one in so many positions is packed.
DENSE = 32

#: Bytes that end a piece, and bytes outside words.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
OUTSIDE = ENDS.copy()
OUTSIDE[[0x20, 0x09]] = True

_SHARD = "shard bigint, lang string, size int, starts binary, words array<string>, ids array<bigint>, counts array<int>, bits binary"


def _packed(at: np.ndarray, size: int) -> np.ndarray:
    flags = np.zeros(-(-size // 64) * 64, bool)
    flags[at] = True
    return np.packbits(flags, bitorder="little").view("<u8")


def _shard(number: int, lang: str, texts: list[tuple[np.ndarray, np.ndarray]], roll: Rolling) -> pa.RecordBatch | None:
    """One shard's row: its words, their hashes, counts and bitmaps; None without words."""
    raw = np.concatenate([x for x, _ in texts])
    at = np.concatenate([[0], *(a[1:] + off for (_, a), off in zip(texts, np.cumsum([0, *(len(x) for x, _ in texts[:-1])])))])
    raw = LOWER[raw]
    start, end, doc = words_of(raw, at, OUTSIDE)
    size = len(start)
    if not size:
        return None
    ended = np.concatenate([[0], np.cumsum(ENDS[raw])])
    opens = np.ones(size, bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (ended[start[1:]] != ended[end[:-1]])
    letters = raw[~OUTSIDE[raw]]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    counts = np.bincount(code, minlength=len(words))
    order = np.argsort(code, kind="stable").astype("<i4")  # positions, word by word
    dense = counts * DENSE > size
    until = np.cumsum(counts)
    parts = [_packed(order[until[k] - counts[k] : until[k]], size).tobytes() for k in np.flatnonzero(dense)]
    parts.append(order[~dense[code[order]]].tobytes())
    at_word = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    prefix = roll.prefix(np.frombuffer(words.buffers()[2], np.uint8)[: at_word[-1]])
    seed = np.uint64(int(roll.ranges(roll.prefix(np.frombuffer(lang.encode() + b"\0", np.uint8)), np.array([0]), np.array([len(lang.encode()) + 1]))[0]))
    ids = mix(mix(roll.ranges(prefix, at_word[:-1], at_word[1:]) + (at_word[1:] - at_word[:-1]).astype(U64)) ^ seed).view(np.int64)
    lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x)
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([lang]), pa.array([size], pa.int32()), pa.array([_packed(np.flatnonzero(opens), size).tobytes()], pa.binary()), lists(words.cast(pa.large_string()).cast(pa.string())), lists(pa.array(ids)), lists(pa.array(counts, pa.int32())), pa.array([b"".join(parts)], pa.binary())],
        names=["shard", "lang", "size", "starts", "words", "ids", "counts", "bits"],
    )


def shards(docs: DataFrame, turn: int = 0) -> DataFrame:
    """The shards of all texts, a row each."""
    small_batches(docs.sparkSession)
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"), F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]):
        roll, made = Rolling(1100 + turn), 0
        open_, held, total = {}, {}, 0

        def close(lang: str):
            nonlocal made, total
            row = _shard((part << 32) + made, lang, open_.pop(lang), roll)
            total -= held.pop(lang)
            made += 1
            give_back()
            if row is not None:
                yield row

        part = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            langs = batch.column(1).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                raw, at = texts_of(batch.column(0).filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == k)))
                open_.setdefault(lang, []).append((raw, at))
                held[lang] = held.get(lang, 0) + len(raw)
                total += len(raw)
                if held[lang] >= SHARD_BYTES:
                    yield from close(lang)
            while total >= OPEN_BYTES or len(open_) > 1000:
                yield from close(max(held, key=held.get))
        for lang in list(open_):
            yield from close(lang)

    return rows.mapInArrow(trimmed(run), _SHARD)


class Bitmaps:
    """The words of a shard, by number; each position's bit is set in one word's bitmap."""

    def __init__(self, row: dict):
        self.size, self.ids, self.counts = row["size"], row["ids"], row["counts"]
        self.starts = np.frombuffer(row["starts"], "<u8")
        self.is_start = np.unpackbits(self.starts.view(np.uint8), count=self.size, bitorder="little").astype(bool)
        dense = np.flatnonzero(self.counts.astype(np.int64) * DENSE > self.size)
        width = len(self.starts)
        self.dense = dense
        self.packed = np.frombuffer(row["bits"], "<u8", len(dense) * width).reshape(len(dense), width)
        sparse = np.flatnonzero(self.counts.astype(np.int64) * DENSE <= self.size)
        #: Set bits of all sparse bitmaps, and which word each is of.
        self.set = np.frombuffer(row["bits"], "<i4", offset=len(dense) * width * 8)
        self.of = np.repeat(sparse, self.counts[sparse])
        #: The sparse word whose bit is set at a position, or -1.
        self.owner = np.full(self.size, -1, np.int64)
        self.owner[self.set] = self.of

    def shifted(self, bits: np.ndarray) -> np.ndarray:
        """Packed bits moved by one place, and cleared at piece starts."""
        out = bits << U64(1)
        out[1:] |= bits[:-1] >> U64(63)
        return out & ~self.starts

    def holds(self, bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (bits[at >> 6] >> (at & 63).astype(U64)) & U64(1) == 1

    def pairs(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """First words, second words, popcounts and, if some are wanted (first * words + second, sorted), positions of all pairs that occur."""
        words = len(self.ids)
        found: list[tuple] = []
        # Sparse first words: their set bits shifted, met by the sparse words' bits and by packed ones.
        inside = self.set + 1 < self.size
        after, first = self.set[inside].astype(np.int64) + 1, self.of[inside]
        keep = ~self.is_start[after]
        after, first = after[keep], first[keep]
        met = self.owner[after]
        found.append((first[met >= 0], met[met >= 0], after[met >= 0]))
        for k, w in enumerate(self.dense):
            hit = (met < 0) & self.holds(self.packed[k], after)
            found.append((first[hit], np.full(hit.sum(), w), after[hit]))
        # Packed first words.
        counted: list[tuple] = []
        for k, w in enumerate(self.dense):
            moved = self.shifted(self.packed[k])
            hit = self.holds(moved, self.set.astype(np.int64))
            found.append((np.full(hit.sum(), w), self.of[hit], self.set[hit].astype(np.int64)))
            for m, v in enumerate(self.dense):
                both = moved & self.packed[m]
                if wanted is None:
                    if n := int(np.bitwise_count(both).sum()):
                        counted.append((w, v, n))
                else:
                    at = np.flatnonzero(np.unpackbits(both.view(np.uint8), bitorder="little"))
                    found.append((np.full(len(at), w), np.full(len(at), v), at))
        a, b, at = (np.concatenate(x) for x in zip(*found))
        key = a * words + b
        if wanted is not None:
            where = np.minimum(np.searchsorted(wanted, key), max(0, len(wanted) - 1))
            keep = wanted[where] == key if len(wanted) else np.zeros(len(key), bool)
            key, at = key[keep], at[keep]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(cut, len(key)))
        one, two = key[cut] // words, key[cut] % words
        if wanted is None and counted:
            extra = np.array(counted, np.int64).T
            one, two, n = np.append(one, extra[0]), np.append(two, extra[1]), np.append(n, extra[2])
        return one, two, n, np.split(at, cut[1:]) if wanted is not None and len(cut) else []


def _rows(table: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    for k in range(table.num_rows):
        numbers = {c: table.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("ids", "counts")}
        yield numbers | {c: table.column(c)[k].as_py() for c in ("shard", "size", "starts", "bits")}


def cells(first: np.ndarray, second: np.ndarray, ranges: int) -> np.ndarray:
    """The hash cells of pairs of word hashes: a range in the upper half, a place of CELL_BITS bits in it in the lower half."""
    h = mix(mix(first.view(U64)) * U64(0x9E3779B97F4A7C15) + second.view(U64))
    return ((h >> U64(32)) % U64(ranges)) << U64(32) | h & U64((1 << CELL_BITS) - 1)


_CELLS = "shard bigint, range bigint, cells binary, counts binary"


def pair_cells(table: DataFrame, least: int, ranges: int) -> DataFrame:
    """shard, range, cells, counts: the popcounts of all pairs in hash cells, those of a range packed in a row.

    A count goes up to `least`, which is all that matters of it.
    """
    kind = "<u1" if least < 256 else "<u8"

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in _rows(batch):
                maps = Bitmaps(row)
                one, two, n, _ = maps.pairs()
                cell = cells(maps.ids[one], maps.ids[two], ranges)
                order = np.argsort(cell)
                cell, n = cell[order], n[order]
                first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
                n = np.minimum(np.add.reduceat(n, first), least).astype(kind) if len(first) else n.astype(kind)
                cell = cell[first]
                at = cell >> U64(32)
                cut = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at)) if len(at) else np.zeros(1, np.int64)
                low = cell.astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(cut) - 1, row["shard"])), pa.array(at[cut[:-1]].astype(np.int64)),
                    pa.array([low[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()), pa.array([n[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
                ], names=["shard", "range", "cells", "counts"])
                give_back()

    return table.select("shard", "size", "starts", "ids", "counts", "bits").mapInArrow(trimmed(run), _CELLS)


def alive_cells(found: DataFrame, least: int) -> DataFrame:
    """shard, range, cells: of each shard the cells that have at least `least` occurrences in all shards together; a range in a task."""
    kind = "<u1" if least < 256 else "<u8"

    def run(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(c, "<u4") for c in table.column("cells").to_pylist()]
        cell, n = np.concatenate(each), np.concatenate([np.frombuffer(c, kind) for c in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        first = np.append(True, cell[order][1:] != cell[order][:-1])
        total = np.add.reduceat(n[order], np.flatnonzero(first))
        alive = np.empty(len(cell), bool)
        alive[order] = (total >= least)[np.cumsum(first) - 1]
        parts = np.split(alive, np.cumsum([len(c) for c in each])[:-1])
        left = [c[keep].tobytes() for c, keep in zip(each, parts)]
        some = pa.array([bool(c) for c in left])
        return pa.table({"shard": table.column("shard"), "range": table.column("range"), "cells": pa.array(left, pa.binary())}).filter(some)

    return found.groupBy("range").applyInArrow(spare1(run), "shard bigint, range bigint, cells binary")


def spare1(run):
    """A function of a group that first gives back what the group before left."""

    def out(table: pa.Table) -> pa.Table:
        give_back()
        return run(table)

    return out


def grown(maps: Bitmaps, alive: np.ndarray, ranges: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of 2 to longest words as rows of word hashes, and their popcounts; alive: the sorted cells of pairs that may follow.

    Bitmaps are extended depth-first: a batch of phrases, then all that grows from it, then the next batch.
    """
    one, two, n, _ = maps.pairs()
    cell = cells(maps.ids[one], maps.ids[two], ranges)
    keep = alive[np.minimum(np.searchsorted(alive, cell), len(alive) - 1)] == cell if len(alive) else np.zeros(len(cell), bool)
    words = len(maps.ids)
    wanted = np.sort(one[keep] * words + two[keep])
    one, two, n, at = maps.pairs(wanted)
    yield np.stack([maps.ids[one], maps.ids[two]], axis=1), n
    if longest < 3 or not len(n):
        return
    #: The word at the end of a pair that may follow, by position: all such pairs' bitmaps at once.
    follows = np.full(maps.size, -1, np.int64)
    for_pair = np.repeat(two, n)
    follows[np.concatenate(at)] = for_pair
    step = max(1, len(n) // 16)
    for lo in range(0, len(n), step):
        phrase = np.stack([one[lo : lo + step], two[lo : lo + step]], axis=1)
        yield from _extend(maps, follows, phrase, np.concatenate(at[lo : lo + step]), np.repeat(np.arange(len(phrase)), n[lo : lo + step]), longest)


def _extend(maps: Bitmaps, follows: np.ndarray, phrase: np.ndarray, bits: np.ndarray, of: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What grows from phrases whose set bits are given; of: the phrase of each bit."""
    inside = bits + 1 < maps.size
    moved, of = bits[inside] + 1, of[inside]
    met = np.where(maps.is_start[moved], -1, follows[moved])
    moved, of, met = moved[met >= 0], of[met >= 0], met[met >= 0]
    if not len(moved):
        return
    key = of * len(maps.ids) + met
    order = np.argsort(key, kind="stable")
    key, moved = key[order], moved[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(cut, len(key)))
    longer = np.concatenate([phrase[key[cut] // len(maps.ids)], (key[cut] % len(maps.ids))[:, None]], axis=1)
    yield maps.ids[longer], n
    if longer.shape[1] < longest:
        yield from _extend(maps, follows, longer, moved, np.repeat(np.arange(len(n)), n), longest)


def counted(table: DataFrame, least: int, longest: int) -> DataFrame:
    """phrase (word hashes), a: all phrases of 2 to longest words with at least `least` occurrences."""
    positions = table.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    ranges = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), positions // RANGE_PAIRS)
    alive = alive_cells(pair_cells(table, least, ranges), least)

    def run(key: tuple, left: pa.Table, right: pa.Table):
        out = []
        own = [(U64(r) << U64(32)) | np.frombuffer(c, "<u4").astype(U64) for r, c in zip(right.column("range").to_pylist(), right.column("cells").to_pylist())]
        cell = np.sort(np.concatenate(own)) if own else np.zeros(0, U64)
        for row in _rows(left):
            maps = Bitmaps(row)
            for phrase, n in grown(maps, cell, ranges, longest):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * phrase.shape[1]), pa.array(np.ascontiguousarray(phrase).ravel()))
                out.append(pa.table({"phrase": lists, "n": pa.array(n, pa.int64())}))
        return pa.concat_tables(out) if out else pa.table({"phrase": pa.array([], pa.list_(pa.int64())), "n": pa.array([], pa.int64())})

    packed = table.select("shard", "size", "starts", "ids", "counts", "bits")
    each = packed.groupBy("shard").cogroup(alive.groupBy("shard")).applyInArrow(spare2(run), "phrase array<bigint>, n bigint")
    flat = each.select(*[F.get("phrase", F.lit(k)).alias(f"w{k}") for k in range(longest)], "n")
    return flat.groupBy(*[f"w{k}" for k in range(longest)]).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int | None = 2000) -> DataFrame:
    """Each language's phrases of 2 to longest words by score: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is floor(1000000 * a * a / (l * r)) at the cut with the lowest one; a phrase goes if a longer one
    that contains it has at least share percent of its occurrences. top: how many are returned of each language (None: all).
    """
    for turn in range(64):
        table = stored(shards(docs, turn), "shards")
        zipped = F.explode(F.arrays_zip("ids", "words", "counts")).alias("w")
        each = table.select("lang", zipped).select("lang", "w.ids", "w.words", "w.counts")
        words = stored(each.groupBy(F.col("ids").alias("id")).agg(F.sum("counts").alias("f"), F.min("words").alias("word"), F.max("words").alias("last"), F.min("lang").alias("lang"), F.max("lang").alias("last_lang")), "words")
        if words.filter((F.col("word") != F.col("last")) | (F.col("lang") != F.col("last_lang"))).isEmpty():
            break  # no two words share a hash
    frequent = words.filter(F.col("f") >= least).select("id", "f", "word", "lang")
    size = table.groupBy("lang").agg(F.sum(F.col("size").cast("long")).alias("n"))
    phrases = stored(counted(table, least, longest), "phrases")
    names = [f"w{k}" for k in range(longest)]
    listed = F.filter(F.array(*names), lambda x: x.isNotNull())
    keyed = phrases.select(listed.alias("key"), "a")
    parts = frequent.select(F.array("id").alias("key"), F.col("f").alias("a")).unionByName(keyed)
    # Every cut of every candidate: counts of both parts, the lowest score, then the smallest first part.
    cuts = keyed.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("key") - 1)))
    cuts = cuts.withColumn("head", F.slice("key", F.lit(1), F.col("k"))).withColumn("rest", F.slice("key", F.col("k") + 1, F.size("key") - F.col("k")))
    cuts = cuts.join(parts.select(F.col("key").alias("head"), F.col("a").alias("l")), "head").join(parts.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest")
    exact = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000000BD * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})"))
    scored = cuts.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Phrases inside a longer one that takes up most of them.
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("key") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("key") - m + 1), lambda s: F.slice("key", s, m))))
    longer = keyed.filter(F.size("key") > 2).select(F.explode(inside).alias("key"), F.col("a").alias("more")).groupBy("key").agg(F.max("more").alias("more"))
    kept = scored.join(longer, "key", "left").filter(F.coalesce(100 * F.col("more") < share * F.col("a"), F.lit(True)))
    for k in range(longest):
        word = frequent.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"t{k}"), *([F.col("lang")] if k == 0 else []))
        kept = kept.join(word, F.get("key", F.lit(k)) == F.col(f"i{k}"), "left" if k > 1 else "inner")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *[f"t{k}" for k in range(longest)]))
    if top is not None:  # each task keeps its first ones before they meet
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
        kept = kept.withColumn("rank", place).filter(F.col("rank") <= top)
        kept = kept.withColumn("rank", F.col("rank").cast("long"))
    else:
        kept = kept.withColumn("rank", F.lit(None).cast("long"))
    return kept.join(size, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))

