"""A character model per language that grows with the corpus (operator 9): modified Kneser-Ney of order ORDER over real characters.

Characters are Unicode's, A-Z as a-z; U+0000 and U+0001 count as U+FFFD, and U+0001 stands before a text. Texts fall in
two folds by their hash, equal texts in one; each fold is scored by the model of the other, else what only a document holds would
be well known to its model. Of all texts, those count that `trusted` takes for prose: enough words, and few symbols.

1. Each block of rows gives its different grams, and each task those of its blocks with their counts in either fold (0 for grams
   of other texts), as sorted arrays, one for each part of the model (`asked`). The part of a gram is a hash of the two characters before its last: grams with one context, and grams
   with one suffix of three characters or more, share a part, so each part counts alone down to its trigrams.
2. Spark merges the counts of a part, WAYS arrays at a time, so that a common gram is no hot key; a part holds different grams only.
3. Pairs and single characters are plain aggregates of the parts' trigrams; a language's pairs are one array.
4. Every part becomes a sorted array of gram hashes with the log probabilities of either fold's model (`model`).
5. Blocks get the probabilities of their own grams back, in the order of their arrays, and score their texts.

Blocks, parts and the arrays in them grow in number with the corpus: neither a task nor the driver holds the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, STEP_BYTES, mix, spare, spare2, steps, stored, texts_of, trimmed

ORDER = 5
#: Bytes of text that a block should hold, and the rows it holds at most.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 16
#: Arrays of a part that one task merges.
WAYS = 256
#: Parts of a small model; different grams whose counts a task holds.
PARTS, HELD = 16, 1 << 21
BEFORE, UNSAID = 1, 0xFFFD
#: Texts that count: of this many words, and this many words for each symbol.
MIN_WORDS, TRUST = 50, 20
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def block_rows(docs: DataFrame) -> tuple[int, int]:
    """Rows of a block (a power of two), and parts of the model, for texts of this number and length."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rows = BLOCK_BYTES * max(1, n) // max(1, size)
    rows = 1 << (max(1, min(BLOCK_ROWS, rows)).bit_length() - 1)
    parts = PARTS << max(0, math.ceil(math.log2(max(1, n // rows) / 16) / 2))
    return rows, min(parts, 1 << 20)


def characters(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of the texts, and where each text starts, in steps of a few texts."""
    raw, at = texts_of(column)
    for lo, hi in steps(at, STEP_BYTES // 2):
        part, own = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lead = np.zeros(len(part) + 1, np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=lead[1:])
        code = np.frombuffer(LOWER[part].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
        code[code <= BEFORE] = UNSAID
        yield code, lead[own]


def numbers(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The different code points in order, the number of each code point in them, and a number's bits."""
    letters = np.flatnonzero(np.bincount(np.append(code, BEFORE)))
    rank = np.zeros(int(letters[-1]) + 1, np.int64)
    rank[letters] = np.arange(len(letters))
    return letters.astype(np.uint32), rank, max(1, int(len(letters) - 1).bit_length())


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix of code points in order, and the number of each row in them."""
    n, k = grams.shape
    if not n or not k:
        return grams[: min(n, 1)], np.zeros(n, np.int64)
    letters, rank, bits = numbers(grams.ravel())
    if k * bits < 64:
        key = rank[grams[:, 0]]
        for j in range(1, k):
            key = key << bits | rank[grams[:, j]]
        one, back = np.unique(key, return_inverse=True)
        return unpacked(one, k, bits, letters), back
    order = np.lexsort(grams.T[::-1])
    new = np.ones(n, bool)
    new[1:] = (grams[order[1:]] != grams[order[:-1]]).any(1)
    back = np.empty(n, np.int64)
    back[order] = np.cumsum(new) - 1
    return grams[order[new]], back


def unpacked(key: np.ndarray, k: int, bits: int, letters: np.ndarray) -> np.ndarray:
    return np.stack([letters[key >> (bits * (k - 1 - j)) & ((1 << bits) - 1)] for j in range(k)], 1)


def ending(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gram of length ORDER that ends at each character."""
    place = np.arange(len(code)) - np.repeat(at[:-1], np.diff(at))
    out = np.full((len(code), ORDER), BEFORE, np.uint32)
    out[:, -1] = code
    for j in range(1, ORDER):
        out[j:, -1 - j] = np.where(place[j:] >= j, code[:-j], BEFORE) if len(code) > j else out[j:, -1 - j]
    return out


def counted(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different grams of some texts; and, for each text and each of its grams, the text, the gram's number and its count."""
    letters, rank, bits = numbers(code)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    width = ORDER * bits
    if width + int(len(at)).bit_length() < 64:
        number = rank[code]
        place = np.arange(len(code)) - at[:-1][text]
        key = text << width | number
        for j in range(1, min(ORDER, len(code))):
            key[j:] |= np.where(place[j:] >= j, number[:-j], 0) << (bits * j)  # BEFORE is the least code point
        pair, n = np.unique(key, return_counts=True)
        one, which = np.unique(pair & ((1 << width) - 1), return_inverse=True)
        return unpacked(one, ORDER, bits, letters), pair >> width, which, n
    grams, back = distinct(ending(code, at))
    pair, n = np.unique(text * max(1, len(grams)) + back, return_counts=True)
    return grams, pair // max(1, len(grams)), pair % max(1, len(grams)), n


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    pair = grams[:, -3].astype(np.uint64) << np.uint64(32) | grams[:, -2].astype(np.uint64)
    return (mix(pair * _STEP) % np.uint64(parts)).astype(np.int64)


def hashed(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        h = mix(h * _STEP + grams[:, j].astype(np.uint64) + np.uint64(1))
    return h


def boxed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; their types and widths are for the reader to know."""
    raw = b"".join(np.ascontiguousarray(a.T).tobytes() for a in arrays)
    return len(arrays[0]).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unboxed(data: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    raw, out, at = pa.decompress(data[16:], size, "zstd", asbytes=True), [], 0
    for kind, wide in kinds:
        x = np.frombuffer(raw, kind, n * wide, at)
        out.append(x.reshape(wide, n).T if wide > 1 else x)
        at += x.nbytes
    return out


#: What counts and merged parts hold: grams, and their counts in fold 0 and 1.
COUNTS = ((np.uint32, ORDER), (np.int64, 2))
#: What a block asks: grams, and in which folds they are, as bits. What it gets: log probabilities, in steps of 1 / STEPS.
ASKED, TOLD, STEPS = ((np.uint32, ORDER), (np.uint8, 1)), ((np.int16, 2),), 1024
#: What a part of the model holds: sorted hashes, and log probabilities by the models of fold 0 and 1.
HASHES = ((np.uint64, 1), (np.float32, 2))


class Grams:
    """Different grams with their numbers: counts to be summed, or bits to be joined."""

    def __init__(self, wide: int, bits: bool = False):
        self.bits = bits
        self.grams, self.n = np.zeros((0, ORDER), np.uint32), np.zeros((0, wide), np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, grams: np.ndarray, n: np.ndarray) -> None:
        self.held.append((grams, n[:, None] if n.ndim == 1 else n))
        if sum(len(x) for x, _ in self.held) > max(100_000, len(self.grams)):
            self.merge()

    def merge(self) -> Grams:
        if self.held:
            self.grams, back = distinct(np.concatenate([self.grams, *(x for x, _ in self.held)]))
            n = np.concatenate([self.n, *(x for _, x in self.held)])
            m = len(self.grams)
            if self.bits:
                self.n = sum((np.bincount(back, n[:, 0] & bit, minlength=m) > 0) * bit for bit in (1, 2)).reshape(m, 1)
            else:
                self.n = np.stack([np.bincount(back, n[:, f], minlength=m) for f in range(n.shape[1])], 1).astype(np.int64)
            self.held = []
        return self


def trusted(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text counts for the model: MIN_WORDS words or more, and a symbol for TRUST of them at most."""
    if not len(raw):
        return np.zeros(len(at) - 1, bool)
    space = np.concatenate([SPACE[raw], [True]])
    last = ~space[:-1] & space[1:]
    edge = at[1:][(at[1:] > at[:-1])] - 1
    last[edge] = ~space[edge]
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at])
    words = sums(last)
    return (words >= MIN_WORDS) & (TRUST * sums(SYMBOL[raw]) <= words)


def by_block(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where their block changes; the blocks of a task come one after another."""
    for batch in rows:
        blocks = batch.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
        for lo, hi in zip(edge[:-1], edge[1:]):
            if lo < hi:
                yield int(blocks[lo]), batch.slice(lo, hi - lo)


def _requests(parts: int):
    """The grams of each block, and the counts of the grams of a task's blocks (`counts`)."""

    def boxes(what: dict[str, Grams], block: int, counts: bool) -> Iterator[pa.RecordBatch]:
        for model, c in what.items():
            c.merge()
            part = part_of(c.grams, parts)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            have = np.flatnonzero(np.diff(edge))
            n = c.n if counts else c.n[:, 0].astype(np.uint8)
            data = [boxed(c.grams[order[edge[p] : edge[p + 1]]], n[order[edge[p] : edge[p + 1]]]) for p in have]
            yield pa.record_batch({"model": pa.array([model] * len(have), pa.string()), "part": pa.array(have), "block": pa.array(np.full(len(have), block)), "counts": pa.array(np.full(len(have), counts)), "data": pa.array(data, pa.binary())})

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict[str, Grams] = {}
        counts: dict[str, Grams] = {}
        now = None
        for block, batch in by_block(rows):
            if block != now and now is not None:
                yield from boxes(here, now, False)
                here = {}
                if sum(len(c.merge().grams) for c in counts.values()) > HELD:
                    yield from boxes(counts, now, True)
                    counts = {}
            now = block
            for model, at in models_of(batch.column(1)):
                asks, sums = here.setdefault(model, Grams(1, True)), counts.setdefault(model, Grams(2))
                fold, texts = batch.column(2).take(at).to_numpy(), batch.column(3).take(at)
                good = trusted(*texts_of(texts))
                first = 0
                for code, own in characters(texts):
                    grams, text, which, n = counted(code, own)
                    f = fold[first : first + len(own) - 1][text]
                    n = n * good[first : first + len(own) - 1][text]
                    sums.add(grams, np.stack([np.bincount(which[f == k], n[f == k], minlength=len(grams)) for k in (0, 1)], 1).astype(np.int64))
                    asks.add(grams, sum((np.bincount(which[f == k], minlength=len(grams)) > 0) * (k + 1) for k in (0, 1)))
                    first += len(own) - 1
        if now is not None:
            yield from boxes(here, now, False)
            yield from boxes(counts, now, True)

    return run


ASKED_ROWS = "model string, part long, block long, counts boolean, data binary"


def models_of(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[str, pa.Array]]:
    """Each model, and its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.dictionary_encode()
    number = coded.indices.to_numpy()
    for k, model in enumerate(coded.dictionary.to_pylist()):
        yield model, pa.array(np.flatnonzero(number == k))


def _merge(key, table):
    """The different grams of some arrays of a part, with their counts; how many have a count of 1, 2, 3 and 4 in either fold,
    for grams of length ORDER down to 3; and the trigrams."""
    c = Grams(2)
    for data in table["data"]:
        c.add(*unboxed(data.as_py(), *COUNTS))
    c.merge()
    grams, n, of = c.grams, c.n, []
    for k in range(ORDER, 2, -1):
        of += [int((n[:, f] == i).sum()) for f in (0, 1) for i in (1, 2, 3, 4)]
        if k > 3:
            grams, n = shorter(grams, n)[:2]
    low = pa.StructArray.from_arrays([pa.array(grams[:, j].astype(np.int32)) for j in (1, 2)] + [pa.array((n[:, f] > 0).astype(np.int32)) for f in (0, 1)], ["b", "c", "in0", "in1"])
    return pa.table({"model": [key[0].as_py()], "part": [key[1].as_py()], "data": pa.array([boxed(c.grams, c.n)], pa.binary()), "of": pa.array([of], pa.list_(pa.int64())), "low": pa.ListArray.from_arrays(pa.array([0, len(low)], pa.int32()), low)})


_MERGED = f"model string, part long, data binary, of array<long>, low array<struct<b:int,c:int,in0:int,in1:int>>"


def shorter(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of grams, how many different characters stand before each in either fold, and the number of each gram's suffix."""
    below, up = distinct(grams[:, 1:])
    return below, np.stack([np.bincount(up, n[:, f] > 0, minlength=len(below)) for f in (0, 1)], 1).astype(np.int64), up


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2 and more."""
    have = [float(x) for x in (n1, n2, n3, n4)]
    y = have[0] / (have[0] + 2 * have[1]) if have[0] and have[1] else 0.5
    return np.array([0.0] + [min(k, max(0.1, k - (k + 1) * y * have[k] / have[k - 1])) if have[k - 1] else 0.5 * k for k in (1, 2, 3)])


def level(context: np.ndarray, n: np.ndarray, of: list[int], below: np.ndarray) -> np.ndarray:
    """Probabilities of grams from their contexts' numbers, counts, counts of counts, and their suffixes' probabilities."""
    d = discounts(*of)
    cut = d[np.minimum(n, 3)]
    total, freed = np.bincount(context, n)[context], np.bincount(context, cut)[context]
    return np.where(total > 0, (n - cut + freed * below) / np.maximum(total, 1), below)


def _pairs(key, table):
    """The probabilities of a language's pairs of characters by the models of fold 0 and 1."""
    b, c = table["b"].to_numpy(), table["c"].to_numpy()
    n = np.stack([table["n0"].to_numpy(), table["n1"].to_numpy()], 1)
    one, up = np.unique(c, return_inverse=True)
    context = np.unique(b, return_inverse=True)[1]
    p = np.empty((len(b), 2))
    for f in (0, 1):
        single = np.bincount(up, n[:, f] > 0, minlength=len(one)).astype(np.int64)
        alone = level(np.zeros(len(one), np.int64), single, [int((single == i).sum()) for i in (1, 2, 3, 4)], np.full(len(one), 1.0 / max(1, len(one))))
        p[:, f] = level(context, n[:, f], [int((n[:, f] == i).sum()) for i in (1, 2, 3, 4)], alone[up])
    return pa.table({"model": pa.array([key[0].as_py()] * len(b), pa.string()), "b": table["b"], "c": table["c"], "p0": pa.array(p[:, 0]), "p1": pa.array(p[:, 1])})


def _hash_arrays(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part of the model from its grams, its language's counts of counts, and the pairs' probabilities."""
    for batch in rows:
        out = []
        for data, of, low in zip(batch.column("data"), batch.column("of"), batch.column("pairs")):
            grams, n = unboxed(data.as_py(), *COUNTS)
            of = np.array(of.as_py()).reshape(ORDER - 2, 2, 4)
            levels, g, m = [], grams, n
            for k in range(ORDER, 2, -1):
                below, fewer, up = shorter(g, m)
                context = distinct(g[:, :-1])[1]
                levels.append((context, m, of[ORDER - k], up))
                g, m = below, fewer
            low = low.values  # of pairs that end a trigram of this part: in order, as g is
            pair = np.stack([low.field("b").to_numpy(), low.field("c").to_numpy()], 1).astype(np.uint32)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            assert (pair[order] == g).all()
            both = np.empty((len(grams), 2), np.float32)
            for f in (0, 1):
                p = low.field(f"p{f}").to_numpy()[order]
                for context, m, have, up in reversed(levels):
                    p = level(context, m[:, f], have[f].tolist(), p[up])
                both[:, f] = np.log(p)
            h = hashed(grams)
            order = np.argsort(h)
            out.append(boxed(h[order], both[order]))
        yield pa.record_batch({"model": batch.column("model"), "part": batch.column("part"), "data": pa.array(out, pa.binary())})


def _answer(key, asked, model):
    """For the grams of each block, the log probability by the other fold's model; a block whose rows two tasks read asked twice."""
    h, logp = unboxed(model["data"][0].as_py(), *HASHES)
    blocks: dict[int, list[bytes]] = {}
    for block, data in zip(asked["block"].to_pylist(), asked["data"].to_pylist()):
        blocks.setdefault(block, []).append(data)
    out = []
    for some in blocks.values():
        c = Grams(1, True)
        for data in some:
            c.add(*unboxed(data, *ASKED))
        found = logp[np.searchsorted(h, hashed(c.merge().grams))]
        found = np.stack([np.where(c.n[:, 0] & (f + 1), found[:, 1 - f], 0) for f in (0, 1)], 1)
        out.append(boxed(np.round(np.maximum(found * STEPS, -32768)).astype(np.int16)))
    n = len(out)
    return pa.table({"_block": pa.array(list(blocks), pa.int64()), "model": pa.array([key[0].as_py()] * n, pa.string()), "part": pa.array([key[1].as_py()] * n, pa.int64()), "data": pa.array(out, pa.binary())})


def model_of(asked: DataFrame) -> DataFrame:
    """model, part and data: the sorted hash arrays of all languages."""
    merged = asked.filter("counts").select("model", "part", "data", F.xxhash64("block").alias("way"))
    arrays = merged.groupBy("model", "part").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while arrays > WAYS:  # each turn leaves a WAYS-th of the arrays
        arrays = -(-arrays // WAYS)
        some = merged.withColumn("way", F.pmod(F.xxhash64("way", F.lit(arrays)), F.lit(arrays)))
        merged = stored(some.groupBy("model", "part", "way").applyInArrow(spare(lambda key, t: _merge(key, t).select(["model", "part", "data"]).append_column("way", pa.array([key[2].as_py()]))), "model string, part long, data binary, way long"), "merging")
    merged = stored(merged.select("model", "part", "data").groupBy("model", "part").applyInArrow(spare(_merge), _MERGED), "merged")
    tri = merged.select("model", "part", F.explode("low").alias("x")).select("model", "part", "x.*")
    pairs = tri.groupBy("model", "b", "c").agg(F.sum("in0").alias("n0"), F.sum("in1").alias("n1"))
    pairs = stored(pairs.groupBy("model").applyInArrow(spare(_pairs), "model string, b int, c int, p0 double, p1 double"), "pairs")
    own = tri.select("model", "part", "b", "c").distinct().join(pairs, ["model", "b", "c"])
    own = stored(own.groupBy("model", "part").agg(F.collect_list(F.struct("b", "c", "p0", "p1")).alias("pairs")), "ends")
    cells = 8 * (ORDER - 2)
    of = merged.groupBy("model").agg(F.array(*[F.sum(F.col("of")[i]) for i in range(cells)]).alias("of"))
    whole = merged.select("model", "part", "data").join(own, ["model", "part"]).join(of, "model")
    return stored(whole.mapInArrow(trimmed(_hash_arrays), "model string, part long, data binary"), "model")


def answers(held: DataFrame, parts: int) -> DataFrame:
    """_block, model, part and data: the log probabilities of the block's grams, in order."""
    asked = stored(held.select("_block", "model", "fold", "text").mapInArrow(trimmed(_requests(parts)), ASKED_ROWS), "asked")
    model = model_of(asked)
    asked = asked.filter("not counts").select("model", "part", "block", "data")
    blocks = asked.agg(F.count_distinct("block")).first()[0]
    ways = max(1, blocks // WAYS)
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("block", F.lit(7)), F.lit(ways)))
    salts = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long")))) if ways > 1 else model.withColumn("salt", F.lit(0).cast("long"))
    key = ["model", "part", "salt"]
    return salted.groupBy(*key).cogroup(salts.groupBy(*key)).applyInArrow(spare2(lambda k, a, m: _answer(k, a, m) if a.num_rows else _NONE), "_block long, model string, part long, data binary")


_NONE = pa.table({"_block": pa.array([], pa.int64()), "model": pa.array([], pa.string()), "part": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})


def log_perplexity(column: pa.ChunkedArray, fold: np.ndarray, told: dict[int, bytes], parts: int) -> np.ndarray:
    """Per character of each text of one model in one block; told: what answers() gives, by part.

    The texts are read twice, first for the block's grams, so that no more than a few texts' counts are held.
    """
    c = Grams(1, True)
    for code, at in characters(column):
        grams = counted(code, at)[0]
        c.add(grams, np.ones(len(grams), np.int64))
    one = c.merge().grams
    if not len(one):
        return np.zeros(len(column))
    part = part_of(one, parts)
    order = np.argsort(part, kind="stable")
    logp = np.concatenate([unboxed(told[int(p)], *TOLD)[0] for p in np.unique(part)])
    h = hashed(one[order])
    order = np.argsort(h)
    h, logp = h[order], logp[order]
    del c, one, part, order
    out = []
    for code, at in characters(column):
        grams, text, which, n = counted(code, at)
        here = logp[np.searchsorted(h, hashed(grams))]
        first = sum(map(len, out))
        f = fold[first : first + len(at) - 1]
        total = np.bincount(text, n * here[which, f[text]].astype(np.float64), minlength=len(at) - 1)
        out.append(-total / STEPS / np.maximum(np.diff(at), 1))
    return np.concatenate(out)
