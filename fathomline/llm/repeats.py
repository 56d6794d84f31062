"""Suffix-array dedup: removes bytes of long strings that occur more than once (operator 1).

A byte goes if a LENGTH-byte string that covers it also starts anywhere else, in the same document or another; strings are
judged on the input. Only strings that can repeat reach a suffix array:

1. Each LENGTH-byte string belongs to its anchor, the GRAM-byte gram of the least hash in it (the first of equals).
   Equal strings have equal anchors at equal offsets. Strings of one anchor form a run of neighbours.
2. Runs whose anchor gram occurs once are done. Equal runs (same text, same offsets) repeat as a whole.
3. One run of each text is fetched and dealt out by anchor. A shard's runs are concatenated, and their suffix array
   (induced sorting) and permuted common prefixes tell which strings two different runs share.
4. An anchor with more than HOT_RUNS different runs isn't sorted in one task. Its runs are cut into cells of neighbouring
   strings, which Spark counts by hash: equal cells repeat as a whole; cells whose common bytes no different cell has hold
   nothing that repeats; others are cut into smaller cells, down to single strings (CELLS).

Defined results: null text counts as empty; texts shorter than LENGTH lose nothing; repeated rows are copies of each
other, so both lose what is long enough; an empty table gives an empty result; other columns are ignored by `removals`
and kept by `remove`. Where a cut leaves part of a character, `remove` drops the rest of that character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, U64, Rolling, mix, placed, small_batches, steps, stored, texts_of, trimmed
from .suffixes import common_prefixes, suffix_array

LENGTH, GRAM = 400, 200
HOT_RUNS = 256
CELLS = (64, 16, 4, 1)
SHARD_BYTES = 3 << 19

_ROLL, _ROLL2 = Rolling(101), Rolling(202)
_PLACE = pa.struct([("file", pa.int64()), ("row", pa.int64())])


def runs_of(raw: np.ndarray, at: np.ndarray, length: int, gram: int):
    """All runs: text, first and last start of its strings, anchor, hash of the anchor gram and of the whole run."""
    z = np.zeros(0, np.int64)
    if len(raw) < length:
        return z, z, z, z, z.view(U64), z.view(U64)
    prefix = _ROLL.prefix(raw)
    grams = mix(_ROLL.grams(prefix, gram))
    bits = max(20, int(len(raw)).bit_length())
    low = U64((1 << bits) - 1)
    best, width, wide = (grams & ~low) | np.arange(len(grams), dtype=U64), 1, length - gram + 1
    while width * 2 <= wide:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if wide > width:
        best = np.minimum(best[: len(best) - (wide - width)], best[wide - width :])
    anchor = (best & low).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    inside = start + length <= at[1:][text]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if not len(start):
        return z, z, z, z, z.view(U64), z.view(U64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    first, last = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
    anchor = anchor[new]
    return text[new], first, last, anchor, grams[anchor], mix(_ROLL2.ranges(_ROLL2.prefix(raw), first, last + length))


def _runs(length: int, gram: int, only_grams: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            raw, at = texts_of(batch.column(1))
            for lo, hi in steps(at):
                own = at[lo : hi + 1] - at[lo]
                text, first, last, anchor, grams, whole = runs_of(raw[at[lo] : at[hi]], own, length, gram)
                cols = {"gram": pa.array(grams.view(np.int64))}
                if not only_grams:
                    cols |= {"place": batch.column(0).take(pa.array(lo + text)), "first": pa.array(first - own[text]), "back": pa.array((anchor - first).astype(np.int32)), "more": pa.array((last - first).astype(np.int32)), "whole": pa.array(whole.view(np.int64))}
                yield pa.record_batch(cols)

    return run


_RUN = f"gram long, place {PLACE}, first long, back int, more int, whole long"


def cells_of(own: np.ndarray, back: int, length: int, gram: int, width: int) -> list[np.ndarray]:
    """Cells of a run: number (counted from the anchor), first and last string, hash of the bytes all strings of the
    number share, and hash of the cell as it is."""
    n = len(own) - length + 1
    shift = length - gram - back  # of the first string, on the grid that all runs of the anchor have in common
    number = np.arange(shift // width, (shift + n - 1) // width + 1)
    low, high = np.maximum(number * width - shift, 0), np.minimum((number + 1) * width - 1 - shift, n - 1)
    p, q = _ROLL.prefix(own), _ROLL2.prefix(own)
    both = lambda a, b: mix(_ROLL.ranges(p, a, b) * U64(3) + mix(_ROLL2.ranges(q, a, b)))
    # In a cell that the run covers in part, the shared bytes are still inside each of its strings.
    core = mix(both(np.maximum((number + 1) * width - 1 - shift, 0), np.minimum(number * width - shift + length, len(own))) + number.astype(U64))
    inside = ((number + 1) * width - 1 - shift < len(own)) & (number * width - shift + length > 0)
    whole = mix(both(low, high + length) + ((low + shift) * 1009 + high + shift).astype(U64))
    return [number[inside], low[inside], high[inside], core[inside].view(np.int64), whole[inside].view(np.int64)]


_CELL = "array<struct<cell:int,low:int,high:int,core:bigint,whole:bigint>>"
_FETCHED = f"gram long, place {PLACE}, first long, text binary, " + ", ".join(f"cells{w} {_CELL}" for w in CELLS)


def _fetch(length: int, gram: int):
    """The text of cold runs, and the cells of hot ones."""
    kind = pa.list_(pa.struct([("cell", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("core", pa.int64()), ("whole", pa.int64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            raw, at = texts_of(batch.column("text"))
            wanted, places = batch.column("wanted"), batch.column("place")
            from_row = np.frombuffer(wanted.buffers()[1], np.int32)[wanted.offset : wanted.offset + len(wanted) + 1]
            items = wanted.flatten()
            f = {n: items.field(n).to_numpy(zero_copy_only=False) for n in ("gram", "first", "back", "more", "hot")}
            row = np.repeat(np.arange(len(places)), np.diff(from_row))
            begin = at[row] + f["first"]
            for lo in range(0, len(row), 2000):
                part = slice(lo, lo + 2000)
                hot = f["hot"][part]
                text = [None if h else raw[b : b + m + length].tobytes() for h, b, m in zip(hot, begin[part], f["more"][part])]
                cols = {"gram": pa.array(f["gram"][part]), "place": places.take(pa.array(row[part])), "first": pa.array(f["first"][part]), "text": pa.array(text, pa.binary())}
                for width in CELLS:
                    found = [None] * len(hot)
                    for i in np.flatnonzero(hot):
                        own = raw[begin[lo + i] : begin[lo + i] + f["more"][lo + i] + length]
                        found[i] = [dict(zip(("cell", "low", "high", "core", "whole"), map(int, x))) for x in zip(*cells_of(own, int(f["back"][lo + i]), length, gram, width))]
                    cols[f"cells{width}"] = pa.array(found, kind)
                yield pa.record_batch(cols)

    return run


def _hot_spans(got: DataFrame, length: int) -> DataFrame:
    """What repeats in the runs of hot anchors, from coarse cells to single strings."""
    run, out, alive = ["gram", "place", "first"], None, None
    for width, finer in zip(CELLS, [*CELLS[1:], 0]):
        runs = got.select(*run, F.col(f"cells{width}").alias("cells"))
        if alive is not None:
            runs = runs.join(alive, run).withColumn("cells", F.filter("cells", lambda c: F.array_contains("parents", F.floor(c["cell"] / ratio).cast("int"))))
        rows = runs.select(*run, F.explode("cells").alias("c")).select(*run, "c.*")
        rows = stored(rows, f"cells{width}")
        same = rows.groupBy("gram", "core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("place", "first", "cell")).alias("one"))
        same = stored(same, f"same{width}")
        twice = rows.join(same.filter("n > 1").select("gram", "core", "whole"), ["gram", "core", "whole"]).select("place", (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + length).alias("end"))
        out = twice if out is None else out.union(twice)
        if finer:
            mixed = same.groupBy("gram", "core").agg(F.count("*").alias("d")).filter("d > 1").select("gram", "core")
            alive = same.join(mixed, ["gram", "core"]).groupBy("gram", "one.place", "one.first").agg(F.collect_set("one.cell").alias("parents"))
            ratio = width // finer
    return out


def shared_strings(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Starts, in each of some texts, of the length-byte strings that start more than once in all of them."""
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes + 1)
    t = np.full(ends[-1] + 1, 1, np.uint16)  # texts are parted by 1; bytes are 2 and over; 0 ends all
    t[-1] = 0
    for x, end in zip(texts, ends):
        t[end - 1 - len(x) : end - 1] = np.frombuffer(x, np.uint8).astype(np.uint16) + 2
    sa = suffix_array(t)
    agree = common_prefixes(t, sa)
    twice = agree >= length
    rank = np.flatnonzero(twice[sa])
    twice[sa[rank - 1]] = True  # both neighbours in order
    out = []
    for n, end in zip(sizes, ends):
        begin = end - 1 - n
        out.append(np.flatnonzero(twice[begin : max(begin, end - length)]))
    return out


def _sorted_shards(length: int, limit: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            place, first, last = [], [], []
            for (_, p, f, _), hits in zip(held, shared_strings([x[3] for x in held], length)):
                if len(hits):
                    new = np.flatnonzero(np.concatenate([[True], np.diff(hits) > 1]))
                    for a, b in zip(hits[new], hits[np.concatenate([new[1:], [len(hits)]]) - 1]):
                        place.append(p), first.append(f + int(a)), last.append(f + int(b) + length)
            return pa.record_batch({"place": pa.array(place, _PLACE), "start": pa.array(first, pa.int64()), "end": pa.array(last, pa.int64())})

        for batch in rows:  # sorted by gram: a shard ends between two anchors
            for x in zip(*(batch.column(n).to_pylist() for n in ("gram", "place", "first", "text"))):
                if size >= limit and held[-1][0] != x[0]:
                    yield out()
                    held, size = [], 0
                held.append(x)
                size += len(x[3])
        if held:
            yield out()

    return run


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """__place, spans (start, end) of the repeated strings of each row of docs, which has a __place; they may overlap."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("__place").alias("place"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") >= length)
    # Stored, here and below: a join can split a hot key of one side only if the other isn't an aggregate made on the way.
    common = stored(texts.mapInArrow(trimmed(_runs(length, gram, True)), "gram long").groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram"), "shared")
    rows = stored(texts.mapInArrow(trimmed(_runs(length, gram, False)), _RUN).join(common, "gram"), "runs")
    key = ["gram", "back", "more", "whole"]
    different = stored(rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("place", "first")).alias("one")), "different")
    equal = rows.join(different.filter("n > 1").select(*key), key).select("place", F.col("first").alias("start"), (F.col("first") + F.col("more") + length).alias("end"))
    many = stored(different.groupBy("gram").agg(F.count("*").alias("d")).filter("d > 1"), "many")
    wanted = (
        different.join(many, "gram").select("one.place", F.struct("gram", "one.first", "back", "more", (F.col("d") > HOT_RUNS).alias("hot")).alias("x"))
        .groupBy("place").agg(F.collect_list("x").alias("wanted"))  # no more than a text has runs
    )
    got = stored(texts.join(wanted, "place").mapInArrow(trimmed(_fetch(length, gram)), _FETCHED), "fetched")
    cold = got.filter("text is not null").select("gram", "place", "first", "text")
    cold = cold.repartition("gram").sortWithinPartitions("gram").mapInArrow(trimmed(_sorted_shards(length, SHARD_BYTES)), f"place {PLACE}, start long, end long")
    hot = _hot_spans(got.filter("text is null"), length)
    found = stored(equal.union(cold).union(hot), "spans")
    return found.groupBy(F.col("place").alias("__place")).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))


def _cut(rows: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        raw, at = texts_of(batch.column("text"))
        out: list[tuple] = []
        for i, found in enumerate(batch.column("spans")):
            text = raw[at[i] : at[i + 1]].tobytes()
            kept, n, cur = [], 0, 0
            for x in sorted((s["start"], s["end"]) for s in (found.as_py() or ())):
                if x[0] > cur or not n:
                    kept.append(text[cur : x[0]])
                    n += 1
                cur = max(cur, x[1])
            kept.append(text[cur:])
            left = b"".join(kept)
            out.append((len(text), len(text) - len(left), n, left.decode(errors="ignore") if whole else hashlib.sha256(left).hexdigest()))
        n_bytes, gone, n_spans, last = zip(*out) if out else ((), (), (), ())
        if whole:
            given = batch.column("given")
            yield pa.record_batch({"given": given, "text": pa.array(last, pa.string())})
        else:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(last, pa.string())})


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    own = placed(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = own.join(spans(own, length, gram), "__place", "left").select("doc_id", "text", F.col("__spans").alias("spans"))
    return both.mapInArrow(trimmed(lambda rows: _cut(rows, False)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents, all of them, with what is left of their texts; n_chars follows if there is one."""
    from pyspark.sql.types import StringType, StructField, StructType

    own = placed(docs, *docs.columns)
    rest = [c for c in docs.columns if c != "text"]
    given = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("given")
    both = own.join(spans(own, length, gram), "__place", "left").select(given, "text", F.col("__spans").alias("spans"))
    out = both.mapInArrow(trimmed(lambda rows: _cut(rows, True)), StructType([StructField("given", StructType([docs.schema[c] for c in rest])), StructField("text", StringType())]))
    cols = {c: F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("given")[c] for c in docs.columns}
    return out.select(*[x.alias(c) for c, x in cols.items()])
