"""Document fingerprints by invertible Bloom look-up sketches (operator 12).

A text's paragraphs are its lines, and long lines are cut where their words say so (after a word whose hash has its two
lowest bits clear), so that an edit moves no cut but those beside it. The k-th copy of a paragraph in a text counts as a
paragraph of its own. Each paragraph digest is added to one cell in each third of the sketch: cells hold a count, the
xor of digests and the xor of their checks. The sketches of two versions are subtracted cell by cell; cells left with a
single digest are peeled until none is left, which recovers the digests that differ. If cells are left over, both sketches
are made again GROWTH times larger from the paragraphs, until peeling ends. So likeness is exact (up to 64-bit digests):
paragraphs in both versions over paragraphs in either one. Two texts without words have likeness 1.

Neighbours in `edited` come from one shuffle of the texts: rows are dealt to ranges of descending doc_id, whose borders
(one row a range) are taken from the ids alone; a border's row is sent to the range before its own as well.

Defined results: a null text counts as empty, an empty table gives an empty result, extra columns are ignored; rows without a
doc_id come last; repeated ids follow each other in the order of the stored rows, and each row gives a row; a single row is its own
next. A text of any length is handled whole, as a step of its own; memory follows the longest text, and workers give it back.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, mix, placed, seeds, small_batches, steps, texts_of, trimmed, words_of

#: Cells of a fingerprint (a multiple of 3), and how much larger each retry is.
CELLS, GROWTH = 24, 4
#: A line goes on after a word unless these bits of the word's hash are clear.
CUT = U64(3)
#: Cells that one vectorised step holds.
STEP_CELLS = 1 << 20

_SEEDS, _CHECK = seeds(64, 1201), U64(0x5851F42D4C957F2D)


def paragraphs(raw: np.ndarray, at: np.ndarray, roll: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """The text of each paragraph of the texts at[0], at[1], ..., and its digest, which counts copies within a text."""
    start, end, doc = words_of(raw, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    prefix = roll.prefix(raw)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    opens = np.ones(len(start), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (lines[start[1:]] != lines[end[:-1]]) | (mix(roll.ranges(prefix, start[:-1], end[:-1])) & CUT == 0)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(start)) - 1
    doc, digest = doc[first], mix(roll.ranges(prefix, start[first], end[last]))
    order = np.lexsort((digest, doc))
    d, h = doc[order], digest[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    where = np.arange(len(d))
    copy = where - np.maximum.accumulate(np.where(new, where, 0))
    return d, mix(h + copy.astype(U64) * _SEEDS[40])


class Sketches:
    """Sketches of m cells, one for each of n texts."""

    def __init__(self, n: int, m: int, doc: np.ndarray, digest: np.ndarray, turn: int = 0):
        self.n, self.m, self.turn = n, m, turn
        self.count, self.key, self.check = np.zeros(n * m, np.int64), np.zeros(n * m, U64), np.zeros(n * m, U64)
        self.add(doc, digest, np.ones(len(doc), np.int64))

    def cells(self, doc: np.ndarray, digest: np.ndarray) -> np.ndarray:
        third = self.m // 3
        own = [mix(digest ^ _SEEDS[3 * self.turn % 36 + j]) % U64(third) for j in range(3)]
        return np.stack([doc * self.m + j * third + own[j].astype(np.int64) for j in range(3)], axis=1)

    def add(self, doc: np.ndarray, digest: np.ndarray, times: np.ndarray) -> None:
        check = mix(digest ^ _CHECK)
        for cell in self.cells(doc, digest).T:
            np.add.at(self.count, cell, times)
            np.bitwise_xor.at(self.key, cell, digest)
            np.bitwise_xor.at(self.check, cell, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.m, np.zeros(0, np.int64), np.zeros(0, U64), self.turn)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts, digests and sides (1 or -1) of what the cells hold, and whether each text's cells came to nothing."""
        found = []
        while True:
            pure = (np.abs(self.count) == 1) & (mix(self.key ^ _CHECK) == self.check)
            at = np.flatnonzero(pure)
            doc, digest = at // self.m, self.key[at]
            cells = self.cells(doc, digest)
            alike = pure[cells] & (self.key[cells] == digest[:, None])
            own = (cells == at[:, None]).any(axis=1)
            at_first = own & (cells[np.arange(len(at)), alike.argmax(axis=1)] == at)  # a digest that is pure in several cells goes once
            if not at_first.any():
                break
            doc, digest, side = doc[at_first], digest[at_first], self.count[at[at_first]]
            found.append((doc, digest, side))
            self.add(doc, digest, -side)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)]
        return *parts, ~left.reshape(self.n, self.m).any(axis=1)

    def texts(self, n_items: np.ndarray) -> list[str]:
        """Each sketch as a string: the number of paragraphs, counts, digests and checks, all little-endian."""
        count, key, check = (x.reshape(self.n, self.m).astype(kind) for x, kind in ((self.count, "<i4"), (self.key, "<u8"), (self.check, "<u8")))
        return [base64.b64encode(int(n).to_bytes(8, "little") + a.tobytes() + b.tobytes() + c.tobytes()).decode() for n, a, b, c in zip(n_items, count, key, check)]


def unlike(n: int, a: tuple, b: tuple, with_digests: bool = False):
    """How many paragraphs differ between n pairs of texts, the cells it took, and on demand (text, digest, side) of them all."""
    out, took, found = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    todo, m, turn = np.arange(n), CELLS, 0
    while len(todo):
        failed = []
        for lo in range(0, len(todo), max(1, STEP_CELLS // m)):
            ids = todo[lo : lo + max(1, STEP_CELLS // m)]
            own = []
            for doc, digest in (a, b):
                lo_at, hi_at = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
                size = hi_at - lo_at
                at = np.repeat(lo_at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                own.append(Sketches(len(ids), m, np.repeat(np.arange(len(ids)), size), digest[at], turn))
            doc, digest, side, ok = own[0].minus(own[1]).peel()
            count = np.bincount(doc, minlength=len(ids))
            out[ids[ok]], took[ids[ok]] = count[ok], m
            failed.append(ids[~ok])
            if with_digests:
                found.append((ids[doc[ok[doc]]], digest[ok[doc]], side[ok[doc]]))
        todo, m, turn = np.concatenate(failed), m * GROWTH, turn + 1
    return out, took, [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)]


def likeness(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    both = n_a + n_b
    return np.where(both > 0, (both - differ) / np.maximum(1, both + differ), 1.0)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, with n_paragraphs and fingerprint."""
    small_batches(docs.sparkSession)
    at_text, fields = docs.columns.index(text), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]):
        roll = Rolling(1200)
        for batch in batches:
            raw, at = texts_of(batch.column(at_text))
            for lo, hi in steps(at):
                doc, digest = paragraphs(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], roll)
                n = np.bincount(doc, minlength=hi - lo)
                made = Sketches(hi - lo, CELLS, doc, digest).texts(n)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(n, pa.int64()), pa.array(made)], names=[*batch.schema.names, "n_paragraphs", "fingerprint"])

    return docs.mapInArrow(trimmed(run), f"{fields}, n_paragraphs bigint, fingerprint string")


def differences(versions: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """For each row with two versions of a text: key, likeness, cells, and the digests of paragraphs that only one version has."""
    small_batches(versions.sparkSession)
    rows = versions.select(key, old, new)

    def run(batches: Iterator[pa.RecordBatch]):
        roll = Rolling(1200)
        for batch in batches:
            sides = [texts_of(batch.column(k)) for k in (1, 2)]
            both = sides[0][1] + sides[1][1]
            for lo, hi in steps(both):
                own = [paragraphs(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], roll) for raw, at in sides]
                sizes = [np.bincount(doc, minlength=hi - lo) for doc, _ in own]
                differ, took, (doc, digest, side) = unlike(hi - lo, *own, with_digests=True)
                lists = []
                for sign in (1, -1):
                    d, h = doc[side == sign], digest[side == sign].view(np.int64)
                    order = np.lexsort((h, d))
                    where = np.searchsorted(d[order], np.arange(hi - lo + 1)).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(where), pa.array(h[order])))
                near = likeness(*sizes, differ)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(near), pa.array(took), *lists], names=[key, "likeness", "cells", "only_old", "only_new"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"`{key}` {kind}, likeness double, cells bigint, only_old array<bigint>, only_new array<bigint>")


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, part and tail, dealt by part and sorted: each row is followed by the next document, a part's last row is a tail."""
    spark = docs.sparkSession
    small_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = placed(docs.withColumn("doc_id", F.col("doc_id").cast("long")) if dict(docs.dtypes)["doc_id"] != "bigint" else docs, "doc_id", "text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("down"), "__place.file", "__place.row")
    ids = rows.select(key.alias("key")).repartitionByRange(n, "key").select("key", F.spark_partition_id().alias("range"))
    borders = sorted((k["none"], k["down"], k["file"], k["row"]) for (k,) in ids.groupBy("range").agg(F.min("key").alias("key")).select("key").collect())  # one a range
    if not borders:
        borders = [(False, 0, 0, 0)]

    @F.pandas_udf("bigint")
    def part_of(none: pd.Series, down: pd.Series, file: pd.Series, row: pd.Series) -> pd.Series:
        """Twice the part, and one more for a border's own row."""
        out = []
        for x in zip(none.tolist(), down.tolist(), file.tolist(), row.tolist()):
            k = bisect.bisect_right(borders, x) - 1
            out.append(2 * k + (borders[k] == x))
        return pd.Series(out, dtype="int64")

    last = len(borders) - 1
    own = F.floor(F.col("code") / 2).cast("int")
    copies = F.array(F.struct(own.alias("part"), F.lit(False).alias("tail")), F.struct(F.when(own > 0, own - 1).otherwise(last).alias("part"), F.lit(True).alias("tail")))
    dealt = rows.select("doc_id", "text", key.alias("key")).withColumn("code", part_of("key.none", "key.down", "key.file", "key.row"))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("code") % 2 == 1, copies).otherwise(F.slice(copies, 1, 1))))
    dealt = dealt.select("doc_id", "text", "key", "to.part", "to.tail").repartitionById(last + 1, "part")
    return dealt.sortWithinPartitions("part", "tail", "key").select("doc_id", "text", "part", "tail")


def edited(docs: DataFrame) -> DataFrame:
    """A row for each document: fingerprints of its text and of its edited text, and how like the edited and the next text are.

    The edited text has the last half of the code points (rounded down) replaced by the first as many of the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        roll, carried = Rolling(1200), None
        for batch in batches:
            table = pa.Table.from_batches([*([carried] if carried is not None else []), batch]).combine_chunks()
            n = table.num_rows
            carried = pa.RecordBatch.from_arrays([table.column(k).slice(n - 1).combine_chunks() for k in range(4)], schema=table.schema)
            raw, at = texts_of(table.column(1))
            tail = table.column(3).to_numpy()
            for lo, hi in steps(at[:n]):  # every row but the last
                keep = np.flatnonzero(~tail[lo:hi])
                if len(keep):
                    yield pa.RecordBatch.from_arrays([table.column(0).slice(lo, hi - lo).combine_chunks().take(pa.array(keep)), *(pa.array(x[keep] if isinstance(x, np.ndarray) else [x[k] for k in keep]) for x in _compared(raw[at[lo] : at[hi + 1]], at[lo : hi + 2] - at[lo], roll))], names=_NAMES)

    return in_ranges(docs).mapInArrow(trimmed(run), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs bigint, cells_edited bigint, cells_next bigint")


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_paragraphs", "cells_edited", "cells_next"]


def _compared(raw: np.ndarray, at: np.ndarray, roll: Rolling) -> list:
    """The columns of `edited` after doc_id, for every text but the last; each text's next one follows it."""
    n = len(at) - 2
    lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    first = np.searchsorted(lead, at)
    chars = np.diff(first)
    swapped = chars[:-1] // 2
    cut = lead[first[:-2] + chars[:-1] - swapped]
    until = lead[first[1:-1] + np.minimum(swapped, chars[1:])]
    data = raw.tobytes()
    changed = [data[a:b] + data[c:d] for a, b, c, d in zip(at[:-2].tolist(), cut.tolist(), at[1:-1].tolist(), until.tolist())]
    changed_at = np.concatenate([[0], np.cumsum([len(x) for x in changed])]).astype(np.int64)
    own, new = paragraphs(raw, at, roll), paragraphs(np.frombuffer(b"".join(changed), np.uint8), changed_at, roll)
    size, new_size = np.bincount(own[0], minlength=n + 1), np.bincount(new[0], minlength=n)
    here = np.searchsorted(own[0], [n, 1])
    mine, nexts = (own[0][: here[0]], own[1][: here[0]]), (own[0][here[1] :] - 1, own[1][here[1] :])
    by_edit, cells_edit, _ = unlike(n, mine, new)
    by_next, cells_next, _ = unlike(n, mine, nexts)
    return [
        chars[:-1], [hashlib.sha256(x).hexdigest() for x in changed], Sketches(n, CELLS, *mine).texts(size[:n]), Sketches(n, CELLS, *new).texts(new_size),
        likeness(size[:n], new_size, by_edit), likeness(size[:n], size[1:], by_next), size[:n], cells_edit, cells_next,
    ]
