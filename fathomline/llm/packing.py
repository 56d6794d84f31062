"""Best-fit packing with certified repacking (operator 5).

Documents are turned into pieces of at most 2048 tokens; pieces are packed into sequences. Pieces are dealt into
partitions, and each is packed best-fit decreasing. A lower bound from dual-feasible functions certifies the number
of its sequences. What no bound certifies, and in any case each partition's emptiest sequences, is given back,
exchanged between fewer partitions, and packed anew; the last round has one partition, whose rows are few since each
round gives back a small part only. In it, as long as its bound certifies fewer sequences, the emptiest sequences and others drawn
beside them exchange their pieces and are packed anew by best-fit decreasing, of lengths stretched a little at random from the second
time on, until the bound is met or TURNS exchanges in a row gain nothing. The number of sequences and the bound of the whole are returned
with each row; where they are equal, no packing has fewer.

Defined results: pieces of equal length go in the order of their hashes; a null or empty text is the single id 0; repeated rows are packed each for itself; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, trimmed

CAPACITY = 2048
END_ID = 0
#: Pieces in a partition, partitions that exchange with each other, and the share of its sequences a partition with a gap gives back.
PARTITION_ROWS, FAN_IN, GIVE_BACK = 20_000, 8, 0.1
#: Exchanges in a row without a gain after which the last partition stops.
TURNS = 40

#: Characters whose class may differ between versions of Unicode tables: such texts go to the reference tokenizer.
_RARE = re.compile("[^\x00-ɏ̀-῿ -⁯₠-₿　-ヿ一-龥가-힣]")


class Tokens:
    """Ids by the byte-level BPE file for `tokenizers`, computed from the same vocabulary as ranks where that is sure to agree."""

    def __init__(self, path: str, ranks: str | None):
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not _RARE.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def default_tokens() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of n ids, and n: full pieces, but the first may be shorter."""
    return [0] + list(range(n % capacity or capacity, n, capacity)) + [n]


def pieces(docs: DataFrame, tokenizer: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and a random but repeatable `deal`."""
    files = tokenizer or default_tokens()
    small_batches(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*files)
        for batch in rows:
            out: list[tuple] = []
            for doc, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(tokens.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                at = cut(len(ids), capacity)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            cols = np.array(out, np.int64).reshape(-1, 5)
            yield pa.record_batch({"doc_id": batch.column(0).take(pa.array(cols[:, 0])), **{c: pa.array(cols[:, i].astype(np.int32) if i == 1 else cols[:, i]) for i, c in ((1, "piece"), (2, "start"), (3, "length"), (4, "ids_crc32"))}})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that any packing needs, by the dual-feasible functions u(k) and the one that drops sizes below a cut."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of(n: np.ndarray, capacity: int = CAPACITY) -> int:
    """The same of how many pieces there are of each length."""
    size = np.arange(capacity + 1)
    best = math.ceil((n * size).sum() / capacity)
    cut_at = np.flatnonzero(n[: capacity // 2 + 1])  # for each cut, sizes over capacity - cut count full, sizes under the cut nothing
    upto, bytes_ = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    if len(cut_at):
        large, middle = upto[-1] - upto[capacity - cut_at + 1], bytes_[capacity - cut_at + 1] - bytes_[cut_at]
        best = max(best, int((large - -middle // capacity).max()))
    for k in range(1, 13):  # x -> x where (k+1)x is whole bins, else floor((k+1)x)/k
        part = (k + 1) * size
        value = np.where(part % capacity == 0, size * k, part // capacity * capacity)
        best = max(best, math.ceil((n * value).sum() / (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY, order: np.ndarray | None = None) -> list[list[int]]:
    """Bins of indices; each length goes to the fullest bin it fits in, longest first or in an order given."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    open_at = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable") if order is None else order:
        x = int(lengths[i])
        fits = open_at >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_at &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(int(i))
        if room > x:
            free[room - x].append(b)
            open_at |= 1 << (room - x)
    return bins


def exchanged(lengths: np.ndarray, bins: list[list[int]], capacity: int = CAPACITY, turns: int = TURNS) -> list[list[int]]:
    """Bins repacked until their number meets the bound, or `turns` exchanges in a row gain nothing.

    An exchange takes the emptiest bins and as many drawn at random, and keeps what it makes of them if these are fewer, or as many and
    more unequal (squares of their sizes add up to more), as room in one place is of more use.
    """
    bound, idle, r = lower_bound(lengths, capacity), 0, np.random.default_rng(len(lengths))
    size = np.array([int(lengths[b].sum()) for b in bins])
    while len(bins) > bound and idle < turns:
        share = min(len(bins), max(2, math.ceil(GIVE_BACK * len(bins))))
        took = np.unique(np.concatenate([np.argsort(size, kind="stable")[:share], r.choice(len(bins), share, replace=False)]))
        items = np.array([i for k in took for i in bins[k]])
        order = np.argsort(-lengths[items] * (1 + (0.3 * r.random(len(items)) if idle else 0)), kind="stable")
        new = [[int(items[i]) for i in b] for b in best_fit_decreasing(lengths[items], capacity, order)]
        new_size = np.array([int(lengths[b].sum()) for b in new])
        idle = 0 if len(new) < len(took) else idle + 1
        if len(new) < len(took) or len(new) == len(took) and (new_size**2).sum() > (size[took] ** 2).sum():
            rest = np.setdiff1d(np.arange(len(bins)), took)
            bins, size = [bins[k] for k in rest] + new, np.concatenate([size[rest], new_size])
    return bins


def _packer(capacity: int, turn: int, last: bool):
    def run(key, table):
        table = table.sort_by("deal")
        lengths = table["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        back: set[int] = set()
        if last:
            bins = exchanged(lengths, bins, capacity)
        else:
            room = [(capacity - int(lengths[b].sum()), k) for k, b in enumerate(bins)]
            gap = len(bins) > lower_bound(lengths, capacity)
            back = {k for left, k in heapq.nlargest(max(1, math.ceil(GIVE_BACK * len(bins))) if gap else 1, room) if left > 0}
        seq, place = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
        first = (turn << 52) | (key[0].as_py() << 24)
        for k, b in enumerate(bins):
            if k not in back:
                at = 0
                for i in b:
                    seq[i], place[i] = first | k, at
                    at += int(lengths[i])
        out = table.drop_columns([c for c in ("part", "sequence_id", "offset") if c in table.column_names])
        return out.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(place))

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of at most capacity."""
    found = stored(found.withColumn("deal", F.xxhash64(*found.columns)), "pieces")
    full = found.filter(F.col("length") == capacity).drop("deal")  # each is a sequence of its own
    done = [full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    rest, turn = found.filter(F.col("length") < capacity), 0
    rows = rest.count()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    parts = max(1, math.ceil(rows / partition_rows))
    while rows:
        last = parts == 1
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("deal", F.lit(turn)), F.lit(parts)).cast("int"))
        turn += 1
        tried = stored(dealt.groupBy("part").applyInArrow(_packer(capacity, turn, last), schema), f"packed{turn}")
        done.append(tried.filter("sequence_id >= 0").drop("deal"))
        if last:
            break
        rest = tried.filter("sequence_id < 0").drop("sequence_id", "offset")
        rows = rest.count()
        parts = max(1, min(math.ceil(parts / FAN_IN), math.ceil(rows / partition_rows))) if parts <= FAN_IN else max(2, math.ceil(parts / FAN_IN))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def certified(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_sequences, and lower_bound, the fewest that any packing of all these pieces needs."""
    by_length = packed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("first")).collect()  # `capacity` rows at most
    n = np.zeros(capacity + 1, np.int64)
    for r in by_length:
        n[r["length"]] = r["n"]
    return packed.sparkSession.createDataFrame([(sum(r["first"] for r in by_length), bound_of(n, capacity) if by_length else 0)], "n_sequences long, lower_bound long")


def best_fit_packing(docs: DataFrame, tokenizer: tuple[str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all documents, and n_sequences and lower_bound of the whole."""
    packed = pack(pieces(docs, tokenizer, capacity), capacity)
    return packed.crossJoin(F.broadcast(certified(packed, capacity)))  # one row
