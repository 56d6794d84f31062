"""Quality rules: text statistics and a perplexity band per language (operator 9).

The language model is one of real characters, see `characters`; it grows with the corpus. Each value of lang has its own model
and band.

Defined results: null text counts as empty (no words, so base_failed and not kept); a null lang is a language of
its own; where no text of a language counts for its model, it has no band and the base rules alone decide; repeated rows are judged one by one, alike; an empty table gives an empty result; other columns of the
input are ignored by `score` and kept by `keep`, where the judgement carries clashing names no further than its own
row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import characters
from .characters import MIN_WORDS, SYMBOL, TRUST
from .common import SPACE, mix, small_batches, spare2, steps, stored, texts_of, trimmed

#: Bands: the median log perplexity per character of the texts of a language, less and more this many interquartile
#: ranges, and the least widths on either side: texts that mix languages lie well above the median, though they are sound.
SPREAD, LEAST_BELOW, LEAST_ABOVE = 4.0, 0.12, 0.9
#: The mean over a short text varies more: the bands of a text are wider by this over the root of its characters.
SHORT = 1.5
#: Bytes of texts that one row of a block holds on its way to the scoring task.
PACKED_BYTES = 4 << 20


def held(docs: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """The rows with their block, model and fold, the same each time they are read."""
    given = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("given")
    fold = F.coalesce(F.xxhash64("text", F.lit(9)).bitwiseAND(1), F.lit(0)).cast("int").alias("fold")
    rest = [F.coalesce("lang", F.lit("")).alias("model"), fold, "text", given]
    shift = rows.bit_length() - 1
    try:  # rows of files are numbered already
        return docs.select(F.xxhash64("_metadata.file_path", F.shiftright("_metadata.row_index", shift)).alias("_block"), *rest)
    except AnalysisException:
        return stored(docs.select(F.shiftright(F.monotonically_increasing_id(), shift).alias("_block"), *rest), "held")


def _facts(text: bytes) -> tuple[int, int, int]:
    """Words, repeated lines, and words in repeated 3-word windows."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    twice = 0
    if n > 3:
        w = mix(np.fromiter(map(hash, words), np.int64, n).view(np.uint64))
        g = w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:] * np.uint64(0x165667B19E3779F9)
        order = np.argsort(g, kind="stable")
        same = g[order[1:]] == g[order[:-1]]
        if same.any():
            hit = np.zeros(n - 2, bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            cover[:-2] |= hit
            cover[1:-1] |= hit
            cover[2:] |= hit
            twice = int(cover.sum())
    return n, len(lines) - len(set(lines)), twice


def packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def unpack(column: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in column])


def _pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a _block, as few rows of the block and its rows without it, as bytes."""
    out = lambda block, some: pa.record_batch({"_block": pa.array([block]), "bytes": pa.array([packed(pa.Table.from_batches(some).drop_columns(["_block"]))], pa.binary())})
    some: list[pa.RecordBatch] = []
    now, size = None, 0
    for block, batch in characters.by_block(rows):
        if some and (block != now or size > PACKED_BYTES):
            yield out(now, some)
            some, size = [], 0
        some.append(batch)
        now, size = block, size + batch.nbytes
    if some:
        yield out(now, some)


def _score(parts: int):
    def run(key, docs, told):
        """Statistics and log perplexity of a block's documents; told: the probabilities of its grams."""
        docs = unpack(docs["bytes"])
        answers: dict[str, dict[int, bytes]] = {}
        for model, part, data in zip(*(told[c].to_pylist() for c in ("model", "part", "data"))):
            answers.setdefault(model, {})[part] = data
        raw, at = texts_of(docs["text"])
        n = docs.num_rows
        facts = np.zeros((n, 5), np.int64)
        logp = np.zeros(n)
        part = None
        for lo, hi in steps(at):
            part, own = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            if len(part):
                ends = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[own])
                facts[lo:hi, 1] = ends(~SPACE[part] & ((part & 0xC0) != 0x80))
                facts[lo:hi, 2] = ends(SYMBOL[part])
            for k in range(lo, hi):
                if own[k - lo] < own[k - lo + 1]:
                    facts[k, [0, 3, 4]] = _facts(part[own[k - lo] : own[k - lo + 1]].tobytes())
        empty = np.diff(at) == 0
        del raw, at, part
        fold = docs["fold"].to_numpy()
        for model, rows in characters.models_of(docs["model"]):
            take = rows.to_numpy()
            logp[take] = characters.log_perplexity(docs["text"].take(rows), fold[take], answers.get(model, {}), parts)
        new = {name: pa.array(facts[:, i]) for i, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
        return pa.table({"given": docs["given"], "text": docs["text"], **new, "log_perplexity": pa.array(logp, mask=empty), "model": docs["model"]})

    return run


def _scored(docs: DataFrame, columns: list[str]) -> DataFrame:
    """given (the other columns), text, statistics, log perplexity and model of each row."""
    from pyspark.sql.types import StructField, StructType

    small_batches(docs.sparkSession)
    size, parts = characters.block_rows(docs)
    rows = held(docs, columns, size)
    stats = docs.sparkSession.createDataFrame([], _STATS).schema
    schema = StructType([rows.schema["given"], StructField("text", rows.schema["text"].dataType), *stats.fields])
    told = characters.answers(rows, parts)
    whole = rows.mapInArrow(trimmed(_pack), "_block long, bytes binary")
    return whole.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(spare2(_score(parts)), schema)


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, model string"


def bands(scored: DataFrame) -> DataFrame:
    """The lower and upper border of each language, from the texts that count for its model; a language without such texts has none."""
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000)
    fit = scored.filter((F.col("n_words") >= MIN_WORDS) & (TRUST * F.col("n_symbols") <= F.col("n_words")) & F.col("log_perplexity").isNotNull()).groupBy("model").agg(q.alias("q"))
    wide = SPREAD * (F.col("q")[2] - F.col("q")[0])
    low, high = F.col("q")[1] - F.greatest(F.lit(LEAST_BELOW), wide), F.col("q")[1] + F.greatest(F.lit(LEAST_ABOVE), wide)
    return stored(fit.select("model", low.alias("low"), high.alias("high")), "bands")


def _judged(scored: DataFrame) -> DataFrame:
    """Adds base_failed, the band of the language and kept."""
    slack = SHORT / F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        scored.join(bands(scored), "model", "left").withColumn("base_failed", failed)
        .withColumn("kept", ~failed & F.coalesce(F.col("log_perplexity").between(F.col("low") - slack, F.col("high") + slack), F.lit(True)))
    )


def score(docs: DataFrame) -> DataFrame:
    """One row per document: statistics, log perplexity per character, the band of its language, base_failed, kept."""
    scored = _scored(docs, ["doc_id"])
    return _judged(stored(scored.select(F.col("given.doc_id").alias("doc_id"), *scored.columns[2:]), "quality"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    judged = _judged(stored(_scored(docs, docs.columns), "quality"))
    return judged.filter("kept").select(*["text" if c == "text" else F.col("given")[c].alias(c) for c in docs.columns])
