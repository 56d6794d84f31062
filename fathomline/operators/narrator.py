"""Language-model steps behind an interface: the prompt and the parser are plan expressions; the call is a plug-in.

The default client is offline and repeatable: it names the entities of the prompt in their order. Calls are made by tasks, each with a
client of its own, a few tasks at a time so that a service isn't overrun. Answers are stored by (model, prompt hash) before anything reads
them, and appended to a cache table, so equal prompts are asked once, now and later.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import table_rows
from ..storage import stored

ANSWERS = "model string, prompt_hash string, answer string"


class Client(Protocol):
    name: str

    def ask(self, prompt: str) -> str: ...


class Offline:
    """Ranks the entities in the order in which the prompt lists them."""

    name = "offline"

    def ask(self, prompt: str) -> str:
        names = [line[2:].split(": ")[0] for line in prompt.split("\n") if line.startswith("- ")]
        rows = "\n".join(f"| {n.split(':')[-1]} | {1 / (k + 1):.3f} |" for k, n in enumerate(names[:5]))
        return f"| Entity | Confidence |\n|---|---|\n{rows}\n"


CLIENTS: list[tuple[str, Callable[[str], Client]]] = [("", lambda model: Offline())]


def register_client(mark: str, make: Callable[[str], Client]) -> None:
    """EXT-06: models whose name contains the mark are asked through this client."""
    CLIENTS.insert(0, (mark, make))


def client(model: str) -> Client:
    return next(make for mark, make in CLIENTS if mark in model)(model)


def with_retries(ask: Callable[[str], str], prompt: str, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    for k in range(tries):
        try:
            return ask(prompt)
        except Exception:
            if k == tries - 1:
                raise
            sleep(2.0**k)
    raise AssertionError


def answered(prompts: DataFrame, model: str = "offline", cache: DataFrame | None = None, parallel: int = 8, cache_path: str | None = None) -> DataFrame:
    """EXT-06/07: cluster_id, model, prompt_hash, answer of all prompts; those in the cache aren't asked again.

    cache: model, prompt_hash, answer; cache_path: a table of the same that is read first, and to which new answers are appended.
    parallel: how many tasks call at once. A call that fails three times fails its task, which Spark tries again.
    """
    spark = prompts.sparkSession
    rows = prompts.select("cluster_id", "prompt", F.sha2("prompt", 256).alias("prompt_hash"))
    known = cache_table(spark, cache_path) if cache_path else spark.createDataFrame([], ANSWERS)
    if cache is not None:
        known = known.unionByName(cache.select("model", "prompt_hash", "answer"))
    known = known.filter(F.col("model") == model).dropDuplicates(["prompt_hash"])
    new = rows.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"]).join(known, "prompt_hash", "left_anti").repartition(parallel)
    make = next(make for mark, make in CLIENTS if mark in model)

    def run(batches: Iterator[pa.RecordBatch]):
        asked = None
        for batch in batches:
            asked = asked or make(model)
            said = [with_retries(asked.ask, p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(said), pa.string()), batch.column(0), pa.array(said, pa.string())], names=["model", "prompt_hash", "answer"])

    said = stored(new.select("prompt_hash", "prompt").mapInArrow(run, ANSWERS), "answers")
    every = stored(known.select("model", "prompt_hash", "answer").unionByName(said), "known") if cache_path else known.unionByName(said)
    if cache_path:
        said.write.mode("append").parquet(cache_path)
    return rows.join(every, "prompt_hash").select("cluster_id", "model", "prompt_hash", "answer")


def cache_table(spark: SparkSession, path: str) -> DataFrame:
    """The answers stored at a path so far; none if nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(ANSWERS).parquet(path) if there else spark.createDataFrame([], ANSWERS)


def parsed_answers(answers: DataFrame) -> DataFrame:
    """FN-13: cluster_id, entity, score of the tables in the answers."""
    return answers.select("cluster_id", F.explode(table_rows(F.col("answer"))).alias("x")).select("cluster_id", F.col("x.entity").alias("entity"), F.col("x.confidence").alias("score"))


#: EXT-04/05: root-cause methods by name.
METHODS: dict[str, Callable[..., DataFrame]] = {}


def register_method(name: str, fn: Callable[..., DataFrame]) -> None:
    METHODS[name] = fn


def domain_rules(spark, forbidden: list[tuple[str, str]], required: list[tuple[str, str]], roots: list[str], leaves: list[str]) -> DataFrame:
    """EXT-09: knowledge of a domain as a rule table."""
    rows = [("forbidden", a, b) for a, b in forbidden] + [("required", a, b) for a, b in required] + [("root", a, None) for a in roots] + [("leaf", a, None) for a in leaves]
    return spark.createDataFrame(rows, "rule string, src string, dst string")


def apply_rules(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """EXT-09: edges without forbidden ones, without ways into roots or out of leaves, with the required ones."""
    of = lambda kind: rules.filter(F.col("rule") == kind)
    out = edges.select("src", "dst").join(of("forbidden").select("src", "dst"), ["src", "dst"], "left_anti")
    out = out.join(of("root").select(F.col("src").alias("dst")), "dst", "left_anti").join(of("leaf").select("src"), "src", "left_anti")
    return out.select("src", "dst").union(of("required").select("src", "dst")).distinct()


def chunks(answers: DataFrame, source: str) -> DataFrame:
    """EXT-10: the JSON object in each answer as a retrieval chunk: cluster_id, original_source, component, symptoms."""
    from ..functions.scalar import json_within

    body = F.from_json(json_within(F.col("answer")), "component string, symptoms array<string>")
    rows = answers.select("cluster_id", F.lit(source).alias("original_source"), body.alias("b"))
    return rows.filter("b.component is not null").select("cluster_id", "original_source", "b.component", "b.symptoms")
