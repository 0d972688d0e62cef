"""Experiments of a configuration file: builds and searches by name, rounds and sweeps, timings."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearword.functions import formulas
from nearword.operators import search
from nearword.plans import index, workload
from nearword.sources import properties, text


@dataclass(frozen=True)
class Outcome:
    """``rows``: results keyed by query_no, or a build's message; ``seconds``: of each query, or of the build; ``postings``: that each query's terms have."""

    config: properties.Config
    rows: DataFrame
    seconds: list[float]
    postings: list[int] = field(default_factory=list)

    @property
    def average_ms(self) -> float:
        return 1000 * sum(self.seconds) / max(1, len(self.seconds))


def index_path(config: properties.Config, kind: str) -> str:
    return f"{config.folder}/{kind}-{properties.dataset_name(config.features)}"


def build(spark: SparkSession, config: properties.Config, kind: str) -> Outcome:
    began = time.perf_counter()
    path = index_path(config, kind)
    features = text.read_features(spark, config.features, most=config.most_tuples)
    index.save(index.build(features, kind, config.block_size), path, "overwrite")
    message = index.built_message(index.open_index(spark, path))
    return Outcome(config, spark.createDataFrame(message.collect(), message.schema), [time.perf_counter() - began])


def run_search(spark: SparkSession, config: properties.Config, kind: str, blended: bool = False) -> Outcome:
    """Every query of the workload after the warm-up ones; results are kept by query, not only the last one's.

    ``blended``: features by nearness to the query's point and relevance; else objects by their neighbourhood.
    """
    opened = index.open_index(spark, index_path(config, kind)).persisted()
    objects = None if blended else text.load_objects_once(spark, config.objects, f"{config.folder}/objects-{properties.dataset_name(config.objects)}")
    todo = workload.queries(opened.term_info, config.query_type, config.n_warm_up + config.n_queries, config.n_keywords, config.seed, config.keywords, config.n_most_frequent, config.space_max)
    rows, seconds, read = [], [], []
    for no, query in enumerate(todo):
        began = time.perf_counter()
        if blended:
            found = search.blended(opened, query.lat, query.lon, formulas.space_diagonal(config.space_max), query.keywords, config.k, config.alpha)
        else:
            found = search.preference(opened, objects, query.keywords, config.neighbourhood, config.radius, config.k, config.grouped)
        answer = spark.createDataFrame(found.collect(), found.schema)  # k rows
        if no >= config.n_warm_up:
            seconds.append(time.perf_counter() - began)
            read.append(index.postings_read(opened, query.keywords))
            rows.append(answer.select(F.lit(no - config.n_warm_up).alias("query_no"), F.lit(query.keywords).alias("keywords"), *answer.columns))
    empty = spark.createDataFrame([], "query_no int, keywords string, id long, lat double, lon double, score double" + ", distance double" * blended)
    return Outcome(config, reduce(DataFrame.unionByName, rows) if rows else empty, seconds, read)


EXPERIMENTS = {
    properties.BUILD_IF: lambda spark, c: build(spark, c, "if"),
    properties.BUILD_S2I: lambda spark, c: build(spark, c, "s2i"),
    properties.SEARCH_IF: lambda spark, c: run_search(spark, c, "if"),
    properties.SEARCH_PREFERENCE: lambda spark, c: run_search(spark, c, "s2i"),
    properties.SEARCH_BLENDED: lambda spark, c: run_search(spark, c, "s2i", blended=True),
}


def run(spark: SparkSession, config: properties.Config) -> Outcome:
    """One experiment; ValueError for a name that there isn't. With an output folder, a line about it is appended."""
    if config.name not in EXPERIMENTS:
        raise ValueError(f"unknown experiment: {config.name!r}")
    out = EXPERIMENTS[config.name](spark, config)
    if config.debug:
        out.rows.show(truncate=False)
    if config.output:
        values = (config.label, config.neighbourhood, config.k, config.n_keywords, float(config.radius), config.round)
        values += (out.average_ms, 1000 * sum(out.seconds), sum(out.postings))
        names = "label string, neighbourhood string, k int, keywords int, radius double, round int, avg_ms double, total_ms double, postings long"
        row = spark.createDataFrame([values], names)
        text.append_rows(row, config.output, header=False)
    return out


def run_all(spark: SparkSession, path: str, shared: bool = False) -> list[Outcome]:
    """All rounds and combinations of a configuration file of the driver; ``shared``: of a store that Spark reads."""
    return [run(spark, c) for c in properties.configs(path, spark if shared else None)]
