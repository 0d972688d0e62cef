"""Configurations: ``key = value`` lines, ``#`` for comments, ``;`` between the values of a sweep."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from nearword.functions.formulas import neighbourhood

BUILD_IF, BUILD_S2I, SEARCH_IF, SEARCH_PREFERENCE = "IFBuildIndex", "S2IBuildIndex", "IFSearch", "PreferenceSearch"
#: The search that blends distance and text, for which configurations have no name of their own elsewhere.
SEARCH_BLENDED = "S2ISearch"


def parse(text: str) -> dict[str, str]:
    """The last value of each key."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in "#!":
            continue
        key, mark, value = re.match(r"([^=:\s]+)\s*([=:]?)\s*(.*)", line).groups()
        out[key] = value.strip() if mark or value else ""
    return out


def load(path: str, spark=None) -> dict[str, str]:
    """A file of the driver, or with a session one of any store that Spark reads."""
    if spark is not None:
        return parse(spark.read.text(path, wholetext=True).first()[0])
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def sweep(properties: dict[str, str]) -> list[dict[str, str]]:
    """Every combination of the ``;``-separated values, and of the rounds."""
    split = {k: [v.strip() for v in value.split(";") if v.strip()] or [""] for k, value in properties.items()}
    first, last = int(properties.get("experiment.startRound") or 1), int(properties.get("experiment.endRound") or 1)
    split["experiment.round"] = [str(r) for r in range(first, last + 1)]
    return [dict(zip(split, values, strict=True)) for values in itertools.product(*split.values())]


@dataclass(frozen=True)
class Config:
    """One experiment. Keys without a counterpart here are kept in ``other``."""

    name: str = SEARCH_PREFERENCE
    round: int = 1
    n_keywords: int = 1
    k: int = 10
    n_queries: int = 1
    query_type: str = "mostFrequent"
    n_most_frequent: int = 5
    keywords: str = ""
    neighbourhood: str = "range"
    radius: float = 0.005
    alpha: float = 0.5
    n_warm_up: int = 0
    grouped: bool = False
    debug: bool = False
    folder: str = ""
    output: str = ""
    features: str = ""
    objects: str = ""
    space_max: float = 10000.0
    most_tuples: int | None = None
    block_size: int = 4096
    other: dict[str, str] = field(default_factory=dict)

    @property
    def label(self) -> str:
        """What tells this experiment's results from others'."""
        return f"{self.name}-{dataset_name(self.features)}-{self.neighbourhood}-k{self.k}-q{self.n_keywords}-r{self.radius}-round{self.round}"

    @property
    def seed(self) -> int:
        """The same for a data set and round, whatever else is swept."""
        value = 0
        for c in f"{dataset_name(self.features)}{self.round}":
            value = (value * 31 + ord(c)) & 0x7FFFFFFF
        return value


#: Configuration keys and the fields they set.
KEYS = {
    "experiment.name": "name", "experiment.round": "round", "experiment.debug": "debug", "experiment.plusMode": "grouped", "experiment.folder": "folder", "experiment.output": "output",
    "query.numKeywords": "n_keywords", "query.numResults": "k", "query.numQueries": "n_queries", "query.type": "query_type", "query.numMostFrequentTerms": "n_most_frequent", "query.keywords": "keywords",
    "query.neighborhood": "neighbourhood", "query.radius": "radius", "query.alpha": "alpha", "query.numWarmUpQueries": "n_warm_up",
    "dataset.featuresFile": "features", "dataset.objectsFile": "objects", "dataset.spaceMaxValue": "space_max", "dataset.maxNumTuples": "most_tuples", "disk.blockSize": "block_size",
}


def config(properties: dict[str, str]) -> Config:
    """The experiment of a configuration without sweeps."""
    values, other = {}, {}
    kinds = {name: type(getattr(Config(), name)) for name in KEYS.values()}
    for key, value in properties.items():
        name = KEYS.get(key)
        if name is None:
            other[key] = value
        elif name == "neighbourhood":
            values[name] = neighbourhood(value)
        elif name == "most_tuples":
            values[name] = int(value) if value and int(value) > 0 else None
        elif kinds[name] is bool:
            values[name] = value.lower() in ("true", "yes", "1")
        else:
            values[name] = kinds[name](value)
    return Config(**values, other=other)


def configs(path: str, spark=None) -> list[Config]:
    return [config(p) for p in sweep(load(path, spark))]


def dataset_name(path: str) -> str:
    """A file's name without its folder, its ending and what follows the first hyphen."""
    return re.sub(r"\.[^.]*$", "", path.rpartition("/")[2]).partition("-")[0]
