"""Edge streams: TRIEST and reservoirs as stateful operators of Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from oremill.functions.ship import ship
from oremill.operators.triest import REPORT, Reservoir, Triest
from oremill.sources.readers import parsed_edges


def read_edges(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream (u, v) of the edge files in a folder, oldest first."""
    return parsed_edges(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder))


def triest_stream(edges: DataFrame, ms: list[int], variant: str = "base", seed: int = 0, strict_capacity: bool = True) -> DataFrame:
    """A stream of REPORT rows, one for each m and micro-batch (output mode update).

    Every m is a key of its own with its own sample as state, at most m edges; edges with a `seq` column
    are taken in its order inside a micro-batch.
    """
    ship(edges.sparkSession)
    ordered = "seq" in edges.columns
    keyed = edges.withColumn("m", F.explode(F.array(*(F.lit(m).cast("long") for m in ms))))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = pickle.loads(state.get[0]) if state.exists else Triest(int(key[0]), variant, seed, strict_capacity)
        held = pd.concat(list(batches))
        if ordered:
            held = held.sort_values("seq")
        x.extend(zip(held["u"].tolist(), held["v"].tolist()))
        state.update((pickle.dumps(x),))
        yield pd.DataFrame([(key[0], variant, x.t, x.sample_size, x.estimate())], columns=["m", "variant", "t", "sample_size", "estimate"])

    return keyed.groupBy("m").applyInPandasWithState(step, REPORT, "state binary", "update", GroupStateTimeout.NoTimeout)


def reservoir_stream(rows: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """A stream (slot, seen, item): the reservoir of `item` (a string column) after each micro-batch."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = pickle.loads(state.get[0]) if state.exists else Reservoir(m, seed)
        for b in batches:
            for item in b["item"].tolist():
                x.add(item)
        state.update((pickle.dumps(x),))
        yield pd.DataFrame({"slot": range(len(x.items)), "seen": x.seen, "item": x.items})

    ship(rows.sparkSession)
    return rows.select("item").withColumn("one", F.lit(0)).groupBy("one").applyInPandasWithState(step, "slot long, seen long, item string", "state binary", "update", GroupStateTimeout.NoTimeout)
