"""Queries over keyed state: what a stream of all turns tells, given the table as one batch."""

from __future__ import annotations

from hashloom.sources import files
from hashloom.streaming import keyed

from . import dialogue

#: The state store on disk, which keyed state in pieces needs.
STORE, ON_DISK = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decayed_cache_states(spark, sf_dir):
    """The cache over decaying contexts (decayed_context_fold) as keyed state, with blocks of 64 hashes."""
    spark.streams.active  # noqa: B018 - starts the keeper of state stores, which a table alone does not
    path, before = files.scratch(spark, "states"), spark.conf.get(STORE)
    spark.conf.set(STORE, ON_DISK)
    try:
        keyed.decayed_cache(dialogue.ordered(spark, sf_dir).select("conv_id", "turn", "hash"), 20, 2, block=64).write.parquet(path)
    finally:
        spark.conf.set(STORE, before)
    return spark.read.parquet(path)


QUERIES = {"decayed_cache_states": decayed_cache_states}
SQL = {"decayed_cache_states": dialogue.SQL["decayed_context_fold"]}
