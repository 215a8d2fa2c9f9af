"""Persistent alarms on a stream of snapshots: frozen index parameters, one small state per asset."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.health import apply_index

BLOCKS = 256


def _ready(code: np.ndarray, pos: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which rows, in order of (code, pos) and each pair once, follow their asset's ``place`` without a gap."""
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    nth = np.arange(len(code)) - np.repeat(starts, np.diff(starts, append=len(code)))
    return pos - place[code] == nth


def _runs(code: np.ndarray, hot: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Length of the run of hot rows that ends at each row; ``run`` is what an asset's earlier rows ended with."""
    at = np.arange(len(code))
    start = np.repeat(np.flatnonzero(np.diff(code, prepend=-1)), np.unique(code, return_counts=True)[1])
    cold = np.maximum.accumulate(np.where(hot, -1, at))
    return np.where(cold >= start, at - cold, at - start + 1 + run[code])


def stream_flags(rows: DataFrame, key: str, value: str, threshold: float, q: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """(key, pos, value, flag): 1 from the q-th of consecutive snapshots above the threshold, each snapshot once.

    Positions of an asset are 0, 1, 2, ... in any order and any cut into batches. What comes before its predecessors waits
    in the state, so the flags are those of the whole series; a position that never comes holds back what follows it. A
    position seen again is ignored, a NULL value ends a run. State per asset: a place, a run length, and what waits. The
    assets of one of ``blocks`` hashed blocks share a state and are advanced together; a checkpoint goes with its number.
    """
    kind = rows.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("pos", T.LongType()), T.StructField(value, T.DoubleType()), T.StructField("flag", T.IntegerType())])
    kept = f"names array<{kind.simpleString()}>, next array<long>, run array<int>, waiting_for array<int>, waiting_pos array<long>, waiting_value array<double>"

    def advance(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, place, run, late, late_pos, late_value = state.get if state.exists else ([], [], [], [], [], [])
        pdf = pd.concat(list(batches), ignore_index=True)
        if group[1]:  # the asset without a name
            fresh, names = np.zeros(len(pdf), int), [None]
        else:
            of, found = pd.factorize(pd.concat([pd.Series(list(names), dtype=pdf[key].dtype), pdf[key]], ignore_index=True))
            fresh, names = of[len(names) :], found.tolist()
        place, run = (np.r_[np.asarray(x, np.int64), np.zeros(len(names) - len(x), np.int64)] for x in (place, run))
        # what waits comes first, so the first of equal positions is the one that counts
        code, pos = np.r_[np.asarray(late, np.int64), fresh], np.r_[np.asarray(late_pos, np.int64), pdf["pos"].to_numpy(np.int64)]
        v = np.r_[np.asarray(late_value, float), pdf[value].to_numpy(float)]
        order = np.lexsort((pos, code))
        code, pos, v = code[order], pos[order], v[order]
        new = (pos >= place[code]) & ((np.diff(code, prepend=-1) != 0) | (np.diff(pos, prepend=-1) != 0))
        code, pos, v = code[new], pos[new], v[new]
        go = _ready(code, pos, place)
        c, length = code[go], _runs(code[go], v[go] > threshold, run)
        made = {key: np.array(names, object)[c], "pos": pos[go], value: v[go], "flag": (length >= q).astype("int32")}
        last = np.flatnonzero(np.diff(c, append=-1))
        place, run[c[last]] = place + np.bincount(c, minlength=len(names)), np.minimum(length[last], q)
        waits = [None if x != x else x for x in v[~go].tolist()]
        state.update((names, place.tolist(), run.tolist(), code[~go].tolist(), pos[~go].tolist(), waits))
        if len(c):
            yield pd.DataFrame(made, columns=out.names)

    picked = rows.select(key, F.col("pos").cast("long").alias("pos"), F.col(value).cast("double").alias(value)).where(F.col("pos").isNotNull())
    picked = picked.withColumns({"_block": F.pmod(F.xxhash64(key), F.lit(blocks)), "_none": F.col(key).isNull()})
    return picked.groupBy("_block", "_none").applyInPandasWithState(advance, out, kept, "append", GroupStateTimeout.NoTimeout)


def stream_index_flags(components: DataFrame, params: DataFrame, threshold: float, q: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """Flags of the frozen index on a stream of raw components (fold_id, asset_id, pos, E, C); ``params`` is a stored fit."""
    return stream_flags(apply_index(components, params), "asset_id", "index", threshold, q, blocks)
