"""First-wins dedup by hash with keyed state, with hashes known before, retries and expiry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state store that keeps its state outside of the executors' heap.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys of the state, and what each has: the hashes of its bucket that were taken, and since when (milliseconds).
BUCKETS, TAKEN = 1 << 14, "hashes array<string>, since array<long>"
NEVER = np.iinfo(np.int64).max


def stream_first_by_hash(
    stream: DataFrame, hash_col: str, place: str, ok: Column | None = None, known: DataFrame | None = None, keep_ms: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """(place, status) of every row of a stream: new, duplicate, retry or empty, as ``state.first_by_hash`` gives.

    ``place`` is a number that ascends from batch to batch and tells rows apart. Of a hash's good rows the first is new, rows
    before it are to be tried again and those after it are duplicates. Rows whose hash is in ``known`` are duplicates: each batch is
    joined with it, so they need no state. ``keep_ms`` forgets a hash so long after its first good row was seen (never by default; known ones
    stay). Rows without a hash need no state either.

    The state is keyed by one of ``buckets`` (fixed for a checkpoint) that a hash falls into, so Python is called for a bucket, not for
    each hash; a batch reads and writes the buckets it meets. Hashes by the hundred million want more of them. A batch's rows of a
    bucket are one task's, three numbers each, so bound the batch.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    good = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    hashed = stream.select(F.nullif(F.col(hash_col), F.lit("")).alias("hash"), F.col(place).cast("long").alias("place"), good.alias("good"))
    status = F.when(F.col("hash").isNull(), "empty")
    if known is not None:
        before = known.select(F.col(hash_col).alias("hash"), F.lit(True).alias("known")).where("hash IS NOT NULL AND hash <> ''").distinct()
        hashed, status = hashed.join(before, "hash", "left"), status.when(F.col("known"), "duplicate")
    hashed = hashed.withColumn("status", status)

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        taken = dict(zip(*state.get, strict=True)) if state.exists else {}
        if keep_ms:
            taken = {h: since for h, since in taken.items() if since + keep_ms > now}
        if not state.hasTimedOut:
            number, held = {}, []
            for part in parts:
                codes, found = pd.factorize(part["hash"])
                held.append((np.array([number.setdefault(h, len(number)) for h in found], np.int64)[codes], part["place"].to_numpy(), part["good"].to_numpy().astype(bool)))
            code, place, ok = (np.concatenate(x) for x in zip(*held, strict=True))
            least = np.full(len(number), NEVER)
            np.minimum.at(least, code[ok], place[ok])
            seen = np.fromiter((h in taken for h in number), bool, len(number))
            status = np.where(seen[code] | (place > least[code]), "duplicate", np.where(place < least[code], "retry", "new"))
            yield pd.DataFrame({"place": place, "status": status.astype(object)})
            taken |= {h: now for h, k in number.items() if least[k] < NEVER and not seen[k]}
        if taken:
            state.update((list(taken), list(taken.values())))
            if keep_ms:
                state.setTimeoutDuration(max(min(taken.values()) + keep_ms - now, 1))
        elif state.exists:
            state.remove()

    told = hashed.where("status IS NULL").select(F.pmod(F.xxhash64("hash"), F.lit(buckets)).alias("bucket"), "hash", "place", "good").groupBy("bucket").applyInPandasWithState(
        first, "place long, status string", TAKEN, "append", GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    )
    return told.unionByName(hashed.where("status IS NOT NULL").select("place", "status"))
