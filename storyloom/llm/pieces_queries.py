"""Query of the piece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import pieces
from storyloom.llm.common import table


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of pieces, a hash of their ids, the N best scores (in millionths) and a hash of the other N - 1 paths."""
    found = pieces.encode(table(spark, sf_dir, "documents"))
    hashes = F.xxhash64("ids").alias("ids_hash"), F.xxhash64(F.to_json("others")).alias("others_hash")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), *hashes, "scores", "round_trip")


QUERIES = {"op4_pieces": op4_pieces}
ORACLES: dict[str, str] = {}
