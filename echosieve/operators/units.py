"""Units of documents: fragments that one step over arrays takes together.

Matching a fragment needs only those within the widest radius, so a long document is split
into units with their halo, and short ones are packed, many to a step. Fragments are shuffled
once; pairs never are."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echosieve.config import Settings

#: Fragments that one unit walks.
UNIT = 8192
#: Fragments of short units that one step takes together.
PACK = 1024


def walk_units(frags: DataFrame, settings: Settings, unit: int = UNIT) -> DataFrame:
    """(doc_id, unit, idx, para_index, tokens, often, whole, walks), and starts_capitalized where
    fragments have it: the fragments that a unit walks and, with walks false, those within the
    widest radius of one of them. often are the tokens of a fragment that more than
    max_candidates_per_token fragments of its document hold; they are left to be counted where a
    unit has its whole document."""
    # by number: a unit's work is far more than its bytes
    parts = int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = settings.paragraph_radius * max(1, settings.growth)
    doc = W.partitionBy("doc_id")
    near = doc.orderBy("para_index").rangeBetween(-reach, reach)
    own = F.floor(F.col("idx") / unit).cast("int")
    more = [c for c in ("starts_capitalized",) if c in frags.columns]
    rows = frags.select("doc_id", "idx", "para_index", "tokens", *more, own.alias("own"))
    rows = rows.withColumns({"first": F.min("own").over(near), "last": F.max("own").over(near), "n": F.count("*").over(doc), "whole": F.max("own").over(doc) == 0})
    rows = rows.withColumn("unit", F.explode(F.sequence("first", "last")))
    index = rows.where(~F.col("whole") & (F.col("n") > settings.max_candidates_per_token)).select("doc_id", "unit", "own", F.explode(F.array_distinct("tokens")).alias("token"))
    over = index.where("unit = own").groupBy("doc_id", "token").agg(F.count("*").alias("df")).where(F.col("df") > settings.max_candidates_per_token).select("doc_id", "token")
    often = index.join(over, ["doc_id", "token"], "left_semi").groupBy("doc_id", "unit").agg(F.collect_set("token").alias("common"))
    rows = rows.repartition(parts, "doc_id", "unit").join(often, ["doc_id", "unit"], "left")  # or a document's units stay in one task
    rows = rows.withColumn("often", F.array_intersect("tokens", "common"))
    return rows.select("doc_id", "unit", "idx", "para_index", "tokens", "often", "whole", *more, (F.col("unit") == F.col("own")).alias("walks"))


def packs(batches, size: int = PACK):
    """Whole units from batches in the order of (doc_id, unit), `size` rows or one unit at a
    time."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        while len(batch):
            new = (batch["doc_id"].ne(batch["doc_id"].shift()) | batch["unit"].ne(batch["unit"].shift())).to_numpy()
            if held:
                end = held[-1].iloc[-1]
                new[0] = end["doc_id"] != batch["doc_id"].iloc[0] or end["unit"] != batch["unit"].iloc[0]
            cuts = new.nonzero()[0]
            cuts = cuts[cuts + rows >= (size if rows < size else 0)]
            cut = int(cuts[0]) if len(cuts) else len(batch)
            if cut:
                held.append(batch.iloc[:cut])
                rows += cut
            batch = batch.iloc[cut:]
            if len(batch):
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def walked(frags: DataFrame, settings: Settings, method: Callable, schema: str, unit: int = UNIT) -> DataFrame:
    """The frames that method(frame of some units, settings) gives for all units."""
    kind = frags.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in packs(batches):
            yield from method(pdf, settings)

    rows = walk_units(frags, settings, unit).sortWithinPartitions("doc_id", "unit", "idx")
    return rows.mapInPandas(run, f"doc_id {kind}, {schema}")
