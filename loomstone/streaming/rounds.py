"""Rounds of judgements dropped as files: each card is judged once, across rounds and restarts, and what is open is handed out within a budget.

The stream keeps, for each key, in which round and with which decision it was judged first. State has no time limit: a second judgement is refused however late it comes, and after a restart
from the same checkpoint. Keys are dealt by hash, and a key's rows of one batch are few, so no group grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Cards and characters that are handed out at once (fixed values).
MOST_CARDS, MOST_CHARACTERS = 30, 60_000
JUDGEMENT = "question_id string, record_id string, round long, place long, decision string"
JUDGED = JUDGEMENT + ", accepted boolean, first_round long, first_decision string"


_COLUMNS = [c.split()[0] for c in JUDGEMENT.split(", ")]


def _first_counts(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One frame for each key, made once: most keys have a few rows, so what is done to a frame costs more than the rows."""
    held = state.get if state.exists else None
    rows = list(parts)
    columns = {c: np.concatenate([p[c].to_numpy() for p in rows]) for c in _COLUMNS}
    order = np.lexsort((columns["place"], columns["round"]))  # stable
    accepted = np.zeros(len(order), bool)
    if held is None:
        accepted[:1] = True
        held = (int(columns["round"][order[0]]), columns["decision"][order[0]])
        state.update(held)
    yield pd.DataFrame({c: v[order] for c, v in columns.items()} | {"accepted": accepted, "first_round": held[0], "first_decision": held[1]})


def judged(stream: DataFrame) -> DataFrame:
    """Each judgement (question_id, record_id, round, place, decision) of a stream with accepted, and the round and decision that counts for its key.

    The first one counts: of a batch, the one of the lowest round and place; over batches, the one that came first. A row without key or round is nobody's judgement and is left out.
    """
    rows = stream.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in JUDGEMENT.split(", "))).filter("question_id is not null and record_id is not null and round is not null")
    rows = rows.fillna({"place": 0, "decision": ""})
    return rows.groupBy("question_id", "record_id").applyInPandasWithState(_first_counts, JUDGED, "round long, decision string", "append", GroupStateTimeout.NoTimeout)


def follow_rounds(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write judgements with what became of them to path; only batches that are complete are read from there."""
    return judged(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def refused(judgements: DataFrame) -> DataFrame:
    """Second judgements, by key: how many, and whether one says something else than the first."""
    again = judgements.filter("not accepted").groupBy("question_id", "record_id")
    return again.agg(F.count("*").alias("n"), F.max(F.col("decision") != F.col("first_decision")).alias("differs"), F.min("first_round").alias("first_round"))


def open_cards(cards: DataFrame, judgements: DataFrame, order: list[str], texts: list[str], most_cards: int = MOST_CARDS, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """The next cards (question_id, record_id, ...) to be judged: the first open ones in order, until the next would be too many or too much; one at least.

    Nothing is planned ahead, so cards that were handed out and judged don't come again, whatever was handed out with them. A null text has no characters.
    """
    done = judgements.filter("accepted").select("question_id", "record_id")
    size = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in texts), F.lit(0))
    first = cards.join(done, ["question_id", "record_id"], "left_anti").withColumn("__size", size).orderBy(*order, "question_id", "record_id").limit(most_cards)
    so_far = Window.orderBy(*order, "question_id", "record_id").rowsBetween(Window.unboundedPreceding, 0)  # over most_cards rows
    return first.withColumn("__sum", F.sum("__size").over(so_far)).withColumn("__at", F.row_number().over(Window.orderBy(*order, "question_id", "record_id"))).filter((F.col("__at") == 1) | (F.col("__sum") <= most_characters)).drop("__size", "__sum", "__at")
