"""Rounds of judgements as a stream with state, and the cards that are handed out."""

import json

from loomstone.streaming import rounds


def drop(path, number, *judgements):
    rows = [{"question_id": q, "record_id": r, "round": number, "place": k, "decision": d} for k, (q, r, d) in enumerate(judgements)]
    (path / f"round_{number:03d}.json").write_text("\n".join(json.dumps(x) for x in rows))


def test_a_card_is_judged_once_across_rounds_and_restarts(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    out, state = f"{tmp_path}/out", f"{tmp_path}/cp"

    def run():
        stream = spark.readStream.schema(rounds.JUDGEMENT).json(str(files))
        rounds.follow_rounds(stream, out, state).awaitTermination()
        return {(r["record_id"], r["round"], r["place"]): (r["accepted"], r["first_round"]) for r in spark.read.parquet(out).collect()}

    drop(files, 1, ("q", "a", "retain"), ("q", "b", "uncertain"), ("q", "a", "retain"), ("q", None, "retain"))
    assert run() == {("a", 1, 0): (True, 1), ("b", 1, 1): (True, 1), ("a", 1, 2): (False, 1)}
    drop(files, 2, ("q", "c", "retain"), ("q", "b", "deprioritize"))
    first = run()  # a new query over the same state
    assert first[("b", 2, 1)] == (False, 1) and first[("c", 2, 0)] == (True, 2) and len(first) == 5
    assert run() == first  # nothing new, nothing said twice
    told = {r["record_id"]: (r["n"], r["differs"], r["first_round"]) for r in rounds.refused(spark.read.parquet(out)).collect()}
    assert told == {"a": (1, False, 1), "b": (1, True, 1)}
    cards = spark.createDataFrame([("q", r, k, t) for k, (r, t) in enumerate([("a", "x"), ("d", "x" * 50), ("c", None), ("e", "y" * 40), ("f", None), ("g", "z")])], "question_id string, record_id string, rank int, title string")
    ask = lambda **most: [r["record_id"] for r in rounds.open_cards(cards, spark.read.parquet(out), ["rank"], ["title"], **most).orderBy("rank").collect()]
    assert ask() == ["d", "e", "f", "g"]
    assert ask(most_cards=2) == ["d", "e"] and ask(most_characters=10) == ["d"] and ask(most_characters=90) == ["d", "e", "f"]


def test_state_is_written_when_a_key_is_first_judged_only():
    import pandas as pd

    class State:
        exists, written = False, 0

        def update(self, held):
            self.get, self.exists, self.written = held, True, self.written + 1

    state, frame = State(), lambda *rows: pd.DataFrame([("q", "a", *r) for r in rows], columns=rounds._COLUMNS)
    (first,) = rounds._first_counts(("q", "a"), iter([frame((2, 0, "x")), frame((1, 5, "y"), (1, 4, "z"))]), state)
    assert first["decision"].tolist() == ["z", "y", "x"] and first["accepted"].tolist() == [True, False, False] and set(first["first_decision"]) == {"z"}
    (second,) = rounds._first_counts(("q", "a"), iter([frame((0, 0, "w"))]), state)
    assert not second["accepted"][0] and second["first_round"][0] == 1 and state.written == 1
