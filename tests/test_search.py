import json
from datetime import date

import pytest

from loomstone.sources.search import FileService, SearchSource, segments


def test_segments_and_source(spark, tmp_path):
    days = [date(2020, 1, 1), date(2020, 1, 2), date(2020, 1, 2), date(2020, 7, 9), date(2021, 5, 5)]
    path = tmp_path / "hits.jsonl"
    path.write_text("\n".join(json.dumps({"id": i, "date": d.isoformat(), "title": f"t{i}"}) for i, d in enumerate(days)))
    service = FileService(str(path))
    assert [n for *_, n in segments(service, date(2019, 1, 1), date(2021, 12, 31), 10)] == [4, 1]
    assert [(str(a), n) for a, _, n in segments(service, date(2020, 1, 1), date(2021, 12, 31), 2)] == [("2020-01-01", 1), ("2020-01-02", 2), ("2020-07-01", 1), ("2021-01-01", 1)]
    with pytest.raises(ValueError):
        list(segments(service, date(2020, 1, 1), date(2020, 12, 31), 1))
    spark.dataSource.register(SearchSource)
    rows = spark.read.format("dated_search").options(path=str(path), first="2020-01-01", last="2021-12-31", most="2").load()
    assert rows.count() == 5 and rows.select("segment_first").distinct().count() == 4
