"""Error records from lines: literal rows, and how often a line is parsed."""
from tracemill.operators import errors as E
from tracemill.sources import tables as B


def test_lines_are_parsed_once_and_only_objects_count(spark):
    lines = [' [{"event_id": "e1", "what": "timeout of 1", "count": 2, "date": "2024-01-05"},', '{"event_id": "e1", "what": "timeout of 2"}', '{"event_id": "e2", "what": "all is well"}',
             "{not json", "[1, 2]", '"{"', "", "null", '{"event_id": 3, "key": "crash failed"}]', "[ \t{}", None]
    df = spark.createDataFrame([("p", k, line) for k, line in enumerate(lines)], "path string, ordinal long, line string")
    records = B.parse_error_lines(df)
    assert [(r.ordinal, r.event_id, r.what) for r in records.orderBy("ordinal").collect()] == [(0, "e1", "timeout of 1"), (1, "e1", "timeout of 2"), (2, "e2", "all is well"), (8, "3", None), (9, None, None)]
    events = E.failure_events(records)
    assert {(r.event_key, r.error_text, r.cnt) for r in events.collect()} == {("e1", "timeout of 1", 2), ("3", "crash failed", 1)}
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse") == 1, plan
