"""Nested JSON text against a plain reading of the rule."""
import json
import random

from pyspark.sql import functions as F

from tracemill import vocab as V
from tracemill.functions import text as T
from tracemill.functions.jsontext import leading_object


def read(value, keys=V.VISIBLE_KEYS):
    match value:
        case bool() | int() | float() | str():
            return str(value)
        case list():
            return "\n".join(read(x) for x in value)
        case dict():
            for k in keys:
                if k in value and (text := read(value[k])):
                    return text
    return ""


def some(r, depth=0):
    kind = r.choice(["text", "text", "number", "truth", "none", "list", "object", "object"] if depth < 5 else ["text", "number", "none"])
    if kind == "text":
        return r.choice(["", "a", "zwei", 'q"uo\\te', "line\nbreak", "{[,:]}", "é🙂", "x|D1", "\t"])
    if kind == "number":
        return r.choice([0, -7, 12345678901, 1.5, 0.25])
    if kind == "list":
        return [some(r, depth + 1) for _ in range(r.randrange(0, 4))]
    if kind == "object":
        return {k: some(r, depth + 1) for k in r.sample([*V.VISIBLE_KEYS, "other", "Text"], r.randrange(0, 5))}
    return True if kind == "truth" else None


def test_payloads_of_any_depth(spark):
    r = random.Random(8)
    payloads = [{k: some(r) for k in r.sample([*V.PAYLOAD_KEYS, "type", "text"], r.randrange(0, 4))} for _ in range(600)] + ["text", [1], None, 3]
    payloads.append({"content": {"text": {"output": [{"result": [{"message": {"value": [["deep"], "er"]}}]}]}}})
    payloads.append({"content": [{"text": "y" * 60_000}, ["z" * 60_000, "\\" * 20_000]]})
    rows = [(json.dumps(p, ensure_ascii=k % 2 == 0, indent=k % 3 or None), read(p, V.PAYLOAD_KEYS) if isinstance(p, dict) else "") for k, p in enumerate(payloads)]
    rows += [("not json", ""), ('{"content":"cut', ""), (None, "")]
    got = spark.createDataFrame(rows, "p string, want string").withColumn("got", T.visible_text("p")).where("NOT got <=> want").collect()
    assert not got, got[:3]


def envelope(text):
    for _ in range(V.ENVELOPES):
        body = text.lstrip()
        at = body.find("{")
        if not (0 <= at < V.ENVELOPE_START and len(body) <= V.ENVELOPE_LENGTH):
            return text
        try:
            inner = read(json.JSONDecoder().raw_decode(body[at:])[0])
        except ValueError:
            return text
        if not inner or inner == text:
            return text
        text = inner
    return text


def test_envelopes(spark):
    wrap = lambda x, n: x if n == 0 else json.dumps({"output": [wrap(x, n - 1)]})
    texts = [wrap("core", n) for n in range(6)] + [f"  note {wrap('in', 2)} and {{more}}", "x" * 239 + '{"text":"ok"}', "x" * 240 + '{"text":"late"}', '{"text":"' + "l" * 20_000 + '"}', '{"text": "open', '{"a":1} tail', '{"text":{"value":"v"}}}}', "a { b", "plain", "", '{"text":"q\\"}{"} {', '{"text":1,}', "[{]}", '{"text":"{\\"text\\":5}"}']
    got = spark.createDataFrame([(t, envelope(t)) for t in texts], "t string, want string").withColumn("got", T.open_envelopes(F.col("t"))).where("NOT got <=> want").collect()
    assert not got, got[:3]


def test_leading_object(spark):
    rows = [('{"b":1,"a":[2]} x', '{"a":[2],"b":1}'), ('{"a":"}"}', '{"a":"}"}'), ('{"a":1', None), ('{"a":1]', None), ("x", None)]
    got = spark.createDataFrame(rows, "t string, want string").withColumn("got", leading_object(F.col("t"))).where("NOT got <=> want").collect()
    assert not got, got
