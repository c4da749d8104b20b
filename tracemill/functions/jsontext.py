"""Text of nested JSON, found in the JVM at any depth.

A JSON text is cut into tokens. One pass over them keeps the place of each value as a string of steps: an `L` step is a place in a list, a `D` step the
rank of a key in its object, so that places sort as their texts are read. What has no rank is left out, and a list's line breaks are
values between its items. Of an object only the first key with a text counts: in sorted order a value is kept unless it parts from the last kept one at a
`D` step. No step is a Python function, and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import vocab as V

#: Strings (possessive, so that long ones need no stack), brackets and marks, and other runs without a blank.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf'(?s){_STRING}|[{{}}\[\],:]|[^\s"{{}}\[\],:]++'
#: The same with blanks and stray quotes, so that the tokens add up to the text.
_PART = rf'(?s){_STRING}|[{{}}\[\]]|[^"{{}}\[\]]++|"'
_UNRANKED, _STEP = "D9", r"[DL]\d+$"
#: Two places joined by a bar: they have a common front and then ranks that differ.
_OTHER_KEY = r"^([^|]*)D(\d)[^|]*\|\1D(?!\2)"


def _list_step(number: Column) -> Column:
    return F.concat(F.lit("L"), F.lpad(number.cast("string"), 9, "0"))


def _rank(token: Column, keys: Sequence[str]) -> Column:
    known = F.array(*[F.lit(f'"{k}"') for k in keys])
    at = F.array_position(known, token)
    return F.when(at > 0, F.concat(F.lit("D"), (at - 1).cast("string"))).otherwise(F.lit(_UNRANKED))


def _values(tokens: Column, top_keys: Sequence[str], keys: Sequence[str]) -> Column:
    """Places and JSON texts of the values that may count, in the order of the tokens."""
    start = F.struct(F.lit("").alias("path"), F.lit("").alias("open"), F.lit(False).alias("key"), F.array().cast("array<struct<path:string,text:string>>").alias("out"))

    def state(s: Column, **changes: Column) -> Column:
        return F.struct(*[changes.get(n, s[n]).alias(n) for n in ("path", "open", "key", "out")])

    def with_value(s: Column, path: Column, text: Column) -> Column:
        return F.when(F.contains(path, F.lit(_UNRANKED)), s["out"]).otherwise(F.array_append(s["out"], F.struct(path.alias("path"), text.alias("text"))))

    def step(s: Column, t: Column) -> Column:
        up = F.regexp_replace(s["path"], _STEP, "")
        in_object = F.substring(s["open"], -1, 1) == "{"
        outer = F.substr(s["open"], F.lit(1), F.length(s["open"]) - 1)
        place = F.regexp_extract(s["path"], r"L(\d+)$", 1).try_cast("int")
        ranked = F.when(F.length(s["open"]) == 1, _rank(t, top_keys)).otherwise(_rank(t, keys))
        broken = with_value(s, F.concat(up, _list_step(place + 1)), F.lit('"\\n"'))
        text = F.when(t.rlike('^"'), t).when(t == "true", F.lit('"True"')).when(t == "false", F.lit('"False"'))
        text = text.otherwise(F.concat(F.lit('"'), F.regexp_replace(t, r"(\.\d+?)0+$", "$1"), F.lit('"')))
        return (
            F.when(t == "{", state(s, open=F.concat(s["open"], t), key=F.lit(True)))
            .when(t == "[", state(s, open=F.concat(s["open"], t), path=F.concat(s["path"], _list_step(F.lit(0))), key=F.lit(False)))
            .when(t == "}", state(s, open=outer, path=F.when(s["key"], s["path"]).otherwise(up), key=F.lit(False)))
            .when(t == "]", state(s, open=outer, path=up, key=F.lit(False)))
            .when((t == ",") & in_object, state(s, path=up, key=F.lit(True)))
            .when(t == ",", state(s, path=F.concat(up, _list_step(place + 2)), out=broken))
            .when(t == ":", s)
            .when(s["key"], state(s, path=F.concat(s["path"], ranked), key=F.lit(False)))
            .when(t.isin("null", '""'), s)
            .otherwise(state(s, out=with_value(s, s["path"], text)))
        )

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def nested_text(value: Column, top_keys: Sequence[str] = V.VISIBLE_KEYS, keys: Sequence[str] = V.VISIBLE_KEYS) -> Column:
    """Text of a JSON value given as canonical JSON (as `to_json` of a variant writes it): a string, number or truth value itself, items of a
    list line by line, and of an object the text of the first of `keys` (of the outermost object: of `top_keys`) that has any."""
    found = F.array_sort(_values(F.regexp_extract_all(value, F.lit(_TOKEN), 0), top_keys, keys))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("texts"))

    def keep(s: Column, v: Column) -> Column:
        other = F.concat(s["last"], F.lit("|"), v["path"]).rlike(_OTHER_KEY)
        return F.when(other, s).otherwise(F.struct(v["path"].alias("last"), F.array_append(s["texts"], v["text"]).alias("texts")))

    kept = F.aggregate(found, start, keep, lambda s: F.array_join(s["texts"], ","))
    return F.array_join(F.from_json(F.concat(F.lit("["), kept, F.lit("]")), "array<string>"), "")


def leading_object(text: Column) -> Column:
    """The JSON object that a text starts with, as canonical JSON, whatever follows it; null if it starts with none."""
    parts = F.regexp_extract_all(text, F.lit(_PART), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), (depth == 0).alias("done")))

    end = F.aggregate(parts, start, step, lambda s: F.when(s["done"], s["n"]))
    return F.to_json(F.try_parse_json(F.array_join(F.slice(parts, 1, F.coalesce(end, F.lit(0))), "")))
