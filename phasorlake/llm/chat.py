"""Chat formatting with linked tool calls.

An assistant message may be a JSON object with ``tool_calls``: a list of objects with
id, name and arguments (an object, or its JSON text), and ``content``. A tool message
may be a JSON object with ``tool_call_id`` and ``content``. Every other text is plain.

A message gives an item, and one for each of its calls. Calls and results are hash-joined
by (conv_id, id) after ids are made one row each, so no key gathers rows. The order of
items is (block, step, place): a message, its calls, then each call's result in the
order of the calls, whichever turn brought it. A call may refer to another's result, as
{"$result": id} anywhere in its arguments. Calls of one message are ordered so that one
follows what it needs; those in a circle, or behind one, keep their order and are
invalid. So is a call that needs one of a later turn, or one that isn't there.
Arguments are validated against the tools' schemas. Items are canonical JSON: sorted
keys, no spaces, plain Unicode.

JSON is strict: NaN, infinite numbers, and values nested over DEEP levels make a text
plain. A lone surrogate, which UTF-8 can't hold, becomes U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasorlake.llm import common

DEEP, CHUNK = 200, 4_000_000
_CALL = "struct<id:string,name:string,arguments:string,place:int,errors:array<string>,needs:array<string>>"
_PARSED = f"row long, conv_id long, turn long, role string, content string, calls array<{_CALL}>, result_id string"
_LONE = re.compile("[\ud800-\udfff]")
_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer()))
    return isinstance(value, _TYPES[kind]) if kind in _TYPES else False


def _resolve(schema: object, root: dict) -> object:
    """A schema, or the one of the whole that its ``$ref`` names; a reference to nothing, or in a circle, allows all."""
    seen = set()
    while isinstance(schema, dict) and isinstance(schema.get("$ref"), str):
        ref = schema["$ref"]
        if ref in seen or not ref.startswith("#"):
            return True
        seen.add(ref)
        schema = root
        for part in ref[1:].split("/")[1:]:
            schema = schema.get(part, True) if isinstance(schema, dict) else True
    return schema


def validate(value: object, schema: dict | bool) -> list[str]:
    """Where a value breaks a schema: type, enum, required, properties, additionalProperties, items, bounds, $ref within the schema, in document order."""
    out: list[str] = []
    stack = [(value, schema, "$")]
    while stack:
        v, s, at = stack.pop()
        if s is None:
            out.append(at)  # an error that waited for its turn
            continue
        if isinstance(v, dict) and set(v) == {"$result"}:
            continue  # stands for a value that isn't known yet
        s = _resolve(s, schema)
        if s is False:
            out.append(f"{at}: not allowed")
        if not isinstance(s, dict):
            continue
        kinds = s.get("type")
        kinds = [kinds] if isinstance(kinds, str) else kinds or []
        if kinds and not any(_is(v, k) for k in kinds):
            out.append(f"{at}: not {'|'.join(kinds)}")
            continue
        if "enum" in s and canonical(v) not in map(canonical, s["enum"]):
            out.append(f"{at}: not in enum")
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            out += [f"{at}: under minimum"] if v < s.get("minimum", v) else []
            out += [f"{at}: over maximum"] if v > s.get("maximum", v) else []
        below: list[tuple] = []
        if isinstance(v, dict):
            known = s.get("properties", {})
            out += [f"{at}.{k}: missing" for k in s.get("required", []) if k not in v]
            for k, x in v.items():
                if k in known:
                    below.append((x, known[k], f"{at}.{k}"))
                elif s.get("additionalProperties") is False:
                    below.append((None, None, f"{at}.{k}: unknown"))
        if isinstance(v, list) and "items" in s:
            below = [(x, s["items"], f"{at}[{i}]") for i, x in enumerate(v)]
        stack += reversed(below)
    return out


def _needs(value: object) -> Iterator[str]:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if isinstance(v.get("$result"), str):
                yield v["$result"]
            stack += v.values()
        elif isinstance(v, list):
            stack += v


def ordered(calls: list[tuple[str | None, set[str]]]) -> tuple[list[int], set[int]]:
    """Places in an order in which each call follows the calls of the list that it needs, first come first; and those in or behind a circle."""
    ids = {c: i for i, (c, _) in reversed(list(enumerate(calls))) if c is not None}
    wait = [{ids[n] for n in needs if n in ids} for _, needs in calls]
    after: list[list[int]] = [[] for _ in calls]
    for i, needed in enumerate(wait):
        for n in needed:
            after[n].append(i)
    left = [len(w) for w in wait]
    free = [i for i, n in enumerate(left) if not n]  # sorted, so a heap
    out = []
    while free:
        i = heapq.heappop(free)
        out.append(i)
        for k in after[i]:
            left[k] -= 1
            if not left[k]:
                heapq.heappush(free, k)
    done = set(out)
    rest = [i for i in range(len(calls)) if i not in done]
    return out + rest, set(rest)


def _strict(_: str) -> None:
    raise ValueError("not JSON")


def _finite(text: str) -> float:
    x = float(text)
    return x if math.isfinite(x) else _strict(text)


def _clean(text: str) -> str:
    return _LONE.sub("\ufffd", text)


def _loads(text: str) -> object:
    """The value of a strict JSON text, without lone surrogates; None if it is broken or nested over DEEP levels."""
    try:
        value = json.loads(text, parse_constant=_strict, parse_float=_finite)
    except (ValueError, RecursionError):
        return None
    stack, lone = [(value, 1)], False
    while stack:
        v, depth = stack.pop()
        if isinstance(v, (dict, list)):
            if depth > DEEP:
                return None
            lone = lone or isinstance(v, dict) and any(map(_LONE.search, v))
            stack += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v)]
        elif isinstance(v, str):
            lone = lone or _LONE.search(v) is not None
    return json.loads(_clean(canonical(value))) if lone else value


def read_message(role: str | None, text: str | None, schemas: dict) -> tuple[str | None, list[dict], str | None]:
    """content, calls, and the id that a tool's message answers."""
    value = _loads(text) if text and text.lstrip()[:1] == "{" else None
    if not isinstance(value, dict):
        return text, [], None
    if role == "tool" and isinstance(value.get("tool_call_id"), str):
        c = value.get("content")
        return c if isinstance(c, str) or c is None else canonical(c), [], value["tool_call_id"]
    listed = value.get("tool_calls")
    if role != "assistant" or not isinstance(listed, list) or not all(isinstance(c, dict) for c in listed):
        return text, [], None
    calls = []
    for c in listed:
        arguments = c.get("arguments")
        arguments = _loads(arguments) if isinstance(arguments, str) else arguments
        name = c.get("name") if isinstance(c.get("name"), str) else None
        errors = [] if isinstance(arguments, dict) else ["$: not object"]
        if name not in schemas:
            errors.append("unknown tool")
        elif not errors:
            errors = validate(arguments, schemas[name])
        calls.append({"id": c.get("id") if isinstance(c.get("id"), str) else None, "name": name, "arguments": canonical(arguments), "errors": errors, "needs": sorted(set(_needs(arguments)))})
    order, circle = ordered([(c["id"], c["needs"]) for c in calls])
    own = {c["id"] for c in calls}
    for i, c in enumerate(calls):
        c["needs"] = [n for n in c["needs"] if n not in own]  # to be looked for in other messages
        if i in circle:
            c["errors"].append("needs itself")
    content = value.get("content")
    return content if isinstance(content, str) else None, [calls[i] | {"place": k} for k, i in enumerate(order)], None


def chat_items(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """The items of conversations in (conv_id, block, step, place) order.

    ``messages`` has conv_id, turn, role and text. Returns conv_id, block, step
    (0 message, 1 call, 2 result, 3 result without call), place, turn, kind, status
    and json. A call is ``linked``, ``unanswered``, ``duplicate`` (its id is used by
    several calls) or ``unnamed`` (no id); a result is ``linked`` or ``orphan`` (no call
    of its id in the conversation); a message is ``plain``. ``errors`` lists where
    arguments break the schema; a message has none.

    Null conv_id: a conversation of its own kind, in which nothing links, and so no
    need is met. Null role or text: null in the JSON. Broken JSON is plain text. Repeated
    rows are items each, and their calls duplicates. An empty table gives no rows. Other
    columns are ignored, whatever their names. Texts of any length are read whole.
    """
    schemas = schemas or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("place", pa.int32()), ("errors", pa.list_(pa.string())), ("needs", pa.list_(pa.string()))]))
        for batch in batches:
            for part in common.slices(batch, 4, CHUNK):
                got = [read_message(r, t, schemas) for r, t in zip(part.column(3).to_pylist(), part.column(4).to_pylist())]
                content, calls, result = zip(*got) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(content, pa.string()), pa.array(calls, kind), pa.array(result, pa.string())], ["row", "conv_id", "turn", "role", "content", "calls", "result_id"])

    rows = messages.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parsed = common.keep(rows.mapInArrow(run, _PARSED), "messages")
    calls = parsed.select("row", "conv_id", "turn", F.explode("calls").alias("c")).select("row", "conv_id", "turn", "c.*")
    results = parsed.filter("result_id IS NOT NULL")
    called = calls.filter("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place")).alias("first"), F.count("*").alias("n"))
    answered = results.groupBy("conv_id", F.col("result_id").alias("id")).agg(F.count("*").alias("answers"))

    empty = F.array().cast("array<string>")
    plain = parsed.filter("result_id IS NULL").select(
        "conv_id", F.col("turn").alias("block"), F.lit(0).alias("step"), F.lit(0).alias("place"), "turn", F.lit("message").alias("kind"), F.lit("plain").alias("status"), empty.alias("errors"), F.struct("content", "role").alias("_json")
    )
    key = ["conv_id", "id"]
    # what a call needs of other messages must be a call of an earlier turn
    wants = calls.select("row", "place", "conv_id", "turn", F.explode("needs").alias("id")).join(called.hint("shuffle_hash"), key, "left")
    fault = F.when(F.col("first").isNull(), F.concat(F.lit("needs "), "id", F.lit(": unknown"))).when(F.col("first.turn") >= F.col("turn"), F.concat(F.lit("needs "), "id", F.lit(": of a later turn")))
    faults = wants.select("row", "place", fault.alias("fault")).filter("fault IS NOT NULL").groupBy("row", "place").agg(F.array_sort(F.collect_list("fault")).alias("faults"))
    call = calls.join(called.hint("shuffle_hash"), key, "left").join(answered.hint("shuffle_hash"), key, "left").join(faults, ["row", "place"], "left")
    call = call.withColumn("errors", F.concat("errors", F.coalesce("faults", empty)))
    status = F.when(F.col("id").isNull(), "unnamed").when(F.col("n") > 1, "duplicate").when(F.col("answers").isNotNull(), "linked").otherwise("unanswered")
    call = call.select("conv_id", F.col("turn").alias("block"), F.lit(1).alias("step"), "place", "turn", F.lit("call").alias("kind"), status.alias("status"), "errors", "id", "name", "arguments")
    result = results.withColumnRenamed("result_id", "id").join(called.hint("shuffle_hash"), key, "left")
    linked = F.col("first").isNotNull()
    result = result.select(
        "conv_id", F.when(linked, F.col("first.turn")).otherwise(F.col("turn")).alias("block"), F.when(linked, 2).otherwise(3).alias("step"), F.when(linked, F.col("first.place")).otherwise(0).alias("place"), "turn",
        F.lit("result").alias("kind"), F.when(linked, "linked").otherwise("orphan").alias("status"), empty.alias("errors"), F.struct("content", F.lit("tool").alias("role"), F.col("id").alias("tool_call_id")).alias("_json"),
    )
    quiet = {"ignoreNullFields": "false"}
    head = ["conv_id", "block", "step", "place", "turn", "kind", "status", "errors"]
    # arguments are canonical JSON already and go in as they are
    text = F.concat(F.lit('{"arguments":'), "arguments", F.lit(',"id":'), _quoted("id"), F.lit(',"name":'), _quoted("name"), F.lit("}"))
    out = plain.select(*head, F.to_json("_json", quiet).alias("json")).unionByName(result.select(*head, F.to_json("_json", quiet).alias("json")))
    return out.unionByName(call.select(*head, text.alias("json")))


def _quoted(name: str):
    return F.expr(f"substring(to_json(named_struct('x', {name}), map('ignoreNullFields', 'false')), 6, length(to_json(named_struct('x', {name}), map('ignoreNullFields', 'false'))) - 6)")
