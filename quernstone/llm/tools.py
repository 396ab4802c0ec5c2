"""Chat formatting: tool calls linked to results, put in order, validated and serialised as canonical JSON."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Store, join_hot, ranked

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
RESULT = re.compile(r"<tool_result\s+id=\"([^\"]*)\"\s*>(.*?)</tool_result>", re.S)
#: Conversations of up to so many calls, if any is out of order, are put in order in one task; longer ones in rounds.
LOCAL = 1_000_000
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_SURROGATE = re.compile("[\ud800-\udfff]")
#: Keywords of JSON schema that say nothing about validity.
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "format", "deprecated", "readOnly", "writeOnly"}
_COUNTS = {"minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"}
_BOUNDS = {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"}


def canonical(value: object) -> str:
    """JSON with sorted keys, no spare space, whole floats as integers, halves of surrogate pairs escaped; NaN and infinities are refused."""

    def plain(x: object) -> object:
        if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 2**53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def unsound(schema: object) -> str | None:
    """What is wrong with a schema: None if it is one of the supported kind.

    Supported are true and false, type, enum, const, allOf, anyOf, oneOf, not,
    minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength,
    maxLength, pattern, items, minItems, maxItems, uniqueItems, properties,
    required, additionalProperties, minProperties, maxProperties, and notes.
    Any other keyword is named, as passing over it would let wrong calls through.
    """
    if isinstance(schema, bool):
        return None
    if not isinstance(schema, dict):
        return "no schema object"
    for key, x in schema.items():
        below: list[object] = []
        if key == "type":
            kinds = x if isinstance(x, list) else [x]
            if not kinds or not all(isinstance(k, str) and (k in _TYPES or k in ("number", "integer")) for k in kinds):
                return f"unknown type {canonical(x)}"
        elif key in ("allOf", "anyOf", "oneOf"):
            if not isinstance(x, list) or not x:
                return f"{key} is no list of schemas"
            below = x
        elif key in ("not", "items", "additionalProperties"):
            below = [x]
        elif key == "properties":
            if not isinstance(x, dict):
                return "properties is no object"
            below = list(x.values())
        elif key == "pattern":
            try:
                re.compile(x)
            except (re.error, TypeError, RecursionError, OverflowError):
                return "pattern is no regular expression"
        elif key in _COUNTS and not (isinstance(x, int) and not isinstance(x, bool) and x >= 0):
            return f"{key} is no count"
        elif key in _BOUNDS and not _number(x):
            return f"{key} is no number"
        elif key == "multipleOf" and not (_number(x) and x > 0):
            return "multipleOf is no positive number"
        elif (key == "enum" and not isinstance(x, list)) or (key == "uniqueItems" and not isinstance(x, bool)):
            return f"{key} of a wrong kind"
        elif key == "required" and not (isinstance(x, list) and all(isinstance(k, str) for k in x)):
            return "required is no list of names"
        elif key not in {"enum", "const", "uniqueItems", "required", "multipleOf"} | _COUNTS | _BOUNDS | _NOTES:
            return f"unknown keyword {key}"
        for own in below:
            if found := unsound(own):
                return found
    return None


def _multiple(x: float, of: float) -> bool:
    return Decimal(repr(x)) % Decimal(repr(of)) == 0 if abs(x) < 1e15 else math.fmod(x, of) == 0 if isinstance(x, float) else Fraction(x) % Fraction(repr(of)) == 0


def violations(value: object, schema: dict | bool, at: str = "$") -> list[str]:
    """What a value breaks of a sound schema; values are equal if their canonical JSON is, so 1 is 1.0 and not true."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    found = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = _number(value)
    whole = number and (isinstance(value, int) or value.is_integer())
    if kinds and not any(number if k == "number" else whole if k == "integer" else isinstance(value, _TYPES[k]) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        found.append(f"{at}: not the constant")
    for x in schema.get("allOf", []):
        found += violations(value, x, at)
    if "anyOf" in schema and all(violations(value, x, at) for x in schema["anyOf"]):
        found.append(f"{at}: none of anyOf")
    if "oneOf" in schema and sum(not violations(value, x, at) for x in schema["oneOf"]) != 1:
        found.append(f"{at}: not one of oneOf")
    if "not" in schema and not violations(value, schema["not"], at):
        found.append(f"{at}: what it must not be")
    if number:
        found += [f"{at}: below minimum"] * (value < schema.get("minimum", -math.inf) or value <= schema.get("exclusiveMinimum", -math.inf))
        found += [f"{at}: above maximum"] * (value > schema.get("maximum", math.inf) or value >= schema.get("exclusiveMaximum", math.inf))
        found += [f"{at}: no multiple"] * ("multipleOf" in schema and not _multiple(value, schema["multipleOf"]))
    if isinstance(value, str):
        found += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", math.inf))
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: pattern")
    if isinstance(value, list):
        found += [f"{at}: too few items"] * (len(value) < schema.get("minItems", 0)) + [f"{at}: too many items"] * (len(value) > schema.get("maxItems", math.inf))
        found += [f"{at}: repeated items"] * (schema.get("uniqueItems", False) and len(set(map(canonical, value))) < len(value))
        for k, x in enumerate(value):
            found += violations(x, schema.get("items", True), f"{at}[{k}]")
    if isinstance(value, dict):
        properties, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        found += [f"{at}: too few properties"] * (len(value) < schema.get("minProperties", 0)) + [f"{at}: too many properties"] * (len(value) > schema.get("maxProperties", math.inf))
        for k in sorted(value):
            if k in properties:
                found += violations(value[k], properties[k], f"{at}.{k}")
            elif more is False:
                found.append(f"{at}.{k}: unknown")
            else:
                found += violations(value[k], more, f"{at}.{k}")
    return found


def parse_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """The calls and results that texts hold: (conv, kind, turn, nth, id, name, arguments, after, content).

    A call is ``<tool_call>{"id", "name", "arguments", "after"}</tool_call>``, a result
    ``<tool_result id="...">content</tool_result>``.  A call that is no JSON object gives
    a row without id whose ``arguments`` is the text as it stands, and so do JSON
    nested too deeply and numbers that JSON does not have.  Halves of surrogate
    pairs in strings become U+FFFD.  Null texts and texts without tags give no rows.
    """
    source = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text")).where(F.col("text").contains("<tool_"))
    ddl = f"conv {source.schema['conv'].dataType.simpleString()}, turn long, kind string, nth int, id string, name string, arguments string, after array<string>, content string"
    fields = pa.schema([("kind", pa.string()), ("nth", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("after", pa.list_(pa.string())), ("content", pa.string())])

    def sound(x: str) -> str:
        return _SURROGATE.sub("\ufffd", x)

    def text_of(x: object) -> str | None:
        return None if x is None else sound(x) if isinstance(x, str) else canonical(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for nth, m in enumerate(CALL.finditer(text)):
                    try:
                        own = json.loads(m[1])
                        canonical(own)
                    except (ValueError, RecursionError):
                        own = None
                    own = own if isinstance(own, dict) else {"arguments": m[1]}
                    after = own.get("after") if isinstance(own.get("after"), list) else []
                    out.append({"kind": "call", "nth": nth, "id": text_of(own.get("id")), "name": text_of(own.get("name")), "arguments": sound(own["arguments"]) if isinstance(own.get("arguments"), str) else canonical(own.get("arguments")), "after": [x for x in map(text_of, after) if x is not None], "content": None})
                    rows.append(i)
                for nth, m in enumerate(RESULT.finditer(text)):
                    out.append({"kind": "result", "nth": nth, "id": m[1], "name": None, "arguments": None, "after": [], "content": m[2]})
                    rows.append(i)
            if out:
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns[:2]), *pa.RecordBatch.from_pylist(out, fields).columns], ["conv", "turn", *fields.names])

    return source.mapInArrow(run, ddl)


def _key(conv: Column, call_id: Column) -> Column:
    """One key of conversation and identifier; null conversations are one, an identifier must be known."""
    return F.concat_ws("\x1f", F.coalesce(conv.cast("string"), F.lit("\x00")), call_id)


def linked(store: Store, calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row an identifier of a conversation: its first call and first result, by turn, and how many there are of each.

    Both sides are reduced to a row a key before they meet, so no identifier
    repeated on both sides multiplies.  Calls without identifier stand alone.
    """
    one = lambda df, cols, n: df.groupBy("_key").agg(F.min(F.struct("turn", *cols)).alias("_m"), F.first("conv").alias("conv"), F.count("*").alias(n)).select("_key", "conv", n, "_m.*")
    nameless = F.concat(F.lit("\x1e"), F.monotonically_increasing_id().cast("string"))
    keyed = store.put(calls.withColumn("_key", F.when(F.col("call_id").isNotNull(), _key(F.col("conv"), F.col("call_id"))).otherwise(F.concat_ws("\x1f", F.coalesce(F.col("conv").cast("string"), F.lit("\x00")), nameless))), "calls")
    left = one(keyed, ["call_id", "name", "arguments", "after"], "n_calls")
    right = one(results.where("call_id is not null").withColumn("_key", _key(F.col("conv"), F.col("call_id"))), ["content", "call_id"], "n_results")
    right = right.select("_key", F.col("conv").alias("_conv"), F.col("call_id").alias("_id"), F.col("turn").alias("result_turn"), "content", "n_results")
    both = left.join(right, "_key", "full")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "pending").otherwise("linked")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("_key", F.when(F.col("n_calls").isNull(), F.col("_conv")).otherwise(F.col("conv")).alias("conv"), F.coalesce("call_id", "_id").alias("call_id"), "turn", "name", "arguments", "after", "result_turn", "content", status.alias("status"), count("n_calls"), count("n_results"))


def _peeled(nodes: pd.DataFrame, fallback: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, cyclic) of the calls of one conversation: rows of rn and deps, the rn of those that it comes after."""
    rn = nodes["rn"].to_numpy()
    sizes = np.fromiter((0 if d is None else len(d) for d in nodes["deps"]), np.int64, len(nodes))
    to = np.repeat(np.arange(len(rn)), sizes)
    order = np.argsort(rn)
    given = [np.asarray(d, np.int64) for d in nodes["deps"] if d is not None and len(d)]
    of = order[np.searchsorted(rn[order], np.concatenate(given))] if given else np.zeros(0, np.int64)
    by = np.argsort(of, kind="stable")
    to, start = to[by], np.searchsorted(of[by], np.arange(len(rn) + 1))
    place, waits = rn.copy(), sizes.copy()
    ready = np.flatnonzero(waits == 0).tolist()
    done = np.zeros(len(rn), bool)
    while ready:
        at = ready.pop()
        done[at] = True
        for other in to[start[at] : start[at + 1]].tolist():
            place[other] = max(place[other], place[at] + 1)
            waits[other] -= 1
            if not waits[other]:
                ready.append(other)
    place[~done] = fallback
    return place, ~done


def _in_rounds(store: Store, edges: DataFrame, backward: DataFrame) -> DataFrame:
    """(rn, place, cyclic) of the calls that a call out of order moves or may move.

    These are the calls with a dependency behind them, and all that come after
    such: cycles are among them.  Those that wait for none of them any more are
    taken off, round by round; when a round takes off none, what is left is in a
    cycle or comes after one.  There are as many rounds as the longest chain.
    """
    found, step = store.put(backward.select("rn").distinct(), "reached-0"), 0
    front = found
    while not front.isEmpty():
        step += 1
        front = store.put(edges.join(front.select(F.col("rn").alias("dep")), "dep", "left_semi").select("rn").distinct().join(found, "rn", "left_anti"), f"reached-{step}")
        found = found.union(front)
    near = edges.join(found, "rn", "left_semi")
    inner = store.put(near.join(found.select(F.col("rn").alias("dep")), "dep", "left_semi").select("rn", "dep"), "live-0")
    outer = near.join(found.select(F.col("rn").alias("dep")), "dep", "left_anti").groupBy("rn").agg((F.max("dep") + 1).alias("_need"))
    state = store.put(found.join(outer, "rn", "left").select("rn", F.greatest("rn", F.coalesce("_need", "rn")).alias("place")), "waiting-0")
    done, live, step = None, inner, 0
    while True:
        step += 1
        ready = store.put(state.join(live.select("rn").distinct(), "rn", "left_anti"), f"ready-{step}")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        near = live.join(ready.select(F.col("rn").alias("dep"), "place"), "dep", "left")
        near = store.put(near, f"near-{step}")
        need = near.where("place is not null").groupBy("rn").agg((F.max("place") + 1).alias("_need"))
        state = store.put(state.join(ready.select("rn"), "rn", "left_anti").join(need, "rn", "left").select("rn", F.greatest("place", F.coalesce("_need", "place")).alias("place")), f"waiting-{step}")
        live = store.put(near.where("place is null").select("rn", "dep"), f"live-{step}")
        store.drop(f"near-{step}", f"waiting-{step - 1}", f"live-{step - 1}")
    left = state.select("rn", F.lit(None).cast("long").alias("place"), F.lit(True).alias("cyclic"))
    return left if done is None else done.select("rn", "place", F.lit(False).alias("cyclic")).union(left)


def ordered(store: Store, links: DataFrame, local: int = LOCAL) -> DataFrame:
    """Adds ``position`` (from 1 in each conversation, a topological order) and ``cyclic``.

    Calls go by turn, equal turns by key, and a call that stands before one that it
    comes ``after`` is moved just behind it.  Where none stands so there is nothing
    to do.  Else the calls of a conversation are peeled off, those first that
    wait for none: in one task if the conversation has at most ``local`` calls, of
    which a task holds numbers only, else in rounds of joins.  Calls in a cycle, and those
    that come after one, stand last.  Identifiers of no known call are passed over.
    How large turns are, and what lies between them, does not matter.
    """
    kept = links.columns
    conv = F.coalesce(F.col("conv").cast("string"), F.lit("\x00"))
    at = F.coalesce("turn", "result_turn", F.lit(0).cast("long"))
    keyed = links.withColumn("_conv", conv).withColumn("_at", at)
    base = store.put(ranked(store, keyed, [F.col("_conv"), F.col("_at"), F.col("_key")], "numbered").drop("_at"), "based")
    span = base.groupBy("_conv").agg(F.min("rn").alias("_first"), F.count("*").alias("_size"))

    asked = base.where(F.size("after") > 0).select("_conv", "rn", F.col("conv"), F.explode("after").alias("_after")).select("_conv", "rn", _key(F.col("conv"), F.col("_after")).alias("_dep"))
    asked = store.put(asked.distinct(), "asked")
    wanted = asked.groupBy("_dep").agg(F.count("*").alias("_n")).join(base.select(F.col("_key").alias("_dep"), F.col("rn").alias("dep")), "_dep")
    edges = store.put(join_hot(asked, store.put(wanted, "wanted"), ["_dep"], "_n").select("_conv", "rn", "dep"), "edges")
    backward = store.put(edges.where("dep >= rn"), "backward")
    spans = store.put(span, "spans")

    if backward.isEmpty():
        plain = join_hot(base, spans.withColumn("_n", F.col("_size")), ["_conv"], "_n")
        return plain.select(*kept, (F.col("rn") - F.col("_first") + 1).alias("position"), F.lit(False).alias("cyclic"))

    touched = store.put(backward.select("_conv").distinct().join(spans, "_conv"), "touched")
    small, large = (touched.where(x).select("_conv", "_first", "_size") for x in (F.col("_size") <= local, F.col("_size") > local))
    deps = edges.join(small, "_conv", "left_semi").groupBy("rn").agg(F.collect_list("dep").alias("deps"))
    nodes = base.select("_conv", "rn").join(small, "_conv").join(deps, "rn", "left").select("_conv", "rn", "deps", (F.col("_first") + 2 * F.col("_size")).alias("_end"))

    def peel(group: pd.DataFrame) -> pd.DataFrame:
        place, cyclic = _peeled(group, int(group["_end"].iloc[0]))
        return pd.DataFrame({"rn": group["rn"], "place": place, "cyclic": cyclic})

    moved = nodes.groupBy("_conv").applyInPandas(peel, "rn long, place long, cyclic boolean")
    if not large.isEmpty():
        in_large = lambda x: store.put(x.join(large, "_conv", "left_semi"), f"large-{uuid.uuid4().hex}")
        moved = moved.union(_in_rounds(store, in_large(edges).select("rn", "dep"), in_large(backward)))
    moved = store.put(moved, "moved")

    sized = spans.join(touched.select("_conv", F.lit(True).alias("_touched")), "_conv", "left").withColumn("_n", F.col("_size"))
    rows = join_hot(base.select("_conv", "rn"), store.put(sized, "sized"), ["_conv"], "_n")
    still = rows.where("_touched is null").select("rn", (F.col("rn") - F.col("_first") + 1).alias("_pos"), F.lit(False).alias("cyclic"))
    again = rows.where("_touched").join(moved, "rn", "left").select("_conv", "_first", "rn", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.when(F.col("cyclic"), F.col("_first") + 2 * F.col("_size")).otherwise(F.coalesce("place", "rn")).alias("place"))
    again = store.put(ranked(store, again, [F.col("_conv"), F.col("place"), F.col("rn")], "again", out="_new"), "renumbered")
    firsts = again.groupBy("_conv").agg(F.min("_new").alias("_least"), F.count("*").alias("_n"))
    again = join_hot(again, store.put(firsts, "firsts"), ["_conv"], "_n").select("rn", (F.col("_new") - F.col("_least") + 1).alias("_pos"), "cyclic")
    return base.join(still.union(again), "rn").select(*kept, F.col("_pos").alias("position"), "cyclic")


def serialised(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Adds ``valid``, ``errors`` and ``json``; of orphan results ``valid`` is null.

    Arguments must be a JSON object that the schema of their name allows; the name
    must have a schema, and one that ``unsound`` has nothing against: else every call of that
    name is invalid and says why.  Arguments that are no JSON, or nested too deeply
    to read, are kept as a string.  Conversations that JSON has no kind for are strings.
    """
    names, broken = calls.columns, {k: unsound(x) for k, x in schemas.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, text = [], [], []
            for r in batch.to_pylist():
                own, found, known = None, [], r["status"] != "orphan"
                if known:
                    try:
                        own = json.loads(r["arguments"]) if r["arguments"] is not None else None
                        canonical(own)
                        schema = schemas.get(r["name"])
                        found = ["no schema"] if schema is None else [f"schema: {broken[r['name']]}"] if broken[r["name"]] else ["$: not object"] if not isinstance(own, dict) else violations(own, schema)
                    except ValueError:
                        own, found = r["arguments"], ["not JSON"]
                    except RecursionError:
                        own, found = r["arguments"], ["too deep"]
                conv = r["conv"] if r["conv"] is None or isinstance(r["conv"], (str, int, bool)) else str(r["conv"])
                out = {"arguments": own, "conversation": conv, "id": r["call_id"], "name": r["name"], "position": r["position"], "result": r["content"], "status": r["status"]} | ({"errors": found} if found else {}) | ({"cyclic": True} if r["cyclic"] else {})
                valid.append(not found if known else None)
                errors.append([_SURROGATE.sub("\ufffd", x) for x in found])
                text.append(canonical(out))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(text, pa.string())], [*names, "valid", "errors", "json"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema)
    return calls.mapInArrow(run, f"{ddl}, valid boolean, errors array<string>, json string")


def format_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict | bool], local: int = LOCAL) -> DataFrame:
    """One row a call (or orphan result): linked, in order, validated and as canonical JSON.

    ``calls`` has (conv, call_id, turn, name, arguments, after), ``results`` (conv,
    call_id, turn, content); other columns are ignored.  Of equal identifiers in a
    conversation the first by turn counts, and n_calls and n_results say how many
    there are.  Null conversations are one; calls without identifier are pending;
    results without one are left out; empty tables give no rows.  A null turn counts
    as its result's turn, or 0.  Texts of any length are taken whole.  Bad
    arguments and bad schemas make a call invalid, never fail the job.
    """
    store = Store(calls.sparkSession, "tools")
    own = calls.select("conv", F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    got = results.select("conv", F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), "content")
    links = store.put(linked(store, own, got), "links")
    return serialised(ordered(store, links, local), schemas).drop("_key")


#: Texts from so many characters on are to be summarised.
LONG_TEXT = 200
#: Schemas of the calls that ``turns_as_calls`` makes.
REPLY = {
    name: {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"turn": {"type": "integer", "minimum": 0}, "text": {"type": "string"} | bounds}}
    for name, bounds in (("reply", {"minLength": 1}), ("summarise", {"minLength": LONG_TEXT, "maxLength": 2 * LONG_TEXT}))
}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations: each user turn is a call, and the next turn, if the assistant's, is its result.

    Texts of ``LONG_TEXT`` characters or more call ``summarise``, others ``reply``.
    Short questions come first: a call comes after that of two turns before
    unless this has more than three times as many characters, and after that of
    two turns on if this has less than half as many.  So some calls stand out of
    order, and pairs for which both hold are cycles.  Identifiers are ``turn-N``.
    """
    call = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    turn, text = F.col("turn").cast("long"), F.coalesce("text", F.lit(""))
    users = messages.where("role = 'user'").select(F.col("conv_id").alias("conv"), turn.alias("turn"), text.alias("text"), F.length(text).alias("n"))
    near = lambda d, n: users.groupBy(F.col("conv").alias("_c"), (F.col("turn") + d).alias("_t")).agg(F.min("n").alias(n))
    on = lambda n: (F.col("_c").eqNullSafe(F.col("conv"))) & (F.col("_t") == F.col("turn"))
    rows = users.join(near(2, "_before"), on("_before"), "left").drop("_c", "_t").join(near(-2, "_next"), on("_next"), "left").drop("_c", "_t")
    after = F.filter(F.array(F.when(F.col("_before") <= 3 * F.col("n"), call(F.col("turn") - 2)), F.when(2 * F.col("_next") < F.col("n"), call(F.col("turn") + 2))), lambda x: x.isNotNull())
    name = F.when(F.col("n") >= LONG_TEXT, "summarise").otherwise("reply")
    calls = rows.select("conv", call(F.col("turn")).alias("call_id"), "turn", name.alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), after.alias("after"))
    replies = messages.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), call(turn - 1).alias("call_id"), turn.alias("turn"), F.col("text").alias("content"))
    return calls, replies
