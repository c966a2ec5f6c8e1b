"""Chat formatting: tool calls linked to their results.

Calls and results are joined by conversation and identifier.  Arguments are parsed and
checked against the tool's schema; a string "${id}" in them refers to another call's
result, and calls get a topological level: 0 without references, else one more than the
highest level referred to.  Sorting by (conv_id, level, turn, pos) puts every call behind
what it needs.  Each call becomes one canonical JSON object (sorted keys, no blanks).

Levels are found a round at a time, each a join over the calls still open, so a
conversation of any size is spread over all tasks; there are as many rounds as levels.

``status`` says what came of a row: ok, no_result, bad_json, unknown_tool,
invalid_arguments, unordered (a cycle, or a reference to nothing or to something
unordered), duplicate_id (the id belongs to an earlier call), orphan_result.

Defined cases: null ids are never joined (no_result, orphan_result); null arguments are bad
JSON; of several results the first by (turn, content) counts; repeated rows are duplicates;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import numbered, stored

REFERENCE = re.compile(r"\$\{([^{}]+)\}")
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
Schema = dict[str, tuple[str, bool]]  # parameter -> (type, required)


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def check(name: str | None, text: str | None, tools: dict[str, Schema]) -> tuple[str | None, list[str], str | None]:
    """(canonical arguments, ids referred to, what is wrong)."""
    try:
        arguments = json.loads(text, parse_constant=_no_constant)
        if not isinstance(arguments, dict):
            raise TypeError("not an object")
        plain = canonical(arguments)
    except (TypeError, ValueError, RecursionError):
        return None, [], "bad_json"
    refs = sorted(set(REFERENCE.findall(plain)))
    if name not in tools:
        return plain, refs, "unknown_tool"
    schema = tools[name]
    fits = set(arguments) <= set(schema) and all(
        p in arguments or not required for p, (_, required) in schema.items()
    )
    for p, value in arguments.items() if fits else ():
        kind = schema[p][0]
        is_bool = isinstance(value, bool)
        fits = fits and isinstance(value, TYPES[kind]) and (is_bool == (kind == "boolean"))
    return plain, refs, None if fits else "invalid_arguments"


def _checked(calls: DataFrame, tools: dict[str, Schema]) -> DataFrame:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [check(n, a, tools) for n, a in zip(frame["name"], frame["arguments"], strict=True)]
            frame["arguments"] = pd.Series([f[0] for f in found], dtype=object)
            frame["refs"] = pd.Series([f[1] for f in found], dtype=object)
            frame["problem"] = pd.Series([f[2] for f in found], dtype=object)
            yield frame

    return calls.mapInPandas(
        work,
        "_row bigint, conv_id bigint, turn bigint, pos int, call_id string, name string, arguments string, refs array<string>, problem string",
    )


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, refs) that can be ordered."""
    needs = calls.select("conv_id", "call_id", F.explode("refs").alias("ref"))
    known = stored(calls.filter(F.size("refs") == 0).select("conv_id", "call_id", F.lit(0).alias("level")))
    found, needs = [known], stored(needs)
    while True:
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        open_ = needs.join(every, ["conv_id", "call_id"], "left_anti")
        there = every.withColumnRenamed("call_id", "ref")
        ready = (
            open_.join(there, ["conv_id", "ref"], "left")
            .groupBy("conv_id", "call_id")
            .agg(F.max("level").alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all"))
            .filter("all")
        )
        ready = stored(ready.select("conv_id", "call_id", (F.col("level") + 1).alias("level")))
        if ready.isEmpty():
            return every
        found.append(ready)


def link(calls: DataFrame, results: DataFrame, tools: dict[str, Schema]) -> DataFrame:
    """conv_id, turn, pos, call_id, name, level, status, json: a row a call, and one an orphan result.

    ``calls``: conv_id, turn, pos, call_id, name, arguments; ``results``: conv_id, turn,
    call_id, content; ``tools``: schemas by name, a fixed list.
    """
    given = calls.select("conv_id", "turn", "pos", "call_id", "name", "arguments")
    rows = stored(_checked(numbered(given).select("_row", *given.columns), tools))
    keyed = rows.filter("conv_id is not null and call_id is not null")
    place = F.struct("turn", "pos", "_row")
    owner = keyed.groupBy("conv_id", "call_id").agg(F.min_by("_row", place).alias("_row"))
    owned = keyed.join(owner.select("_row"), "_row", "left_semi")
    sound = owned.filter("problem is null").select("conv_id", "call_id", "refs")
    level = levels(sound)

    answers = results.select("conv_id", "turn", "call_id", "content")
    best = (
        answers.filter("conv_id is not null and call_id is not null")
        .groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "content")).alias("first"))
    )
    answered = owned.select("_row", "conv_id", "call_id").join(best, ["conv_id", "call_id"])
    ordered = owned.select("_row", "conv_id", "call_id").join(level, ["conv_id", "call_id"])
    facts = (
        rows.join(owner.select("_row", F.lit(True).alias("owner")), "_row", "left")
        .join(ordered.select("_row", "level"), "_row", "left")
        .join(answered.select("_row", F.col("first.content").alias("result"), F.lit(True).alias("answered")), "_row", "left")
    )
    status = (
        F.when(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull() & F.col("owner").isNull(), "duplicate_id")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("owner").isNotNull() & F.col("level").isNull(), "unordered")
        .when(F.col("answered").isNull(), "no_result")
        .otherwise("ok")
    )
    columns = ["conv_id", "turn", "pos", "call_id", "name", "level", "status", "arguments", "result"]
    linked = facts.withColumn("status", status).select(*columns)
    strays = answers.alias("r").join(
        owner.alias("o"), (F.col("r.conv_id") == F.col("o.conv_id")) & (F.col("r.call_id") == F.col("o.call_id")), "left_anti"
    )
    nothing = F.lit(None)
    orphans = strays.select(
        "conv_id", "turn", nothing.cast("int").alias("pos"), "call_id", nothing.cast("string").alias("name"),
        nothing.cast("int").alias("level"), F.lit("orphan_result").alias("status"),
        nothing.cast("string").alias("arguments"), F.col("content").alias("result"),
    )

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for call_id, name, level_, state, arguments, result in zip(
                *(frame[c] for c in ("call_id", "name", "level", "status", "arguments", "result")), strict=True
            ):
                out.append(
                    canonical(
                        {
                            "arguments": None if arguments is None else json.loads(arguments),
                            "id": call_id,
                            "level": None if pd.isna(level_) else int(level_),
                            "name": name,
                            "result": result,
                            "status": state,
                        }
                    )
                )
            yield frame.drop(columns=["arguments", "result"]).assign(json=pd.Series(out, dtype=object, index=frame.index))

    schema = "conv_id bigint, turn bigint, pos int, call_id string, name string, level int, status string, json string"
    return linked.union(orphans).mapInPandas(write, schema)


#: The tools of ``from_conversations``.
TOOLS: dict[str, Schema] = {
    "search": {"k": ("integer", True), "q": ("string", True)},
    "read": {"doc": ("string", True), "lines": ("array", False)},
    "compare": {"a": ("string", True), "b": ("string", True), "exact": ("boolean", False)},
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results for a table of plain turns, which holds none.

    Every assistant turn searches for its text, reads what was found, and (text of even
    length) compares both; some calls are broken on purpose: a number as text (length
    divisible by 7), no such tool (11), a circle of two (13), cut JSON (19).  Results come a
    turn later, for four of five calls, some of them twice; every 17th other turn brings
    a result that nobody asked for.
    """
    n = F.length("text")
    base = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("-"))

    def ref(i: int):
        return F.concat(F.lit("${"), base, F.lit(f"{i}}}"))

    digest = F.md5("text")
    k = (n % 10 + 1).cast("string")
    number = F.when(n % 7 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    search = F.concat(F.lit('{ "q": "'), digest, F.lit('", "k": '), number, F.lit(" }"))
    read = F.concat(F.lit('{"lines": [3, 1], "doc": "'), ref(0), F.lit('"'), F.when(n % 19 == 0, "").otherwise("}"))
    compare = F.concat(F.lit('{"b":"'), ref(1), F.lit('","a":"'), ref(0), F.lit('","exact":true}'))
    circle = [F.concat(F.lit('{"doc":"'), ref(i), F.lit('"}')) for i in (5, 4)]

    def call(pos: int, name: str, arguments, when=None):
        row = F.struct(F.lit(pos).alias("pos"), F.concat(base, F.lit(str(pos))).alias("call_id"), F.lit(name).alias("name"), arguments.alias("arguments"))
        return row if when is None else F.when(when, row)

    made = F.array(
        call(0, "search", search),
        call(1, "read", read),
        call(2, "compare", compare, n % 2 == 0),
        call(3, "guess", F.lit("{}"), n % 11 == 0),
        call(4, "read", circle[0], n % 13 == 0),
        call(5, "read", circle[1], n % 13 == 0),
    )
    asked = turns.filter("role = 'assistant' and text is not null").select(
        "conv_id", "turn", n.alias("n"), digest.alias("digest"), F.inline(F.filter(made, lambda c: c.isNotNull()))
    )
    calls = asked.select("conv_id", "turn", "pos", "call_id", "name", "arguments")
    chance = (F.col("n") + F.col("pos")) % 5
    later = F.explode(F.when(chance == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    content = F.md5(F.concat("digest", F.col("pos").cast("string")))
    answers = asked.filter(chance != 0).select("conv_id", "turn", "call_id", content.alias("content"), later.alias("later"))
    answers = answers.select("conv_id", (F.col("turn") + F.col("later")).alias("turn"), "call_id", "content")
    strange = turns.filter((F.col("role") != "assistant") & (n % 17 == 0)).select(
        "conv_id", "turn", F.concat(F.lit("x"), F.col("turn").cast("string")).alias("call_id"), digest.alias("content")
    )
    return calls, answers.union(strange)
