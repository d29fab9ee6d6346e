"""Chat formatting: linking tool calls to their results, with DataFrame functions only.

Calls and results meet in a hash join by identifier. A call may wait for other calls (``after``, an
array). Its step in the topological order is 0 if it waits for none, else one more than the largest of
those. Runs of calls that wait for one call each are followed by pointer doubling, so a chain of any
length needs a number of rounds that grows with its logarithm; calls that wait for several are settled
level by level behind that. No conversation is gathered in one task. Arguments are checked against a
table of schemas, keep their JSON types, and each linked call is written as canonical JSON: sorted keys,
no white space, nulls kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgework.llm.common import table, written

#: name, argument, type, required, largest length or value
REPLY_SCHEMAS = [
    ("configure", "prompt", "string", True, 300),
    ("reply", "prompt", "string", True, 240),
    ("reply", "turn", "integer", True, 1000),
    ("reply", "words", "integer", False, 60),
]
SCHEMA = "tool string, argument string, type string, required boolean, most long"
#: Tools beyond which the table of schemas is joined by a shuffle.
BROADCAST_TOOLS = 50_000


def anchored(single: DataFrame) -> DataFrame:
    """(call_id, anchor, more) of calls that wait for one call (call_id, up): the first call on the way up that isn't of these, and how far.

    Calls in or behind a cycle have a null anchor.
    """
    # (call_id, up, more, done): up is the call that the way has come to, an anchor once done
    first = single.select("call_id", "up", F.lit(1).cast("bigint").alias("more"))
    inner = single.select(F.col("call_id").alias("up"), F.lit(True).alias("inner"))
    at = written(first.join(inner, "up", "left").select("call_id", "up", "more", F.col("inner").isNull().alias("done")))
    left = -1
    # each round doubles the way and ends some calls of any chain, so where none ends the rest is a cycle, or behind one
    while (now := at.where("not done").count()) not in (0, left):
        left = now
        above = at.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("more").alias("further"), F.col("done").alias("ended"))
        moved = at.where("not done").join(above, "up").select("call_id", F.col("next").alias("up"), (F.col("more") + F.col("further")).alias("more"), F.col("ended").alias("done"))
        at = written(at.where("done").unionByName(moved))
    return at.select("call_id", F.expr("if(done, up, null)").alias("anchor"), F.expr("if(done, more, null)").alias("more"))


def steps(calls: DataFrame) -> DataFrame:
    """(call_id, root, step) of calls (call_id, after array<string>): the place in the order of ``after``, from 0, and the smallest first call behind it.

    Of repeated calls of an identifier the waits are taken together; waiting for an unknown call, or for
    null, is no waiting. Calls in or behind a cycle have a null step and root.
    """
    known = calls.select("call_id").distinct()
    waits = calls.select("call_id", F.explode("after").alias("up")).distinct().join(known.withColumnRenamed("call_id", "up"), "up", "left_semi")
    waits = written(waits)
    many = waits.groupBy("call_id").agg(F.count("*").alias("n"), F.min("up").alias("up"))
    single = anchored(many.where("n = 1").select("call_id", "up"))
    nothing = known.join(many, "call_id", "left_anti")
    settled = nothing.select("call_id", F.col("call_id").alias("root"), F.lit(0).cast("bigint").alias("step"))
    # the other calls, level by level: each way up ends at a call without waits or at one of these
    several = many.where("n > 1").select("call_id")
    way = waits.join(several, "call_id", "left_semi").join(single.withColumnRenamed("call_id", "up"), "up", "left")
    follows = single.select("call_id").withColumnRenamed("call_id", "up").withColumn("on", F.lit(True))
    open_ = way.join(follows, "up", "left").select("call_id", F.expr("if(on, anchor, up)").alias("anchor"), F.coalesce("more", F.lit(0)).alias("more"))
    open_, left = written(open_), -1
    while (now := open_.select("call_id").distinct().count()) not in (0, left):
        left = now
        got = open_.join(settled.withColumnRenamed("call_id", "anchor"), "anchor", "left").groupBy("call_id").agg(
            F.bool_and(F.col("step").isNotNull()).alias("ready"), F.min("root").alias("root"), (F.max(F.col("step") + F.col("more")) + 1).alias("step"))
        ready = got.where("ready").select("call_id", "root", "step")
        settled = written(settled.unionByName(ready))
        open_ = written(open_.join(settled.select("call_id"), "call_id", "left_anti"))
    behind = single.join(settled.select(F.col("call_id").alias("anchor"), "root", "step"), "anchor", "left").select("call_id", "root", (F.col("step") + F.col("more")).alias("step"))
    return settled.unionByName(behind).unionByName(open_.select("call_id").distinct().select("call_id", F.lit(None).cast("string").alias("root"), F.lit(None).cast("bigint").alias("step")))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``errors``: the sorted names of arguments that break a rule of the call's schema, or ``?`` for an unknown tool or arguments that are no JSON object.

    ``schemas`` has one row for each argument of a tool: tool, argument, type (string, integer, number,
    boolean, object, array), required, most (largest length or value). An argument without a rule is an
    error too, and so is a null where one is required.
    """
    rules = schemas.select("tool", F.struct("argument", "type", "required", "most").alias("rule")).groupBy("tool").agg(F.collect_list("rule").alias("__rules"))
    few = rules.count() <= BROADCAST_TOOLS
    given = F.from_json("arguments", "map<string,variant>")
    both = calls.withColumn("__given", given).join(F.broadcast(rules) if few else rules, calls["name"] == rules["tool"], "left").drop("tool")
    kind = lambda v: F.schema_of_variant(v)
    length = lambda v: F.length(F.try_variant_get(v, "$", "string"))
    number = lambda v: F.try_variant_get(v, "$", "double")

    def bad(rule: Column) -> Column:
        v = F.element_at("__given", rule["argument"])
        none = v.isNull() | F.is_variant_null(v)
        fits = (
            F.when(rule["type"] == "string", (kind(v) == "STRING") & length(v).between(1, F.coalesce(rule["most"], F.lit(1 << 60))))
            .when(rule["type"] == "integer", (kind(v) == "BIGINT") & (number(v) <= F.coalesce(rule["most"], F.lit(1 << 60))))
            .when(rule["type"] == "number", kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL)") & (number(v) <= F.coalesce(rule["most"], F.lit(1 << 60))))
            .when(rule["type"] == "boolean", kind(v) == "BOOLEAN")
            .otherwise(F.lower(kind(v)).startswith(rule["type"]))
        )
        return F.when(none, rule["required"]).otherwise(~F.coalesce(fits, F.lit(False)))

    broken = F.transform(F.filter("__rules", bad), lambda r: r["argument"])
    extra = F.array_except(F.map_keys("__given"), F.transform("__rules", lambda r: r["argument"]))
    unknown = F.col("__rules").isNull() | F.col("__given").isNull()
    errors = F.when(unknown, F.array(F.lit("?"))).otherwise(F.array_sort(F.array_distinct(F.concat(broken, extra))))
    return both.withColumn("errors", errors).drop("__given", "__rules")


def canonical(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys; null values are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Link ``calls`` (call_id, name, arguments: a JSON object as text, after array<string>) and ``results`` (call_id, content).

    One row for each call: its columns, root and step (see ``steps``), result (null if there is none; of
    several results of an identifier the smallest content), valid, errors and json, the call as
    canonical JSON (arguments keep their types; those that are no JSON object are null). Repeated calls
    of an identifier are linked alike; calls of a null identifier have no step and no result. Columns of
    ``calls`` that have a new column's name are replaced.
    """
    calls = calls.drop("root", "step", "result", "valid", "errors", "json")
    one = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("result"))
    linked = checked(calls, schemas).join(steps(calls.where("call_id is not null").select("call_id", "after")), "call_id", "left").join(one, "call_id", "left")
    parsed = F.when(F.from_json("arguments", "map<string,variant>").isNotNull(), F.try_parse_json("arguments"))  # a variant's keys are sorted at every depth
    fields = {k: F.col(k) for k in ("call_id", "name", "after", "step", "result", "errors")} | {"arguments": parsed}
    return linked.withColumn("valid", F.size("errors") == 0).withColumn("json", canonical(fields))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chat turns (conv_id, turn, role, text).

    A user turn calls ``reply``, a system turn ``configure``; an assistant turn is the result of the
    call in the turn before. A call waits for the one in the turn before, or else two turns before.
    """
    key = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    ok = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asks = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", F.when(ok, key(0)).alias("call_id"), F.when(ok, key(1)).alias("one"), F.when(ok, key(2)).alias("two"),
        F.expr("if(role = 'user', 'reply', 'configure')").alias("name"),
        F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("prompt"), "turn", F.size(F.split("text", " ")).alias("words")), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct(F.col("text").alias("prompt")), {"ignoreNullFields": "false"})).alias("arguments"),
    )
    ids = asks.where("call_id is not null").select("call_id").dropDuplicates()
    after = asks.join(ids.withColumnRenamed("call_id", "one").withColumn("has1", F.lit(True)), "one", "left").join(ids.withColumnRenamed("call_id", "two").withColumn("has2", F.lit(True)), "two", "left")
    calls = after.select("conv_id", "turn", "call_id", "name", "arguments", F.expr("case when has1 then array(one) when has2 then array(two) else array() end").cast("array<string>").alias("after"))
    results = turns.where("role = 'assistant'").where(ok).select(key(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def schema_table(spark, rows: list[tuple[str, str, str, bool, int]]) -> DataFrame:
    """A small table of schemas out of literals (no rows go through Python)."""
    each = [F.struct(F.lit(t).alias("tool"), F.lit(a).alias("argument"), F.lit(k).alias("type"), F.lit(r).alias("required"), F.lit(m).cast("long").alias("most")) for t, a, k, r, m in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


def op8_tool_call_linking(spark, sf_dir: str) -> DataFrame:
    """The calls of all conversations with their results, order and checks; an empty table gives no rows."""
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    linked = link_tool_calls(calls, results, schema_table(spark, REPLY_SCHEMAS))
    return linked.select("conv_id", "turn", "call_id", "name", F.concat_ws(",", "after").alias("after"), "root", "step", "valid", F.concat_ws(",", "errors").alias("errors"), F.length("result").alias("result_chars"), "json")


SQL = """
WITH asks AS (
  SELECT conv_id, turn, conv_id || '-' || turn AS call_id,
    CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name, text
  FROM conversations WHERE role IN ('user', 'system')),
waits AS (
  SELECT a.*, CASE WHEN b.call_id IS NOT NULL THEN b.call_id ELSE c.call_id END AS after
  FROM asks a
  LEFT JOIN (SELECT DISTINCT conv_id, turn, call_id FROM asks) b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1
  LEFT JOIN (SELECT DISTINCT conv_id, turn, call_id FROM asks) c ON c.conv_id = a.conv_id AND c.turn = a.turn - 2),
chains AS (
  SELECT call_id, after, SUM(CASE WHEN after IS NULL THEN 1 ELSE 0 END) OVER w AS chain, ROW_NUMBER() OVER w AS place, conv_id
  FROM (SELECT DISTINCT conv_id, turn, call_id, after FROM waits)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
placed AS (
  SELECT call_id, FIRST_VALUE(call_id) OVER (PARTITION BY conv_id, chain ORDER BY place) AS root,
    ROW_NUMBER() OVER (PARTITION BY conv_id, chain ORDER BY place) - 1 AS step FROM chains),
results AS (
  SELECT conv_id || '-' || (turn - 1) AS call_id, MIN(text) AS result
  FROM conversations WHERE role = 'assistant' GROUP BY 1),
checked AS (
  SELECT w.*, p.root, p.step, r.result, len(string_split(w.text, ' ')) AS words,
    CASE WHEN w.text IS NULL OR length(w.text) = 0 OR length(w.text) > (CASE WHEN name = 'reply' THEN 240 ELSE 300 END)
        THEN ['prompt'] ELSE CAST([] AS VARCHAR[]) END
      || CASE WHEN name = 'reply' AND w.turn > 1000 THEN ['turn'] ELSE CAST([] AS VARCHAR[]) END
      || CASE WHEN name = 'reply' AND len(string_split(w.text, ' ')) > 60 THEN ['words'] ELSE CAST([] AS VARCHAR[]) END AS errs
  FROM waits w LEFT JOIN placed p USING (call_id) LEFT JOIN results r USING (call_id))
SELECT conv_id, turn, call_id, name, coalesce(after, '') AS after, root, CAST(step AS BIGINT) AS step, len(errs) = 0 AS valid,
  array_to_string(errs, ',') AS errors, CAST(length(result) AS INTEGER) AS result_chars,
  CAST(json_object('after', CASE WHEN after IS NULL THEN CAST([] AS VARCHAR[]) ELSE [after] END, 'arguments', CASE WHEN name = 'reply'
      THEN json_object('prompt', text, 'turn', turn, 'words', words)
      ELSE json_object('prompt', text) END,
    'call_id', call_id, 'errors', errs, 'name', name, 'result', result, 'step', step) AS VARCHAR) AS json
FROM checked
"""
