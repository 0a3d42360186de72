"""Chat formatting in SQL functions: calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions.durable import checkpointed, written


def canonical(pairs: Column) -> Column:
    """JSON object of an array of (key, JSON value) structs: sorted by key, without white space."""
    quoted = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("k"))), r"^\{\"k\":(.*)\}$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))


def depths(calls: DataFrame) -> DataFrame:
    """``(call_id, depth)``: the length of the longest run of calls that each call waits for in turn; -1 on or behind a cycle.

    ``calls(call_id, needs array<string>)``; null needs and ids of no call don't count; calls of one id are one call with the needs of all.
    A call with one need points to it, and pointers are doubled until they reach a call without needs or with several; finished
    calls take no part any more. The calls with several needs, now tied to each other directly, are then worked off level by level.
    The rounds grow with the logarithm of the longest run and with the most such calls in one run.
    """
    ids = checkpointed(calls.where("call_id is not null").select("call_id").distinct())
    edges = calls.where("call_id is not null").select("call_id", F.explode("needs").alias("need")).where("need is not null").distinct()
    edges = checkpointed(edges.join(ids.select(F.col("call_id").alias("need")), "need", "left_semi"))
    one = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("up"))
    first = ids.join(one, "call_id", "left")
    ends = first.where("n is null or n > 1").select("call_id", F.col("call_id").alias("end"), F.lit(0).cast("long").alias("steps"))
    done = checkpointed(ends)
    open_ = checkpointed(first.where("n = 1").select("call_id", "up", F.lit(1).cast("long").alias("steps")))
    left, rounds = open_.count(), 0
    most = left.bit_length() + 1  # rounds after which only calls on or behind a cycle of single needs are open
    while left and rounds <= most:
        reached = open_.join(done.select(F.col("call_id").alias("up"), "end", F.col("steps").alias("more")), "up").select("call_id", "end", (F.col("steps") + F.col("more")).alias("steps"))
        further = open_.join(open_.select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more")), "up").select("call_id", F.col("up2").alias("up"), (F.col("steps") + F.col("more")).alias("steps"))
        done, open_ = checkpointed(done.unionByName(reached)), checkpointed(further)
        left, rounds = open_.count(), rounds + 1
    several = one.where("n > 1").select("call_id")
    ties = edges.join(several, "call_id", "left_semi").join(done.withColumnRenamed("call_id", "need"), "need", "left").select("call_id", "end", (F.col("steps") + 1).alias("steps"))
    level = ids.join(edges.select("call_id").distinct(), "call_id", "left_anti").select(F.col("call_id").alias("end"), F.lit(0).cast("long").alias("level"))
    ties = checkpointed(ties)  # end is null behind a cycle
    waiting = ties.select("call_id").distinct().count()
    level = checkpointed(level)
    while waiting:
        known = ties.join(level, "end", "left").groupBy("call_id").agg(F.max(F.col("steps") + F.col("level")).alias("level"), F.min(F.col("level").isNotNull()).alias("all"))
        new = checkpointed(known.where("all").select(F.col("call_id").alias("end"), "level").join(level.select("end"), "end", "left_anti"))
        found = new.count()
        if not found:
            break
        level = checkpointed(level.unionByName(new))
        waiting -= found
    out = done.join(level, "end", "left").select("call_id", (F.col("steps") + F.col("level")).alias("depth"))
    return ids.join(out, "call_id", "left").select("call_id", F.coalesce("depth", F.lit(-1).cast("long")).alias("depth"))


#: JSON's grammar of numbers.
INTEGER, NUMBER = r"^-?(0|[1-9][0-9]*)\z", r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"


def canonical_number(value: Column) -> Column:
    """A JSON number in its shortest form of the same notation: no negative zero, no zeros at the end of a fraction, small e, no plus, no leading zeros of an exponent."""
    out = F.regexp_replace(F.lower(value), r"(\.[0-9]*?)0+(?=e|$)", "$1")
    out = F.regexp_replace(out, r"\.(?=e|$)", "")
    out = F.regexp_replace(out, r"e\+?(-?)0*(?=[0-9])", "e$1")
    out = F.regexp_replace(out, r"e-?0$", "")
    return F.when(out.rlike(r"^-?0(e.*)?$"), "0").otherwise(out)


def numbered(calls: DataFrame) -> DataFrame:
    """``calls(conv_id, depth, call_id, …)`` with ``place``, counted from 0 in each conversation by depth, then call_id; calls of one id in any order.

    Rows are dealt out by ranges, so that a long conversation is spread over tasks; the counts of its parts before are joined back.
    """
    parts = written(calls.repartitionByRange("conv_id", "depth", "call_id").select("*", F.spark_partition_id().alias("_part")))
    nth = F.expr("row_number() over (partition by _part, conv_id order by depth, call_id)") - 1
    counts = checkpointed(parts.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("n")))
    before = counts.select("conv_id", "_part", F.expr("sum(n) over (partition by conv_id order by _part rows between unbounded preceding and 1 preceding)").alias("before")).where("before is not null")
    same = [F.col("p.conv_id").eqNullSafe(F.col("b.conv_id")), F.col("p._part") == F.col("b._part")]
    out = parts.withColumn("place", nth.cast("long")).alias("p").join(before.alias("b"), same, "left")
    return out.select(*[f"p.{c}" for c in calls.columns], (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("place"))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call: its result, place in its conversation, verdict and canonical JSON.

    ``calls(conv_id, call_id, needs array<string>, name, arguments map<string,string>)``, ``results(call_id, content)``,
    ``schemas(name, required array<string>, kinds map<string,string>)`` with kinds ``string``, ``integer`` or ``number``; of several schemas
    of one name that with the most required arguments counts, then the greatest in order.
    Calls and results are hash-joined by identifier; of several results the least content counts, and ``n_results`` tells. Status:
    ``ok``, ``cycle``, ``unknown_tool``, ``invalid_arguments`` (a required one is missing, one isn't declared or isn't of its kind), ``duplicate_id``, ``no_result``; the first
    that holds in that order, ``no_id`` before all for a null call_id. The calls of a conversation are in topological order by ``place``: by depth, then call_id;
    those on or behind a cycle come first, with depth -1. Numbers must follow JSON's grammar and are written in a canonical form; other values are strings.
    Null arguments are an empty map; extra columns are left out; empty in, empty out.
    """
    answer = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("result"), F.count(F.lit(1)).alias("n_results"))
    calls = calls.select("conv_id", "call_id", "needs", "name", F.coalesce("arguments", F.create_map().cast("map<string,string>")).alias("arguments"))
    named = calls.where("call_id is not null")
    copies = named.groupBy("call_id").agg(F.count(F.lit(1)).alias("copies"))
    out = named.join(answer, "call_id", "left").join(copies, "call_id", "left").join(depths(calls), "call_id", "left")
    none = calls.where("call_id is null")
    for c in (f for f in out.schema.fields if f.name not in none.columns):
        none = none.withColumn(c.name, F.lit(None).cast(c.dataType))
    out = out.unionByName(none).drop("needs")
    best = F.max(F.struct(F.size("required").alias("n"), "required", F.sort_array(F.map_entries("kinds")).alias("kinds")))
    known = schemas.where("name is not null").groupBy("name").agg(best.alias("s")).select("name", F.col("s.required").alias("required"), F.map_from_entries("s.kinds").alias("kinds"))
    out = out.join(known, "name", "left")
    shape = F.create_map(*[F.lit(x) for kv in {"string": r"(?s)^.*$", "integer": INTEGER, "number": NUMBER}.items() for x in kv])
    keys = F.map_keys("arguments")
    fits = F.forall(keys, lambda k: F.coalesce(F.col("arguments")[k].isNotNull() & F.regexp(F.col("arguments")[k], F.try_element_at(shape, F.try_element_at(F.col("kinds"), k))), F.lit(False)))
    valid = fits & (F.size(F.array_except("required", keys)) == 0)
    status = (
        F.when(F.col("call_id").isNull(), "no_id").when(F.col("depth") < 0, "cycle").when(F.col("required").isNull(), "unknown_tool").when(~valid, "invalid_arguments")
        .when(F.col("copies") > 1, "duplicate_id").when(F.col("n_results").isNull(), "no_result").otherwise("ok")
    )
    text = lambda s: F.regexp_extract(F.to_json(F.struct(F.coalesce(s, F.lit("")).alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    number = lambda k: F.coalesce(F.try_element_at(F.col("kinds"), k).isin("integer", "number") & F.regexp(F.col("arguments")[k], F.lit(NUMBER)), F.lit(False))
    value = lambda k: F.when(number(k), canonical_number(F.col("arguments")[k])).otherwise(text(F.col("arguments")[k]))
    body = canonical(F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value"))))
    message = canonical(F.array(entry("arguments", body), entry("id", text(F.col("call_id"))), entry("name", text(F.col("name"))), entry("result", F.when(F.col("result").isNull(), F.lit("null")).otherwise(text(F.col("result"))))))
    out = out.select("conv_id", "call_id", "name", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"), message.alias("json"))
    return numbered(out).select("conv_id", "call_id", "name", "depth", "place", "n_results", "status", "json")


def turn_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas that plain conversations amount to.

    Each user turn is a call of the tool ``reply``; the assistant's next turn is its result; a call needs
    the call of the turn two before. System turns call the tool ``configure`` and have no result. Rows of other or null
    roles are neither and are left out.
    """
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("t"), turn.cast("string"))
    asked = turns.where("role in ('user', 'system')")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    arguments = F.create_map(F.lit("prompt"), F.coalesce("text", F.lit("")), F.lit("words"), words.cast("string"))
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), F.array(name(F.col("turn") - 2)).alias("needs"), F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    kinds = "map('prompt', 'string', 'words', 'integer')"
    schemas = turns.sparkSession.sql(f"select explode(array('reply', 'configure')) as name, array('prompt') as required, {kinds} as kinds")
    return calls, results, schemas
