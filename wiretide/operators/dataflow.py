"""What bytecode tables tell by following values and calls: constants that reach a call, and ways from a component to it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import storage

# Instructions that only read their first register, and bounds of the search for a way.
READS = ("if-", "return", "throw", "monitor-", "check-cast", "fill-array-data", "packed-switch", "sparse-switch", "iput", "sput", "aput", "goto", "nop")
NODES, DEPTH = 4000, 8


def begins(column: str, *prefixes: str) -> Column:
    return reduce(or_, [F.startswith(F.col(column), F.lit(p)) for p in prefixes])


def constant_of() -> Column:
    """The value that a const instruction loads, as text: strings without their quotes, numbers in decimal, else null."""
    raw = F.trim("literal")
    number = F.when(raw.rlike(r"^-?(?:0[xX][0-9a-fA-F]+|[0-9]+)$"), raw)
    minus = F.startswith(number, F.lit("-"))
    digits = F.regexp_replace(number, "^-", "")
    value = F.when(digits.rlike("^0[xX]"), F.conv(F.substring(digits, 3, 32), 16, 10)).otherwise(F.regexp_replace(digits, "^0+(?=[0-9])", ""))
    quoted = F.when(raw.rlike('(?s)^".*"$') & (F.char_length(raw) > 1), F.expr("substring(trim(literal), 2, char_length(trim(literal)) - 2)")).otherwise(raw)
    return F.when(begins("op", "const-string"), quoted).when(F.col("op") == "const-class", raw).otherwise(F.when(minus & (value != "0"), F.concat(F.lit("-"), value)).otherwise(value))


def constant_arguments(instructions: DataFrame, watched: DataFrame, joins: bool = False) -> DataFrame:
    """sample_id, method, pc, api_class, api_method, arguments (array of text; null where no constant is known), for each
    call of a watched method.

    instructions: sample_id, method, pc, op, registers (array), literal, api_class, api_method (of calls), label (whether a
    jump leads there); watched: api_class, api_method.  A register holds the last constant that an earlier instruction of
    the method loaded, unless another wrote to it since; the receiver is dropped.  ``joins`` also forgets everything where a
    jump leads to.  Only methods that call something watched are looked at, and each register of a method is a window of
    its own.  Null registers and literals are unknown; repeated rows of an instruction count once."""
    key = ["sample_id", "method"]
    calls = instructions.where(begins("op", "invoke")).join(watched.distinct(), ["api_class", "api_method"], "left_semi")
    i = instructions.dropDuplicates([*key, "pc"]).join(calls.select(*key).distinct(), key, "left_semi")
    i = i.join(watched.distinct().withColumn("watched", F.lit(True)), ["api_class", "api_method"], "left")
    i = i.withColumn("asks", begins("op", "invoke") & F.coalesce("watched", F.lit(False)))
    block = F.sum(F.when(F.coalesce("label", F.lit(False)), 1).otherwise(0)).over(Window.partitionBy(*key).orderBy("pc")) if joins else F.lit(0)
    i = i.withColumn("block", block)
    first = F.get("registers", F.lit(0))
    writes = i.where(~F.col("asks") & first.isNotNull() & (begins("op", "const") | ~begins("op", *READS)))
    writes = writes.select(*key, "block", first.alias("register"), "pc", F.struct(F.when(begins("op", "const"), constant_of()).alias("value")).alias("holds"))
    reads = i.where("asks").select(*key, "block", "pc", "api_class", "api_method", F.posexplode("registers").alias("place", "register"), (~F.contains("op", F.lit("static"))).cast("int").alias("skip"))
    both = reads.withColumn("holds", F.lit(None).cast("struct<value:string>")).unionByName(writes, allowMissingColumns=True)
    so_far = Window.partitionBy(*key, "block", "register").orderBy("pc").rowsBetween(Window.unboundedPreceding, -1)
    known = both.withColumn("held", F.last("holds", ignorenulls=True).over(so_far)).where("place IS NOT NULL")
    # An instruction has few registers: the array is bounded by the format.
    args = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") >= F.col("skip"), F.struct("place", F.col("held.value").alias("value"))))), lambda x: x.value)
    found = known.groupBy(*key, "pc", "api_class", "api_method").agg(args.alias("arguments"))
    bare = calls.where(F.coalesce(F.size("registers"), F.lit(0)) <= 0).select(*key, "pc", "api_class", "api_method", F.array().cast("array<string>").alias("arguments"))
    return found.unionByName(bare)


def ways(calls: DataFrame, targets: DataFrame, components: DataFrame, nodes: int = NODES, depth: int = DEPTH) -> DataFrame:
    """sample_id, target, steps, way (array from the component's method down to the target): for each target the first
    method of a component that a breadth-first search over its callers meets.

    calls: sample_id, caller, callee; targets: sample_id, target; components: sample_id, method (all methods of component
    classes).  The search of a target visits at most ``nodes`` methods, each by its first caller in order (of the queue, then
    by name), to a depth of ``depth``; targets without a way have no row.  All targets advance together, one join a step, and
    one that has found its way leaves."""
    key = ["sample_id", "target"]
    calls = storage.stored(calls.select("sample_id", "caller", "callee").where("caller IS NOT NULL AND callee IS NOT NULL").distinct(), "calls")
    marks = components.select("sample_id", F.col("method").alias("name")).distinct().withColumn("home", F.lit(True))
    front = targets.select("sample_id", "target").distinct().withColumns({"name": F.col("target"), "place": F.lit(0).cast("long"), "way": F.array("target"), "before": F.lit(1).cast("long")})
    seen = front.select(*key, "name")
    out = None
    order = Window.partitionBy(*key).orderBy("place")
    for step in range(depth + 1):
        # What each method of the queue would add; it is looked at only if what came before has not filled the bound.
        up = calls.select("sample_id", F.col("callee").alias("name"), "caller")
        new = front.join(up, ["sample_id", "name"]).join(seen.select(*key, F.col("name").alias("caller")), [*key, "caller"], "left_anti")
        new = new.groupBy(*key, "caller").agg(F.min(F.struct("place", "way")).alias("by"))
        grown = new.groupBy(*key, F.col("by.place").alias("place")).agg(F.count("*").alias("adds"))
        q = front.join(grown, [*key, "place"], "left").join(marks, ["sample_id", "name"], "left")
        upto = F.coalesce(F.sum("adds").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
        q = q.withColumn("looked", upto < nodes).withColumn("found", F.min(F.when(F.col("looked") & F.col("home"), F.col("place"))).over(Window.partitionBy(*key)))
        q = storage.stored(q.select(*key, "name", "place", "way", "before", "looked", "found"), "queue")
        hit = q.where("place = found").select(*key, F.lit(step).alias("steps"), F.reverse("way").alias("way"))
        out = hit if out is None else out.unionByName(hit)
        going = q.where("found IS NULL AND looked")
        if step == depth or going.isEmpty():
            break
        kept = new.join(going.select(*key, F.col("place").alias("p")), [*[new[k] == going[k] for k in key], F.col("by.place") == F.col("p")], "left_semi")
        total = q.groupBy(*key).agg(F.max("before").alias("before"))
        placed = kept.select(*key, F.col("caller").alias("name"), F.row_number().over(Window.partitionBy(*key).orderBy("by.place", "caller")).cast("long").alias("place"), F.concat("by.way", F.array("caller")).alias("way")).join(total, key)
        front = storage.stored(placed.withColumn("before", F.col("before") + F.count("*").over(Window.partitionBy(*key))), "front")
        seen = storage.stored(seen.unionByName(front.select(*key, "name")), "seen")
    return out
