"""Chat formatting with tool calls: link calls and results, order them, validate arguments, serialise canonical JSON.

Input rows are events of a conversation: messages, calls (identifier, name, arguments as a JSON object, identifiers of
results they need) and results (identifier, content).  One aggregate by (conversation, identifier) finds where the first
call and the first result of an identifier stand; the events then meet it in one hash join.  What is aggregated, ordered
and joined in rounds holds no bodies, so these are shuffled once, and a conversation's rows never meet in one task.

Order: an event's level is 0 if it needs nothing; a call is one above the highest result it needs and a result one
above its call, in every conversation alike.  Calls that need one result form chains, which are shortened by pointer
doubling (as many rounds as the logarithm of the longest chain); only calls that need several take rounds of their own,
one for each such call on the longest path.  Calls on a cycle, or behind one, and their results get level null and the
problem `cycle`.  (level, turn, part) is a topological order.

Canonical JSON: one object an event, keys sorted at every depth, no spaces, absent values left out; arguments are nested
as parsed (numbers in one form, escapes as to_json writes them), or stay a string where they are `bad json`.

Defined results: a call without a result has the problem `no result`; a result without a call `no call`; of an identifier
that repeats within a kind the events at its first place (turn, part) are linked, those at later places get `repeated id`
and level 0; a null identifier links with nothing; a null conversation is a conversation of its own, apart from all
numbers; needs of results that do not exist are ignored; arguments that are not one JSON object (also null, empty, with a
key twice, or beyond the size of a variant) are `bad json`, a missing required one `missing NAME`, one of another type
`type NAME`, a string longer than allowed `length NAME`, an unknown tool `unknown tool`; null texts are left out of the
JSON; texts of any length are read whole; an empty table gives an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

EVENT = "conv long, turn long, part int, kind string, id string, name string, body string, needs array<string>"
#: JSON types as schema_of_variant names them.
TYPES = {"string": "^STRING$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "integer": r"^(BIGINT$|DECIMAL\(\d+,0\))", "boolean": "^BOOLEAN$", "object": "^OBJECT<", "array": "^ARRAY<"}


def validate(name: Column, arguments: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """Problems of a call's parsed arguments (a variant); schemas: by tool, by argument, {type, required, max_length}."""
    out = F.when(~F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT<"), F.lit(False)), F.array(F.lit("bad json")))
    for tool, schema in schemas.items():
        checks = []
        for arg, rule in schema.items():
            path = "$['" + arg.replace("\\", "\\\\").replace("'", "\\'") + "']"
            value = F.try_variant_get(arguments, path, "variant")
            kind = F.schema_of_variant(value)
            if rule.get("required"):
                checks.append(F.when(value.isNull(), F.lit(f"missing {arg}")))
            checks.append(F.when(value.isNotNull() & ~kind.rlike(TYPES[rule["type"]]), F.lit(f"type {arg}")))
            if "max_length" in rule:
                checks.append(F.when((kind == "STRING") & (F.length(F.try_variant_get(arguments, path, "string")) > rule["max_length"]), F.lit(f"length {arg}")))
        out = out.when(name == tool, F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))
    return out.otherwise(F.array(F.lit("unknown tool")))


def _on(*pairs: tuple[str, str]) -> Column:
    """Null-safe equality of pairs of columns (which Spark hashes like plain equality)."""
    out = F.lit(True)
    for a, b in pairs:
        out &= F.col(a).eqNullSafe(F.col(b))
    return out


def levels(edges: DataFrame) -> DataFrame:
    """(conv, node, level): of edges (conv, node, parent), each node's longest path from a node that is no `node`, in edges;
    nodes on or behind a cycle have level null.  Nothing is collected; rounds as the module's text says."""
    edges = cut(edges.distinct())
    degree = edges.groupBy("conv", "node").agg(F.count("*").alias("n"))
    single = edges.join(degree.where("n = 1").select(F.col("conv").alias("c"), F.col("node").alias("k")), _on(("conv", "c"), ("node", "k")), "left_semi")
    jumps, last = cut(single.select("conv", "node", F.col("parent").alias("top"), F.lit(1).cast("long").alias("steps"))), None
    while True:
        # rows whose top is itself a chain node; on a cycle they never end, else some end in every round
        above = jumps.select(F.col("conv").alias("c"), F.col("node").alias("k"), F.col("top").alias("top2"), F.col("steps").alias("steps2"))
        new = cut(jumps.join(above, _on(("conv", "c"), ("top", "k")), "left").select("conv", "node", F.coalesce("top2", "top").alias("top"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("k").isNotNull().alias("open")))
        left = new.agg(F.count_if("open")).first()[0]
        forget(jumps)
        jumps = new.drop("open")
        jumps._cut_path = new._cut_path
        if left in (0, last):
            break
        last = left
    chain = new.where("not open").drop("open")
    stuck = new.where("open").select(F.col("conv").alias("c"), F.col("node").alias("k"))
    joins = degree.where("n > 1").select(F.col("conv").alias("jc"), F.col("node").alias("jk"))
    later = _on(("conv", "jc"), ("top", "jk"))
    placed = None
    if not joins.isEmpty():
        # each edge of a node with several parents, as its distance from the top of the parent's chain
        joins = cut(joins)
        several = edges.join(joins, _on(("conv", "jc"), ("node", "jk")), "left_semi")
        named = chain.select(F.col("conv").alias("c"), F.col("node").alias("k"), "top", "steps")
        hops = cut(several.join(named, _on(("conv", "c"), ("parent", "k")), "left").select("conv", "node", F.coalesce("top", "parent").alias("top"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
        free = lambda df: df.join(stuck, _on(("conv", "c"), ("top", "k")), "left_anti")
        dead = hops.join(stuck, _on(("conv", "c"), ("top", "k")), "left_semi").select(F.col("conv").alias("c"), F.col("node").alias("k"))
        waiting = cut(free(hops).join(dead, _on(("conv", "c"), ("node", "k")), "left_anti").join(joins, later, "left").select("conv", "node", "top", "steps", F.col("jk").isNotNull().alias("later"), F.lit(0).cast("long").alias("base")))
        while True:
            ready = waiting.groupBy("conv", "node").agg(F.bool_or("later").alias("w"), F.max(F.col("base") + F.col("steps")).alias("level")).where("not w").select("conv", "node", "level")
            ready = cut(ready)
            if ready.isEmpty():
                break
            placed = ready if placed is None else cut(placed.unionByName(ready))
            r = ready.select(F.col("conv").alias("c"), F.col("node").alias("k"), "level")
            rest = waiting.join(r, _on(("conv", "c"), ("node", "k")), "left_anti")
            new = rest.join(r, _on(("conv", "c"), ("top", "k")), "left").select("conv", "node", "top", "steps", (F.col("later") & F.col("k").isNull()).alias("later"), F.coalesce("level", "base").alias("base"))
            waiting = cut(new)
    done = chain.select("conv", "node", "top", "steps")
    if placed is not None:
        p = placed.select(F.col("conv").alias("c"), F.col("node").alias("k"), "level")
        done = done.join(p, _on(("conv", "c"), ("top", "k")), "left").join(joins, later, "left")
        done = done.where("jk is null or k is not null").select("conv", "node", (F.col("steps") + F.coalesce("level", F.lit(0))).alias("level")).unionByName(placed)
    else:
        # without a place, nodes with several parents are on or behind cycles, and so is what hangs on them
        done = done.join(joins, later, "left_anti").select("conv", "node", F.col("steps").alias("level"))
    d = done.select(F.col("conv").alias("c"), F.col("node").alias("k"), "level")
    return edges.select("conv", "node").distinct().join(d, _on(("conv", "c"), ("node", "k")), "left").select("conv", "node", "level")


#: A string, a number, or what is between them in JSON text.
_TOKEN = r'"(?:[^"\\]++|\\.)*+"|-?\d[\d.eE+\-]*+|[^"\d\-]++|-'


def canonical_numbers(json: Column) -> Column:
    """JSON text with each number outside of strings written by its value: without an exponent, a plus or zeros at its end while
    38 digits (18 after the point) hold it exactly, else as the shortest text of a double."""
    exponent = lambda t: F.coalesce(F.regexp_extract(t, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    places = lambda t: F.length(F.regexp_replace(F.regexp_extract(t, r"\.(\d+)", 1), r"0+$", "")) - exponent(t)
    plain = lambda t: F.regexp_replace(F.regexp_replace(t.try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    number = lambda t: F.coalesce(F.when(places(t) <= 18, plain(t)), t.try_cast("double").cast("string"), t)
    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0)), lambda t: F.when(t.rlike(r"^-?\d"), number(t)).otherwise(t)), "")


def link(events: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """One row an event: conv, position key (level, turn, part), kind, id, linked, problems, canonical JSON."""
    e = events.select("conv", "turn", "part", "kind", "id", "name", "body", "needs")
    tool = F.col("kind").isin("call", "result") & F.col("id").isNotNull()
    at = F.struct("turn", "part")
    ends = cut(e.where(tool).groupBy("conv", "id").agg(F.min(F.when(F.col("kind") == "call", at)).alias("call"), F.min(F.when(F.col("kind") == "result", at)).alias("result")))
    # calls are at even levels: one step is from a result's call to the call that needs the result
    side = lambda tag, *more: ends.select(F.col("conv").alias(f"{tag}c"), F.col("id").alias(f"{tag}i"), *more)
    wants = e.where(tool & (F.col("kind") == "call") & F.col("needs").isNotNull()).select("conv", "id", at.alias("at"), F.explode("needs").alias("need"))
    wants = wants.join(side("a", F.col("call").alias("first")), _on(("conv", "ac"), ("id", "ai"))).where("at = first")
    wants = wants.join(side("b", F.col("call").alias("from"), "result"), _on(("conv", "bc")) & (F.col("need") == F.col("bi"))).where("result is not null")
    wants = cut(wants.select("conv", F.col("id").alias("node"), F.when(F.col("from").isNotNull(), F.col("need")).alias("parent")))
    found = levels(wants.where("parent is not null")).withColumn("level", 2 * F.col("level"))
    # a needed result without a call is at level 0, so the call is at 1 at least
    lone = wants.where("parent is null").select("conv", "node", F.lit(1).cast("long").alias("level"))
    known = found.withColumn("lost", F.col("level").isNull()).unionByName(lone.withColumn("lost", F.lit(False))).groupBy(F.col("conv").alias("lc"), F.col("node").alias("li")).agg(F.max("level").alias("level"), F.bool_or("lost").alias("lost"))
    ends = ends.join(known, _on(("conv", "lc"), ("id", "li")), "left").select(F.col("conv").alias("c"), F.col("id").alias("i"), "call", "result", F.coalesce("level", F.lit(0)).alias("base"), F.coalesce("lost", F.lit(False)).alias("lost"))
    none = F.lit(None).cast(ends.schema["call"].dataType)
    rest = e.where(~F.coalesce(tool, F.lit(False))).withColumns({"mine": none, "other": none, "base": F.lit(0).cast("long"), "lost": F.lit(False)})
    call = F.col("kind") == "call"
    named = e.where(tool).join(ends, _on(("conv", "c")) & (F.col("id") == F.col("i"))).withColumns({"mine": F.when(call, F.col("call")).otherwise(F.col("result")), "other": F.when(call, F.col("result")).otherwise(F.col("call"))})
    columns = [*e.columns, "mine", "other", "base", "lost"]
    rows = named.select(*columns).unionByName(rest.select(*columns))
    is_tool, first = F.col("kind").isin("call", "result"), F.coalesce(F.col("mine").eqNullSafe(at), F.lit(False))
    named_id = F.col("mine").isNotNull()
    linked = named_id & first & F.col("other").isNotNull()
    cycle = F.col("lost") & first & ((F.col("kind") == "call") | linked)
    level = F.when(cycle, F.lit(None)).when(named_id & first & call, F.col("base")).when(linked, F.col("base") + 1).otherwise(F.lit(0)).cast("int")
    no = F.array().cast("array<string>")
    parsed = F.when(call, F.try_parse_json("body"))
    problems = F.concat(
        F.when(is_tool & ~linked, F.when(call, F.array(F.lit("no result"))).otherwise(F.array(F.lit("no call")))).otherwise(no),
        F.when(named_id & ~first, F.array(F.lit("repeated id"))).otherwise(no),
        F.when(call, validate(F.col("name"), F.col("args"), schemas)).otherwise(no),
        F.when(cycle, F.array(F.lit("cycle"))).otherwise(no),
    )
    good = F.coalesce(F.schema_of_variant("args").startswith("OBJECT<"), F.lit(False))
    others = [F.col("id").alias("id"), F.col("kind").alias("kind"), F.when(F.col("kind") != "result", F.col("name")).alias("name"), F.col("turn").alias("turn")]
    content = F.when(~F.coalesce(call, F.lit(False)), F.col("body")).alias("content")
    text = F.when(good, canonical_numbers(F.to_json(F.struct(F.col("args").alias("arguments"), content, *others)))).otherwise(F.to_json(F.struct(F.when(call, F.col("body")).alias("arguments"), content, *others)))
    return rows.withColumn("args", parsed).select("conv", level.alias("level"), "turn", "part", "kind", "id", F.coalesce(linked, F.lit(False)).alias("linked"), F.array_join(problems, ",").alias("problems"), text.alias("json"))
