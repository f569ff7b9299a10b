"""Object graph: vertices, module owners, procedures, call and reference edges; calls, impact, search, statistics.

Inputs: objects(type, name, description, ord) and modules(path, content) or their lines(path, ord, text). Where an order decides, it is (path, line_no,
pos) for code and ord for objects.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.work import saved
from . import rules as R


def vertices(objects: DataFrame) -> DataFrame:
    """key, type, name, description, ord: the first object of each type and name."""
    first = Window.partitionBy("key").orderBy("ord")
    keyed = objects.select(F.concat_ws(":", "type", "name").alias("key"), "type", "name", F.coalesce("description", F.lit("")).alias("description"), "ord")
    return keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def module_owners(paths: DataFrame, v: DataFrame) -> DataFrame:
    """path, owner, is_new, owner_name: the object of the first known type directory in a path, by name and preferably type.

    Without such an object the owner is a new vertex of type Module.
    """
    parts = F.split("path", "/")
    known = F.array(*map(F.lit, R.GRAPH_TYPES))
    at = F.array_position(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), lambda s: F.array_contains(known, s)), True).cast("int")
    types = F.create_map(*[F.lit(x) for kv in R.GRAPH_TYPES.items() for x in kv])
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    split = paths.select("path", parts.alias("p"), F.when((at > 0) & (F.size(parts) > 1), at).alias("at"), stem.alias("stem"))
    named = split.select("path", F.try_element_at("p", F.col("at")).alias("dir"), F.coalesce(F.try_element_at("p", F.col("at") + 1), "stem").alias("owner_name"), F.col("at").isNotNull().alias("in_dir"))
    named = named.withColumn("low", F.lower("owner_name")).withColumn("want", F.try_element_at(types, F.col("dir")))
    by_name = v.select(F.lower("name").alias("low"), "key", "type", "ord")
    fits = F.coalesce((F.col("type") == F.col("want")) | (F.col("type") == F.col("dir")) | (F.concat("type", F.lit("s")) == F.col("dir")), F.lit(False))
    joined = named.filter("in_dir").join(by_name, "low", "left").withColumn("fits", fits)
    per = joined.groupBy("path", "owner_name").agg(F.min(F.when(F.col("fits"), F.struct("ord", "key"))).alias("best"), F.count("key").alias("n"), F.min("key").alias("only"))
    found = per.select("path", "owner_name", F.coalesce("best.key", F.when(F.col("n") == 1, F.col("only"))).alias("owner"))
    every = found.unionByName(named.filter("NOT in_dir").select("path", "owner_name", F.lit(None).cast("string").alias("owner")))
    return every.select("path", F.coalesce("owner", F.concat(F.lit("Module:"), "owner_name")).alias("owner"), F.col("owner").isNull().alias("is_new"), "owner_name")


def all_vertices(v: DataFrame, owners: DataFrame) -> DataFrame:
    """The objects' vertices and those of modules without an object (ord is null: last in order)."""
    new = owners.filter("is_new").groupBy("owner").agg(F.first("owner_name").alias("name")).join(v.select(F.col("key").alias("owner")), "owner", "left_anti")
    new = new.select(F.col("owner").alias("key"), F.lit("Module").alias("type"), "name", F.lit("").alias("description"), F.lit(None).cast(v.schema["ord"].dataType).alias("ord"))
    return v.select("key", "type", "name", "description", "ord").unionByName(new)


#: A path, word or object is frequent with more than a 200th of all rows (and FREQUENT rows): there are fewer than 200 such.
SHARE, FREQUENT = 200, 20_000
#: Ranges that a frequent path's lines are dealt into.
RANGES = 64
#: Rows of both sides of a join for each of its tasks.
TASK_ROWS = 500_000


def frequent(counts: DataFrame, n: str, total: int, least: int = FREQUENT) -> DataFrame:
    """Rows of counts with more than a 200th of the total."""
    return counts.filter(F.col(n) > max(least, total // SHARE))


def marked_lines(lines: DataFrame) -> DataFrame:
    """path, ord, text, name (of a procedure's header), is_end."""
    raw = F.col("text")
    name = F.nullif(T.extract(raw, R.PROCEDURE, 1), F.lit(""))
    marked = lines.filter(raw.isNotNull()).select("path", F.col("ord").cast("long").alias("ord"), "text", name.alias("name"))
    return marked.withColumn("is_end", F.col("name").isNull() & T.matches(raw, R.PROCEDURE_END))


def long_paths(marked: DataFrame, counts: DataFrame, least: int = FREQUENT) -> DataFrame:
    """path, ends: the frequent paths with the places where their lines are cut into ranges."""
    long = frequent(counts, "n", marked.count(), least).select("path")
    return marked.join(F.broadcast(long), "path").groupBy("path").agg(F.percentile_approx("ord", [i / RANGES for i in range(1, RANGES)]).alias("ends"))


def scoped_lines(marked: DataFrame, owners: DataFrame, long: DataFrame) -> DataFrame:
    """path, owner, line_no, text, name, is_end, is_header, scope (the procedure a line is in, null outside).

    Lines are numbered and scoped by path or, of the long paths, by range; a range goes on with the number of lines and the state
    that the ranges before it end with. The owner comes as a first row of each range. Lines without anything to find in them
    are left out when they are counted.
    """
    state = F.when(F.col("name").isNotNull(), F.col("name")).when(F.col("is_end"), F.lit(""))
    part = F.when(F.col("ends").isNull(), 0).otherwise(F.size(F.filter("ends", lambda e: e < F.col("ord"))))
    held = marked.join(F.broadcast(long), "path").withColumn("part", part).withColumn("state", state).groupBy("path", "part")
    held = held.agg(F.count("*").alias("n"), F.max(F.when(F.col("state").isNotNull(), F.struct("ord", "text", "state"))).alias("s"))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = saved(held.select("path", "part", F.sum("n").over(before).alias("n_before"), F.last("s.state", True).over(before).alias("state_before")), "graph-ranges")
    columns = ["path", "part", "ord", "text", "name", "is_end", "owner"]
    code = marked.join(F.broadcast(long), "path", "left").withColumn("part", part).withColumn("owner", F.lit(None).cast("string")).select(*columns)
    firsts = owners.join(F.broadcast(long), "path", "left").select("path", "owner", F.when(F.col("ends").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("ends"))).alias("parts"))
    firsts = firsts.select("path", F.explode("parts").alias("part"), "owner")
    by = Window.partitionBy("path", "part").orderBy(F.col("ord").asc_nulls_first(), "text")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    every = code.unionByName(firsts, allowMissingColumns=True).select("path", "part", "ord", "text", "name", "is_end", F.first("owner", True).over(so_far).alias("owner"), F.last(state, True).over(so_far).alias("state"), (F.row_number().over(by) - 1).alias("n"))
    text = F.col("text")
    worth = F.col("name").isNotNull() | F.col("is_end") | text.contains("(") | text.contains(".")
    found = every.filter(F.col("ord").isNotNull() & F.col("owner").isNotNull() & worth).join(F.broadcast(carried), ["path", "part"], "left")
    procedure = F.nullif(F.coalesce("state", "state_before"), F.lit(""))
    line_no = (F.col("n") + F.coalesce("n_before", F.lit(0))).cast("int")
    scope = F.when(procedure.isNotNull(), F.concat_ws("#", "owner", procedure))
    return found.select("path", "owner", line_no.alias("line_no"), "text", "name", "is_end", F.col("name").isNotNull().alias("is_header"), scope.alias("scope"))


def procedures(scoped: DataFrame) -> DataFrame:
    """fq, name, module, owner, line_no: the first definition of each."""
    heads = scoped.filter("is_header").select(F.col("scope").alias("fq"), F.struct("path", "line_no", "name", "owner").alias("s")).groupBy("fq").agg(F.min("s").alias("s"))
    return heads.select("fq", "s.name", F.col("s.path").alias("module"), "s.owner", "s.line_no")


COLLECTION = rf"\b({'|'.join(R.COLLECTIONS)})\.({R.NAME_PART}+)"


def _code(scoped: DataFrame) -> DataFrame:
    return scoped.filter("NOT is_header AND NOT is_end")


def _shown(text: Column) -> Column:
    return F.substring(T.strip(text), 1, 200).alias("text")


def _row(text: Column) -> list:
    return [F.col("scope").alias("from_proc"), F.col("path").alias("from_module"), F.col("owner").alias("from_owner"), "line_no", text]


#: A name as the first of its run of name characters: what follows a name is none, so no later start in the run can match.
RUN = rf"(?<!{R.NAME_PART})[0-9]*+({R.NAME}+)"


def call_edges(scoped: DataFrame) -> DataFrame:
    """from_proc, from_module, from_owner, line_no, text, pos, callee, is_first (of its callee in the line)."""
    found = _code(scoped).filter(F.col("text").contains("(")).select(*_row(_shown(F.col("text"))), T.extract_all(F.col("text"), RUN + r"\s*+\(", 1).alias("callees"))
    # The outer form: for the other, Spark adds a filter that evaluates the pattern again. Lines without a call go with NOT_CALLS.
    found = found.select("*", F.posexplode_outer("callees").alias("pos", "callee")).withColumn("is_first", F.array_position("callees", F.col("callee")) == F.col("pos") + 1).drop("callees")
    found = found.filter(~F.lower("callee").isin(*R.NOT_CALLS))
    return found.withColumn("from_proc", F.coalesce("from_proc", F.concat("from_module", F.lit("#(module)"))))


def _pairs(column: str, pattern: str) -> Column:
    """Both groups of a pattern's matches."""
    text = F.col(column)
    return F.arrays_zip(T.extract_all(text, pattern, 1).alias("head"), T.extract_all(text, pattern, 2).alias("tail"))


def ref_lines(scoped: DataFrame) -> DataFrame:
    """from_proc, from_module, from_owner, line_no, text, refs: of the lines with a dot, what may refer to a vertex.

    refs(pos, kind, how, word): a word is looked up as a vertex's name in lower case (how: name), as the first vertex's of that
    name (first) or as a key (key).
    """
    text = F.col("text")
    words = F.create_map(*[F.lit(x) for k, t in R.COLLECTIONS.items() for x in (k.lower(), t)])
    ref = lambda kind, how, word, pos: F.struct(pos.alias("pos"), F.lit(kind).cast("string").alias("kind"), F.lit(how).alias("how"), word.alias("word"))
    # Dotted names: the head is any vertex's name.
    dotted = F.transform(T.extract_all(text, RUN + rf"\.({R.NAME_PART}*)", 1), lambda m, i: ref(None, "name", F.lower(m), i))
    # Collections and movements: the key is made of the word's type and the name as written.
    collection = F.transform(_pairs("text", COLLECTION), lambda m, i: ref("collection", "key", F.concat_ws(":", F.try_element_at(words, F.lower(m["head"])), m["tail"]), i))
    moved = F.transform(T.extract_all(text, rf"\bДвижения\.({R.NAME_PART}+)", 1), lambda m, i: ref("movement", "key", F.concat(F.lit(R.MOVEMENT_TYPE + ":"), m), i))
    # Query sources: the second segment, as the first vertex of that name.
    pattern = rf"\b(?:из|from|соединение|join)\s+((?:{'|'.join(R.QUERY_TABLES)})\.{R.NAME_PART}+(?:\.{R.NAME_PART}+)*)"
    tables = F.transform(T.extract_all(text, pattern, 1), lambda m, i: ref("query", "first", F.lower(F.element_at(F.split(m, r"\."), 2)), i))
    return _code(scoped).filter(text.contains(".")).select(*_row(text), F.concat(dotted, collection, moved, tables).alias("refs"))


def ref_edges(scoped: DataFrame, v: DataFrame, least: int = FREQUENT) -> DataFrame:
    """from_proc, from_module, from_owner, line_no, text, pos, target, kind (null, collection, movement or query)."""
    lines = saved(ref_lines(scoped), "graph-refs")
    refs = lines.select("from_proc", "from_module", "from_owner", "line_no", "text", F.explode("refs").alias("r")).select("*", "r.*").drop("r")
    names = v.select(F.lower("name").alias("word"), F.lit("name").alias("how"), F.col("key").alias("target"))
    firsts = v.groupBy(F.lower("name").alias("word")).agg(F.min(F.struct(F.col("ord").isNull().alias("late"), "ord", "key")).alias("f")).select("word", F.lit("first").alias("how"), F.col("f.key").alias("target"))
    keys = v.select(F.col("key").alias("word"), F.lit("key").alias("how"), F.col("key").alias("target"))
    found = spread_join(refs, names.unionByName(firsts).unionByName(keys), ["word", "how"], frequent_keys(refs, ["word", "how"], least), 2 * lines.count() + 3 * v.count())
    columns = ["from_proc", "from_module", "from_owner", "line_no", _shown(F.col("text")), "pos", "target", "kind"]
    return found.filter((F.col("how") == "first") | (F.col("target") != F.col("from_owner"))).select(*columns)


def frequent_keys(df: DataFrame, keys: list[str], least: int = FREQUENT) -> DataFrame:
    """The frequent keys of a written table."""
    counts = saved(df.groupBy(*keys).agg(F.count("*").alias("n")), "key-counts")
    return saved(frequent(counts, "n", counts.agg(F.sum("n")).first()[0] or 0, least).select(*keys), "frequent-keys")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """left JOIN right (how: inner or left). What right has for the left's frequent keys is broadcast, the rest is shuffled to
    tasks whose number grows with the rows of both sides: no key and no merging of partitions makes a task's share grow."""
    many = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), keys, "left_semi")), keys, how)
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS)
    few = left.join(F.broadcast(hot), keys, "left_anti").repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys, how)
    return many.unionByName(few)


class Graph:
    """The graph's tables, built from objects and modules when they are asked for; those that others are built from are
    written to the shared folder once, so nothing stays in executors' memory and lost executors cost no new scan."""

    def __init__(self, objects: DataFrame, modules: DataFrame | None = None, lines: DataFrame | None = None):
        """Modules as modules(path, content) or, where one may be too long for a row, as lines(path, ord, text)."""
        self.objects, self.modules = objects, modules
        self.lines = lines if modules is None else T.graph_lines(modules).withColumnRenamed("line_no", "ord")

    @cached_property
    def base(self) -> DataFrame:
        return saved(vertices(self.objects), "graph-objects")

    @cached_property
    def owners(self) -> DataFrame:
        paths = self.counts if self.modules is None else saved(self.modules.select("path"), "graph-paths")
        return saved(module_owners(paths.select("path"), self.base), "graph-owners")

    @cached_property
    def marked(self) -> DataFrame:
        return saved(marked_lines(self.lines), "graph-marked")

    @cached_property
    def counts(self) -> DataFrame:
        """path, n: the lines of each."""
        return saved(self.marked.groupBy("path").agg(F.count("*").alias("n")), "graph-counts")

    @cached_property
    def vertices(self) -> DataFrame:
        return saved(all_vertices(self.base, self.owners), "graph-vertices")

    @cached_property
    def scoped(self) -> DataFrame:
        long = saved(long_paths(self.marked, self.counts), "graph-long")
        return saved(scoped_lines(self.marked, self.owners, long), "graph-lines")

    @cached_property
    def procedures(self) -> DataFrame:
        return saved(procedures(self.scoped), "graph-procedures")

    @cached_property
    def call_edges(self) -> DataFrame:
        return call_edges(self.scoped)

    @cached_property
    def ref_edges(self) -> DataFrame:
        return ref_edges(self.scoped, self.vertices)

    def one(self, name: str, object_type: str = "") -> str:
        """The key of the only vertex of that name (and type), in any case."""
        v = self.vertices.filter(F.lower("name") == name.strip().lower())
        if object_type:
            v = v.filter(F.lower("type") == object_type.lower())
        keys = [r["key"] for r in v.select("key").limit(2).collect()]
        if len(keys) != 1:
            raise ValueError(f"object not found or ambiguous: {name}")
        return keys[0]

    def resolved_calls(self, owner: str | None = None, least: int = FREQUENT) -> DataFrame:
        """call_edges (of one owner) with `resolved`: a procedure of the same module first, else one of a common module, else null.

        Resolved are the different pairs of procedure and callee, not each call.
        """
        p = self.procedures.select("fq", F.lower("name").alias("low"), "module", "line_no", "owner")
        order = F.struct("module", "line_no", "fq")
        local = p.groupBy(F.col("module").alias("home"), "low").agg(F.min(order)["fq"].alias("here")).withColumn("has_home", F.lit(True))
        common = p.filter(F.col("owner").startswith("CommonModule:")).groupBy("low").agg(F.min(order)["fq"].alias("there"))
        calls = self.call_edges if owner is None else call_edges(self.scoped.filter(F.col("owner") == owner))
        calls = saved(calls.withColumn("low", F.lower("callee")), "graph-calls")
        keys = ["from_proc", "low"]
        pairs = saved(calls.groupBy(*keys).agg(F.count("*").alias("n")), "graph-called")
        total, rows = calls.count(), pairs.count()
        homes = p.select(F.col("fq").alias("from_proc"), F.col("module").alias("home"))
        homed = pairs.join(homes, "from_proc", "left").withColumn("has_home", F.col("home").isNotNull()).withColumn("home", F.coalesce("home", "from_proc"))
        homed = saved(homed.join(local, ["home", "has_home", "low"], "left").select(*keys, "here"), "graph-called-here")
        resolved = spread_join(homed, common, ["low"], frequent_keys(homed, ["low"], least), 2 * rows, "left")
        resolved = saved(resolved.select(*keys, F.coalesce("here", "there").alias("resolved")), "graph-resolved")
        hot = saved(frequent(pairs, "n", total, least).select(*keys), "frequent-keys")
        out = spread_join(calls, resolved, keys, hot, total + rows, "left")
        return out.select("from_proc", "from_module", "from_owner", "line_no", "text", "pos", "callee", "resolved")

    def calls(self, name: str, direction: str = "both", object_type: str = "", limit: int | None = 50) -> DataFrame:
        """direction, proc, callee, resolved, caller_owner, caller_proc, module, line_no, text: the first calls per direction, or all (limit=None)."""
        key = self.one(name, object_type)
        if direction != "in":
            # A procedure's fq ends with its name, which has no #; a line outside is of path#(module).
            out = self.resolved_calls(key).filter(~F.col("from_proc").endswith("#(module)")).withColumn("proc", F.substring_index("from_proc", "#", -1))
            out = _first(out, limit, "from_module", "line_no", "pos").select(F.lit("out").alias("direction"), "proc", "callee", "resolved", F.lit(None).cast("string").alias("caller_owner"), F.lit(None).cast("string").alias("caller_proc"), F.col("from_module").alias("module"), "line_no", "text")
        if direction != "out":
            names = saved(self.procedures.filter(F.col("owner") == key).select(F.lower("name").alias("low")).distinct(), "graph-own")
            into = self.call_edges.filter("is_first").withColumn("low", F.lower("callee")).join(names, "low", "left_semi")
            into = _first(into, limit, "from_module", "line_no", "pos", "callee").select(F.lit("in").alias("direction"), F.lit(None).cast("string").alias("proc"), "callee", F.lit(None).cast("string").alias("resolved"), F.col("from_owner").alias("caller_owner"), F.col("from_proc").alias("caller_proc"), F.col("from_module").alias("module"), "line_no", "text")
        return into if direction == "in" else out if direction == "out" else out.unionByName(into)

    def impact(self, name: str, object_type: str = "", depth: int = 2, limit: int | None = 100) -> DataFrame:
        return impact(self.ref_edges.select("from_owner", "target"), self.vertices, self.one(name, object_type), depth, limit)

    def search(self, query: str, object_type: str = "", limit: int | None = 20) -> DataFrame:
        """key, type, name, description, modules, procedures of the first (limit=None: of all) vertices whose name or description holds the query."""
        q = query.strip().lower()
        v = self.vertices.filter(F.lower("name").contains(q) | F.lower("description").contains(q))
        if object_type:
            v = v.filter(F.lower("type") == object_type.lower())
        v = _first(v, limit, F.col("ord").asc_nulls_last(), "key")
        m = self.owners.groupBy(F.col("owner").alias("key")).agg(F.count("*").alias("modules"))
        p = self.scoped.filter("is_header").groupBy(F.col("owner").alias("key")).agg(F.count("*").alias("procedures"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return v.join(m, "key", "left").join(p, "key", "left").select("key", "type", "name", F.substring("description", 1, 120).alias("description"), zero("modules"), zero("procedures"))

    def stats(self) -> DataFrame:
        """vertices, procedures, call_edges, ref_edges, modules."""
        tables = {"vertices": self.vertices, "procedures": self.procedures, "call_edges": self.call_edges, "ref_edges": self.ref_edges, "modules": self.owners}
        rows = None
        for n, df in tables.items():
            one = df.agg(F.count("*").alias("c")).select(F.lit(n).alias("n"), "c")
            rows = one if rows is None else rows.unionByName(one)
        return rows.agg(*[F.max(F.when(F.col("n") == n, F.col("c"))).alias(n) for n in tables])


def _first(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def impact(edges: DataFrame, v: DataFrame, start: str, depth: int = 2, limit: int | None = 100, least: int = FREQUENT) -> DataFrame:
    """key, type, name, depth, reason_key of what refers to the start, directly or over other objects, up to a depth.

    One join per level against the levels before, which are written once made; the reason is the least key of the level before. Levels are complete, and
    the cut at the limit takes them by (depth, key).
    """
    links = edges.filter("from_owner <> target").select(F.col("from_owner").alias("key"), F.col("target").alias("reason_key")).distinct()
    links = saved(links.join(v.select("key"), "key", "left_semi"), "impact-links")
    hot, rows = frequent_keys(links, ["reason_key"], least), 2 * links.count()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0, None)], "key string, depth int, reason_key string")
    level = seen
    for d in range(1, depth + 1):
        near = spread_join(links, level.select(F.col("key").alias("reason_key")), ["reason_key"], hot, rows).groupBy("key").agg(F.min("reason_key").alias("reason_key"))
        level = saved(near.join(seen.select("key"), "key", "left_anti").select("key", F.lit(d).alias("depth"), "reason_key"), "impact-level")
        seen = seen.unionByName(level)
    found = seen.filter("depth > 0").join(v.select("key", "type", "name"), "key").select("key", "type", "name", "depth", "reason_key")
    return _first(found, limit, "depth", "key")


def undefined_refs(scoped: DataFrame, v: DataFrame) -> DataFrame:
    """type, name, cnt of collection references to objects that do not exist."""
    words = F.create_map(*[F.lit(x) for k, t in R.COLLECTIONS.items() for x in (k.lower(), t)])
    found = _code(scoped).select(F.explode(_pairs("text", COLLECTION)).alias("m"))
    found = found.select(F.try_element_at(words, F.lower("m.head")).alias("type"), F.col("m.tail").alias("name")).groupBy("type", "name").agg(F.count("*").alias("cnt"))
    return found.join(v.select("type", "name"), ["type", "name"], "left_anti")
