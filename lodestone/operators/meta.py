"""Metadata queries over objects(type_dir, type, name, code, description, subsystem, ord) and members; snapshot comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import audit
from . import rules as R

BASIC = ("type_dir", "type", "name", "code", "description")


def tree(objects: DataFrame, type_dir: str = "") -> DataFrame:
    return (objects.filter(F.col("type_dir") == type_dir) if type_dir else objects).select(*BASIC)


def tree_members(objects: DataFrame) -> DataFrame:
    """The tree with the numbers of forms and commands (columns forms and commands of the objects)."""
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0)).cast("long")
    return objects.select(*BASIC, size(F.col("forms")).alias("n_forms"), size(F.col("commands")).alias("n_commands"))


def tree_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("type_dir", "type").agg(F.count("*").alias("objects"))


def normalize_type(objects: DataFrame, wanted: str) -> str:
    """An object type as it is, or that of a type directory; anything else is an error."""
    rows = objects.filter((F.col("type") == wanted.strip()) | (F.col("type_dir") == wanted.strip())).orderBy(F.col("type") != wanted.strip(), "ord").select("type").limit(1).collect()
    if not rows:
        raise ValueError(f"Unknown object_type: {wanted}")
    return rows[0]["type"]


def search(objects: DataFrame, query: str, object_type: str = "") -> DataFrame:
    """name, type, code, description, score: 100 the name, 50 part of it, 30 of the description, 20 of the code."""
    if not query:
        raise ValueError("query required")
    q = query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    score = F.when(F.lower("name") == q, 100).when(has("name"), 50).when(has("description"), 30).when(has("code"), 20).otherwise(0)
    found = objects.filter(F.col("type") == normalize_type(objects, object_type)) if object_type else objects
    return found.select("name", "type", "code", "description", score.alias("score")).filter("score > 0")


def resolve(objects: DataFrame, name: str) -> DataFrame:
    """The first object by exact name, then by TypeDir.Name, then by either or the last dotted part in any case."""
    low, last = name.lower(), name.split(".")[-1].lower()
    dotted = F.concat_ws(".", "type_dir", "name")
    tier = F.when(F.col("name") == name, 1).when(dotted == name, 2).when((F.lower("name") == low) | (F.lower(dotted) == low) | (F.lower("name") == last), 3)
    return objects.withColumn("_tier", tier).filter("_tier IS NOT NULL").orderBy("_tier", "ord").limit(1).drop("_tier")


def structure(objects: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """object, section, pos, member_kind, name, type, type_uri, qualifiers, description of the resolved object's members."""
    key = resolve(objects, name).select("type_dir", F.col("name").alias("object"))
    quals = F.array_join(F.transform(F.array_sort(F.map_entries("type_qualifiers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return members.join(key, ["type_dir", "object"]).select("object", "section", "pos", "member_kind", "name", "type", "type_uri", quals.alias("qualifiers"), "description")


def full_structure(objects: DataFrame, members: DataFrame, modules: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """object, part, section, name, type, detail of the resolved object: its members, its modules, and of forms, commands and
    templates those that its XML names, or else the folders of the dump (listed: type_dir, object, group, name)."""
    key = resolve(objects, name).select("type_dir", F.col("name").alias("object"))
    null = F.lit(None).cast("string")
    own = structure(objects, members, name).select("object", F.col("member_kind").alias("part"), "section", "name", "type", F.col("qualifiers").alias("detail"))
    of = lambda df: df.join(F.broadcast(key), ["type_dir", "object"])  # noqa: E731  one row
    files = of(object_modules(objects, modules).withColumnRenamed("name", "object")).select("object", F.lit("Module").alias("part"), null.alias("section"), F.col("path").alias("name"), F.col("module_type").alias("type"), F.col("content_length").cast("string").alias("detail"))
    kinds = F.create_map(*[F.lit(x) for kv in R.MEMBER_GROUPS.items() for x in kv])
    folders = of(listed).select("object", F.try_element_at(kinds, "group").alias("part"), null.alias("section"), "name", F.lit("").alias("type"), F.lit("folder").alias("detail")).filter("part IS NOT NULL")
    named = own.filter("section IS NULL").select("part").distinct()
    return own.unionByName(files).unionByName(folders.join(named, "part", "left_anti").select(*own.columns))


def dependencies(objects: DataFrame, members: DataFrame, modules: DataFrame, listed: DataFrame, name: str, direction: str = "references") -> DataFrame:
    """What an object is made of (its full structure), or, for 'referenced_by', path, line_no, text of the lines that name it."""
    return audit.find_refs(modules, name) if direction == "referenced_by" else full_structure(objects, members, modules, listed, name)


def cross_reference(objects: DataFrame, modules: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """kind (form, module, reference), path, line_no, text for the first object of exactly that name: the form files below its
    folder, its modules, and the lines of code that name it. No rows without such an object."""
    key = F.broadcast(objects.filter(F.col("name") == name).orderBy("ord").limit(1).select("type_dir", "name"))
    p = F.split("rel_path", "/")
    forms = listing.filter(F.element_at(p, -1) == "Form.xml").select(F.element_at(p, 1).alias("type_dir"), F.try_element_at(p, F.lit(2)).alias("name"), "rel_path", F.element_at(p, F.size(p) - 1).alias("form")).join(key, ["type_dir", "name"])
    none = F.lit(None)
    rows = forms.select(F.lit("form").alias("kind"), F.col("rel_path").alias("path"), none.cast("int").alias("line_no"), F.col("form").alias("text"))
    rows = rows.unionByName(object_modules(objects, modules).join(key, ["type_dir", "name"]).select(F.lit("module").alias("kind"), "path", none.cast("int").alias("line_no"), F.col("module_type").alias("text")))
    refs = audit.find_refs(modules, name).crossJoin(key.select("name")).select(F.lit("reference").alias("kind"), "path", "line_no", "text")  # one row or none
    return rows.unionByName(refs)


def report_structure(objects: DataFrame, name: str) -> DataFrame:
    """The first object of exactly that name with its forms."""
    return objects.filter(F.col("name") == name).orderBy("ord").limit(1).select(*BASIC, "forms")


def texts_compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """rel_path, different, size1, size2 (characters) of the texts that both listings (rel_path, content) hold."""
    both = one.select("rel_path", F.col("content").alias("a")).join(two.select("rel_path", F.col("content").alias("b")), "rel_path")
    return both.select("rel_path", (F.col("a") != F.col("b")).alias("different"), F.length("a").cast("long").alias("size1"), F.length("b").cast("long").alias("size2"))


def object_modules(objects: DataFrame, modules: DataFrame) -> DataFrame:
    """type_dir, name, path, content_length, module_type of every object's modules: an equi-join on the first two segments."""
    parts = F.split("path", "/")
    m = modules.select(F.element_at(parts, 1).alias("type_dir"), F.try_element_at(parts, F.lit(2)).alias("name"), "path", F.length("content").cast("long").alias("content_length"), module_type(F.col("path")).alias("module_type"))
    return m.join(objects.select("type_dir", "name"), ["type_dir", "name"])


def module_type(path: Column) -> Column:
    out = F.lit("Unknown")
    for words, kind in reversed(R.MODULE_KINDS):
        found = F.lit(True)
        for w in words:
            found = found & path.contains(w)
        out = F.when(found, F.lit(kind)).otherwise(out)
    return out


def orphans(objects: DataFrame, recorded: bool = False) -> DataFrame:
    """Objects outside all subsystems. Where no object has a subsystem and the dump records no membership either (recorded,
    files.membership_recorded), the question has no answer, and that is an error."""
    if not recorded and objects.filter(F.coalesce("subsystem", F.lit("")) != "").isEmpty():
        raise ValueError("subsystem membership is not recorded in this dump; objects cannot be classified")
    return objects.filter((F.coalesce("subsystem", F.lit("")) == "") & ~F.col("type").isin(*R.NOT_ORPHANS)).select(*BASIC)


def subsystem_map(objects: DataFrame) -> DataFrame:
    return objects.filter(F.coalesce("subsystem", F.lit("")) != "").select("subsystem", "name")


def containing(objects: DataFrame, types: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """Objects whose type or name holds one of the words: roles, exchange plans, registers."""
    return objects.filter(T.has_any(F.col("type"), types) | T.has_any(F.col("name"), names)).select(*BASIC)


def roles(objects: DataFrame) -> DataFrame:
    return containing(objects, ("Role",), ("Роль",))


def exchange_plans(objects: DataFrame) -> DataFrame:
    return containing(objects, ("ExchangePlan",), ("Обмен", "ПланОбмена"))


def exchange_safety(objects: DataFrame) -> DataFrame:
    return containing(objects, ("ExchangePlan",), ("Обмен",)).select(F.col("name").alias("plan"), "type", F.lit("Review rules for cascade handling and idempotency").alias("note"))


def registers(objects: DataFrame) -> DataFrame:
    return containing(objects, ("Register",), ("Регистр",)).select("name")


def command_audit(objects: DataFrame) -> DataFrame:
    """name, type, commands: objects with commands."""
    return objects.filter(F.size("commands") > 0).select("name", "type", F.size("commands").cast("long").alias("commands"))


def form_structure(modules: DataFrame, form_name: str) -> DataFrame:
    return modules.filter(F.lower("path").contains(form_name.lower()) & F.col("path").contains("Form")).select("path")


def config_info(objects: DataFrame, modules: DataFrame) -> DataFrame:
    o = objects.agg(F.count("*").alias("total_objects"), F.count_distinct("type_dir").alias("metadata_types"))
    m = modules.agg(F.count("*").alias("total_modules"))
    both = o.withColumn("_k", F.lit(1)).join(m.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("avg_modules_per_object", F.round(F.col("total_modules") / F.greatest("total_objects", F.lit(1)), 6))


def config_lists(objects: DataFrame, subsystems: DataFrame) -> DataFrame:
    """kind, name: the metadata types and the subsystems of a configuration."""
    types = objects.select(F.lit("type").alias("kind"), F.col("type_dir").alias("name")).distinct()
    return types.unionByName(subsystems.select(F.lit("subsystem").alias("kind"), "name").distinct())


def compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """name, change (added, removed) between the name sets of two snapshots."""
    sides = one.select("name", F.lit(1).alias("s")).unionByName(two.select("name", F.lit(2).alias("s"))).groupBy("name").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    return sides.filter("lo = hi").select("name", F.when(F.col("lo") == 1, "removed").otherwise("added").alias("change"))


def compare_totals(one: DataFrame, two: DataFrame) -> DataFrame:
    sides = one.select("name", F.lit(1).alias("s")).unionByName(two.select("name", F.lit(2).alias("s"))).groupBy("name").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return sides.agg(n("hi = 2 AND lo = 2").alias("added"), n("hi = 1").alias("removed"), n("lo < hi").alias("common"), n("lo = 1").alias("total1"), n("hi = 2").alias("total2"))


def diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """name, change (added, removed, changed): the last object of a name counts; code or description decide."""
    tag = lambda df, s: df.select("name", "ord", "code", "description", F.lit(s).alias("s"))
    both = tag(one, 1).unionByName(tag(two, 2)).groupBy("name", "s").agg(F.max(F.struct("ord", "code", "description")).alias("v"))
    wide = both.groupBy("name").agg(F.max(F.when(F.col("s") == 1, F.col("v"))).alias("a"), F.max(F.when(F.col("s") == 2, F.col("v"))).alias("b"))
    differs = ~(F.col("a.code").eqNullSafe(F.col("b.code")) & F.col("a.description").eqNullSafe(F.col("b.description")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(differs, "changed")
    return wide.select("name", change.alias("change")).filter("change IS NOT NULL")


def files_compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """rel_path, change between two listings (rel_path, content) of source files."""
    suffix = F.lower(F.substring_index("rel_path", ".", -1)).isin(*R.COMPARED_SUFFIXES)
    tag = lambda df, s: df.filter(suffix).select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("h"), F.lit(s).alias("s"))
    sides = tag(one, 1).unionByName(tag(two, 2)).groupBy("rel_path").agg(F.max(F.when(F.col("s") == 1, F.col("h"))).alias("a"), F.max(F.when(F.col("s") == 2, F.col("h"))).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return sides.select("rel_path", change.alias("change")).filter("change IS NOT NULL")


def largest(modules_listed: DataFrame, k: int = 20) -> DataFrame:
    return modules_listed.orderBy(F.desc("lines"), "path").limit(k)


def risk_areas(objects: DataFrame) -> DataFrame:
    outside = (F.coalesce("subsystem", F.lit("")) == "") & ~F.col("type").isin(*R.NOT_ORPHANS)
    return objects.agg(F.count(F.when(outside, 1)).alias("orphaned_objects"), (F.count(F.when(F.coalesce("subsystem", F.lit("")) != "", 1)) == 0).alias("unmapped_subsystems"))


def missing_parts(listing: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """part, found for a listing of relative paths: a part that ends in / is a directory."""
    spark = listing.sparkSession
    parts = spark.createDataFrame([(p, i) for i, p in enumerate(expected)], "part string, i int")
    any_of = lambda p: F.bool_or(F.col("rel_path").startswith(p) if p.endswith("/") else F.col("rel_path") == p)
    row = listing.agg(*[F.coalesce(any_of(p), F.lit(False)).alias(f"f{i}") for i, p in enumerate(expected)])
    found = row.select(F.posexplode(F.array(*[f"f{i}" for i in range(len(expected))])).alias("i", "found"))
    return parts.join(found, "i").select("part", "found")


def validate_build(listing: DataFrame) -> DataFrame:
    """kind (warning, issue), message for a dump's listing of relative paths."""
    missing = missing_parts(listing, tuple(f"{d}/" for d in R.REQUIRED_DIRS)).filter("NOT found")
    warnings = missing.select(F.lit("warning").alias("kind"), F.concat(F.lit("Directory not found: "), F.regexp_replace("part", "/$", "")).alias("message"))
    git = listing.agg(F.coalesce(F.bool_or(F.col("rel_path").startswith(".git/")), F.lit(False)).alias("g")).filter("g")
    return warnings.unionByName(git.select(F.lit("issue").alias("kind"), F.lit(".git directory found in config dump — should be excluded").alias("message")))


def last_per(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
