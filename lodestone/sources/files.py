"""Sources: dumps of modules and metadata XML, standards corpora, registries, binary artifacts, listings."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as R


def require(path: str | None) -> str:
    """A path that is given; a scan of nothing must not look like a clean one."""
    if not path:
        raise ValueError("code_path required")
    return path


def _relative(path: str) -> Column:
    """The part of a file's path below the root. Spark reports paths URL-encoded."""
    root = path.rstrip("/").split("://")[-1].removeprefix("file:")
    full = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z0-9]+:/{0,2}(?=/)", "")
    return F.regexp_replace(F.substring_index(full, root + "/", -1), r"^/+", "")


def text_of(content: Column) -> Column:
    """UTF-8 with replacement, universal line ends."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


#: What the bytes from 128 on are in the fallback encoding.
_UPPER = bytes(range(128, 256))


def decoded(content: Column) -> Column:
    """A tool's output: UTF-8 if it is valid, else code page 866, in which every byte means something."""
    latin = F.decode(content, "ISO-8859-1")
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.translate(latin, _UPPER.decode("latin-1"), _UPPER.decode("cp866")))


def file_hashes(files: DataFrame) -> DataFrame:
    """rel_path, sha256 of files (rel_path, content)."""
    return files.select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def write_json(result: DataFrame, path: str) -> None:
    """A result as JSON lines with all its fields, nulls included."""
    result.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(require(path))


def load_modules(spark: SparkSession, path: str) -> DataFrame:
    """modules(path, content) of all *.bsl files below a folder, path relative to it; or of one such file."""
    if require(path).lower().endswith(".bsl"):
        one = spark.read.format("binaryFile").load(path)
        return one.select(F.element_at(F.split(_relative(""), "/"), -1).alias("path"), text_of(F.col("content")).alias("content"))
    return binary_files(spark, path, "*.bsl").select(_relative(path).alias("path"), text_of(F.col("content")).alias("content"))


def load_listing(spark: SparkSession, path: str) -> DataFrame:
    """rel_path, length of all files below a folder."""
    return binary_files(spark, path, "*").select(_relative(path).alias("rel_path"), "length")


def load_contents(spark: SparkSession, path: str) -> DataFrame:
    return binary_files(spark, path, "*").select(_relative(path).alias("rel_path"), "content")


def artifact_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, size, header, valid of binary artifacts."""
    files = spark.read.format("binaryFile").load(require(path))
    return headers(files.select("path", F.col("length").alias("size"), "content"))


def headers(files: DataFrame) -> DataFrame:
    """path, size, header (lower-case hex of 8 bytes), valid from path, size, content."""
    head = F.hex(F.substring("content", 1, 8))
    valid = F.lit(False)
    for m in R.MAGICS:
        valid = valid | head.startswith(m)
    return files.select("path", "size", F.lower(head).alias("header"), valid.alias("valid"))


def extract_version(files: DataFrame) -> DataFrame:
    """path, version of text artifacts."""
    return files.select("path", F.regexp_extract(text_of(F.col("content")), "(?Ud)" + R.VERSION_PATTERN, 2).alias("version"))


# metadata XML


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _child(e, name: str):
    return next((c for c in e if _tag(c) == name), None) if e is not None else None


def _text(e) -> str:
    return (e.text or "").strip() if e is not None else ""


def _properties(e) -> dict:
    return {_tag(c): c for c in (_child(e, "Properties") if _child(e, "Properties") is not None else [])}


_TYPED, _NAMED = ("Attribute", "Dimension", "Resource", "Column", "Field"), ("EnumValue", "RecordType", "AddressingAttribute")


def _members(holder, section: str | None) -> list[dict]:
    out: list[dict] = []
    for child in _child(holder, "ChildObjects") if _child(holder, "ChildObjects") is not None else []:
        kind, props = _tag(child), _properties(child)
        row = {"section": section, "member_kind": kind, "name": _text(props.get("Name")), "type": "", "type_uri": "", "type_qualifiers": [], "description": ""}
        if kind in ("Form", "Command", "Template"):
            row["name"] = row["name"] or _text(child)
        if not row["name"]:
            continue
        if kind == "TabularSection":
            out += [row, *_members(child, row["name"])]
        elif kind in _TYPED:
            for t in props.get("Type") if props.get("Type") is not None else []:
                if _tag(t) == "Type":
                    row["type_uri"] = _text(t)
                    row["type"] = row["type_uri"].split(":", 1)[-1]
                elif _tag(t).endswith("Qualifiers"):
                    row["type_qualifiers"] += [(_tag(q), _text(q)) for q in t if _text(q)]
            row["description"] = next((d for k in ("Comment", "Description") if (d := _text(props.get(k)))), "")
            out.append(row)
        elif kind in _NAMED or kind in ("Form", "Command", "Template"):
            out.append(row)
    return out


def parse_object(content: bytes, stem: str) -> dict | None:
    """Name, code, description and members of one object's XML, in document order; None if it is malformed. What has no
    properties is described by the root's attributes and its Description."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return None
    inner = root[0] if len(root) else root
    props = _properties(inner)
    value = lambda k: _text(props.get(k))
    return {
        "name": value("Name") or root.get("Name") or stem,
        "code": value("Code") or root.get("Code", ""),
        "description": value("Description") or _text(_child(root, "Description")),
        "members": _members(inner, None),
    }


_MEMBER = pa.struct([("section", pa.string()), ("member_kind", pa.string()), ("name", pa.string()), ("type", pa.string()), ("type_uri", pa.string()), ("type_qualifiers", pa.map_(pa.string(), pa.string())), ("description", pa.string())])
_PARSED = "path string, name string, code string, description string, members array<struct<section:string,member_kind:string,name:string,type:string,type_uri:string,type_qualifiers:map<string,string>,description:string>>"


def parse_objects(files: DataFrame) -> DataFrame:
    """path, name, code, description, members from path, content (XML). Malformed files are left out.

    Python, since members of different kinds must keep their order in the document, which schema-based XML readers lose.
    """

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                got = parse_object(content, path.rsplit("/", 1)[-1].removesuffix(".xml"))
                if got:
                    rows.append((path, got["name"], got["code"], got["description"], got["members"]))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.list_(_MEMBER))], ["path", "name", "code", "description", "members"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, _PARSED)


def object_files(files: DataFrame) -> DataFrame:
    """Those of rel_path, content that describe an object: <Type>/<Object>.xml, or one file of <Type>/<Object>/, the one
    named like it if there is one."""
    parts = F.split("rel_path", "/")
    xml = files.filter(F.lower("rel_path").endswith(".xml")).select("rel_path", "content", parts.alias("p"), F.size(parts).alias("n"))
    flat = xml.filter((F.col("n") == 2) & ~F.element_at("p", 1).isin(*R.SKIPPED_DIRS)).select("rel_path", "content", F.lit(0).alias("deep"))
    nested = xml.filter((F.col("n") == 3) & ~F.element_at("p", 1).isin(*R.SKIPPED_DIRS) & (F.element_at("p", 2) != "Ext"))
    named = F.element_at("p", 3) == F.concat(F.element_at("p", 2), F.lit(".xml"))
    best = nested.groupBy(F.element_at("p", 1).alias("t"), F.element_at("p", 2).alias("o")).agg(F.min(F.struct((~named).alias("other"), "rel_path"))["rel_path"].alias("rel_path"))
    return flat.unionByName(nested.join(best.select("rel_path"), "rel_path", "left_semi").select("rel_path", "content", F.lit(1).alias("deep")))


def type_name(type_dir: Column) -> Column:
    types = F.create_map(*[F.lit(x) for kv in R.PARSER_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(types, type_dir), type_dir)


def load_objects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(objects, members) of a dump. objects: type_dir, type, name, code, description, subsystem, forms, commands, ord."""
    files = object_files(load_contents(spark, path))
    parsed = parse_objects(files.select(F.col("rel_path").alias("path"), "content"))
    parsed = parsed.withColumn("type_dir", F.substring_index("path", "/", 1))
    names = lambda kind: F.transform(F.filter("members", lambda m: m["section"].isNull() & (m["member_kind"] == kind)), lambda m: m["name"])
    objects = parsed.select(
        "type_dir", type_name(F.col("type_dir")).alias("type"), "name", "code", "description", F.lit("").alias("subsystem"), names("Form").alias("forms"), names("Command").alias("commands"),
        "path",
    )
    objects = objects.withColumn("ord", F.col("path")).drop("path")
    members = parsed.select("type_dir", F.col("name").alias("object"), F.posexplode("members").alias("pos", "m")).select("type_dir", "object", (F.col("pos") + 1).alias("pos"), "m.*")
    return objects, members


def load_subsystems(spark: SparkSession, path: str) -> DataFrame:
    """name, description of the files directly below Subsystems, by the root's attributes; '' without a name."""
    files = load_contents(spark, path).filter(F.col("rel_path").rlike(r"^Subsystems/[^/]*\.xml$"))

    def run(batches):
        for b in batches:
            rows = []
            for content in b.column("content").to_pylist():
                try:
                    root = ET.fromstring(content)
                except ET.ParseError:
                    continue
                rows.append((root.get("Name", ""), root.findtext("Description", "")))
            columns = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["name", "description"])

    return files.select("content").mapInArrow(run, "name string, description string")


def membership_recorded(listing: DataFrame) -> bool:
    """Whether a dump says which objects belong to a subsystem: some Content.xml lies below Subsystems."""
    return not listing.filter(F.col("rel_path").rlike("^Subsystems/(.*/)?Content\\.xml$")).isEmpty()


def listed_members(listing: DataFrame, group: str) -> DataFrame:
    """type_dir, object, name: the folders below an object's Forms, Commands or Templates, for XML that lists none."""
    return listed_groups(listing).filter(F.col("group") == group).drop("group")


def listed_groups(listing: DataFrame) -> DataFrame:
    """type_dir, object, group, name: all folders two levels below an object's own."""
    p = F.split("rel_path", "/")
    deep = listing.filter(F.size(p) > 4)
    return deep.select(F.element_at(p, 1).alias("type_dir"), F.element_at(p, 2).alias("object"), F.element_at(p, 3).alias("group"), F.element_at(p, 4).alias("name")).distinct()


# corpora and registries


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """pages(id, title, aliases, body, ord) of a JSON-lines corpus: blank and malformed lines are left out, {"page": {...}}
    envelopes and the spellings ID and name are understood."""
    page = "id string, ID2 string, title string, name string, aliases array<string>, body_markdown string"
    rows = spark.read.text(path).withColumn("_ord", F.monotonically_increasing_id())
    return pages_of(rows.select(F.regexp_replace("value", r'"ID"\s*:', '"ID2":').alias("value"), "_ord"), page)


def pages_of(rows: DataFrame, page: str) -> DataFrame:
    parsed = rows.withColumn("j", F.from_json("value", f"{page}, page struct<{', '.join(x.replace(' ', ': ', 1) for x in page.split(', '))}>", {"mode": "PERMISSIVE"}))
    pick = lambda *names: F.coalesce(*[F.when(F.col("j.page").isNotNull(), F.col(f"j.page.{n}")).otherwise(F.col(f"j.{n}")) for n in names])
    out = parsed.select(F.coalesce(F.nullif(pick("id"), F.lit("")), pick("ID2")).alias("id"), pick("title", "name").alias("title"), F.coalesce(pick("aliases"), F.array().cast("array<string>")).alias("aliases"), pick("body_markdown").alias("body"), F.col("_ord").alias("ord"))
    return out.filter("id IS NOT NULL AND id <> ''")


def load_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """functions(name, verdict, kind), methods(name, verdict), synonyms(ru, en), disproved(name) of a registry file."""
    keys = R.REGISTRY_FILE_KEYS
    schema = f"{keys['functions']} map<string, struct<verdict: string, kind: string>>, {keys['methods']} map<string, string>, {keys['synonyms']} map<string, array<string>>, {keys['disproved']} array<string>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return {
        "functions": raw.select(F.explode(keys["functions"]).alias("name", "v")).select("name", "v.verdict", "v.kind"),
        "methods": raw.select(F.explode(keys["methods"]).alias("name", "verdict")),
        "synonyms": raw.select(F.explode(keys["synonyms"]).alias("ru", "e")).select("ru", F.explode("e").alias("en")),
        "disproved": raw.select(F.explode(keys["disproved"]).alias("name")),
    }
