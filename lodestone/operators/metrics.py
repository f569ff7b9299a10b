"""Function and module metrics, gates, trends and duplicate blocks over modules(path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.work import saved
from . import rules as R

def in_file():
    """A file's lines in order."""
    return Window.partitionBy("path").orderBy("line_no")


def _flags(modules: DataFrame) -> DataFrame:
    """Narrow columns of every line: only these are shuffled by the window over a file's lines, not the text."""
    branches = sum((F.col("text").contains(w).cast("int") for w in R.BRANCH_WORDS), F.lit(0))
    kind = T.extract(F.col("text"), R.FUNCTION_HEADER, 1, cased=True)
    return T.lines(modules).select("path", "line_no", F.nullif(kind, F.lit("")).alias("kind"), T.extract(F.col("text"), R.FUNCTION_HEADER, 2, cased=True).alias("name"), branches.alias("branches"))


def _grouped(modules: DataFrame) -> DataFrame:
    """One row per file and function number; number 0 holds the lines before the first header."""
    numbered = _flags(modules).withColumn("fn_no", F.count("kind").over(in_file()))
    header = F.col("kind").isNotNull()
    return numbered.groupBy("path", "fn_no").agg(
        F.max("kind").alias("type"),
        F.max(F.when(header, F.col("name"))).alias("name"),
        F.min("line_no").alias("start"),
        (F.lit(1) + F.sum(F.when(~header, F.col("branches")).otherwise(0))).alias("complexity"),
        F.count("*").alias("n_lines"),
    )


def functions(modules: DataFrame) -> DataFrame:
    """path, fn_no, type, name, start, complexity, lines. A function ends at the next header or the file's end."""
    g = _grouped(modules).filter("fn_no > 0")
    return g.select("path", "fn_no", "type", "name", F.col("start").cast("int").alias("start"), F.col("complexity").cast("long").alias("complexity"), (F.col("n_lines") - 1).alias("lines"))


def module_metrics(modules: DataFrame) -> DataFrame:
    """path, lines, functions, max_complexity (0 without a function)."""
    named = F.col("fn_no") > 0
    return _grouped(modules).groupBy("path").agg(
        F.sum("n_lines").alias("lines"), F.count(F.when(named, 1)).alias("functions"), F.coalesce(F.max(F.when(named, F.col("complexity"))), F.lit(0)).cast("long").alias("max_complexity")
    )


def module_complexity(modules: DataFrame, max_lines: int = R.MAX_LINES, max_complexity: int = R.MAX_COMPLEXITY, max_functions: int = R.MAX_FUNCTIONS) -> DataFrame:
    """Module metrics with the texts of exceeded limits, joined by '; '."""
    over = lambda column, limit, text: F.when(F.col(column) > limit, F.concat(F.lit(text + ": "), F.col(column).cast("string"), F.lit(f" > {limit}")))
    issues = F.array_compact(F.array(over("lines", max_lines, "Too many lines"), over("max_complexity", max_complexity, "High complexity"), over("functions", max_functions, "Too many functions")))
    return module_metrics(modules).withColumn("issues", F.array_join(issues, "; "))


def quality_gate(modules: DataFrame, max_complexity: int = R.MAX_COMPLEXITY, max_lines: int = R.MAX_LINES) -> DataFrame:
    """path, check, value, threshold of every violation."""
    m = module_metrics(modules)
    checks = [("max_loc", F.col("lines"), max_lines), ("max_cyclomatic", F.col("max_complexity"), max_complexity)]
    rows = [F.when(v > t, F.struct(F.lit(n).alias("check"), v.alias("value"), F.lit(t).cast("long").alias("threshold"))) for n, v, t in checks]
    return m.select("path", F.inline(F.array_compact(F.array(*rows))))


def quality_gate_passed(modules: DataFrame, max_complexity: int = R.MAX_COMPLEXITY, max_lines: int = R.MAX_LINES) -> DataFrame:
    m = module_metrics(modules)
    bad = (F.col("lines") > max_lines) | (F.col("max_complexity") > max_complexity)
    return m.agg(F.coalesce(~F.bool_or(bad), F.lit(True)).alias("passed"), F.count(F.when(bad, 1)).alias("files_with_violations"))


def quality_metrics(modules: DataFrame) -> DataFrame:
    m = module_metrics(modules).agg(F.count("*").alias("total_files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("functions"), F.lit(0)).alias("total_functions"), F.coalesce(F.max("max_complexity"), F.lit(0)).alias("max_cyclomatic_complexity"))
    return m.withColumn("avg_loc_per_function", F.round(F.col("total_lines") / F.greatest("total_functions", F.lit(1)), 6))


def quality_trend(snapshots: DataFrame) -> DataFrame:
    """snapshot, lines, files of modules with a column snapshot, and what can be said of a trend over all snapshots."""
    n = F.size(F.split("content", "\n", -1))
    per = snapshots.groupBy("snapshot").agg(F.sum(n).cast("long").alias("lines"), F.count("*").alias("files"))
    several = F.count("*").over(Window.partitionBy(F.lit(0))) > 1  # one row per snapshot
    return per.withColumn("trend", F.when(several, "compare snapshots").otherwise("insufficient_data"))


def module_list(modules: DataFrame) -> DataFrame:
    """path, lines, functions (lines that mention a header word anywhere)."""
    parts = F.split("content", "\n", -1)
    return modules.select("path", F.size(parts).cast("long").alias("lines"), F.size(F.filter(parts, lambda x: T.has_any(x, ("Процедура", "Функция")))).cast("long").alias("functions"))


def file_coverage(paths: DataFrame) -> DataFrame:
    """test_files, source_files. A file with both spellings counts twice, as two patterns find it."""
    name = F.element_at(F.split("path", "/"), -1)
    tests = F.when(name.contains("Тест"), 1).otherwise(0) + F.when(name.contains("test"), 1).otherwise(0)
    return paths.filter(F.col("path").endswith(".bsl")).agg(F.coalesce(F.sum(tests), F.lit(0)).alias("test_files"), F.count(F.when(~F.lower(name).contains("test"), 1)).alias("source_files"))


# duplicate blocks


def normalized_lines(modules: DataFrame) -> DataFrame:
    """path, idx (from 1), norm: lines without blank ones and comments, white space collapsed."""
    bare = F.transform(F.split("content", "\n", -1), lambda x: T.strip(x))
    kept = F.filter(bare, lambda x: (x != "") & ~x.startswith("//"))
    return modules.select("path", F.transform(kept, lambda x: F.regexp_replace(x, r"(?U)\s+", " ")).alias("norm"))


def _key(block: Column) -> Column:
    return F.sha2(F.array_join(block, "\n"), 256)


def _first_repeat(blocks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Each block with the first equal one that begins at least n lines later.

    Rows go from the last block to the first, so the frame only grows and its least element is the nearest.
    """
    later = Window.partitionBy(*keys).orderBy(F.desc("idx")).rangeBetween(Window.unboundedPreceding, -n)
    return blocks.withColumn("second", F.min("idx").over(later)).filter("second IS NOT NULL")


def _reported(found: DataFrame, n: int, *more: str) -> DataFrame:
    preview = F.concat(F.substring("first_line", 1, 80), F.lit("..." if n > 1 else ""))
    i, j = F.col("idx").cast("long"), F.col("second").cast("long")
    return found.select(*more, i.alias("first_start"), (i + n - 1).alias("first_end"), j.alias("second_start"), (j + n - 1).alias("second_end"), F.lit(n).cast("long").alias("lines"), preview.alias("block_preview"))


def duplicates_in_modules(modules: DataFrame, n: int = R.DUPLICATE_LINES) -> DataFrame:
    """Repeated blocks inside each module; positions are those of the normalised lines."""
    arrays = normalized_lines(modules).filter(F.size("norm") >= 2 * n)
    starts = F.sequence(F.lit(1), F.size("norm") - n + 1)
    blocks = arrays.select("path", F.explode(F.transform(starts, lambda i: F.struct(i.alias("idx"), _key(F.slice("norm", i, n)).alias("key"), F.substring(F.element_at("norm", i), 1, 80).alias("first_line")))).alias("b"))
    return _reported(_first_repeat(blocks.select("path", "b.*"), ["path", "key"], n), n, "path")


def duplicates_in_corpus(modules: DataFrame, n: int = R.DUPLICATE_LINES, bucket: int = 10_000) -> DataFrame:
    """Repeated blocks over all modules in a row (in path order); a block may reach over modules.

    Lines get their running number from per-module counts, summed by ranges of paths; blocks are made in buckets of running
    numbers (at least n long), each with the first n - 1 lines of the next. A block's repeat is looked for in its bucket, and
    beyond it among the first ones of later buckets, so a block that is everywhere does not come together in one task.
    """
    arrays = normalized_lines(modules)
    sizes = saved(arrays.select("path", F.size("norm").alias("c")).repartitionByRange("path").withColumn("part", F.spark_partition_id()), "module-sizes")
    upto = lambda *keys: (Window.partitionBy(*keys[:-1]) if keys[:-1] else Window).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("part").agg(F.sum("c").alias("s")).select("part", F.coalesce(F.sum("s").over(upto("part")), F.lit(0)).alias("offset"))
    before = sizes.withColumn("within", F.coalesce(F.sum("c").over(upto("part", "path")), F.lit(0))).join(ranges, "part").select("path", (F.col("offset") + F.col("within")).alias("before"))
    lines = arrays.join(before, "path").select("before", F.posexplode("norm").alias("p", "norm")).select((F.col("before") + F.col("p") + 1).alias("idx"), "norm")
    own = lines.withColumn("bucket", F.floor((F.col("idx") - 1) / bucket))
    spill = own.filter(((F.col("idx") - 1) % bucket < n - 1) & (F.col("bucket") > 0)).withColumn("bucket", F.col("bucket") - 1)
    frame = Window.partitionBy("bucket").orderBy("idx").rowsBetween(0, n - 1)
    blocks = own.unionByName(spill).withColumn("block", F.collect_list("norm").over(frame)).filter((F.size("block") == n) & (F.floor((F.col("idx") - 1) / bucket) == F.col("bucket")))
    blocks = saved(blocks.select("idx", "bucket", _key(F.col("block")).alias("key"), F.substring("norm", 1, 80).alias("first_line")), "corpus-blocks")
    place = (F.col("idx") - 1) % bucket
    # Of every bucket that holds the block: its first place, and the first one that is n lines after all of the bucket before.
    firsts = blocks.groupBy("key", "bucket").agg(F.min("idx").alias("first"), F.min(F.when(place >= n - 1, F.col("idx"))).alias("late"))
    back = Window.partitionBy("key").orderBy(F.desc("bucket"))
    beyond = F.coalesce(F.min("late").over(back.rangeBetween(-1, -1)), F.min("first").over(back.rangeBetween(Window.unboundedPreceding, -2)))
    firsts = firsts.select("key", "bucket", beyond.alias("beyond"))
    # The first n - 1 places of the next bucket are looked at with the bucket itself.
    near = blocks.filter((place < n - 1) & (F.col("bucket") > 0)).withColumn("bucket", F.col("bucket") - 1)
    both = blocks.withColumn("own", F.lit(True)).unionByName(near.withColumn("own", F.lit(False)))
    later = Window.partitionBy("key", "bucket").orderBy(F.desc("idx")).rangeBetween(Window.unboundedPreceding, -n)
    found = both.withColumn("inside", F.min("idx").over(later)).filter("own").join(firsts, ["key", "bucket"]).withColumn("second", F.coalesce("inside", "beyond"))
    return _reported(found.filter("second IS NOT NULL"), n)
