"""File trees: walking, ignore rules, hashing, roots and change scopes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import extension, glob_regex, safe_path
from .languages import EXTENSIONS

#: Rules up to which they are broadcast (some 100 bytes each); shares of the entries beyond.
RULES, SALTS = 50_000, 32


def compile_rule(line: str) -> tuple[str, bool, bool, bool] | None:
    """(regex, negated, directories only, anchored) of a line of an ignore file; None for blanks and comments."""
    text = line.rstrip("\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    if text.startswith(("\\#", "\\!")):
        text = text[1:]
    directory = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.lstrip("/")
    if not text:
        return None
    out, k = "", 0
    while k < len(text):
        if text.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
        elif text.startswith("**", k):
            out, k = out + ".*", k + 2
        elif text[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif text[k] == "?":
            out, k = out + "[^/]", k + 1
        elif text[k] == "[" and (end := text.find("]", k + 2)) > 0:
            body = text[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif text[k] == "\\" and k + 1 < len(text):
            out, k = out + re.escape(text[k + 1]), k + 2
        else:
            out, k = out + re.escape(text[k]), k + 1
    return f"^{out}$", negated, directory, anchored


def ignore_rules(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The rule table of ignore files, given by their directory ('' for the root)."""
    rows, n = [], 0
    for base in sorted(files, key=lambda d: (d.count("/") + bool(d), d)):
        for line in files[base].split("\n"):
            if rule := compile_rule(line):
                rows.append((n, base, *rule))
                n += 1
    return spark.createDataFrame(rows, "ord int, base string, regex string, negated boolean, dir_only boolean, anchored boolean")


def ancestors(path: Column) -> Column:
    """The path's folders from the outermost on, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """The ignored of entries (path, is_dir): the last matching rule decides; rules hold below their base, unanchored ones on names.

    An entry is exploded to the folders above it, so it meets the rules of these by an
    equi join.  Up to `RULES` rules are broadcast; more are joined by base and a salt of
    the entries, as all entries meet the root's rules.
    """
    inside = F.when(F.col("base") == "", F.col("path")).otherwise(F.expr("substring(path, length(base) + 2)"))
    subject = F.when(F.col("anchored"), inside).otherwise(F.substring_index("path", "/", -1))
    e = entries.select("path", "is_dir", F.explode(F.concat(F.array(F.lit("")), F.filter(ancestors(F.col("path")), lambda x: x != F.col("path")))).alias("base"))
    if len(rules.take(RULES + 1)) <= RULES:
        hit = e.join(F.broadcast(rules), "base")
    else:
        salted = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = e.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, ["base", "_salt"])
    hit = hit.filter((F.col("is_dir") | ~F.col("dir_only")) & F.call_function("regexp_like", subject, F.col("regex")))
    return hit.groupBy("path").agg(F.max_by("negated", "ord").alias("negated")).filter("NOT negated").select("path")


def visible(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """The files that neither they nor a directory above them ignores or hides.

    Each file is exploded to its ancestors, so pruning is one anti join.
    """
    out = ignored(entries, rules)
    files = entries.filter("NOT is_dir AND NOT rlike(concat('/', path), '/[.]')")
    chain = files.select("path", F.explode(ancestors(F.col("path"))).alias("up"))
    bad = chain.join(out.withColumnRenamed("path", "up"), "up", "left_semi").select("path").distinct()
    return files.join(bad, "path", "left_anti").select("path")


def known_extension(df: DataFrame, column: str = "file_path", only: list[str] | None = None) -> DataFrame:
    return df.filter(extension(F.col(column)).isin(only or sorted(EXTENSIONS)))


def walk(spark: SparkSession, root: str, rules: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """file_path, content_hash, file_size and content (text) of a directory's known files.

    Only files of a known extension are opened.  Files that aren't UTF-8 have no text.
    """
    known = sorted(only or EXTENSIONS)
    name = "*.{" + ",".join(sorted({*known, *(x.upper() for x in known)})) + "}"
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:"))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}/", "")
    b = b.withColumn("file_path", rel)
    b = known_extension(b, only=known).filter(~F.concat(F.lit("/"), "file_path").rlike(r"/\."))
    if rules is not None:
        up = b.select(F.explode(ancestors(F.col("file_path"))).alias("path"), "file_path").select("path", (F.col("path") != F.col("file_path")).alias("is_dir")).distinct()
        b = b.join(visible(up, rules).withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    text = F.when(F.expr("is_valid_utf8(cast(content AS string))"), F.col("content").cast("string"))
    return b.select("file_path", F.substring(F.sha2("content", 256), 1, 32).alias("content_hash"), F.col("length").alias("file_size"), text.alias("content"))


def roots(directories: DataFrame) -> DataFrame:
    """The repositories (path of directories with `.git`) that lie in no other one."""
    d = directories.select("path").distinct()
    above = d.select("path", F.explode(ancestors(F.col("path"))).alias("above")).filter("above <> path")
    inner = above.join(d.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return d.join(inner, "path", "left_anti").orderBy("path")


def enclosing_root(paths: DataFrame, root: DataFrame) -> DataFrame:
    """path and root: the nearest root above or at a path; null if none.

    A path is exploded to its ancestors, so this is an equi join.
    """
    chain = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    best = chain.join(root.select("root").distinct(), "root", "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left")


def overlapping(open_roots: DataFrame, wanted: str) -> DataFrame:
    """root and relation (exact, descendant, ancestor) of the open roots that a new one collides with."""
    w = F.lit(wanted)
    how = F.when(F.col("root") == w, "exact").when(F.startswith(w, F.concat("root", F.lit("/"))), "descendant").when(F.startswith(F.col("root"), F.concat(w, F.lit("/"))), "ancestor")
    return open_roots.select("root", how.alias("relation")).filter("relation IS NOT NULL")


def porcelain(lines: DataFrame) -> DataFrame:
    """position and path of the changed files of `git status --porcelain` lines (position, line)."""
    x, y = F.substring("line", 1, 1), F.substring("line", 2, 1)
    rest = F.expr("substring(line, 4)")
    keep = (F.substring("line", 1, 2) == "??") | (~x.isin("U", "D") & ~y.isin("U", "D") & ((x == "M") | (y == "M") | x.isin("A", "R", "C")))
    path = F.when(x == "R", F.element_at(F.split(rest, " -> "), -1)).otherwise(rest)
    return lines.filter(keep).select("position", path.alias("path"))


def changed(lines: DataFrame) -> DataFrame:
    """position and path of what a range of commits changed, from lines (position, line) of `git diff --name-status`: added, copied, modified and renamed files, by their new name."""
    parts = F.split("line", "\t")
    return lines.filter(F.col("line").rlike("^[ACMR]")).select("position", F.element_at(parts, -1).alias("path"))


def diff_range(text: str) -> str:
    """A range of commits as it is, a single commit up to HEAD."""
    return text if ".." in text else f"{text}..HEAD"


def matching(files: DataFrame, pattern: str) -> DataFrame:
    """position and path of a file scope: the pattern itself where it has no `*`, `?` or `[`; else the files (file_path) that match, none of whose wildcards crosses a slash, in order."""
    if not re.search(r"[*?\[]", pattern):
        return files.sparkSession.createDataFrame([(0, pattern)], "position long, path string")
    rx = glob_regex(pattern).replace("(?s:.*)", "[^/]*").replace("(?s:.)", "[^/]")
    hidden = F.exists(F.split("path", "/"), lambda x: F.startswith(x, F.lit(".")))
    hit = files.select(F.col("file_path").alias("path")).filter(F.col("path").rlike(rx))
    hit = hit if re.search(r"(^|/)\.", pattern) else hit.filter(~hidden)
    return hit.withColumn("position", F.row_number().over(Window.orderBy("path")).cast("long")).select("position", "path")


def scope(paths: DataFrame, diagnosable: list[str]) -> DataFrame:
    """The safe, diagnosable paths, the first of equals, in order."""
    ok = paths.filter(safe_path(F.col("path")) & extension(F.col("path")).isin(diagnosable))
    w = Window.partitionBy("path").orderBy("position")
    return ok.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").orderBy("position")
