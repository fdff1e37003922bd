"""Filters and sums over a tree of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import glob_regex

#: Extensions of tools' own files, and ends of extensions of a database's side files.
WORK_EXTENSIONS = [
    "tmp", "temp", "bak", "crdownload", "part", "partial", "download", "opdownload", "!ut", "lock", "lck",
    "swp", "swo", "log", "etl", "blf", "regtrans-ms", "dat", "db", "wal",
    "shm", "ldb", "edb", "jfm", "crc", "mmkv", "dmp", "mdmp", "symcache", "obj", "o", "pdb", "ilk", "idb", "iobj", "ipdb", "pch",
    "ipch", "tlog", "lastbuildstate", "exp", "ninja_log", "ninja_deps", "d", "pyc", "class", "cache",
]
WORK_SUFFIXES = ["-wal", "-shm", "-journal"]


def under(ids: list[int]) -> Column:
    """Below any of a few folders, at any depth."""
    return F.arrays_overlap("ancestor_ids", F.array(*[F.lit(i).cast("long") for i in ids]))


def within(ids: list[int]) -> Column:
    return F.col("id").isin(ids) | under(ids)


def child_of(folder: int) -> Column:
    return F.col("parent_id") == folder


def path_starts(prefix: str) -> Column:
    from quillsift.functions.text import fold, folded

    return F.startswith(folded(F.col("path")), F.lit(fold(prefix)))


def path_tail(parts: list[str]) -> Column:
    """The folded end of the path is exactly these names."""
    return F.slice(F.concat("folders", F.array("name_folded")), -len(parts), len(parts)) == F.array(*[F.lit(p) for p in parts])


def work_file(name_folded: Column, ext: Column, is_dir: Column | None = None) -> Column:
    """Noise: empty names and names with a dot or ~ in front; of files also a hash of 16 digits or more in front (a
    run of digits alone may be a date), tools' extensions, kept-aside copies and a database's side files."""
    stem = F.regexp_replace(name_folded, r"\.[^.]*$", "")
    run = F.regexp_extract(stem, "^[0-9a-f]*", 0)
    hashed = (F.length(run) >= 16) & run.rlike("[a-f]")
    side = ext.rlike(f".(?:{'|'.join(WORK_SUFFIXES)})$") | ext.rlike("^bak-.")
    file = hashed | F.coalesce(ext.isin(WORK_EXTENSIONS) | side, F.lit(False))
    return (name_folded == "") | name_folded.rlike("^[.~]") | (file if is_dir is None else ~is_dir & file)


def semi_below(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """Entries below any folder of a table (folder_id): an equality join on exploded ancestors, no nested loop."""
    pairs = entries.select("id", F.explode("ancestor_ids").alias("folder_id"))
    return entries.join(pairs.join(folders.select("folder_id").distinct(), "folder_id").select("id").distinct(), "id", "left_semi")


def folder_totals(entries: DataFrame) -> DataFrame:
    """Sizes of folders with all that is below: unknown sizes are left out, only unknown ones give null, nothing gives 0.

    Files are summed by parent first, so what is exploded over ancestors is a row for each folder, not for each file.
    """
    files = entries.where("NOT is_dir").groupBy("parent_id").agg(F.sum("size").alias("own"), F.count(F.lit(1)).alias("files"))
    folders = entries.where("is_dir").select("id", "ancestor_ids")
    direct = folders.join(files, folders["id"] == files["parent_id"]).select(F.explode(F.concat("ancestor_ids", F.array("id"))).alias("folder_id"), "own", "files")
    sums = direct.groupBy("folder_id").agg(F.sum("own").alias("total"), F.sum("files").alias("files"))
    known = folders.join(sums, folders["id"] == sums["folder_id"], "left")
    return known.select(folders["id"], F.when(F.col("files").isNull(), F.lit(0)).otherwise(F.col("total")).cast("long").alias("total"), F.coalesce("files", F.lit(0)).cast("long").alias("files"))


def empty_folders(entries: DataFrame) -> DataFrame:
    kids = entries.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("_p")).distinct()
    return entries.where("is_dir").join(kids, F.col("id") == F.col("_p"), "left_anti")


#: Largest files that are read for their text, by kind (bytes).
READ_LIMITS = {"code": 2 << 20, "data": 4 << 20, "text": 16 << 20, "document": 100 << 20}
READ_KINDS = {"code": ["c", "cpp", "java", "js", "py", "rs", "sql"], "data": ["csv", "json", "log", "xml"], "text": ["md", "txt"], "document": ["docx", "pdf", "pptx", "xlsx"]}


def read_verdict(low_priority: Column) -> Column:
    """Whether a file's text is read: read, low_priority, too_large or unknown_size. Extensions that no kind lists, and
    none at all, count as text."""
    limit = F.when(F.col("ext").isin(READ_KINDS["text"]), READ_LIMITS["text"])
    for kind in ("code", "data", "document"):
        limit = limit.when(F.col("ext").isin(READ_KINDS[kind]), READ_LIMITS[kind])
    limit = limit.otherwise(READ_LIMITS["text"])
    return F.when(F.col("size").isNull(), "unknown_size").when(F.col("size") > limit, "too_large").when(low_priority, "low_priority").otherwise("read")


def hidden(rules: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that no rule hides; a rule (rule) is a folder's folded name, at any depth."""
    gone = entries.select("id", F.explode(F.concat("folders", F.when(F.col("is_dir"), F.array("name_folded")).otherwise(F.array().cast("array<string>")))).alias("rule"))
    return entries.join(gone.join(rules.select("rule").distinct(), "rule").select("id").distinct(), "id", "left_anti")


def skip_reason(excluded_ext: list[str], hidden: list[int]) -> Column:
    """Why an entry is left out: at most one reason, counted apart."""
    return F.when(F.col("ext").isin(excluded_ext) & under(hidden), "both").when(F.col("ext").isin(excluded_ext), "type").when(under(hidden), "hidden").otherwise("shown")


def left_out(excluded_ext: list[str], globs: list[str], hidden: list[int]) -> Column:
    """The same for types and names: files of an extension or with a name of a pattern (*, ?) are out as a type; a folder
    is none, whatever its name."""
    named = F.lit(False)
    for g in globs:
        named = named | F.col("name_folded").rlike(glob_regex(g))
    kind = ~F.col("is_dir") & (F.coalesce(F.col("ext").isin(excluded_ext), F.lit(False)) | named)
    return F.when(kind & under(hidden), "both").when(kind, "type").when(under(hidden), "hidden").otherwise("shown")
