"""Working directories to projects: evidence, containment, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, repo_name

# A marker directory followed by this child holds worktrees of the project above it.
WORKTREES = [(".claude", "worktrees")]
# Patterns of what follows `-` or `_` in a sibling worktree's name, and words that are no project themselves.
SUFFIXES = [r"[0-9]+(?:[-_].*)?", r"(?:issue|issues|wt|worktree|pr|branch|agent)(?:[-_].*)?"]
RESERVED = ["issue", "issues", "wt", "worktree", "pr", "branch", "agent"]


def segments(path: Column | str) -> Column:
    """Parts between slashes of either kind, without empty ones and `.`."""
    return F.filter(F.split(F.coalesce(col(path), F.lit("")), r"[/\\]"), lambda x: (x != "") & (x != "."))


def strip_worktree(segs: Column, worktrees: list[tuple[str, str]] | None = None) -> Column:
    """What lies above the first worktree marker that has a segment before and after it."""
    found = F.lit(None).cast("int")
    for marker, child in WORKTREES if worktrees is None else worktrees:
        hits = F.filter(F.transform(segs, lambda x, i: F.when((x == marker) & (F.try_element_at(segs, i + 2) == child) & (i >= 1), i)), lambda i: i.isNotNull())
        found = F.least(found, F.array_min(hits))
    return F.when(found.isNotNull(), F.slice(segs, F.lit(1), F.coalesce(found, F.lit(0)))).otherwise(segs)


def sibling_pattern(suffixes: list[str] | None = None) -> str:
    """One pattern for the leftmost cut of name and suffix; the base is lazy and no reserved word alone."""
    words = "|".join(sorted(RESERVED, key=len, reverse=True))
    reserved = f"(?i:{words})"
    tail = "|".join(SUFFIXES if suffixes is None else suffixes)
    return rf"^((?:{reserved}[-_].*?|(?!{reserved}[-_]).+?))[-_](?:{tail})\z"


def fold_sibling(name: Column | str, suffixes: list[str] | None = None) -> Column:
    """The project that a sibling worktree's name begins with, or the name."""
    n = col(name)
    base = F.regexp_extract(n, sibling_pattern(suffixes), 1)
    return F.when(base != "", base).otherwise(n)


def is_root(name: Column) -> Column:
    return name.rlike("^[A-Za-z]:$")


def name_project(segs: Column, suffixes: list[str] | None = None) -> Column:
    """The last segment's project, '' for none or a drive."""
    last = F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit(""))
    return F.when((last == "") | is_root(last), "").otherwise(fold_sibling(last, suffixes))


def match_in_path(segs: Column, name: Column) -> Column:
    """The path's spelling of a repository's name: a whole segment, or the start of the last one before `-` or `_`; else null."""
    whole = F.try_element_at(F.filter(segs, lambda s: F.lower(s) == F.lower(name)), F.lit(1))
    last = F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit(""))
    n = F.length(name)
    head = F.when((F.length(last) > n) & (F.lower(F.substring(last, F.lit(1), n)) == F.lower(name)) & F.substring(last, n + 1, F.lit(1)).isin("-", "_"), F.substring(last, F.lit(1), n))
    return F.when(name != "", F.coalesce(whole, head))


def shipped_project(segs: Column, repos: Column) -> Column:
    """The one spelling that the repositories have on the path; '' for none or several."""
    hits = F.array_distinct(F.filter(F.transform(F.coalesce(repos, F.array().cast("array<string>")), lambda r: match_in_path(segs, repo_name(r))), lambda h: h.isNotNull()))
    return F.when(F.size(hits) == 1, F.element_at(hits, 1)).otherwise("")


def project_of(cwd: Column | str, repos: Column, suffixes: list[str] | None = None, worktrees: list[tuple[str, str]] | None = None) -> Column:
    """One directory's project from its own evidence and name alone."""
    segs = strip_worktree(segments(cwd), worktrees)
    shipped = shipped_project(segs, repos)
    return F.when(F.size(segs) == 0, "").when(shipped != "", shipped).otherwise(name_project(segs, suffixes))


def segment_key(segs: Column) -> Column:
    return F.array_join(F.transform(segs, F.lower), "\0")


def resolve(dirs: DataFrame, shipped: DataFrame | None = None, suffixes: list[str] | None = None, worktrees: list[tuple[str, str]] | None = None) -> DataFrame:
    """cwd, project of a set of directories, each decided with knowledge of the others.

    dirs: cwd. shipped: cwd, repos array<string>. A directory takes its own evidence; else that of its nearest enclosing
    directory with some; else the name of the outermost enclosing directory that has one; else its own name. Enclosing
    directories are matched by segments without case; of spellings of one directory the least stands for all.
    Two joins on keys of ancestors; no iteration.
    """
    base = dirs.select("cwd").distinct()
    base = base.join(shipped, "cwd", "left") if shipped is not None else base.withColumn("repos", F.array().cast("array<string>"))
    base = base.withColumn("segs", strip_worktree(segments("cwd"), worktrees))
    own = base.select("cwd", "segs", F.size("segs").alias("depth"), shipped_project(F.col("segs"), F.col("repos")).alias("evidence"), name_project(F.col("segs"), suffixes).alias("name"))
    own = own.withColumn("key", segment_key(F.col("segs")))
    # the spelling that comes first stands for all: what it is called is the same for every one, up to case
    known = own.filter("depth > 0").groupBy("key").agg(F.min_by(F.struct("evidence", "name"), F.col("cwd")).alias("r")).select(F.col("key").alias("above"), "r.evidence", "r.name")
    ups = own.filter("depth > 1").select("cwd", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("up"), "segs").select("cwd", "up", segment_key(F.slice("segs", F.lit(1), F.col("up"))).alias("above"))
    met = ups.join(known, "above").groupBy("cwd").agg(
        F.max_by(F.when(F.col("evidence") != "", F.col("evidence")), F.when(F.col("evidence") != "", F.col("up"))).alias("near"),
        F.min_by(F.when(F.col("name") != "", F.col("name")), F.when(F.col("name") != "", F.col("up"))).alias("outer"),
    )
    out = own.join(met, "cwd", "left")
    return out.select("cwd", F.coalesce(F.nullif("evidence", F.lit("")), "near", "outer", "name").alias("project"))
