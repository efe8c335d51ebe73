"""Two listings side by side, counts across panels, moves and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.rules import compare_glyph
from ..sources import scratch
from . import ranks


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (name, kind, size, mtime, hash) with the glyph of its row against right."""
    r = right.select("name", F.col("kind").alias("r_kind"), F.col("size").alias("r_size"), F.col("mtime").alias("r_mtime"), F.col("hash").alias("r_hash"))
    both = left.join(r, "name", "left")
    glyph = compare_glyph(F.col("kind") == "file", F.col("r_kind").isNotNull(), F.col("hash"), F.col("r_hash"), (F.col("size") == F.col("r_size")) & (F.col("mtime") == F.col("r_mtime")))
    return both.select("name", "kind", glyph.alias("glyph"))


def match_percent(compared_: DataFrame) -> DataFrame:
    files = F.count(F.when(F.col("kind") == "file", 1))
    return compared_.agg(F.when(files > 0, F.expr("count(case when kind = 'file' and glyph in ('=', '≈') then 1 end) * 100 div count(case when kind = 'file' then 1 end)")).alias("match_percent"))


def confidence(rows: DataFrame) -> DataFrame:
    files = F.count(F.when(F.col("kind") == "file", 1))
    return rows.agg(F.when(files > 0, F.expr("count(case when kind = 'file' then hash end) * 100 div count(case when kind = 'file' then 1 end)")).alias("confidence"))


def match_count(active: DataFrame, other: DataFrame) -> DataFrame:
    return active.join(other.select("hash"), "hash", "left_semi").agg(F.count(F.lit(1)).alias("matches"))


def signed(listing: DataFrame, directory: str, signatures: DataFrame) -> DataFrame:
    """Entries of a listing with what tells their content: the hash of a file, the signature (of dir) of a directory."""
    path = F.concat(F.lit("" if directory == "/" else directory), F.lit("/"), "name")
    own = signatures.select(F.col("dir").alias("path_"), "signature")
    return listing.withColumn("path_", path).join(own, "path_", "left").withColumn("content", F.when(F.col("kind") == "file", F.col("hash")).otherwise(F.col("signature"))).drop("path_", "signature")


def matches(active: DataFrame, other: DataFrame) -> DataFrame:
    """files, dirs: entries of the active listing (kind, content) whose content the other has in an entry of the same kind."""
    found = active.join(other.where("content is not null").select("kind", "content").distinct(), ["kind", "content"], "left_semi")
    return found.agg(F.count(F.when(F.col("kind") == "file", 1)).alias("files"), F.count(F.when(F.col("kind") == "dir", 1)).alias("dirs"))


def across(panels: DataFrame, content: str = "hash") -> DataFrame:
    """hash (or another column that tells the content), panels: content in at least two panels, counted once in each."""
    once = panels.where(f"`{content}` is not null").select("panel", content).distinct()
    return once.groupBy(content).agg(F.count(F.lit(1)).alias("panels")).where("panels >= 2")


def move_decisions(moved: DataFrame, there: DataFrame) -> DataFrame:
    """moved (path, name, size, hash) into a directory with there (name, size, hash): duplicate, renamed or moved, and the name it gets."""
    same = there.where("hash is not null").groupBy("size", "hash").agg(F.count(F.lit(1)).alias("copies"))
    names = there.select("name").distinct().withColumn("taken", F.lit(True))
    out = moved.join(same, ["size", "hash"], "left").join(names, "name", "left")
    decision = F.when(F.col("copies").isNotNull(), "duplicate").when(F.col("taken"), "renamed").otherwise("moved")
    return numbered_names(out.withColumn("decision", decision), there)


def _numbered(name):
    """The forms (head_, tail_, n_) that a taken name may have: ``stem.dupN.ext``, ``stem.dupN``, ``name.N``."""

    def form(pattern: str, tail: int | None):
        at = lambda i: F.regexp_extract(name, pattern, i)
        return F.when(at(2) != "", F.struct(at(1).alias("head_"), (at(tail) if tail else F.lit("")).alias("tail_"), at(2).cast("int").alias("n_")))

    forms = F.array(form(r"(?s)^(.*\.dup)(\d{1,9})(\.[^.]*)$", 3), form(r"(?s)^(.*\.dup)(\d{1,9})$", None), form(r"(?s)^(.*\.)(\d{1,9})$", None))
    return F.filter(forms, lambda f: f.isNotNull())


def numbered_names(rows: DataFrame, there: DataFrame) -> DataFrame:
    """rows (path, name, decision) with new_name: the first free ``stem.dupN.ext`` for duplicates, ``name.N`` for renamed.

    With a column dir in both, names are free or taken in their directory.  The k-th row of a form gets the k-th free number.  Used number u, the i-th in
    order, has u - i free ones before it; sorted among the rows by that, a row's place is its number.  Neither rows nor
    numbers of a form are gathered, so any number of files may ask for one name.
    """
    local = "dir" in rows.columns
    key = ["dir_", "head_", "tail_"]
    stem, ext = F.regexp_extract("name", r"(?s)^(.+)\.[^.]*$", 1), F.regexp_extract("name", r"(?s)^.+(\.[^.]*)$", 1)
    stem = F.when(stem == "", F.col("name")).otherwise(stem)
    head = F.when(F.col("decision") == "duplicate", F.concat(stem, F.lit(".dup"))).otherwise(F.concat("name", F.lit(".")))
    tail = F.when(F.col("decision") == "duplicate", ext).otherwise(F.lit(""))
    at = (lambda df: df.withColumn("dir_", F.col("dir"))) if local else (lambda df: df.withColumn("dir_", F.lit("")))
    held = scratch.cut(at(rows).withColumns({"head_": head, "tail_": tail, "row_": F.struct(*rows.columns)}), "names")
    asking = ranks.within(held.where("decision <> 'moved'").select(*key, "path", "row_"), key, "path", "k_")
    names = at(there).select("dir_", "name").distinct().select("dir_", F.explode(_numbered(F.col("name"))).alias("f")).select("dir_", "f.*").where("n_ > 0")
    used = scratch.cut(names.join(held.where("decision <> 'moved'").select(*key).distinct(), key, "left_semi").distinct(), "used")
    before = ranks.within(used, key, "n_", "i_").select(*key, F.struct((F.col("n_") - F.col("i_") + 1).alias("at"), F.lit(0).alias("kind"), F.col("n_").cast("string").alias("tie")).alias("order_"), F.lit(None).cast(held.schema["row_"].dataType).alias("row_"))
    both = scratch.cut(asking.select(*key, F.struct(F.col("k_").alias("at"), F.lit(1).alias("kind"), F.col("path").alias("tie")).alias("order_"), "row_").union(before), "numbers")
    numbered = ranks.within(both, key, "order_", "number_").where("row_ is not null")
    new = numbered.select("row_.*", F.concat("head_", F.col("number_").cast("string"), "tail_").alias("new_name"))
    return held.where("decision = 'moved'").select(*rows.columns, F.col("name").alias("new_name")).union(new.select(*rows.columns, "new_name"))


def merged(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """path, new_path, decision of the files below source when it is merged into a directory target of the same name.

    A file whose place is free is moved there; where it is taken, the file is a duplicate if the target's directory has the same size and hash, else
    renamed, and gets the first free name in that directory.
    """
    asked = manifest.where(paths.below(F.col("path"), source)).withColumn("new_path", F.concat(F.lit(target), F.substr(F.col("path"), F.lit(len(source) + 1))))
    asked = asked.withColumns({"dir": paths.parent(F.col("new_path")), "name": paths.name(F.col("new_path"))})
    there = manifest.where(paths.below(F.col("path"), target)).select(F.col("path").alias("new_path"), F.col("size").alias("t_size"), F.col("hash").alias("t_hash"))
    out = asked.join(there, "new_path", "left")
    decision = F.when(F.col("t_size").isNull(), "moved").when((F.col("size") == F.col("t_size")) & (F.col("hash") == F.col("t_hash")), "duplicate").otherwise("renamed")
    taken = there.select(F.col("new_path").alias("p")).select(paths.parent(F.col("p")).alias("dir"), paths.name(F.col("p")).alias("name"))
    arriving = asked.select("dir", "name")  # files that move to a free place take their names too
    named = numbered_names(out.select("path", "dir", "name", decision.alias("decision")), taken.union(arriving).distinct())
    return named.select("path", F.concat(F.when(F.col("dir") == "/", "").otherwise(F.col("dir")), F.lit("/"), "new_name").alias("new_path"), "decision")


def to_snapshot(sources: DataFrame, done: DataFrame) -> DataFrame:
    """dataset, seq: the datasets (of seq, dataset rows) that still need their one snapshot, by first use."""
    return sources.groupBy("dataset").agg(F.min("seq").alias("seq")).join(done.select("dataset"), "dataset", "left_anti").orderBy("seq")


def snapshots_made(due: DataFrame, failed: DataFrame) -> DataFrame:
    """dataset, seq, outcome of the datasets due (from :func:`to_snapshot`): made up to the first that failed (dataset), which is failed; those after it weren't tried."""
    broken = due.join(failed.select("dataset").distinct(), "dataset", "left_semi")
    first = broken.agg(F.min(F.struct("seq", "dataset")).alias("first"))  # one row
    at = F.struct("seq", "dataset")
    outcome = F.when(F.col("first").isNull() | (at < F.col("first")), "made").when(at == F.col("first"), "failed").otherwise("not tried")
    return due.join(F.broadcast(first)).select("dataset", "seq", outcome.alias("outcome"))


def undone(moves: DataFrame) -> DataFrame:
    """seq, source, target of the moves that take a batch back, in order."""
    last = moves.groupBy("batch").agg(F.max("seq").alias("last"))
    return moves.join(last, "batch").select((F.col("last") - F.col("seq") + 1).alias("seq"), "batch", F.col("target").alias("source"), F.col("source").alias("target"))
