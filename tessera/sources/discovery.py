"""A source tree as a classified file table, with an issue for whatever is left out."""

from __future__ import annotations

import fnmatch
import os
import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.functions import vocab as V
from tessera.runtime import ship_package

FILES = "path string, length long, content binary"
ISSUES = "path string, reason string, detail string"


# --- lexical containment, on the driver --------------------------------------------------


def normalise_lexically(path: str) -> str:
    """``.`` and inner ``..`` go; a leading climb stays; the file system isn't asked."""
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return ("/" if path.startswith("/") else "") + "/".join(out)


def climbs(path: str) -> bool:
    return normalise_lexically(path).split("/")[0] == ".."


def drive_relative(path: str) -> bool:
    return len(path) > 1 and path[1] == ":" and path[0].isalpha() and path[2:3] not in ("/", "\\")


def relative_path(root: str, path: str) -> str | None:
    """Path below a root, by components; None outside of it."""
    root, path = normalise_lexically(root).rstrip("/"), normalise_lexically(path)
    if path == root:
        return ""
    return path[len(root) + 1 :] if path.startswith(root + "/") else None


def contains(root: str, path: str) -> bool:
    return relative_path(root, path) is not None


# --- ignore rules ------------------------------------------------------------------------


class IgnoreRules:
    """Rules of ignore files, the last match wins; a rule holds below its file's folder."""

    def __init__(self):
        self.rules: list[tuple[str, str, bool, bool]] = []

    def add(self, folder: str, text: str) -> None:
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dir = line.endswith("/")
            self.rules.append((folder, line.rstrip("/"), keep, only_dir))

    def ignored(self, path: str, is_dir: bool) -> bool:
        out = False
        for folder, pattern, keep, only_dir in self.rules:
            if folder and not path.startswith(folder + "/"):
                continue
            rel = path[len(folder) + 1 :] if folder else path
            if only_dir and not is_dir:
                continue
            if "/" in pattern:
                hit = self._match(rel.split("/"), pattern.lstrip("/").split("/"))
            else:
                hit = fnmatch.fnmatchcase(rel.rsplit("/", 1)[-1], pattern)
            if hit:
                out = not keep
        return out

    @staticmethod
    def _match(parts: list[str], pattern: list[str]) -> bool:
        if not pattern:
            return not parts
        if pattern[0] == "**":
            return any(IgnoreRules._match(parts[k:], pattern[1:]) for k in range(len(parts) + 1))
        return bool(parts) and fnmatch.fnmatchcase(parts[0], pattern[0]) and IgnoreRules._match(parts[1:], pattern[1:])


def walk(root: str, exclude=V.VCS_NAMES + V.NOISE_NAMES, ignore_files=(".gitignore", ".ignore")) -> tuple[list[str], list[tuple[str, str, str]]]:
    """(relative paths, issues) of a tree: excluded and ignored folders are pruned, links to
    files inside the root are followed, links to folders are not, escapes and dangling links
    are issues. Only the listing happens here; contents are read by executors."""
    found, issues, rules = [], [], IgnoreRules()
    names = {n.lower() for n in exclude}
    real_root = os.path.realpath(root)
    for folder, dirs, files in os.walk(root):
        rel = posixpath.join(*os.path.relpath(folder, root).split(os.sep)) if folder != root else ""
        for name in ignore_files:
            if name in files:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    rules.add(rel, f.read())
        keep = []
        for d in sorted(dirs):
            p = f"{rel}/{d}" if rel else d
            if d.lower() in names or rules.ignored(p, True):
                continue
            if os.path.islink(os.path.join(folder, d)):
                issues.append((p, "directory_link", os.readlink(os.path.join(folder, d))))
                continue
            keep.append(d)
        dirs[:] = keep
        for f in sorted(files):
            p, full = (f"{rel}/{f}" if rel else f), os.path.join(folder, f)
            if rules.ignored(p, False):
                continue
            if os.path.islink(full):
                target = os.path.realpath(full)
                if not os.path.exists(target):
                    issues.append((p, "dangling_link", os.readlink(full)))
                    continue
                if not contains(real_root, target):
                    issues.append((p, "link_escapes", target))
                    continue
            found.append(p)
    return found, issues


def case_insensitive(root: str) -> bool:
    """Whether the file system folds case, by asking for a name that it has in other case."""
    for name in os.listdir(root):
        other = name.swapcase()
        if other != name:
            return os.path.exists(os.path.join(root, other)) and other not in os.listdir(root)
    return False


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, length, content) of listed files, read by the executors in Arrow batches. Contents
    over the cap are not read. Roots must be reachable from executors."""
    ship_package(spark)
    base, cap = os.path.abspath(root), V.MAX_FILE_BYTES

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p in batch.column("path").to_pylist():
                full = os.path.join(base, p)
                size, data = 0, None  # a file that can't be read is an issue, not an error
                try:
                    size = os.path.getsize(full)
                    if size <= cap:
                        with open(full, "rb") as f:
                            data = f.read()
                except OSError:
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["path", "length", "content"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(len(paths) // 64 + 1, 200))).mapInArrow(run, FILES)


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """The same through Spark's own reader, for roots in any store."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.expr("substring_index(path, '" + root.rstrip("/").replace("'", "\\'") + "/', -1)")
    return df.select(rel.alias("path"), F.col("length"), "content")


def discover(files: DataFrame, max_bytes: int = V.MAX_FILE_BYTES, fold_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """(discovered: path, language, classification, size_bytes, text; issues).

    In order: excluded names, unknown extensions, the size cap, invalid UTF-8 (with the first
    bad byte), and twins under case folding, of which the first path stays.
    """
    base = files.withColumn("path", X.normalize_path("path")).where("path IS NOT NULL").where(~X.excluded("path"))
    lang = X.language_of("path")
    text_ok = F.expr("is_valid_utf8(content)")
    verdict = (F.when(lang.isNull(), "unsupported_extension").when(F.col("length") > max_bytes, "too_large").when(F.col("content").isNull(), "unreadable").when(~text_ok, "invalid_utf8"))
    judged = base.withColumn("_why", verdict).withColumn("language", lang)
    if fold_case:
        w = Window.partitionBy(X.ascii_lower("path")).orderBy("path")
        judged = judged.withColumn("_why", F.when(F.col("_why").isNull() & (F.row_number().over(w) > 1), "case_twin").otherwise(F.col("_why")))
    good = judged.where("_why IS NULL").withColumn("text", F.expr("decode(content, 'UTF-8')"))
    out = good.select("path", "language", X.classify("path", "text").alias("classification"), F.col("length").alias("size_bytes"), "text")
    bad_at = F.udf(first_bad_byte, "int")  # only for the few files with a defect
    detail = F.when(F.col("_why") == "invalid_utf8", F.concat(F.lit("first bad byte at "), bad_at("content").cast("string"))).when(F.col("_why") == "too_large", F.concat(F.col("length").cast("string"), F.lit(" bytes")))
    return out, judged.where("_why IS NOT NULL").select("path", F.col("_why").alias("reason"), detail.alias("detail"))


def first_bad_byte(content: bytes | None) -> int | None:
    if content is None:
        return None
    try:
        bytes(content).decode("utf-8")
    except UnicodeDecodeError as e:
        return e.start
    return None


def statistics(discovered: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files, bytes, largest, counts by classification and language, issues by reason."""
    a = discovered.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("size_bytes"), F.lit(0)).alias("largest"))
    hist = lambda df, c, name: df.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(a).join(one(hist(discovered, "classification", "by_classification")), "_one").join(one(hist(discovered, "language", "by_language")), "_one").join(one(hist(issues, "reason", "by_reason")), "_one").drop("_one")


def empty_reason(files: int, unsupported: int, issues: int) -> str | None:
    """Why a walk found nothing to index."""
    if files:
        return None
    if not issues:
        return "no_files"
    return "no_indexable_extensions" if unsupported == issues else "all_unusable"


def fnv_repo_id(root: str, git_dir: str | None = None) -> str:
    """Identity of a repository from its canonical paths: four salted FNV-1a lanes."""
    text = os.path.realpath(root) + "\0" + (git_dir or "")
    return "".join(X.fnv1a64(f"{k}:{text}").split(":")[1] for k in range(4))


def index_location(repo_id: str, environ=os.environ) -> str:
    """Folder of the index: an override, else the user's cache."""
    base = environ.get("TESSERA_INDEX_DIR") or os.path.join(environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache"), "tessera")
    return os.path.join(base, repo_id[:32])
