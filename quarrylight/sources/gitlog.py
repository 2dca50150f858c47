"""The history of a git repository as commit touches."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..operators import history

COMMITS = 300
_MARK = "__COMMIT__"


def read_log(root: str, commits: int = COMMITS, timeout: int = 120) -> str | None:
    """Text of the last commits that are no merges, with their paths; None without a repository or git."""
    what = f"{_MARK}%H|%an|%ae|%aI"
    try:
        run = subprocess.run(["git", "-C", root, "log", f"-n{commits}", "--no-merges", f"--format={what}", "--name-only"], capture_output=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return run.stdout.decode("utf-8", "replace")


def touches(spark: SparkSession, root: str, commits: int = COMMITS) -> DataFrame | None:
    """(commit_hash, author_name, author_email, date, file_path, ord), or None."""
    text = read_log(root, commits)
    if text is None:
        return None
    return history.parse_log(spark.createDataFrame([(root, text)], "log_id string, text string"), _MARK)
