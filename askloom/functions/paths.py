"""Paths that agents name: where they lead within a workspace, and whether they may be written. Plain Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The workspace's name for agents, and what they may not write.
ROOT = "/workspace/project"
FOLDERS = [".opencode", "eval_attempts", "trajectory", "subagent_view"]
FILES = ["paper.txt", "harness_summary.json"]
NAMES = [".", "askloom", "sitecustomize", "usercustomize"]  # hidden ones, this package and what starts by itself
ENDINGS = [".py", ".pyc", ".pth", ".so", ".sh", ".egg-link"]


def within(path: Column, root: str = ROOT) -> Column:
    """A path in its shortest form relative to the workspace; null if it is the workspace itself or leads out of it."""
    p = strip(F.replace(path, F.lit("\\"), F.lit("/")))
    p = F.when(p.startswith(f"{root}/"), F.substr(p, F.lit(len(root) + 2))).otherwise(p)
    none = F.array().cast("array<string>")

    def walk(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(p, "/"), none, walk)
    inside = ~p.startswith("/") & (F.size(parts) > 0) & (F.get(parts, F.lit(0)) != "..")
    return F.when(inside, F.array_join(parts, "/"))


def writable(path: Column, root: str = ROOT) -> Column:
    """Whether an agent may write there: never the evaluator, its outputs, transcripts, the paper, or anything that can be imported."""
    p = within(path, root)
    base = F.element_at(F.split(p, "/"), -1)
    no = F.get(F.split(p, "/"), F.lit(0)).isin(FOLDERS) | p.isin(FILES)
    for x in NAMES:
        no = no | base.startswith(x)
    for x in ENDINGS:
        no = no | base.endswith(x)
    return F.coalesce(~no, F.lit(False))
