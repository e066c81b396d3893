"""Group-commit windows: a window opens at its first request and closes after a time or a count, whichever is first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def group_commit(requests: DataFrame, window: int, most: int) -> DataFrame:
    """requests (repo_id, tx, arrival) with their batch, from 0 in each repository.

    Where a window ends depends on all that came before it, so a repository's requests stream in order through one
    task, in Arrow batches of which only the open window's start and size are kept."""
    rows = requests.select("repo_id", "tx", "arrival").repartition("repo_id").sortWithinPartitions("repo_id", "arrival", "tx")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, start, n, batch = None, 0, 0, -1
        for f in frames:
            out = []
            for r, at in zip(f["repo_id"], f["arrival"], strict=True):
                if r != repo:
                    repo, batch, n, start = r, 0, 0, at
                elif at - start >= window or n >= most:
                    batch, n, start = batch + 1, 0, at
                n += 1
                out.append(batch)
            yield f.assign(batch=pd.array(out, "int64"))

    return rows.mapInPandas(run, "repo_id string, tx long, arrival long, batch long")
