"""Chains whose versions arrive one at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is kept of a chain: its last version, that version's document and digest, and its place in the chain.
STATE = "version long, doc_id string, sha256 string, step int"
PAIRS = "chain_id string, cmp_id string, step int, doc_a string, doc_b string, late boolean"


def pairs_of(versions: DataFrame) -> DataFrame:
    """Pairs of consecutive versions of a stream (chain_id, version, doc_id, sha256), in append mode.

    Each chain keeps its last version only. A version whose digest is the last one's is left out, though its number
    counts as seen; a null digest is like none. A version that isn't above the last number seen is late: it comes out
    with ``late`` and no partner and changes nothing, so a repeated delivery does no harm. Within a
    micro-batch versions are put in order first. Without late ones, the pairs are those of ``chain.consecutive``
    over all rows, however these are split into micro-batches. Rows without a chain or number are left out.
    """

    def advance(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain = key[0]
        version, doc, digest, step = state.get if state.exists else (None, None, None, -1)
        rows = pd.concat(list(frames)).sort_values(["version", "doc_id"], kind="stable")
        out = []
        for its_version, its_doc, its_digest in zip(rows["version"].tolist(), rows["doc_id"].tolist(), rows["sha256"].tolist()):
            its_digest = its_digest if isinstance(its_digest, str) else None
            if version is not None and its_version <= version:
                out.append((chain, None, None, None, its_doc, True))
                continue
            version = its_version
            if its_digest is not None and its_digest == digest:
                continue
            if step >= 0:
                out.append((chain, f"{chain}:{step}", step, doc, its_doc, False))
            doc, digest, step = its_doc, its_digest, step + 1
        state.update((version, doc, digest, step))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])
        yield frame.astype({"step": "Int32"})

    rows = versions.where("chain_id is not null and version is not null")
    rows = rows.select(F.col("chain_id").cast("string"), F.col("version").cast("long"), F.col("doc_id").cast("string"), F.col("sha256").cast("string"))
    return rows.groupBy("chain_id").applyInPandasWithState(advance, PAIRS, STATE, "append", GroupStateTimeout.NoTimeout)
