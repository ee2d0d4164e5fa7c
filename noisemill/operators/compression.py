"""Tables whose rare codes count as one: found from (noisy) counts, merged for measuring, drawn apart again in the end."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisemill.functions.codec import merge_rare, unmerge_rare
from noisemill.operators.private import common_codes
from noisemill.spec import Categorical, Schema


@dataclass(frozen=True)
class Compression:
    """``masks`` has, for each column that changes, which of its codes stay apart; all others of it are one code."""

    masks: dict[str, list[bool]]

    def schema(self, schema: Schema) -> Schema:
        """What the compressed table's columns are."""
        return dict(schema) | {c: Categorical(tuple(range(sum(m) + 1))) for c, m in self.masks.items()}

    def compress(self, codes: DataFrame) -> DataFrame:
        """The coded table with rare codes merged, in the scan's own projection; other columns stay, null stays null."""
        return codes.select(*((merge_rare(F.col(f"`{c}`"), self.masks[c]) if c in self.masks else F.col(f"`{c}`")).alias(c) for c in codes.columns))

    def uncompress(self, codes: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
        """Back to the declared codes. A merged code becomes one of its column's rare codes, drawn evenly by a hash
        of ``keys`` (the first of them without keys), so that a lost task draws the same again."""

        def back(c: str):
            draw = (*keys, F.lit(c)) if keys else ()
            return unmerge_rare(F.col(f"`{c}`"), self.masks[c], *draw, seed=seed)

        return codes.select(*((back(c) if c in self.masks else F.col(f"`{c}`")).alias(c) for c in codes.columns))

    def counts(self, column: str, full: np.ndarray) -> np.ndarray:
        """A column's counts after merging, from those of all its codes."""
        if column not in self.masks:
            return full
        common = np.array(self.masks[column])
        return np.append(full[common], full[~common].sum())


def find_compression(noisy: dict[str, np.ndarray], stddev: float, fixed: set[str] = frozenset()) -> Compression:
    """Merge the codes whose counts are below three standard deviations; columns in ``fixed`` keep theirs."""
    masks = {c: common_codes(x, stddev) for c, x in noisy.items() if c not in fixed}
    return Compression({c: m for c, m in masks.items() if not all(m)})
