"""A registry of user extractors over snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[DataFrame], DataFrame]


@dataclass
class ExtractorRegistry:
    """Extractors by id. One takes the files of its sources (snapshot, source, text) and returns snapshot, data and complete."""

    known: dict[str, tuple[tuple[str, ...], Extractor]] = field(default_factory=dict)

    def register(self, extractor_id: str, sources: tuple[str, ...], extract: Extractor) -> None:
        if extractor_id in self.known:
            raise ValueError(f"extractor {extractor_id} is registered twice")
        self.known[extractor_id] = (sources, extract)

    def run(self, files: DataFrame) -> DataFrame:
        """snapshot, extractor_id, data, complete, by extractor id; an extractor gives no row for snapshots without any of its sources."""
        if not self.known:
            return files.select("snapshot", F.lit("").alias("extractor_id"), F.lit("").alias("data"), F.lit(False).alias("complete")).limit(0)
        parts = []
        for name, (sources, extract) in sorted(self.known.items()):
            own = files.filter(F.col("source").isin(*sources))
            parts.append(extract(own).select("snapshot", F.lit(name).alias("extractor_id"), "data", "complete"))
        return reduce(DataFrame.unionByName, parts)

    def diagnostics(self, files: DataFrame) -> DataFrame:
        """Extractors that lack sources in a snapshot: snapshot, extractor_id, present, missing (sorted), code SOURCES_ABSENT (it gives no row there) or SOURCES_PARTIAL."""
        asked = sorted({s for sources, _ in self.known.values() for s in sources})
        # a set of registered names at most
        there = files.groupBy("snapshot").agg(F.collect_set(F.when(F.col("source").isin(*asked), F.col("source"))).alias("there"))
        wanted = F.array(*[F.struct(F.lit(name).alias("extractor_id"), F.array(*map(F.lit, sources)).alias("wanted")) for name, (sources, _) in sorted(self.known.items())])
        j = there.select("snapshot", "there", F.inline(wanted))
        present, missing = F.array_sort(F.array_intersect("wanted", "there")), F.array_sort(F.array_except("wanted", "there"))
        code = F.when(F.size(present) == 0, F.lit("SOURCES_ABSENT")).otherwise(F.lit("SOURCES_PARTIAL"))
        return j.filter(F.size(missing) > 0).select("snapshot", "extractor_id", present.alias("present"), missing.alias("missing"), code.alias("code"))
