"""Which events findings cite, by reference: findings point to groups of events, and each group is stored once.

A failed-login run is one group, however many findings cite it, so what is stored grows with the events and the findings, not with their
product.  Readers that want the events of many findings work on groups and meet the members last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import SPLIT, spread_join
from tidewatch.session import checkpointed

GROUP = ["website_id", "group_id"]


@dataclass(frozen=True)
class Citations:
    """``links`` (website_id, finding_id, group_id) and ``members`` (website_id, group_id, event_id)."""
    links: DataFrame
    members: DataFrame

    @staticmethod
    def of(pairs: DataFrame) -> Citations:
        """From (website_id, finding_id, event_id); every finding has a group of its own."""
        own = pairs.select("website_id", F.col("finding_id").alias("group_id"), "event_id")
        return Citations(pairs.select("website_id", "finding_id", F.col("finding_id").alias("group_id")).distinct(), own)

    def union(self, other: Citations) -> Citations:
        return Citations(self.links.unionByName(other.links), self.members.unionByName(other.members))

    def stored(self) -> Citations:
        return Citations(checkpointed(self.links), checkpointed(self.members))

    def _members(self, groups: DataFrame, how: str = "inner") -> DataFrame:
        return spread_join(self.members, groups, GROUP, how, n=SPLIT)

    def events(self, findings: DataFrame | None = None) -> DataFrame:
        """Distinct (website_id, event_id) that any finding, or one of ``findings``, cites."""
        links = self.links if findings is None else self.links.join(findings.select("website_id", "finding_id"), ["website_id", "finding_id"], "left_semi")
        return self._members(links.select(*GROUP).distinct(), "left_semi").select("website_id", "event_id").distinct()

    def tagged(self, tags: DataFrame, distinct: bool = True) -> DataFrame:
        """Distinct (website_id, *further columns, event_id): events with the tags of the findings that cite them.

        Callers that gather sets of tags can do without the rows being made distinct.  ``tags`` has website_id, finding_id and few distinct further values; they are made distinct by group before they meet its members."""
        more = [c for c in tags.columns if c not in ("website_id", "finding_id")]
        by_group = self.links.join(tags, ["website_id", "finding_id"]).select(*GROUP, *more).distinct()
        rows = self._members(by_group).select("website_id", *more, "event_id")
        return rows.distinct() if distinct else rows

    def pairs(self) -> DataFrame:
        """(website_id, finding_id, event_id) in full: as many rows as there are citations."""
        return self._members(self.links).select("website_id", "finding_id", "event_id").distinct()
