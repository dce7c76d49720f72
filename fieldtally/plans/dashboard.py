"""Field monitoring of one survey: interviews against the sample frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import as_number, collapse, only_levels
from fieldtally.operators import monitor
from fieldtally.operators.linkage import attach_one
from fieldtally.operators.tabulate import formatted, frequency

# The parts of a household's address.
ADDRESS = ("ed", "building_number", "dwelling_number", "household_number")


@dataclass
class FieldMonitor:
    """Interviews (results as labels), paradata and sample frame.

    ``team`` maps an interviewer's name to their account.
    """

    base: DataFrame
    diagnostics: DataFrame
    frame: DataFrame
    review_url: str
    key: str = "interview__key"
    interview_id: str = "interview__id"
    community: str = "ctv"
    head: str = "head_name"
    frame_key: str = "interview_key"
    frame_community: str = "ctv_official"
    partial: str = "Partial"
    address: Sequence[str] = ADDRESS
    team: Mapping[str, str] = field(default_factory=dict)

    @cached_property
    def interviews(self) -> DataFrame:
        """Interviews with numeric address parts and the interviewer's name."""
        numbers = {c: as_number(F.col(c).cast("string"), "int") for c in self.address if c.endswith("_number")}
        accounts = self.diagnostics.select(self.key, "responsible")
        name = only_levels(collapse("responsible", {n: [a] for n, a in self.team.items()}), list(self.team))
        return attach_one(self.base.withColumns(numbers), accounts, [self.key]).withColumn("interviewer", name)

    @cached_property
    def counts(self) -> DataFrame:
        """Sampled, visited, completed and pending per community of the frame."""
        return monitor.frame_counts(
            self.frame, self.interviews, self.address, self.frame_key, self.frame_community, self.community
        )

    def kpis(self) -> DataFrame:
        return monitor.kpis(self.interviews, self.counts, self.community, partial=self.partial)

    def progress(self) -> DataFrame:
        return monitor.progress(self.counts, self.frame_community)

    def response(self) -> DataFrame:
        return formatted(monitor.response_table(self.interviews, self.community), digits=0)

    def map_status(self, community: str | None = None) -> DataFrame:
        """Markers of the sampled households, of one community if named."""
        frame = self.frame.select(
            F.col(self.frame_key).alias("frame_id"),
            F.col(self.frame_community).alias("frame_community"),
            F.col(self.head).alias("frame_head"),
            *self.address,
        )
        visits = self.interviews.select(
            F.col(self.key).alias("interview_key"), F.col(self.interview_id).alias("interview_id"), "result", *self.address
        )
        return monitor.map_status(monitor.frame_join(frame, visits, self.address), community, self.review_url)

    def _listed(self) -> tuple[DataFrame, list[str]]:
        columns = [self.key, self.head, self.community, "result", "interviewer"]
        return self.interviews.withColumnRenamed(self.interview_id, "interview_id"), columns

    def nonrespondents(self) -> DataFrame:
        return monitor.nonrespondents(*self._listed(), self.review_url)

    def missing_result(self) -> DataFrame:
        return monitor.missing_result(*self._listed(), self.review_url)

    def by_interviewer(self) -> DataFrame:
        return frequency(self.interviews, ["interviewer"])

    def charts(self, *columns: str) -> DataFrame:
        """Bars of several columns in one pass."""
        return monitor.chart_counts(self.interviews, {c: (F.col(c), None) for c in columns})
