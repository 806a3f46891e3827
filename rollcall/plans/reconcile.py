"""Reconciling observations with a roster, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame

from rollcall.operators import report
from rollcall.operators.claims import first_claims, value_keys, with_claim_state, with_value, with_value_forms
from rollcall.operators.decisions import Decisions, pending
from rollcall.operators.lookup import Limits, fill_cores, heavy_keys, which_small
from rollcall.operators.match import found_rows, match_keys, outcome, settled_parts, with_name_forms
from rollcall.operators.roster import Roster, duplicate_rows, index_roster
from rollcall.sources.staging import stage


#: What matching reads and no output, apart from details of issues.
SETTLED = ("full_raw", "name_present", "n_direct", "direct_id", "n_swapped", "swapped_id", "has_id", "has_name", "has_full")


@dataclass(frozen=True)
class Params:
    """Scalar settings of a run."""

    min_value: float | None = None
    max_value: float | None = None
    absent_tokens: tuple[str, ...] = ()


@dataclass
class Reconciliation:
    """Results of a run; each is a DataFrame built when first asked for."""

    roster_rows: DataFrame
    roster: Roster
    files: DataFrame
    matched: DataFrame
    limits: Limits
    sheets: DataFrame | None = None
    early_issues: list[DataFrame] = field(default_factory=list)
    files_small: bool = True
    stage_rows: bool = True
    #: Parts of the matched rows, the first of which is written already, and what makes rows of parts.
    parts: list[DataFrame] = field(default_factory=list)
    finish: Callable[[list[DataFrame]], DataFrame] | None = None
    details: bool = True

    @cached_property
    def rows(self) -> DataFrame:
        """Matched rows for outputs that read them more than once: written when first asked for.

        Rows with a known id that are written are not written again; their values are parsed again.
        """
        if not self.stage_rows:
            return self.matched
        if not self.parts or self.finish is None:
            return stage(self.matched, "matched")
        return self.finish([self.parts[0], *(stage(part, "matched") for part in self.parts[1:])])

    @cached_property
    def claims(self) -> DataFrame:
        """First claims, from the written rows where there are any.

        Written if the files are not small, as their rows per file are counted too.
        """
        found = first_claims(self.__dict__.get("rows", self.matched))
        return found if self.files_small or not self.stage_rows else stage(found, "claims")

    @cached_property
    def kept_claims(self) -> DataFrame:
        """First claims for outputs that read the rows beside them."""
        found = first_claims(self.rows)
        return stage(found, "claims") if self.stage_rows else found

    @cached_property
    def stated(self) -> DataFrame:
        """Matched rows that know whether an earlier claim exists."""
        return with_claim_state(
            self.rows, self.kept_claims, small=self.roster.small, limits=self.limits
        )

    @cached_property
    def consolidated(self) -> DataFrame:
        claims = self.__dict__.get("kept_claims", self.claims)
        return report.consolidated(self.roster.members, claims, self.files, self.files_small, self.limits)

    @cached_property
    def file_report(self) -> DataFrame:
        return report.file_report(self.files, self.rows, self.kept_claims)

    @cached_property
    def totals(self) -> DataFrame:
        return report.totals(self.consolidated)

    @cached_property
    def unclaimed(self) -> DataFrame:
        return report.unclaimed(self.consolidated)

    @cached_property
    def roster_issues(self) -> DataFrame:
        return duplicate_rows(
            self.roster_rows, self.roster.members, self.roster.small, self.limits
        )

    @cached_property
    def issues(self) -> DataFrame:
        """Issues of files, sheets and rows; ``roster_issues`` has the roster's."""
        found = report.row_issues(
            self.stated, self.files, self.kept_claims, self.files_small, self.limits, self.details
        )
        for early in self.early_issues:
            found = found.unionByName(early, allowMissingColumns=True)
        return found

    @cached_property
    def pending(self) -> DataFrame:
        return pending(self.stated, self.sheets)


@dataclass(frozen=True)
class Lookups:
    """The part of a run that no answer changes; see ``operators.match.found_rows``."""

    roster: Roster
    found: list[DataFrame]


def look_up(
    roster_rows: DataFrame,
    observations: DataFrame,
    *,
    limits: Limits = Limits(),
    roster_small: bool | None = None,
    thin: bool = False,
) -> Lookups:
    """Id and name lookups for several runs of ``reconcile`` on the same rows.

    Written where they shuffle, so that a run with other answers does not look up again.
    """
    roster = index_roster(roster_rows, limits, roster_small)
    heavy = heavy_keys(with_name_forms(observations), match_keys(roster, False), limits)
    rows = fill_cores(observations) if thin and roster.small else observations
    found = found_rows(rows, roster, limits, heavy)
    return Lookups(roster, [*found[:1], *(stage(part, "name_hits") for part in found[1:])])


def reconcile(
    roster_rows: DataFrame,
    observations: DataFrame,
    files: DataFrame | None = None,
    *,
    decisions: Decisions = Decisions(),
    params: Params = Params(),
    limits: Limits = Limits(),
    roster_small: bool | None = None,
    stage_rows: bool = True,
    thin: bool = False,
    lookups: Lookups | None = None,
    details: bool = True,
) -> Reconciliation:
    """Resolve observations to members and keep the first claim of each.

    ``roster_rows``: id, first_name, last_name, email, ord. ``observations``:
    see ``operators.match``, with sheet and value_raw. ``files``: file_ord,
    file. With ``stage_rows`` the matched rows are written once to the shared
    folder as soon as an output needs them twice, so that claims, report, issues
    and questions do not match again.
    ``thin`` tells that the observations come in fewer partitions than there are
    cores; they are spread then, unless the lookup of ids shuffles them anyway.
    ``lookups``: of the same rows and roster, for runs that differ in their answers.
    Without ``details`` those of issues tell only the value and the earlier source, and
    the other cells are not carried through the lookups.
    """
    roster = lookups.roster if lookups else index_roster(roster_rows, limits, roster_small)
    if files is None:
        files = observations.select("file_ord", "file").distinct()
    names_small, tokens_small, clamps_small, files_small = which_small(
        [decisions.name_decisions, decisions.absent_tokens, decisions.clamp_choices, files], limits
    )
    keys = match_keys(roster, decisions.name_decisions is not None and not names_small) | value_keys(
        decisions.absent_tokens is not None and not tokens_small,
        decisions.clamp_choices is not None and not clamps_small,
    )

    def formed(rows: DataFrame) -> DataFrame:
        return with_value_forms(with_name_forms(rows), params.min_value, params.max_value)

    if lookups:
        keys = {kind: key for kind, key in keys.items() if kind not in ("id", "name")}
        found = lookups.found
        counted = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        heavy = heavy_keys(formed(counted), keys, limits)
    else:
        heavy = heavy_keys(formed(observations), keys, limits)
        # The lookup of ids spreads the rows where it shuffles.
        rows = fill_cores(observations) if thin and roster.small else observations
        found = found_rows(rows, roster, limits, heavy, details)
    parts = settled_parts(found, decisions.name_decisions, names_small, limits, heavy)

    def finish(parts: list[DataFrame]) -> DataFrame:
        rows = with_value(
            outcome(parts),
            low=params.min_value, high=params.max_value, tokens=params.absent_tokens,
            token_table=decisions.absent_tokens, clamp_choices=decisions.clamp_choices,
            tokens_small=tokens_small, clamps_small=clamps_small, limits=limits,
            heavy=heavy,
        )
        return rows if details else rows.drop(*SETTLED)

    # Where saved answers to values shuffle, or nothing is written yet, the rows are written whole.
    apart = not roster.small and tokens_small and clamps_small
    return Reconciliation(
        roster_rows, roster, files, finish(parts), limits, files_small=files_small, stage_rows=stage_rows,
        parts=parts if apart else [], finish=finish, details=details,
    )
