"""Checks counted in the pass that builds the models, without another scan.

A run watches its monthly aggregates and its mart (``DataFrame.observe``); what was counted is
known once the mart is written. Counts are of violations: a task that runs twice after a lost
executor may count a violation twice, but never makes one of none.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.operators import classify

# how long the listener's report of a finished write is waited for
REPORT_SECONDS = 30


class CheckFailed(ValueError):
    """A watched check found violations."""


def _row_count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


@dataclass
class RunChecks:
    _watched: list[tuple[Observation, DataFrame]] = field(default_factory=list)

    def _watch(self, df: DataFrame, **counts: Column) -> DataFrame:
        columns = [F.coalesce(c, F.lit(0)).alias(name) for name, c in counts.items()]
        seen = Observation()
        self._watched.append((seen, df.agg(*columns)))
        return df.observe(seen, *columns)

    def usage(self, user_month: DataFrame) -> DataFrame:
        """User-months with ``_rows`` and ``_days``: rows beyond one for a user and day."""
        return self._watch(user_month, repeated_usage_days=F.sum(F.col("_rows") - F.bit_count("_days")))

    def arr(self, arr_monthly: DataFrame) -> DataFrame:
        """Account-months with ``_rows`` and ``_days``: rows beyond one for an account and day, of
        which first and last are undefined."""
        return self._watch(arr_monthly, repeated_arr_days=F.sum(F.col("_rows") - F.bit_count("_days")))

    def mart(self, mart: DataFrame) -> DataFrame:
        """Mart rows without a key, and with a label outside its domain."""
        domains = {
            "lifecycle_segment": classify.LIFECYCLE_SEGMENTS,
            "reason_code": classify.REASON_CODES,
            "recommended_action": classify.RECOMMENDED_ACTIONS,
            "is_expansion_ready": (0, 1),
        }
        counts = {c: _row_count(F.col(c).isNull() | ~F.col(c).isin(*values)) for c, values in domains.items()}
        no_key = _row_count(F.col("billing_account_id").isNull() | F.col("snapshot_month").isNull())
        return self._watch(mart, null_mart_keys=no_key, **{f"unknown_{c}": n for c, n in counts.items()})

    def found(self) -> dict[str, int]:
        """Violations by check, zeros included; call it when what was watched has been written.

        Spark may leave a watched part out of a plan at run time (a join with nothing on its
        other side); such a part is counted by a query of its own."""
        out: dict[str, int] = {}
        for seen, query in self._watched:
            got: dict[str, int] = {}
            waiting = threading.Thread(target=lambda s=seen, g=got: g.update(s.get), daemon=True)
            waiting.start()
            waiting.join(REPORT_SECONDS)
            out |= got or query.first().asDict()
        return out

    def require(self) -> dict[str, int]:
        """``found()``, or an error that names the checks with violations."""
        found = self.found()
        bad = {name: n for name, n in found.items() if n}
        if bad:
            raise CheckFailed(", ".join(f"{name}: {n}" for name, n in sorted(bad.items())))
        return found
