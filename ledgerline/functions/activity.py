"""The nine product counters of a daily usage row and their monthly names."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nine usage counters in source column order.
COUNTERS = (
    "meeting_count",
    "page_view_count",
    "page_visit_count",
    "note_viewed_count",
    "ai_chat_message_submitted_count",
    "note_synced_count",
    "dashboard_viewed_count",
    "meeting_agenda_viewed_count",
    "task_synced_count",
)

# Counter -> monthly total column, in the order the monthly usage model emits them.
MONTHLY_TOTALS = {
    "meeting_count": "total_meetings",
    "page_view_count": "total_page_views",
    "page_visit_count": "total_page_visits",
    "note_viewed_count": "total_notes_viewed",
    "ai_chat_message_submitted_count": "total_ai_chats",
    "note_synced_count": "total_notes_synced",
    "dashboard_viewed_count": "total_dashboards_viewed",
    "meeting_agenda_viewed_count": "total_meeting_agendas_viewed",
    "task_synced_count": "total_tasks_synced",
}

# Counter -> user-day count column, in the order the adoption model emits them.
DAYS_WITH = {
    "meeting_count": "days_with_meetings",
    "ai_chat_message_submitted_count": "days_with_ai_chat",
    "page_view_count": "days_with_page_views",
    "page_visit_count": "days_with_page_visits",
    "note_viewed_count": "days_with_notes_viewed",
    "note_synced_count": "days_with_notes_synced",
    "dashboard_viewed_count": "days_with_dashboards",
    "meeting_agenda_viewed_count": "days_with_meeting_agendas",
    "task_synced_count": "days_with_tasks",
}


def row_total(prefix: str = "") -> Column:
    """Sum of the nine counters of one row; NULL when any counter is NULL (equal weights)."""
    return reduce(add, [F.col(prefix + c) for c in COUNTERS])


def flag(condition: Column) -> Column:
    """SQL ``CASE WHEN cond THEN 1 ELSE 0 END``: NULL conditions give 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))
