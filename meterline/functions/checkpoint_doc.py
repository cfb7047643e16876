"""Reading the latest checkpoint out of a checkpoint report (a JSON text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which reports carry each fact, by preference.
DURATION_KEYS = (
    "end_to_end_duration",
    "end-to-end-duration",
    "endToEndDuration",
    "duration",
    "checkpoint_duration",
    "end_to_end_latency",
)
ID_KEYS = ("id", "checkpoint_id", "checkpointId")
STATUS_KEYS = ("status", "state")
TRIGGER_KEYS = ("trigger_timestamp", "triggerTimestamp", "trigger")
COMPLETE_KEYS = (
    "completion_timestamp",
    "completionTimestamp",
    "completion",
    "latest_ack_timestamp",
)


def latest_entry(report: Column) -> Column:
    """The newest checkpoint as JSON text; empty values count as missing."""

    def at(path: str) -> Column:
        found = F.get_json_object(report, path)
        return F.when(~found.isin("{}", "[]", '""', "", "0", "false"), found)

    completed = at("$.latest.completed")
    has_id = F.array_contains(F.json_object_keys(completed), "id")
    return F.coalesce(
        at("$.history.entries[0]"),
        F.when(has_id, completed),
        at("$.latest.completed.entries[0]"),
        at("$.last"),
        at("$.last_completed"),
    )


def entry_facts(entry: Column) -> Column:
    """Entry JSON to a flat map; needed because key presence matters, not only value."""
    return F.from_json(entry, "map<string,string>")


def checkpoint_id(facts: Column) -> Column:
    return _first_value(facts, ID_KEYS).try_cast("bigint")


def checkpoint_status(facts: Column) -> Column:
    return _first_value(facts, STATUS_KEYS)


def checkpoint_duration_ms(facts: Column) -> Column:
    """The first duration key present decides; without a value, completion - trigger."""
    stated = F.coalesce(
        *[F.when(F.map_contains_key(facts, key), _present(facts, key)) for key in DURATION_KEYS]
    )
    measured = F.try_subtract(
        _first_value(facts, COMPLETE_KEYS).try_cast("bigint"),
        _first_value(facts, TRIGGER_KEYS).try_cast("bigint"),
    )
    return F.coalesce(F.nullif(stated, F.lit(_NO_VALUE)).try_cast("bigint"), measured)


# Stands for "the key is there but holds null", which ends the key search.
_NO_VALUE = "null"


def _present(facts: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(facts, F.lit(key)), F.lit(_NO_VALUE))


def _first_value(facts: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_element_at(facts, F.lit(key)) for key in keys])
