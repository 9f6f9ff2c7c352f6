"""Column resolution and canonical projection (C1, S2): driver-side over column names, then one select."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted column names, in order of preference.
ALIASES = {
    "cdr": {
        "caller": ["Mobile_No", "caller_id", "caller", "caller_msisdn", "subscriber_id", "calling_party", "a_party", "A_Party_No"],
        "receiver": ["Other_Party_No", "receiver_msisdn", "receiver_id", "receiver", "callee_id", "called_party", "b_party", "B_Party_No"],
        "timestamp": ["timestamp", "call_timestamp", "session_timestamp", "datetime", "event_time", "start_datetime", "TIME1 (dd/MM/yyyy HH:mm:ss)"],
        "date": ["Call_Date", "call_date", "date"],
        "time": ["Call_Initiation_Time(CIT)", "call_time", "start_time", "time"],
        "timezone": ["timezone", "time_zone", "tz", "utc_offset", "UTC Offset"],
        "duration": ["duration_seconds", "Call_Duration", "call_duration", "duration"],
        "event_type": ["Call_Type", "Service_Type", "event_type", "type"],
        "cell": ["cell_id", "First_Cell_id", "First CELL ID", "tower_id"],
    },
    "ipdr": {
        "subscriber": ["Landline/MSISDN/MDN/Leased Circuit ID for Internet Access", "subscriber_id", "msisdn", "Mobile_No", "user_id", "User Id for internet Access based on authentication"],
        "timestamp": ["timestamp", "call_timestamp", "session_timestamp", "datetime", "event_time", "start_datetime", "TIME1 (dd/MM/yyyy HH:mm:ss)"],
        "date": ["Start Date of Public IP Address allocation (dd/mm/yyyy)", "start_date", "date"],
        "time": ["IST Start Time of Public IP address allocation (hh:mm:ss)", "start_time", "time"],
        "timezone": ["timezone", "time_zone", "tz", "utc_offset", "UTC Offset"],
        "destination": ["destination_ip", "Destination IP Address", "destination", "remote_ip"],
        "port": ["destination_port", "Destination Port", "Destination_Port", "DestinationPort"],
        "cell": ["cell_id", "First_Cell_id", "First CELL ID", "tower_id"],
        "megabytes": ["megabytes_transferred", "megabytes", "data_mb"],
        "upload": ["Data Volume Up Link", "upload_kb", "uplink_kb"],
        "download": ["Data Volume Down Link", "download_kb", "downlink_kb"],
        "session_duration": ["Session Duration (Seconds)", "duration_seconds", "session_duration"],
    },
}
REQUIRED = {"cdr": ["caller"], "ipdr": ["subscriber"]}
#: Fields that a row must name to be a header.
HEADER = {"cdr": ["caller", "receiver"], "ipdr": ["subscriber"]}


def plain_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.casefold())


def find_column(columns: list[str], names: list[str]) -> str | None:
    """The first of names among columns exactly, else by lower-case letters and digits (the last such column)."""
    for n in names:
        if n in columns:
            return n
    plain = {plain_name(c): c for c in columns}
    return next((plain[plain_name(n)] for n in names if plain_name(n) in plain), None)


def is_header(row: list[str], kind: str, overrides: dict[str, str] | None = None) -> bool:
    """Whether a row names all that a kind's header must: by the names asked for, or by known ones."""
    asked = overrides or {}
    if all(f in asked for f in HEADER[kind]) and all(find_column(row, [asked[f]]) for f in HEADER[kind]):
        return True
    return all(find_column(row, ALIASES[kind][f]) for f in HEADER[kind])


def resolve_schema(columns: list[str], kind: str, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Canonical field -> column. Overrides win; a missing required column or an unknown override is an error."""
    found = {}
    for field, names in ALIASES[kind].items():
        asked = (overrides or {}).get(field)
        if asked is not None and asked not in columns:
            raise ValueError(f"column {asked!r} for {field} is not in {columns}")
        column = asked or find_column(columns, names)
        if column:
            found[field] = column
    for field in REQUIRED[kind]:
        if field not in found:
            raise ValueError(f"no column for {field} among {columns}")
    if "time" in found and "date" not in found:
        del found["time"]
    return found


def canonicalize_source(df: DataFrame, kind: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Only the columns that resolve, by their canonical names; `when` is the text of the event's time."""
    found = resolve_schema(df.columns, kind, overrides)
    quoted = {f: F.col(f"`{c}`") for f, c in found.items()}
    when = quoted.get("timestamp")
    if when is None and "date" in quoted:
        when = F.concat_ws(" ", F.coalesce(quoted["date"], F.lit("")), *([F.coalesce(quoted["time"], F.lit(""))] if "time" in quoted else []))
    kept = [c.alias(f) for f, c in quoted.items() if f not in ("timestamp", "date", "time")]
    return df.select(*kept, (F.lit(None).cast("string") if when is None else F.trim(when)).alias("when"))
