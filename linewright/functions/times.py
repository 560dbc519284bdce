"""The instant a line's timestamp text stands for.

What the text leaves out is never guessed: month-day stamps need a ``year``, times of
day a ``date``, and stamps without a zone are in ``zone``. Without the argument they need,
and where a field is out of range, there is no instant.
"""

from __future__ import annotations

from . import patterns as P
from . import sql

_MONTHS = P.MONTH.removeprefix("(?:").removesuffix(")").split("|")
_ZONED = r"(?:Z|[+-][0-9]{2}:[0-9]{2})\z"
_WHOLE = rf"^{P.DATE}[T ]{P.HMS}(?:\.[0-9]+)?(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})?\z"


def stamp_month(stamp: str) -> str:
    """Month, 1 to 12, of a stamp that has one but no year; else null."""
    name = f"array_position(array({sql.texts(_MONTHS)}), left({stamp}, 3))"
    return sql.case(
        [
            (
                f"{stamp} RLIKE {sql.text('^(?:0[1-9]|1[0-2])-')}",
                f"CAST(left({stamp}, 2) AS INT)",
            ),
            (f"{stamp} RLIKE {sql.text('^' + P.MONTH)}", f"CAST({name} AS INT)"),
        ]
    )


def event_time(
    stamp: str,
    year: int | str | None = None,
    date: str | None = None,
    zone: str = "UTC",
) -> str:
    """Timestamp, or null, for a column of timestamp texts of any format.

    ``year`` is a number, or SQL for one.
    """
    branches = [(f"{stamp} RLIKE {sql.text('^[0-9]{4}-')}", stamp)]
    if year is not None:
        if isinstance(year, str):
            head = f"concat(lpad(CAST({year} AS STRING), 4, '0'), '-')"
        else:
            head = sql.text(f"{year:04d}-")
        branches.append(
            (f"{stamp} RLIKE {sql.text('^[0-9]{2}-')}", f"concat({head}, {stamp})")
        )
        month = f"array_position(array({sql.texts(_MONTHS)}), left({stamp}, 3))"
        day = sql.extract(stamp, r"^[A-Z][a-z]{2} *+[^0-9 ]?([0-9]{1,2}) ")
        clock = sql.extract(stamp, rf" ({P.HMS})\z")
        branches.append(
            (
                f"{stamp} RLIKE {sql.text('^' + P.MONTH)}",
                f"concat({head}, lpad(CAST({month} AS STRING), 2, '0'), '-', "
                f"lpad({day}, 2, '0'), ' ', {clock})",
            )
        )
    if date is not None:
        branches.append(
            (
                f"{stamp} RLIKE {sql.text('^[0-9]{2}:')}",
                f"concat({sql.text(date + ' ')}, {stamp})",
            )
        )
    full = sql.case(branches)
    zoned = sql.case(
        [
            (f"NOT (s RLIKE {sql.text(_WHOLE)})", "NULL"),
            (f"s RLIKE {sql.text(_ZONED)}", "s"),
        ],
        f"concat(s, {sql.text(' ' + zone)})",
    )
    return f"transform(array({full}), s -> try_cast({zoned} AS TIMESTAMP))[0]"
