"""Registration states, seat lines, tracker signals, links and invitations, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sorrel.functions.dates import ZONE, local_day

STATES = ("registration_open", "registration_closed", "no_upcoming_dates", "waitlist", "not_yet_open", "availability_unknown")


def _url(value: Column) -> Column:
    return F.when(F.trim(value) != "", F.trim(value))


def registration_action(seat: Column, status: Column, register_url: Column, waitlist_url: Column) -> Column:
    """struct<state, url>: what a session's button does. Confirmed full wins over any status; a full or closed session leads to its waitlist only."""
    wait, register = _url(waitlist_url), _url(register_url)
    closed = F.struct(F.when(wait.isNotNull(), "waitlist").otherwise("full_or_closed").alias("state"), wait.alias("url"))
    full = (seat == "confirmed_full") | (status == "registration_closed")
    state = F.when(status.isin(*STATES), status).otherwise("availability_unknown")
    return F.when(F.coalesce(full, F.lit(False)), closed).otherwise(F.struct(state.alias("state"), F.when(status == "waitlist", wait).otherwise(register).alias("url")))


def seat_line(state: Column, left: Column, checked_at: Column, manual_day: Column, now: Column, zone: str = ZONE) -> Column:
    """struct<text, tone> of a reading that is younger than seven days and not older than the manual check's day; counts only within two hours, with the local time of the check, later with its day."""
    age = F.unix_timestamp(now) - F.unix_timestamp(checked_at)
    usable = state.isin("available", "full", "waitlist") & F.coalesce(left >= 0, F.lit(True)) & (age < 7 * 86400) & F.coalesce(manual_day <= local_day(checked_at, zone), F.lit(True))
    at, fresh = F.from_utc_timestamp(checked_at, zone), age < 2 * 3600
    when = F.concat(F.lit(" · checked "), F.when(fresh, F.lower(F.date_format(at, "h:mm a"))).otherwise(F.date_format(at, "MMM d")))

    def line(text: Column, tone: Column | str) -> Column:
        return F.struct(F.concat(text, when).alias("text"), (F.lit(tone) if isinstance(tone, str) else tone).alias("tone"))

    out = (
        F.when(~F.coalesce(usable, F.lit(False)), None).when((state == "full") | ((state == "available") & (left == 0)), line(F.lit("Full"), "full"))
        .when(state == "waitlist", line(F.lit("Full · waitlist open"), "full")).when(~fresh | left.isNull(), line(F.lit("Spots available"), "open"))
    )
    return out.otherwise(line(F.concat(left.cast("string"), F.when(left == 1, " spot left").otherwise(" spots left")), F.when(left <= 5, "warning").otherwise("open")))


def manual_seat_line(seat: Column, status: Column, waitlist_url: Column) -> Column:
    """struct<text, tone> of what was checked by hand, or null without a fact about seats."""
    full = F.struct(F.when(_url(waitlist_url).isNotNull(), "Full, waitlist").otherwise("Full").alias("text"), F.lit("full").alias("tone"))
    return F.when((seat == "confirmed_full") | (status == "waitlist"), full).when(seat == "confirmed_available", F.struct(F.lit("Spots available").alias("text"), F.lit("open").alias("tone")))


def tracker_signals(status: Column, opens_on: Column, deadline_on: Column) -> Column:
    """Ordered names of what is known about a session's registration."""
    return F.array_compact(F.array(
        F.when(opens_on.isNotNull() & ~(status == "not_yet_open"), "opens_on"), F.when(deadline_on.isNotNull(), "deadline_on_file"),
        F.when(status.isin(*STATES) & (status != "availability_unknown"), "lifecycle").otherwise("unknown"),
    ))


def crossed_full(before: Column, after: Column) -> Column:
    """Both counts are known and one of them, only one, is zero."""
    return F.coalesce((before > 0) != (after > 0), F.lit(False))


def link_status(status: Column, expires_on: Column, today: Column) -> Column:
    """opted_out and reviewed before expired, else ok."""
    return F.when(status == "opted_out", "opted_out").when(status == "reviewed", "reviewed").when(expires_on < today, "expired").otherwise("ok")


def reminder_due(status: Column, sends: Column, last_on: Column, today: Column) -> Column:
    """Sent once, not answered, seven days or more ago."""
    return F.coalesce((status == "sent") & (sends == 1) & (F.datediff(today, last_on) >= 7), F.lit(False))


def platform(url: Column, text: Column, rules: dict[str, str]) -> Column:
    """The first registration platform whose pattern the host holds, else the text; null without one."""
    out = F.lit(None).cast("string")
    for source in (text, F.regexp_extract(F.lower(url), r"^https?://([^/?#]+)", 1)):
        for name, pattern in reversed(rules.items()):
            out = F.when(F.lower(source).rlike(pattern), name).otherwise(out)
    return out


def unsafe_host(host: Column) -> Column:
    """Why a host must not be fetched: null if no rule names it. Blocked names, private and special IPv4 ranges, any IPv6 literal of this machine or a private net."""
    h = F.lower(F.regexp_replace(host, r"^\[|\]$|\.$", ""))
    v4 = r"^(?:\d{1,3}\.){3}\d{1,3}$"
    octet = [F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int") for k in (1, 2)]
    private = (octet[0].isin(0, 10, 127)) | ((octet[0] == 100) & octet[1].between(64, 127)) | ((octet[0] == 169) & (octet[1] == 254)) | ((octet[0] == 172) & octet[1].between(16, 31)) | ((octet[0] == 192) & (octet[1] == 168)) | (octet[0] >= 224)
    return (
        F.when(h.isNull() | (h == ""), "missing").when((h == "localhost") | h.rlike(r"\.(localhost|local|internal)$"), "blocked_name")
        .when(h.rlike(v4) & private, "private_ip").when(h.contains(":") & h.rlike(r"^(::1?$|f[cd]|fe[89ab]|ff|::ffff:)"), "private_ip")
    )
