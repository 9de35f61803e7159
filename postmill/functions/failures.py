"""Failures of sources, sorted into stable classes: by native columns over logged failures, and on the
driver as they happen."""

from __future__ import annotations

import math
import re
import ssl
from dataclasses import dataclass
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRY_CAP = 300.0
RETRYABLE = ("transient_network", "rate_limited")
RESETTING = ("cursor_expired",)


def status_class(status: Column, cursor_active: Column) -> Column:
    return (
        F.when(status == 429, "rate_limited")
        .when(status.isin(401, 403), "authentication_configuration")
        .when(cursor_active & (status == 410), "cursor_expired")
        .when(status.isin(408, 425) | status.between(500, 599), "transient_network")
        .when(status.between(400, 499), "invalid_request")
        .otherwise("adapter_failure")
    )


def message_class(message: Column, cursor_active: Column) -> Column:
    low = F.lower(message)
    expired = low.rlike("cursor|continuation|continue token|page token") & low.rlike("expired|invalid|stale|no longer valid")
    return (
        F.when(cursor_active & expired, "cursor_expired")
        .when(low.rlike("rate limit|too many requests"), "rate_limited")
        .when(low.rlike("unauthorized|forbidden|authentication|api key"), "authentication_configuration")
        .otherwise("adapter_failure")
    )


def exception_class(kind: Column, message: Column) -> Column:
    """The class of an exception by the name of its type and its message, in this order: trouble with
    certificates and proxies, with the network, wrong values, an HTTP status in the text, a rate
    limit in the text."""
    status = F.regexp_extract(message, r"(?i)\bHTTP\s+(\d{3})\b", 1).try_cast("int")
    return (
        F.when(kind.isin("SSLError", "ProxyError", "InvalidProxyURL"), "authentication_configuration")
        .when(kind.isin("Timeout", "ConnectTimeout", "ReadTimeout", "ConnectionError", "RetryError", "TimeoutError"), "transient_network")
        .when(kind.isin("TypeError", "ValueError"), "invalid_request")
        .when(status.isNotNull(), status_class(status, F.lit(False)))
        .when(F.lower(message).rlike("rate limit|too many requests"), "rate_limited")
        .otherwise("adapter_failure")
    )


def is_retryable(code: Column) -> Column:
    return code.isin(*RETRYABLE)


def resets_checkpoint(code: Column) -> Column:
    return code.isin(*RESETTING)


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds or an HTTP date, between 0 and RETRY_CAP; null for anything else."""
    number = value.try_cast("double")
    stamp = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]{3}, ", ""), r" GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(number, F.unix_timestamp(stamp).cast("double") - F.unix_timestamp(now))
    sound = wait.isNotNull() & ~F.isnan(wait) & (F.abs(wait) < float("inf"))
    return F.when(sound, F.least(F.greatest(wait, F.lit(0.0)), F.lit(RETRY_CAP)))


def retry_delay(attempt: Column, base: float, retry_after: Column) -> Column:
    """Doubling waits, never shorter than what the source asked for."""
    return F.greatest(F.lit(base) * F.pow(F.lit(2.0), attempt), F.coalesce(retry_after, F.lit(0.0)))


# -- on the driver -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Failure:
    """A class of failure, what may be done about it, and what happened."""

    code: str
    kind: str = "Exception"
    message: str = ""
    retry_after: float | None = None

    @property
    def retryable(self) -> bool:
        return self.code in RETRYABLE

    @property
    def resets(self) -> bool:
        return self.code in RESETTING

    @property
    def recoverable(self) -> bool:
        return self.retryable or self.resets


class SourceFailure(Exception):
    """A failure whose class is known where it is raised."""

    code = "adapter_failure"

    def __init__(self, message: str = "", code: str | None = None, retry_after: float | None = None) -> None:
        super().__init__(message)
        self.code, self.retry_after = code or self.code, retry_after


class HttpFailure(SourceFailure):
    """An answer that isn't one, by its status and, for the others, its message."""

    def __init__(self, site: str, status: int, message: str | None = None, cursor_active: bool = False, retry_after: str | float | None = None) -> None:
        code = code_of_status(status, cursor_active)
        if status < 400 and message:
            code = code_of_message(message, cursor_active)
        super().__init__(f"{site} answered {status}" + (f": {message}" if message else ""), code, seconds_of(retry_after))


def code_of_status(status: int, cursor_active: bool) -> str:
    """The same order as ``status_class``."""
    exact = {429: "rate_limited", 401: "authentication_configuration", 403: "authentication_configuration", 408: "transient_network", 425: "transient_network"}
    if cursor_active:
        exact[410] = "cursor_expired"
    return exact.get(status) or {4: "invalid_request", 5: "transient_network"}.get(status // 100, "adapter_failure")


def code_of_message(message: str, cursor_active: bool) -> str:
    low = message.lower()
    if cursor_active and re.search("cursor|continuation|continue token|page token", low) and re.search("expired|invalid|stale|no longer valid", low):
        return "cursor_expired"
    if re.search("rate limit|too many requests", low):
        return "rate_limited"
    return "authentication_configuration" if re.search("unauthorized|forbidden|authentication|api key", low) else "adapter_failure"


def seconds_of(value: str | float | None, now: datetime | None = None) -> float | None:
    """A wait in seconds or until an HTTP date, between 0 and RETRY_CAP; None for anything else."""
    if value is None:
        return None
    try:
        wait = float(value)
    except ValueError:
        try:
            wait = (parsedate_to_datetime(str(value)) - (now or datetime.now(timezone.utc))).total_seconds()
        except (TypeError, ValueError):
            return None
    return min(max(wait, 0.0), RETRY_CAP) if math.isfinite(wait) else None


def failure_of(error: BaseException) -> Failure:
    """The class of an exception: as it says itself, or by its type, or by a status or a rate limit in
    its text."""
    kind, text = type(error).__name__, str(error)
    if isinstance(error, SourceFailure):
        return Failure(error.code, kind, text, error.retry_after)
    names = {c.__name__ for c in type(error).__mro__}
    status = re.search(r"\bHTTP\s+(\d{3})\b", text, re.I)
    if isinstance(error, ssl.SSLError) or names & {"SSLError", "ProxyError", "InvalidProxyURL"}:
        code = "authentication_configuration"
    elif isinstance(error, (TimeoutError, ConnectionError)) or names & {"Timeout", "ConnectTimeout", "ReadTimeout", "RetryError"}:
        code = "transient_network"
    elif isinstance(error, (TypeError, ValueError)):
        code = "invalid_request"
    elif status:
        code = code_of_status(int(status.group(1)), False)
    else:
        code = "rate_limited" if re.search("rate limit|too many requests", text.lower()) else "adapter_failure"
    return Failure(code, kind, text)
