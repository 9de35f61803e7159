import json
import threading
from datetime import datetime

import pytest

from postmill import api
from postmill.functions.failures import Failure, HttpFailure, SourceFailure, failure_of, seconds_of
from postmill.outcome import Outcome, SiteFailure, SiteSummary
from postmill.request import SearchRequest
from postmill.sources.boards import Capabilities
from postmill.sources.registry import Registry
from postmill.streaming.checkpoint import Conflict, SiteState
from postmill.streaming.consumer import Consumer, supervised
from postmill.streaming.listing_stream import EventLog, local_folder
from postmill.streaming.search import Cancellation, Cancelled, Context, Progress, Unacknowledged
from test_checkpoint import STORES


def _zip(key, **more):
    return {"listing_key": key, "name": f"Job {key}", "job_description": "<p>Call us</p>", "hiring_company": {"name": "Acme"}, "job_country": "US", **more}


@pytest.fixture
def recorded(tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    pages = [[_zip("a"), _zip("b")], [_zip("b"), _zip("c"), {"name": "no key"}], [_zip("d")]]
    lines = [json.dumps({"page": k + 1, "items": [{"raw": x} for x in page], "cursor": f"t{k}" if k < 2 else None}) for k, page in enumerate(pages)]
    (folder / "zip_recruiter.jsonl").write_text("\n".join(lines))
    google = ["Nurse", "Clinic", "Berlin, Germany", [["https://x.test/1"]], *[None] * 8, "2 days ago", *[None] * 6, "remote work", *[None] * 8, "g1"]
    (folder / "google.jsonl").write_text(json.dumps({"page": 1, "items": [{"raw": google}, {"raw": ["short"]}]}))
    return folder


# -- DataFrames -----------------------------------------------------------------------------------------------


def test_batch_search_dedups_limits_and_flattens(spark, recorded):
    for table in (api.search_table, api.scrape_jobs):
        rows = table(spark, str(recorded), "2025-07-01", sites=("zip_recruiter", "google"), results_wanted=3).collect()
        assert len(rows[0]) == 37
        assert [(r.site, r.id) for r in rows] == [("google", "go-g1"), ("zip_recruiter", "zr-a"), ("zip_recruiter", "zr-b"), ("zip_recruiter", "zr-c")]
        assert rows[0].is_remote and str(rows[0].date_posted) == "2025-06-29" and rows[0].location == "Berlin, Germany"


def test_offset_skips_raw_rows_of_each_site(spark, recorded):
    found = api.search(spark, SearchRequest(sites=("zip_recruiter",), offset=2), str(recorded), "2025-07-01")
    assert sorted(r.id for r in found.collect()) == ["zr-b", "zr-c", "zr-d"]


@pytest.mark.parametrize(("how", "count"), [({"search_term": "NURSE clinic"}, 1), ({"search_term": "pilot"}, 0), ({"location": "berlin"}, 1), ({"location": "Rome"}, 0), ({"is_remote": True}, 1), ({"hours_old": 24}, 0), ({"hours_old": 48}, 1)])
def test_filters_that_a_listing_can_answer(spark, recorded, how, count):
    assert api.search(spark, SearchRequest(sites=("google",), **how), str(recorded), "2025-07-01").count() == count


# -- sources of our own, without Spark ------------------------------------------------------------------------------


def _job(n):
    return {"title": f"Job {n}", "job_url": f"https://x.test/{n}", "id": str(n)}


class Paged:
    """Pages of listings, resumed by page; fails as often as told."""

    capabilities = Capabilities(frozenset({"search_term"}))

    def __init__(self, site="own", pages=((0, 1), (2,)), failures=(), runs=None):
        self.site, self.pages, self.failures, self.runs = site, pages, failures, runs if runs is not None else []

    def scrape(self, request, context=None):
        self.runs.append(context.resume_state)
        page = context.resume_state.get("page", 0)
        if len(self.runs) <= len(self.failures):
            raise self.failures[len(self.runs) - 1]
        seen = sum(map(len, self.pages[:page]))
        while context.should_continue and page < len(self.pages):
            for n in self.pages[page]:
                context.emit_job(_job(n), {"page": page})
            seen += len(self.pages[page])
            page += 1
            context.emit_progress({"page": page}, page, seen, has_more=page < len(self.pages))


def _stream(*sources, store=None, request=None, **how):
    registry = Registry()
    for s in sources:
        registry.register(s.site, lambda s=s: s, s.capabilities)
    made = SearchRequest(sites=tuple(s.site for s in sources), **(request or {}))
    return api.stream_search(None, "", "2025-07-01", made, registry=registry, store=store, retry_backoff=0.0, **how)


def _told(stream):
    return [(e.type, e.job["id"] if e.job else None) for e in stream]


WHOLE = [("job", "0"), ("job", "1"), ("progress", None), ("job", "2"), ("progress", None), ("site_complete", None), ("search_complete", None)]


def test_events_are_numbered_without_gaps_and_the_last_tells_the_totals():
    events = list(_stream(Paged()))
    assert [(e.type, e.job["id"] if e.job else None) for e in events] == WHOLE and [e.sequence for e in events] == list(range(1, 8))
    assert (events[-1].total_jobs, events[-1].total_errors, events[-1].completed) == (3, 0, True) and events[2].progress == Progress(1, 2, 2, None, True)
    with pytest.raises(TypeError):
        events[0].resume_state["page"] = 5


@pytest.mark.parametrize("kind", sorted(STORES))
@pytest.mark.parametrize("acknowledged", range(8))
def test_a_restart_at_any_event_loses_none_and_repeats_only_what_was_open(kind, acknowledged, tmp_path):
    store = STORES[kind](tmp_path)
    first = _stream(Paged(), store=store, ack="explicit")
    for _ in range(acknowledged):
        if (event := next(first, None)) is not None:
            first.ack(event)
    next(first, None)  # delivered, but not acknowledged
    first.wait_closed(5)
    done = [n for t, n in WHOLE[:acknowledged] if t == "job"]
    rest = [n for t, n in _told(_stream(Paged(), store=store)) if t == "job"]
    assert done + rest == ["0", "1", "2"]
    held = store.load()
    assert held.completed and held.sites["own"].completed and len(held.sites["own"].keys) == held.sites["own"].emitted == 3


def test_a_page_counts_as_done_when_its_progress_is_acknowledged(tmp_path):
    store, runs = STORES["sqlite"](tmp_path), []
    stream = _stream(Paged(runs=runs), store=store, ack="explicit")
    for _ in range(2):
        stream.ack(next(stream))
    next(stream)
    assert store.load().sites["own"].state == {"page": 0}
    stream.wait_closed(5)
    stream = _stream(Paged(runs=runs), store=store, ack="explicit")
    assert next(stream).type == "progress" and stream.checkpoint.sites["own"].state == {"page": 0}
    stream.ack()
    assert store.load().sites["own"].state == {"page": 1}
    stream.wait_closed(5)


def test_explicit_acknowledgement_is_asked_for_and_in_order():
    stream = _stream(Paged(), ack="explicit")
    one = next(stream)
    with pytest.raises(Unacknowledged):
        next(stream)
    stream.ack(one), stream.ack(one)
    two = next(stream)
    with pytest.raises(ValueError):
        stream.ack(one)
    assert two.job["id"] == "1" and stream.checkpoint.revision == 2
    assert stream.wait_closed(5) and next(stream, None) is None


def test_a_site_that_fails_leaves_the_others_alone():
    outcome_of = lambda *s, **k: _collected(*s, **k)
    got = outcome_of(Paged("good"), Paged("bad", failures=[RuntimeError("boom")] * 9))
    assert (got.status, got.total_jobs, got.total_failures) == ("partial", 3, 1) and got.succeeded_sites == ("good",) and got.failed_sites == ("bad",)
    assert got.failures[0].failure.code == "adapter_failure" and got.summary_for("bad").failure_count == 1
    with pytest.raises(KeyError):
        got.summary_for("none")
    with pytest.raises(api.SearchFailed) as raised:
        outcome_of(Paged("bad", failures=[RuntimeError("boom")]), strict=True)
    assert raised.value.outcome.status == "failed" and "boom" in str(raised.value)


def _collected(*sources, strict=False):
    registry = Registry()
    for s in sources:
        registry.register(s.site, lambda s=s: s, s.capabilities)
    return api.collect_jobs(None, "", "2025-07-01", SearchRequest(sites=tuple(s.site for s in sources)), strict=strict, registry=registry)


DISPOSITIONS = [
    (HttpFailure("x", 429, retry_after="0"), "rate_limited", 3), (HttpFailure("x", 503), "transient_network", 3), (HttpFailure("x", 403), "authentication_configuration", 1),
    (HttpFailure("x", 410, cursor_active=True), "cursor_expired", 1), (HttpFailure("x", 404), "invalid_request", 1), (TimeoutError("slow"), "transient_network", 3),
    (ValueError("bad"), "invalid_request", 1), (SourceFailure("odd"), "adapter_failure", 1), (RuntimeError("got HTTP 500"), "transient_network", 3), (RuntimeError("Too many requests"), "rate_limited", 3),
]


@pytest.mark.parametrize(("error", "code", "attempts"), DISPOSITIONS)
def test_what_is_tried_again(error, code, attempts):
    runs = []
    events = list(_stream(Paged(failures=[error] * 9, runs=runs), max_retries=2))
    failed = next(e for e in events if e.type == "error")
    assert len(runs) == attempts and failed.failure.code == code and failed.failure.resets == (code == "cursor_expired") and not events[-1].completed
    assert sum(e.type == "warning" for e in events) == attempts - 1


def test_a_flaky_source_is_tried_again_without_an_error():
    assert [e for e in _told(_stream(Paged(failures=[TimeoutError()]))) if e[0] != "warning"] == WHOLE


def test_limits_count_what_was_acknowledged_before(tmp_path):
    store, runs = STORES["json"](tmp_path), []
    assert [n for t, n in _told(_stream(Paged(pages=((0, 1, 2, 3),), runs=runs), store=store, request={"results_wanted": 2})) if t == "job"] == ["0", "1"]
    held = store.load()
    assert held.completed and held.sites["own"].emitted == 2
    assert _told(_stream(Paged(runs=runs), store=store, request={"results_wanted": 2})) == [("search_complete", None)] and len(runs) == 1
    assert _told(_stream(Paged(runs=runs), request={"results_wanted": 0})) == [("site_complete", None), ("search_complete", None)] and len(runs) == 1


def test_an_error_behind_the_limit_is_none():
    class Late(Paged):
        def scrape(self, request, context=None):
            super().scrape(request, context)
            raise RuntimeError("late")

    assert [t for t, _ in _told(_stream(Late(pages=((0,),)), request={"results_wanted": 1}))][-2:] == ["site_complete", "search_complete"]


def test_returned_listings_are_emitted_once():
    class Returning(Paged):
        def scrape(self, request, context=None):
            context.emit_job(_job(1), {})
            return [_job(1), _job(2)]

    assert [n for t, n in _told(_stream(Returning())) if t == "job"] == ["1", "2"]


def test_filters_that_a_source_does_not_know_are_told_once():
    told = [e.message for e in _stream(Paged(), request={"location": "Rome", "distance": 9}) if e.type == "warning"]
    assert told == ["own: filters not supported: distance, location"]


def test_cancelling_and_closing_are_prompt():
    class Waiting(Paged):
        def scrape(self, request, context=None):
            context.emit_job(_job(1), {})
            context.wait(60)

    flag = threading.Event()
    stream = _stream(Waiting(), cancel_event=flag)
    assert next(stream).type == "job" and not stream.diagnostics().quiescent
    flag.set()
    with pytest.raises(Cancelled):
        next(stream)
    assert stream.wait_closed(5) and stream.diagnostics().closed
    stream.close()
    with pytest.raises(ValueError):
        stream.wait_closed(-1)
    other = _stream(Waiting(), cancel_callback=lambda: flag.is_set())
    with pytest.raises(Cancelled):
        next(other)


def test_a_conflict_closes_the_stream(tmp_path):
    store = STORES["sqlite"](tmp_path)
    one, two = _stream(Paged(), store=store, ack="explicit"), _stream(Paged(), store=store, ack="explicit")
    a, b = next(one), next(two)
    one.ack(a)
    with pytest.raises(Conflict):
        two.ack(b)
    assert next(two, None) is None and one.wait_closed(5) and two.wait_closed(5)


def test_starting_afresh_forgets_and_fences(tmp_path):
    store = STORES["folder"](tmp_path)
    list(_stream(Paged(), store=store))
    assert [n for t, n in _told(_stream(Paged(), store=store, resume=False)) if t == "job"] == ["0", "1", "2"]


def test_listings_that_cannot_be_delivered_are_not_seen():
    taken = []
    context = Context(None, "own", SearchRequest(sites=("own",)), SiteState(), lambda note: bool(taken), Cancellation())
    assert not context.emit_job(_job(1), {"page": 3}) and context.emitted_count == 0 and context.resume_state == {}
    taken.append(1)
    assert context.emit_job(_job(1), {"page": 3}) and not context.emit_job(_job(1)) and context.already_seen(_job(1))


def test_outcomes_that_contradict_themselves_are_refused():
    failed = SiteFailure("a", 1, Failure("adapter_failure"))
    for bad in (lambda: SiteSummary("a", 0, (), False), lambda: SiteSummary("a", 0, (failed,), True), lambda: Outcome((), (SiteSummary("a", 1, (), True),), 1, 0, True),
                lambda: Outcome((("b", {}),), (SiteSummary("a", 0, (), True),), 1, 0, True), lambda: Outcome((), (SiteSummary("a", 0, (failed,)),), 0, 1, True), lambda: Progress(3, 1, 2), lambda: Progress(3, None, 0, 2)):
        with pytest.raises(ValueError):
            bad()


def test_waits_and_arguments():
    assert seconds_of("7") == 7.0 and seconds_of("9999") == 300.0 and seconds_of("-3") == 0.0 and seconds_of("nan") is None and seconds_of("soon") is None and seconds_of(None) is None
    assert seconds_of("Tue, 01 Jul 2025 00:01:00 GMT", datetime.fromisoformat("2025-07-01T00:00:00+00:00")) == 60.0
    assert failure_of(HttpFailure("x", 429, retry_after="4")).retry_after == 4.0
    for bad in ({"queue_size": 0}, {"max_retries": -1}, {"ack": "never"}):
        with pytest.raises(ValueError):
            _stream(Paged(), **bad)
    with pytest.raises(TypeError):
        api.build_search_request(SearchRequest(), sites=("indeed",))
    with pytest.raises(ValueError):
        api.stream_search(None, "", "2025-07-01", SearchRequest(), store=object(), checkpoint_path="x")
    waits, calls = [], []

    def run():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "done"

    assert supervised(run, 3, 0.5, lambda e: (True, 0.7), waits.append) == "done" and waits == [0.7, 1.0]


def test_requests_are_checked_and_comparable():
    a, b = SearchRequest(sites=("ZipRecruiter", "zip-recruiter", "Indeed")), SearchRequest(sites=("zip_recruiter", "indeed"))
    assert a.sites == ("zip_recruiter", "indeed") and a.fingerprint() == b.fingerprint()
    assert SearchRequest(job_type="Part-time").job_type == "parttime"
    for bad in ({"sites": ()}, {"country": "atlantis"}, {"job_type": "odd"}, {"max_pages": 0}, {"offset": -1}, {"sites": ("no name!",)}):
        with pytest.raises(ValueError):
            SearchRequest(**bad)


# -- recorded boards ------------------------------------------------------------------------------------------------


def test_recorded_boards_are_resumed_page_by_page(spark, recorded, tmp_path):
    store = STORES["sqlite"](tmp_path)
    how = {"sites": ("zip_recruiter",), "store": store}
    stream = api.stream_search(spark, str(recorded), "2025-07-01", ack="explicit", **how)
    for _ in range(4):  # a, b, progress, c
        stream.ack(next(stream))
    stream.wait_closed(20)
    assert store.load().sites["zip_recruiter"].state == {"continue_token": "t0", "page": 2, "skipped": 0, "raw_seen": 2}
    rest = list(api.stream_search(spark, str(recorded), "2025-07-01", **how))
    assert [e.job["id"] for e in rest if e.type == "job"] == ["zr-d"] and [e.type for e in rest if e.type == "warning"] == ["warning"]
    assert store.load().sites["zip_recruiter"].completed


def test_offset_limit_and_failures_of_recorded_boards(spark, recorded):
    lines = (recorded / "zip_recruiter.jsonl").read_text().split("\n")
    page = {**json.loads(lines[1]), "failures": [{"status": 503}]}
    (recorded / "zip_recruiter.jsonl").write_text("\n".join([lines[0], json.dumps(page), lines[2]]))
    got = api.collect_jobs(spark, str(recorded), "2025-07-01", sites=("zip_recruiter", "google", "bayt"), offset=1, results_wanted=2, retry_backoff=0.0)
    assert sorted(j["id"] for _, j in got.jobs) == ["zr-b", "zr-c"] and got.status == "partial" and got.failed_sites == ("bayt",)
    assert sorted(j["id"] for j in api.stream_jobs(spark, str(recorded), "2025-07-01", sites=("zip_recruiter",), retry_backoff=0.0)) == ["zr-a", "zr-b", "zr-c", "zr-d"]
    with pytest.raises(RuntimeError):
        list(api.stream_jobs(spark, str(recorded), "2025-07-01", sites=("bayt",), raise_on_error=True))


# -- the log ----------------------------------------------------------------------------------------------------------


def test_the_log_takes_each_listing_once_and_goes_on_after_a_restart(spark, recorded, tmp_path):
    folder = local_folder(tmp_path / "run")
    run = lambda: api.stream_to_log(spark, str(recorded), folder, "2025-07-01", sites=("zip_recruiter",), results_wanted=5)
    assert sorted(r.id for r in run().collect()) == ["zr-a", "zr-b", "zr-c", "zr-d"]
    with (recorded / "zip_recruiter.jsonl").open("a") as more:
        more.write("\n" + json.dumps({"page": 4, "items": [{"raw": _zip("a")}, {"raw": _zip("e")}, {"raw": _zip("f")}]}))
    assert sorted(r.id for r in run().collect()) == ["zr-a", "zr-b", "zr-c", "zr-d", "zr-e"]
    log = EventLog(spark, f"{folder}/log")
    events = log.read().orderBy("number").collect()
    assert [r.number for r in events] == list(range(1, len(events) + 1)) and [r.type for r in events].count("progress") == 4 and [r.type for r in events].count("warning") == 1
    # whatever is acknowledged, the next event follows it, also where two share a page
    for stop in range(0, len(events), 3):
        store = STORES["memory"](tmp_path)
        first = Consumer(log, store, "f", explicit=True)
        for row, _ in zip(first, range(stop)):
            first.ack(row)
        got = [r.number for r in Consumer(log, store, "f")]
        assert got == list(range(stop + 1, len(events) + 1))
        assert list(Consumer(log, store, "f")) == []
