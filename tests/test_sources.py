import json

import pytest
from pyspark.sql import functions as F

from postmill import api
from postmill.request import SearchRequest, unsupported
from postmill.sources import replay, translate, wire
from postmill.sources.boards import BOARDS, Capabilities
from postmill.sources.registry import Registry, check_listings, check_source, default_registry, legacy_source
from postmill.sources.replay import ListingReplay, walk


def test_lists_are_found_depth_first():
    row = ["Dev", "Acme"]
    assert wire.list_under({"a": [{"b": {wire.LISTING_KEY: row}}], wire.LISTING_KEY: 3}) == row
    deep = [row]
    for _ in range(5000):
        deep = [deep]
    assert wire.list_under(deep) is None and wire.list_under(None) is None
    body = "junk [[[" + json.dumps(json.dumps([[[{wire.LISTING_KEY: row}]]])) + "]]] tail"
    assert wire.unwrapped(body) == [json.dumps(row)] and wire.unwrapped("[[[") == [] and wire.unwrapped(None) == []
    page = f'x"{wire.LISTING_KEY}":["Cook [night]", ["a"] ]}}]]]]] "{wire.LISTING_KEY}": 7, "{wire.LISTING_KEY}" : ["Maid", broken "{wire.LISTING_KEY}":["Nurse"]'
    assert wire.listings_of_page(page) == ['["Cook [night]", ["a"] ]', '["Nurse"]'] and wire.listings_of_page(None) == []
    assert wire.cursor_in_body('<div data-async-fc="c7">') == "c7" and wire.cursor_in_body(None) is None


def test_bodies_of_boards_are_taken_apart():
    assert wire.listings_in_body("naukri", json.dumps({"jobDetails": [{"jobId": "é"}]})) == ['{"jobId": "é"}']
    assert wire.listings_in_body("indeed", json.dumps({"data": {"jobSearch": {"results": [{"job": {"key": "k"}}]}}})) == ['{"key": "k"}']
    assert wire.listings_in_body("glassdoor", json.dumps([{"data": {"jobListings": {"jobListings": [{"jobview": 1}]}}}])) == ['{"jobview": 1}']
    for broken in (None, "", "{", "[]", '{"jobDetails": 3}'):
        assert wire.listings_in_body("naukri", broken) == []
    cards = wire.listings_in_body("linkedin", "<ul><li><div class='base-search-card x'>A <b>&lt;b&gt;</b> tail<br>end</div></li><li><div class='base-search-card'>B</div></li></ul>")
    assert cards == ['<div class="base-search-card x">A <b>&lt;b&gt;</b> tail<br>end</div>', '<div class="base-search-card">B</div>']
    assert wire.listings_in_body("bayt", "<ul><li data-js-job><h2>x</h2></li><li>no</li></ul>") == ['<li data-js-job=""><h2>x</h2></li>']
    assert wire.listings_in_body("bdjobs", "<section><p>Clerk</p><a href='jobdetails.asp?id=1'>x</a></section>") == ['<section><p>Clerk</p><a href="jobdetails.asp?id=1">x</a></section>']


def test_cursors_and_starts(spark):
    df = spark.sql("select array(named_struct('pageNumber', 2, 'cursor', 'c2'), named_struct('pageNumber', 3, 'cursor', 'c3')) as c")
    assert df.select(wire.cursor_for_page(F.col("c"), F.lit(3)).alias("v"), wire.cursor_for_page(F.col("c"), F.lit(9)).alias("w")).first() == ("c3", None)
    assert wire.rounded_start(27) == (20, 7)


def test_requests_in_the_words_of_boards():
    r = SearchRequest(search_term="cook", location="Lyon", hours_old=30, job_type="fulltime", easy_apply=True, country="france")
    assert translate.params("linkedin", r)["f_TPR"] == "r108000" and translate.params("linkedin", r)["f_JT"] == "F"
    assert translate.params("zip_recruiter", r)["days"] == 2 and translate.params("zip_recruiter", r)["employment_type"] == "full_time"
    assert translate.one_of(r) == ("hours_old", ["easy_apply", "job_type"]) and "job_type" not in translate.params("indeed", r)
    assert translate.params("google", r)["q"] == "cook fulltime near Lyon in the last 3 days"
    assert unsupported(r, translate.SUPPORTED["bayt"]) == "filters not supported: country, easy_apply, hours_old, job_type, location"
    assert api.warnings_of(SearchRequest(search_term="x"), default_registry()) == {}
    assert translate.exclusive_warning("indeed", r) == "indeed filters by hours_old only; left out: easy_apply, job_type" and translate.exclusive_warning("bayt", r) is None
    assert translate.params("linkedin", SearchRequest(company_ids=[7, 9]))["f_C"] == "7,9"


def test_places_of_the_review_board():
    assert translate.glassdoor_location(None, True) == (11047, "STATE")
    assert translate.glassdoor_location([{"locationId": "5", "locationType": "C"}], False) == (5, "CITY")
    with pytest.raises(ValueError):
        translate.glassdoor_location([], False)


# -- how boards page ------------------------------------------------------------------------------------


def _recorded(tmp_path, site, pages, **more):
    lines = [json.dumps({"items": [{"raw": f"{k}.{i}"} for i in range(n)], "cursor": c, **more.get(f"page{k}", {})}) for k, (n, c) in enumerate(pages, 1)]
    (tmp_path / f"{site}.jsonl").write_text("\n".join(lines))
    file = tmp_path / f"{site}.jsonl"
    return {"path": str(tmp_path), "steps": "99"}, [(str(file), 0, file.stat().st_size)]


def _walked(site, options, path, **more):
    rows = list(walk(BOARDS[site], {**options, **more}, path))
    return [r[4] for r in rows if r[1] == "listing"], [json.loads(r[7]) for r in rows if r[1] == "progress"], rows


SIZES = {"linkedin": [(25, None)] * 3, "indeed": [(2, "b"), (2, "c"), (1, None)], "zip_recruiter": [(2, "b"), (2, "c"), (1, None)], "glassdoor": [(30, "b"), (30, "c"), (4, None)],
         "google": [(10, "b"), (10, "c"), (3, None)], "bayt": [(3, None), (3, None), (0, None), (3, None)], "naukri": [(20, None), (20, None), (5, None), (20, None)], "bdjobs": [(3, None), (2, None)]}
READ = {"linkedin": 75, "indeed": 5, "zip_recruiter": 5, "glassdoor": 64, "google": 23, "bayt": 6, "naukri": 45, "bdjobs": 5}


@pytest.mark.parametrize("site", sorted(BOARDS))
def test_a_board_is_read_to_its_end_and_from_any_state(site, tmp_path):
    options, path = _recorded(tmp_path, site, SIZES[site])
    whole, states, rows = _walked(site, options, path)
    assert len(whole) == READ[site] and states[-1].get("raw_seen") == len(whole)
    sequence = [r[3] for r in rows]
    assert sequence == sorted(sequence) and len(set(sequence)) == len(sequence)
    # from the state of each page on, with and without the hint where it lies, the rest follows
    for row in (r for r in rows if r[1] == "progress" and not json.loads(r[4])["ended"]):
        rest = whole[sum(r[1] == "listing" and r[3] < row[3] for r in rows) :]
        hint = {"byte": row[10], "before": json.loads(row[4])["before"]}
        assert _walked(site, options, path, state=row[7])[0] == rest == _walked(site, options, path, state=row[7], **hint)[0]
    assert len(_walked(site, options, path, max_pages="1")[1]) == 1


def test_states_within_a_page_and_starts_by_offset(tmp_path):
    options, path = _recorded(tmp_path, "naukri", SIZES["naukri"])
    _, _, rows = _walked("naukri", options, path, offset="23")
    assert rows[0][4] == "2.0" and rows[0][6] == 20 and json.loads(rows[2][7]) == {"page": 2, "page_skip": 3, "raw_seen": 23, "pages_fetched": 0}
    assert _walked("naukri", options, path, state=rows[2][7])[2][0][6] == 20
    options, path = _recorded(tmp_path, "linkedin", SIZES["linkedin"])
    _, states, rows = _walked("linkedin", options, path, offset="37")
    assert rows[0][4] == "2.5" and rows[0][6] == 30 and states[0] == {"start": 50, "pages_completed": 1, "raw_seen": 20}
    options, path = _recorded(tmp_path, "glassdoor", SIZES["glassdoor"])
    _, states, rows = _walked("glassdoor", options, path, offset="31")
    assert rows[0][6] == 30 and states[0] == {"page": 3, "cursor": "c", "pages_fetched": 1, "raw_seen": 30}
    assert [r[8] for r in rows if r[1] == "progress"] == [True, False]
    assert not BOARDS["linkedin"].may_fetch({"start": 1000, "pages_completed": 3}, 50) and not BOARDS["glassdoor"].may_fetch({"page": 31, "pages_fetched": 2}, 50)


def test_unknown_counts_stay_unknown(tmp_path):
    options, path = _recorded(tmp_path, "indeed", SIZES["indeed"])
    _, states, rows = _walked("indeed", options, path, state=json.dumps({"cursor": "b", "page": 2}))
    assert [s["raw_seen"] for s in states] == [None, None] and rows[0][6] is None


def test_expired_cursors_and_recorded_failures(tmp_path):
    options, path = _recorded(tmp_path, "indeed", SIZES["indeed"], page2={"failures": [{"status": 503}]})
    rows = _walked("indeed", options, path, state=json.dumps({"cursor": "old", "page": 2}))[2]
    assert [r[1] for r in rows] == ["error"] and json.loads(rows[0][4])["status"] == 410
    assert [r[1] for r in _walked("indeed", options, path)[2]][-1] == "error" and len(_walked("indeed", options, path, attempt="1")[0]) == 5


def test_a_page_of_any_length_keeps_numbers_apart(spark, tmp_path):
    _recorded(tmp_path, "bayt", [(150_000, None), (2, None)])
    default_registry().install(spark)
    rows = spark.read.format("listing_replay").option("path", str(tmp_path)).load().where("kind = 'listing'")
    assert rows.count() == rows.select("sequence").distinct().count() == 150_002
    assert spark.read.format("listing_replay").option("path", str(tmp_path / "none")).load().count() == 0


def test_files_of_a_site_are_read_through_and_in_parts(spark, tmp_path, monkeypatch):
    folder = tmp_path / "naukri.jsonl"
    folder.mkdir()
    for part in range(3):
        (folder / f"part-{part}").write_text("".join(json.dumps({"page": part * 4 + k + 1, "items": [{"raw": f"{part}.{k}.{i}"} for i in range(20)]}) + "\n" for k in range(4)))
    (folder / "_SUCCESS").write_text("")
    options = {"path": str(tmp_path), "steps": "99"}
    parts = replay._files(options)["naukri"]
    whole, states, rows = _walked("naukri", options, parts)
    assert len(whole) == 240 and states[-1]["page"] == 13
    fifth = [r for r in rows if r[1] == "progress"][5]
    assert _walked("naukri", options, parts, state=fifth[7], byte=fifth[10], before=json.loads(fifth[4])["before"])[0] == whole[120:]
    every = [r for r in replay._all_rows(options, replay.SiteRange("naukri", *parts[0][:2], 0, parts[0][2]))]
    for most in (7, 100, 333, 10_000):
        split = [r for x in replay._ranges("naukri", parts[:1], 0, parts[0][2], most) for r in replay._all_rows(options, x)]
        assert split == every
    default_registry().install(spark)
    got = spark.read.format("listing_replay").option("path", str(tmp_path)).load().where("kind = 'listing'")
    assert sorted(r.raw for r in got.collect()) == sorted(whole) and got.select("sequence").distinct().count() == 240


# -- registry -----------------------------------------------------------------------------------------------


class Own:
    site, capabilities = "own_board", Capabilities(frozenset({"search_term"}))

    def scrape(self, request, context=None):
        return []


def test_registry_takes_a_site_once_and_knows_the_eight_boards():
    registry = default_registry()
    assert set(registry.sites()) == set(BOARDS) and registry.cursor_version("Zip-Recruiter") == 1
    with pytest.raises(ValueError):
        registry.register("indeed", Own)
    with pytest.raises(ValueError):
        registry.add_spark_source(ListingReplay)
    other = registry.copy()
    other.register("own-board", Own)
    assert "own_board" in other.sites() and "own_board" not in registry.sites()
    for bad in ("", "9x", "a b!", "x" * 65):
        with pytest.raises(ValueError):
            other.register(bad, Own)
    with pytest.raises(ValueError):
        registry.create("nowhere")


def test_registry_checks_what_a_factory_makes():
    registry = Registry()
    registry.register("own_board", Own, capabilities=Capabilities())
    with pytest.raises(TypeError):
        registry.create("own_board")
    registry.register("own_board", Own, cursor_version=2, replace=True)
    with pytest.raises(TypeError):
        registry.create("own_board")
    registry.register("own_board", Own, replace=True)
    assert registry.capabilities("own_board") == Own.capabilities
    registry.register("other", Own)
    with pytest.raises(TypeError):
        registry.create("other")
    with pytest.raises(ValueError):
        registry.register("third", Own, cursor_version=0)
    with pytest.raises(ValueError):
        Capabilities(job_types=frozenset({"fulltime"}))


def test_sources_without_context_are_wrapped():
    class Plain:
        site = "plain"

        def scrape(self, request):
            return [{"title": "Cook", "job_url": "https://x.test/1"}]

    registry = Registry()
    registry.register("plain", legacy_source(Plain))
    made = registry.create("plain")
    assert not made.capabilities.resumes and len(made.scrape(SearchRequest(sites=("plain",)), None)) == 1
    registry.register("plain", Plain, replace=True)
    with pytest.warns(DeprecationWarning):
        assert not registry.create("plain").capabilities.resumes


def test_the_contract_of_sources():
    check_source(Own(), "own_board")
    for broken in (object(), type("A", (Own,), {"site": "A b"})(), type("B", (Own,), {"capabilities": {}})(), type("C", (Own,), {"scrape": 3})()):
        with pytest.raises(TypeError):
            check_source(broken)
    check_listings([{"title": "x", "job_url": "https://x.test"}]), check_listings(None)
    for broken in ("text", {"title": "x"}, 7, [3], [{"title": "x"}]):
        with pytest.raises(TypeError):
            check_listings(broken)
