import threading

from biblink.sources import client, settings
from pyspark.sql import functions as F


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def index(answers, name="pubmed"):
    clock = Clock()
    calls = []

    def transport(url, headers):
        calls.append(url)
        answer = answers[min(len(calls), len(answers)) - 1]
        if isinstance(answer, Exception):
            raise answer
        return answer

    return client.Index(name, transport, lambda: clock.now, clock.sleep, lambda: 0.0), clock, calls


def test_retries_back_off_and_give_up():
    one, clock, calls = index([(503, "busy"), ConnectionError("x"), (200, "{}")])
    assert one.get("u") == ("{}", None) and len(calls) == 3 and clock.slept[:2] == [1.0, 2.0]
    one, _, calls = index([(500, "no")])
    assert one.get("u") == (None, "gave up: HTTP 500 no") and len(calls) == 4


def test_quota_wall_disables_for_good_and_rejections_do_not_retry():
    one, _, calls = index([(429, "Insufficient budget")])
    assert one.get("u")[0] is None and "quota" in one.get("v")[1] and len(calls) == 1
    one, _, calls = index([(429, "slow down"), (200, "ok")])
    assert one.get("u") == ("ok", None)
    one, _, calls = index([(404, "")])
    assert one.get("u") == (None, None) and len(calls) == 1
    one, _, calls = index([(400, "bad field")])
    assert one.get("u") == (None, "HTTP 400 bad field") and len(calls) == 1
    assert client.retryable(502) and not client.retryable(403) and not client.quota_wall(500, "add funds")


def test_requests_are_paced():
    one, clock, _ = index([(200, "x")])
    for _ in range(5):
        one.get("u")
    assert abs(clock.now - 4 * client.INTERVALS["pubmed"]) < 1e-9


def test_fetch_deals_indexes_out_and_isolates_failures(spark):
    rows = [(i, p, f"http://{p}/{i}") for i in range(6) for p in ("crossref", "openalex", "semanticscholar")]
    df = spark.createDataFrame(rows, "id long, provider string, url string")

    def transport(url, headers):
        if "openalex" in url:
            raise ValueError("broken")
        return 200, '{"at":"' + url + '"}'

    old = client.FIRST_DELAY
    progress = spark.sparkContext.accumulator(0)
    try:
        client.FIRST_DELAY = 0.0
        got = client.fetch(df.where("id < 1 or provider <> 'openalex'"), transport, progress=progress).collect()
    finally:
        client.FIRST_DELAY = old
    by = {(r.id, r.provider): r for r in got}
    assert progress.value == 13 == len(by)
    assert by[3, "crossref"].json == '{"at":"http://crossref/3"}' and by[3, "crossref"].error is None
    assert by[0, "openalex"].json is None and "broken" in by[0, "openalex"].error
    assert by[0, "semanticscholar"].json is None and by[0, "semanticscholar"].error is None
    assert "semanticscholar" in client.enabled({"semanticscholar": "k"}) and client.request_url("http://x", {"q": "a b"}) == "http://x?q=a+b"


def test_tagged_jobs_can_be_cancelled(spark):
    with client.cancellable(spark, "slow") as cancel:
        threading.Timer(3.0, cancel).start()
        try:
            spark.range(0, 10**10, 1, 64).select(F.sum(F.sin("id"))).collect()
        except Exception as e:
            assert "cancel" in str(e).lower()
        else:
            raise AssertionError("not cancelled")
    assert spark.range(3).count() == 3


def test_settings(tmp_path, monkeypatch):
    path = tmp_path / "a" / "settings.json"
    assert settings.load(path) == {} and not settings.forget(path)
    settings.save({"mailto": "a@b", "library_key": "secret12", "other": "x", "library_user": ""}, path)
    settings.save({"library_user": "7"}, path)
    assert settings.load(path) == {"mailto": "a@b", "library_key": "secret12", "library_user": "7"}
    assert path.stat().st_mode & 0o777 == 0o600
    monkeypatch.setenv("BIBLINK_MAILTO", "env@b")
    assert settings.chosen({"library_user": "9"}, path) == {"mailto": "env@b", "library_key": "secret12", "library_user": "9"}
    assert settings.shown(settings.load(path))["library_key"] == "…et12"
    path.write_text("[1]")
    assert settings.load(path) == {}
    assert settings.forget(path)
