"""The feed as a stream, and the watch over it."""

import json
import os

import pytest

from riskloom import cli
from riskloom.sources import feeds


def shown(folder, query, *links):
    with open(f"{folder}/{query}.json", "w", encoding="utf-8") as f:
        json.dump([{"title": f"t{n}", "link": f"http://x/{n}", "summary": "s", "published": None} for n in links], f)


def reader(folder, spool, queries=("a", "b"), **options):
    def fetch(query):
        with open(f"{folder}/{query}.json", encoding="utf-8") as f:
            return json.load(f)

    return feeds.Polls(list(queries), fetch, str(spool), options.get("most", 100), options.get("remember", 100), options.get("failures", 3))


def polled(r, start, end):
    return [(row[0], row[4][9:]) for p in r.partitions({"poll": start}, {"poll": end}) for row in r.read(p)]


def test_a_poll_gives_what_is_new_and_the_same_again(tmp_path):
    shown(tmp_path, "a", 1, 2, 2), shown(tmp_path, "b")
    r = reader(tmp_path, tmp_path / "spool")
    assert r.initialOffset() == {"poll": 0} and r.latestOffset() == {"poll": 1}
    assert polled(r, 0, 1) == [("a", "1"), ("a", "2")]
    shown(tmp_path, "a", 3, 2), shown(tmp_path, "b", 9)
    # the batch is made again by a new reader, after the feed has changed
    r = reader(tmp_path, tmp_path / "spool")
    assert polled(r, 0, 1) == [("a", "1"), ("a", "2")]
    assert r.latestOffset() == {"poll": 2} and polled(r, 1, 2) == [("a", "3"), ("b", "9")]
    r.commit({"poll": 2})
    assert os.listdir(tmp_path / "spool") == [f"{2:012d}"]
    # an entry that left the feed and comes back is still known; an added query gives all of its own
    shown(tmp_path, "a", 1, 4), shown(tmp_path, "c", 7)
    r = reader(tmp_path, tmp_path / "spool", ("c", "a"))
    assert polled(r, 2, 3) == [("c", "7"), ("a", "4")]
    assert polled(r, 3, 3) == []
    with pytest.raises(ValueError, match="new checkpoint"):
        reader(tmp_path, tmp_path / "other").partitions({"poll": 3}, {"poll": 1})


def test_what_a_poll_leaves_comes_later(tmp_path):
    shown(tmp_path, "a", *range(5))
    r = reader(tmp_path, tmp_path / "spool", ("a",), most=2)
    assert [[n for _, n in polled(r, i, i + 1)] for i in range(4)] == [["0", "1"], ["2", "3"], ["4"], []]


def test_a_query_that_fails(tmp_path):
    shown(tmp_path, "a", 1)
    r = reader(tmp_path, tmp_path / "spool", ("a",))
    assert polled(r, 0, 1) == [("a", "1")]
    os.rename(tmp_path / "a.json", tmp_path / "gone")
    assert polled(r, 1, 2) == polled(r, 2, 3) == []
    with pytest.raises(FileNotFoundError):
        polled(r, 3, 4)
    shown(tmp_path, "a", 1, 2)
    assert polled(r, 3, 4) == [("a", "2")]  # known entries outlast failures


def test_a_stream_that_starts_again(spark, tmp_path):
    """Batches that fail in the sink are made again: none is read twice, none is lost, though the feed moves on."""
    folder = str(tmp_path)

    def fetch(query):
        with open(f"{folder}/{query}.json", encoding="utf-8") as f:
            return json.load(f)

    feeds.register(spark, fetch)
    got, fail = [], []

    def sink(batch, number):
        rows = [(number, r.query, r.link[9:]) for r in batch.collect()]
        if fail:
            raise RuntimeError(fail.pop())
        got.extend(rows)

    def go():
        q = spark.readStream.format("riskloom_feed").options(queries="a\nb", spool=f"{folder}/spool").load().writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    shown(tmp_path, "a", 1, 2), shown(tmp_path, "b", 5)
    go()
    shown(tmp_path, "a", 3), shown(tmp_path, "b", 5)
    fail.append("lost")
    with pytest.raises(Exception, match="lost"):
        go()
    shown(tmp_path, "a", 4), shown(tmp_path, "b", 6)  # 3 isn't shown any more
    go()
    go()
    assert sorted(x for _, *x in got) == [["a", "1"], ["a", "2"], ["a", "3"], ["a", "4"], ["b", "5"], ["b", "6"]]


def test_watch(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "get_spark", lambda: spark)
    config, folder = tmp_path / "c.toml", str(tmp_path)
    monkeypatch.setenv("RISKLOOM_REQUEST_DELAY_SECONDS", "0")
    config.write_text('[news]\nqueries = ["q"]\n[entities]\ncompanies = ["Nvidia"]\n[sec]\ncompanies = []\n')

    def feed(query):
        name = "dated" if "after:" in query else "q" if query == "q" else None
        if not name:
            return []
        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            return json.load(f)

    empty = lambda items: items.sparkSession.createDataFrame([], "item_id string, content_type string, body string")
    said = lambda: (cli.main(["--root", f"{folder}/store", "--config", str(config), "--reports", f"{folder}/reports", "watch", "--once"], feed, lambda name: "{}", empty), capsys.readouterr().out)[1]
    shown(tmp_path, "q", 1, 2, 3), shown(tmp_path, "dated", 7)
    first = [json.loads(line) for line in said().splitlines() if line.startswith("{")]
    shown(tmp_path, "q", 4, 3)
    said()
    items = cli.Engine(spark, f"{folder}/store").store.read("items")
    assert first and sorted(r.url[9:] for r in items.collect()) == ["1", "2", "3", "4", "7"]
